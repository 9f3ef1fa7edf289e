"""What people look at: the library, a paper's citations, failures by region, the thread of proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# The region of a page in which failures of a stage are shown.
REGIONS = {
    "extract": "document", "structure": "document", "locate-refs": "references", "segment": "references",
    "parse-entry": "references", "resolve": "references", "link-markers": "markers",
}
PAPER_ID = r"^[0-9a-fA-F-]{36}\z"


def library(entries: DataFrame, most: int = 20) -> DataFrame:
    """The newest papers, a page of ``most``: (paper_id, n_entries, uploaded_at)."""
    papers = entries.groupBy("paper_id").agg(F.count("*").alias("n_entries"), F.max("recorded_at").alias("uploaded_at"))
    return papers.orderBy(F.col("uploaded_at").desc(), "paper_id").limit(most)


def citations_table(entries: DataFrame, times: DataFrame, most: int = 25) -> DataFrame:
    """The first references of each paper, as the table shows them before it is opened: label, year, times cited."""
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("entry_ix", "entry_key"))
    rows = entries.withColumn("place", rank.cast("long")).filter(F.col("place") <= most).join(times, "entry_key")
    return rows.select("entry_key", "place", tx.author_label(F.col("csl.author")).alias("label"), F.expr("try_element_at(try_element_at(csl.issued, 1), 1)").alias("year"), "times_cited")


def failures(entries: DataFrame, orphans: DataFrame, uncited: DataFrame) -> DataFrame:
    """(paper_id, stage, code, n): entries without title, papers with orphans and with uncited entries."""
    count = lambda df, stage, code: df.groupBy("paper_id").agg(F.count("*").alias("n")).select("paper_id", F.lit(stage).alias("stage"), F.lit(code).alias("code"), "n")
    return count(entries.filter("csl.title IS NULL"), "parse-entry", "no-title").unionByName(count(orphans, "link-markers", "orphan-markers")).unionByName(count(uncited, "link-markers", "uncited-references"))


def by_region(rows: DataFrame) -> DataFrame:
    """Failures by region; that of uncited references is shown live and not counted here."""
    region = F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv]), F.col("stage"))
    return rows.filter("code <> 'uncited-references'").groupBy("paper_id", region.alias("region")).agg(F.sum("n").alias("n"), F.count("*").alias("n_failures"))


def proposal_thread(names: DataFrame) -> DataFrame:
    """Two rows for each proposal, what was asked and what came of it, oldest first: (proposal_id, seq, role)."""
    proposals = names.groupBy("proposal_id").agg(F.min("created_at").alias("at"), F.count("*").alias("n"))
    rows = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("part"), F.lit("proposal").alias("role")))
    return proposals.select("proposal_id", "at", "n", F.inline(rows))


def note_counts(entries: DataFrame) -> DataFrame:
    """Papers by what their notes say: unverified entries, notes on missing titles, those that tell of rate limits."""
    note = F.coalesce("resolution.note", F.lit(""))
    limited = note.rlike("(?i)rate.?limit|429|time budget")
    return entries.groupBy("paper_id").agg(
        F.count_if(F.col("resolution.status") != "verified").alias("unverified"),
        F.count_if(note.rlike("(?i)no title")).alias("no_title"),
        F.count_if(limited).alias("rate_limited"),
        (F.count_if(limited) >= 4).alias("partial_coverage"),
    )


def valid_papers(df: DataFrame) -> DataFrame:
    return df.select("paper_id", F.coalesce(F.col("paper_id").rlike(PAPER_ID), F.lit(False)).alias("valid")).distinct()

"""Review of papers: which sections and claims to look at, what is left to do, what a judge found."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# Headings that are not reviewed, and the limits of an excerpt and of a list shown to a judge.
SKIPPED = r"(?i)^(\(front matter\)|acknowledgm?ents?|references|bibliography|appendix|notation)"
MOST_SECTIONS, EXCERPT, MOST_CLAIMS = 8, 1400, 3


def reviewable_sections(sections: DataFrame) -> DataFrame:
    """``(section_key, rank, excerpt)``: the first eight sections of level 1 or 2 of a paper that have text."""
    text = F.array_join(F.filter("paragraphs", lambda p: p.isNotNull()), "\n\n")
    rows = sections.filter((F.col("heading_level").between(1, 2)) & (F.size("paragraphs") > 0) & ~F.coalesce("heading", F.lit("")).rlike(SKIPPED))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("section_ix", "section_key"))
    return rows.select("section_key", rank.cast("long").alias("rank"), F.substring(tx.plain_superscripts(text), 1, EXCERPT).alias("excerpt")).filter(F.col("rank") <= MOST_SECTIONS)


def claims(sections: DataFrame) -> DataFrame:
    """``(paper_id, number, rank, section_key, sentence)``: for each number up to three distinct sentences that cite it."""
    paras = sections.select("section_key", "paper_id", "section_ix", F.posexplode("paragraphs").alias("para_ix", "t")).filter("t IS NOT NULL")
    spans = paras.select("section_key", "paper_id", "section_ix", "para_ix", "t", F.explode(tx.spans_of(F.col("t"), tx.BRACKET)).alias("m"))
    said = spans.select("section_key", "paper_id", "section_ix", "para_ix", F.col("m.start_pos").alias("at"), F.explode(tx.number_list(F.col("m.inner"))).alias("number"), F.trim(tx.plain_superscripts(tx.sentence_at(F.col("t"), F.col("m.start_pos")))).alias("sentence"))
    good = said.filter((F.length("sentence") >= 20) & ~tx.is_math_noise(F.col("sentence")))
    first = good.groupBy("paper_id", "number", "sentence").agg(F.min(F.struct("section_ix", "section_key", "para_ix", "at")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("paper_id", "number").orderBy("o"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= MOST_CLAIMS).select("paper_id", "number", "rank", F.col("o.section_key").alias("section_key"), "sentence")


def pending(units: DataFrame, ledger: DataFrame) -> DataFrame:
    """Units of work (run_id, unit_kind, unit_id) that the ledger has not as done."""
    return units.join(ledger.select("run_id", "unit_kind", "unit_id").distinct(), ["run_id", "unit_kind", "unit_id"], "left_anti")


def statistics(units: DataFrame) -> DataFrame:
    """Counts of a run: units of each kind, claims among them, supported and withdrawn ones."""
    return units.groupBy("run_id").agg(
        F.count_if(F.col("unit_kind") == "section").alias("sections_scanned"),
        F.count_if(F.col("unit_kind") == "entry").alias("entries_checked"),
        F.count_if(F.col("verdict").isNotNull()).alias("claims_checked"),
        F.count_if(F.col("verdict") == "supports").alias("claims_supported"),
    )


Judge = Callable[[str, str], tuple[str, str, str]]


@lru_cache(256)  # neighbours in a batch have the same source
def _long_words(t: str) -> frozenset[str]:
    return frozenset(w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split() if len(w) > 4)


def quoting_judge(claim: str, source: str) -> tuple[str, str, str]:
    """A judge without a model: (verdict, confidence, quote) by the words a claim shares with its source."""
    mine, theirs = _long_words(claim), _long_words(source)
    share = len(mine & theirs) / len(mine) if mine else 0.0
    verdict = "supports" if share >= 0.5 else "partially-supports" if share >= 0.25 else "does-not-support" if share > 0 else "cannot-tell"
    return verdict, "high" if share >= 0.5 else "medium", source[:60]


def judged(pairs: DataFrame, key: str, judge: Judge = quoting_judge) -> DataFrame:
    """``(key, claim, source, verdict, confidence, quote)`` of pairs (key, claim, source) by any judge, in batches."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [judge(c or "", s or "") for c, s in zip(pdf["claim"], pdf["source"])]
            yield pdf.assign(**{n: [x[i] for x in said] for i, n in enumerate(("verdict", "confidence", "quote"))})

    return pairs.select(key, "claim", "source").mapInPandas(run, f"{key} {kind}, claim string, source string, verdict string, confidence string, quote string")


def findings(judgements: DataFrame, key: str) -> DataFrame:
    """``(key, severity, confidence)``: what is reported; a finding whose quote is not in the source is of low confidence."""
    shown = F.col("verdict").isin("does-not-support", "partially-supports")
    quoted = tx.quote_in_text(F.col("quote"), F.col("source"))
    return judgements.filter(shown).select(key, F.when(F.col("verdict") == "does-not-support", "high").otherwise("medium").alias("severity"), F.when(quoted, F.col("confidence")).otherwise("low").alias("confidence"))

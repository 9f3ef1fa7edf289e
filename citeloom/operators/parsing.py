"""Whole documents: sections from lines, abstracts, layout labels, and the chain from lines to linked markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import entries, markers, structure
from citeloom.operators.prefix import chunk_of, running_sum
from citeloom.session import materialize


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines without running heads, feet and page numbers."""
    return structure.running_furniture(lines).filter("NOT furniture").select(lines.columns)


def _in_sections(lines: DataFrame) -> DataFrame:
    """Lines with the heading they are, if any, and the number of headings up to them in their paper."""
    heads = structure.headings(lines).select("line_key", "level", "kind", "heading")
    titled = lines.join(heads, "line_key", "left")
    return running_sum(titled, ["paper_id"], chunk_of(F.col("line_no")), ["line_no", "line_key"], F.when(F.col("heading").isNotNull(), 1).otherwise(0), "section_ix")


def reference_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, page, col_no, x_pos, text)``: the lines under headings of references."""
    marked = _in_sections(lines)
    lists = marked.filter(F.col("heading").rlike(structure.REF_HEADING)).select("paper_id", "section_ix")
    kept = marked.filter("heading IS NULL AND text IS NOT NULL").join(lists, ["paper_id", "section_ix"], "left_semi")
    return kept.select(F.col("paper_id").alias("doc_id"), "line_no", "page", "col_no", "x_pos", "text")


def entries_of_lines(lines: DataFrame) -> DataFrame:
    """``(paper_id, entry_ix, marker, text, too_short)`` of reference lines: numbered lists, else hanging indents."""
    numbered = structure.segment_numbered(lines).select("doc_id", "entry_ix", "marker", "text", "too_short")
    plain = lines.join(structure.entry_style(lines).filter("style = 'hanging-indent'"), "doc_id", "left_semi")
    hanging = structure.segment_hanging(plain).select("doc_id", "entry_ix", F.lit(None).cast("string").alias("marker"), "text", "too_short")
    return numbered.unionByName(hanging).withColumnRenamed("doc_id", "paper_id")


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """``(section_key, paper_id, section_ix, heading_level, heading, kind, paragraphs)``: lines cut at their headings.

    A section takes the lines up to the next heading; what stands before the first is front matter of level
    0.  Sections under a heading of references are kept apart by ``kind = 'references'``.
    """
    marked = _in_sections(lines)
    named = marked.filter("heading IS NOT NULL").select("paper_id", "section_ix", "heading", F.col("level").alias("heading_level"))
    body = structure.paragraphs(marked.filter("heading IS NULL"), ("section_ix",))
    rows = F.array_sort(F.collect_list(F.struct("page", "col_no", "para_ix", "text")))
    texts = body.groupBy("paper_id", "section_ix").agg(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t != "").alias("paragraphs"))
    both = named.join(texts, ["paper_id", "section_ix"], "full")
    kind = F.when(F.col("heading").rlike(structure.REF_HEADING), "references").when(F.col("heading").isNull(), "front").otherwise("body")
    return both.select(
        F.xxhash64("paper_id", "section_ix").alias("section_key"), "paper_id", F.col("section_ix").cast("int").alias("section_ix"), F.coalesce("heading_level", F.lit(0)).alias("heading_level"),
        F.coalesce("heading", F.lit("(front matter)")).alias("heading"), kind.alias("kind"), F.coalesce("paragraphs", tx.array_of()).alias("paragraphs"),
    )


def abstracts(sections: DataFrame) -> DataFrame:
    """``(paper_id, abstract, cut)``: the section or the paragraph that says so, up to the first numbers of a figure.

    Behind the cut only whole sentences of eight words or more stay, and a numeric tail of the last one goes.
    """
    kept = F.filter("paragraphs", lambda p: p.isNotNull())
    titled = sections.filter(F.col("heading").rlike(r"(?i)^(\d+\.?\s+)?abstract\b"))
    led = sections.filter(~F.coalesce(F.col("heading").rlike(r"(?i)^(\d+\.?\s+)?abstract\b"), F.lit(False))).select("paper_id", "section_ix", F.filter(kept, lambda p: p.rlike(r"(?i)^abstract[.:\s—-]")).alias("ps")).filter("size(ps) > 0")
    rows = titled.select("paper_id", "section_ix", F.lit(0).alias("rank"), kept.alias("ps")).unionByName(
        led.select("paper_id", "section_ix", F.lit(1).alias("rank"), F.array(F.regexp_replace(F.col("ps")[0], r"(?i)^abstract[.:\s—-]+", "")).alias("ps"))
    )
    first = rows.groupBy("paper_id").agg(F.min_by("ps", F.struct("rank", "section_ix")).alias("ps"))
    debris = F.transform("ps", lambda p: tx.is_numeric_debris(p))
    at = F.coalesce(F.array_position(debris, F.lit(True)), F.lit(0))
    prose = lambda p: F.trim(p).rlike(r"[.!?]$") & (F.size(tx.words(F.trim(p))) >= 8)
    head = F.slice("ps", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0)).cast("int"))
    last = F.array_max(F.transform(head, lambda p, i: F.when(prose(p), i + 1).otherwise(0)))
    chosen = F.when(F.col("at") > 0, F.slice(head, F.lit(1), F.coalesce(last, F.lit(0)))).otherwise(F.col("ps"))
    return first.withColumn("at", at).select("paper_id", F.array_join(chosen, "\n\n").alias("abstract"), (F.col("at") > 0).alias("cut"))


def layout_labels(pages: DataFrame) -> DataFrame:
    """``(paper_id, label)`` of pages (paper_id, page, columns): most, some or none have two columns."""
    two = F.count_if(F.col("columns") == 2)
    return pages.groupBy("paper_id").agg(F.when(two > F.count("*") / 2, "two-column").when(two > 0, "mixed").otherwise("single-column").alias("label"))


def healed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(paper_id, healed, remaining)`` of entries (paper_id, entry_key, status) before and after a new attempt."""
    pairs = before.select("paper_id", "entry_key", F.col("status").alias("was")).join(after.select("entry_key", F.col("status").alias("now")), "entry_key")
    done = (F.col("was") != "verified") & (F.col("now") == "verified")
    return pairs.groupBy("paper_id").agg(F.count_if(done).alias("healed"), F.count_if(F.col("now") != "verified").alias("remaining"))


def checkable(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """Entries (paper_id, number, status, abstract) that have claims, are verified and have an abstract to check them with."""
    return entries.join(claims.select("paper_id", "number").distinct(), ["paper_id", "number"], "left_semi").filter("status = 'verified' AND abstract IS NOT NULL AND abstract <> ''")


def guarded_queries(queries: DataFrame, sections: DataFrame, most: int = 2) -> DataFrame:
    """The first two queries (section_key, pos, query) of each section that exists; others are not run."""
    known = queries.join(sections.select("section_key"), "section_key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("section_key").orderBy("pos"))
    return known.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def zipped_answers(ids: DataFrame) -> DataFrame:
    """``(id, record)`` of batch answers (ids, records): the k-th record answers the k-th id, a null is a miss."""
    return ids.select(F.inline(F.arrays_zip("ids", "records"))).select(F.col("ids").alias("id"), F.col("records").alias("record")).filter("record IS NOT NULL")


def fix_commands(findings: DataFrame, most: int = 490) -> DataFrame:
    """A finding (finding_id, kind, summary, detail) as the command that would mend it, of bounded length."""
    verb = F.when(F.col("kind") == "missing-work", "Cite the work where it belongs: ").otherwise("Correct the claim: ")
    return findings.select("finding_id", F.substring(F.concat(verb, "summary", F.lit(". "), "detail"), 1, most).alias("command"))


@dataclass
class Parsed:
    """Tables of a corpus after parsing."""

    lines: DataFrame
    titles: DataFrame
    sections: DataFrame
    abstracts: DataFrame
    markers: DataFrame
    styles: DataFrame
    entries: DataFrame
    numbers: DataFrame
    cites: DataFrame
    failures: DataFrame


def parse(lines: DataFrame, as_of_year: int = 2026) -> Parsed:
    """From lines to markers linked to entries: the chain of the operators above, nothing is collected on the way.

    Lines, sections and entries are written once, as several of the tables read them.  ``numbers`` and ``cites``
    link markers (marker_key) to entries (entry_key); ``failures`` has (paper_id, stage, kind, n).
    """
    body = materialize(body_lines(lines), "parse-lines")
    sections = materialize(sections_of_lines(body), "parse-sections")
    text = sections.filter("kind <> 'references'")
    found = markers.find_markers(text)
    styles = markers.style_vote(found)
    spans = markers.drop_foreign_superscripts(found, styles).drop("style").withColumn("marker_key", F.xxhash64("paper_id", "seq"))
    listed = materialize(reference_lines(body), "parse-references")
    cut = entries_of_lines(listed).withColumn("entry_key", F.xxhash64("paper_id", "entry_ix"))
    cut = materialize(cut, "parse-entries")
    kept = cut.filter("NOT too_short")
    read = entries.entry_fields(kept.select("entry_key", "text"), "entry_key", as_of_year)
    full = kept.join(read, "entry_key")
    csl = F.struct("title", F.col("authors").alias("author"), F.when(F.col("year").isNotNull(), F.array(F.array("year"))).alias("issued"))
    known = full.select("entry_key", "paper_id", "entry_ix", "marker", F.col("text").alias("raw_text"), csl.alias("csl"))
    titles, found_abstracts = structure.titles(body), abstracts(sections)
    papers = body.select("paper_id").distinct()
    none = lambda df, stage, kind: papers.join(df.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"))
    segment = structure.segment_failures(listed).select(F.col("doc_id").alias("paper_id"), F.lit("segment").alias("stage"), "kind", "n")
    failures = none(titles, "structure", "no-title").unionByName(none(found_abstracts, "structure", "no-abstract")).unionByName(none(kept, "references", "no-references")).unionByName(segment)
    return Parsed(body, titles, sections, found_abstracts, spans, styles, full, markers.link_numbers(spans, known), markers.link_author_years(spans, known), failures)

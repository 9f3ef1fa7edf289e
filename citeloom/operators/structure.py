"""Operators from lines to structure: furniture, headings, titles, paragraphs, reference entries.

Lines are rows (paper_id, page, line_no, text, x_pos, y_pos, font_size, col_no, bold); everything that
depends on order is a window over a paper, or over a page where the page is enough.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.prefix import chunk_of, previous, running_sum

# Patterns of headings and captions.
ROMAN_HEADING = r"^[IVXLC]{1,7}\.\s+[A-Z][A-Z\s,:&-]{2,70}$"
NUMBERED = r"^(\d+(?:\.\d+)*|[IVXLC]+)\.?\s+(.{2,80})$"
KNOWN = r"(?i)^(abstract|introduction|related work|background|methods?|methodology|experiments?|results|discussion|conclusions?|references|bibliography|acknowledgm?ents?|appendix|limitations)\b"
CAPTION = r"(?i)^(figure|fig\.|table|algorithm|listing)\b"
REF_HEADING = r"(?i)^(references|bibliography|works cited|literature cited)\b"
POST_REF_HEADING = r"(?i)^(appendix|appendices|supplementary|acknowledgm?ents?)\b"
CITATION_SHAPED = r"^(\[\d{1,3}\]|\d{1,3}\.\s|[A-Z][\p{L}'’-]+,?\s+([A-Z]\.\s*)+)"
BRACKET_START = r"^\[(\d{1,3})\]\s*"
DOT_START = r"^(\d{1,3})\.\s+\S"
ENTRY_STARTS = (r"^[A-Z][\p{L}'’-]+,?\s", r"^([A-Z]\.[\s-]?)+[A-Z][\p{L}'’-]+", r"^[A-Z][\w@&'’-]{1,40}\.\s+[A-Z0-9]")


def half_points(c: Column) -> Column:
    """Sizes in bins of half a point, halves rounded up."""
    return F.floor(c * 2 + 0.5) / 2


def body_sizes(lines: DataFrame) -> DataFrame:
    """(paper_id, body_size): the size that most characters have; of equals the one seen first."""
    binned = lines.filter("text IS NOT NULL AND font_size IS NOT NULL").groupBy("paper_id", half_points(F.col("font_size")).alias("size")).agg(
        F.sum(F.length("text")).alias("weight"), F.min("line_no").alias("first")
    )
    return binned.groupBy("paper_id").agg(F.max_by("size", F.struct("weight", -F.col("first"))).alias("body_size"))


def page_edges(lines: DataFrame) -> DataFrame:
    """Lines with the extent of their page and whether they stand in its upper or lower 8 %."""
    page = lines.groupBy("paper_id", "page").agg(F.max("y_pos").alias("top"))
    near = (F.col("y_pos") > 0.92 * F.col("height")) | (F.col("y_pos") < 0.08 * F.col("height"))
    same = F.col("l.paper_id").eqNullSafe(F.col("e.paper_id")) & F.col("l.page").eqNullSafe(F.col("e.page"))  # lines without a page stay
    edged = lines.alias("l").join(page.alias("e"), same).select("l.*", "e.top")
    return edged.withColumn("height", F.col("top") * 1.05).withColumn("near_edge", F.coalesce((F.col("height") > 0) & near, F.lit(False)))


def running_furniture(lines: DataFrame) -> DataFrame:
    """Lines with ``furniture``: an edge line that is a number, or whose text but for digits stands on three pages."""
    edged = page_edges(lines).withColumn("mask", tx.mask_digits(F.col("text")))
    repeats = edged.filter("near_edge AND mask IS NOT NULL").groupBy("paper_id", "mask").agg(F.count_distinct("page").alias("pages"))
    marked = edged.join(repeats, ["paper_id", "mask"], "left")
    return marked.withColumn("furniture", F.col("near_edge") & (F.coalesce(F.trim("text").rlike(r"^\d{1,4}$"), F.lit(False)) | (F.coalesce("pages", F.lit(0)) >= 3)))


def heading_of(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """``struct<level, kind>`` of a heading line, null for any other; rules in order."""
    t = F.trim(text)
    larger, number, title = F.coalesce(size >= body * 1.05, F.lit(False)), F.regexp_extract(t, NUMBERED, 1), F.regexp_extract(t, NUMBERED, 2)
    numbered, dotted = t.rlike(NUMBERED), F.contains(number, F.lit("."))
    heading = lambda level, kind: F.struct(level.cast("int").alias("level"), F.lit(kind).alias("kind"))
    too_large = F.exists(F.split(number, r"\."), lambda p: p.rlike(r"^\d+$") & (F.length(p) > 2))
    all_caps = number.rlike(r"^\d") & title.rlike("[A-Z]{3}") & (title == F.upper(title))
    bold = F.coalesce(bold, F.lit(False))
    return (
        F.when((t == "") | (F.length(t) > 90) | t.rlike(CAPTION), F.lit(None))
        .when(t.rlike(ROMAN_HEADING), heading(F.lit(1), "numbered"))
        .when(numbered & too_large, F.lit(None))
        .when(numbered & (larger | (dotted & title.rlike("^[A-Z]") & (F.length(t) <= 70)) | all_caps | bold), heading(F.when(dotted, F.size(F.split(number, r"\."))).otherwise(1), "numbered"))
        .when(t.rlike(KNOWN) & (larger | bold | (t == F.upper(t))), heading(F.lit(1), "known"))
        .when((F.length(t) <= 60) & ~t.rlike(r"[.;:,]$") & (F.coalesce(size >= body * 1.15, F.lit(False)) | (bold & F.coalesce(size >= body * 0.95, F.lit(False)))), heading(F.lit(1), "styled"))
    )


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines (line_key, level, kind, heading), front matter and texts that return often taken out."""
    sized = lines.filter("text IS NOT NULL").join(body_sizes(lines), "paper_id")
    found = sized.withColumn("h", heading_of(F.col("text"), F.col("font_size"), F.col("bold"), F.col("body_size"))).filter("h IS NOT NULL")
    found = found.select("line_key", "paper_id", "page", "line_no", F.trim("text").alias("heading"), "h.*").filter("NOT (kind = 'styled' AND page = 1)")
    often = F.count("*").over(Window.partitionBy("paper_id", "heading"))
    titled = found.join(titles(lines).select("paper_id", "title"), "paper_id", "left").filter((F.col("page") != 1) | ~F.coalesce(F.contains("title", "heading"), F.lit(False)))
    return titled.withColumn("n", often).filter((F.col("n") < 3) | (F.col("kind") != "styled") | F.col("heading").rlike(NUMBERED)).drop("n", "title")


def titles(lines: DataFrame) -> DataFrame:
    """(paper_id, title): the first four lines of page 1 near its largest size, if that exceeds the body's by 15 %."""
    first = lines.filter("page = 1 AND text IS NOT NULL AND font_size IS NOT NULL")
    largest = first.groupBy("paper_id").agg(F.max("font_size").alias("largest")).join(body_sizes(lines), "paper_id").filter("largest >= body_size * 1.15")
    rows = first.join(largest, "paper_id").filter("font_size >= largest * 0.95").withColumn("rn", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_no"))).filter("rn <= 4")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("paper_id").agg(F.trim(F.regexp_replace(text, r"(\p{L})- (\p{L})", "$1$2")).alias("title"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Place of each line on its page: by column, from the top, from the left."""
    order = Window.partitionBy("paper_id", "page").orderBy(F.col("col_no").asc_nulls_last(), F.col("y_pos").desc_nulls_last(), F.col("x_pos").asc_nulls_last(), "line_key")
    return lines.withColumn("place", F.row_number().over(order).cast("long"))


def paragraphs(lines: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(paper_id, page, col_no, para_ix, n_lines, text): islands of lines on a page, joined without their hyphens.

    A paragraph ends at a gap of 1.6 times the page's upper median gap, or of 1.1 times if the next line is indented.
    within: further columns whose change ends a paragraph, such as a section; they are in the result.
    """
    flow = ["paper_id", *within, "page", "col_no"]
    order = Window.partitionBy(*flow).orderBy("line_no")
    gaps = lines.filter("text IS NOT NULL AND y_pos IS NOT NULL").withColumn("gap", F.lag("y_pos").over(order) - F.col("y_pos")).withColumn("shift", F.col("x_pos") - F.lag("x_pos").over(order))
    sizes = gaps.groupBy(*flow).agg(F.sort_array(F.collect_list("gap")).alias("all"))
    median = sizes.select(*flow, F.coalesce(F.nullif(F.get("all", F.floor(F.size("all") / 2).cast("int")), F.lit(0.0)), F.lit(12.0)).alias("median"))
    broken = (F.col("gap") > F.col("median") * 1.6) | ((F.col("shift") > 5) & (F.col("gap") > F.col("median") * 1.1))
    same = reduce(and_, [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in flow])
    marked = gaps.alias("g").join(median.alias("m"), same).select("g.*", "m.median").withColumn("start", F.coalesce(broken.cast("int"), F.lit(0)))
    island = marked.withColumn("para_ix", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return island.groupBy(*flow, "para_ix").agg(F.count("*").alias("n_lines"), F.trim(tx.join_wrapped(texts)).alias("text"))


def citation_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_lines): the longest run of citation-shaped lines, up to three others in between.

    A run inside the text ends before its last hit; one that reaches the end takes the lines behind it along.
    lines has doc_id, line_no (from 0), text.
    """
    by = Window.partitionBy("doc_id").orderBy("line_no")
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    hits = lines.filter(F.trim("text").rlike(CITATION_SHAPED)).select("doc_id", "line_no")
    runs = hits.withColumn("new", F.coalesce((F.col("line_no") - F.lag("line_no").over(by) > 4).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last")).join(n, "doc_id")
    length = F.when(F.col("n") - 1 - F.col("last") <= 3, F.col("n") - F.col("first_line")).otherwise(F.col("last") - F.col("first_line"))
    best = ends.withColumn("n_lines", length).filter("n_lines > 0").groupBy("doc_id").agg(F.max_by(F.struct("first_line", "n_lines"), F.struct("n_lines", -F.col("first_line"))).alias("b"))
    return best.select("doc_id", F.col("b.first_line").cast("long").alias("first_line"), F.col("b.n_lines").cast("long").alias("n_lines"))


def entry_style(lines: DataFrame) -> DataFrame:
    """(doc_id, style) of a list of references: three bracketed starts, else three numbered ones, else hanging."""
    n = lambda p: F.count_if(F.col("text").rlike(p))
    return lines.groupBy("doc_id").agg(F.when(n(BRACKET_START) >= 3, "bracket").when(n(DOT_START) >= 3, "number-dot").otherwise("hanging-indent").alias("style"))


def segment_numbered(lines: DataFrame) -> DataFrame:
    """Entries of numbered lists: (doc_id, entry_ix, marker, text, too_short); lines before the first number are told by ``segment_failures``."""
    styled = lines.join(entry_style(lines), "doc_id").filter("style <> 'hanging-indent'")
    pattern = F.when(F.col("style") == "bracket", F.regexp_extract("text", BRACKET_START, 1)).otherwise(F.regexp_extract("text", DOT_START, 1))
    cut = F.when(pattern != "", F.when(F.col("style") == "bracket", F.regexp_replace("text", BRACKET_START, "")).otherwise(F.regexp_replace("text", r"^(\d{1,3})\.\s+", ""))).otherwise(F.col("text"))
    rows = styled.select("doc_id", "line_no", pattern.alias("marker"), cut.alias("text"))
    rows = running_sum(rows, ["doc_id"], chunk_of(F.col("line_no")), ["line_no"], F.when(F.col("marker") != "", 1).otherwise(0), "entry_ix").filter("entry_ix > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    out = rows.groupBy("doc_id", "entry_ix").agg(F.max("marker").alias("marker"), tx.squeeze(tx.join_wrapped(texts)).alias("text"))
    return out.withColumn("too_short", F.length("text") < 20)


def segment_hanging(lines: DataFrame) -> DataFrame:
    """Entries of unnumbered lists by hanging indent; lines has doc_id, line_no, page, col_no, x_pos, text."""
    margin = F.min("x_pos").over(Window.partitionBy("doc_id", "page", "col_no"))
    opening = lines.groupBy("doc_id").agg(F.min("line_no").alias("opening"))
    starts = F.col("text").rlike(ENTRY_STARTS[0]) | F.col("text").rlike(ENTRY_STARTS[1]) | F.col("text").rlike(ENTRY_STARTS[2])
    first = F.col("line_no") == F.col("opening")
    rows = lines.withColumn("margin", margin).join(opening, "doc_id").withColumn("start", (first | ((F.col("x_pos") <= F.col("margin") + 2) & starts)).cast("int"))
    rows = running_sum(rows, ["doc_id"], chunk_of(F.col("line_no")), ["line_no"], F.coalesce("start", F.lit(0)), "entry_ix")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "entry_ix").agg(tx.squeeze(tx.join_wrapped(texts)).alias("text")).withColumn("too_short", F.length("text") < 20)


def segment_failures(lines: DataFrame) -> DataFrame:
    """``(doc_id, kind, n)``: what went wrong in cutting numbered lists to entries.

    'preamble': lines before the first number, which belong to no entry; 'too-short': entries of under twenty
    characters; 'sequence-gap': numbers that do not go on by one.  lines has doc_id, line_no, text.
    """
    styled = lines.join(entry_style(lines), "doc_id").filter("style <> 'hanging-indent'")
    begins = F.when(F.col("style") == "bracket", F.col("text").rlike(BRACKET_START)).otherwise(F.col("text").rlike(DOT_START))
    first = styled.filter(begins).groupBy("doc_id").agg(F.min("line_no").alias("first"))
    preamble = styled.join(first, "doc_id").filter("line_no < first").groupBy("doc_id").agg(F.count("*").alias("n"))
    cut = segment_numbered(lines)
    short = cut.filter("too_short").groupBy("doc_id").agg(F.count("*").alias("n"))
    gaps = sequence_gaps(cut.select(F.col("doc_id").alias("paper_id"), F.col("entry_ix").alias("entry_key"), F.col("entry_ix").cast("int").alias("entry_ix"), "marker"))
    gaps = gaps.groupBy(F.col("paper_id").alias("doc_id")).agg(F.count("*").alias("n"))
    kinds = (("preamble", preamble), ("too-short", short), ("sequence-gap", gaps))
    return reduce(DataFrame.unionByName, [df.select("doc_id", F.lit(k).alias("kind"), "n") for k, df in kinds])


def sequence_gaps(entries: DataFrame) -> DataFrame:
    """Places where the list numbers of a paper do not go on by one: (paper_id, entry_ix, previous, number)."""
    number = F.col("marker").try_cast("int")
    rows = entries.filter(number.isNotNull()).select("paper_id", "entry_key", "entry_ix", number.alias("number"))
    rows = previous(rows, ["paper_id"], chunk_of(F.col("entry_ix")), ["entry_ix", "entry_key"], "number", "previous")
    return rows.filter("number <> previous + 1").select("paper_id", "entry_ix", "previous", "number")


def reference_regions(lines: DataFrame) -> DataFrame:
    """(doc_id, start, stop, heading): lines behind the last reference heading up to the next heading that ends the list.

    lines has doc_id, line_no, text and is_heading.  Without a heading line, a short line with the word will do.
    """
    t = F.trim("text")
    good, fair = t.rlike(REF_HEADING) & F.col("is_heading"), t.rlike(REF_HEADING) & (F.length(t) < 30)
    start = lines.groupBy("doc_id").agg(F.coalesce(F.max(F.when(good, F.col("line_no"))), F.max(F.when(fair, F.col("line_no")))).alias("start"), F.max("line_no").alias("last")).filter("start IS NOT NULL")
    behind = lines.join(start, "doc_id").filter("line_no > start AND is_heading").groupBy("doc_id").agg(F.min("line_no").alias("stop"))
    named = lines.select("doc_id", F.col("line_no").alias("start"), t.alias("heading"))
    return start.join(behind, "doc_id", "left").join(named, ["doc_id", "start"]).select("doc_id", "start", F.coalesce("stop", F.col("last") + 1).alias("stop"), "heading")


def section_labels(sections: DataFrame) -> DataFrame:
    """Sections without paragraphs: whether their content stands in subsections or is missing."""
    by = Window.partitionBy("paper_id").orderBy("section_ix", "section_key")
    empty = F.coalesce(F.size("paragraphs"), F.lit(0)) <= 0
    return sections.withColumn("next_level", F.lead("heading_level").over(by)).filter(empty).select(
        "section_key", F.when(F.col("next_level") > F.col("heading_level"), "content in subsections").otherwise("no text captured").alias("label")
    )

"""Structure of scanned lines and of document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import parsing
from citeloom.operators import structure as ops
from citeloom.sources.tables import once, table

LINE = ("line_key", "paper_id", "page", "line_no", "text", "x_pos", "y_pos", "font_size", "col_no", "bold")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "text_lines", *LINE))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all document texts, numbered from 0."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def body_font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.body_sizes(_lines(spark, sf_dir))


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.running_furniture(_lines(spark, sf_dir)).select("line_key", "near_edge", "furniture")


def heading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.headings(_lines(spark, sf_dir)).select("line_key", "level", "kind", "heading")


def paper_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.titles(_lines(spark, sf_dir))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reading_order(_lines(spark, sf_dir)).select("line_key", "place")


def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.paragraphs(_lines(spark, sf_dir))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are mathematics, or numbers of a table (as the parser and as the reader judges)."""
    t = F.col("text")
    marked = _document_lines(spark, sf_dir).filter("length(text) > 0").select(
        "doc_id", F.col("line_no").cast("long"), tx.is_math_noise(t).alias("math"), tx.is_numeric_debris(t).alias("debris"), tx.is_numeric_debris(t, False).alias("debris_shown")
    )
    return marked.filter("math OR debris OR debris_shown")


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.filter(tx.is_markdown_table(F.col("text"))).select("doc_id")


def table_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more lines with cell bars, with the greatest number of cells."""
    return ops_table_runs(_document_lines(spark, sf_dir))


def ops_table_runs(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    cells = F.size(F.split(F.trim("text"), r"\s*\|\s*", -1))
    rows = lines.filter(F.col("text").contains("|")).withColumn("cells", cells)
    rows = rows.withColumn("run", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    runs = rows.groupBy("doc_id", "run").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n_rows"), F.max("cells").cast("long").alias("most_cells"))
    return runs.filter("n_rows >= 3").drop("run")


def citation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.citation_runs(_document_lines(spark, sf_dir))


def ref_list_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.entry_style(_document_lines(spark, sf_dir))


def ref_segment_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_numbered(_document_lines(spark, sf_dir)).withColumn("entry_ix", F.col("entry_ix").cast("long"))


def ref_segment_hanging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned lines cut at their hanging indent."""
    lines = _lines(spark, sf_dir).filter("text IS NOT NULL AND x_pos IS NOT NULL").withColumn("doc_id", F.col("paper_id"))
    return ops.segment_hanging(lines).select("doc_id", F.col("entry_ix").cast("long"), "text", "too_short")


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sequence_gaps(once(table(spark, sf_dir, "ref_entries", "paper_id", "entry_key", "entry_ix", "marker")))


def reference_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reference lists stand in document texts: from the first line that looks like an entry's heading word."""
    lines = _document_lines(spark, sf_dir)
    t = F.trim("text")
    heading = t.rlike(r"^\d+ [A-Z]") & (F.length(t) <= 60) & ~t.rlike(r"[.;:,]$") | t.rlike(ops.REF_HEADING)
    return ops.reference_regions(lines.withColumn("is_heading", heading)).select("doc_id", F.col("start").cast("long"), F.col("stop").cast("long"), "heading")


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.section_labels(once(table(spark, sf_dir, "sections", "section_key", "paper_id", "section_ix", "heading_level", "paragraphs")))


def parsed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that the lines of scanned papers make."""
    return parsing.parse(_lines(spark, sf_dir)).sections.select("paper_id", F.col("section_ix").cast("long"), "heading_level", "heading", "kind", F.size("paragraphs").cast("long").alias("n_paragraphs"))


def parsed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in the text of scanned papers, from lines to links in one chain."""
    return parsing.parse(_lines(spark, sf_dir)).markers.select("paper_id", "para_ix", "kind", "start_pos", "raw", "seq")


def parsed_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.abstracts(once(table(spark, sf_dir, "sections", "paper_id", "section_ix", "heading", "paragraphs")))


def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read off the lines under headings of references."""
    return parsing.parse(_lines(spark, sf_dir)).entries.select("paper_id", F.col("entry_ix").cast("long"), "marker", "text", "doi", "year", "title")


def parsed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong in parsing, a row a paper, stage and kind."""
    return parsing.parse(_lines(spark, sf_dir)).failures


def segment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before the first number, too short entries and gaps of documents' numbered lists."""
    return ops.segment_failures(_document_lines(spark, sf_dir))


def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by the number of columns their pages have."""
    pages = _lines(spark, sf_dir).groupBy("paper_id", "page").agg((F.coalesce(F.max("col_no"), F.lit(0)) + 1).alias("columns"))
    return parsing.layout_labels(pages)


_L = "(SELECT DISTINCT line_key, paper_id, page, line_no, text, x_pos, y_pos, font_size, col_no, bold FROM text_lines)"
_BODY = f"""body AS (SELECT paper_id, arg_max(size, (weight, -first)) AS body_size FROM (SELECT paper_id, floor(font_size * 2 + 0.5) / 2 AS size, sum(len(text)) AS weight, min(line_no) AS first
  FROM {_L} WHERE text IS NOT NULL AND font_size IS NOT NULL GROUP BY 1, 2) GROUP BY paper_id)"""
_TITLES = f"""first_page AS (SELECT l.*, b.body_size, max(font_size) OVER (PARTITION BY l.paper_id) AS largest FROM {_L} l JOIN body b USING (paper_id) WHERE page = 1 AND text IS NOT NULL AND font_size IS NOT NULL),
big AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY line_no) AS rn FROM first_page WHERE largest >= body_size * 1.15 AND font_size >= largest * 0.95),
titles AS (SELECT paper_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY rn), '(\\p{{L}})- (\\p{{L}})', '\\1\\2', 'g')) AS title FROM big WHERE rn <= 4 GROUP BY paper_id)""".replace("\\\\", "\\").replace("{{", "{").replace("}}", "}")
_DOC_LINES = "dl AS (SELECT doc_id, u.i - 1 AS line_no, ls[u.i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u)"
_JOIN = "list_reduce(list_prepend('', list(text ORDER BY line_no)), lambda acc, x: CASE WHEN regexp_matches(acc, '-$') AND regexp_matches(x, '^[a-z]') THEN acc[1:len(acc) - 1] || x WHEN acc = '' THEN x ELSE acc || ' ' || x END)"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_DEBRIS = r"(len(ws) >= 4 AND len(list_filter(ws, lambda w: regexp_matches(w, '{}') OR len(w) <= 2)) >= 0.6 * len(ws))"
_STYLE = r"""style AS (SELECT doc_id, CASE WHEN count(*) FILTER (regexp_matches(text, '^\[(\d{1,3})\]\s*')) >= 3 THEN 'bracket' WHEN count(*) FILTER (regexp_matches(text, '^(\d{1,3})\.\s+\S')) >= 3 THEN 'number-dot' ELSE 'hanging-indent' END AS style FROM dl GROUP BY doc_id)"""

SQL = {
    "body_font_mode": f"WITH {_BODY} SELECT * FROM body",
    "furniture_lines": rf"""
WITH e AS (SELECT *, max(y_pos) OVER (PARTITION BY paper_id, page) * 1.05 AS height, regexp_replace(text, '\d+', '#', 'g') AS mask FROM {_L}),
n AS (SELECT *, coalesce(height > 0 AND (y_pos > 0.92 * height OR y_pos < 0.08 * height), false) AS near_edge FROM e),
r AS (SELECT paper_id, mask, count(DISTINCT page) AS pages FROM n WHERE near_edge AND mask IS NOT NULL GROUP BY 1, 2)
SELECT line_key, near_edge, near_edge AND (coalesce(regexp_matches(trim(text), '^\d{{1,4}}$'), false) OR coalesce(pages, 0) >= 3) AS furniture FROM n LEFT JOIN r ON r.paper_id = n.paper_id AND r.mask = n.mask""",
    "heading_classes": rf"""
WITH {_BODY}, {_TITLES},
t AS (SELECT l.*, trim(l.text) AS t, body_size, coalesce(font_size >= body_size * 1.05, false) AS larger, coalesce(l.bold, false) AS b,
    regexp_extract(trim(l.text), '^(\d+(?:\.\d+)*|[IVXLC]+)\.?\s+(.{{2,80}})$', 1) AS number, regexp_extract(trim(l.text), '^(\d+(?:\.\d+)*|[IVXLC]+)\.?\s+(.{{2,80}})$', 2) AS rest
  FROM {_L} l JOIN body USING (paper_id) WHERE l.text IS NOT NULL),
h AS (SELECT *, CASE WHEN t = '' OR len(t) > 90 OR regexp_matches(t, '(?i)^(figure|fig\.|table|algorithm|listing)\b') THEN NULL
    WHEN regexp_matches(t, '^[IVXLC]{{1,7}}\.\s+[A-Z][A-Z\s,:&-]{{2,70}}$') THEN 'numbered'
    WHEN number <> '' AND len(list_filter(string_split(number, '.'), lambda p: regexp_matches(p, '^\d+$') AND len(p) > 2)) > 0 THEN NULL
    WHEN number <> '' AND (larger OR b OR (contains(number, '.') AND regexp_matches(rest, '^[A-Z]') AND len(t) <= 70) OR (regexp_matches(number, '^\d') AND regexp_matches(rest, '[A-Z]{{3}}') AND rest = upper(rest))) THEN 'numbered'
    WHEN regexp_matches(t, '(?i)^(abstract|introduction|related work|background|methods?|methodology|experiments?|results|discussion|conclusions?|references|bibliography|acknowledgm?ents?|appendix|limitations)\b') AND (larger OR b OR t = upper(t)) THEN 'known'
    WHEN len(t) <= 60 AND NOT regexp_matches(t, '[.;:,]$') AND (coalesce(font_size >= body_size * 1.15, false) OR (b AND coalesce(font_size >= body_size * 0.95, false))) THEN 'styled' END AS kind FROM t),
k AS (SELECT h.*, title FROM h LEFT JOIN titles USING (paper_id) WHERE kind IS NOT NULL AND NOT (kind = 'styled' AND page = 1)),
f AS (SELECT *, count(*) OVER (PARTITION BY paper_id, t) AS n FROM k WHERE page <> 1 OR NOT coalesce(contains(title, t), false))
SELECT line_key, CAST(CASE WHEN kind = 'numbered' AND contains(number, '.') AND NOT regexp_matches(t, '^[IVXLC]{{1,7}}\.\s+[A-Z][A-Z\s,:&-]{{2,70}}$') THEN len(string_split(number, '.')) ELSE 1 END AS INTEGER) AS level, kind, t AS heading
FROM f WHERE n < 3 OR kind <> 'styled' OR number <> ''""",
    "paper_titles": f"WITH {_BODY}, {_TITLES} SELECT * FROM titles",
    "reading_order": f"SELECT line_key, row_number() OVER (PARTITION BY paper_id, page ORDER BY col_no ASC NULLS LAST, y_pos DESC NULLS LAST, x_pos ASC NULLS LAST, line_key) AS place FROM {_L}",
    "paragraph_islands": rf"""
WITH g AS (SELECT *, lag(y_pos) OVER w - y_pos AS gap, x_pos - lag(x_pos) OVER w AS shift FROM {_L} WHERE text IS NOT NULL AND y_pos IS NOT NULL WINDOW w AS (PARTITION BY paper_id, page, col_no ORDER BY line_no)),
m AS (SELECT paper_id, page, col_no, coalesce(nullif(list_sort(list(gap) FILTER (gap IS NOT NULL))[CAST(floor(count(gap) / 2) AS INTEGER) + 1], 0), 12) AS median FROM g GROUP BY 1, 2, 3),
i AS (SELECT g.*, CAST(sum(coalesce(CAST(gap > median * 1.6 OR (shift > 5 AND gap > median * 1.1) AS INTEGER), 0)) OVER (PARTITION BY g.paper_id, g.page, g.col_no ORDER BY line_no) AS BIGINT) AS para_ix
  FROM g JOIN m ON m.paper_id = g.paper_id AND m.page = g.page AND m.col_no = g.col_no)
SELECT paper_id, page, col_no, para_ix, count(*) AS n_lines, trim({_JOIN}) AS text FROM i GROUP BY 1, 2, 3, 4""",
    "noise_lines": rf"""
WITH {_DOC_LINES}, w AS (SELECT doc_id, line_no, text, string_split_regex(text, '\s+') AS ws, len(regexp_extract_all(text, '[√∑∏∫≈≤≥±×÷∈∀∃∇∂∞·∗‖|=+^_{{}}\\]')) AS hits FROM dl WHERE len(text) > 0),
f AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, hits >= 3 OR hits > 0.02 * len(text) OR len(list_filter(ws, lambda w: len(w) <= 2)) > 0.5 * len(ws) AS math,
  {_DEBRIS.format(r'^[\d.,()%×±\-–|]+$')} AS debris, {_DEBRIS.format(r'^[\d.,()%×±\-–]+$')} AS debris_shown FROM w)
SELECT * FROM f WHERE math OR debris OR debris_shown""",
    "markdown_tables": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '^\|.*\|\n\| ?---')",
    "table_line_runs": rf"""
WITH {_DOC_LINES}, r AS (SELECT *, len(string_split_regex(trim(text), '\s*\|\s*')) AS cells, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM dl WHERE contains(text, '|'))
SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, count(*) AS n_rows, CAST(max(cells) AS BIGINT) AS most_cells FROM r GROUP BY doc_id, run HAVING count(*) >= 3""",
    "citation_runs": rf"""
WITH {_DOC_LINES}, n AS (SELECT doc_id, count(*) AS n FROM dl GROUP BY 1),
h AS (SELECT doc_id, line_no, coalesce(CAST(line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 4 AS INTEGER), 0) AS new FROM dl WHERE regexp_matches(trim(text), '^(\[\d{{1,3}}\]|\d{{1,3}}\.\s|[A-Z][\p{{L}}''’-]+,?\s+([A-Z]\.\s*)+)')),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM h),
e AS (SELECT r.doc_id, run, min(line_no) AS first_line, CASE WHEN any_value(n) - 1 - max(line_no) <= 3 THEN any_value(n) - min(line_no) ELSE max(line_no) - min(line_no) END AS n_lines FROM r JOIN n USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, CAST(first_line AS BIGINT) AS first_line, CAST(n_lines AS BIGINT) AS n_lines FROM e WHERE n_lines > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_lines DESC, first_line) = 1""",
    "ref_list_style": f"WITH {_DOC_LINES}, {_STYLE} SELECT * FROM style",
    "ref_segment_numbered": rf"""
WITH {_DOC_LINES}, {_STYLE},
p AS (SELECT doc_id, line_no, CASE WHEN style = 'bracket' THEN regexp_extract(text, '^\[(\d{{1,3}})\]\s*', 1) ELSE regexp_extract(text, '^(\d{{1,3}})\.\s+\S', 1) END AS marker, style, text FROM dl JOIN style USING (doc_id) WHERE style <> 'hanging-indent'),
c AS (SELECT doc_id, line_no, marker, CASE WHEN marker = '' THEN text WHEN style = 'bracket' THEN regexp_replace(text, '^\[(\d{{1,3}})\]\s*', '') ELSE regexp_replace(text, '^(\d{{1,3}})\.\s+', '') END AS text,
  CAST(sum(CASE WHEN marker <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS entry_ix FROM p),
j AS (SELECT doc_id, entry_ix, max(marker) AS marker, {_SQUEEZE.format(_JOIN)} AS text FROM c WHERE entry_ix > 0 GROUP BY 1, 2)
SELECT *, len(text) < 20 AS too_short FROM j""",
    "segment_failures": rf"""
WITH {_DOC_LINES}, {_STYLE},
p AS (SELECT doc_id, line_no, CASE WHEN style = 'bracket' THEN regexp_extract(text, '^\[(\d{{1,3}})\]\s*', 1) ELSE regexp_extract(text, '^(\d{{1,3}})\.\s+\S', 1) END AS marker, style, text FROM dl JOIN style USING (doc_id) WHERE style <> 'hanging-indent'),
c AS (SELECT doc_id, line_no, marker, CASE WHEN marker = '' THEN text WHEN style = 'bracket' THEN regexp_replace(text, '^\[(\d{{1,3}})\]\s*', '') ELSE regexp_replace(text, '^(\d{{1,3}})\.\s+', '') END AS text,
  CAST(sum(CASE WHEN marker <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS entry_ix FROM p),
j AS (SELECT doc_id, entry_ix, max(marker) AS marker, {_SQUEEZE.format(_JOIN)} AS text FROM c WHERE entry_ix > 0 GROUP BY 1, 2),
g AS (SELECT doc_id, try_cast(marker AS INTEGER) AS k, lag(try_cast(marker AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY entry_ix) AS before FROM j)
SELECT doc_id, 'preamble' AS kind, count(*) AS n FROM c WHERE entry_ix = 0 AND doc_id IN (SELECT doc_id FROM j) GROUP BY 1
UNION ALL SELECT doc_id, 'too-short', count(*) FROM j WHERE len(text) < 20 GROUP BY 1 UNION ALL SELECT doc_id, 'sequence-gap', count(*) FROM g WHERE k <> before + 1 GROUP BY 1""",
    "ref_segment_hanging": rf"""
WITH m AS (SELECT *, min(x_pos) OVER (PARTITION BY paper_id, page, col_no) AS margin, row_number() OVER (PARTITION BY paper_id ORDER BY line_no) AS rn FROM {_L} WHERE text IS NOT NULL AND x_pos IS NOT NULL),
s AS (SELECT paper_id, line_no, text, CAST(sum(CAST(rn = 1 OR (x_pos <= margin + 2 AND (regexp_matches(text, '^[A-Z][\p{{L}}''’-]+,?\s') OR regexp_matches(text, '^([A-Z]\.[\s-]?)+[A-Z][\p{{L}}''’-]+') OR regexp_matches(text, '^[A-Z][\w@&''’-]{{1,40}}\.\s+[A-Z0-9]'))) AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY line_no) AS BIGINT) AS entry_ix FROM m),
j AS (SELECT paper_id AS doc_id, entry_ix, {_SQUEEZE.format(_JOIN)} AS text FROM s GROUP BY 1, 2)
SELECT *, len(text) < 20 AS too_short FROM j""",
    "sequence_gaps": """
WITH n AS (SELECT DISTINCT paper_id, entry_key, entry_ix, try_cast(marker AS INTEGER) AS number FROM ref_entries WHERE try_cast(marker AS INTEGER) IS NOT NULL),
p AS (SELECT *, lag(number) OVER (PARTITION BY paper_id ORDER BY entry_ix, entry_key) AS previous FROM n)
SELECT paper_id, entry_ix, previous, number FROM p WHERE number <> previous + 1""",
    "reference_regions": rf"""
WITH {_DOC_LINES}, h AS (SELECT *, (regexp_matches(trim(text), '^\d+ [A-Z]') AND len(trim(text)) <= 60 AND NOT regexp_matches(trim(text), '[.;:,]$')) OR regexp_matches(trim(text), '(?i)^(references|bibliography|works cited|literature cited)\b') AS is_heading,
  regexp_matches(trim(text), '(?i)^(references|bibliography|works cited|literature cited)\b') AS word FROM dl),
s AS (SELECT doc_id, coalesce(max(line_no) FILTER (word AND is_heading), max(line_no) FILTER (word AND len(trim(text)) < 30)) AS start, max(line_no) AS last FROM h GROUP BY 1)
SELECT s.doc_id, CAST(start AS BIGINT) AS start, CAST(coalesce((SELECT min(line_no) FROM h WHERE h.doc_id = s.doc_id AND h.line_no > s.start AND is_heading), last + 1) AS BIGINT) AS stop,
  (SELECT trim(text) FROM h WHERE h.doc_id = s.doc_id AND h.line_no = s.start) AS heading FROM s WHERE start IS NOT NULL""",
    "layout_labels": f"""
WITH p AS (SELECT paper_id, page, coalesce(max(col_no), 0) + 1 AS columns FROM {_L} GROUP BY 1, 2)
SELECT paper_id, CASE WHEN count(*) FILTER (columns = 2) > count(*) / 2 THEN 'two-column' WHEN count(*) FILTER (columns = 2) > 0 THEN 'mixed' ELSE 'single-column' END AS label FROM p GROUP BY 1""",
    "section_labels": """
WITH s AS (SELECT DISTINCT section_key, paper_id, section_ix, heading_level, paragraphs FROM sections),
n AS (SELECT *, lead(heading_level) OVER (PARTITION BY paper_id ORDER BY section_ix, section_key) AS next_level FROM s)
SELECT section_key, CASE WHEN next_level > heading_level THEN 'content in subsections' ELSE 'no text captured' END AS label FROM n WHERE coalesce(len(paragraphs), 0) = 0""",
}

QUERIES = {
    f.__name__: f
    for f in (
        body_font_mode, furniture_lines, heading_classes, paper_titles, reading_order, paragraph_islands, noise_lines, markdown_tables, table_line_runs,
        citation_runs, ref_list_style, ref_segment_numbered, ref_segment_hanging, sequence_gaps, reference_regions, section_labels,
        parsed_sections, parsed_markers, parsed_abstracts, parsed_entries, parsed_failures, segment_failures, layout_labels,
    )
}

"""Citation markers: finding them in text, linking them to entries, and the reports on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import markers as ops
from citeloom.sources.tables import once, table


def _entries(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "ref_entries", "entry_key", "paper_id", *cols))


def _markers(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "markers", "marker_key", "paper_id", *cols))


def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per paper its markers, orphans, references, cited and uncited ones."""
    return ops.citation_report(_markers(spark, sf_dir, "targets", "unresolved"), _entries(spark, sf_dir, "id"))


def times_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.times_cited(_markers(spark, sf_dir, "targets"), _entries(spark, sf_dir, "id"))


def uncited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.uncited(_markers(spark, sf_dir, "targets"), _entries(spark, sf_dir, "id"))


def cited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cited(_markers(spark, sf_dir, "targets"), _entries(spark, sf_dir, "id"))


def orphan_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.orphans(_markers(spark, sf_dir, "raw", "unresolved")).select("marker_key", "raw", "n_unresolved")


def unresolved_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper the first 40 distinct unresolved cites in marker order, one a line."""
    return ops.unresolved_digest(_markers(spark, sf_dir, "unresolved"))


def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker in every paragraph, of four kinds, with offsets and its number within the paper."""
    return ops.find_markers(once(table(spark, sf_dir, "sections", "section_key", "paper_id", "section_ix", "paragraphs")))


def citation_style_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.style_vote(marker_spans(spark, sf_dir))


def style_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers without superscripts where the paper's style is another."""
    spans = marker_spans(spark, sf_dir)
    return ops.drop_foreign_superscripts(spans, ops.style_vote(spans)).select("section_key", "para_ix", "start_pos", "raw")


def numeric_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bracketed markers and the entry each one names; the last entry of a number wins."""
    return ops.link_numbers(_markers(spark, sf_dir, "raw"), _entries(spark, sf_dir, "id", "entry_ix", "marker"))


def author_year_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-year cites: the entry if exactly one fits, else how many do."""
    return ops.link_author_years(_markers(spark, sf_dir, "raw"), _entries(spark, sf_dir, "id", "raw_text", "csl"))


def superscript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with superscript tokens, in plain form and in segments."""
    return ops.superscript_segments(once(table(spark, sf_dir, "text_spans", "span_key", "text")))


_M = "(SELECT DISTINCT marker_key, paper_id, raw, targets, unresolved FROM markers)"
_E = "(SELECT DISTINCT entry_key, paper_id, id, entry_ix, marker, raw_text, csl FROM ref_entries)"
_CITED = f"SELECT DISTINCT paper_id, id FROM (SELECT paper_id, unnest(targets) AS id FROM {_M}) WHERE id IS NOT NULL"
_SPANS = r"""
paras AS (SELECT section_key, paper_id, section_ix, u.i - 1 AS para_ix, paragraphs[u.i] AS t
  FROM (SELECT DISTINCT section_key, paper_id, section_ix, paragraphs FROM sections), LATERAL (SELECT unnest(range(1, len(paragraphs) + 1)) AS i) u
  WHERE paragraphs[u.i] IS NOT NULL),
kinds(kind, rank, re) AS (VALUES ('bracket', 0, '\[(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\]'), ('superscript', 1, '⟦\^([\d\s,;–-]+)⟧'),
  ('parenthetical', 2, '\(([^()]{2,120}?(?:19|20)\d{2}[a-z]?(?:[^()]{0,80})?)\)'),
  ('narrative', 3, '\b([A-Z][\p{L}''’-]+)(?:\s+et al\.?|\s+(?:and|&)\s+[A-Z][\p{L}''’-]+)?\s+\(((?:19|20)\d{2}[a-z]?)\)')),
hits AS (SELECT section_key, paper_id, section_ix, para_ix, kind, rank,
    regexp_extract_all(t, re) AS raws, regexp_extract_all(t, re, 1) AS inners, list_transform(string_split_regex(t, re), lambda x: len(x)) AS pieces
  FROM paras, kinds WHERE regexp_matches(t, re)),
found AS (SELECT section_key, paper_id, section_ix, para_ix, kind, rank, raws[u.i] AS raw, inners[u.i] AS inner_text,
    CAST(list_sum(pieces[1:u.i]) + coalesce(list_sum(list_transform(raws[1:u.i - 1], lambda x: len(x))), 0) AS BIGINT) AS start_pos
  FROM hits, LATERAL (SELECT unnest(range(1, len(raws) + 1)) AS i) u),
kept AS (SELECT * FROM found WHERE kind <> 'parenthetical'
  OR len(list_filter(string_split(inner_text, ';'), lambda c: regexp_matches(trim(c), '^[A-Z][\p{L}\d@&''’.-]*') AND regexp_matches(c, '(?:19|20)\d{2}'))) > 0),
spans AS (SELECT section_key, paper_id, para_ix, kind, start_pos, start_pos + len(raw) AS end_pos, raw,
    CAST(row_number() OVER (PARTITION BY paper_id ORDER BY section_ix, section_key, para_ix, rank, start_pos) - 1 AS BIGINT) AS seq FROM kept)
"""
_VOTE = """votes AS (SELECT paper_id, CAST(count(*) FILTER (kind = 'bracket') AS BIGINT) AS brackets, CAST(count(*) FILTER (kind = 'superscript') AS BIGINT) AS superscripts,
    CAST(count(*) FILTER (kind IN ('parenthetical', 'narrative')) AS BIGINT) AS author_years FROM spans GROUP BY paper_id),
styles AS (SELECT *, CASE WHEN brackets >= superscripts AND brackets >= author_years THEN 'numeric-bracket' WHEN superscripts >= author_years THEN 'superscript' ELSE 'author-year' END AS style FROM votes)"""

SQL = {
    "citation_report": f"""
WITH m AS (SELECT paper_id, CAST(count(*) AS BIGINT) AS n_markers, CAST(count(*) FILTER (len(list_filter(unresolved, lambda x: x IS NOT NULL)) > 0) AS BIGINT) AS n_orphans,
    CAST(coalesce(sum(len(list_filter(unresolved, lambda x: x IS NOT NULL))), 0) AS BIGINT) AS n_unresolved FROM {_M} GROUP BY paper_id),
cited AS ({_CITED}),
e AS (SELECT e.paper_id, CAST(count(*) AS BIGINT) AS n_entries, CAST(count(c.id) AS BIGINT) AS n_cited FROM {_E} e LEFT JOIN cited c ON c.paper_id = e.paper_id AND c.id = e.id GROUP BY e.paper_id)
SELECT coalesce(m.paper_id, e.paper_id) AS paper_id, coalesce(n_markers, 0) AS n_markers, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_unresolved, 0) AS n_unresolved,
  coalesce(n_entries, 0) AS n_entries, coalesce(n_cited, 0) AS n_cited, coalesce(n_entries - n_cited, 0) AS n_uncited FROM m FULL JOIN e ON m.paper_id = e.paper_id""",
    "times_cited": f"""
WITH t AS (SELECT paper_id, id, CAST(count(DISTINCT marker_key) AS BIGINT) AS n FROM (SELECT marker_key, paper_id, unnest(targets) AS id FROM {_M}) WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT entry_key, coalesce(n, 0) AS times_cited FROM {_E} e LEFT JOIN t ON t.paper_id = e.paper_id AND t.id = e.id""",
    "uncited_entries": f"SELECT entry_key FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM ({_CITED}) c WHERE c.paper_id = e.paper_id AND c.id = e.id)",
    "cited_entries": f"SELECT entry_key FROM {_E} e WHERE EXISTS (SELECT 1 FROM ({_CITED}) c WHERE c.paper_id = e.paper_id AND c.id = e.id)",
    "orphan_markers": f"SELECT marker_key, raw, CAST(len(list_filter(unresolved, lambda x: x IS NOT NULL)) AS BIGINT) AS n_unresolved FROM {_M} WHERE len(list_filter(unresolved, lambda x: x IS NOT NULL)) > 0",
    "unresolved_digest": f"""
WITH u AS (SELECT paper_id, v, min(marker_key) AS k, min(i) AS i FROM (SELECT paper_id, marker_key, unnest(unresolved) AS v, generate_subscripts(unresolved, 1) AS i FROM {_M}) WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT paper_id, v, row_number() OVER (PARTITION BY paper_id ORDER BY k, v) AS rn FROM u)
SELECT paper_id, string_agg(v, chr(10) ORDER BY rn) AS cites FROM f WHERE rn <= 40 GROUP BY paper_id""",
    "marker_spans": f"WITH {_SPANS} SELECT section_key, paper_id, CAST(para_ix AS BIGINT) AS para_ix, kind, start_pos, CAST(end_pos AS BIGINT) AS end_pos, raw, seq FROM spans",
    "citation_style_vote": f"WITH {_SPANS}, {_VOTE} SELECT paper_id, brackets, superscripts, author_years, style FROM styles",
    "style_markers": f"""WITH {_SPANS}, {_VOTE} SELECT section_key, CAST(para_ix AS BIGINT) AS para_ix, start_pos, raw FROM spans JOIN styles USING (paper_id)
WHERE style = 'superscript' OR NOT starts_with(raw, '⟦^')""",
    "numeric_links": rf"""
WITH parts AS (SELECT marker_key, paper_id, unnest(string_split_regex(CASE WHEN regexp_matches(raw, '\[(\d{{1,3}}(?:\s*[,–-]\s*\d{{1,3}})*)\]') THEN regexp_extract(raw, '\[(\d{{1,3}}(?:\s*[,–-]\s*\d{{1,3}})*)\]', 1) ELSE regexp_extract(raw, '⟦\^([\d\s,;–-]+)⟧', 1) END, '[,;]')) AS part
  FROM {_M} WHERE regexp_matches(raw, '\[(\d{{1,3}}(?:\s*[,–-]\s*\d{{1,3}})*)\]') OR regexp_matches(raw, '⟦\^([\d\s,;–-]+)⟧')),
ends AS (SELECT marker_key, paper_id, list_transform(string_split_regex(part, '[–-]'), lambda x: try_cast(trim(x) AS INTEGER)) AS e FROM parts),
nums AS (SELECT DISTINCT marker_key, paper_id, unnest(CASE WHEN len(e) = 2 AND e[2] > e[1] THEN range(e[1], least(e[2], e[1] + 99) + 1) WHEN e[1] IS NOT NULL THEN [e[1]] ELSE [] END) AS number FROM ends),
last_one AS (SELECT paper_id, marker, arg_max(entry_key, (entry_ix, entry_key)) AS entry_key FROM {_E} WHERE marker IS NOT NULL GROUP BY 1, 2)
SELECT marker_key, CAST(number AS BIGINT) AS number, entry_key FROM nums LEFT JOIN last_one l ON l.paper_id = nums.paper_id AND l.marker = CAST(number AS VARCHAR)""",
    "author_year_links": rf"""
WITH parts AS (SELECT marker_key, paper_id, trim(unnest(CASE WHEN starts_with(raw, '(') THEN string_split(regexp_extract(raw, '^\((.*)\)$', 1), ';') WHEN regexp_matches(raw, '^\p{{L}}.*\(') THEN [raw] ELSE [] END)) AS cite FROM {_M}),
named AS (SELECT marker_key, paper_id, cite, lower(regexp_extract(cite, '{ops.SURNAME.replace("'", "''")}', 1)) AS surname FROM parts WHERE regexp_matches(cite, '{ops.SURNAME.replace("'", "''")}')),
years AS (SELECT marker_key, paper_id, surname, unnest(regexp_extract_all(cite, '{ops.YEAR_LETTERS}', 1)) AS year, unnest(regexp_extract_all(cite, '{ops.YEAR_LETTERS}', 2)) AS letters FROM named),
cites AS (SELECT DISTINCT marker_key, paper_id, surname, CAST(year AS INTEGER) AS year, unnest(string_split_regex(letters, '\s*,\s*')) AS letter FROM years),
fits AS (SELECT c.marker_key, c.surname, c.year, c.letter, e.entry_key, c.letter <> '' AND contains(e.raw_text, c.year || c.letter) AS lettered FROM cites c JOIN {_E} e ON e.paper_id = c.paper_id AND e.csl.issued[1][1] = c.year
  WHERE list_contains(list_transform(e.csl.author, lambda a: lower(a.family)), c.surname)
    OR len(list_filter(e.csl.author, lambda a: contains(' ' || regexp_replace(lower(a.literal), '[^\p{{L}}\d]+', ' ', 'g') || ' ', ' ' || regexp_replace(c.surname, '[^\p{{L}}\d]+', ' ', 'g') || ' '))) > 0
    OR contains(' ' || regexp_replace(lower(substr(e.raw_text, 1, 120)), '[^\p{{L}}\d]+', ' ', 'g') || ' ', ' ' || regexp_replace(c.surname, '[^\p{{L}}\d]+', ' ', 'g') || ' '))
SELECT c.marker_key, c.surname, c.year, c.letter, CAST(count(f.entry_key) AS BIGINT) AS n_fits,
  CASE WHEN count(f.entry_key) = 1 THEN min(f.entry_key) WHEN count(*) FILTER (f.lettered) = 1 THEN min(f.entry_key) FILTER (f.lettered) END AS entry_key,
  CASE WHEN count(f.entry_key) = 0 THEN 'unresolved' WHEN count(f.entry_key) = 1 OR count(*) FILTER (f.lettered) = 1 THEN 'linked' ELSE 'ambiguous' END AS outcome
FROM cites c LEFT JOIN fits f ON f.marker_key = c.marker_key AND f.surname = c.surname AND f.year = c.year AND f.letter = c.letter GROUP BY 1, 2, 3, 4""",
    "superscript_segments": r"""
SELECT span_key, regexp_replace(text, '⟦\^([\d\s,;–-]+)⟧', '[\1]', 'g') AS plain, regexp_extract_all(text, '⟦\^([\d\s,;–-]+)⟧', 1) AS tokens
FROM (SELECT DISTINCT span_key, text FROM text_spans) WHERE regexp_matches(text, '⟦\^([\d\s,;–-]+)⟧')""",
}

QUERIES = {
    f.__name__: f
    for f in (
        citation_report, times_cited, uncited_entries, cited_entries, orphan_markers, unresolved_digest, marker_spans, citation_style_vote,
        style_markers, numeric_links, author_year_links, superscript_segments,
    )
}

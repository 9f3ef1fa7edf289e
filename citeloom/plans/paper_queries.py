"""Layout, edits, review, exports, reports and activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import editing, export, layout, markers, reports, review
from citeloom.sources import store
from citeloom.sources.tables import once, table
from citeloom.streaming import activity


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "sections", "section_key", "paper_id", "section_ix", "section_id", "heading_level", "heading", "paragraphs"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "text_spans", "span_key", "paper_id", "page", "span_ix", "text", "x_pos", "y_pos", "width", "font_size", "font_name", "bold"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "ref_entries", "entry_key", "paper_id", "id", "entry_ix", "raw_text", "csl", "resolution", "recorded_at"))


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "markers", "marker_key", "paper_id", "raw", "targets", "unresolved"))


# layout


def bold_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = table(spark, sf_dir, "text_spans", "font_name").filter("font_name IS NOT NULL").distinct()
    return fonts.select("font_name", layout.is_bold_font(F.col("font_name")).alias("is_bold"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_lines(_spans(spark, sf_dir))


def span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_tables(_spans(spark, sf_dir))


def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns on each page by the places at which its spans start."""
    return layout.clusters(_spans(spark, sf_dir).filter("x_pos IS NOT NULL"), ["paper_id", "page"], "x_pos")


def nfkc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nfkc(_spans(spark, sf_dir).filter("text IS NOT NULL"), "span_key", "text")


# edits: three kinds of operations on every section, by its level, and one that is out of range on long ones


def _operations(sections: DataFrame) -> DataFrame:
    n = F.size("paragraphs")
    op = lambda name, at, text: F.struct(F.lit(name).alias("op"), at.cast("int").alias("at"), F.lit(text).alias("text"))
    front, first, last = op("insert_paragraph", F.lit(-1), "Inserted."), op("replace_paragraph", F.lit(0), "Rewritten [1]."), op("delete_paragraph", n - 1, "")
    far = F.when(n >= 3, F.array(op("replace_paragraph", n + 3, "Lost."), op("delete_paragraph", F.lit(0), ""))).otherwise(F.array().cast("array<struct<op:string,at:int,text:string>>"))
    chosen = F.concat(F.when(F.col("heading_level") == 0, F.array(front)).when(F.col("heading_level") == 1, F.array(first)).otherwise(F.array(last)), far)
    return sections.filter(n > 0).select("section_key", F.posexplode(chosen).alias("op_ix", "o")).select("section_key", "op_ix", "o.*")


def _paragraphs(sections: DataFrame) -> DataFrame:
    return sections.select("section_key", F.posexplode("paragraphs").alias("para_ix", "text"))


def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    return editing.apply_operations(_paragraphs(s), _operations(s))


def edit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    return editing.structural_violations(s.select("section_key", F.size("paragraphs").alias("n_paragraphs")), _operations(s)).withColumn("op_ix", F.col("op_ix").cast("long"))


def citations_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    papers = s.select("section_key", "paper_id")
    before = _paragraphs(s).join(papers, "section_key")
    after = editing.apply_operations(_paragraphs(s), _operations(s)).join(papers, "section_key")
    return editing.citations_lost(before, after).withColumn("number", F.col("number").cast("long"))


def word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title as it was read off against the text it was read from."""
    e = _entries(spark, sf_dir).select("entry_key", F.col("csl.title").alias("before"), F.col("raw_text").alias("after")).filter("before IS NOT NULL AND after IS NOT NULL")
    return editing.diff_rows(e, "entry_key")


# review


def reviewable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewable_sections(_sections(spark, sf_dir))


def claims_per_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.claims(_sections(spark, sf_dir))


def claim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims judged against the section heading they stand under, by the judge without a model."""
    s = _sections(spark, sf_dir)
    pairs = review.claims(s).join(s.select("section_key", "heading"), "section_key").filter("heading IS NOT NULL")
    named = pairs.select(F.concat_ws("|", "paper_id", "number", "rank").alias("claim_id"), F.col("sentence").alias("claim"), F.col("heading").alias("source"))
    return review.findings(review.judged(named, "claim_id"), "claim_id")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir).select(F.col("paper_id").alias("run_id"), F.lit("section").alias("unit_kind"), F.col("section_key").cast("string").alias("unit_id"), F.lit(None).cast("string").alias("verdict"))
    e = _entries(spark, sf_dir).select(F.col("paper_id").alias("run_id"), F.lit("entry").alias("unit_kind"), F.col("entry_key").cast("string").alias("unit_id"), F.when(tx.quote_in_text(F.col("csl.title"), F.col("raw_text")), "supports").otherwise("cannot-tell").alias("verdict"))
    return s.unionByName(e)


def review_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of review that are left when all supported entries are on the ledger."""
    units = _units(spark, sf_dir)
    return review.pending(units, units.filter("verdict = 'supports'")).select("run_id", "unit_kind", "unit_id")


def review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.statistics(_units(spark, sf_dir))


# exports


def export_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.bibtex(_entries(spark, sf_dir))


def export_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.latex_sections(_sections(spark, sf_dir))


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown_sections(_sections(spark, sf_dir))


def export_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of every document as LaTeX."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(export.tables_in(F.regexp_replace("text", "\r", ""))).alias("table_ix", "t"))
    return docs.filter(tx.is_markdown_table(F.col("t"))).select("doc_id", "table_ix", export.tabular(F.col("t")).alias("latex"))


def cite_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed markers as cite commands, with the ids of their paper's numbered entries."""
    e = once(table(spark, sf_dir, "ref_entries", "entry_key", "paper_id", "id", "entry_ix", "marker"))
    return export.cite_markers(_markers(spark, sf_dir).select("marker_key", "paper_id", "raw"), e)


def csl_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography lines in each of the styles."""
    return reduce(DataFrame.unionByName, [export.bibliography(_entries(spark, sf_dir), s).withColumn("style", F.lit(s)) for s in ("apa", "vancouver", "harvard1")])


# reports


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.library(_entries(spark, sf_dir))


def citations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return reports.citations_table(e, markers.times_cited(_markers(spark, sf_dir), e))


def failure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = _entries(spark, sf_dir), _markers(spark, sf_dir)
    lost = e.join(markers.uncited(m, e), "entry_key", "left_semi")
    return reports.by_region(reports.failures(e, markers.orphans(m), lost))


def proposal_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = once(table(spark, sf_dir, "csl_names", "name_key", "proposal_id", "created_at"))
    return reports.proposal_thread(names)


def resolution_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.note_counts(_entries(spark, sf_dir))


def valid_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.valid_papers(table(spark, sf_dir, "markers", "paper_id"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as server-sent frames, the last one unfinished, and read back."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    frame = F.concat(F.lit('data: {"type":"'), "event_type", F.lit('","id":'), F.col("event_id").cast("string"), F.lit("}\n\n"))
    frames = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))), lambda x: x["f"]), "")
    text = e.groupBy(F.col("user_id").alias("stream")).agg(F.concat(frames, F.lit('data: {"type":"cut')).alias("value"))
    return store.parse_events(text).select("stream", F.col("seq").cast("long"), "event", F.get_json_object("payload", "$.id").cast("long").alias("event_id"))


# activity: extensions over the events table


def activity_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.tumbling(table(spark, sf_dir, "events"))


def activity_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.sliding(table(spark, sf_dir, "events"))


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.sessions(table(spark, sf_dir, "events"))


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.breaker_states(table(spark, sf_dir, "events"))


_S = "(SELECT DISTINCT section_key, paper_id, section_ix, section_id, heading_level, heading, paragraphs FROM sections)"
_E = "(SELECT DISTINCT entry_key, paper_id, id, entry_ix, raw_text, csl, resolution, recorded_at FROM ref_entries)"
_M = "(SELECT DISTINCT marker_key, paper_id, raw, targets, unresolved FROM markers)"
_OPS = f"""base AS (SELECT section_key, paper_id, u.i - 1 AS "at", paragraphs[u.i] AS text FROM {_S}, LATERAL (SELECT unnest(range(1, len(paragraphs) + 1)) AS i) u),
n AS (SELECT *, len(paragraphs) AS n FROM {_S} WHERE len(paragraphs) > 0),
ops AS (SELECT section_key, n, 0 AS op_ix, CASE heading_level WHEN 0 THEN 'insert_paragraph' WHEN 1 THEN 'replace_paragraph' ELSE 'delete_paragraph' END AS op, CASE heading_level WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE n - 1 END AS "at", CASE heading_level WHEN 0 THEN 'Inserted.' WHEN 1 THEN 'Rewritten [1].' ELSE '' END AS text FROM n
  UNION ALL SELECT section_key, n, 1, 'replace_paragraph', n + 3, 'Lost.' FROM n WHERE n >= 3 UNION ALL SELECT section_key, n, 2, 'delete_paragraph', 0, '' FROM n WHERE n >= 3),
done AS (SELECT b.section_key, b."at", 0 AS behind, 0 AS op_ix, coalesce(r.text, b.text) AS text FROM base b LEFT JOIN ops r ON r.section_key = b.section_key AND r."at" = b."at" AND r.op = 'replace_paragraph'
    WHERE NOT EXISTS (SELECT 1 FROM ops d WHERE d.section_key = b.section_key AND d."at" = b."at" AND d.op = 'delete_paragraph')
  UNION ALL SELECT section_key, "at", 1, op_ix, text FROM ops WHERE op = 'insert_paragraph'),
after_edit AS (SELECT section_key, CAST(row_number() OVER (PARTITION BY section_key ORDER BY "at", behind, op_ix) - 1 AS BIGINT) AS para_ix, text FROM done)"""
_NUMS = r"""list_distinct(flatten(list_transform(string_split_regex(x, '[,;]'), lambda p: CASE WHEN len(string_split_regex(p, '[–-]')) = 2 AND try_cast(trim(string_split_regex(p, '[–-]')[2]) AS INTEGER) > try_cast(trim(string_split_regex(p, '[–-]')[1]) AS INTEGER)
  THEN range(CAST(trim(string_split_regex(p, '[–-]')[1]) AS BIGINT), least(CAST(trim(string_split_regex(p, '[–-]')[2]) AS BIGINT), CAST(trim(string_split_regex(p, '[–-]')[1]) AS BIGINT) + 99) + 1) ELSE [try_cast(trim(string_split_regex(p, '[–-]')[1]) AS BIGINT)] END)))"""
_BRACKET = r"'\[(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\]'"
_LATEX = r"replace(regexp_replace(replace(regexp_replace(replace(regexp_replace({0}, '⟦\^([\d\s,;–-]+)⟧', '[\1]', 'g'), '\', chr(1)), '([&%$#_{{}}])', '\\\1', 'g'), '~', '\textasciitilde{{}}'), '\^', '\\textasciicircum{{}}', 'g'), chr(1), '\textbackslash{{}}')"
_QUOTED = r"(len(trim(regexp_replace(lower(csl.title), '[^\p{L}\p{N}]+', ' ', 'g'))) >= 10 AND contains(trim(regexp_replace(lower(raw_text), '[^\p{L}\p{N}]+', ' ', 'g')), trim(regexp_replace(lower(csl.title), '[^\p{L}\p{N}]+', ' ', 'g'))))"
_UNITS = f"""units AS (SELECT paper_id AS run_id, 'section' AS unit_kind, CAST(section_key AS VARCHAR) AS unit_id, CAST(NULL AS VARCHAR) AS verdict FROM {_S}
  UNION ALL SELECT paper_id, 'entry', CAST(entry_key AS VARCHAR), CASE WHEN {_QUOTED} THEN 'supports' ELSE 'cannot-tell' END FROM {_E})"""
_TIMES = f"t AS (SELECT paper_id, id, count(DISTINCT marker_key) AS n FROM (SELECT marker_key, paper_id, unnest(targets) AS id FROM {_M}) WHERE id IS NOT NULL GROUP BY 1, 2)"
_NAME = "coalesce(csl.author[{0}].family, csl.author[{0}].literal, '?')"

SQL = {
    "bold_fonts": "SELECT DISTINCT font_name, regexp_matches(font_name, '(?i)bold|black|heavy|semibold|demi|medi') AS is_bold FROM text_spans WHERE font_name IS NOT NULL",
    "edit_apply": f"WITH {_OPS} SELECT * FROM after_edit",
    "edit_violations": f"""WITH {_OPS} SELECT section_key, CAST(op_ix AS BIGINT) AS op_ix, 'out-of-range' AS rule FROM ops WHERE "at" < CASE WHEN op = 'insert_paragraph' THEN -1 ELSE 0 END OR "at" >= n
UNION ALL SELECT section_key, CAST(op_ix AS BIGINT), 'conflict' FROM (SELECT *, row_number() OVER (PARTITION BY section_key, "at" ORDER BY op_ix) AS k FROM ops WHERE op <> 'insert_paragraph') WHERE k > 1""",
    "citations_lost": f"""WITH {_OPS},
b AS (SELECT DISTINCT paper_id, unnest({_NUMS.replace('x,', 'l,', 1)}) AS number FROM (SELECT paper_id, unnest(regexp_extract_all(text, {_BRACKET}, 1)) AS l FROM base)),
a AS (SELECT DISTINCT paper_id, unnest({_NUMS.replace('x,', 'l,', 1)}) AS number FROM (SELECT paper_id, unnest(regexp_extract_all(text, {_BRACKET}, 1)) AS l FROM after_edit JOIN {_S} USING (section_key)))
SELECT paper_id, number FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.paper_id = b.paper_id AND a.number = b.number)""",
    "reviewable_sections": rf"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_ix, section_key) AS rank FROM {_S} WHERE heading_level BETWEEN 1 AND 2 AND len(paragraphs) > 0
  AND NOT regexp_matches(coalesce(heading, ''), '(?i)^(\(front matter\)|acknowledgm?ents?|references|bibliography|appendix|notation)'))
SELECT section_key, rank, substr(regexp_replace(array_to_string(list_filter(paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10)), '⟦\^([\d\s,;–-]+)⟧', '[\1]', 'g'), 1, 1400) AS excerpt FROM r WHERE rank <= 8""",
    "review_pending": f"WITH {_UNITS} SELECT run_id, unit_kind, unit_id FROM units WHERE verdict IS DISTINCT FROM 'supports'",
    "review_statistics": f"""WITH {_UNITS} SELECT run_id, count(*) FILTER (unit_kind = 'section') AS sections_scanned, count(*) FILTER (unit_kind = 'entry') AS entries_checked,
  count(verdict) AS claims_checked, count(*) FILTER (verdict = 'supports') AS claims_supported FROM units GROUP BY run_id""",
    "export_bibtex": rf"""
WITH e AS (SELECT *, coalesce(id, 'entry-' || entry_key) AS name, csl.csl_type AS ty,
  array_to_string(list_transform(csl.author, lambda a: coalesce(a.literal, nullif(concat_ws(', ', a.family, a.given), ''), '')), ' and ') AS who, CAST(csl.issued[1][1] AS VARCHAR) AS y FROM {_E}),
l AS (SELECT paper_id, entry_ix, entry_key, '@' || CASE ty WHEN 'paper-conference' THEN 'inproceedings' WHEN 'book' THEN 'book' ELSE 'article' END || '{{' || name || ',' || chr(10) || concat_ws(',' || chr(10),
  '  title = {{' || regexp_replace(nullif(csl.title, ''), '[{{}}]', '', 'g') || '}}', '  author = {{' || regexp_replace(nullif(who, ''), '[{{}}]', '', 'g') || '}}', '  year = {{' || y || '}}',
  CASE ty WHEN 'paper-conference' THEN '  booktitle = {{' ELSE '  journal = {{' END || regexp_replace(nullif(csl.container_title, ''), '[{{}}]', '', 'g') || '}}', '  volume = {{' || nullif(csl.volume, '') || '}}',
  '  pages = {{' || nullif(csl.page, '') || '}}', '  doi = {{' || nullif(csl.doi, '') || '}}') || chr(10) || '}}' AS line FROM e)
SELECT paper_id, string_agg(line, chr(10) || chr(10) ORDER BY entry_ix, entry_key) AS text FROM l GROUP BY paper_id""",
    "export_latex": rf"""
WITH l AS (SELECT paper_id, section_ix, section_key, array_to_string(list_prepend('\' || CASE WHEN heading_level >= 3 THEN 'subsubsection' WHEN heading_level = 2 THEN 'subsection' ELSE 'section' END || '{{' ||
  {_LATEX.format(r"regexp_replace(coalesce(heading, ''), '^\d+(\.\d+)*\.?\s+', '')")} || '}}', list_transform(list_filter(paragraphs, lambda p: p IS NOT NULL), lambda p: {_LATEX.format('p')})), chr(10) || chr(10)) AS line FROM {_S} WHERE heading_level > 0)
SELECT paper_id, string_agg(line, chr(10) || chr(10) ORDER BY section_ix, section_key) AS text FROM l GROUP BY paper_id""",
    "export_markdown": rf"""
WITH l AS (SELECT paper_id, section_ix, section_key, array_to_string(list_prepend(repeat('#', CAST(least(CASE WHEN heading_level > 0 THEN heading_level + 1 ELSE 2 END, 6) AS INTEGER)) || ' ' || coalesce(heading, ''),
  list_transform(list_filter(paragraphs, lambda p: p IS NOT NULL), lambda p: regexp_replace(p, '⟦\^([\d\s,;–-]+)⟧', '[\1]', 'g'))), chr(10) || chr(10)) AS line FROM {_S})
SELECT paper_id, string_agg(line, chr(10) || chr(10) ORDER BY section_ix, section_key) AS text FROM l GROUP BY paper_id""",
    "cite_commands": rf"""
WITH s AS (SELECT marker_key, paper_id, raw, string_split_regex(regexp_extract(raw, {_BRACKET}, 1), '[,;]') AS parts FROM {_M} WHERE regexp_full_match(raw, {_BRACKET})),
o AS (SELECT marker_key, paper_id, raw, generate_subscripts(parts, 1) AS i, list_transform(string_split_regex(unnest(parts), '[–-]'), lambda x: try_cast(trim(x) AS BIGINT)) AS e FROM s),
p AS (SELECT marker_key, paper_id, raw, i, unnest(CASE WHEN len(e) = 2 AND e[2] > e[1] THEN range(e[1], least(e[2], e[1] + 99) + 1) ELSE [e[1]] END) AS number FROM o),
l AS (SELECT paper_id, marker, arg_max(id, (entry_ix, entry_key)) AS id FROM {_E.replace("entry_ix, raw_text", "entry_ix, marker, raw_text")} WHERE marker IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2)
SELECT marker_key, CASE WHEN count(l.id) > 0 THEN '\cite{{' || string_agg(l.id, ',' ORDER BY i, number) || '}}' ELSE raw END AS latex
FROM p LEFT JOIN l ON l.paper_id = p.paper_id AND l.marker = CAST(p.number AS VARCHAR) GROUP BY marker_key, raw""",
    "library_listing": f"SELECT paper_id, count(*) AS n_entries, max(recorded_at) AS uploaded_at FROM {_E} GROUP BY paper_id ORDER BY uploaded_at DESC, paper_id LIMIT 20",
    "citations_table": f"""WITH {_TIMES}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY entry_ix, entry_key) AS place FROM {_E})
SELECT entry_key, place, CASE WHEN coalesce(len(csl.author), 0) = 0 THEN '—' WHEN len(csl.author) = 1 THEN {_NAME.format(1)} WHEN len(csl.author) = 2 THEN {_NAME.format(1)} || ' & ' || {_NAME.format(2)} ELSE {_NAME.format(1)} || ' et al.' END AS label,
  csl.issued[1][1] AS year, coalesce(n, 0) AS times_cited FROM r LEFT JOIN t ON t.paper_id = r.paper_id AND t.id = r.id WHERE place <= 25""",
    "failure_regions": f"""WITH f AS (SELECT paper_id, 'references' AS region, count(*) AS n FROM {_E} WHERE csl.title IS NULL GROUP BY 1
  UNION ALL SELECT paper_id, 'markers', count(*) FROM {_M} WHERE len(list_filter(unresolved, lambda x: x IS NOT NULL)) > 0 GROUP BY 1)
SELECT paper_id, region, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_failures FROM f GROUP BY 1, 2""",
    "proposal_thread": """WITH p AS (SELECT proposal_id, min(created_at) AS "at", count(*) AS n FROM (SELECT DISTINCT name_key, proposal_id, created_at FROM csl_names) GROUP BY 1)
SELECT proposal_id, "at", n, 0 AS part, 'user' AS role FROM p UNION ALL SELECT proposal_id, "at", n, 1, 'proposal' FROM p""",
    "resolution_notes": f"""SELECT paper_id, count(*) FILTER (resolution.status <> 'verified') AS unverified, count(*) FILTER (regexp_matches(coalesce(resolution.note, ''), '(?i)no title')) AS no_title,
  count(*) FILTER (regexp_matches(coalesce(resolution.note, ''), '(?i)rate.?limit|429|time budget')) AS rate_limited, count(*) FILTER (regexp_matches(coalesce(resolution.note, ''), '(?i)rate.?limit|429|time budget')) >= 4 AS partial_coverage FROM {_E} GROUP BY paper_id""",
    "valid_papers": "SELECT DISTINCT paper_id, coalesce(regexp_full_match(paper_id, '[0-9a-fA-F-]{36}'), false) AS valid FROM markers",
    "event_frames": "SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS event, event_id FROM events",
    "activity_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "activity_sliding": "SELECT window_start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS window_start FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1",
    "activity_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
}

QUERIES = {
    f.__name__: f
    for f in (
        bold_fonts, span_lines, span_tables, column_clusters, nfkc_spans, edit_apply, edit_violations, citations_lost, word_diffs, reviewable_sections,
        claims_per_reference, claim_findings, review_pending, review_statistics, export_bibtex, export_latex, export_markdown, export_tabular, cite_commands,
        csl_bibliography, library_listing, citations_table, failure_regions, proposal_thread, resolution_notes, valid_papers, event_frames,
        activity_tumbling, activity_sliding, activity_sessions, breaker_states,
    )
}

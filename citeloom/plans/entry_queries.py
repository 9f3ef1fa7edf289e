"""Fields of entries, and their resolution against source records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import entries as ops
from citeloom.operators import workflow
from citeloom.sources.tables import once, once_by_key, table


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "raw_entries", "raw_key", "text"))


def _entries(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "ref_entries", "entry_key", "paper_id", "entry_ix", "raw_text", "csl", "recorded_at")
    rows = once_by_key(rows, "entry_key") if by_key else once(rows)
    return rows.select("entry_key", "paper_id", "entry_ix", "raw_text", "recorded_at", F.col("csl.title").alias("title"), F.expr("try_element_at(try_element_at(csl.issued, 1), 1)").alias("year"), F.col("csl.doi").alias("doi"), F.col("csl.author").alias("author"))


def _works(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "works", "work_key", "service", "item_id", "title", "author", "issued", "doi", "container_title", "fetched_at")
    rows = once_by_key(rows, "work_key") if by_key else once(rows)
    return rows.withColumn("year", F.expr("try_element_at(try_element_at(issued, 1), 1)"))


def entry_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.identifiers(_raw(spark, sf_dir), "raw_key")


def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every raw entry; authors as 'family, given' or the literal, in order."""
    shown = F.transform("authors", lambda a: F.coalesce(a["literal"], F.concat_ws(", ", a["family"], a["given"])))
    return ops.entry_fields(_raw(spark, sf_dir), "raw_key").withColumn("authors", F.array_join(shown, "; "))


def paper_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return ops.paper_years(e, e.groupBy("paper_id").agg(F.year(F.min("recorded_at")).alias("meta_year")))


def title_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ops.tokens(_entries(spark, sf_dir, True), "entry_key", F.col("title"))
    right = ops.tokens(_works(spark, sf_dir, True), "work_key", F.col("title"))
    return ops.similar_titles(left, right, "entry_key", "work_key").withColumn("score", F.round("score", 6))


def resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_by_title(_entries(spark, sf_dir, True), _works(spark, sf_dir, True))


def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second service resolved against the first: by DOI, what is left by title, type of venue and year."""
    w = _works(spark, sf_dir)
    mine = w.filter("service = 'semanticscholar'")
    theirs = w.filter("service = 'openalex'").withColumnRenamed("work_key", "other_key")
    doi, named = tx.bare_doi(F.col("doi")), F.concat_ws("|", F.lower("title"), F.col("year").cast("string"))
    return ops.by_identifier(mine, theirs, [(doi, doi, "doi"), (F.when(F.col("year").isNotNull(), named), F.when(F.col("year").isNotNull(), named), "title-year")], "work_key", "other_key")


def missing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unmatched_works(_works(spark, sf_dir, True), _entries(spark, sf_dir, True), 2020)


def greedy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists by venue and year without near repeats, the lower key first."""
    w = _works(spark, sf_dir).filter("container_title IS NOT NULL AND year IS NOT NULL AND title IS NOT NULL")
    return ops.greedy_distinct(w, ["container_title", "year"], "work_key")


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_records(_works(spark, sf_dir)).select("service", "item_id", "work_key")


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works written as the first service's JSON and read back."""
    w = _works(spark, sf_dir)
    names = F.transform(F.coalesce("author", F.array()), lambda a: F.struct(F.struct(F.coalesce(a["literal"], F.concat_ws(" ", a["given"], a["family"])).alias("display_name")).alias("author")))
    index = F.map_from_entries(F.transform(F.array_distinct(F.split("title", " ")), lambda x: F.struct(x.alias("key"), F.filter(F.transform(F.split("title", " "), lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull()).alias("value"))))
    body = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), names.alias("authorships"), index.alias("abstract_inverted_index")))
    read = ops.csl_of_source_json(w.select(body.alias("body")))
    return read.select("item_id", "csl_type", "title", "year", "doi", F.size("authors").cast("long").alias("n_authors"), F.get("authors", F.lit(0))["family"].alias("first_family"), "abstract")


def doi_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs in requests of 50."""
    return ops.request_chunks(_works(spark, sf_dir).select(tx.bare_doi(F.col("doi")).alias("doi")), "doi", 50)


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by DOI that no stored answer has; stored are those of the first service."""
    w = _works(spark, sf_dir).filter("doi IS NOT NULL")
    request = w.select("work_key", "service", F.concat(F.lit("https://api.example.org/works/"), F.url_encode("doi")).alias("url"), F.lit(None).cast("string").alias("body"))
    cache = request.filter("service = 'openalex'").select(ops.cache_key(F.col("url"), F.col("body")).alias("key")).distinct()
    return ops.cache_misses(request, cache).select("work_key", "key")


def work_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best records for the title of every entry."""
    queries = _entries(spark, sf_dir, True).filter("title IS NOT NULL").select(F.col("entry_key").alias("query_id"), F.col("title").alias("query"), F.col("year").alias("max_year"))
    return workflow.search(queries, _works(spark, sf_dir, True), max_year=F.col("max_year") + 1)


def resolved_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade over all entries: identifiers of the text, then titles."""
    e, ids = _entries(spark, sf_dir, True), F.col("raw_text")
    entries = e.select("entry_key", "paper_id", "entry_ix", "title", "year", "raw_text", tx.doi_of(ids).alias("doi"), tx.arxiv_of(ids).alias("arxiv"), F.lit(None).cast("string").alias("status"))
    works = _works(spark, sf_dir, True).withColumn("arxiv", F.nullif(F.regexp_extract(F.lower("doi"), r"^10\.48550/arxiv\.(.+)$", 1), F.lit("")))
    return workflow.resolve(entries, works).withColumn("score", F.round("score", 6))


def missing_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that sections could cite: two queries a section, from its heading and its first words."""
    s = once(table(spark, sf_dir, "sections", "section_key", "heading", "paragraphs")).select("section_key", "heading", F.substring(F.array_join(F.filter("paragraphs", lambda p: p.isNotNull()), " "), 1, 1400).alias("excerpt"))
    asked = F.array(F.struct(F.lit(0).alias("pos"), F.col("heading").alias("query")), F.struct(F.lit(1).alias("pos"), F.substring("excerpt", 1, 120).alias("query")))
    queries = s.select("section_key", F.inline(asked)).filter("query IS NOT NULL").select("section_key", F.concat_ws("|", "section_key", "pos").alias("query_id"), "query")
    return workflow.missing_work(s.select("section_key", "excerpt"), queries, _works(spark, sf_dir, True), _entries(spark, sf_dir, True))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).filter("title IS NOT NULL").select("entry_key", tx.search_form(F.col("title")).alias("query"), tx.slug(F.col("title")).alias("slug"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = once(table(spark, sf_dir, "csl_names", "name_key", "literal")).filter("literal IS NOT NULL")
    return n.select("name_key", tx.split_display_name(F.trim("literal")).alias("n")).select("name_key", "n.*")


def quotes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).filter("title IS NOT NULL AND raw_text IS NOT NULL")
    return e.select("entry_key", tx.quote_in_text(F.col("title"), F.col("raw_text")).alias("quoted"))


_E = "(SELECT DISTINCT entry_key, paper_id, entry_ix, raw_text, recorded_at, csl.title AS title, csl.issued[1][1] AS year, csl.doi AS doi, csl.author AS author FROM ref_entries)"
_W = "(SELECT DISTINCT work_key, service, item_id, title, author, issued[1][1] AS year, doi, container_title, fetched_at FROM works)"
_TOK = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: len(x) > 1))"
_SEARCH = r"trim(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_SCORE = "CASE WHEN len(list_intersect(a.t, b.t)) = least(len(a.t), len(b.t)) AND least(len(a.t), len(b.t)) >= 4 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) END"
_PAIRS = f"""et AS (SELECT *, {_TOK} AS t FROM {_E} WHERE title IS NOT NULL), wt AS (SELECT *, {_TOK} AS t FROM {_W} WHERE title IS NOT NULL),
pairs AS (SELECT a.entry_key, b.work_key, {_SCORE} AS score FROM et a JOIN wt b ON len(a.t) > 0 AND len(b.t) > 0 WHERE {_SCORE} >= 0.75)"""

_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([A-Z])\.', '\1' || chr(1), 'g'), '([.?!])\s+([A-Z"“]|arXiv\b|in\s|pages\s)', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')"""
_LONG = r"(len(string_split_regex({0}, '\s+')) >= 3 AND NOT regexp_matches({0}, '(?i)\b10\.\d{{4,9}}/'))"
_BARE = r"""regexp_replace(regexp_replace({0}, '\.$', ''), '^["“]|["”]$', '', 'g')"""
_LATER = r"""list_filter(segments[2:4], lambda c: len(string_split_regex(c, '\s+')) >= 3 AND NOT regexp_matches(c, '(?i)\b10\.\d{4,9}/') AND NOT regexp_matches(c, '(?i)^(?:in|proceedings|journal|arxiv)\b')
    AND len(list_filter(string_split_regex(c, '\s+'), lambda w: regexp_matches(w, '^[A-Z]\.?,?$'))) < 0.4 * len(string_split_regex(c, '\s+')))[1]"""
_PERSON = ops.PERSON.replace("'", "''")

SQL = {
    "entry_identifiers": r"""
SELECT DISTINCT raw_key, nullif(regexp_replace(regexp_extract(text, '(?i)(?:^|[^0-9A-Za-z_])(10\.\d{4,9}/[^\s"<>;,]+)', 1), '[.,;)\]]+$', ''), '') AS doi,
  nullif(regexp_extract(text, '(?i)(?:arxiv[:\s]*|abs/)(\d{4}\.\d{4,5})(v\d+)?', 1), '') AS arxiv,
  list_filter(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{2})[a-z]?\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1900 AND 2027)[-1] AS year
FROM raw_entries WHERE text IS NOT NULL""",
    "entry_fields": rf"""
WITH r AS (SELECT DISTINCT raw_key, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM raw_entries WHERE text IS NOT NULL),
s AS (SELECT *, {_SENTENCES.format('t')} AS segments, regexp_extract(t, '\((?:19|20)\d{{2}}[a-z]?\)[.:]?\s+(.+)$', 1) AS rest,
    regexp_replace(regexp_extract(t, '["“]([^"“”]{{15,300}})["”]', 1), '[\s,.]+$', '') AS quoted, regexp_replace(regexp_extract(t, '^([^"“]+)["“]', 1), '[,\s]+$', '') AS before_quote FROM r),
h AS (SELECT *, CASE WHEN before_quote <> '' THEN before_quote ELSE coalesce(segments[1], '') END AS head, ({_SENTENCES.format('rest')})[1] AS dated FROM s),
b AS (SELECT *, regexp_replace(regexp_replace(head, '(?i)\bet al\b\.?', '', 'g'), '([^A-Z])\.\s*$', '\1') AS bare FROM h),
a AS (SELECT *, regexp_replace(bare, '(?i),?\s+and\s+', ', ', 'g') || ',' AS listed FROM b),
u AS (SELECT *, list_filter(list_zip(regexp_extract_all(listed, '{ops.AUTHOR_UNIT}', 1), regexp_extract_all(listed, '{ops.AUTHOR_UNIT}', 2), regexp_extract_all(listed, '{ops.AUTHOR_UNIT}', 3)), lambda x: len(trim(coalesce(x[1], '') || coalesce(x[3], ''))) > 1) AS units FROM a)
SELECT raw_key, nullif(regexp_replace(regexp_extract(text, '(?i)(?:^|[^0-9A-Za-z_])(10\.\d{{4,9}}/[^\s"<>;,]+)', 1), '[.,;)\]]+$', ''), '') AS doi,
  nullif(regexp_extract(text, '(?i)(?:arxiv[:\s]*|abs/)(\d{{4}}\.\d{{4,5}})(v\d+)?', 1), '') AS arxiv,
  list_filter(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{{2}})[a-z]?\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1900 AND 2027)[-1] AS year,
  coalesce(CASE WHEN {_LONG.format('quoted')} THEN quoted END, CASE WHEN {_LONG.format('dated')} THEN {_BARE.format('dated')} END,
    regexp_replace({_BARE.format(_LATER)}, ',\s*(?:19|20)\d{{2}}$', '')) AS title,
  CASE WHEN trim(bare) = '' OR len(bare) > 300 THEN '' ELSE array_to_string(list_slice(list_transform(units, lambda x: CASE WHEN coalesce(x[2], '') <> '' THEN trim(coalesce(x[1], '')) || ', ' || trim(coalesce(x[2], ''))
    WHEN regexp_matches(trim(coalesce(x[3], '')), '{_PERSON}') AND regexp_extract(trim(coalesce(x[3], '')), '{ops.GIVEN_FAMILY}', 2) <> '' THEN regexp_extract(trim(coalesce(x[3], '')), '{ops.GIVEN_FAMILY}', 2) || ', ' || regexp_extract(trim(coalesce(x[3], '')), '{ops.GIVEN_FAMILY}', 1)
    ELSE trim(coalesce(x[3], '')) END), 1, 30), '; ') END AS authors FROM u""",
    "paper_year": f"""
SELECT paper_id, CAST(coalesce(greatest(max(year), least(year(min(recorded_at)), max(year) + 1)), max(year), year(min(recorded_at))) AS INTEGER) AS paper_year FROM {_E} GROUP BY paper_id""",
    "title_similarity_pairs": f"WITH {_PAIRS} SELECT entry_key, work_key, round(score, 6) AS score FROM pairs",
    "resolve_titles": f"""
WITH {_PAIRS},
j AS (SELECT p.*, service, abs(nullif(e.year, 0) - nullif(w.year, 0)) <= 1 AS year_ok,
    CASE WHEN len(coalesce(w.author[1].family, string_split_regex(w.author[1].literal, '\\s+')[-1])) > 2 THEN contains(lower(raw_text), lower(coalesce(w.author[1].family, string_split_regex(w.author[1].literal, '\\s+')[-1]))) END AS author_ok
  FROM pairs p JOIN {_E} e USING (entry_key) JOIN {_W} w USING (work_key)),
v AS (SELECT *, CASE WHEN year_ok IS NOT DISTINCT FROM false OR author_ok IS NOT DISTINCT FROM false THEN 'low-confidence' WHEN year_ok OR author_ok THEN 'verified' WHEN score >= 0.9 THEN 'verified' ELSE 'low-confidence' END AS status FROM j)
SELECT entry_key, work_key, service, round(score, 6) AS score, status FROM v
QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY CASE status WHEN 'verified' THEN 0 ELSE 1 END, CASE service WHEN 'openalex' THEN 0 ELSE 1 END, score DESC, work_key) = 1""".replace("\\\\", "\\"),
    "resolution_cascade": f"""
WITH m AS (SELECT *, lower(doi) AS d, lower(title) || '|' || year AS n FROM {_W} WHERE service = 'semanticscholar'), o AS (SELECT *, lower(doi) AS d, lower(title) || '|' || year AS n FROM {_W} WHERE service = 'openalex'),
h1 AS (SELECT a.work_key, b.work_key AS other_key, 'doi' AS via FROM m a JOIN (SELECT d, max(work_key) AS work_key FROM o WHERE d IS NOT NULL GROUP BY d) b USING (d)),
h2 AS (SELECT a.work_key, b.work_key AS other_key, 'title-year' AS via FROM (SELECT * FROM m WHERE work_key NOT IN (SELECT work_key FROM h1)) a JOIN (SELECT n, max(work_key) AS work_key FROM o WHERE n IS NOT NULL GROUP BY n) b USING (n))
SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
    "missing_candidates": f"""
WITH {_PAIRS} SELECT work_key FROM {_W} w WHERE title IS NOT NULL AND (year IS NULL OR year = 0 OR year <= 2020)
AND NOT EXISTS (SELECT 1 FROM {_E} e WHERE lower(e.doi) = lower(w.doi)) AND work_key NOT IN (SELECT work_key FROM pairs)""",
    "latest_records": f"SELECT service, item_id, work_key FROM {_W} QUALIFY row_number() OVER (PARTITION BY service, item_id ORDER BY fetched_at DESC, work_key DESC) = 1",
    "source_records": rf"""
SELECT item_id, 'article' AS csl_type, title, year, doi, CAST(len(coalesce(author, [])) AS BIGINT) AS n_authors,
  CASE WHEN len(string_split_regex(coalesce(author[1].literal, concat_ws(' ', author[1].given, author[1].family)), '\s+')) > 1 THEN string_split_regex(coalesce(author[1].literal, concat_ws(' ', author[1].given, author[1].family)), '\s+')[-1] END AS first_family,
  title AS abstract FROM {_W}""",
    "doi_requests": f"SELECT doi, CAST((row_number() OVER (ORDER BY doi) - 1) // 50 AS BIGINT) AS chunk FROM (SELECT DISTINCT lower(doi) AS doi FROM {_W} WHERE doi IS NOT NULL)",
    "cache_misses": f"""
WITH r AS (SELECT work_key, service, sha1('https://api.example.org/works/' || replace(doi, '/', '%2F')) AS key FROM {_W} WHERE doi IS NOT NULL)
SELECT work_key, key FROM r WHERE key NOT IN (SELECT key FROM r WHERE service = 'openalex')""",
    "work_search": rf"""
WITH w AS (SELECT work_key, year, {_TOK} AS t FROM {_W} WHERE title IS NOT NULL), n AS (SELECT count(*) AS n FROM w),
ww AS (SELECT work_key, unnest(t) AS w FROM w), d AS (SELECT w, count(*) AS df, ln((any_value(n) + 1.0) / count(*)) AS idf FROM ww, n GROUP BY w),
q AS (SELECT entry_key AS query_id, year + 1 AS most, unnest({_TOK.replace('title', _SEARCH)}) AS w FROM {_E} WHERE title IS NOT NULL),
k AS (SELECT q.*, idf FROM q JOIN d ON d.w = q.w),
m AS (SELECT query_id, work_key, round(sum(idf), 6) AS relevance, any_value(most) AS most FROM k JOIN ww ON ww.w = k.w GROUP BY 1, 2)
SELECT query_id, m.work_key, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, m.work_key) AS place FROM m JOIN w ON w.work_key = m.work_key WHERE most IS NULL OR year IS NULL OR year <= most
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, m.work_key) <= 5""".replace("{{", "{").replace("}}", "}"),
    "search_queries": rf"""
SELECT entry_key, trim(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS query, substr(regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '-', 'g'), 1, 60) AS slug FROM {_E} WHERE title IS NOT NULL""",
    "display_names": r"""
WITH n AS (SELECT DISTINCT name_key, trim(literal) AS l, string_split_regex(trim(literal), '\s+') AS ws FROM csl_names WHERE literal IS NOT NULL)
SELECT name_key, CASE WHEN len(ws) > 1 THEN ws[-1] END AS family, CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:len(ws) - 1], ' ') END AS given, CASE WHEN len(ws) = 1 THEN l END AS literal FROM n""",
    "quotes_in_text": rf"""
WITH q AS (SELECT entry_key, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS q, trim(regexp_replace(lower(raw_text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM {_E} WHERE title IS NOT NULL AND raw_text IS NOT NULL)
SELECT entry_key, len(q) >= 10 AND contains(t, q) AS quoted FROM q""",
}

QUERIES = {
    f.__name__: f
    for f in (
        entry_identifiers, entry_fields, paper_year, title_similarity_pairs, resolve_titles, resolution_cascade, missing_candidates, greedy_candidates,
        latest_records, source_records, doi_requests, cache_misses, search_queries, display_names, quotes_in_text, work_search, resolved_entries, missing_work,
    )
}

"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import canonical_text, entity_matching, mixing, name_variants, near_duplicates, scan_repair, text_quality, tokenizer
from citeloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "ref_entries", "entry_key", "raw_text"), "entry_key", "raw_text")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a reference entry: its class and the number of verified links."""
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "ref_entries", "entry_key", "raw_text"), "entry_key", "raw_text")[0]


NAMES = ("name_key", "family", "given", "literal")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.name_pairs(table(spark, sf_dir, "csl_names", *NAMES))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a name: its group and the number of verified links of its spelling."""
    return name_variants.name_groups(table(spark, sf_dir, "csl_names", *NAMES))


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repair(*(table(spark, sf_dir, t) for t in ("text_lines", "sections", "raw_entries")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.found(_repairs(spark, sf_dir))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, paragraph and entry as repaired (null: furniture)."""
    return _repairs(spark, sf_dir).select("tbl", "row_key", "para_ix", "repaired")


def p4_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text of each scanned page."""
    return scan_repair.page_texts(_repairs(spark, sf_dir))


WORKS = ("work_key", "service", "title", "author", "issued", "volume", "page")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("entry_key", "work_key")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match with the rule that made it and its confidence."""
    return entity_matching.match(table(spark, sf_dir, "ref_entries", "entry_key", "raw_text", "csl"), table(spark, sf_dir, "works", *WORKS))


FIELDS_6 = {
    "text_spans": ("span_key", "text"),
    "works": ("work_key", "title"),
    "ref_entries": ("entry_key", "csl.title"),
    "raw_entries": ("raw_key", "text"),
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [canonical_text.cases(table(spark, sf_dir, t, key, F.col(c).alias("value")), t, key, F.col("value")) for t, (key, c) in FIELDS_6.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of problem 6 in its one form, a row for each key."""
    parts = [
        table(spark, sf_dir, t, F.lit(t).alias("tbl"), F.col(key).alias("row_key"), canonical_text.canonical_column(F.col(c)).alias("text"))
        for t, (key, c) in FIELDS_6.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("tbl", "row_key").agg(F.first("text").alias("text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))[1]


DOCUMENTS = ("doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.found(table(spark, sf_dir, "documents", *DOCUMENTS), table(spark, sf_dir, "common_words"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics with its outlier score."""
    return text_quality.scored(table(spark, sf_dir, "documents", *DOCUMENTS), table(spark, sf_dir, "common_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p3_found, p3_groups, p4_found, p4_repaired, p4_page_texts, p5_found, p5_matches, p6_found, p6_canonical, p7_ids, p8_mix, p8_shares, p9_found, p9_statistics)}


def _cases_sql() -> str:
    """Simple cases by their characters; look-alikes by a Latin letter in the same word (Python gives the classes)."""
    plain = f"[{canonical_text.INVISIBLE}{canonical_text.SPACES}\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06\ufe00-\ufe0f\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
    phonetic = "".join(c for c in canonical_text.LOOK_ALIKES if c in "ɡɑı")
    other = "".join(c for c in canonical_text.LOOK_ALIKES if c not in phonetic)
    latin = r"[a-zA-Z\x{C0}-\x{24F}]"
    looks = rf"{latin}\p{{L}}*[{other}{phonetic}]|[{other}{phonetic}]\p{{L}}*{latin}"
    test = f"regexp_matches(t, '{plain}') OR regexp_matches(t, '{looks}')"
    parts = [f"SELECT '{tbl}' AS tbl, {key} AS row_key, {col} AS t FROM {tbl}" for tbl, (key, col) in FIELDS_6.items()]
    return f"SELECT DISTINCT tbl, row_key FROM ({' UNION ALL '.join(parts)}) WHERE {test}"


SQL: dict[str, str] = {"p6_found": _cases_sql()}

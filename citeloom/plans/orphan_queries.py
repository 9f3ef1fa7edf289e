"""Queries of problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators.orphans import orphan_references, orphan_report, references
from citeloom.sources.tables import table

MARKERS = ("marker_key", "paper_id", "targets", "unresolved", "recorded_at")
ENTRIES = ("paper_id", "id", "marker", "csl", "recorded_at", "removed_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = orphan_references(table(spark, sf_dir, "markers", *MARKERS), table(spark, sf_dir, "ref_entries", *ENTRIES))
    return lost.select("marker_key", "field", "ref_value")


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "markers", *MARKERS)
    lost = orphan_references(markers, table(spark, sf_dir, "ref_entries", *ENTRIES))
    return orphan_report(lost, references(markers))


_FOUND_SQL = r"""
WITH refs AS (
  SELECT DISTINCT marker_key, paper_id, recorded_at, field, ref_value FROM (
    SELECT marker_key, paper_id, recorded_at, 'targets' AS field, lower(trim(unnest(targets))) AS ref_value FROM markers
    UNION ALL
    SELECT marker_key, paper_id, recorded_at, 'unresolved', lower(trim(unnest(unresolved))) FROM markers)
  WHERE ref_value IS NOT NULL AND NOT (field = 'unresolved' AND regexp_matches(ref_value, '\(ambiguous:.*\)'))),
lost AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM ref_entries e
    WHERE e.paper_id = r.paper_id AND e.recorded_at <= r.recorded_at AND (e.removed_at IS NULL OR e.removed_at > r.recorded_at)
      AND ((r.field = 'targets' AND lower(trim(e.id)) = r.ref_value)
        OR (r.field = 'unresolved' AND regexp_matches(r.ref_value, '^\d+$') AND lower(trim(e.marker)) = r.ref_value)
        OR (r.field = 'unresolved' AND NOT regexp_matches(r.ref_value, '^\d+$')
          AND (lower(trim(e.csl.author[1].family)) || ', ' || CAST(e.csl.issued[1][1] AS VARCHAR) = r.ref_value
            OR lower(trim(e.csl.author[1].family)) || ' (' || CAST(e.csl.issued[1][1] AS VARCHAR) || ')' = r.ref_value)))))
"""

SQL = {
    "p2_found": _FOUND_SQL + "SELECT marker_key, field, ref_value FROM lost",
    "p2_orphans_by_month": _FOUND_SQL
    + """SELECT field, month, CAST(count(*) AS BIGINT) AS n_references, CAST(sum(gone) AS BIGINT) AS n_orphans FROM (
    SELECT r.field, strftime(r.recorded_at, '%Y-%m') AS month,
      CASE WHEN EXISTS (SELECT 1 FROM lost l WHERE l.marker_key = r.marker_key AND l.field = r.field AND l.ref_value = r.ref_value) THEN 1 ELSE 0 END AS gone
    FROM refs r) GROUP BY field, month""",
}

QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month}

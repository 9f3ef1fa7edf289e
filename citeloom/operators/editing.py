"""Edits as data: applying operations to sections, checking them, and showing what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# The kinds of operations.
OPERATIONS = ("replace_paragraph", "insert_paragraph", "delete_paragraph", "edit_heading", "replace_abstract", "add_reference")


def apply_operations(paragraphs: DataFrame, operations: DataFrame) -> DataFrame:
    """``(section_key, para_ix, text)`` after the operations, paragraphs numbered anew.

    paragraphs: section_key, para_ix, text.  operations: section_key, op_ix, op, at, text; for an insertion
    ``at`` is the paragraph it goes behind, -1 the front.  The last replacement of a paragraph counts; a
    deleted paragraph keeps what was inserted behind it.
    """
    target = ["section_key", "at"]
    replaced = operations.filter("op = 'replace_paragraph'").groupBy(*target).agg(F.max_by("text", "op_ix").alias("new"))
    deleted = operations.filter("op = 'delete_paragraph'").select(*target).distinct().withColumn("gone", F.lit(True))
    base = (
        paragraphs.withColumnRenamed("para_ix", "at")
        .join(replaced, target, "left")
        .join(deleted, target, "left")
        .filter("gone IS NULL")
        .select("section_key", "at", F.lit(0).alias("behind"), F.lit(0).cast("long").alias("op_ix"), F.coalesce("new", "text").alias("text"))
    )
    inserted = operations.filter("op = 'insert_paragraph'").select("section_key", "at", F.lit(1).alias("behind"), F.col("op_ix").cast("long").alias("op_ix"), "text")
    order = Window.partitionBy("section_key").orderBy("at", "behind", "op_ix")
    return base.unionByName(inserted).select("section_key", (F.row_number().over(order) - 1).cast("long").alias("para_ix"), "text")


def structural_violations(sections: DataFrame, operations: DataFrame) -> DataFrame:
    """``(section_key, op_ix, rule)``: unknown sections, paragraphs out of range, targets touched twice.

    sections: section_key, n_paragraphs.
    """
    placed = operations.filter(~F.col("op").isin("replace_abstract", "add_reference")).join(sections, "section_key", "left")
    least = F.when(F.col("op") == "insert_paragraph", -1).otherwise(0)
    outside = (F.col("op") != "edit_heading") & ((F.col("at") < least) | (F.col("at") >= F.col("n_paragraphs")))
    touched = F.row_number().over(Window.partitionBy("section_key", "at").orderBy("op_ix"))
    twice = placed.filter(F.col("op").isin("replace_paragraph", "delete_paragraph") & F.col("n_paragraphs").isNotNull()).withColumn("n", touched).filter("n > 1")
    return (
        placed.filter("n_paragraphs IS NULL").select("section_key", "op_ix", F.lit("no-section").alias("rule"))
        .unionByName(placed.filter(F.col("n_paragraphs").isNotNull() & outside).select("section_key", "op_ix", F.lit("out-of-range").alias("rule")))
        .unionByName(twice.select("section_key", "op_ix", F.lit("conflict").alias("rule")))
    )


def cited_numbers(paragraphs: DataFrame) -> DataFrame:
    """Distinct (paper_id, number) of bracketed markers in paragraphs (paper_id, text)."""
    lists = paragraphs.select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(tx.BRACKET), F.lit(1))).alias("list"))
    return lists.select("paper_id", F.explode(tx.number_list(F.col("list"))).alias("number")).distinct()


def citations_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Numbers a paper cites before an edit and nowhere after it."""
    return cited_numbers(before).join(cited_numbers(after), ["paper_id", "number"], "left_anti")


def word_diff(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(kind, words) runs of 'same', 'del' and 'add' by longest common subsequence; on a tie the deletion comes first."""
    n, m = len(before), len(after)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if before[i] == after[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[str, list[str]]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and before[i] == after[j]:
            kind, word, i, j = "same", before[i], i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            kind, word, i = "del", before[i], i + 1
        else:
            kind, word, j = "add", after[j], j + 1
        if out and out[-1][0] == kind:
            out[-1][1].append(word)
        else:
            out.append((kind, [word]))
    return [(k, " ".join(ws)) for k, ws in out]


def diff_rows(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, part_ix, kind, words)`` of each pair (key, before, after)."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, what, ws) for k, b, a in zip(pdf[key], pdf["before"], pdf["after"]) for i, (what, ws) in enumerate(word_diff((b or "").split(), (a or "").split()))]
            yield pd.DataFrame(rows, columns=[key, "part_ix", "kind", "words"])

    return pairs.select(key, "before", "after").mapInPandas(run, f"{key} {kind}, part_ix int, kind string, words string")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(proposal_id, outcome)``: 404 for an unknown proposal, 409 for one decided before, else the new status.

    proposals: proposal_id, status; decisions: proposal_id, decision.
    """
    known = decisions.join(proposals, "proposal_id", "left")
    outcome = F.when(F.col("status").isNull(), "404").when(~F.col("decision").isin("approve", "reject"), "400").when(F.col("status") != "proposed", "409").when(F.col("decision") == "approve", "approved").otherwise("rejected")
    return known.select("proposal_id", outcome.alias("outcome"))

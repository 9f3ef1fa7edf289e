"""Orphan references: a broadcast Bloom filter of parent keys, then exact verification.

The filter answers "certainly no such parent" for most orphans without a shuffle; only references it
lets through go into the exact temporal join.  The filter's size is fixed from a count of the parents
and bounded by ``max_filter_bytes``; beyond that bound the filter is skipped and every reference takes
the exact path, which gives the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import materialize

TRIM = r"(?U)^\s+|\s+$"


def _tidy(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, TRIM, ""))


def parent_keys(entries: DataFrame) -> DataFrame:
    """``(paper_id, kind, ref_key, live_from, live_to)``: the keys under which an entry can be referred to.

    kind 'id' is the entry id, 'no' its list marker, 'ay' the first author's family with the year.
    A null paper, key or recorded_at yields no row.  Redelivered rows collapse.
    """
    family = F.get(F.col("csl.author"), F.lit(0))["family"]
    year = F.expr("try_element_at(try_element_at(csl.issued, 1), 1)")
    kinds = F.array(
        F.struct(F.lit("id").alias("kind"), _tidy(F.col("id")).alias("ref_key")),
        F.struct(F.lit("no").alias("kind"), _tidy(F.col("marker")).alias("ref_key")),
        F.struct(F.lit("ay").alias("kind"), F.concat(_tidy(family), F.lit("|"), year.cast("string")).alias("ref_key")),
    )
    return (
        entries.select("paper_id", F.inline(kinds), F.col("recorded_at").alias("live_from"), F.col("removed_at").alias("live_to"))
        .filter("paper_id IS NOT NULL AND ref_key IS NOT NULL AND live_from IS NOT NULL")
        .distinct()
    )


def references(markers: DataFrame) -> DataFrame:
    """One row for each distinct reference value of a marker, with the key it is to be looked up by.

    Null lists, null members and notes of ambiguity give no row.  A value of no known form keeps a key
    of kind 'none' that no parent has, so it is an orphan.
    """
    cite = r"^(.*?)\s*(?:,\s*(\d{4})|\((\d{4})\))$"
    base = markers.select("marker_key", "paper_id", "recorded_at", "targets", "unresolved")
    tagged = base.select(
        "marker_key",
        "paper_id",
        "recorded_at",
        F.explode(
            F.concat(
                F.transform(F.coalesce("targets", F.array().cast("array<string>")), lambda v: F.struct(F.lit("targets").alias("field"), v.alias("raw"))),
                F.transform(F.coalesce("unresolved", F.array().cast("array<string>")), lambda v: F.struct(F.lit("unresolved").alias("field"), v.alias("raw"))),
            )
        ).alias("r"),
    ).select("marker_key", "paper_id", "recorded_at", "r.field", _tidy(F.col("r.raw")).alias("ref_value"))
    value = F.col("ref_value")
    is_cite = value.rlike(cite)
    year = F.concat(F.regexp_extract(value, cite, 2), F.regexp_extract(value, cite, 3))
    return (
        tagged.filter(value.isNotNull() & ~((F.col("field") == "unresolved") & value.rlike(r"\(ambiguous:.*\)")))
        .withColumn(
            "kind",
            F.when(F.col("field") == "targets", "id").when(value.rlike(r"^\d+$"), "no").when(is_cite, "ay").otherwise("none"),
        )
        .withColumn("ref_key", F.when(F.col("kind") == "ay", F.concat(F.regexp_extract(value, cite, 1), F.lit("|"), year)).otherwise(value))
        .distinct()
    )


def _positions(first: np.ndarray, second: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Kirsch-Mitzenmacher double hashing, one row of k positions a key."""
    a, b = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def _hashes(*cols: str) -> list[Column]:
    return [F.xxhash64(*[F.col(c) for c in cols]).alias("_h1"), F.xxhash64(F.lit("second"), *[F.col(c) for c in cols]).alias("_h2")]


def bloom_words(keys: DataFrame, cols: list[str], n_keys: int, fpp: float, max_filter_bytes: int) -> tuple[np.ndarray, int]:
    """The filter's bit array over ``keys`` and the number of hashes.

    Bits are set with a distributed OR by 64-bit word; the driver receives at most max_filter_bytes of words.
    Where the wished share of false positives takes more, the filter has that size and lets more through, which
    the exact join looks at; what it rejects is an orphan at any size.
    """
    bits = min(max(1024, int(math.ceil(-max(n_keys, 1) * math.log(fpp) / math.log(2) ** 2))), max(max_filter_bytes, 8) * 8)
    bits = (bits + 63) // 64 * 64
    k = min(max(1, round(bits / max(n_keys, 1) * math.log(2))), 16)

    def set_bits(batches):
        for pdf in batches:
            pos = np.unique(_positions(pdf["_h1"].to_numpy(), pdf["_h2"].to_numpy(), k, bits).ravel())
            word, bit = (pos >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (pos & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"word": word, "bit": bit})

    words = (
        keys.select(*_hashes(*cols))
        .mapInPandas(set_bits, "word long, bit long")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toPandas()
    )
    array = np.zeros(bits // 64, dtype=np.int64)
    array[words["word"].to_numpy(dtype=np.int64)] = words["bit"].to_numpy(dtype=np.int64)
    return array, k


def orphan_references(markers: DataFrame, entries: DataFrame, fpp: float = 0.01, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``(marker_key, field, ref_value, recorded_at, paper_id)`` of every reference without a live parent.

    A reference whose marker has a null recorded_at or paper_id has no parent that was live then, so it
    is an orphan.  Empty tables give empty results (no parents: every reference is an orphan).  Extra
    columns are ignored.
    """
    spark = markers.sparkSession
    refs = references(markers)
    parents = materialize(parent_keys(entries), "orphan-parents")
    key = ["paper_id", "kind", "ref_key"]
    filt = bloom_words(parents, key, parents.count(), fpp, max_filter_bytes)
    words, k = spark.sparkContext.broadcast(filt[0]), filt[1]

    @F.pandas_udf(T.BooleanType())
    def might_hold(h1: pd.Series, h2: pd.Series) -> pd.Series:
        array = words.value
        pos = _positions(h1.to_numpy(), h2.to_numpy(), k, array.size * 64)
        hit = (array[(pos >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (pos & np.uint64(63))) & np.uint64(1)
        return pd.Series(hit.all(axis=1) if len(hit) else np.zeros(0, dtype=bool))

    h1, h2 = _hashes(*key)
    probed = materialize(refs.withColumn("_maybe", might_hold(h1, h2)), "orphan-refs")
    maybe, surely = probed.filter("_maybe"), probed.filter("NOT _maybe")
    live = parents.alias("p")
    m = maybe.alias("m")
    on = [F.col(f"m.{c}") == F.col(f"p.{c}") for c in key] + [
        F.col("p.live_from") <= F.col("m.recorded_at"),
        F.col("p.live_to").isNull() | (F.col("p.live_to") > F.col("m.recorded_at")),
    ]
    lost = m.join(live, on, "left_anti").unionByName(surely)
    return lost.select("marker_key", "field", "ref_value", "recorded_at", "paper_id")


def orphan_report(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans against all references, by field and month of the marker's recorded_at (null month kept)."""
    by = lambda df, name: df.groupBy("field", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias(name))
    return (
        by(refs, "n_references")
        .join(by(orphans, "n_orphans").withColumnRenamed("field", "f2").withColumnRenamed("month", "m2"), F.expr("field = f2 AND month <=> m2"), "left")
        .select("field", "month", "n_references", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))
    )

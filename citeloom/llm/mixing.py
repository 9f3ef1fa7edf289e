"""Mixing sources to target weights, measured in tokens, with capped repeats.

Method
    1. Every record's size is its number of tokens of a public tokenizer.  A source's records stand in a
       pseudo-random order (hash of the key); a prefix sum over hash ranges gives each record the offset
       of its first token in its source's stream.  The stream repeats at most ``max_repeats`` times.
    2. The total is the greatest for which every source that has records reaches its share within its
       repeats, or a given total; a source's quota is its share of it.  Quotas are cut to blocks.
    3. A splitting tree deals the blocks to output shards: a node's vector of block quotas is divided
       between its halves by one multivariate hypergeometric draw, so every shard holds the same number
       of blocks (plus or minus one) and the exact quotas are used up.
    4. A shard's blocks of a source are a range of a permutation of that source's blocks, hence disjoint;
       records of a shard are then shuffled within it.

A source's share differs from its target by less than one record.  Driver state is one row a source and
one number for each source and shard (shards are bounded); no record is ever collected.

Defined results: records with a null source, a source without target, or no tokens take no part; a
target without records, or with a null or non-positive share, contributes nothing and is reported with
zero; a null max_repeats counts as 1; repeated target rows count once (the largest share).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom.llm.tokenizer import VOCABULARY, count_tokens
from citeloom.session import materialize


@dataclass(frozen=True)
class Params:
    total_tokens: int | None = None
    shard_tokens: int = 64 << 20
    blocks_per_shard: int = 64
    least_shards: int = 8
    most_shards: int = 100_000
    records_per_range: int = 20_000
    seed: int = 20


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    size: int  # tokens
    records: int
    quota: int = 0
    blocks: int = 0


def quotas(sources: list[Source], p: Params) -> tuple[list[Source], int]:
    """Sources with their token quota and number of blocks; the tokens of a block."""
    live = [s for s in sources if s.size > 0 and s.share > 0]
    if not live:
        return [], 1
    total = p.total_tokens if p.total_tokens is not None else math.floor(min(s.size * s.repeats / s.share for s in live))
    quota = {s.name: min(round(s.share * total), s.size * s.repeats) for s in live}
    block = max(1, min(p.shard_tokens // p.blocks_per_shard, sum(quota.values()) // (p.least_shards * p.blocks_per_shard)))
    return [Source(s.name, s.share, s.repeats, s.size, s.records, quota[s.name], -(-quota[s.name] // block)) for s in live], block


def split_blocks(blocks: list[int], n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), by recursive hypergeometric halving."""
    out = np.zeros((n_shards, len(blocks)), dtype=np.int64)
    todo = [(0, n_shards, np.array(blocks, dtype=np.int64))]
    while todo:
        first, n, vector = todo.pop()
        if n == 1:
            out[first] = vector
            continue
        half = n // 2
        left = rng.multivariate_hypergeometric(vector, int(vector.sum()) * half // n, method="marginals")
        todo += [(first, half, left), (first + half, n - half, vector - left)]
    return out


def _stride(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """a, c of the permutation b -> (a * b + c) mod n."""
    if n < 3:
        return 1, 0
    while True:
        a = int(rng.integers(n // 3 + 1, n))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n))


def mix(documents: DataFrame, targets: DataFrame, p: Params = Params(), vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)``: (shard, position, source, doc_id, copy, n_tokens) and one row for each target."""
    spark = documents.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for row in targets.select("source_name", "target_share", "max_repeats").collect():  # one row a source: a setting, not data
        if row[0] is not None and row[1] is not None and row[1] > 0:
            wanted[row[0]] = max(wanted.get(row[0], (0.0, 0)), (float(row[1]), max(0, 1 if row[2] is None else row[2])))
    names = sorted(wanted)
    docs = documents.select("doc_id", "source", "text").filter(F.col("source").isin(names))
    sized = materialize(count_tokens(docs, keep=("source",), vocabulary=vocabulary).filter("n_tokens > 0"), "mix-sizes")
    have = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    plan, block = quotas([Source(n, *wanted[n], *have.get(n, (0, 0))) for n in names], p)
    rng = np.random.default_rng(p.seed)
    n_blocks = sum(s.blocks for s in plan)
    n_shards = max(1, min(p.most_shards, max(p.least_shards, n_blocks // p.blocks_per_shard)))
    dealt = split_blocks([s.blocks for s in plan], n_shards, rng) if plan else np.zeros((1, 0), dtype=np.int64)
    bounds = {s.name: np.cumsum(dealt[:, i]) for i, s in enumerate(plan)}
    strides = {s.name: (*_stride(s.blocks, rng), s.blocks) for s in plan}
    shared = spark.sparkContext.broadcast((bounds, strides))

    facts = spark.createDataFrame(
        [(s.name, s.quota, s.size, s.repeats, max(1, math.ceil(math.log2(max(2, s.records / p.records_per_range))))) for s in plan],
        "source string, quota long, size long, repeats int, bits int",
    )
    order = F.xxhash64(F.lit(p.seed), "doc_id")
    placed = sized.join(F.broadcast(facts), "source").withColumn("h", order).withColumn("range", F.expr("shiftrightunsigned(h, 64 - bits)"))
    ranges = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.select("source", "range", F.coalesce(F.sum("t").over(by_range), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(ahead, ["source", "range"])
    start = start.withColumn("mid", F.col("ahead") + F.col("inside") + F.floor(F.col("n_tokens") / 2))
    copies = F.least(F.col("repeats"), F.ceil((F.col("quota") - F.col("mid")) / F.col("size"))).cast("int")
    used = start.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    used = used.withColumn("block", F.floor((F.col("copy") * F.col("size") + F.col("mid")) / F.lit(block)))

    @F.pandas_udf(T.IntegerType())
    def shard_of(source: pd.Series, number: pd.Series) -> pd.Series:
        bound, stride = shared.value
        out = np.zeros(len(source), dtype=np.int32)
        for name in source.unique():
            a, c, n = stride[name]
            m = (source == name).to_numpy()
            place = np.array([(a * int(b) + c) % n for b in number[m]])
            out[m] = np.searchsorted(bound[name], place, side="right")
        return pd.Series(out)

    mixed = used.withColumn("shard", shard_of("source", "block"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(p.seed + 1), "doc_id", "copy"), "doc_id", "copy")
    mixture = mixed.select("shard", (F.row_number().over(local) - 1).cast("long").alias("position"), "source", "doc_id", "copy", "n_tokens")
    got = used.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), (F.max("copy") + 1).alias("most_uses"))
    asked = targets.filter("source_name IS NOT NULL").groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = got.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shares = (
        asked.withColumnRenamed("source_name", "source")
        .join(got, "source", "left")
        .join(F.broadcast(total))
        .select("source", "target_share", "max_repeats", zero("records"), zero("tokens"), zero("most_uses"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
    )
    return mixture, shares

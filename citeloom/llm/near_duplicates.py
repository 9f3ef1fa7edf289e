"""Near-duplicate records: segment-popcount embedding of a shingle fingerprint.

Method
    1. A record's *skeleton* is its letters and digits, lower case.  Equal skeletons form one class at
       once (plain aggregation), and one representative of each class goes on.
    2. Each distinct character trigram of a skeleton is one bit of a fingerprint; the embedding counts the
       bits in each segment of it.  If two trigram sets differ in r members, the Manhattan distance of their
       embeddings is at most r, over any choice of segments and for any folding that brings counts no farther
       apart.
    3. Grid: the first coordinate is the size, the number of bits.  It is cut at powers of two, and a record
       goes into its own stratum and into the next one if a similar record could be there, so that sizes are
       joined by range.  Within a stratum of size s the segments are dealt to s / ``bits`` sub-grids, as often
       as it takes to have ``cells`` of them; records meet that have equal counts in one sub-grid.  As
       sub-grids hold the same few bits at every size, the chance to meet depends on the similarity alone,
       not on the length: above 0.99 from a similarity of 0.7 on (``tests/llm`` measures it by length).
    4. A pair that met is kept when the sizes and the Manhattan distance of the folded embedding (512 segments,
       counts modulo two, compared as bits in the JVM) do not exceed what the similarity allows.  This is asked
       where records meet, so that only what passes is written; cells are joined in rounds by their number, so that
       the rows of one round at a time, which carry the embedding, take disk.
    5. What is left is verified exactly: Jaccard similarity of the trigram sets.
    6. Verified pairs are closed to groups by distributed connected components.

A cell is never gathered: pairs of a cell come from a sort-merge join on the cell, whose skewed partitions
adaptive execution splits, and no cell is treated otherwise for its size.

Character trigrams rather than word shingles are used because blanks inside words come and go in these
records; a pair is similar from ``similar`` on, or from ``doubtful`` on when the numbers agree as well.

Defined results: null text gives no row; records without a letter or digit are equal only if their text
is; repeated rows of one key count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.graph import connected_components
from citeloom.session import discard, materialize


@dataclass(frozen=True)
class Params:
    cells: int = 40  # sub-grids a record is put into, in each of its strata
    bits: float = 4.0  # bits a sub-grid holds at the lower end of its stratum
    width: int = 4096  # segments of a sub-grid
    least_bits: int = 4  # cells with fewer bits tell nothing, unless that is a third of the record
    similar: float = 0.66
    doubtful: float = 0.5


WORDS = [f"w{i}" for i in range(8)]  # the folded embedding, 64 segments a word
ROUNDS, ROUND_RECORDS = 16, 12_500  # most rounds in which cells are joined, records from which another round is worth it
_STRATUM_CHARS = 2_000_000  # characters handled at once; bounds memory, not results


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprint(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bit): the distinct trigrams of each text as numbers of 64 bits, by owner."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = codes[:-2] << np.uint64(42) ^ codes[1:-1] << np.uint64(21) ^ codes[2:]
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:-2] == owner[2:]
    owner, bit = owner[:-2][inside], _mix(gram[inside], 0x5A17)
    order = np.lexsort((bit, owner))
    owner, bit = owner[order], bit[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bit[1:] != bit[:-1])
    return owner[first], bit[first]


def fold(owner: np.ndarray, bit: np.ndarray, n: int) -> np.ndarray:
    """Counts of 512 segments modulo two, packed to 8 words: distances do not grow by it."""
    counts = np.bincount(owner * 512 + (bit & np.uint64(511)).astype(np.int64), minlength=n * 512)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, 512), axis=1).view(np.int64)


def cells_of(owner: np.ndarray, bit: np.ndarray, size: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(record, cell) of every informative cell of every record, in each of its strata."""
    stratum = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    reaches = size >= p.similar * 2.0 ** (stratum + 1)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for up in (0, 1):
        here = (size > 0) & (reaches if up else True)
        for level in np.unique(stratum[here]) + up:
            grids = max(1, round(2.0 ** int(level) / p.bits))
            rows = np.nonzero(here & (stratum + up == level))[0]
            place = np.full(len(size), -1)
            place[rows] = np.arange(len(rows))
            mine = place[owner] >= 0
            row, b = place[owner[mine]], bit[mine]
            for turn in range(-(-p.cells // grids)):
                h = _mix(b, 1000 + turn)
                used = min(grids, p.cells - turn * grids)
                grid = ((h >> np.uint64(24)) % np.uint64(grids)).astype(np.int64)
                keep = grid < used
                slot = row[keep] * used + grid[keep]
                # equal counts have equal sums of the segments' weights; sums stay exact in doubles
                weight = (_mix(h[keep] % np.uint64(p.width), 77) >> np.uint64(19)).astype(np.float64)
                total = np.bincount(slot, weights=weight, minlength=len(rows) * used)
                count = np.bincount(slot, minlength=len(rows) * used)
                told = np.nonzero((count > 0) & (count >= np.minimum(p.least_bits, np.repeat(size[rows], used) / 3)))[0]
                where = (int(level) << 20) + turn * grids
                out.append((rows[told // used], _mix(_mix(total[told].astype(np.uint64), 11) ^ (where + told % used).astype(np.uint64), 9).view(np.int64)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("skeleton").to_pylist()
        start = chars = 0
        for i, t in enumerate(texts):
            if chars and chars + len(t) > _STRATUM_CHARS:
                yield ids[start:i], texts[start:i]
                start, chars = i, 0
            chars += len(t)
        if start < len(texts):
            yield ids[start:], texts[start:]


def embedded(items: DataFrame, p: Params) -> DataFrame:
    """Items (id, skeleton) with their size, folded embedding and the array of their cells, of which 32 bits are enough to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            owner, bit = fingerprint(texts)
            size = np.bincount(owner, minlength=len(texts))
            words = fold(owner, bit, len(texts))
            row, cell = cells_of(owner, bit, size, p)
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
            columns = [pa.array(ids), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(WORDS)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[order].astype(np.int32)))], names=["id", "size", *WORDS, "cells"])

    return items.mapInArrow(run, "id long, size int, " + ", ".join(f"{w} long" for w in WORDS) + ", cells array<int>")


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])


def _within(p: Params, distance: Column) -> Column:
    """Whether a distance may belong to a pair of the least similarity; sizes are a_size and b_size."""
    return distance <= F.lit((1 - p.doubtful) / (1 + p.doubtful)) * (F.col("a_size") + F.col("b_size"))


def candidates(vectors: DataFrame, p: Params, rounds: int = 1) -> DataFrame:
    """Pairs ``(a_id, b_id)`` that share a cell, within the bounds on sizes and on the Manhattan distance."""
    distance = reduce(add, [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS])

    def met_in(turn: int) -> DataFrame:
        mine = F.filter("cells", lambda c: F.pmod(c, F.lit(rounds)) == turn) if rounds > 1 else F.col("cells")
        cells = vectors.select(F.explode(mine).alias("cell"), "id", "size", *WORDS)
        met = _side(cells, "a").join(_side(cells, "b"), F.col("a_cell") == F.col("b_cell"))
        met = met.filter((F.col("a_id") < F.col("b_id")) & _within(p, F.abs(F.col("a_size") - F.col("b_size"))) & _within(p, distance))
        return materialize(met.select("a_id", "b_id").distinct(), "nd-met")

    return reduce(DataFrame.unionByName, map(met_in, range(rounds))).distinct()


def trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def same_record(a: str, b: str, text_a: str, text_b: str, p: Params) -> bool:
    """The exact test of two different skeletons and the texts they come from."""
    return _judge(trigrams(a), trigrams(b), text_a, text_b, p, a == b)


def _judge(x: set[str], y: set[str], text_a: str, text_b: str, p: Params, equal: bool = False) -> bool:
    shared = len(x & y)
    union = len(x) + len(y) - shared
    score = shared / union if union else float(equal)
    if score >= p.similar:
        return True
    if score < p.doubtful:
        return False
    m, n = Counter(re.findall(r"\d+", text_a)), Counter(re.findall(r"\d+", text_b))
    return bool(m) and sum((m & n).values()) >= 0.75 * max(sum(m.values()), sum(n.values()))


class _Trigrams:
    """Trigram sets of the texts seen last, up to a number of characters."""

    def __init__(self, most: int = _STRATUM_CHARS) -> None:
        self.most, self.held, self.chars = most, {}, 0

    def __call__(self, text: str) -> set[str]:
        found = self.held.get(text)
        if found is None:
            if self.chars > self.most:
                self.held, self.chars = {}, 0
            found = self.held[text] = trigrams(text)
            self.chars += len(text)
        return found


def near_duplicate_classes(df: DataFrame, key: str, text: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members (key, class_id, n_links) with one row a record, links between representatives.

    n_links counts the verified links of the record's representative.
    """
    base = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    bare = F.col("skeleton")
    same = F.unhex(F.md5(F.when(bare == "", F.concat(F.lit(" "), F.col("text"))).otherwise(bare)))
    base = materialize(base.withColumn("skeleton", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")).withColumn("same", same), "nd-base")
    reps = base.groupBy("same").agg(F.min(F.struct("id", "text", "skeleton")).alias("r")).select("same", "r.*")
    reps = materialize(reps, "nd-reps")
    members = materialize(base.select("id", "same"), "nd-keys")
    discard(base)
    items = reps.filter("skeleton <> ''").select("id", "skeleton")
    vectors = materialize(embedded(items.repartition(F.col("id")), p), "nd-vectors")
    near = materialize(candidates(vectors, p, min(ROUNDS, 1 + vectors.count() // ROUND_RECORDS)), "nd-near")
    discard(vectors)
    texts = reps.select("id", "skeleton", "text")

    @F.pandas_udf(T.BooleanType())
    def verify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets = _Trigrams()
        for columns in batches:
            yield pd.Series([_judge(sets(a), sets(b), s, t, p) for a, b, s, t in zip(*columns)], dtype=bool)

    met = near.join(_side(texts, "a"), "a_id").join(_side(texts, "b"), "b_id")
    links = met.filter(verify("a_skeleton", "b_skeleton", "a_text", "b_text")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    links = materialize(links, "nd-links")
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = reps.select("same", F.col("id").alias("node")).join(comp, "node", "left").join(degree, "node", "left")
    classes = classes.select("same", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    members = members.join(classes, "same").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return members.select(F.col("id").alias(key), "class_id", "n_links"), links


def near_duplicate_pairs(df: DataFrame, key: str, text: str, p: Params = Params()) -> DataFrame:
    """All pairs ``(key_a, key_b)``, a < b, of records of one class."""
    members, _ = near_duplicate_classes(df, key, text, p)
    members = materialize(members, "nd-members")
    busy = members.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id")
    grouped = members.join(busy, "class_id", "left_semi")
    a = grouped.select("class_id", F.col(key).alias(f"{key}_a"))
    b = grouped.select("class_id", F.col(key).alias(f"{key}_b"))
    return a.join(b, "class_id").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")

"""MinHash near-duplicates with tensored banding.

Two small collections of half-bands are drawn, A (``a_bands`` of ``a_rows`` minima) and B (``b_bands`` of
``b_rows``).  Every pair (A_i, B_j) is the key of a table, so ``a_bands * b_bands`` tables cost only
``a_bands * a_rows + b_bands * b_rows`` minima: 62 for 140 tables of five rows.  A pair of Jaccard 0.8 shares no key
with probability (1 - 0.8**3)**14 + (1 - 0.8**2)**10 = 8e-5.

Equal shingle sets are one class before anything is paired.  A bucket (texts sharing a key) is then resolved by
pivots: members are compared, on full sets, with the members that share most buckets with others (the originals of
large groups of copies, as a rule); links join components, and only members that have not been compared and are in
different components go to the next round.  So a group of thousands of copies costs a comparison or a few a member
and not all pairs.  What the pivot rounds leave open is compared exactly, family by family (texts connected by the
open buckets): families are cut into blocks by size class and hash, a task counts all intersections of two blocks
by matrix products over their shared shingles, and hands in a spanning forest of the links.  No link in a bucket is
lost.  Buckets are aggregated before the shuffle and joined by sort-merge joins, which adaptive execution splits
when a key is hot.

Defined results: null or empty texts and texts without words have no shingles, link with nothing and stand alone;
repeated rows of equal doc_id count once for linking and come back as often as they came in; if their texts differ, the
document links as the text of least hash does, and with equal texts of any of its rows; rows without doc_id stand alone,
with a null component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, drop, release, signed, written
from .components import merged
from .textkern import SPACED, U64, Words, mix, pieces


@dataclass(frozen=True)
class Banding:
    """words: of a shingle; percent: least 100 * Jaccard of a link; the rest as above."""

    words: int = 5
    percent: int = 80
    a_bands: int = 14
    a_rows: int = 3
    b_bands: int = 10
    b_rows: int = 2
    pivots: tuple[int, ...] = (1, 4)
    block: int = 256
    block_shingles: int = 200_000
    broadcast_ids: int = 1_000_000


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the offsets of the rows (n + 1)."""
    h = w.hash()
    count = np.diff(w.first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(w.first[:-1], made)
    have = np.repeat(np.minimum(count, k), made)
    out = np.zeros(len(row), U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            use = have > j
            out[use] = mix(out[use] + h[at[use] + j], j + 1)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set, by sums."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(sets, 501), begin), np.add.reduceat(mix(sets, 502), begin)


def _signatures(p: Banding):
    n_min = p.a_bands * p.a_rows + p.b_bands * p.b_rows
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(1, 2**62, n_min, dtype=np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 2**63, n_min, dtype=np.uint64)

    def bands(minima: np.ndarray, n: int, rows: int, salt: int) -> np.ndarray:
        out = np.zeros((len(minima), n), U64)
        with np.errstate(over="ignore"):
            for r in range(rows):
                out = mix(out + minima[:, r::rows][:, :n], salt + r)
            return mix(out + np.arange(n, dtype=U64)[None, :], salt + 90)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in pieces(batch.column("text")):
                sets, first = shingles(Words(data, off, SPACED), p.words)
                size = np.diff(first)
                some = np.flatnonzero(size)
                minima = np.zeros((len(some), n_min), U64)
                h1, h2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
                if len(some):
                    begin = first[:-1][some]
                    with np.errstate(over="ignore"):
                        for i in range(n_min):
                            v = sets * mul[i] + add[i]
                            minima[:, i] = np.minimum.reduceat(v ^ (v >> U64(31)), begin)
                    h1[some], h2[some] = _sums(sets, begin)
                cut = p.a_bands * p.a_rows
                side = {
                    "a": (bands(minima[:, :cut], p.a_bands, p.a_rows, 1000), p.a_bands),
                    "b": (bands(minima[:, cut:], p.b_bands, p.b_rows, 2000), p.b_bands),
                }
                ends = np.concatenate([[0], np.cumsum(size > 0)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(signed(h1)), pa.array(signed(h2))]
                    + [
                        pa.ListArray.from_arrays(pa.array(ends * n, pa.int32()), pa.array(signed(x.ravel())))
                        for x, n in side.values()
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "a", "b"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in pieces(batch.column("text")):
                sets, first = shingles(Words(data, off, SPACED), words)
                some = np.flatnonzero(np.diff(first))
                h1, h2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
                if len(some):
                    h1[some], h2[some] = _sums(sets, first[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(signed(h1)), pa.array(signed(h2)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(sets)))],
                    ["id", "h1", "h2", "s"],
                )

    return run


def _verified(sets: DataFrame, pairs: DataFrame, p: Banding) -> DataFrame:
    """The pairs (a, b) that are links, by exact counts over full shingle sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        .where(F.lit(100).cast("long") * F.col("i") >= F.lit(p.percent) * (F.col("t") - F.col("i")))
        .select("a", "b")
    )


def spanning_links(ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between rows of different sides (of any rows, if there is one side only) that join different labels, a
    spanning forest of them."""
    n = len(ids)
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    tokens, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = df[column] > 1
    row, column = row[some], (np.cumsum(df > 1) - 1)[column[some]]
    shared = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for c in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        shared += part @ part.T
    union = size[:, None] + size[None, :] - shared
    link = np.triu(100 * shared.astype(np.float64) >= percent * union, 1) & (labels[:, None] != labels[None, :])
    if sides.min() != sides.max():
        link &= sides[:, None] != sides[None, :]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            up[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def _open_links(live: DataFrame, sets: DataFrame, p: Banding) -> DataFrame:
    """Links (a, b) among the members of open buckets (key, doc_id, n, label), exactly, by blocks."""
    hub = live.groupBy("key").agg(F.min("doc_id").alias("b"))
    family = merged(None, live.join(hub, "key").where("doc_id <> b").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")))
    docs = (
        live.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("label").alias("label"))
        .join(family.select(F.col("id").alias("doc_id"), F.col("label").alias("family")), "doc_id")
        .withColumn("class", F.floor(F.log(100 / p.percent, F.col("n") * 1.0)).cast("int"))
    )
    # sizes of links are within a factor of 100 / percent: one class or two that follow each other
    classes = docs.groupBy("family", "class").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / p.block), F.ceil(F.sum("n") / p.block_shingles)).cast("int").alias("blocks")
    )
    classes = written(classes, "classes")
    for k in (-1, 1):
        docs = docs.join(classes.select("family", (F.col("class") - k).alias("class"), F.col("blocks").alias(f"blocks{k}")), ["family", "class"], "left")
    docs = docs.join(classes, ["family", "class"]).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))

    def up_to(c: str) -> Column:
        return F.sequence(F.lit(0), F.col(c) - 1)

    def task(of: Column, i: Column, j: Column, next_: int, side: Column) -> Column:
        return F.struct(of.alias("class_"), i.cast("int").alias("i_"), j.cast("int").alias("j_"), F.lit(next_).alias("next_"), side.alias("side_"))

    of, i = F.col("class"), F.col("i")
    own = F.transform(up_to("blocks"), lambda j: task(of, F.least(i, j), F.greatest(i, j), 0, (i > j).cast("int")))
    below = F.transform(up_to("blocks1"), lambda j: task(of, i, j, 1, F.lit(0)))
    above = F.transform(up_to("blocks-1"), lambda j: task(of - 1, j, i, 1, F.lit(1)))
    none = F.array().cast("array<struct<class_:int,i_:int,j_:int,next_:int,side_:int>>")
    spread = docs.select("doc_id", "label", "family", F.explode(F.concat(own, F.coalesce(below, none), F.coalesce(above, none))).alias("t"))
    rows = spread.join(sets, F.col("doc_id") == F.col("id")).select("doc_id", "label", "family", "t.*", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = pdf["side_"].to_numpy()
        if pdf["i_"].iloc[0] == pdf["j_"].iloc[0] and not pdf["next_"].iloc[0]:
            sides = np.zeros(len(pdf), int)
        elif sides.min() == sides.max():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        found = spanning_links(pdf["doc_id"].to_numpy(), pdf["label"].to_numpy(), sides, list(pdf["s"]), p.percent)
        return pd.DataFrame(found or np.zeros((0, 2), np.int64), columns=["a", "b"])

    return rows.groupBy("family", "class_", "i_", "j_", "next_").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    p, spark = banding, docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(
        docs.transform(arrow, _signatures(p), "doc_id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>"), "signatures"
    )
    classes = written(
        sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes"
    )
    reps = sig.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "a", "b"), F.struct("h1", "h2")).alias("v_")).select("doc_id", "v_.*")
    # a row becomes more than a hundred: as many tasks as any shuffle has
    reps = reps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id", F.lit(9)))
    keys = (
        reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("a").alias("ka"), "b")
        .select("doc_id", "n", "ka", F.explode("b").alias("kb"))
        .select(F.xxhash64("ka", "kb").alias("key"), "doc_id", "n")
    )
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = written(keys.join(shared, "key"), "buckets")
    release(spark)
    # a bucket whose members equal those of another bucket is compared once
    once = (
        members.groupBy("key")
        .agg(F.bit_xor(F.xxhash64("doc_id")).alias("u"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("v"), F.count(F.lit(1)).alias("c"))
        .groupBy("u", "v", "c")
        .agg(F.min("key").alias("key"))
    )
    live = written(members.join(once.select("key"), "key", "left_semi"), "live")
    drop(members)
    near = F.lit(100) * F.least("n", "n2") >= F.lit(p.percent) * F.greatest("n", "n2")
    ids = written(live.select("doc_id").distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= p.broadcast_ids else ids
    sets = docs.join(wanted, "doc_id", "left_semi").transform(arrow, _sets(p.words), "id long, h1 long, h2 long, s array<long>")
    # of a document's texts the one that its signature is of
    sets = written(sets.where(F.size("s") > 0).groupBy("id").agg(F.min_by("s", F.struct("h1", "h2")).alias("s")), "sets")
    # the texts that share most buckets are compared first
    size = live.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    score = live.join(size, "key").groupBy("doc_id").agg(F.sum("c").alias("score"))
    live = written(live.join(score, "doc_id").withColumn("label", F.col("doc_id")), "scored")
    labels: DataFrame | None = None
    for n_pivots in p.pivots:
        if live.isEmpty():
            break
        order = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
        pivot = (
            live.withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= n_pivots)
            .select("key", F.col("doc_id").alias("doc2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
        )
        pairs = live.join(pivot, "key").where("doc_id <> doc2 AND label <> label2").where(near)
        pairs = written(pairs.select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b")).distinct(), "pairs")
        labels = merged(labels, written(_verified(sets, pairs, p), "links"))
        drop(pairs)
        # pivots have met their whole bucket; the others go on where a bucket still spans components
        rest = (
            live.drop("label")
            .join(pivot.select("key", F.col("doc2").alias("doc_id")), ["key", "doc_id"], "left_anti")
            .join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
            .withColumn("label", F.coalesce("label", "doc_id"))
        )
        rest = written(rest, "rest")
        spans = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        live = written(rest.join(spans, "key", "left_semi"), "live")
        drop(rest)
    if not live.isEmpty():
        labels = merged(labels, written(_open_links(live, sets, p), "links"))
    drop(sets)
    reps_of = classes
    if labels is not None:
        reps_of = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
            "h1", "h2", F.coalesce("label", "rep").alias("rep")
        )
    found = sig.select("doc_id", "n_shingles", "h1", "h2").join(reps_of, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))

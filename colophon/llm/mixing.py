"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share the sum of all sizes; a target
above ``most`` times its source stops there and the excess is shared again by weight.

Quotas: a source's documents are dealt into BLOCKS blocks by hash, and its blocks are permuted.  Its quota is a number
of draws from that permutation, round after round: as many as fit its target in words, and a few more, the window,
that are drawn in part.  The window is the blocks from the first one that no longer fits on, as many as hold ``few``
documents (if the permutation ends before, those ahead of it are taken in); where it holds more than ``pack``, its
documents are dealt into blocks again, level by level.  Of the last window's documents those are drawn whose sum is
nearest to what the target still lacks: in permuted order whatever fits, and of the EXACT smallest the best subset of
all; with that, one of the larger documents may go, come, or give its place to another, whichever leaves the least
distance.  The rule is one for all sizes; the distance to the target is at most half the largest of those smallest
documents, or where they cannot reach, less than the smallest document left out.

Splitting: a binary tree over the output shards splits the vector of quotas exactly: the left half of the shards draws
its capacity from the quotas without replacement (a multivariate hypergeometric draw), the right half keeps the rest,
down to single shards.  Every shard then draws its numbers of blocks from each source's permutation where the shard
before it stopped, so shards hold disjoint draws.  What a document gives is what the shards have drawn of it:
``taken`` is its size times the draws that hold it.  Rows are shuffled inside a shard by hash.

The plan is a few small arrays a source (sources are taken to be a dimension of configuration size: BLOCKS numbers a
source and level pass through the driver) and the window's documents; rows find their draws by one broadcast join, and
texts move once, to their shards.

Defined results: null texts have size 0; sources of size 0 have target 0 and give nothing; rows that repeat a doc_id
in a source share its draws and count each; documents without words take part with size 0; null ids and sources are
values like others; an empty table gives an empty result; extra columns are ignored by ``mixture`` and kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, written

BLOCKS = 256
#: Documents that are tried in all combinations.
EXACT = 16
_LEVELS = 8


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    most: int = 3
    shards: int = 16
    seed: int = 11
    few: int = 64
    pack: int = 5000


def targets(sizes: list[int], weights: tuple[float, ...], most: int) -> list[float]:
    """Targets of sources in order, as above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, live = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while live:
        total = sum(w[i] for i in live)
        over = [i for i in live if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in live:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        live = [i for i in live if i not in set(over)]
    return out


def split_quotas(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Units of each source in each shard (sources x shards), by the splitting tree."""
    out = np.zeros((len(units), shards), np.int64)

    def share(total: int, first: int, last: int) -> int:
        """What shards [first, last) hold of all units."""
        return total * last // shards - total * first // shards

    def part(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle = (first + last) // 2
        take = share(int(units.sum()), first, middle)
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts
        part(left, first, middle)
        part(counts - left, middle, last)

    part(units.astype(np.int64), 0, shards)
    return out


class Subsets:
    """All sums of a few sizes, and the subset of each."""

    def __init__(self, sizes: np.ndarray):
        sums = np.zeros(1, np.int64)
        for v in sizes:
            sums = np.concatenate([sums, sums + v])
        self.count, self.order = len(sizes), np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, rest: np.ndarray) -> np.ndarray:
        """Places of the sums nearest to each of ``rest``, of two as near the smaller one."""
        high = np.clip(np.searchsorted(self.sums, rest), 0, len(self.sums) - 1)
        low = np.maximum(high - 1, 0)
        return np.where(np.abs(rest - self.sums[low]) <= np.abs(rest - self.sums[high]), low, high)

    def subset(self, place: int) -> np.ndarray:
        return np.array([self.order[place] >> j & 1 for j in range(self.count)], bool)


def nearest_subset(sizes: np.ndarray, rest: float) -> np.ndarray:
    """The subset whose sum is nearest to ``rest`` (the smaller sum of two as near), among all."""
    every = Subsets(sizes)
    return every.subset(int(every.nearest(np.array([rest]))[0]))


def nearest_documents(sizes: np.ndarray, rest: float) -> np.ndarray:
    """Which of the documents, given in permuted order, are drawn for ``rest`` words, by the rule above."""
    chosen = np.zeros(len(sizes), bool)
    some = np.flatnonzero(sizes > 0)
    small = some[np.argsort(sizes[some], kind="stable")[:EXACT]]
    others = np.setdiff1d(some, small)
    for i in others:
        if sizes[i] <= rest:
            chosen[i] = True
            rest -= int(sizes[i])
    every = Subsets(sizes[small])
    inside, outside = others[chosen[others]], others[~chosen[others]]
    # what can go (nothing or a document) against what can come
    leave, enter = np.append(0, sizes[inside]), np.append(0, sizes[outside])
    best = (np.inf, 0, 0, 0)
    for i, gone in enumerate(leave):
        lacks = rest + gone - enter
        place = every.nearest(lacks)
        gap = np.abs(lacks - every.sums[place])
        j = int(gap.argmin())
        if gap[j] < best[0]:
            best = (float(gap[j]), i, j, int(place[j]))
        if best[0] <= 0.5:  # sums are whole numbers
            break
    if best[1]:
        chosen[inside[best[1] - 1]] = False
    if best[2]:
        chosen[outside[best[2] - 1]] = True
    chosen[small] = every.subset(best[3])
    return chosen


@dataclass
class Level:
    """The permutation of a source's blocks: rank of each (-1: empty), ranks drawn in full, ranks drawn in part."""

    rank: list[int]
    full: int
    part: int
    rest: float
    documents: int

    @staticmethod
    def of(words: np.ndarray, docs: np.ndarray, rest: float, few: int, rng: np.random.Generator) -> Level:
        order = rng.permutation(BLOCKS)
        order = order[docs[order] > 0]
        rank = np.full(BLOCKS, -1)
        rank[order] = np.arange(len(order))
        if rest <= 0:
            return Level(rank.tolist(), 0, 0, 0.0, 0)
        reach = np.cumsum(words[order])
        full = int(np.searchsorted(reach, rest, side="right"))
        stop = full
        while stop < len(order) and docs[order[full:stop]].sum() < few:
            stop += 1
        while full and docs[order[full:stop]].sum() < few:
            full -= 1
        return Level(rank.tolist(), full, stop - full, rest - float(words[order[:full]].sum()), int(docs[order[full:stop]].sum()))


def _block(level: int, mix: Mix) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(mix.seed + level)), F.lit(BLOCKS)).cast("int")


@dataclass
class Plan:
    """sources: a row a source with its arrays; window: (sk__, doc_id) of the documents drawn in part."""

    sources: DataFrame
    window: DataFrame
    levels: int
    small: bool


def _plan(sized: DataFrame, mix: Mix) -> Plan:
    spark = sized.sparkSession
    kind = sized.schema["doc_id"].dataType

    def counted(rows: DataFrame, by: str, level: int) -> dict:
        """Words and documents of the blocks of every source."""
        out: dict = {}
        for r in rows.groupBy(by, _block(level, mix).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect():
            words, docs = out.setdefault(r[0], (np.zeros(BLOCKS, np.int64), np.zeros(BLOCKS, np.int64)))
            words[r.b], docs[r.b] = r.s, r.n
        return out

    first = counted(sized, "source", 1)
    names = sorted(first, key=lambda x: (x is None, x or ""))
    sizes = [int(first[x][0].sum()) for x in names]
    goal = targets(sizes, mix.weights, mix.most)
    whole = [min(mix.most, int(t // s)) if s else 0 for s, t in zip(sizes, goal, strict=True)]
    lacks = [t - w * s for s, t, w in zip(sizes, goal, whole, strict=True)]
    rng = np.random.Generator(np.random.PCG64(mix.seed))
    levels = [[Level.of(*first[x], rest, mix.few, rng)] for x, rest in zip(names, lacks, strict=True)]
    rounds = [max(own[0].rank) + 1 for own in levels]
    quotas = np.array([w * n + own[0].full + own[0].part for w, n, own in zip(whole, rounds, levels, strict=True)], np.int64)
    shares = np.cumsum(split_quotas(quotas, mix.shards, rng), axis=1)

    one = T.StructType([T.StructField("rank", T.ArrayType(T.IntegerType())), T.StructField("full", T.IntegerType()), T.StructField("part", T.IntegerType())])
    schema = T.StructType(
        [
            T.StructField("sk__", T.IntegerType()), T.StructField("source__", T.StringType()), T.StructField("source_size__", T.LongType()),
            T.StructField("target__", T.DoubleType()), T.StructField("whole__", T.IntegerType()), T.StructField("round__", T.IntegerType()),
            T.StructField("rest__", T.DoubleType()), T.StructField("shares__", T.ArrayType(T.LongType())), T.StructField("levels__", T.ArrayType(one)),
        ]
    )

    def table() -> DataFrame:
        rows = [
            (i, x, sizes[i], goal[i], whole[i], rounds[i], levels[i][-1].rest, shares[i].tolist(), [(v.rank, v.full, v.part) for v in levels[i]])
            for i, x in enumerate(names)
        ]
        return spark.createDataFrame(rows, schema)

    small = len(names) * (BLOCKS + mix.shards) <= 4_000_000
    while True:
        plan = Plan(table(), spark.createDataFrame([], T.StructType([T.StructField("sk__", T.IntegerType()), T.StructField("doc_id", kind)])), max(map(len, levels), default=0), small)
        large = [i for i, own in enumerate(levels) if own[-1].documents > mix.pack and len(own) < _LEVELS]
        if not large:
            break
        inside = _with_sources(sized, plan).where(_state(plan.levels, mix).isNull() & F.col("sk__").isin(large))
        for i, (words, docs) in counted(inside, "sk__", plan.levels + 1).items():
            levels[i].append(Level.of(words, docs, levels[i][-1].rest, mix.few, rng))
        for i in large:
            if len(levels[i]) == plan.levels:  # no rows: cannot be, its window held documents
                raise AssertionError("a window without documents")
    inside = _with_sources(sized, plan).where(_state(plan.levels, mix).isNull())
    inside = inside.groupBy("sk__", "doc_id").agg(F.sum("size").alias("size"), F.first("rest__").alias("rest__"))
    inside = inside.withColumn("u__", F.xxhash64("doc_id", F.lit(mix.seed)))

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u__", "doc_id"], kind="stable")
        return pdf[nearest_documents(pdf["size"].to_numpy(np.int64), float(pdf["rest__"].iloc[0]))][["sk__", "doc_id"]]

    plan.window = written(inside.groupBy("sk__").applyInPandas(drawn, plan.window.schema), "window")
    return plan


def _with_sources(rows: DataFrame, plan: Plan) -> DataFrame:
    sources = F.broadcast(plan.sources) if plan.small else plan.sources
    return rows.join(sources, F.col("source").eqNullSafe(F.col("source__"))).drop("source__")


def _state(levels: int, mix: Mix) -> Column:
    """Whether a document is drawn in the last round: true, false, or null if the window decides."""
    out: Column = F.lit(None).cast("boolean")
    for i in range(levels, 0, -1):
        level = F.get("levels__", F.lit(i - 1))
        rank = F.get(level["rank"], _block(i, mix))
        # a source without this level goes to its window
        out = F.when(rank < level["full"], True).when(rank >= level["full"] + level["part"], False).otherwise(out)
    return out


def _draws(rows: DataFrame, plan: Plan, mix: Mix) -> DataFrame:
    """``rows`` (doc_id, source, ...) with source_size__, target__ and shards__: the shard of every draw that holds the row."""
    window = plan.window.select(F.col("sk__").alias("wk__"), F.col("doc_id").alias("wd__"))
    window = F.broadcast(window) if plan.window.count() <= 1_000_000 else window
    found = _with_sources(rows, plan).join(window, (F.col("sk__") == F.col("wk__")) & F.col("doc_id").eqNullSafe(F.col("wd__")), "left")
    last = F.coalesce(_state(plan.levels, mix), F.col("wk__").isNotNull())
    rank = F.get(F.get("levels__", F.lit(0))["rank"], _block(1, mix))
    rounds = F.when(F.col("whole__") > 0, F.sequence(F.lit(0), F.greatest(F.col("whole__") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rounds = F.concat(rounds, F.when(last, F.array("whole__")).otherwise(F.array().cast("array<int>")))
    places = F.transform(rounds, lambda c: c * F.col("round__") + rank)
    # a shard draws the places from where the one before it stopped; beyond the last quota nothing is drawn
    shards = F.transform(F.filter(places, lambda x: x < F.element_at("shares__", -1)), lambda x: F.size(F.filter("shares__", lambda s: s <= x)))
    keep = [c for c in rows.columns]
    return found.select(*keep, "source_size__", "target__", shards.alias("shards__"))


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, shards) of every row; shards has one a copy."""
    sized = written(docs.select("doc_id", "source", _size().alias("size")), "sizes")
    copies = F.size("shards__")
    return _draws(sized, _plan(sized, mix), mix).select(
        "doc_id", "source", "size", F.col("source_size__").alias("source_size"), F.col("target__").alias("target"),
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.col("shards__").alias("shards"),
    )


#: Columns of the mix, which replace a table's own of the same names.
MIX_COLUMNS = ("size", "source_size", "target", "taken", "copy", "shard", "place")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy taken, with ``size``, ``source_size``, ``target``, ``taken`` (of
    the row, all copies), ``copy``, ``shard`` and ``place`` (the order in a shard), laid out by shard and shuffled inside
    it.  These replace columns of the same names."""
    sized = written(docs.select("doc_id", "source", _size().alias("size")), "sizes")
    own = docs.select(*(c for c in docs.columns if c.lower() not in MIX_COLUMNS))
    # the table's columns travel as one, so that none meets a name of the plan's
    packed = own.select("doc_id", "source", F.struct("*").alias("own__"), _size().alias("size"))
    rows = _draws(packed, _plan(sized, mix), mix).where(F.size("shards__") > 0)
    rows = rows.select(
        "own__.*", "size", F.col("source_size__").alias("source_size"), F.col("target__").alias("target"),
        (F.size("shards__") * F.col("size")).cast("long").alias("taken"), F.posexplode("shards__").alias("copy", "shard"),
    ).withColumn("place", F.xxhash64("doc_id", "copy", F.lit(mix.seed + 200)))
    # a shard is laid out in up to 256 runs of places, so that its size does not bound a task's
    return rows.repartition("shard", F.shiftright("place", 56)).sortWithinPartitions("shard", "place")

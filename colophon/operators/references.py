"""From page text to reference lists: line predicates, page scores, islands, segmentation, duplicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import most_blocks, reaches, reference_id
from .stages import settled, stored


def lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 0, line) of every line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def boilerplate(c: Column, patterns: list[str], most: int = 120) -> Column:
    """Short lines that one of the patterns hits."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(f"(?i){p}")
    return hit & (F.length(c) <= most)


def page_scores(pages: DataFrame, key: list[str], text: Column, is_reference: Column) -> DataFrame:
    """Reference lines and non-empty lines of every page; ``is_reference`` judges the column ``line``."""
    one = pages.select(*key, F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line"))
    return one.groupBy(*key).agg(
        F.count_if((F.col("line") != "") & is_reference).alias("reference_lines"), F.count_if(F.col("line") != "").alias("lines")
    )


def islands(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, first, last, n) of runs of consecutive places."""
    order = Window.partitionBy(key).orderBy(place)
    run = rows.select(key, place).distinct().withColumn("run_", F.col(place) - F.row_number().over(order))
    return run.groupBy(key, "run_").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).drop("run_")


def segments(rows: DataFrame, key: str, order: str, starts: Column, text: str) -> DataFrame:
    """(key, segment from 1, text): lines joined from one start to the next."""
    window = Window.partitionBy(key).orderBy(order)
    number = rows.withColumn("segment", F.sum(starts.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    number = number.withColumn("segment", F.greatest("segment", F.lit(1)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return number.groupBy(key, "segment").agg(joined.alias("text"))


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n characters, by doubling; runs that reach past the end are missing."""
    mul, h, have, out, done = np.uint64(0x9E3779B97F4A7C15), codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & have:
            if out is None:
                out = h
            else:
                m = min(len(out), len(h) - done)
                out = (out[: max(m, 0)] ^ (out[: max(m, 0)] >> np.uint64(29))) * mul + h[done : done + max(m, 0)]
            done += have
        if done == n:
            return (out ^ (out >> np.uint64(32))) * mul
        m = max(len(h) - have, 0)
        h = (h[:m] ^ (h[:m] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[have : have + m]
        have *= 2


def _size_class(n: int) -> int:
    return (n + 1).bit_length() - 2


def run_keys(texts: list[str], share: float) -> list[list[tuple[int, bool]]]:
    """For each text (key, own): the runs that a text inside it would be found by, and whether it is found by them itself.

    A text of class c has at least 2^(c+1) - 1 characters.  In each window of that length the run of 2^c characters with
    the smallest hash is a key.  What holds a text holds its windows, so all its own keys.  A text holds texts of at most
    two classes, as they have ``share`` of its length.
    """
    out: list[list[tuple[int, bool]]] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    jobs: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        for c in range(_size_class(math.floor(n * share)), _size_class(n) + 1):
            jobs.setdefault(c, []).append(i)
    for c, members in jobs.items():
        if c < 0:  # the empty text is in all that are short enough
            for i in members:
                out[i].append((0, sizes[i] == 0))
            continue
        k = 1 << c
        codes = np.frombuffer("".join(texts[i] for i in members).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([sizes[i] for i in members])
        low = h = _hashed(codes, k)
        step = 1
        while step < k:  # the smallest hash of k runs in a row, by doubling
            low = np.minimum(low[: max(len(low) - step, 0)], low[step:])
            step *= 2
        owner = np.repeat(np.arange(len(members)), lens)[: len(low)]
        end = np.cumsum(lens)[owner] if len(low) else owner
        fit = np.arange(len(low)) + 2 * k - 1 <= end
        low, owner = low[fit], owner[fit]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        for o, key in dict.fromkeys(zip(owner[new].tolist(), low[new].view(np.int64).tolist(), strict=True)):
            out[members[o]].append((key ^ c, _size_class(sizes[members[o]]) == c))
    return out


def contained_pairs(rows: DataFrame, block: list[str], id_: str, norm: str, share: float = 0.72) -> DataFrame:
    """(a, b), a < b, of the different texts of a block of which one holds the other and is not much longer.

    ``rows`` has each text of a block once.  A text is looked up by the rarest of its keys (``run_keys``), so texts
    without such a partner are left before any text is compared.
    """

    @F.pandas_udf("struct<keys: array<bigint>, own: array<bigint>>")
    def keyed(texts: pd.Series) -> pd.DataFrame:
        got = run_keys(texts.tolist(), share)
        return pd.DataFrame({"keys": [[k for k, _ in g] for g in got], "own": [[k for k, o in g if o] for g in got]})

    texts = rows.select(F.col(id_).alias("id"), F.xxhash64(*block).alias("block"), F.col(norm).alias("norm"), F.length(norm).alias("size"))
    keys = settled(texts.withColumn("keyed", keyed("norm")).select("id", "block", "size", "keyed.*"))
    key = F.xxhash64("block", "k").alias("k")
    every = keys.select("id", "block", "size", F.explode("keys").alias("k")).select("id", "size", key)
    own = keys.select("id", "block", "size", F.size("own").alias("m"), F.explode("own").alias("k")).select("id", "size", "m", key)
    often = settled(every.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a key of its own that no other text has says that no other holds the text
    found = own.join(often, "k").groupBy("id").agg(F.min_by("k", "n").alias("k"), F.count(F.lit(1)).alias("c"), F.first("m").alias("m"), F.first("size").alias("size")).where("c = m")
    met = found.select("k", F.col("id").alias("y"), F.col("size").alias("sy")).join(every.select("k", F.col("id").alias("x"), F.col("size").alias("sx")), "k")
    met = met.where((F.col("x") != F.col("y")) & (F.col("sy") <= F.col("sx")) & (F.col("sy") >= F.floor(F.col("sx") * share))).select("x", "y")
    met = settled(met)
    used = met.select(F.col("x").alias("id")).unionByName(met.select(F.col("y").alias("id"))).distinct()
    used = stored(texts.join(used, "id", "left_semi").select("id", "block", "norm"))
    left, right = (used.select(F.col("id").alias(k), F.col("block").alias(f"b{k}"), F.col("norm").alias(f"n{k}")) for k in "xy")
    sure = met.join(left, "x").join(right, "y").where((F.col("bx") == F.col("by")) & F.col("nx").contains(F.col("ny")))
    return sure.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_references(rows: DataFrame, block: list[str], id_: str, norm: str, share: float = 0.72) -> DataFrame:
    """Pairs (a, b) inside a block whose different texts contain one another at nearly the same length.  Equal texts meet
    once: a pair links the smallest ids of two different texts."""
    same = stored(rows.groupBy(*block, norm).agg(F.min(id_).alias(id_)))
    return contained_pairs(same, block, id_, norm, share)


def links_within(ids: list, texts: list[str], sides: list[int], least: float) -> list[tuple]:
    """Pairs that join the texts that reach the ratio into the components which all such pairs make; of two cells
    (``sides`` 0 and 1) only texts of different ones are paired, of one cell all.

    Counts of runs of two, three and five characters rule pairs out many at a time; the rest is asked in turn, but for texts
    that other pairs have joined.
    """
    order = sorted(range(len(ids)), key=lambda i: len(texts[i]))
    ids, texts, side = np.array([ids[i] for i in order]), [texts[i] for i in order], np.array([sides[i] for i in order])
    size = np.array([len(t) for t in texts])
    blocks = np.array([most_blocks(t) for t in texts])
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    two, three, five = np.empty((len(ids), 256), np.int32), np.empty((len(ids), 2048), np.uint8), np.empty((len(ids), 8192), np.uint8)
    for i, c in enumerate(codes):
        two[i] = np.bincount(((c[:-1] * 0x9E3779B1 + c[1:] * 0x85EBCA77) >> np.uint64(9)).astype(np.int64) % 256, minlength=256)
        three[i] = np.minimum(np.bincount(((c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D) >> np.uint64(7)).astype(np.int64) % 2048, minlength=2048), 255)
        five[i] = np.minimum(np.bincount((_hashed(c, 5) >> np.uint64(40)).astype(np.int64) % 8192, minlength=8192), 255)
    both, up, out, counts = bool(side.any()), list(range(len(ids))), [], {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        end = np.searchsorted(size, size[i] * (2 - least) / least + 1e-6, "right")
        for begin in range(i + 1, int(end), 1024):
            js = np.arange(begin, min(begin + 1024, int(end)))
            if both:
                js = js[side[js] != side[i]]
            for q, grams in ((2, two), (3, three), (5, five)):
                if len(js):
                    apart = np.abs(grams[js].astype(np.int32 if q == 2 else np.int16) - grams[i]).sum(1, dtype=np.int64)
                    total = size[js] + size[i]
                    need = np.ceil(least * total / 2 - 1e-6)
                    k = np.minimum(np.where(ids[js] > ids[i], blocks[js], blocks[i]), total - 2 * need + 1)
                    # matching blocks keep all their runs but q - 1 each
                    js = js[apart <= total - 2 * (need - k * (q - 1))]
            for j in js.tolist():
                x, y = root(i), root(j)
                if x != y:
                    a, b = (i, j) if ids[i] < ids[j] else (j, i)
                    if reaches(texts[a], texts[b], least, counts):
                        up[y] = x
                        out.append((ids[a].item(), ids[b].item()))
            if len(counts) > 500:
                counts.clear()
    return out


def ratio_links(rows: DataFrame, block: list[str], id_: str, norm: str, least: float = 0.93, most: int = 2000, most_size: int = 16_000_000) -> DataFrame:
    """Pairs (a, b), a < b, of texts of a block that reach the ratio: not all, but enough for the same components.

    ``rows`` has each text of a block once.  A block of more than ``most`` texts or ``most_size`` characters is cut into
    classes by length, of which only neighbours can meet, and classes into cells; two cells at a time are one group.
    """
    width = math.log((2 - least) / least) + 1e-6
    texts = rows.select(F.col(id_).alias("id"), F.xxhash64(*block).alias("block"), F.length(norm).alias("size"))
    cells = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("size") / most_size)).cast("int")
    whole = texts.groupBy("block").agg(F.count(F.lit(1)).alias("c"), cells().alias("cells")).where("c > 1")
    texts = settled(texts.join(whole, "block").withColumn("class", F.when(F.col("cells") == 1, 0).otherwise(F.floor(F.log(F.greatest("size", F.lit(1))) / width).cast("int"))))
    classes = texts.groupBy("block", "class").agg(cells().alias("own"))
    after = classes.select("block", (F.col("class") - 1).alias("class"), F.col("own").alias("next"))
    before = classes.select("block", (F.col("class") + 1).alias("class"), F.col("own").alias("last"))
    classes = classes.join(after, ["block", "class"], "left").join(before, ["block", "class"], "left").fillna(0, ["next", "last"])
    cell = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    placed = texts.select("block", "class", "id").join(classes, ["block", "class"]).withColumn("cell", cell)
    at = lambda kind, i, j, side: F.struct(kind.alias("class"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    here, me = F.col("class") * 2, F.col("cell")
    same = F.transform(upto("own"), lambda o: F.when(o < me, at(here, o, me, 1)).otherwise(at(here, me, o, 0)))
    later = F.transform(upto("next"), lambda o: at(here + 1, me, o, 0))
    earlier = F.transform(upto("last"), lambda o: at(here - 1, o, me, 1))
    groups = placed.select("block", "id", F.concat(same, later, earlier).alias("g")).join(rows.select(F.col(id_).alias("id"), F.col(norm).alias("norm")), "id")
    dealt = groups.select("block", "id", "norm", F.explode("g").alias("g")).select("block", "id", "norm", "g.*")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        one_cell = group["class"].iloc[0] % 2 == 0 and group["i"].iloc[0] == group["j"].iloc[0]
        found = links_within(group["id"].tolist(), group["norm"].tolist(), group["side"].tolist(), least) if one_cell or group["side"].nunique() > 1 else []
        return pd.DataFrame(found, columns=["a", "b"])

    kind = rows.schema[id_].dataType.simpleString()
    return dealt.groupBy("block", "class", "i", "j").applyInPandas(links, f"a {kind}, b {kind}")


def similar_components(rows: DataFrame, block: list[str], id_: str, norm: str, least: float = 0.93, share: float = 0.72) -> DataFrame:
    """(id, component) with the smallest id of the texts that are linked: in one block, and one contains the other at nearly
    the same length or both reach the ratio.  ``rows`` has each text of a block once."""
    links = contained_pairs(rows, block, id_, norm, share).unionByName(ratio_links(rows, block, id_, norm, least))
    return block_components(settled(links), rows, id_)


def block_components(pairs: DataFrame, nodes: DataFrame, id_: str) -> DataFrame:
    """(id, component) with the smallest id of each component; an iterative smallest-label join over pair links.

    Every round is settled before the next."""
    labels = nodes.select(F.col(id_).alias("id"), F.col(id_).alias("component"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        nxt = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        nxt = settled(nxt)
        labels = nxt.select("id", F.col("low").alias("component"))
        if nxt.where("low < component").isEmpty():
            return labels


def canonical(rows: DataFrame, component: str, text: str, norm: str, origin: str) -> DataFrame:
    """One row a component: the longest text (then the smallest), its id, and the sorted distinct origins."""
    return rows.groupBy(component).agg(
        F.min_by(F.struct(text, norm), F.struct(-F.length(text), F.col(text))).alias("c_"), F.array_sort(F.collect_set(origin)).alias("origins")
    ).select(reference_id(F.col(f"c_.{norm}")).alias("reference_id"), F.col(f"c_.{text}").alias("reference_text"), F.size("origins").alias("n_origins"), F.array_join("origins", " | ").alias("origins"))

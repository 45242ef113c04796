"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard.

Equal vectors are one point that carries its smallest ids (one more than asked for, which is all that can be among
the nearest), so a vector with thousands of copies neither breaks the graph nor fills a task.  Points are dealt to
shards of about ``shard`` points by hash.  A graph is a set of flat neighbour arrays, one for each level; levels are
built from the top down, each entered through the one above, and points are inserted in batches: a batch is searched
together (a beam search over all its points at once), linked to a diverse choice of what it found and of its own
members, and linked back.  Graphs are written to the shared folder; every block of queries meets every shard, and
the shards' results are merged by a window.

Scores are computed from the original vectors in double precision.  Defined results: vectors that are null, empty,
zero or hold null or non-finite components take no part, as candidate or query; vectors of different lengths never
meet; ties go to the smaller id; a query with fewer candidates gets all of them; repeated rows count once; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


@dataclass(frozen=True)
class Graph:
    links: int = 16
    build_beam: int = 64
    search_beam: int = 256
    shard: int = 8192
    block: int = 2048


def beam(vec: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` points for each query (ids, -1 if fewer; similarities), best first; the ``wide`` best open points
    of every query are opened together."""
    n_q, n = len(q), len(vec)
    seen = np.zeros((n_q, n), bool)
    ids, sims, open_ = np.full((n_q, ef), -1, np.int64), np.full((n_q, ef), -np.inf, np.float32), np.zeros((n_q, ef), bool)
    fresh_row, fresh = np.nonzero(entry >= 0)
    fresh = entry[fresh_row, fresh]
    key = np.unique(fresh_row * n + fresh)
    live = np.arange(n_q)
    while len(live):
        if len(key):
            row, to = key // n, key % n
            seen[row, to] = True
            got = np.einsum("ij,ij->i", q[row], vec[to])
            touched, begin, count = np.unique(row, return_index=True, return_counts=True)
            width = int(count.max())
            place = np.arange(len(row)) - np.repeat(begin, count)
            new_ids, new_sims = np.full((len(touched), width), -1, np.int64), np.full((len(touched), width), -np.inf, np.float32)
            at = np.repeat(np.arange(len(touched)), count)
            new_ids[at, place], new_sims[at, place] = to, got
            all_ids, all_sims = np.concatenate([ids[touched], new_ids], axis=1), np.concatenate([sims[touched], new_sims], axis=1)
            all_open = np.concatenate([open_[touched], new_ids >= 0], axis=1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[touched], sims[touched] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            open_[touched] = np.take_along_axis(all_open, top, 1)
        live = live[open_[live].any(axis=1)]
        if not len(live):
            break
        score = np.where(open_[live], sims[live], -np.inf)
        k = min(wide, ef)
        pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
        ok = np.isfinite(np.take_along_axis(score, pick, 1))
        open_[live[:, None], pick] = False
        row, col = np.nonzero(ok)
        out = nbr[ids[live[row], pick[row, col]]]
        row = np.repeat(live[row], out.shape[1])
        out = out.ravel()
        good = out >= 0
        row, out = row[good], out[good].astype(np.int64)
        good = ~seen[row, out]
        key = np.unique(row[good] * n + out[good])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(vec: np.ndarray, cand: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Up to ``links`` of each row's candidates (best first): those closer to the row than to any taken one, then the
    best of the rest."""
    n, c = cand.shape
    v = vec[np.maximum(cand, 0)]
    between = np.einsum("nad,nbd->nab", v, v)
    taken, blocked, count = np.zeros((n, c), bool), np.full((n, c), -np.inf, np.float32), np.zeros(n, np.int64)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (count < links) & (sims[:, j] > blocked[:, j])
        taken[:, j] = ok
        count += ok
        blocked = np.where(ok[:, None], np.maximum(blocked, between[:, j, :]), blocked)
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < links:
        out = np.concatenate([out, np.full((n, links - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def _link_back(vec: np.ndarray, nbr: np.ndarray, src: np.ndarray, chosen: np.ndarray) -> None:
    """Adds src to the lists of chosen; a full list keeps a diverse choice."""
    row, col = np.nonzero(chosen >= 0)
    to, frm = chosen[row, col], src[row]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    who, begin, count = np.unique(to, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    extra = np.full((len(who), width), -1, np.int64)
    extra[np.repeat(np.arange(len(who)), count), np.arange(len(to)) - np.repeat(begin, count)] = frm
    most = nbr.shape[1]
    for s in range(0, len(who), 512):
        w = who[s : s + 512]
        cand = np.concatenate([nbr[w].astype(np.int64), extra[s : s + 512]], axis=1)
        sims = np.where(cand >= 0, np.einsum("nd,ncd->nc", vec[w], vec[np.maximum(cand, 0)]), -np.inf).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        cand = np.where(np.isfinite(sims), cand, -1)
        full = (cand >= 0).sum(axis=1) > most
        nbr[w[~full]] = cand[~full][:, :most]
        if full.any():
            keep = min(cand.shape[1], most + 16)
            nbr[w[full]] = diverse(vec, cand[full][:, :keep], sims[full][:, :keep], most)


def build(vec: np.ndarray, g: Graph, seed: int = 1) -> list[np.ndarray]:
    """Neighbour arrays (n x links, -1 for none) from the bottom level up; a point above the bottom has a row only in
    the levels it reaches, others hold -1."""
    n = len(vec)
    rng = np.random.Generator(np.random.PCG64(seed))
    height = np.minimum((-np.log(1 - rng.random(n)) / np.log(g.links)).astype(int), 6)
    order = np.lexsort((rng.random(n), -height))
    levels: list[np.ndarray] = []  # from the top down while building
    for level in range(int(height.max(initial=0)), -1, -1):
        members = order[: int((height >= level).sum())]
        if len(members) < 2 and level:
            continue  # a level of one point leads nowhere
        links = g.links * (2 if level == 0 else 1)
        nbr = np.full((n, links), -1, np.int32)
        first = members[: min(len(members), 512)]
        sims = vec[first] @ vec[first].T
        np.fill_diagonal(sims, -np.inf)
        c = min(len(first), g.build_beam)
        near = np.argsort(-sims, axis=1, kind="stable")[:, :c]
        near_sims = np.take_along_axis(sims, near, 1)
        chosen = diverse(vec, np.where(np.isfinite(near_sims), first[near], -1), near_sims, g.links)
        nbr[first, : g.links] = chosen
        _link_back(vec, nbr, first, chosen)
        done = len(first)
        while done < len(members):
            part = members[done : done + min(256, max(32, done // 4))]
            q = vec[part]
            entry = search(vec, levels[::-1], q, 4, level_from=None) if levels else np.broadcast_to(first[:4], (len(part), min(4, len(first))))
            ids, sims = beam(vec, nbr, q, entry, g.build_beam)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            k = min(8, len(part))
            mates = np.argpartition(-own, k - 1, axis=1)[:, :k]
            mate_sims = np.take_along_axis(own, mates, 1)
            cand = np.concatenate([ids, np.where(np.isfinite(mate_sims), part[mates], -1)], axis=1)
            sims = np.concatenate([sims, mate_sims], axis=1)
            by = np.argsort(-sims, axis=1, kind="stable")
            chosen = diverse(vec, np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1), g.links)
            nbr[part, : g.links] = chosen
            _link_back(vec, nbr, part, chosen)
            done += len(part)
        levels.append(nbr)
    return levels[::-1]


def search(vec: np.ndarray, levels: list[np.ndarray], q: np.ndarray, ef: int, level_from=None) -> np.ndarray:
    """Ids found for each query, best first, descending through ``levels`` (bottom first)."""
    entry = None
    for i, nbr in enumerate(reversed(levels)):
        if entry is None:
            top = np.flatnonzero((nbr >= 0).any(axis=1))[:4]
            if not len(top):  # a graph of one point
                top = np.zeros(1, np.int64)
            entry = np.broadcast_to(top, (len(q), len(top)))
        entry, _ = beam(vec, nbr, q, entry, ef if i + 1 == len(levels) else max(4, min(ef, 8)))
    return entry


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


_INDEX = "dim int, shard long, ids array<array<long>>, vectors binary, levels array<binary>"


def points(vectors: DataFrame, k: int) -> DataFrame:
    """(ids, embedding, dim) of distinct usable vectors; ids are the k + 1 smallest."""
    e = F.col("embedding")
    # scaled by the largest part, so that squares neither vanish nor overflow
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return rows.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("dim", F.size("embedding"))


def index(distinct: DataFrame, g: Graph = Graph()) -> DataFrame:
    """One row a shard: its points and its graph as flat arrays, written to the shared folder."""
    shards = max(1, -(-distinct.count() // g.shard))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([x[0] for x in pdf["ids"]], kind="stable")]
        vec = np.stack(pdf["embedding"].to_numpy())
        levels = build(unit(vec), g)
        return pd.DataFrame(
            {"dim": [key[0]], "shard": [key[1]], "ids": [[list(map(int, x)) for x in pdf["ids"]]], "vectors": [vec.astype(np.float64).tobytes()], "levels": [[x.tobytes() for x in levels]]}
        )

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))
    return written(dealt.groupBy("dim", "shard").applyInPandas(make, _INDEX), "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, g: Graph = Graph()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` among all rows of ``vectors``
    but the row of the query's own id."""
    found = written(points(vectors, k), "points")
    graphs = index(found, g)
    e = F.col("embedding")
    usable = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    asked = queries.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    asked = written(asked.withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, -(-asked.count() // g.block))
    shards = graphs.select("dim", "shard")  # a row for some thousand points
    shards = F.broadcast(shards) if graphs.count() <= 100_000 else shards
    spread = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(shards, "dim")
    copies = graphs.select(
        F.col("dim").alias("dim2"), F.col("shard").alias("shard2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block2"),
        "ids", "vectors", "levels",
    )

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        row = right.iloc[0]
        dim, ids = int(row["dim2"]), [np.asarray(x, np.int64) for x in row["ids"]]
        full = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        norm = np.sqrt((full * full).sum(axis=1))
        vec = unit(full)
        levels = [np.frombuffer(x, np.int32).reshape(len(full), -1) for x in row["levels"]]
        out = []
        want = min(len(full), max(g.search_beam, 2 * k))
        for s in range(0, len(left), 256):
            part = left.iloc[s : s + 256]
            q = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            got = search(vec, levels, unit(q), want)  # all are scored again: float32 cannot tell close ones apart
            for i, (qid, near) in enumerate(zip(part["query_id"], got, strict=True)):
                near = near[near >= 0]
                score = full[near] @ q[i] / (norm[near] * np.sqrt(q[i] @ q[i]))
                rows = [(-s, int(v)) for s, p in zip(score.tolist(), near, strict=True) for v in ids[p] if v != qid]
                out += [(qid, v, -s) for s, v in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    hits = spread.groupBy("dim", "shard", "block").cogroup(copies.groupBy("dim2", "shard2", "block2")).applyInPandas(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

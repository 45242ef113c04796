"""Best partners: every row is sought among all rows, by what the two have in common.

Rows are packed, in order of their ids, into blocks of a few thousand.  Each task holds the blocks of one range of ids,
its queries, and reads the blocks of all rows in order of ids; it puts them together into pieces of bounded size and
answers its queries piece by piece.  What a query has found so far bounds what later rows must share, and of equal rows
the earlier ones win, so most of a piece is passed over.  Pairs are never rows of a table.  Values are compared as
64-bit hashes, under a seed by which the values at hand are proved distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import in_batches, settled, trim

BLOCK = 2048  # rows of a block
FIRST = 8192  # rows of the first piece, which gives the bounds for the others


def seed_apart(values: DataFrame, seeds: int = 16) -> int:
    """A seed under which no two values (kind, v) of a kind have one hash."""
    for seed in range(seeds):
        hashed = values.groupBy("kind", F.xxhash64(F.lit(seed), F.col("v")).alias("h")).agg(F.min("v").alias("a"), F.max("v").alias("b"))
        if hashed.where("a <> b").isEmpty():
            return seed
    raise ValueError(f"values share a hash under each of {seeds} seeds")


def hashes(values: Column, seed: int) -> Column:
    """The hashes of a list's values, in one order for equal sets."""
    return F.array_sort(F.transform(values, lambda v: F.xxhash64(F.lit(seed), v)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, no, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "no": pa.array([no], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if size + part.num_rows > BLOCK:
                yield block()
                no, held, size = no + 1, [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield block()


def best_partners(rows: DataFrame, schema: str, search: Callable, piece: int) -> DataFrame:
    """What ``search(queries, pieces)`` yields for the rows of each task, as Arrow tables of ``schema``.

    ``rows`` has an ``id``, which is not null.  ``queries`` is a table of a task's rows; ``pieces`` gives pairs of the
    number of rows before and a table of at most ``piece`` rows, all of them in order of ids.
    """
    spark = rows.sparkSession
    tasks = max(24, 2 * spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(tasks, "id").sortWithinPartitions("id")
    blocks = settled(in_batches(ordered, _packed, "task int, no int, data binary"))
    # how often all blocks travel does not depend on how many ranges Spark made
    own = blocks.select((F.col("task") % tasks).alias("for"), F.lit(0).alias("kind"), "task", "no", "data")
    askers = own.groupBy("for").agg(F.count(F.lit(1)).alias("c")).select("for")
    every = blocks.crossJoin(F.broadcast(askers)).select("for", F.lit(1).alias("kind"), "task", "no", "data")
    dealt = own.unionByName(every).repartitionById(tasks, F.col("for")).sortWithinPartitions("for", "kind", "task", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lambda data: pa.ipc.open_stream(data).read_all()
        entries = ((f, k, d) for b in batches for f, k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), strict=True))
        entry = next(entries, None)
        while entry is not None:
            asker, mine = entry[0], []
            while entry is not None and entry[:2] == (asker, 0):
                mine.append(opened(entry[2].as_buffer()))
                entry = next(entries, None)

            def pieces() -> Iterator[tuple[int, pa.Table]]:
                nonlocal entry
                before, held, size, most = 0, [], 0, min(FIRST, piece)
                while entry is not None and entry[0] == asker:  # noqa: B023
                    block = opened(entry[2].as_buffer())
                    entry = next(entries, None)
                    if held and size + block.num_rows > most:
                        whole, held = [pa.concat_tables(held)], []
                        yield before, whole.pop()
                        before, size, most = before + size, 0, piece
                    held.append(block)
                    size += block.num_rows
                if held:
                    whole, held = [pa.concat_tables(held)], []
                    yield before, whole.pop()

            for table in search(pa.concat_tables(mine), pieces()):
                yield from table.combine_chunks().to_batches(max_chunksize=2000)

    return in_batches(dealt, run, schema)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's begin."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    return values, np.concatenate([[0], ends]).astype(np.int64)


def _apart(ids: pa.ChunkedArray) -> pa.ChunkedArray:
    """The ids without the blocks they came in."""
    return pa.chunked_array([pa.concat_arrays(ids.chunks)]) if ids.num_chunks > 1 else pa.chunked_array([ids.take(pa.array(np.arange(len(ids)))).combine_chunks()])


class Postings:
    """The rows that hold a value, in order; values that many rows hold as a mask over all rows too."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        n = self.n = len(starts) - 1
        order = np.argsort(values, kind="stable")
        if len(values) < 1 << 31:
            order = order.astype(np.int32)
        held = values[order]
        self.rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        self.vocab, self.at = held[first], np.concatenate([first, [len(held)]])
        self.masks = {}
        for k in np.flatnonzero(np.diff(self.at) > max(64, n // 16)).tolist():
            mask = np.zeros(n, np.uint8)
            mask[self.rows[self.at[k] : self.at[k + 1]]] = 1
            self.masks[k] = mask

    def find(self, values: np.ndarray) -> np.ndarray:
        """The number of each value here, -1 where no row holds it."""
        if not len(self.vocab):
            return np.full(len(values), -1)
        k = np.minimum(np.searchsorted(self.vocab, values), len(self.vocab) - 1)
        return np.where(self.vocab[k] == values, k, -1)


class _Best:
    """The ``keep`` best partners of each query: the larger key first, then the earlier place."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.keys, self.places = keep, np.zeros((queries, keep), np.int32), np.full((queries, keep), -1, np.int64)
        self.known, self.ids = np.zeros(0, np.int64), None

    def add(self, q: int, places: np.ndarray, keys: np.ndarray) -> None:
        if len(keys) > self.keep:
            kth = np.partition(keys, len(keys) - self.keep)[len(keys) - self.keep]
            above, level = np.flatnonzero(keys > kth), np.flatnonzero(keys == kth)
            if len(level) > (rest := self.keep - len(above)):
                level = level[np.argpartition(places[level], rest - 1)[:rest]]
            ok = np.concatenate([above, level])
            places, keys = places[ok], keys[ok]
        keys, places = np.concatenate([self.keys[q], keys]), np.concatenate([self.places[q], places])
        order = np.lexsort((places, -keys.astype(np.int64)))[: self.keep]
        self.keys[q], self.places[q] = keys[order], places[order]

    def name(self, before: int, ids: pa.ChunkedArray) -> None:
        """Keeps the ids of the rows of a piece that are partners now, and of no others."""
        used = np.unique(self.places[self.keys > 0])
        old, new = used[used < before], used[used >= before]
        parts = [*([self.ids.take(pa.array(np.searchsorted(self.known, old)))] if len(old) else []), pa.array(ids.take(pa.array(new - before)).to_pylist(), ids.type)]
        self.known, self.ids = used, pa.concat_arrays(parts)

    def table(self, askers: pa.ChunkedArray, sets: np.ndarray, top: int) -> pa.Table:
        """(id, other, rank, key) of the ``top`` partners that are not the asker itself; ``sets`` has each asker's query."""
        mine, at = askers.take(pa.array(np.repeat(np.arange(len(sets)), self.keep))), self.places[sets].ravel()
        keys = self.keys[sets].ravel()
        where = np.flatnonzero(keys > 0)
        out = pa.table({"id": mine.take(pa.array(where)), "other": self.ids.take(pa.array(np.searchsorted(self.known, at[where]))), "key": pa.array(keys[where])})
        other = pa.compute.not_equal(out["id"], out["other"]).to_numpy(zero_copy_only=False)
        row = (where // self.keep)[other]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first + 1
        out = out.filter(pa.array(other)).append_column("rank", pa.array(rank.astype(np.int32)))
        return out.filter(pa.array(rank <= top)).select(["id", "other", "rank", "key"])


def _by_length(index: Postings, flat: np.ndarray, owner: np.ndarray, queries: int) -> tuple[list, list, list, list]:
    """Of every query the values that the index holds, the rarest first: where each query's begin, and where the value's
    rows begin and end, and its number."""
    found = index.find(flat)
    has = found >= 0
    who, what = owner[has], found[has]
    order = np.lexsort((index.at[what + 1] - index.at[what], who))
    what = what[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=queries))])
    return ends.tolist(), index.at[what].tolist(), index.at[what + 1].tolist(), what.tolist()


def most_shared(top: int, least: int) -> Callable:
    """A search for the ``top`` rows that share most of ``t``, ``least`` or more; of equal ones the first."""

    def search(queries: pa.Table, pieces: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.Table]:
        values, starts = _flat(queries["t"])
        asked: dict[bytes, int] = {}
        sets = np.array([asked.setdefault(values[a:b].tobytes(), len(asked)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
        flat = np.concatenate([np.frombuffer(k, np.int64) for k in asked])
        sizes = np.array([len(k) // 8 for k in asked], np.int64)
        owner = np.repeat(np.arange(len(asked)), sizes)
        best = _Best(len(asked), top + 1)  # a row is a partner of itself here
        for before, piece in pieces:
            index, ids = Postings(*_flat(piece["t"])), _apart(piece["id"])
            del piece
            trim()
            rows, masks = index.rows, index.masks
            ends, low, high, what = _by_length(index, flat, owner, len(asked))
            acc = np.zeros(index.n, np.uint8 if sizes.max() < 256 else np.uint32)
            lowest = best.keys[:, -1].tolist()
            for q in range(len(asked)):
                a, b, need = ends[q], ends[q + 1], max(least, lowest[q] + 1)
                if b - a < need:
                    continue
                # two rows that share ``need`` share one among all but the need - 1 most frequent
                cut = b - need + 1
                for k in range(a, cut):
                    mask = masks.get(what[k])
                    if mask is None:
                        acc[rows[low[k] : high[k]]] += 1
                    else:
                        acc += mask
                near = np.flatnonzero(acc)
                c = acc[near]
                acc.fill(0)
                for k in range(cut, b):
                    if (mask := masks.get(what[k])) is not None:
                        c += mask[near]
                    else:
                        mine = rows[low[k] : high[k]]
                        if len(mine) > 40 * len(near):
                            c += mine[np.minimum(np.searchsorted(mine, near), len(mine) - 1)] == near
                        else:
                            acc[mine] = 1
                            c += acc[near]
                            acc[mine] = 0
                    ok = c >= need - (b - k - 1)
                    near, c = near[ok], c[ok]
                    if not len(near):
                        break
                if need > b - a or not len(near):
                    continue
                ok = c >= need
                best.add(q, near[ok] + before, c[ok])
            best.name(before, ids)
        yield best.table(queries["id"], sets, top)

    return search


#: What two notes have in common, as bits of a number; below them is the number of words, 9 standing for more.
AUTHOR, REGION, METHOD, JOURNAL, PLACE, YEARS, NEAR = (1 << k for k in (10, 9, 8, 7, 6, 5, 4))


def best_related(top: int, keys: np.ndarray, several: int = 48) -> Callable:
    """A search for the ``top`` rows of the largest key, 0 being none; of equal ones the first.

    ``keys`` has a key for every set of bits, which no further bit or word makes smaller.  The rows of a piece lie by the
    authors, regions and methods they have (``kin``): what those give, with all else in common, bounds the rows of a kin,
    and kins are looked at from the largest bound on; all rows at once, where more than ``several`` would have to be.
    """
    traits, marks = (("authors", AUTHOR), ("regions", REGION), ("methods", METHOD)), (("journal", JOURNAL), ("place", PLACE), ("dir", NEAR))

    def plain(column: pa.ChunkedArray, none: int) -> np.ndarray:
        return pa.compute.fill_null(column, none).to_numpy()

    def search(queries: pa.Table, pieces: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.Table]:
        n = queries.num_rows
        flat, starts = _flat(queries["t"])
        owner = np.repeat(np.arange(n), np.diff(starts))
        asked = {k: _flat(queries[k]) for k, _ in traits}
        years = plain(queries["year"], -1).tolist()
        best = _Best(n, top + 1)  # a row is a partner of itself here
        for before, piece in pieces:
            size, ids = piece.num_rows, _apart(piece["id"])
            kin = plain(piece["kin"], 0)
            order = np.argsort(kin, kind="stable")
            kin, places = kin[order], order.astype(np.int64) + before
            edges = np.flatnonzero(np.concatenate([[True], kin[1:] != kin[:-1]]))
            sizes = np.diff(np.concatenate([edges, [size]]))
            lows, highs = edges.tolist(), (edges + sizes).tolist()
            kins = {k: Postings(*_flat(piece[k].take(pa.array(order[edges])))) for k, _ in traits}
            held = [(bit, kins[k], kins[k].find(asked[k][0]).tolist(), asked[k][1].tolist()) for k, bit in traits]
            index = Postings(*_flat(piece["t"].take(pa.array(order))))
            rows, masks = index.rows, index.masks
            ends, low, high, what = _by_length(index, flat, owner, n)
            codes, wanted = [], []
            for c, bit in marks:
                vocab, inverse = np.unique(plain(piece[c], 0), return_inverse=True)
                mine = plain(queries[c], 0)
                at = np.minimum(np.searchsorted(vocab, mine), len(vocab) - 1)
                codes.append((np.where(piece[c].is_null().to_numpy(), -1, inverse).astype(np.int32)[order], np.uint8(bit)))
                wanted.append(np.where(queries[c].is_null().to_numpy() | (vocab[at] != mine), -2, at).tolist())
            year = plain(piece["year"], -1)[order]
            if year.max() < 1 << 30:
                year = year.astype(np.int32)
            gained = np.zeros(len(edges), np.int32)
            # only the ids of the piece are read from here on
            del piece, kin, order
            trim()

            def look(q: int, lo: int, hi: int, base, seen=()) -> None:
                acc = np.zeros(hi - lo, np.uint8)
                for k in range(ends[q], ends[q + 1]):  # noqa: B023
                    if (mask := masks.get(what[k])) is not None:  # noqa: B023
                        acc += mask[lo:hi]
                    else:
                        mine = rows[low[k] : high[k]]  # noqa: B023
                        if hi - lo < size:  # noqa: B023
                            a, b = np.searchsorted(mine, np.array([lo, hi], np.int32))
                            mine = mine[a:b] - lo
                        acc[mine] += 1
                    if (k - ends[q]) % 200 == 199:  # noqa: B023
                        np.minimum(acc, 9, out=acc)
                np.minimum(acc, 9, out=acc)
                for (code, bit), wish in zip(codes, wanted, strict=True):  # noqa: B023
                    if wish[q] >= 0:
                        acc |= (code[lo:hi] == wish[q]).view(np.uint8) * bit
                if (y := years[q]) >= 0:
                    y_ = year[lo:hi]  # noqa: B023
                    acc |= ((y_ >= max(0, y - 3)) & (y_ <= y + 3)).view(np.uint8) * np.uint8(YEARS)
                key = keys[base : base + 256][acc] if isinstance(base, int) else keys[base + acc]
                for g in seen:
                    key[lows[g] : highs[g]] = 0  # noqa: B023
                near = np.flatnonzero(key >= max(1, best.keys[q, -1]))
                if len(near):
                    best.add(q, places[lo + near], key[near])  # noqa: B023

            for q in range(n):
                gained.fill(0)
                for bit, by, found, begin in held:
                    for v in found[begin[q] : begin[q + 1]]:
                        if v >= 0:
                            gained[by.rows[by.at[v] : by.at[v + 1]]] |= bit
                rest = min(9, ends[q + 1] - ends[q]) + (YEARS if years[q] >= 0 else 0)
                rest += sum(int(bit) for (_, bit), wish in zip(codes, wanted, strict=True) if wish[q] >= 0)
                bound = keys[gained + rest]
                most, least = bound.max(), max(1, best.keys[q, -1])
                if most < least:
                    continue
                first = np.flatnonzero(bound == most)
                if len(first) > several:
                    look(q, 0, size, np.repeat(gained, sizes))
                    continue
                for g in first.tolist():
                    look(q, lows[g], highs[g], int(gained[g]))
                others = np.flatnonzero((bound >= max(1, best.keys[q, -1])) & (bound < most))
                if len(others) > several:
                    look(q, 0, size, np.repeat(gained, sizes), first.tolist())
                    continue
                for g in others[np.argsort(-bound[others], kind="stable")].tolist():
                    if bound[g] >= best.keys[q, -1]:
                        look(q, lows[g], highs[g], int(gained[g]))
            best.name(before, ids)
        yield best.table(queries["id"], np.arange(n), top)

    return search

"""Exact substring removal over a sampled suffix array.

Which suffixes are sorted: of every run of ``length`` bytes at least one suffix is picked by its content alone
(the least hash of the 16-byte grams in a window), so two equal strings of ``length`` bytes hold picked suffixes at
the same places.  One suffix in about forty is picked.

1. Texts equal as a whole are found by their hashes; later copies are removed whole and take no further part.
2. Splitters sampled from the leading eight bytes range-partition the picked suffixes; a range is cut further by the
   hash of the gram, so that buckets stay bounded however many suffixes there are.  A suffix travels as hashes: of its
   gram, of all bytes within reach (``length - 16`` before, ``length`` from it on), of the first half of what follows
   and of the half before.  Suffixes with equal bytes within reach are one class: its first stays, all that the others
   reach is removed at once, and tasks do this before the shuffle too, so copied passages hardly travel.  Of the
   firsts only those matter that share their gram and a half with another: every string of ``length`` bytes through a
   picked place holds one of the two halves.
3. What matters goes, with its bytes within reach, to buckets of bounded size: ranges of its own, cut by gram.  A
   bucket sorts by multikey quicksort, eight bytes a step, once by what follows and once by what precedes, and
   compares neighbours.  A string with o bytes before the picked place repeats an earlier one if it falls into one
   class with it in both orders, at common prefixes of length - o and o; the first of the class stays.  Places of
   grams in more than ``hot`` places go through the same shuffle as hashes of every string through them instead,
   dealt by hash, the first of equal ones in a task alone; so no bucket holds a hot gram.
4. Ranges are merged by document.

Nothing on the driver grows with the corpus: splitters (``ranges`` at most) are quantiles taken by the executors, and
of hot grams there are at most 50,000 (a gram is hot beyond the larger of ``hot`` places and that share of all).

Defined results: null counts as the empty text; texts shorter than ``length`` keep every byte; rows that repeat a
doc_id are one document (they come back as often as they came in), and if their texts differ the text of least hash
is the document while the other rows keep every byte, as rows without doc_id do; ties are broken by doc_id and place;
an empty table gives an empty result; extra columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop, release, text_or_empty, written
from .textkern import U64, RangeHash, mix, pieces

GRAM = 16
#: Names beside a table's own columns.
OWN, CUT = "own_id__", ("cut_from__", "cut_to__")
U32 = np.uint32
_T32 = np.random.Generator(np.random.PCG64(99)).integers(1, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Suffixes:
    """length: bytes of a repeat; sample: documents read for splitters at least; ranges: splitters at most; bucket,
    context_bucket: suffixes in a bucket of either phase; hot: see above; held: suffixes a task gathers before it
    hands them on."""

    length: int = 100
    sample: int = 2000
    ranges: int = 1024
    bucket: int = 150_000
    context_bucket: int = 30_000
    hot: int = 200_000
    held: int = 100_000
    broadcast_ids: int = 1_000_000

    @property
    def before(self) -> int:
        return self.length - GRAM

    @property
    def half(self) -> int:
        """A string with at most so many bytes before the place holds the half that follows, any other the one before."""
        return (self.length - GRAM) // 2


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive values (len(x) - w + 1 of them)."""
    n, k = len(x) - w + 1, 1
    while 2 * k <= w:
        x = f(x[: len(x) - k], x[k:])
        k *= 2
    return f(x[:n], x[w - k : w - k + n])


def picked(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picked places with their document (local) and gram hash."""
    w = length - GRAM + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(off)
    if len(data) < length or not (sizes >= length).any():
        return none, none, none.astype(U32)
    with np.errstate(over="ignore"):
        h = _T32[data]
        for k, c in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D), (8, 0x27D4EB2F)):
            h = h[: len(h) - k] * U32(c) + h[k:]
        h ^= h >> U32(15)
        h *= U32(0x2C1B3C6D)
        h ^= h >> U32(13)
        h |= U32(1)
    least = _slide(h, w, np.minimum)
    good = np.zeros(len(least) + 1, np.int32)  # windows inside one document
    begin, end = off[:-1][sizes >= length], off[1:][sizes >= length] - length + 1
    np.add.at(good, begin, 1)
    np.add.at(good, end, -1)
    least[np.cumsum(good)[: len(least)] == 0] = 0
    pad = np.zeros(w - 1, U32)
    most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(most == h)
    return at, np.searchsorted(off, at, side="right") - 1, h[at]


def lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    out = np.zeros(len(at), U64)
    for j in range(8):
        out = (out << U64(8)) | data[at + j].astype(U64)
    return out


@dataclass
class Ranges:
    """Splitters over leads, cut ``fan`` times by gram; keys of the grams (lead, hash) known to be hot."""

    splitters: np.ndarray
    fan: int
    hot: np.ndarray

    @property
    def n(self) -> int:
        return (len(self.splitters) + 1) * self.fan

    def bucket(self, leads: np.ndarray, grams: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.splitters, leads, side="left").astype(np.int64)
        hi = np.searchsorted(self.splitters, leads, side="right").astype(np.int64)
        spread = mix(grams.astype(U64), 3)
        at = lo + (spread % (hi - lo + 1).astype(U64)).astype(np.int64)
        return at * self.fan + (mix(spread, 4) % U64(self.fan)).astype(np.int64)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return np.isin(keys, self.hot)


def gram_key(leads: np.ndarray, grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(leads + mix(grams.astype(U64), 5), 6)


#: Leads are unsigned; with the top bit turned they sort as signed numbers too.
_TOP = U64(1 << 63)


def _splitters(leads: DataFrame, n: int) -> np.ndarray:
    """n - 1 quantiles of the column ``lead``, taken by the executors."""
    if n < 2:
        return np.zeros(0, U64)
    cuts = F.percentile_approx("lead", F.array(*(F.lit(k / n) for k in range(1, n))), 20 * n)
    got = leads.agg(cuts.alias("cuts")).first()["cuts"] or []
    return np.sort(np.asarray(got, np.int64).view(U64) ^ _TOP)


def _ranges(docs: DataFrame, n_docs: int, n_bytes: int, p: Suffixes) -> Ranges:
    """From the picked suffixes of some documents, chosen by hash: ``sample`` or enough to see the hot grams."""
    expected = 2 * n_bytes / (p.length - GRAM + 2)
    hot = max(p.hot, expected / 50_000)
    share = min(1.0, max(p.sample / max(1, n_docs), 100 / hot))
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches):
        for batch in batches:
            for _, _, data, off in pieces(batch.column("text")):
                at, _, gram = picked(data, off, p.length)
                leads = lead(data, at)
                yield pa.RecordBatch.from_arrays([pa.array((leads ^ _TOP).view(np.int64)), pa.array(gram_key(leads, gram).view(np.int64))], ["lead", "key"])

    got = written(few.transform(arrow, run, "lead long, key long"), "leads")
    often = got.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= 20) & (F.col("c") / share > hot)).select("key").collect()
    buckets = max(1, math.ceil(expected / p.bucket))
    cuts = _splitters(got, min(p.ranges, buckets))
    drop(got)
    return Ranges(cuts, -(-buckets // (len(cuts) + 1)), np.array([r.key for r in often], np.int64).view(U64))


#: kind: 0 suffixes or bytes within reach, 1 hashes of strings, 2 ranges to remove.
_BLOB = "pid int, kind int, blob binary"
_REC = np.dtype([("lead", "<u8"), ("full", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("gram", "<u4"), ("right", "<u4"), ("left", "<u4"), ("nr", "u1"), ("hot", "u1")])
_STRING = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("s", "<i4")])
_RANGE = np.dtype([("doc", "<i8"), ("a", "<i4"), ("b", "<i4")])


def _emit(kind: int, rec: np.ndarray, pid: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(pid, kind="stable")
    rec, pid = rec[order], pid[order]
    begin = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
    blobs = [x.tobytes() for x in np.split(rec, begin[1:])]
    return pa.RecordBatch.from_arrays([pa.array(pid[begin], pa.int32()), pa.array(np.full(len(begin), kind, np.int32)), pa.array(blobs, pa.binary())], ["pid", "kind", "blob"])


def _emit_ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> pa.RecordBatch:
    doc, a, b = _union(doc.astype(np.int64), a.astype(np.int64), b.astype(np.int64))
    rec = np.zeros(len(doc), _RANGE)
    rec["doc"], rec["a"], rec["b"] = doc, a, b
    return _emit(2, rec, (mix(doc.view(U64), 7) % U64(n)).astype(np.int64))


def _blobs(batches: Iterator[pa.RecordBatch], kinds: list[np.dtype]) -> Iterator[list[np.ndarray]]:
    """The records of every bucket of a task, a list by kind."""
    by_pid: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for pid, kind, blob in zip(batch.column("pid").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            by_pid.setdefault(pid, [[] for _ in kinds])[kind].append(np.frombuffer(blob.as_buffer(), kinds[kind]))
    while by_pid:
        _, parts = by_pid.popitem()
        yield [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True)]


def firsts(rec: np.ndarray, keys: tuple[str, ...], place: str) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, laters) of records that agree in ``keys``, by document and place; one of equal documents and places."""
    rec = rec[np.lexsort((rec[place], rec["doc"], rec[keys[0]]))]
    if not len(rec):
        return rec, rec
    new = np.ones(len(rec), bool)
    new[1:] = np.logical_or.reduce([rec[k][1:] != rec[k][:-1] for k in keys])
    head = rec[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (rec["doc"] != head["doc"]) | (rec[place] != head[place])
    return rec[new], rec[later]


def _reach(rec: np.ndarray, p: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rec["doc"], rec["pos"] - np.minimum(p.before, rec["pos"]), rec["pos"] + rec["nr"]


_CLASS = ("full", "lead", "gram")


def _spread(r: Ranges, p: Suffixes):
    def out(recs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rec, later = firsts(np.concatenate(recs), _CLASS, "pos")
        if len(later):
            yield _emit_ranges(*_reach(later, p), r.n)
        pid = r.bucket(rec["lead"], rec["gram"])
        hot = np.flatnonzero(rec["hot"])
        pid[hot] = (mix(rec["full"][hot], 8) % U64(r.n)).astype(np.int64)
        yield _emit(0, rec, pid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, held = [], 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for a, _, data, off in pieces(batch.column("text")):
                at, row, gram = picked(data, off, p.length)
                if not len(at):
                    continue
                rec = np.zeros(len(at), _REC)
                rec["lead"], rec["gram"] = lead(data, at), gram
                rec["doc"], rec["pos"] = ids[row + a], at - off[row]
                rec["hot"] = r.is_hot(gram_key(rec["lead"], gram))
                nl, nr = np.minimum(p.before, at - off[row]), np.minimum(p.length, off[row + 1] - at)
                rec["nr"] = nr
                h = RangeHash(data)
                rec["full"] = mix(h(at - nl, at + nr), 11) ^ mix((nl * 256 + nr).astype(U64), 12)
                k = np.flatnonzero(nr >= p.length - p.half)
                rec["right"][k] = (h(at[k], at[k] + p.length - p.half) >> U64(32)) | U64(1)
                k = np.flatnonzero(nl > p.half)
                rec["left"][k] = (h(at[k] - p.half - 1, at[k] + GRAM) >> U64(32)) | U64(1)
                recs.append(rec)
                held += len(at)
                if held > p.held:
                    yield from out(recs)
                    recs, held = [], 0
        if held:
            yield from out(recs)

    return run


_KEPT = "doc_id long, pos array<int>, wide array<boolean>, a array<int>, b array<int>, leads array<long>"
#: One lead in so many kept suffixes is handed on for the next splitters.
_EACH = 64


def _shared(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Records whose gram and half another record has; half 0 is none."""
    with np.errstate(over="ignore"):
        _, at, count = np.unique(mix(key + half.astype(U64), 13), return_inverse=True, return_counts=True)
    return (count[at] > 1) & (half > 0)


def _repeating(p: Suffixes):
    """Of a bucket's suffixes those that matter, by document (``wide`` marks grams in more than ``hot`` places), and
    the ranges that are known to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rec, _, gone in _blobs(batches, [_REC, _STRING, _RANGE]):
            rec, later = firsts(rec, _CLASS, "pos")
            doc, a, b = (np.concatenate(x) for x in zip(_reach(later, p), (gone["doc"], gone["a"], gone["b"]), strict=True))
            if len(doc):
                yield _kept_rows(spans=_union(doc.astype(np.int64), a.astype(np.int64), b.astype(np.int64)))
            key = gram_key(rec["lead"], rec["gram"])
            sure = rec["hot"] == 1
            keep = sure | _shared(key, rec["right"]) | _shared(key, rec["left"])
            rec, key, sure = rec[keep], key[keep], sure[keep]
            if not len(rec):
                continue
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            yield _kept_rows(rec=rec, wide=sure | (count[at] > p.hot))

    return run


def _kept_rows(rec: np.ndarray | None = None, wide: np.ndarray | None = None, spans=None) -> pa.RecordBatch:
    none = np.zeros(0, np.int32)
    pos, flags, a, b, leads = none, none.astype(bool), none, none, none.astype(np.int64)
    if spans is None:
        order = np.argsort(rec["doc"], kind="stable")
        doc, pos, flags = rec["doc"][order], rec["pos"][order], wide[order]
        leads = (np.sort(rec["lead"])[_EACH // 2 :: _EACH] ^ _TOP).view(np.int64)
    else:
        doc, a, b = spans
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(begin, len(doc))

    def lists(x: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends if len(x) else np.zeros(len(ends)), pa.int32()), pa.array(x, kind))

    first = pa.array(np.minimum(np.arange(len(ends)), 1) * len(leads), pa.int32())  # all with the bucket's first row
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[begin], pa.int64()), lists(pos, pa.int32()), lists(flags, pa.bool_()), lists(a, pa.int32()), lists(b, pa.int32()),
         pa.ListArray.from_arrays(first, pa.array(leads, pa.int64()))],
        ["doc_id", "pos", "wide", "a", "b", "leads"],
    )


def _context_ranges(kept: DataFrame, p: Suffixes) -> Ranges:
    """Splitters for what matters, from one lead in ``_EACH`` that the buckets of the first phase hand in."""
    n = kept.agg(F.coalesce(F.sum(F.size("pos")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(n / p.context_bucket))
    cuts = _splitters(kept.select(F.explode("leads").alias("lead")), min(p.ranges, buckets))
    return Ranges(cuts, -(-buckets // (len(cuts) + 1)), np.zeros(0, U64))


def context_kind(p: Suffixes) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("pos", "<i4"), ("gram", "<u4"), ("nl", "u1"), ("nr", "u1"), ("l", "u1", p.before), ("r", "u1", p.length)])


def _contexts(data: np.ndarray, off: np.ndarray, ids: np.ndarray, row: np.ndarray, at: np.ndarray, r: Ranges, p: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(records, buckets) with the bytes around places: ``before`` before it, backward, and ``length`` from it on."""
    rec = np.zeros(len(at), context_kind(p))
    rec["doc"], rec["pos"] = ids[row], at - off[row]
    rec["nl"], rec["nr"] = np.minimum(p.before, at - off[row]), np.minimum(p.length, off[row + 1] - at)
    span = np.arange(p.length)
    right = data[np.minimum(at[:, None] + span, len(data) - 1)]
    right[span[None, :] >= rec["nr"][:, None]] = 0
    left = data[np.maximum(at[:, None] - 1 - span[: p.before], 0)]
    left[span[None, : p.before] >= rec["nl"][:, None]] = 0
    rec["l"], rec["r"] = left, right
    with np.errstate(over="ignore"):
        gram = mix(lead(data, at) + mix(lead(data, at + 8), 8), 9)
    rec["gram"] = (gram >> U64(32)).astype(U32)
    return rec, r.bucket(lead(data, at), rec["gram"])


def _strings(data: np.ndarray, off: np.ndarray, ids: np.ndarray, row: np.ndarray, at: np.ndarray, p: Suffixes) -> Iterator[np.ndarray]:
    """Hashes of every string of ``length`` bytes through the places, each once."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.maximum(at - p.before, off[row]), 1)
    np.add.at(edge, np.maximum(np.minimum(at, off[row + 1] - p.length) + 1, np.maximum(at - p.before, off[row])), -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    h, g = RangeHash(data), RangeHash(data, 1)
    for i in range(0, len(starts), 100_000):
        s = starts[i : i + 100_000]
        of = np.searchsorted(off, s, side="right") - 1
        rec = np.zeros(len(s), _STRING)
        rec["h"], rec["g"], rec["doc"], rec["s"] = h(s, s + p.length), g(s, s + p.length), ids[of], s - off[of]
        yield rec


def _around(r: Ranges, p: Suffixes):
    """What matters of every text: bytes within reach of ordinary places, hashes of strings through wide ones."""

    def strings(recs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rec, later = firsts(np.concatenate(recs), ("h", "g"), "s")
        if len(later):
            yield _emit_ranges(later["doc"], later["s"], later["s"] + p.length, r.n)
        yield _emit(1, rec, (mix(rec["h"], 10) % U64(r.n)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, pids, held = [], [], 0
        wides, n_wide = [], 0
        for batch in batches:
            lists, flags = batch.column("pos"), batch.column("wide")
            flat, wide = np.asarray(lists.flatten()), np.asarray(flags.flatten().to_numpy(zero_copy_only=False), bool)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            ids = np.asarray(batch.column("doc_id"))
            for a, b, data, off in pieces(batch.column("text")):
                pos, w = flat[ends[a] : ends[b]].astype(np.int64), wide[ends[a] : ends[b]]
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                at, own = pos + off[row], ids[a:b]
                for i in range(0, len(at), 4000):
                    k = np.arange(i, min(i + 4000, len(at)))[~w[i : i + 4000]]
                    rec, pid = _contexts(data, off, own, row[k], at[k], r, p)
                    recs.append(rec)
                    pids.append(pid)
                    held += len(k)
                    if held > 20_000:
                        yield _emit(0, np.concatenate(recs), np.concatenate(pids))
                        recs, pids, held = [], [], 0
                if w.any():
                    for rec in _strings(data, off, own, row[w], at[w], p):
                        wides.append(rec)
                        n_wide += len(rec)
                        if n_wide > p.held:
                            yield from strings(wides)
                            wides, n_wide = [], 0
        if held:
            yield _emit(0, np.concatenate(recs), np.concatenate(pids))
        if n_wide:
            yield from strings(wides)

    return run


def multikey_order(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (zero padded, ``size`` real bytes) and the common prefix of each with its predecessor.

    Multikey quicksort, eight bytes a step: one step sorts, inside every run of rows that are equal so far, by the
    next eight bytes; runs of one row are done.  Equal rows follow by size.
    """
    m, width = rows.shape
    steps = -(-width // 8)
    padded = np.zeros((m, steps * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(U64)
    order = np.lexsort((size, words[:, 0]))
    group = np.zeros(m, np.int64)
    for k in range(steps):
        w = words[order, k]
        new = np.zeros(m, bool)
        new[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        if k + 1 == steps:
            break
        alone = np.ones(m + 1, bool)
        alone[1:m] = new[1:]
        alone = alone[:-1] & alone[1:]
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        sub = order[live]
        order[live] = sub[np.lexsort((size[sub], words[sub, k + 1], group[live]))]
    common = np.zeros(m, np.int64)
    if m > 1:
        a, b = padded[order[:-1]], padded[order[1:]]
        differ = a != b
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), steps * 8)
        common[1:] = np.minimum(first, np.minimum(size[order[:-1]], size[order[1:]]))
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_ranges(doc, pos, left, nl, right, nr, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of what earlier strings cover, for records with the bytes around them."""
    by_age = np.lexsort((pos, doc))
    doc, pos, left, nl, right, nr = (x[by_age] for x in (doc, pos, left, nl.astype(np.int64), right, nr.astype(np.int64)))
    m = len(doc)
    same = np.zeros(m, bool)  # a record met twice is itself, not an earlier one
    same[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    order_r, common_r = multikey_order(right, nr)
    order_l, common_l = multikey_order(left, nl)
    most, least = np.full(m, -1, np.int64), np.full(m, length, np.int64)
    for o in range(left.shape[1] + 1):
        ok = np.flatnonzero((nl >= o) & (nr >= length - o) & ~same)
        if len(ok) < 2:
            continue
        key = _classes(order_r, common_r, length - o)[ok] * (m + 1) + _classes(order_l, common_l, o)[ok]
        by = np.argsort(key, kind="stable")
        again = np.zeros(len(ok), bool)
        again[by[1:]] = key[by[1:]] == key[by[:-1]]
        x = ok[again]
        most[x] = np.maximum(most[x], o)
        least[x] = np.minimum(least[x], o)
    x = np.flatnonzero(most >= 0)
    return doc[x], pos[x] - most[x], pos[x] - least[x] + length


def _bucketed(p: Suffixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rec, strings, gone in _blobs(batches, [context_kind(p), _STRING, _RANGE]):
            if len(gone):
                yield _span_rows(gone["doc"].astype(np.int64), gone["a"].astype(np.int64), gone["b"].astype(np.int64))
            _, later = firsts(strings, ("h", "g"), "s")
            if len(later):
                yield _span_rows(later["doc"].astype(np.int64), later["s"].astype(np.int64), later["s"].astype(np.int64) + p.length)
            values, counts = np.unique(rec["gram"], return_counts=True)
            rec = rec[np.isin(rec["gram"], values[counts > 1])]
            # grams are independent: a bucket that came out large is sorted in several turns
            turn = np.searchsorted(values, rec["gram"])
            cum = np.cumsum(counts)
            turn = (cum[turn] - 1) // p.context_bucket if len(rec) else turn
            for t in np.unique(turn):
                x = rec[turn == t]
                who, a, b = repeated_ranges(
                    x["doc"].astype(np.int64), x["pos"].astype(np.int64), x["l"], x["nl"], x["r"], x["nr"], p.length
                )
                if len(who):
                    yield _span_rows(who, a, b)

    return run


def _span_rows(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Ranges merged and gathered by document."""
    doc, a, b = _union(doc, a, b)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = pa.array(np.append(begin, len(doc)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[begin]), pa.ListArray.from_arrays(ends, pa.array(a, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(b, pa.int32()))],
        ["doc_id", "a", "b"],
    )


def _union(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges by document; ranges that touch become one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    lift = group * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + lift)
    new = np.concatenate([[True], (a + lift)[1:] > reach[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], a[begin], (reach - lift)[end]


@dataclass
class Found:
    """docs: the table with OWN; copies: doc_id of later copies of whole texts; spans: doc_id, a, b (arrays of int:
    bytes [a, b) to remove)."""

    docs: DataFrame
    copies: DataFrame
    spans: DataFrame
    copies_small: bool
    spans_small: bool


def _small(df: DataFrame, small: bool) -> DataFrame:
    """Ids, sent to every executor where their checked number allows it."""
    return F.broadcast(df) if small else df


def _keyed(docs: DataFrame, p: Suffixes) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the number OWN of its document (null: no part in this) and the heads (doc_id, h, g, n) of documents."""
    text = text_or_empty()
    h, g = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), g.alias("g"), F.octet_length(text).alias("n")).where("doc_id IS NOT NULL")
    heads = written(rows.where(F.col("n") >= p.length).distinct(), "heads")
    several = written(heads.groupBy("doc_id").agg(F.min(F.struct("h", "g")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    own = F.col("doc_id").cast("long")
    if several.isEmpty():
        return docs.withColumn(OWN, own), heads
    heads = heads.join(several, "doc_id", "left").where("m IS NULL OR (h = m.h AND g = m.g)").select("doc_id", "h", "g", "n")
    chosen = several.select(F.col("doc_id").alias(OWN), F.col("m").alias(CUT[0]))
    marked = docs.join(_small(chosen, several.count() <= p.broadcast_ids), own == F.col(OWN), "left")
    it = F.when(F.col(CUT[0]).isNull() | ((F.col(CUT[0]).getField("h") == h) & (F.col(CUT[0]).getField("g") == g)), own)
    return marked.withColumn(OWN, it).drop(CUT[0]), written(heads, "heads")


def find_repeats(docs: DataFrame, p: Suffixes = Suffixes()) -> Found:
    spark = docs.sparkSession
    keyed, heads = _keyed(docs, p)
    firsts_ = heads.groupBy("h", "g", "n").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = written(heads.join(firsts_, ["h", "g", "n"]).where("doc_id <> m").select("doc_id"), "copies")
    n_copies = copies.count()
    n_docs, n_bytes = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    drop(heads)
    copies_small = n_copies <= p.broadcast_ids
    own = keyed.where(F.col(OWN).isNotNull()).select(F.col(OWN).alias("doc_id"), text_or_empty().alias("text"))
    own = own.where(F.octet_length("text") >= p.length).join(_small(copies, copies_small), "doc_id", "left_anti")
    r = _ranges(own, n_docs, n_bytes, p)
    kept = written(
        own.transform(arrow, _spread(r, p), _BLOB)
        .repartitionById(r.n, F.col("pid"))
        .transform(arrow, _repeating(p), _KEPT),
        "kept",
    )
    release(spark)
    again = _context_ranges(kept, p)
    by_doc = kept.where(F.size("pos") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("pos")).alias("pos"), F.flatten(F.collect_list("wide")).alias("wide"))
    by_doc = written(by_doc, "places")
    n_ids = by_doc.count()
    some = own.join(_small(by_doc.select("doc_id"), n_ids <= p.broadcast_ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    near = (
        some.join(by_doc, "doc_id")
        .transform(arrow, _around(again, p), _BLOB)
        .repartitionById(again.n, F.col("pid"))
        .transform(arrow, _bucketed(p), "doc_id long, a array<int>, b array<int>")
    )
    spans = kept.where(F.size("a") > 0).select("doc_id", "a", "b").unionByName(near)
    spans = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    spans = written(spans, "spans")
    drop(by_doc)
    drop(kept)
    release(spark)
    return Found(keyed, copies, spans, copies_small, spans.count() <= p.broadcast_ids)


def _split(found: Found) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are later copies, that have ranges to remove (with them), and the others."""
    copies, ids = _small(found.copies.toDF(OWN), found.copies_small), _small(found.spans.select(F.col("doc_id").alias(OWN)), found.spans_small)
    spans = found.spans.select(F.col("doc_id").alias(OWN), F.col("a").alias(CUT[0]), F.col("b").alias(CUT[1]))
    own = found.docs.join(copies, OWN, "left_anti")
    return found.docs.join(copies, OWN, "left_semi"), own.join(ids, OWN, "left_semi").join(spans, OWN), own.join(ids, OWN, "left_anti")


def ranges_of(a, b) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    _, a, b = _union(np.zeros(len(a), np.int64), a, b)
    return a, b


def repeats(docs: DataFrame, p: Suffixes = Suffixes()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    import hashlib

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    copies, cut, rest = _split(find_repeats(docs, p))
    zero, size = F.lit(0).cast("long"), F.octet_length("text").cast("long")
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, a, b in zip(*(batch.column(c) for c in ("doc_id", "text", *CUT)), strict=True):
                raw = text.as_py().encode()
                a, b = ranges_of(a.values, b.values)
                h, at = hashlib.sha256(), 0
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    h.update(raw[at:i])
                    at = j
                h.update(raw[at:])
                out.append((d.as_py(), len(raw), int((b - a).sum()), len(a), h.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)] if out else [pa.array([], k) for k in (pa.int64(),) * 4 + (pa.string(),)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return (
        cut.select("doc_id", "text", *CUT).transform(arrow, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        .unionByName(copies.select("doc_id", size, size, F.lit(1).cast("long"), F.lit(empty)).toDF(*names))
        .unionByName(rest.select("doc_id", size, zero, zero, F.sha2("text", 256)).toDF(*names))
    )


def without_repeats(docs: DataFrame, p: Suffixes = Suffixes()) -> DataFrame:
    """``docs`` with repeated bytes removed from its texts; texts that nothing is left of go, all others stay.

    What is left of a character cut in half is dropped with it.
    """
    copies, cut, rest = _split(find_repeats(docs, p))

    @F.pandas_udf("string")
    def kept(text, a, b):
        import pandas as pd

        out = []
        for t, i, j in zip(text, a, b, strict=True):
            raw, parts, at = t.encode(), [], 0
            for x, y in zip(*(v.tolist() for v in ranges_of(i, j)), strict=True):
                parts.append(raw[at:x])
                at = y
            out.append(b"".join([*parts, raw[at:]]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    left = cut.withColumn("text", kept("text", *CUT)).where(F.length("text") > 0).select(*docs.columns)
    return left.unionByName(rest.select(*docs.columns))

"""Benchmark decontamination with an FM-index per training shard.

The benchmark's words are numbered; every other word is one foreign symbol that no phrase can contain, so only runs
of benchmark words at least as long as the shortest phrase enter the shard's text.  The shard gets a suffix array
(prefix doubling), a Burrows-Wheeler transform in a wavelet matrix, and every ``sample``-th text position of the
suffix array.  All phrases are searched backward together through wavelet ranks; occurrences are located by walking
to a sampled position; their word ranges are merged into removal spans.

No row is shuffled: a shard is indexed and searched where it is read.  The phrases are sent along in blocks of at
most ``block`` phrases; every batch is searched for all blocks and their spans are merged row by row.

Defined results: null and empty texts have no words, no hits and no items; items without words are ignored; equal
items and repeated rows are each judged by themselves; an empty benchmark leaves every document clean; extra columns
pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow
from .textkern import ALNUM, Words, hash_words, pieces


class WaveletMatrix:
    """Rank over a sequence of small integers, for many positions at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            zeros = len(seq) - int(count[-1])
            self.levels.append((bit, count, zeros))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        lo, hi = np.zeros_like(at), at
        for bit, count, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            lo = np.where(one, zeros + count[lo], lo - count[lo])
            hi = np.where(one, zeros + count[hi], hi - count[hi])
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the end of the text sorts first."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(np.diff(text[order]) != 0)
    step = 1
    while n and rank[order[-1]] < n - 1:
        after = np.full(n, 0, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        rank, step = fresh, step * 2
    return order


class FMIndex:
    """Backward search and location over one shard's symbols (1 .. top; 0 separates)."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        text, top = np.concatenate([text + 1, [0]]).astype(np.int64), top + 1  # an end that occurs once
        self.n = len(text)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.tree = WaveletMatrix(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.kept = np.where(sa % sample == 0, sa, -1)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases of one length (one per line)."""
        phrases = phrases + 1
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            hi[live] = np.maximum(lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        hi[hi < lo] = lo[hi < lo]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(self.kept[at] < 0)
        while len(live):
            at[live] = self.step(self.bwt[at[live]], at[live])
            walked[live] += 1
            live = live[self.kept[at[live]] < 0]
        return self.kept[at] + walked


@dataclass
class Phrases:
    """A block of windows: vocabulary (sorted hashes), windows by length, the items of every window."""

    vocab: np.ndarray
    by_length: list[tuple[int, np.ndarray, list[list[int]]]] = field(default_factory=list)

    @property
    def shortest(self) -> int:
        return min((k for k, _, _ in self.by_length), default=0)


def phrases(items: list[tuple[int, np.ndarray]], window: int) -> Phrases:
    vocab = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
    owners: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, h in items:
        ids = np.searchsorted(vocab, h) + 1
        k = min(window, len(ids))
        for w in dict.fromkeys(map(tuple, np.lib.stride_tricks.sliding_window_view(ids, k).tolist())):
            owners[k][w].append(item)
    return Phrases(vocab, [(k, np.array(list(w), np.int64), list(w.values())) for k, w in owners.items()])


def blocks(benchmark: DataFrame, window: int, block: int) -> list[Phrases]:
    """The benchmark in blocks of at most ``block`` windows (or one item)."""
    out: list[Phrases] = []
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        (h,) = hash_words([row.text], ALNUM)
        if not len(h):
            continue
        if held and size + len(h) > block:
            out.append(phrases(held, window))
            held, size = [], 0
        held.append((row.item_id, h))
        size += len(h)
    return [*out, phrases(held, window)] if held or not out else out


#: Symbols of one FM-index: a batch with more is indexed in several shards.
SHARD = 1 << 20
FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<first:long,last:long,start:long,end:long>>"


class Finder:
    """Hits of one block of phrases in an Arrow column of texts."""

    def __init__(self, block: Phrases):
        self.p = block
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(block.vocab >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, col: pa.Array) -> list[tuple[int, int, list[int], list[tuple[int, int, int, int]]]]:
        out: list = []
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for a, b, data, off in pieces(col):
            w = Words(data, off, ALNUM)
            out += [(int(n), 0, [], []) for n in np.diff(w.first)]
            run = self._runs(w, off, a)
            if len(run[0]):
                held.append(run)
                size += len(run[0])
            if size >= SHARD:
                self._shard(held, out)
                held, size = [], 0
        if held:
            self._shard(held, out)
        return out

    def _runs(self, w: Words, off: np.ndarray, a: int) -> tuple[np.ndarray, ...]:
        """Symbols worth indexing with row, word number, start and end in the text; a 0 ends every run."""
        h = w.hash()
        symbol = np.zeros(len(h) + 1, np.int64)
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.p.vocab, h[hit]), max(0, len(self.p.vocab) - 1))
        same = self.p.vocab[at] == h[hit] if len(self.p.vocab) else np.zeros(0, bool)
        symbol[hit[same]] = at[same] + 1
        known = np.flatnonzero(symbol)
        if not len(known):
            return (known,) * 5
        row = np.searchsorted(w.first, known, side="right") - 1
        new = np.ones(len(known), bool)
        new[1:] = (np.diff(known) != 1) | (np.diff(row) != 0)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(known)))
        keep = np.repeat(length >= self.p.shortest, length)
        ends = np.zeros(len(known), bool)
        ends[np.append(begin[1:], len(known)) - 1] = True
        known, row, ends = known[keep], row[keep], ends[keep]
        copies = 1 + ends
        last = np.cumsum(copies) - 1
        text = symbol[np.repeat(known, copies)]
        text[last[ends]] = 0
        known, row = np.repeat(known, copies), np.repeat(row, copies)
        return text, row + a, known - w.first[row], w.start[known] - off[row], w.end[known] - off[row]

    def _shard(self, held: list[tuple[np.ndarray, ...]], out: list) -> None:
        text, row, word, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
        index = FMIndex(text, len(self.p.vocab))
        covered = np.zeros(len(text) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for k, windows, owners in self.p.by_length:
            lo, hi = index.search(windows)
            count = hi - lo
            which = np.repeat(np.arange(len(windows)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            at = index.locate(rows)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k, -1)
            for r, x in np.unique(np.stack([row[at], which]), axis=1).T.tolist() if len(at) else ():
                items[r].update(owners[x])
        hit = (np.cumsum(covered)[: len(text)] > 0) & (text > 0)
        at = np.flatnonzero(hit)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(row[at]) != 0) | (np.diff(word[at]) != 1)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(at)) - 1
        spans: dict[int, list] = defaultdict(list)
        for i, j in zip(at[begin].tolist(), at[stop].tolist(), strict=True):
            spans[int(row[i])].append((int(word[i]), int(word[j]), int(start[i]), int(end[j])))
        for r, s in spans.items():
            out[r] = (out[r][0], sum(y - x + 1 for x, y, _, _ in s), sorted(items[r]), s)


def merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Union of word ranges (first, last, start, end)."""
    out: list[list[int]] = []
    for s in sorted(map(tuple, spans)):
        if out and s[0] <= out[-1][1] + 1:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def united(find: list[Finder], col: pa.Array) -> list[tuple[int, int, list[int], list[tuple[int, int, int, int]]]]:
    """Hits of all blocks in a column, row by row."""
    out = find[0](col)
    for f in find[1:]:
        for k, (n, _, items, spans) in enumerate(f(col)):
            if spans:
                both = merge(out[k][3] + spans)
                out[k] = (n, sum(y - x + 1 for x, y, _, _ in both), sorted({*out[k][2], *items}), both)
    return out


def _fields(found: list) -> list[pa.Array]:
    kind = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])
    return [
        pa.array([x[0] for x in found], pa.int64()),
        pa.array([x[1] for x in found], pa.int64()),
        pa.array([x[2] for x in found], pa.list_(pa.int64())),
        pa.array([[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in x[3]] for x in found], pa.list_(kind)),
    ]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): hit words, the items found and the merged removal spans.

    A span holds its first and last word (from 0) and its bytes [start, end) in the UTF-8 text.
    """
    docs = docs.select("doc_id", "text")
    parts = blocks(benchmark, window, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [Finder(part) for part in parts]
        for batch in batches:
            found = united(find, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_fields(found)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.transform(arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def cut(text: str, ranges: list[tuple[int, int]], gap: str = "\n") -> str:
    """The text without the byte ranges, ``gap`` in place of each."""
    raw, out, at = text.encode(), [], 0
    for a, b in ranges:
        out.append(raw[at:a])
        at = b
    return gap.encode().join([*out, raw[at:]]).decode(errors="ignore")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 200_000) -> DataFrame:
    """``docs`` with every removal span cut from its text; all columns and rows stay.

    The spans of all blocks are found in the whole text and united before anything is cut."""
    parts = blocks(benchmark, window, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [Finder(part) for part in parts]
        for batch in batches:
            i = batch.schema.get_field_index("text")
            found = united(find, batch.column(i))
            if any(x[3] for x in found):
                texts = batch.column(i).to_pylist()
                for k, x in enumerate(found):
                    if x[3]:
                        texts[k] = cut(texts[k], [(s[2], s[3]) for s in x[3]])
                batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            yield batch

    return docs.transform(arrow, run, docs.schema)

"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of lower-cased words with a blank before and after; grams are hashed to
``buckets`` embeddings, a text is the average of its grams, and a linear softmax over that average is trained by
stochastic gradient descent in numpy.  Some training examples are thinned to a few dozen grams, so that short texts
are learned too.  A temperature fitted on texts kept back calibrates the probabilities; a text is rejected when its
calibrated probability is below four fifths of what all but ``reject_share`` of the kept-back texts reach, and below
0.4 in any case.

The fit sees at most about ``sample`` texts (whole), drawn by hash with equal shares for the languages.  Scoring
folds embeddings and softmax into one table of buckets x languages, which is what travels to the executors.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; a corpus without any
training row makes every text ``und``; ties go to the language that sorts first; repeated rows are scored each;
extra columns pass through, but for those with the names of ``identify``'s own, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, held_out, trim
from .textkern import LETTERS, LOWER, U64, lut, pieces

BITS = 15
U32 = np.uint32
_ASCII = lut((0x41, 0x5A), (0x61, 0x7A))
_FOLD = np.where(LETTERS[LOWER], LOWER, 0x20).astype(np.uint8)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size the bucket of every place and whether a gram starts there."""
    b = _FOLD[data]
    x, blank, n = b.astype(U32), b == 0x20, len(b)
    cuts = off[1:-1]
    word = x.copy()
    for size in (2, 3, 4):
        if n < size:
            return
        with np.errstate(over="ignore"):
            word = (word[: n - size + 1] << U32(8)) | x[size - 1 :]
            index = ((word ^ U32(size * 0x1000193)) * U32(0x9E3779B1)) >> U32(32 - BITS)
        ok = np.ones(n - size + 1, bool)
        if size == 2:
            ok &= ~(blank[:-1] & blank[1:])
        for j in range(1, size - 1):
            ok &= ~blank[j : n - size + 1 + j]
        for j in range(1, size):
            at = cuts - j
            ok[at[(at >= 0) & (at < len(ok))]] = False
        yield index, ok


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, c): the buckets of a whole text and their counts."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, data, off in pieces(batch.column("text")):
            got = list(grams(data, off))
            ids, values = [], []
            for r in range(b - a):
                total = np.zeros(1 << BITS, np.int64)
                for index, ok in got:
                    part = slice(off[r], off[r + 1])
                    total += np.bincount(index[part][ok[part]], minlength=1 << BITS)
                ids.append(np.flatnonzero(total).astype(np.int32))
                values.append(total[ids[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[a:b]), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["lang", "i", "c"]
            )


def sampled(df: DataFrame, column: str, quota: int, seed: int, counts: dict | None = None) -> tuple[DataFrame, dict]:
    """Rows with about ``quota`` of each value of ``column``, by a hash of doc_id."""
    if counts is None:
        counts = {r[0]: r[1] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    share = F.lit(-1)
    for value, n in counts.items():
        share = F.when(F.col(column) == value, int(min(1.0, quota / n) * 1_000_000)).otherwise(share)
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share), counts


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, dim: int = 16, epochs: int = 6, seed: int = 5):
    """Embeddings, weights and bias by SGD over (label, buckets, counts)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.uniform(-0.5, 0.5, (1 << BITS, dim)).astype(np.float32) / dim
    w = rng.normal(0, 0.1, (dim, n_labels)).astype(np.float32)
    bias = np.zeros(n_labels, np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            label, i, c = examples[k]
            if not len(i):
                continue
            if rng.random() < 0.5:  # a short text of the same language
                c = rng.multinomial(int(rng.integers(8, 120)), c / c.sum())
                i, c = i[c > 0], c[c > 0]
            rate = 1.0 * (1 - done / steps) + 0.05
            done += 1
            share = (c / c.sum()).astype(np.float32)
            x = share @ emb[i]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = w @ p
            w -= rate * np.outer(x, p)
            bias -= 0.1 * rate * p
            emb[i] -= (rate * 20) * share[:, None] * back[None, :]
    return emb, w, bias


def _calibrated(z: np.ndarray, y: np.ndarray, reject_share: float) -> tuple[float, float]:
    """Temperature of least loss; probability below which texts are rejected."""

    def top(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    t = min((float(x) for x in np.geomspace(0.5, 20, 60)), key=lambda t: -np.log(top(t)[np.arange(len(y)), y] + 1e-9).mean())
    p = top(t)
    right = p.argmax(axis=1) == y
    best = p.max(axis=1)[right]
    return t, float(min(0.4, 0.8 * np.quantile(best, reject_share))) if len(best) else 0.4


def fit_language(docs: DataFrame, sample: int = 2400, reject_share: float = 0.001, seed: int = 5) -> LanguageModel:
    """Learns from text and lang of ``docs`` that are not held out."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    few, _ = sampled(rows, "lang", max(20, sample // len(counts)), seed, counts)
    got = few.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").transform(arrow, _counts, "lang string, i array<int>, c array<int>").toArrow().combine_chunks()
    trim()
    labels = sorted(counts)
    number = {x: i for i, x in enumerate(labels)}
    # views into two flat columns
    langs, lists = got.column("lang").to_pylist(), got.column("i").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    counts_ = np.asarray(got.column("c").combine_chunks().values) if got.num_rows else np.zeros(0, np.int32)
    examples = [(number[x], flat[s:e], counts_[s:e]) for x, s, e in zip(langs, ends[:-1], ends[1:], strict=True) if e > s]
    examples.sort(key=lambda e: (e[0], len(e[1]), e[1].sum(), (e[1] * e[2]).sum()))  # the order rows arrive in has no say
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(examples))
    back = order[: len(examples) // 5]
    emb, w, bias = train([examples[k] for k in order[len(examples) // 5 :]], len(labels), seed=seed)
    table = emb @ w
    z = np.array([(examples[k][2] / examples[k][2].sum()) @ table[examples[k][1]] + bias for k in back]).reshape(len(back), len(labels))
    t, reject = _calibrated(z, np.array([examples[k][0] for k in back], int), reject_share) if len(back) else (1.0, 0.0)
    del examples, emb, got, lists, flat, counts_
    trim()
    return LanguageModel(labels, np.ascontiguousarray(table, np.float32), bias, t, reject)


def _scores(model: LanguageModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best label and its calibrated probability, for every text of a slice."""
    n, labels = len(off) - 1, len(model.labels)
    z, total = np.zeros((n, labels)), np.zeros(n)
    for index, ok in grams(data, off):
        at = np.flatnonzero(ok)
        pos = np.searchsorted(at, off)
        some = np.flatnonzero(np.diff(pos))
        total += np.diff(pos)
        index = index[at]
        for k in range(labels):
            if len(some):
                z[some, k] += np.add.reduceat(model.table[:, k][index], pos[:-1][some], dtype=np.float64)
    z = z / np.maximum(total, 1)[:, None] + model.bias
    e = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    p = e / e.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def _judged(model: LanguageModel, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text has a letter, the number of its best label and its probability."""
    best, score, plain = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
    for _, _, data, off in pieces(col):
        i, p = _scores(model, data, off)
        best.append(i)
        score.append(p)
        seen = np.concatenate([[0], np.cumsum(_ASCII[data])])
        plain.append(seen[off[1:]] > seen[off[:-1]])
    letters = np.concatenate(plain)
    for k in np.flatnonzero(~letters):  # texts without an ASCII letter may have others
        letters[k] = col[k].is_valid and any(map(str.isalpha, col[k].as_py()))
    return letters, np.concatenate(best), np.where(letters, np.concatenate(score), 0.0)


#: Columns that ``identify`` adds, in place of a table's own of these names.
ADDED = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ADDED))
    if not model.labels:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.labels, object)
        for batch in batches:
            letters, best, p = _judged(model, batch.column(batch.schema.get_field_index("text")))
            lang = np.where(letters, names[best], "und")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(p), pa.array(~letters | (p < model.reject))], [*batch.schema.names, *ADDED]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(ADDED[0], T.StringType()), T.StructField(ADDED[1], T.DoubleType()), T.StructField(ADDED[2], T.BooleanType())])
    return docs.transform(arrow, run, schema)


def without_rejected(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their columns as they are."""
    if not model.labels:
        return docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, _, p = _judged(model, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(letters & (p >= model.reject)))

    return docs.transform(arrow, run, docs.schema)

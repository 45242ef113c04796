"""Toxicity by weak supervision.

Voters: lexicon entries (whole words and word beginnings of 4, 5, 6 and 7 bytes, case folded) for either side, and
patterns (shouting, exclamation marks, masked letters, words spelled with digits or gaps).  Lexicon entries are mined
from labelled rows by a likelihood-ratio test with a bound on the expected number of chance entries; the ``entries``
strongest are kept (a bound of the model's size), and of entries that fire on nearly the same texts one becomes a
voter (greedy cover, ``voters`` at most for a side).  A voter fires or abstains; its side is what its accuracy says.

Label model: a generative model with one hidden label.  The labelled rows give each voter's firing rate under either
label (its accuracy) as counts; EM adds to them what the unlabelled texts say, and estimates the correlations of
voters given the label.  Voters that correlate share their evidence: a voter's weight is one over one plus the sum of
its positive correlations.  The posterior of a text, labelled or not, comes from its votes alone.

Classifier: logistic regression over all entries and patterns, trained on the posteriors of labelled and unlabelled
texts; the given labels calibrate its scores (scale, shift and the patterns).  Scoring looks every word of the whole text up in the entries and adds
weights.

The fit reads at most about ``positives`` + ``negatives`` labelled and ``unlabelled`` other texts, drawn by hash, none
of them held out.  Defined results: null and empty texts have no voter firing and get the score of that; without any
positive or negative training row every score is the share of positives (0 if there is no row); labels that are null
are ignored, of repeated ones the largest counts; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, held_out, signed, written
from .langid import sampled
from .textkern import LETTERS, U64, Words, lut, mix, pieces

#: Lengths of word beginnings that are lexicon entries; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7)
_UPPER, _BANG, _STAR, _DIGIT = lut((0x41, 0x5A)), lut((0x21, 0x21)), lut((0x2A, 0x2A)), lut((0x30, 0x39))
PATTERNS = ("shouting", "exclaiming", "masked", "digits_inside", "spelled_out")


@dataclass
class ToxicityModel:
    entries: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the entries, then of the patterns
    bias: float
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of every word and beginning in a slice."""
    w = Words(data, off, LETTERS)
    row = w.row
    size = w.end - w.start
    for k in BEGINNINGS:
        if k:
            long = size > k
            yield w.hash(w.start[long], w.start[long] + k, salt=k), row[long]
        else:
            yield w.hash(), row


def patterns(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Indicators of PATTERNS (texts x patterns)."""
    n, size = len(off) - 1, np.maximum(1, np.diff(off))

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[off[1:]] - c[off[:-1]]

    m = len(data)
    upper, star, digit = _UPPER[data], _STAR[data], _DIGIT[data]
    letter = LETTERS[data] | upper
    inner = np.zeros(m, bool)
    between = np.zeros(m, bool)
    apart = np.zeros(m, bool)
    if m > 2:
        inner[1:-1] = letter[:-2] & star[1:-1] & letter[2:]
        between[1:-1] = letter[:-2] & digit[1:-1] & letter[2:]
    if m > 4:
        gap = ~letter & ~digit
        apart[:-4] = gap[:-4] & letter[1:-3] & gap[2:-2] & letter[3:-1] & gap[4:]
    share = count(upper) / np.maximum(1, count(letter))
    out = np.zeros((n, len(PATTERNS)), bool)
    out[:, 0] = (share > 0.5) & (size >= 10)
    out[:, 1] = count(_BANG[data]) / size > 0.02
    out[:, 2] = count(inner) > 0
    out[:, 3] = count(between) / size > 0.01
    out[:, 4] = count(apart) / size > 0.05
    return out


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of toxic and other texts with each entry, summed over a task before the shuffle."""
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for a, b, data, off in pieces(batch.column("text"), 4 << 20):
            h, row = (np.concatenate(x) for x in zip(*features(data, off), strict=True))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            one = np.ones(len(h), bool)
            one[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, toxic = h[one], y[a:b][row[one]]
            if not len(h):
                continue
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            pos = np.add.reduceat(toxic, begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h[begin])), pa.array(pos, pa.int64()), pa.array(np.diff(np.append(begin, len(h))) - pos, pa.int64())],
                ["h", "pos", "neg"],
            )


class Lookup:
    """Entries that occur in each text of a slice."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(entries >> U64(46)).astype(np.int64)] = True

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry), distinct."""
        found = [np.zeros(0, np.int64)]
        n = max(1, len(self.entries))
        for h, row in features(data, off):
            at = np.flatnonzero(self.maybe[(h >> U64(46)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.entries, h[at]), n - 1)
            same = self.entries[i] == h[at] if len(self.entries) else np.zeros(len(at), bool)
            found.append(row[at[same]].astype(np.int64) * n + i[same])
        key = np.unique(np.concatenate(found))
        return key // n, key % n


def cover(on: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Columns that together fire on many positives, often more than once, and on few others; greedily, ties to the
    first.  A column that fires on nearly the same texts as one already taken adds nothing and is passed over."""
    pos, neg = on[y == 1].astype(np.float32), on[y == 0].astype(np.float32)
    wanted, out = np.ones(len(pos), np.float32), []
    cost = 4 * neg.sum(axis=0) * min(1.0, len(pos) / max(1, len(neg)))
    size = pos.sum(axis=0) + neg.sum(axis=0)
    usable = np.ones(on.shape[1], bool)
    while len(out) < most and usable.any():
        gain = np.where(usable, wanted @ pos - cost, -np.inf)
        k = int(gain.argmax())
        if gain[k] < 2:
            break
        out.append(k)
        wanted *= 1 - 0.5 * pos[:, k]
        both = pos[:, k] @ pos + neg[:, k] @ neg
        usable &= both <= 0.8 * (size + size[k] - both)
    return np.array(out, np.int64)


def label_model(votes: np.ndarray, given: np.ndarray, prior: float, rounds: int = 25, share: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label from the votes alone, firing rates (2 x voters) and correlations given the label.

    An unlabelled text counts ``share`` of a labelled one when accuracies are estimated, so that many of them cannot
    carry the label away.  ``given`` is 1 or 0 where a label is known and -1 elsewhere.  Known labels enter only as counts of the voters'
    firing (their accuracies); the posterior of a text never sees its own or any other label.
    """
    m = votes.shape[1]
    known, v, free = given >= 0, votes.astype(np.float32), votes[given < 0].astype(np.float32)
    fired = np.stack([v[given == y].sum(axis=0) for y in (0, 1)]).astype(np.float64)
    seen = np.array([(given == y).sum() for y in (0, 1)], np.float64)
    weight, corr = np.ones(m), np.zeros((m, m))
    for y in (0, 1):
        d = v[given == y] - fired[y] / max(1.0, seen[y])
        c = (d.T @ d).astype(np.float64) / max(1.0, seen[y])
        s = np.sqrt(np.diag(c)) + 1e-9
        corr += seen[y] / max(1, known.sum()) * c / s[:, None] / s[None, :]
    np.fill_diagonal(corr, 0)
    weight = 1 / (1 + np.clip(corr, 0, None).sum(axis=1))
    post = np.zeros(len(free))
    rates = np.zeros((2, m))
    every = v.mean(axis=0)
    for turn in range(rounds):
        for y, p in ((0, 1 - post), (1, post)):
            told = (fired[y], seen[y]) if not turn else (fired[y] + share * (p @ free), seen[y] + share * p.sum())
            rates[y] = (told[0] + 0.5 * every + 0.01) / (told[1] + 0.5 + 0.02)
        fire, rest = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        base = np.log(prior / (1 - prior)) + (weight * rest).sum()
        post = 1 / (1 + np.exp(-np.clip(base + free @ (weight * (fire - rest)), -30, 30)))
    return 1 / (1 + np.exp(-np.clip(base + v @ (weight * (fire - rest)), -30, 30))), rates, corr


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft targets, by Newton steps that are halved until the loss falls."""
    n, m = x.shape
    x = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    pull = np.append(np.full(m, ridge), 1e-6)
    w = np.zeros(m + 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (pull * w * w).sum())

    best = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + pull * w
        bend = (x * (weight * p * (1 - p))[:, None].astype(x.dtype)).T @ x
        move = np.linalg.solve(bend.astype(np.float64) + np.diag(pull + 1e-9), slope)
        while True:
            now = loss(w - move)
            if now <= best or np.abs(move).max() < 1e-9:
                break
            move = move / 2
        done = best - now < 1e-9 * max(1.0, abs(best))
        w, best = w - move, now
        if done:
            break
    return w[:m], float(w[m])


def _unlabelled(docs: DataFrame, labels: DataFrame, quota: int, seed: int) -> DataFrame:
    """About ``quota`` texts without a label that are not held out (y = -1), by a hash of doc_id."""
    free = docs.select("doc_id", "text").where(~held_out() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, quota / max(1, free.count()))
    few = free.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    mine = F.broadcast(few.select("doc_id").distinct())  # about ``quota`` ids
    known = labels.where("toxic IS NOT NULL").select("doc_id").join(mine, "doc_id", "left_semi").distinct()
    return few.join(F.broadcast(known), "doc_id", "left_anti").select("doc_id", "text", F.lit(-1).alias("y"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 4000, unlabelled: int = 4000, entries: int = 1024, voters: int = 128, seed: int = 3
) -> ToxicityModel:
    """Learns from rows of ``labels`` (doc_id, toxic) that are not held out."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    none = np.zeros(0, U64)
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return ToxicityModel(none, np.zeros(len(PATTERNS)), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    few = sampled(known, "y", positives, seed, {1: counts[1]})[0].unionByName(sampled(known, "y", negatives, seed, {0: counts[0]})[0])
    labelled = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text IS NOT NULL")
    rows = written(labelled.unionByName(_unlabelled(docs, labels, unlabelled, seed)), "sample")
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    got = rows.where("y >= 0").transform(arrow, _mined, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos") + 0.0, F.col("neg") + 0.0
    df, total = a + b, float(pos + neg)

    def term(k, e):
        return F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)

    g2 = 2 * (
        term(a, df * (pos / total)) + term(b, df * (neg / total))
        + term(pos - a, (total - df) * (pos / total)) + term(neg - b, (total - df) * (neg / total))
    )
    # 30: about 4e-8 a test, so some hundred thousand entries give none by chance
    sided = (a / pos > 3 * b / neg) | (b / neg > 3 * a / pos)
    picked = got.where(sided & (g2 > 30)).select("h", g2.alias("g")).orderBy(F.desc("g"), "h").limit(entries).toPandas()
    lexicon = np.sort(picked["h"].to_numpy(np.int64).view(U64)) if len(picked) else none

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(lexicon)
        for batch in batches:
            y, ids = batch.column("y"), batch.column("doc_id")
            for s, e, data, off in pieces(batch.column("text")):
                row, entry = look(data, off)
                first = np.searchsorted(row, np.arange(e - s + 1))
                pats = patterns(data, off)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s, e - s).cast(pa.int64()), y.slice(s, e - s), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(entry, pa.int32())),
                     pa.array([np.flatnonzero(p).astype(np.int32) for p in pats], pa.list_(pa.int32()))],
                    ["doc_id", "y", "e", "p"],
                )

    sample = rows.transform(arrow, seen, "doc_id long, y int, e array<int>, p array<int>").toPandas()
    sample["n"] = sample["e"].map(len)
    sample = sample.sort_values(["doc_id", "y", "n"], kind="stable")
    x = np.zeros((len(sample), len(lexicon) + len(PATTERNS)), bool)
    for i, (e, p) in enumerate(zip(sample["e"], sample["p"], strict=True)):
        x[i, e] = True
        x[i, np.asarray(p, int) + len(lexicon)] = True
    return trained(x, sample["y"].to_numpy(), lexicon, voters)


def voter_columns(x: np.ndarray, y: np.ndarray, n_entries: int, most: int) -> np.ndarray:
    """Columns that vote: entries covering the toxic and the other labelled texts, and all patterns."""
    bad = cover(x[:, :n_entries], y, most)
    good = cover(x[:, :n_entries], np.where(y >= 0, 1 - y, y), most)
    return np.concatenate([np.unique(np.concatenate([bad, good])), np.arange(n_entries, x.shape[1])]).astype(np.int64)


def trained(x: np.ndarray, y: np.ndarray, lexicon: np.ndarray, voters: int) -> ToxicityModel:
    """The model from indicators (texts x entries and patterns) and labels (-1: none)."""
    given = y >= 0
    prior = float(np.clip(y[given].mean(), 0.01, 0.99)) if given.any() else 0.5
    votes = x[:, voter_columns(x, y, len(lexicon), voters)]
    post, rates, corr = label_model(votes, y, prior)
    # either label has half the weight, so that a score of one half means no evidence
    balance = np.where(post >= 0.5, 0.5 / max(1, (post >= 0.5).sum()), 0.5 / max(1, (post < 0.5).sum())) * len(y)
    w, b = logistic(x.astype(np.float32), post, balance)
    z, t = (x.astype(np.float32) @ w + b)[given], y[given]
    balance = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum())) * len(t)
    # the given labels set scale and shift, and what the few patterns say that words do not
    more, shift = logistic(np.column_stack([z / 4, x[given][:, len(lexicon) :]]), t.astype(np.float64), balance)
    w, b = w * more[0] / 4, b * more[0] / 4 + shift
    w[len(lexicon) :] += more[1:]
    return ToxicityModel(lexicon, w, float(b), rates, corr)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    lexicon, weights, bias = model.entries, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(lexicon)
        for batch in batches:
            z = [np.zeros(0)]
            for a, b, data, off in pieces(batch.column("text")):
                row, entry = look(data, off)
                z.append(np.bincount(row, weights[entry], minlength=b - a) + patterns(data, off) @ weights[len(lexicon) :] + bias)
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(arrow, run, f"doc_id {kind}, score double")

"""Quality by a sparse rule ensemble.

Statistics of a text are Spark column expressions.  Over a bounded sample of labelled rows, boosted shallow trees
are grown; every path from a root to a node becomes a conjunctive rule; a lasso logistic regression over rules keeps
a few dozen; and these are compiled to column expressions, so scoring is one projection inside the JVM.

The fit reads at most about ``sample`` labelled rows of each class, drawn by hash.  Defined results: null counts as
the empty text, whose statistics are 0; without any row of either class the score is the share of the other (0.5
without any row); null labels are ignored and of repeated ones the smallest counts; repeated rows are scored each;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty
from .langid import sampled


def statistics() -> dict[str, Column]:
    """Statistics of the column ``text_``; shares are of characters or words."""
    t = F.col("text_")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    words = F.greatest(count(r"\S+"), F.lit(1.0))
    lines = F.split(t, "\n")
    n_lines = F.size(lines).cast("double")
    return {
        "chars": chars,
        "words": words,
        "word_length": chars / words,
        "lines": n_lines,
        "words_a_line": words / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "upper": count(r"\p{Lu}") / chars,
        "digit": count(r"\d") / chars,
        "symbol": count(r"[#$%&*+=<>@^_~|\\/{}\[\]]") / words,
        "doubled": count(r"([^\p{L}\p{N}\s])\1") / words,
        "stop": count(r"[.,;:](?=\s|$)") / words,
        "shout": count(r"[!?]") / words,
        "short": count(r"\b\p{L}{1,3}\b") / words,
        "titled": count(r"\b\p{Lu}\p{Ll}") / words,
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is greater, threshold) that hold together."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.terms:
            out &= (x[name] > at) if above else (x[name] <= at)
        return out


@dataclass
class QualityModel:
    rules: list[Rule]
    weights: list[float]
    bias: float


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], least: int):
    """Best (gain, feature, threshold) for the rows, by Newton gain."""
    best = (1e-6, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        bin_of = np.searchsorted(at, x[rows, f], side="left")  # x <= at[k] is left of cut k
        n = np.cumsum(np.bincount(bin_of, minlength=len(at) + 1))[:-1]
        sg = np.cumsum(np.bincount(bin_of, g[rows], minlength=len(at) + 1))[:-1]
        sh = np.cumsum(np.bincount(bin_of, h[rows], minlength=len(at) + 1))[:-1]
        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(at[k]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.2) -> list[Rule]:
    """Every path to a node of boosted trees, as rules, once each."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    # thresholds between values, rounded, so that they are the same numbers in every engine
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    least = max(3, len(y) // 200)
    rng = np.random.Generator(np.random.PCG64(1))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        bag = np.flatnonzero(rng.random(len(y)) < 0.7)
        stack = [(np.arange(len(y)), bag, ())]
        while stack:
            rows, seen, terms = stack.pop()
            cut = _split(x, g, h, seen, cuts, least) if len(terms) < depth and len(seen) >= 2 * least else (0, -1, 0)
            if cut[1] < 0:
                z[rows] += rate * g[seen].sum() / (h[seen].sum() + 1) if len(seen) else 0
                continue
            f, at = cut[1], cut[2]
            for above in (False, True):
                side = (*terms, (names[f], above, at))
                rules[Rule(side)] = None
                stack.append((rows[(x[rows, f] > at) == above], seen[(x[seen, f] > at) == above], side))
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean loss plus penalty times the sum of absolute weights, by FISTA."""
    n, m = x.shape
    w, b, sw, sb = np.zeros(m), 0.0, np.zeros(m), 0.0
    rate = 4.0 / (np.square(x).sum(axis=1).max(initial=0) + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ sw + sb, -30, 30)))
        g = weight * (p - y) / n
        nw, nb = sw - rate * (x.T @ g), sb - rate * g.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        pull = k / (k + 3)
        sw, sb = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b = nw, nb
    return w, b


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_rules: int = 60, seed: int = 4) -> QualityModel:
    """Learns from rows of ``labels`` (doc_id, quality) that are not held out."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return QualityModel([], [], float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    few = sampled(known, "y", sample, seed, counts)[0]
    stats = statistics()
    rows = docs.select("doc_id", text_or_empty().alias("text_")).join(F.broadcast(few), "doc_id")
    got = rows.select("doc_id", "y", *(c.alias(k) for k, c in stats.items())).toPandas().sort_values("doc_id")
    names = list(stats)
    x, y = got[names].to_numpy(float), got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return QualityModel([], [], 0.0)
    rules = grow_rules(x, y, names)
    columns = {k: x[:, i] for i, k in enumerate(names)}
    on = np.array([r.holds(columns) for r in rules]).T.astype(float)
    keep = np.flatnonzero((on.mean(axis=0) > 0.002) & (on.mean(axis=0) < 0.998))
    rules, on = [rules[i] for i in keep], on[:, keep]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    w, b = np.zeros(len(rules)), 0.0
    for penalty in (0.001, 0.002, 0.004, 0.008, 0.016, 0.03):  # the least that leaves a small enough ensemble
        w, b = lasso_logistic(on, y, weight, penalty)
        if (np.abs(w) > 1e-6).sum() <= most_rules:
            break
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return QualityModel([rules[i] for i in some], [float(w[i]) for i in some], float(b))


def quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    used = {name for r in model.rules for name, _, _ in r.terms}
    stats = docs.select("doc_id", text_or_empty().alias("text_")).select("doc_id", *(c.alias(k) for k, c in statistics().items() if k in used))
    z = F.lit(model.bias)
    for r, w in zip(model.rules, model.weights, strict=True):
        z = z + F.when(r.column(), w).otherwise(0.0)
    return stats.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))

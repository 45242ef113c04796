"""Similar whole texts against brute force."""

import random
import time
from difflib import SequenceMatcher

from colophon import catalogue
from colophon.functions.text import ratio, reaches
from colophon.operators import references as r


def similar(x, y):
    near = SequenceMatcher(None, x, y).ratio() >= 0.93
    return near or (y in x and len(y) >= int(len(x) * 0.72)) or (x in y and len(x) >= int(len(y) * 0.72))


def brute_components(rows):
    """Sorted (n, origins) of the components of texts that share their first word."""
    first = {}
    for d, _, t in rows:
        first[t] = min(d, first.get(t, d))
    texts = sorted(first, key=first.get)
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, x in enumerate(texts):
        for y in texts[i + 1 :]:
            if x.split()[0] == y.split()[0] and similar(x, y):
                up[root(y)] = root(x)
    out = {}
    for _, source, t in rows:
        out.setdefault(root(t), []).append(source)
    return sorted((len(v), " | ".join(sorted(set(v)))) for v in out.values())


def test_near_dup_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(60)]
    rows = []
    for family in range(12):
        base = ["start" if family % 2 else "begin", *rng.choices(words, k=rng.choice([12, 30, 90]))]
        changed, inserted, shorter, tail = [*base], [base[0], "xq", *base[1:]], [base[0], *base[2:]], [*base[:-4], *rng.choices(words, k=4)]
        changed[1], changed[2] = "zz", "yy"  # words 2 and 3 differ
        rows += [" ".join(w) for w in (base, base, changed, inserted, shorter, tail, base[: len(base) * 8 // 10])]
    rows = [(i, f"s{i % 7}_{i // 7}", t) for i, t in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n, r.origins) for r in catalogue.queries()["near_dup_components"](spark, str(tmp_path)).collect())
    assert got == brute_components(rows)
    assert len({t.split()[1] for _, _, t in rows}) > 12 and got[-1][0] > 3


def test_reaches_equals_ratio():
    rng = random.Random(4)
    seen = set()
    for _ in range(1500):
        a = "".join(rng.choices("abcdef ", k=rng.randint(0, 400)))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 8))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choices("abcdef ", k=rng.randint(0, 2))
        b = "".join(b)
        for least in (0.6, 0.93):
            assert reaches(a, b, least) == (ratio(a, b) >= least)
            seen.add((least, reaches(a, b, least)))
    assert len(seen) == 4


LETTERS = "eeeeeettttaaaaooooiiiinnnnsssshhhhrrrddlcumwfgypbvkjxqz019"


def test_reaches_equals_ratio_of_long_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(200)]
    seen = set()
    for _ in range(250):
        a = " ".join(rng.choices(words, k=rng.randint(20, 200)))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // rng.choice([9, 14, 25])))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choices(LETTERS, k=rng.randint(0, 2))
        b = "".join(b[len(b) // 2 :] + b[: len(b) // 2] if rng.random() < 0.2 else b)
        exact = ratio(a, b)
        for least in (0.6, 0.93, exact, exact + 1e-9):
            assert reaches(a, b, least) == (exact >= least)
            seen.add(exact >= least)
    assert len(seen) == 2


def test_long_texts_are_decided_soon():
    rng = random.Random(5)
    a = " ".join("".join(rng.choices(LETTERS, k=6)) for _ in range(12000))
    b = a[:20000] + a[20500:60000] + a[61000:]
    began = time.process_time()
    assert reaches(a, a, 0.93) and not reaches(a, a[::-1], 0.93)
    reaches(a, b, 0.93)  # equal to the ratio by the test above, which takes long here
    assert time.process_time() - began < 5


def test_copies_make_few_links(spark):
    """A family of near copies is joined by one link a text, also where it is cut into cells."""
    rng = random.Random(8)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(3, 8))) for _ in range(300)]
    base, rows = rng.choices(words, k=60), []
    for k in range(60):
        w = [*base]
        w[rng.randrange(60)] = f"x{k}"
        rows.append((k, "b", " ".join(w)))
        rows.append((100 + k, "b", " ".join(rng.choices(words, k=60 + k % 5))))
    frame = spark.createDataFrame(rows, "id long, block string, norm string")
    for most in (2000, 25):
        links = r.ratio_links(frame, ["block"], "id", "norm", most=most).collect()
        parts = {x.id: x.component for x in r.block_components(spark.createDataFrame(links), frame, "id").collect()}
        assert all(parts[k] == (0 if k < 60 else k) for k, _, _ in rows)
        assert len(links) == 59 if most == 2000 else len(links) < 600


def test_contained_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {""}
    for size in [*range(1, 40), *range(40, 400, 7)] * 3:
        t = "".join(rng.choices("ab " if size < 12 else LETTERS, k=size))
        cut = rng.randint(0, size - int(size * 0.72))
        texts |= {t, t[cut : cut + int(size * 0.72)], t[: int(size * 0.72) - 1], t[cut:], t[1:-1], t * 2, t[:9] * 20}
    rows = [(i, i % 2, t) for i, t in enumerate(sorted(texts))]
    frame = spark.createDataFrame(rows, "id long, block long, norm string")
    want = sorted((i, j) for i, p, x in rows for j, q, y in rows if i < j and p == q and ((y in x and len(y) >= int(len(x) * 0.72)) or (x in y and len(x) >= int(len(y) * 0.72))))
    assert sorted((p.a, p.b) for p in r.contained_pairs(frame, ["block"], "id", "norm").collect()) == want and len(want) > 100


def test_keys_of_a_text_are_few():
    rng = random.Random(6)
    texts = ["".join(rng.choices(LETTERS, k=k)) for k in range(20, 3000, 13)]
    assert max(len(k) for k in r.run_keys(texts, 0.72)) < 30

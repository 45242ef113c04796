"""Best partners by what rows share: equal to brute force over many pieces, and not a table of pairs."""

import random
import time

from pyspark.sql import functions as F

from colophon.operators import joins as j
from colophon.operators import partners as p
from colophon.operators import relations as rel


def shared_most(rows, top, least):
    want = {}
    for i, t in rows:
        met = sorted((-len(t & u), k) for k, u in rows if k != i and len(t & u) >= least)[:top]
        want[i] = [(n + 1, k, -s) for n, (s, k) in enumerate(met)]
    return want


def test_pieces_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"r{i:03}é", {f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(0, 12))}) for i in range(300)]
    rows += [(f"copy{i}", {"w0", "w1", "w2", "w3"}) for i in range(40)] + [(f"long{i}", {f"w{k}" for k in range(i, 400)}) for i in range(3)]
    made = spark.createDataFrame([(i, sorted(t)) for i, t in rows], "id string, t array<string>")
    hashed = made.select("id", p.hashes(F.col("t"), 0).alias("t")).where("size(t) > 0")
    for piece in (40, 100_000):
        got = {i: [] for i, _ in rows}
        for r in p.best_partners(hashed, "id string, other string, rank int, key int", p.most_shared(4, 2), piece).collect():
            got[r.id].append((r["rank"], r.other, r.key))
        assert {k: sorted(v) for k, v in got.items()} == shared_most(rows, 4, 2)


def test_frequent_words_are_not_paired(spark):
    """9,000 rows share two words: 81 million pairs, which the join by prefixes had not made after 70 seconds."""
    rows = spark.range(9000).select("id", F.array(F.lit("that"), F.lit("with"), F.concat(F.lit("w"), (F.col("id") % 4500).cast("string"))).alias("t"))
    began = time.time()
    got = {(r.id, r["rank"]): (r.other, r.shared) for r in j.related(rows, "id", "t").collect()}
    assert time.time() - began < 60
    assert len(got) == 54_000 and got[5, 1] == (4505, 3) and got[4505, 1] == (5, 3)
    assert [got[5, k] for k in range(2, 7)] == [(k, 2) for k in (0, 1, 2, 3, 4)] and got[3, 5] == (4, 2)


def test_hashes_that_meet_are_seen(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z")], "kind string, v string")
    assert p.seed_apart(rows) == 0


NOTE = "dir string, stem string, category string, title string, authors array<string>, keywords array<string>, methods array<string>, regions array<string>, year string, journal_abbr string"


def topics_of(spark, rows):
    none = F.array().cast("array<string>")
    return rel.note_topics(spark.createDataFrame(rows, NOTE).select("*", none.alias("topics"), none.alias("tags"), F.lit("").alias("body")))


def related_by_pairs(notes, top=6):
    """What ``related_notes`` says, pair by pair."""
    out = {}
    for x in notes:
        met = []
        for y in notes:
            if x.id == y.id:
                continue
            both = {k: sorted(set(x[k]) & set(y[k])) for k in ("authors", "regions", "methods", "tokens")}
            words, near = len(both["tokens"]), x.dir == y.dir
            years = all(v.year.isdigit() and int(v.year) < 1 << 63 for v in (x, y)) and abs(int(x.year) - int(y.year)) <= 3
            score = 0.0
            for ok, w in ((both["authors"], 1.8), (both["regions"], 1.0), (both["methods"], 0.8), (words, min(1.8, 0.22 * words)), (x.journal_abbr and x.journal_abbr == y.journal_abbr, 0.2), (x.place == y.place, 0.22), (years, 0.08)):
                score += w if ok else 0.0
            strong = bool(both["authors"] or both["regions"] or both["methods"]) or words >= 2
            tier = 1 if score >= 1.0 or (strong and score >= 0.58) or (near and score >= 0.48) else 2 if score >= 0.35 and (strong or near) else None
            if tier:
                met.append((tier, -score, not near, y.id))
        met = sorted(met)[:top]
        out[x.id] = [(n + 1, t, -s, o) for n, (t, s, _, o) in enumerate(met) if t == met[0][0]]
    return out


def test_related_notes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    some = lambda values, most: rng.sample(values, rng.randint(0, most))
    words, rows = [f"word{chr(97 + k)}" for k in range(20)], []
    for i in range(260):
        # authors of few notes and of many, directories of one slug, notes that share nothing, and copies
        authors = some([f"Q. Auth{chr(97 + k)}" for k in range(9)], 2) if i % 3 else [f"Q. Only{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        one = (" ".join(some(words, 14)), authors if i % 5 else [], some(words, 2), some(["Case Study", "Survey"], 1) if i % 4 == 0 else [], some(["Kenya", "Peru", "Fiji"], 2) if i % 6 == 0 else [])
        title, authors, keywords, methods, regions = rows[-1][3:8] if i % 11 == 10 else one
        rows.append((rng.choice(["a b", "a_b", "c", "\u00e9"]), f"n{i}", "x", title, authors, keywords, methods, regions, rng.choice(["", "1990", "1992", "1996", "in press", "9223372036854775807", "99999999999999999999"]), rng.choice(["", "", "apsr", "ajps"])))
    topics = topics_of(spark, rows)
    want = related_by_pairs(rel.signatures(topics).collect())
    assert {t for w in want.values() for _, t, _, _ in w} == {1, 2}
    for first in (p.FIRST, 30):
        monkeypatch.setattr(p, "FIRST", first)
        got = {k: [] for k in want}
        for r in rel.related_notes(topics).collect():
            got[r.id].append((r["rank"], r.tier, r.score, r.other))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_notes_of_one_author_are_not_paired(spark):
    """9,000 notes of one author and directory: 40 million pairs, which were joined, scored and written one by one."""
    rows = [("d", f"n{i:04}", "d", f"title{chr(97 + i % 9)}", ["Q. Zed"], [], [], [], "2000", "apsr") for i in range(9000)]
    topics = topics_of(spark, rows)
    began = time.time()
    got = {(r.id, r["rank"]): r.other for r in rel.related_notes(topics).collect()}
    assert time.time() - began < 60
    assert len(got) == 54_000 and [got["d/n0009", k] for k in range(1, 7)] == [f"d/n{i:04}" for i in (0, 18, 27, 36, 45, 54)]

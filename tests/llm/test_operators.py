"""Operators against brute force, held-out accuracy and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from colophon.llm import queries
from colophon.llm.components import merged
from colophon.llm.decontaminate import FMIndex, contamination, decontaminated
from colophon.llm.hnsw import Graph, nearest
from colophon.llm.langid import fit_language, identify, without_rejected
from colophon.llm.mixing import Mix, mixed, mixture, split_quotas, targets
from colophon.llm.neardup import Banding, near_duplicates
from colophon.llm.pages import blocks, cost, extract, main_text, minimum_cut
from colophon.llm.quality import fit_quality, quality
from colophon.llm.substrings import Suffixes, multikey_order, repeats, without_repeats
from colophon.llm.tokens import default_vocabulary, field_token_counts, spans, token_counts
from colophon.llm.toxicity import fit_toxicity, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, tiny and long texts, repeated rows, ties, an extra column."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "x", "en", None, 1), (4, "12 34 !!", "en", "a", 8), (5, long, "en", "a", None),
        (6, "one two three four five six seven", "en", "b", 1), (6, "one two three four five six seven", "en", "b", 1), (7, "one two three four five six seven", None, "b", 1),
        (8, "é" * 120, "fr", "c", 1), (9, "é" * 120, "fr", "c", 1), (10, "a" * 500, "en", "c", 1), (11, "\x00    ", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "z") for r in rows], f"{DOCS}, a string")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_near(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("banding", [Banding(words=2), Banding(words=5), Banding(words=2, pivots=(), block=3)])
def test_near_duplicates_equal_brute_force(spark, docs, banding):
    assert near_rows(near_duplicates(docs, banding)) == brute_near([(r.doc_id, r.text) for r in docs.collect()], banding.words)


def test_near_duplicates_of_one_large_family(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(near_duplicates(df, Banding(words=2))) == brute_near(rows, 2)


def test_near_duplicates_odd(odd):
    got = near_duplicates(odd, Banding(words=2))
    assert got.count() == odd.count()
    assert near_rows(got) == brute_near([(r.doc_id, r.text) for r in odd.collect()], 2)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.label for r in merged(None, edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    more = merged(merged(None, edges), spark.createDataFrame([(5, 101), (200, 201)], "a long, b long"))
    assert {r.label for r in more.collect()} == {0, 200}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_contamination(rows, items, k=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    found |= x
                    hit.update(range(j, j + n))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [200_000, 300])
def test_contamination_equals_brute_force(spark, docs, block):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(39).union(spark.createDataFrame([(900, "the of"), (901, None), (902, "  "), (903, "the of")], "item_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(docs, items, block=block).collect())
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[2] for x in got)


def test_contamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "two three four"), (2, "a" * 500), (3, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(odd, items).collect())
    assert got == brute_contamination([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    left = decontaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert not any(x[2] for x in brute_contamination([(r.doc_id, r.text) for r in left.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert contamination(odd, items.limit(0)).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("block", [200_000, 4])
def test_contamination_keeps_repeated_and_null_ids(spark, block):
    rows = [(1, "a b c d e"), (1, "f g h i"), (1, "a b c d e"), (None, "a b c"), (None, "f g h"), (2, None)]
    items = spark.createDataFrame([(1, "a b c"), (2, "f g h"), (3, "c d")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), items, block=block).collect())
    assert got == [(0, 3, 3, [1]), (0, 3, 3, [2]), (1, 4, 3, [2]), (1, 5, 4, [1, 3]), (1, 5, 4, [1, 3]), (2, 0, 0, [])]


@pytest.mark.parametrize("block", [200_000, 12, 1])
def test_decontaminated_does_not_depend_on_blocks(spark, block):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(["x", *w[20:29]])), (4, "p q")]
    texts = [" ".join(w[:15]), " ".join(["a", *w[:15], "b"]), " ".join(["x", *w[:10], *w[20:29]]), " ".join(["p", *w[:10], "q"]), "clean", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in decontaminated(rows, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()}
    assert {d: words(t) for d, t in left.items()} == {0: [], 1: ["a", "b"], 2: ["x", *w[20:29]], 3: ["p", "q"], 4: ["clean"], 5: []}


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 300)
    index = FMIndex(text, 3, sample=5)
    for k in (1, 3):
        for p in {tuple(text[i : i + k]) for i in range(50)} - {p for p in [(0,)]}:
            lo, hi = index.search(np.array([p]))
            want = [i for i in range(len(text) - k + 1) if tuple(text[i : i + k]) == p]
            assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def brute_repeats(rows, k=100):
    seen, out = set(), {}
    for d, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if b[i : i + k] in seen:
                cut[i : i + k] = b"\x01" * k
            seen.add(b[i : i + k])
        runs = sum(1 for i in range(len(b)) if cut[i] and (not i or not cut[i - 1]))
        out[d] = (len(b), sum(cut), runs, hashlib.sha256(bytes(c for c, x in zip(b, cut, strict=True) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("p", [Suffixes(), Suffixes(bucket=2000, context_bucket=300, hot=10, sample=100), Suffixes(hot=1, sample=200)])
def test_repeats_equal_brute_force(docs, p):
    assert {r[0]: tuple(r[1:]) for r in repeats(docs, p).collect()} == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_odd(spark, odd):
    got = repeats(odd)
    assert got.count() == odd.count()
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    left = without_repeats(odd)
    assert left.columns == odd.columns
    assert 9 not in [r.doc_id for r in left.collect()]


def test_multikey_order():
    rng = np.random.default_rng(2)
    size = rng.integers(0, 21, 400)
    rows = rng.integers(0, 2, (400, 20)).astype(np.uint8)
    rows[:200, :17] = rows[0, :17]
    rows[np.arange(20)[None, :] >= size[:, None]] = 0
    order, common = multikey_order(rows, size)
    keys = [rows[i].tobytes() for i in order]
    assert keys == sorted(keys)
    for k in range(1, 400):
        a, b = rows[order[k - 1]][: size[order[k - 1]]], rows[order[k]][: size[order[k]]]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert common[k] == same


def test_language(spark, docs, odd):
    model = fit_language(docs)
    got = identify(docs, model).where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    found = {r.doc_id: r for r in identify(odd.select("doc_id", "text"), model).collect()}
    assert all(found[d].lang_pred == "und" and found[d].lang_rejected for d in (1, 2, 4, 11)) and all(0 <= r.lang_score <= 1 for r in found.values())
    kept = without_rejected(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 4, 11} & {r.doc_id for r in kept.collect()}
    none = fit_language(docs.limit(0))
    assert {r.lang_pred for r in identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert without_rejected(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("fit, score, column", [(fit_toxicity, toxicity, "toxic"), (fit_quality, quality, "quality")])
def test_scores(spark, odd, fit, score, column):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = fit(docs, labels)
    got = [(r.score, r[column]) for r in score(docs, model).join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    high, low = [s for s, y in got if y], [s for s, y in got if not y]
    assert np.mean([a > b for a in high for b in low]) > 0.8
    rows = score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = fit(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in score(docs.limit(5), nothing).collect())
    nulls = labels.selectExpr("doc_id", "cast(null as int) as quality", "cast(null as int) as toxic")
    fit(docs, nulls)
    assert score(docs.limit(0), model).count() == 0


def test_targets():
    assert targets([100, 100, 100], (5, 2, 1), 3) == [187.5, 75.0, 37.5]
    got = targets([10, 1000, 1000], (5, 2, 1), 3)
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert targets([0, 5], (5, 2, 1), 3) == [0.0, 5.0] and targets([], (5,), 3) == []


def test_split_quotas():
    units = np.array([17, 0, 5, 40])
    q = split_quotas(units, 7, np.random.default_rng(1))
    assert (q.sum(axis=1) == units).all() and q.sum(axis=0).max() - q.sum(axis=0).min() <= 1 and (q >= 0).all()


def test_mixture(spark, docs, odd):
    got = mixture(docs)
    rows = got.collect()
    assert len(rows) == 200 and sorted(mixture(docs).collect()) == sorted(rows)
    by = {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.shards) == r.copies
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        smallest = min(r.size for r in group)
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(smallest, 0.05 * group[0].target)
    out = mixed(docs, Mix(shards=4))
    assert out.count() == sum(r.copies for r in mixture(docs, Mix(shards=4)).collect())
    assert mixture(odd).count() == odd.count() and mixture(docs.limit(0)).count() == 0
    small = mixture(docs, Mix(pack=3)).collect()  # many levels of blocks
    for source, group in by.items():
        total = sum(r.taken for r in small if r.source == source)
        assert abs(total - group[0].target) <= max(r.size for r in group)  # what one block of few rows can be off


def test_token_counts(spark, docs, odd):
    v = default_vocabulary()
    for r in token_counts(docs.limit(20)).join(docs, "doc_id").collect():
        assert r.n_tokens == sum(r.section_tokens) and r.n_bytes == len(r.text.encode()) and r.n_sections == len(r.section_tokens)
    text = "Café <|endoftext|>\n\n  two lines\nlast"
    at = spans(text, v)
    assert at[-1] == len(text.encode()) and (np.diff(at) > 0).all()
    assert token_counts(odd).count() == odd.count()
    rows = spark.createDataFrame([(1, "title", None), (2, None, None)], "k long, t string, b string")
    got = {r.k: r for r in field_token_counts(rows, "k", ["t", "b"]).collect()}
    assert got[1].n_sections == 2 and sum(got[1].section_tokens) == got[1].n_tokens


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])], "vec_id long, embedding array<float>")
    copies = rows.where("vec_id = 50").selectExpr("explode(sequence(8000, 8040)) as vec_id", "embedding")
    every = rows.unionByName(bad).unionByName(copies)
    got = {}
    for r in nearest(every, every.where("vec_id % 50 = 0 OR vec_id > 9000"), 5, Graph(shard=200, block=4)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.unionByName(copies).collect()}
    hits = total = 0
    for q in [q for q in table if q % 50 == 0]:
        def cos(i):
            return float(table[i] @ table[q] / np.linalg.norm(table[i]) / np.linalg.norm(table[q]))
        want = sorted(((-round(cos(i), 9), i) for i in table if i != q))[:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and all(abs(s - cos(i)) < 1e-9 for _, i, s in mine)
        hits += len({i for _, i in want} & {i for _, i, _ in mine})
        total += 5
    assert hits / total >= 0.95
    assert [x[1] for x in got[9006]] == [9007] and not {9001, 9002, 9003, 9004, 9005} & set(got)
    assert nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_nearest_tells_close_points_apart(spark):
    rng = np.random.default_rng(6)
    q, v = rng.normal(size=(2, 16))
    rows = [(0, q.tolist())] + [(1 + j, (v + 3e-10 * ((j * 17) % 40) * q).tolist()) for j in range(40)]
    rows += [(100 + j, x.tolist()) for j, x in enumerate(rng.normal(size=(100, 16)) - 2 * q)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest(table, table.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [1 + j for j in sorted(range(40), key=lambda j: -((j * 17) % 40))[:5]]


def test_pages(spark):
    page = (
        "<html><head><title>T</title><script>if (a<b) {}</script></head><body><div class='cookie-notice'><p>We use cookies on this site to make it better for you.</p></div>"
        "<nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>First <b>bold</b>\n para, and it goes on for a while.<p>Second</p><aside>See also</aside></article>"
        "<div id=comments><p>A reader says that this is a long comment, about nothing.</p></div><footer>c</footer></body></html>"
    )
    assert main_text(page) == "Head & more\nFirst bold para, and it goes on for a while.\nSecond"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert [b.text for b in blocks("a<br>b<p>c<p>d</div>&lt;x&gt;")] == ["a b", "c", "d", "<x>"]
    rows = spark.createDataFrame([(1, None, None), (2, "u", page), (2, "u", page), (3, "v", "<<<>>")], "page_id long, url string, html string")
    got = extract(rows).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)


def test_words_of_a_block_are_counted_beyond_a_long_first_one():
    for n in (10, 25):
        late, early = blocks(f"<p>{'a' * 500}{' word' * n}")[0], blocks(f"<p>{'word ' * n}{'a' * 500}")[0]
        assert cost(late) == cost(early)


def test_minimum_cut_equals_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        z = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def total(labels, z=z, edges=edges):
            return sum(max(-x, 0) if y else max(x, 0) for x, y in zip(z, labels, strict=True)) + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(total([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(total(minimum_cut(z, edges)) - best) < 1e-9


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_query_has_its_columns(spark, name):
    want = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id held_out lang_pred score", "op3": "doc_id held_out score predicted", "op4": "doc_id n_shingles component_id kept",
        "op5": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6": "doc_id size source_size target taken", "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op8": "doc_id n_tokens", "op9": "query_id rank vec_id score", "op10": "page_id url text n_chars",
    }[name.split("_")[0]]
    assert set(want.split()) <= set(queries.queries()[name](spark, SF).columns)


def test_pipeline(spark, odd, docs):
    import corpus_pipeline

    at = docs.withColumn("lang_pred", docs.lang)  # an extra column with a clashing name
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, at, SF)
        if name != "mixing":
            assert nxt.columns == at.columns
        if name == "near_dedup":
            want = {d for d, x in brute_near([(r.doc_id, r.text) for r in at.collect()], 5).items() if x[2]}
            assert {r.doc_id for r in nxt.collect()} == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x[2] for x in brute_contamination([(r.doc_id, r.text) for r in nxt.collect()], items))
        at = nxt
    for rows in (odd, docs.limit(0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        at.count()

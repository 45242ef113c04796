"""The dealt methods themselves: what they are worth, that they are what decides, odd inputs, and brute force."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, SF, brute_contamination, brute_near, brute_repeats, docs, odd  # noqa: F401

from colophon.llm import pagefit, pages
from colophon.llm.decontaminate import contamination, decontaminated
from colophon.llm.hnsw import Graph, nearest
from colophon.llm.langid import fit_language, identify, without_rejected
from colophon.llm.mixing import Mix, mixed, mixture, nearest_documents, nearest_subset
from colophon.llm.neardup import Banding, near_duplicates
from colophon.llm.pages import extract, labelled, main_text
from colophon.llm.quality import fit_quality, quality, statistics
from colophon.llm.substrings import Suffixes, repeats, without_repeats
from colophon.llm.tokens import default_vocabulary, encoder, token_counts
from colophon.llm.toxicity import fit_toxicity, label_model, toxicity

BIG = "/root/testdata/sf0.01"


def frame(spark, rows, extra="doc_id long, text string"):
    return spark.createDataFrame(rows, extra)


# toxicity: the label model


def votes(rng, n=4000, prior=0.2):
    """Ten voters of different accuracy, five of them copies of one bad one, and the hidden label."""
    y = rng.random(n) < prior
    rates = [(0.7, 0.02), (0.5, 0.01), (0.6, 0.05), (0.3, 0.01), (0.2, 0.02)]
    own = np.column_stack([rng.random(n) < np.where(y, a, b) for a, b in rates])
    bad = rng.random(n) < np.where(y, 0.4, 0.3)
    copies = np.column_stack([bad ^ (rng.random(n) < 0.02) for _ in range(5)])
    return np.concatenate([own, copies], axis=1), y.astype(int)


def test_label_model_beats_a_majority_and_needs_no_label_of_the_text():
    x, y = votes(np.random.default_rng(1))
    given = np.where(np.arange(len(y)) < 400, y, -1)
    post, rates, corr = label_model(x, given, 0.2)
    rest = given < 0
    loss = lambda p: -np.where(y == 1, np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1)))[rest].mean()
    assert loss(post) < 0.7 * loss(np.clip(x.mean(axis=1), 0.01, 0.99))  # the share of voters that fire
    assert ((post > 0.5) == y)[rest].mean() > max(((x.sum(axis=1) >= k) == y)[rest].mean() for k in range(1, 10))
    assert corr[5, 6] > 0.8 and abs(corr[0, 1]) < 0.3
    # a posterior comes from the votes: a known label changes nothing beyond the counts
    same = [i for i in range(400) if (x[i] == x[0]).all()]
    assert len({round(float(post[i]), 12) for i in same}) == 1
    # and discounting correlated voters is worth something
    z = np.log(rates[1] / rates[0]) - np.log((1 - rates[1]) / (1 - rates[0]))
    plain = 1 / (1 + np.exp(-(np.log(0.25) + np.log((1 - rates[1]) / (1 - rates[0])).sum() + x @ z)))
    assert loss(post) < loss(plain)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = fit_toxicity(docs, labels)
    rows = toxicity(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    found, wrong = sum(r.score >= 0.7 and r.toxic == 1 for r in rows), sum(r.score >= 0.7 and r.toxic == 0 for r in rows)
    assert found >= 0.7 * sum(r.toxic for r in rows) and wrong <= 0.05 * len(rows)
    assert sorted(toxicity(docs, fit_toxicity(docs, labels)).collect()) == sorted(toxicity(docs, model).collect())


# quality: the rules


def test_compiled_rules_equal_the_rules(spark, docs):  # noqa: F811
    big, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = fit_quality(big, labels)
    assert model.rules and len(model.rules) <= 60 and all(1 <= len(r.terms) <= 3 for r in model.rules)
    stats = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text_")).select("doc_id", *(c.alias(k) for k, c in statistics().items())).toPandas().sort_values("doc_id")
    x = {k: stats[k].to_numpy(float) for k in statistics()}
    z = model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True))
    got = {r.doc_id: r.score for r in quality(docs, model).collect()}
    assert np.allclose([got[d] for d in stats["doc_id"]], 1 / (1 + np.exp(-z)))
    held = quality(big, model).join(labels.where("quality IS NOT NULL"), "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.9


# language


def test_identify_replaces_columns_of_its_names(spark, docs):  # noqa: F811
    model = fit_language(docs)
    rows = docs.withColumn("Lang_Pred", F.lit(7)).withColumn("letters_", F.lit("x")).withColumn("lang_rejected", F.lit(None).cast("string"))
    got = identify(rows, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "letters_", "lang_pred", "lang_score", "lang_rejected"]
    assert sorted((r.doc_id, r.lang_pred) for r in got.collect()) == sorted((r.doc_id, r.lang_pred) for r in identify(docs, model).collect())
    kept = {r.doc_id for r in without_rejected(docs, model).collect()}
    assert kept == {r.doc_id for r in identify(docs, model).where("NOT lang_rejected").collect()}
    assert without_rejected(rows, model).columns == rows.columns


# mixing


def test_nearest_subset_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 40) for _ in range(rng.randint(0, 9))], np.int64)
        rest = rng.uniform(0, 150)
        got = sizes[nearest_subset(sizes, rest)].sum()
        want = min((sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes.tolist(), k)), key=lambda s: (abs(rest - s), s))
        assert got == want
    for _ in range(50):  # more documents than are tried in all combinations
        sizes = np.array([rng.randint(0, 3000) for _ in range(rng.randint(17, 300))], np.int64)
        rest = rng.uniform(0, sizes.sum())
        gap = abs(rest - sizes[nearest_documents(sizes, rest)].sum())
        assert gap <= np.sort(sizes[sizes > 0])[:16].max() / 2 + 1


@pytest.mark.parametrize("mix", [Mix(), Mix(pack=80, few=8), Mix(shards=3, few=1)])
def test_a_mix_is_what_its_shards_draw(spark, mix):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = mixture(docs, mix).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.taken == r.size * len(r.shards) <= 3 * r.size and all(0 <= s < mix.shards for s in r.shards)
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= (2 if mix.few == 64 else max(r.size for r in group))
    # every shard has about its part of every source
    for group in by.values():
        drawn = [s for r in group for s in r.shards]
        share = np.bincount(drawn, minlength=mix.shards) / max(1, len(drawn))
        assert len(drawn) < 40 or share.max() < 3 / mix.shards
    assert sorted(map(repr, mixture(docs, mix).collect())) == sorted(map(repr, rows))


def test_mixed_keeps_repeated_rows_and_null_ids(spark):
    rows = [(i % 10, "w " * (i % 10 + 1), "s") for i in range(30)] + [(None, "a b c", "t")] * 2 + [(7, "x y", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Shard", F.lit("own"))
    plan = mixture(table).collect()
    assert len(plan) == len(rows)
    out = mixed(table).collect()
    assert len(out) == sum(r.copies for r in plan)
    assert sum(r.size for r in out) == sum(r.taken for r in plan)
    for d in range(10):  # rows of one document share its draws
        assert len({tuple(r.shards) for r in plan if r.doc_id == d and r.source == "s"}) == 1
    assert {r.shard for r in out} <= set(range(16))


# near duplicates, substrings, contamination: rows that share an id, and empty tables


def test_rows_of_one_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, b), (8, a + " x"), (9, "c d"), (None, a), (None, "")]
    for order in (rows, rows[::-1]):
        got = near_duplicates(frame(spark, order), Banding(words=2)).collect()
        assert len(got) == 7
        by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
        assert by[7, 59] == 5 and by[5, 59] == 5 and by[9, 1] == 9 and by[None, 59] is None
        first = sorted(map(repr, got))
    assert first == sorted(map(repr, near_duplicates(frame(spark, rows), Banding(words=2)).collect()))
    seen = []
    for order in (rows, rows[::-1]):
        got = repeats(frame(spark, order)).collect()
        assert len(got) == 7
        seen.append(sorted(map(repr, got)))
        kept = [r for r in got if r.doc_id is None]
        assert all(r.n_removed == 0 for r in kept)
    assert seen[0] == seen[1]


def test_empty_tables(spark, docs):  # noqa: F811
    none, items = docs.limit(0), frame(spark, [], "item_id long, text string")
    for got, columns in (
        (near_duplicates(none), ["doc_id", "n_shingles", "component_id", "kept"]), (contamination(none, items), ["doc_id", "n_words", "n_hit", "items", "spans"]),
        (repeats(none), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]), (token_counts(none), ["doc_id", "n_bytes", "n_tokens", "n_sections", "n_crossing", "section_tokens"]),
        (mixed(none), [*docs.columns, "size", "source_size", "target", "taken", "copy", "shard", "place"]), (without_repeats(none), docs.columns), (decontaminated(none, items), docs.columns),
        (extract(frame(spark, [], "page_id long, url string, html string")), ["page_id", "url", "text", "n_chars"]),
        (nearest(frame(spark, [], "vec_id long, embedding array<float>"), frame(spark, [], "vec_id long, embedding array<float>")), ["query_id", "rank", "vec_id", "score"]),
    ):
        assert got.columns == columns and got.collect() == []


def test_extra_columns_that_clash(spark, docs):  # noqa: F811
    names = ["h", "g", "n", "id", "s", "a", "b", "label", "key", "pos", "wide", "m", "c", "y", "e", "p", "text_", "f0_", "sk__", "rest__", "size", "target", "shards", "u__", "own_id__x", "items", "spans", "copy"]
    rows = docs.limit(60)
    wide = rows.select("*", *(F.lit("own").alias(k) for k in names))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for op in (lambda d: near_duplicates(d, Banding(words=2)), repeats, lambda d: contamination(d, items).drop("spans"), token_counts, mixture):
        assert sorted(map(repr, op(wide).collect())) == sorted(map(repr, op(rows).collect()))
    assert without_repeats(wide).columns == decontaminated(wide, items).columns == wide.columns
    assert {r["key"] for r in mixed(wide).collect()} == {"own"}


@pytest.mark.parametrize("p", [Suffixes(held=400, hot=5, sample=50, bucket=700, context_bucket=90, ranges=3), Suffixes(held=100, hot=2, sample=30)])
def test_repeats_in_hot_passages(spark, p):
    """A line in every text, short of a repeat on its own, a passage in half of them, near copies and runs of one byte."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7)))
    line, passage, base = " ".join(word() for _ in range(16))[:80], " ".join(word() for _ in range(60)), [word() for _ in range(120)]
    rows = []
    for d in range(120):
        own = [" ".join(word() for _ in range(20)), line, " ".join(word() for _ in range(6))]
        if d % 2:
            own.append(passage)
        if d % 5 == 0:
            near = list(base)
            near[rng.randrange(120)] = word()
            own.append(" ".join(near))
        if d % 11 == 0:
            own.append("é" * rng.randint(40, 200))
        rng.shuffle(own)
        rows.append((d, "\n".join(own)))
    assert {r[0]: tuple(r[1:]) for r in repeats(frame(spark, rows), p).collect()} == brute_repeats(rows)


# tokens


def test_token_counts_equal_a_count_token_by_token(spark, docs):  # noqa: F811
    v = default_vocabulary()
    encoding, _ = encoder(v)
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(1001, "é\n\n  x\n\n\ny" * 9), (1002, "\n"), (1003, None), (1004, ""), (1005, "a" * 5000)]
    got = {r.doc_id: r for r in token_counts(frame(spark, rows)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        starts = [0] * bool(raw) + [i + 1 for i in range(len(raw) - 1) if raw[i] == 10]
        counts, crossing, at = [0] * len(starts), 0, 0
        for token in encoding.encode_ordinary(t or ""):
            size = len(encoding.decode_single_token_bytes(token))
            line = sum(s <= at for s in starts) - 1
            counts[line] += 1
            crossing += sum(s <= at + size - 1 for s in starts) - 1 != line
            at += size
        r = got[d]
        assert (r.n_bytes, r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == (len(raw), sum(counts), len(starts), crossing, counts)


# pages


def test_weights_are_those_of_the_fit():
    assert pagefit.fit() == pages.WEIGHTS


def test_the_cut_is_worth_more_than_the_classifier_alone():
    rng = random.Random(99)
    held = [pagefit.synthetic_page(rng) for _ in range(150)]

    def right(near):
        return sum(all((b.text in main) == kept for b, kept in labelled(page, near)) for page, main in held)

    assert right(1.0) > 1.05 * right(0.0)


def test_neighbours_decide_where_nothing_is_named():
    prose = "This is a sentence of a long article that goes on for quite a while, with commas, and ends here at last."
    body = "</div><div>".join([prose, prose, "Yes", prose, prose])
    page = f"<div><div>{body}</div></div><div><div><a href=x>Yes</a></div><div><a href=y>No</a></div></div>"
    assert main_text(page) == "\n".join([prose, prose, "Yes", prose, prose])
    assert [k for b, k in labelled(page, 0.0) if b.text == "Yes"] == [False, False]


def test_pages_in_linear_time():
    for part in ("<a ", "<div>x", "<!-- ", '<p b="', "<svg/>x", "<li>a<p>b", "</section>", "<b><p>x</b>", "<![CDATA[", "& <"):
        times = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            main_text("<div>" * (n // 4) + part * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 4 and times[1] < 12 * times[0] + 0.3, part
    text = "Words of a paragraph, as long as they come. " * 25_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


# contamination: long items and texts, many blocks


def test_contamination_of_long_texts(spark):
    w = [f"w{i % 700}" for i in range(40_000)]
    items = [(1, " ".join(w[100:140])), (2, " ".join(w[39_000:39_020])), (3, "zz"), (4, " ".join(w[:9]))]
    rows = [(1, " ".join(w)), (2, "zz ZZ zz"), (3, "")]
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(frame(spark, rows), frame(spark, items, "item_id long, text string"), block=30).collect())
    assert got == brute_contamination(rows, items)


# nearest


def test_nearest_over_many_shards(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(table, table.where("vec_id % 50 = 0"), 5, Graph(shard=300, block=8, search_beam=64)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for _, i in got[q]})
    assert hits >= 0.9 * 150


# the pipeline, stage by stage


def test_pipeline_stages_against_brute_force(spark, docs):  # noqa: F811
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    model = fit_language(docs)
    at = stages["language"](spark, docs, SF)
    assert {r.doc_id for r in at.collect()} == {r.doc_id for r in identify(docs, model).where("NOT lang_rejected").collect()}
    deduped = stages["near_dedup"](spark, at, SF)
    assert {r.doc_id for r in deduped.collect()} == {d for d, x in brute_near([(r.doc_id, r.text) for r in at.collect()], 5).items() if x[2]}
    cut = {r.doc_id: r.text for r in stages["substring_dedup"](spark, deduped, SF).collect()}
    want = brute_repeats([(r.doc_id, r.text) for r in deduped.collect()])
    for r in deduped.collect():
        size, removed, _, _ = want[r.doc_id]
        assert len(cut.get(r.doc_id, "").encode()) == size - removed or removed  # a character cut in half goes with it
        assert (r.doc_id in cut) == (size > removed) or removed
        if not removed:
            assert cut[r.doc_id] == r.text
    last = stages["mixing"](spark, deduped, SF)
    plan = {(r.doc_id, r.source): r for r in mixture(deduped).collect()}
    rows = last.collect()
    assert set(deduped.columns) < set(last.columns)
    for r in rows:
        assert r.shard == plan[r.doc_id, r.source].shards[r["copy"]] and r.text is not None
    assert len(rows) == sum(len(p.shards) for p in plan.values())


def test_arrow_limits_are_lowered_and_never_raised(spark):
    from colophon.llm.common import arrow

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        rows = spark.range(40).repartition(1)
        sizes = rows.transform(arrow, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) == 7 and spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_no_word_of_a_query_is_a_subset():
    """Queries read whole tables."""
    import inspect

    from colophon.llm import queries

    text = inspect.getsource(queries)
    assert not re.search(r"\.limit\(|\.sample\(|\.head\(", text) and DOCS

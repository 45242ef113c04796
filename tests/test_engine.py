"""Sources, sinks, note files and workflows on literal cases."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colophon import __main__ as command
from colophon.functions import bib
from colophon.functions import text as x
from colophon.functions.names import journal_code, source_code, unknown_journal
from colophon.operators import adapters as ad
from colophon.operators import citations as oc
from colophon.operators import discovery as d
from colophon.operators import joins as j
from colophon.operators import notefiles as nf
from colophon.operators import publish as pb
from colophon.operators import relations as rel
from colophon.operators import workflows as wf
from colophon.operators.references import canonical
from colophon.sources import paged, readers, writers


def one(spark, c, kind="string"):
    return spark.range(1).select(c.cast(kind).alias("v")).first().v


def read(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


# sinks


def test_csv_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["y", "x"]), ('b"c', [])], "k string, s array<string>")
    writers.write_csv(rows.limit(0), str(tmp_path / "none"), one_file=True)
    assert read(tmp_path / "none") == ""
    writers.write_csv(rows.limit(0), str(tmp_path / "fixed"), fixed=True)
    assert read(tmp_path / "fixed") == "k,s\n"
    writers.write_csv(rows, str(tmp_path / "some"), one_file=True)
    back = readers.csv_rows(spark, str(tmp_path / "some"))
    assert [tuple(r) for r in back.collect()] == [("a", "x; y"), ('b"c', None)]


def test_jsonl_lines_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([("é", ["b", "a"])], "k string, s array<string>")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert read(tmp_path / "j") == '{"k":"é","s":["a","b"]}\n'
    writers.write_lines(rows, "k", str(tmp_path / "l"))
    assert read(tmp_path / "l") == "é\n"
    found = spark.createDataFrame([("yes",), ("no",), ("no",)], "downloaded string")
    writers.write_summary(pb.discovery_summary(found, {"prefix": "p", "keywords": ["a", "b"], "year_cutoff": None}), str(tmp_path / "s"))
    assert json.loads(read(tmp_path / "s")) == {"prefix": "p", "keywords": ["a", "b"], "year_cutoff": None, "total_candidates": 3, "downloaded_rows": 1, "metadata_only_rows": 2}
    writers.write_bibliography(spark.createDataFrame([("b", "@b"), ("a", "@a")], "key string, entry string"), str(tmp_path / "b"))
    assert read(tmp_path / "b") == "@a\n\n@b\n\n"


# sources


def test_readers(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"id": "W1", "doi": "https://doi.org/10.1/A", "abstract_inverted_index": {"b": [2], "a": [0]}}\n')
    works = ad.captured_works(readers.works(spark, str(tmp_path / "w.json"))).collect()
    assert [(r.id, r.doi, r.abstract, r.authors, r.landing) for r in works] == [("W1", "https://doi.org/10.1/A", "a  b", [], "https://doi.org/10.1/A")]
    (tmp_path / "i.json").write_text('{"DOI": "10.1/X", "title": ["T"], "published-print": {"date-parts": [[0]]}, "issued": {"date-parts": [[1999, 5]]}, "link": [{"URL": "u", "content-type": "application/pdf"}]}\n')
    items = readers.items(spark, str(tmp_path / "i.json")).withColumn("item_id", F.lit(1))
    assert ad.item_metadata(items, "item_id", F.lit(""), F.lit(True)).select("title", "year", "entry_type").collect() == [("T", "1999", "phdthesis")]
    assert [r.publication_date for r in ad.item_works(items).collect()] == ["0"]
    (tmp_path / "p.csv").write_text("﻿code,display_name,filename_slug,title_aliases\nA,Annals,annals,x; y ;\n,No code,n,\n")
    got = readers.pending_sources(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.code, r.title_aliases, r.publisher) for r in got] == [("A", ["x", "y"], "")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    assert readers.file_hashes(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")


def test_note_headers(spark, tmp_path):
    notes = {"a.md": "---\ntitle: A é\nauthors:\n- X\n- Y\nyear: 2001\nempty:\n---\nBody\n", "bad.md": "---\n: [\n---\nKept\n", "_skip.md": "x", "none.md": "", "plain.md": "No header"}
    for name, text in notes.items():
        (tmp_path / name).write_text(text)
    got = {Path(r.path).name: r for r in readers.headers(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "bad.md", "plain.md"}
    assert got["a.md"].header == {"title": "A é", "authors": '["X", "Y"]', "year": "2001", "empty": None} and got["a.md"].body == "Body\n"
    assert got["bad.md"].header == {} and got["bad.md"].body == "Kept\n" and got["plain.md"].body == "No header"
    back = spark.createDataFrame([('{"title": "A é", "n": [1, 2]}',)], "h string").select(readers.header_yaml("h").alias("y")).first().y
    assert back == "---\ntitle: A é\nn:\n- 1\n- 2\n---\n"


def test_collections_and_folder_names(spark):
    files = spark.createDataFrame([("A b/x.pdf",), ("Notes/y.pdf",), ("C/sub/z.pdf",), (".d/q.pdf",), ("E_f/x.pdf",), ("top.pdf",)], "path string")
    known = spark.createDataFrame([("E_f", "Effs", "Eff", "e.bib")], "pdf_dir string, note_dir string, category string, bib_name string")
    got = sorted(tuple(r) for r in readers.collections(files, known).collect())
    assert got == [("A b", "A b", "A b", "a_b.bib", "auto"), ("E_f", "Effs", "Eff", "e.bib", "explicit")]
    assert [r.pdf_dir for r in readers.collections(files, known, ["E f"]).collect()] == ["E_f"] == [r.pdf_dir for r in readers.collections(files, known, ["Eff"]).collect()]
    names = readers.folder_names(readers.collections(files, known)).collect()
    assert sorted((r.folder, r.pdf_dir) for r in names) == [("A b", "A b"), ("E_f", "E_f"), ("Eff", "E_f"), ("Effs", "E_f")]


def test_paging_stops():
    asked = []

    def load(page):
        asked.append(page)
        return {"results": [1] * (2 if page < 3 else 1), "meta": {"count": 5}}

    assert [len(p) for p in paged.numbered(load, 2)] == [2, 2, 1] and asked == [1, 2, 3]
    assert list(paged.numbered(lambda p: {"results": []})) == [] == list(paged.cursored(lambda c: {}))
    pages = {"*": ([1], "b"), "b": ([2], "b")}
    assert list(paged.cursored(lambda c: {"message": {"items": pages[c][0], "next-cursor": pages[c][1]}})) == [[1], [2]]


def test_session_and_politeness():
    answers, slept = [(503, {}, b""), OSError("lost"), (200, {}, b'{"a": 1}')], []

    def send(url):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    assert paged.Session(send, sleep=slept.append).json("http://h/x") == {"a": 1} and slept == [1.0, 2.0]
    answers[:] = [(500, {}, b"")] * 3
    with pytest.raises(OSError, match="HTTP 500"):
        paged.Session(send, tries=2, sleep=slept.append).json("http://h/x")
    log, clock = [], iter([0.0, 0.0, 0.4, 0.4, 10.0, 10.0])
    pages = {"http://h/robots.txt": (200, {}, b"User-agent: *\nDisallow: /no"), "http://h/a": (200, {}, b""), "http://h/b": (429, {"Retry-After": "7"}, b""), "http://g/robots.txt": (404, {}, b"")}
    polite = paged.Politeness(paged.Session(lambda u: pages[u], tries=0, sleep=log.append), clock=lambda: next(clock))
    assert polite.allowed("http://h/a") and not polite.allowed("http://h/no/x") and polite.allowed("http://g/any")
    polite.get("http://h/a")
    polite.get("http://h/b")
    assert log == [pytest.approx(0.7), 7.0]


def test_configuration():
    text = 'prefix = "p"\noutput_dir = "out"\nkeywords = [" law ", ""]\ndiscovery_strategies = ["search"]\nscholar_csv_paths = ["/abs.csv", "rel.csv"]\n'
    got = paged.configuration(text, "/root", {"match_mode": "all", "year_cutoff": None})
    assert (got["keywords"], got["search_queries"], got["match_mode"], got["output_dir"], got["scholar_csv_paths"]) == (["law"], ["law"], "all", "/root/out", ["/abs.csv", "/root/rel.csv"])
    assert got["openalex_discovery_strategies"] == ["search"] and got["download_workers"] == 8
    for bad in ('prefix="p"\noutput_dir="o"\nkeywords=[]', 'prefix="p"\noutput_dir="o"\nkeywords=["a"]\nmatch_mode="some"', 'prefix="p"\noutput_dir="o"\nkeywords=["a"]\ndiscovery_providers=["x"]'):
        with pytest.raises(ValueError):
            paged.configuration(bad)


# functions


def test_identifiers_and_indexes(spark):
    assert one(spark, ad.first_doi(F.lit("none"), F.lit("x10.1234/aB.;) y"), F.lit("10.9999/z"))) == "10.1234/ab"
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(3)), F.lit("b"), F.array(F.lit(3), F.lit(1)))
    assert one(spark, x.rebuilt_abstract(index)) == "a b  b"
    assert one(spark, x.rebuilt_abstract(F.lit(None).cast("map<string,array<int>>"))) == ""
    assert one(spark, bib.bib_url(F.lit("http://dx.doi.org/10.1/A/"), F.lit("10.1/a"), F.lit("misc"))) == ""
    assert one(spark, bib.bib_url(F.lit("http://x/ "), F.lit("10.1/a"), F.lit("techreport"))) == "http://x/"
    assert one(spark, bib.bib_url(F.lit("http://x/"), F.lit(""), F.lit("article"))) == ""
    assert one(spark, unknown_journal(F.lit(" Annals &amp; X "))) == "annals_x" and one(spark, source_code(F.lit("The Law & Society"))) == "LS"
    assert one(spark, journal_code(F.lit("The Economic Journal"))) == "ej"


def test_similar_texts_are_not_ruled_out():
    import difflib
    import random

    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(3, 120)))
        b = "".join(ch if rng.random() > 0.05 else rng.choice("abcx") for ch in a) + ("y" * rng.randint(0, 4))
        assert x.reaches(a, b, 0.9) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.9)


# joins and orders


def test_lookups_orders_and_names(spark):
    rows = spark.createDataFrame([(1, "k1", "old"), (2, "k2", "old")], "i int, doi string, v string")
    lookup = spark.createDataFrame([("k1", None), ("k3", "new")], "doi string, v string")
    assert sorted((r.i, r.v or "") for r in j.enriched(rows, lookup, "doi", ["v"]).collect()) == [(1, ""), (2, "old")]
    works = spark.createDataFrame([("b", 2000, "x", 1), ("a", None, "z", 2), ("a", 1990, "y", 3), ("a", None, "z", 0)], "source_slug string, publication_year int, display_name string, seq int")
    assert [r.seq for r in pb.in_discovery_order(works).collect()] == [0, 2, 3, 1]
    index = spark.createDataFrame([(2, "no"), (0, "yes"), (1, "no")], "index int, downloaded string")
    assert [r["index"] for r in pb.missing(index).collect()] == [1, 2]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "b")], "id int, name string")
    assert sorted(tuple(r) for r in j.allocated_names(names, "id", "name").collect()) == [(1, "a"), (2, "a_2"), (3, "a_2_2"), (4, "b")]
    text = spark.createDataFrame([(1, "s", "long text", "k", "p2"), (1, "t", "short", "k2", "p1")], "c int, t string, text string, norm string, pdf string")
    got = canonical(text, "c", "text", "norm", "pdf").first()
    assert (got.reference_text, got.n_origins, got.origins) == ("long text", 2, "p1 | p2")


def test_related_rows_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, sorted(rng.sample(range(40), rng.randint(0, 14)) + [90] * (i % 3 == 0) + [91] * (i % 2))) for i in range(120)]
    got = {}
    for r in j.related(spark.createDataFrame([(i, [f"t{v}" for v in t]) for i, t in rows], "i int, t array<string>"), "i", "t").collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.shared))
    for i, t in rows:
        want = sorted(((-len(set(t) & set(u)), k) for k, u in rows if k != i and len(set(t) & set(u)) >= 2))[:6]
        assert sorted(got.get(i, [])) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]


# manifests and fetches


def test_manifest(spark):
    work = "id string, doi string, display_name string, publication_year int, publication_date string, authorships array<struct<author:struct<display_name:string>>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    work += "best_oa_location struct<landing_page_url:string>, primary_location struct<landing_page_url:string>, open_access struct<is_oa:boolean,oa_status:string>, source_display_name string, source_slug string, publisher string, "
    work += "matched_terms array<string>, matched_fields array<string>, search_queries array<string>, discovery_strategies array<string>, metadata_sources array<string>"
    rows = spark.createDataFrame([("W1", "https://doi.org/10.1/A", "T", 2001, None, [(("Ada B Lovelace",),), ((" ",),)], ("1", None, "2", "3"), None, ("u",), (True, "gold"), "J", "j", "P", ["b", "a"], ["title"], [], None, ["x"])], work)
    r = d.manifest(rows, F.lit("f.pdf"), F.lit("n")).first()
    assert len(r) == 26 and (r.downloaded, r.authors, r.first_author, r.year, r.doi, r.landing_page_url, r.is_oa, r.matched_terms) == ("yes", "Ada B Lovelace", "lovelace", "2001", "10.1/A", "u", "True", "a; b")


# note files


def test_note_texts(spark):
    body = "Intro\n## Notes\nx\n"
    assert one(spark, nf.headed(F.lit("# Old\n# T\nrest\n\n"), F.lit("T"))) == "# T\nrest\n"
    assert one(spark, nf.headed(F.lit("  \n" + body), F.lit("T"))) == "# T\n\n" + body
    assert one(spark, nf.headed(F.lit(""), F.lit("T"))) == "# T\n"
    header, found = "header struct<title:string,status:string,tags:array<string>>", "found struct<authors:array<string>,year:string,venue:string,doi:string,volume:string,issue:string,pages:string,abstract:string,source:string>"
    about = (["A"], "2001", "V", "", "", "", "", "An abstract.", "fallback")
    rows = spark.createDataFrame(
        [("d", "new", None, ("T", "x", ["a"]), "", about, "d/new.pdf"), ("d", "stub", "old", ("T", "imported-metadata", ["a"]), "# T\n", about, "d/s.pdf"), ("d", "full", "old", ("T", "organized", []), "# T\n\nProse\n", about, "d/f.pdf")],
        f"dir string, stem string, old string, {header}, body string, {found}, pdf string",
    )
    got = {r.stem: r for r in nf.refreshed(rows, "2020-01-01").collect()}
    assert all(r.changed for r in got.values())
    stub = got["stub"].text
    assert stub.startswith("---\ntitle: T\nstatus: imported-metadata\ntags:\n- a\n---\n# T\n") and "## Metadata Status\n- Synced on 2020-01-01" in stub and "## Basic Information\n- Authors: A\n- Year: 2001" in stub
    assert "## Abstract / Extracted Summary\nAn abstract.\n" in stub and stub.endswith("## Notes\n-\n")
    assert "Metadata Status" not in got["full"].text and got["full"].text.endswith("## Abstract / Extracted Summary\nAn abstract.\n")
    same = nf.refreshed(rows.drop("old").withColumn("old", F.lit(got["full"].text)).where("stem = 'full'").withColumn("body", F.lit("# T\n\nProse\n\n## Abstract / Extracted Summary\nAn abstract.\n")), "2020-01-01").first()
    assert not same.changed
    new = nf.new_notes(rows.where("stem = 'new'"), "2020-01-01").first().text
    assert "status: imported-metadata\ntags:\n- a\n- needs-summary\n---\n# T\n\n## Metadata Status\n" in new and new.endswith("## Abstract / Extracted Summary\nAn abstract.\n\n## Notes\n- \n")


def test_related_bullets(spark):
    notes = [("d", "a", "d", "First title", ["A Smith"], ["x/y"], "2001"), ("d", "b", "d", "Second title", ["B Smith"], [], "2003"), ("e", "c", "e", "Third", ["C Jones"], [], "")]
    kind = "dir string, stem string, category string, title string, authors array<string>, keywords array<string>, year string"
    rows = spark.createDataFrame(notes, kind).select("*", *(F.array().cast("array<string>").alias(k) for k in ("topics", "tags", "methods", "regions")), F.lit("").alias("journal_abbr"), F.lit("").alias("body"))
    topics = rel.note_topics(rows)
    got = {r.id: r.bullets for r in rel.related_lines(rel.related_notes(topics), topics).collect()}
    assert got == {"d/a": ["- [[Notes/d/b|Second title]]  | shared: shared author, title"], "d/b": ["- [[Notes/d/a|First title]]  | shared: shared author, title"]}


# workflows, command line, streams


def pages(spark):
    ref = "Smith, John ({}) \"A title of number {} about things.\" Journal of Things 5, 1-20."
    rows = [("a", 1, "Text"), ("a", 2, "References\n" + "\n".join(ref.format(1990 + k, k) for k in range(4))), ("b", 1, "No list here"), ("c", 1, "References\n" + ref.format(1990, 0) + "\n" + ref.format(1991, 1))]
    return spark.createDataFrame(rows, "doc string, page int, text string")


def test_mining(spark):
    out = wf.mining(pages(spark), "doc", "page")
    assert sorted((r.doc, r.reference_index) for r in out["references"].collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 1), ("c", 2)]
    distinct = out["distinct"].collect()
    assert [(r.source_pdf_count, r.source_pdfs) for r in distinct] == [(2, "a | c"), (2, "a | c"), (1, "a"), (1, "a")]
    assert [r.title for r in out["titles"].collect()] == [f"A title of number {k} about things" for k in range(4)]
    status = {r.doc: (r.start, r.method, r.extracted, r.note) for r in out["status"].collect()}
    assert status["a"] == (2, "header", 4, "") and status["b"] == (None, "none", 0, "no standard references section detected")
    s = out["summary"].first()
    assert (s.pdf_count, s.pdfs_with_detected_references, s.total_extracted_reference_rows, s.total_deduped_references, s.pdfs_without_detected_references) == (3, 2, 6, 4, ["b"])
    assert oc.mined(pages(spark).limit(0), "doc", "page").count() == 0


def test_candidates(spark):
    kind = "id string, doi string, title string, display_name string, publication_year int, abstract string, slug string, query string, strategy string, seq int"
    a = spark.createDataFrame([("W1", "https://doi.org/10.1/A", "State law", "State law", 2001, "", "j", "q1", "search", 1), ("W2", "", "Nothing", "Nothing", 2000, "", "j", "q1", "search", 2), ("W1", "https://doi.org/10.1/A", "State law", "State law", 2001, "", "j", "q2", "search", 3)], kind)
    b = spark.createDataFrame([("crossref:x", "https://doi.org/10.1/A", "Other", "Other", 1999, "of state", "j", "q3", "bibliographic", 1), ("crossref:y", "", "The state", "The state", None, "", "i", "q3", "bibliographic", 2)], kind)
    got = wf.candidates([(a, "openalex"), (b, "crossref")], ["state", "law"]).collect()
    assert [(r.key, r.title, r.matched_terms, r.search_queries, r.metadata_sources) for r in got] == [
        ("crossref:y", "The state", ["state"], ["q3"], ["crossref"]), ("10.1/A", "State law", ["law", "state"], ["q1", "q2", "q3"], ["crossref", "openalex"]),
    ]


def test_vault(spark):
    files = spark.createDataFrame([("d", "smith_2001_x", "smith_2001_x", "h", True, False)], "dir string, stem string, desired string, sha256 string, noted boolean, stub boolean")
    text = ("title", "venue", "publisher", "year", "journal_abbr", "entry_type", "volume", "issue", "pages", "note", "url", "doi", "status", "category")
    rows = spark.createDataFrame([("d", "smith_2001_x", "see [[Reading Notes/d/smith_2001_x]]"), ("d", "smith_2001_x_2", "copy")], "dir string, stem string, body string")
    notes = rows.select("*", *(F.lit("").alias(k) for k in text), *(F.array().cast("array<string>").alias(k) for k in ("authors", "keywords", "topics", "tags", "methods", "regions", "aliases")))
    out = wf.vault(files, notes)
    assert {k: v.count() for k, v in out.items()} == {"renames": 0, "merges": 1, "prunes": 0, "links": 1, "related": 0, "bibliography": 1, "counts": 1}
    assert out["links"].first().text == "see [[Notes/d/smith_2001_x]]"


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "mined_references" in capsys.readouterr().out
    assert command.main(["query", "source_counts", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    pages(spark).write.parquet(str(tmp_path / "pages"))
    assert command.main(["mine", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "m")]) == 0
    assert json.loads(read(tmp_path / "m" / "summary"))["pdf_count"] == 3 and len(read(tmp_path / "m" / "titles").splitlines()) == 4
    with pytest.raises(SystemExit):
        command.main(["query", "no_such", "--tables", "x"])


def test_streams(spark, tmp_path):
    from colophon import streaming

    rows = [("2020-01-01 00:00:01", "a", 1), ("2020-01-01 00:00:02", "a", 2), ("2020-01-01 00:01:05", "b", 3), ("2020-01-01 00:10:00", "b", 4)]
    batch = spark.createDataFrame(rows, "ts string, k string, n int").withColumn("ts", F.to_timestamp("ts"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    counts = run(streaming.counts(events, "k", "ts", "1 minute", "1 minute"), "counted", "append")
    assert {(r.k, r.n) for r in counts} >= {("a", 2), ("b", 1)}
    assert sorted(r.k for r in run(streaming.first_seen(events, ["k"], "ts", "1 minute"), "seen", "append")) == ["a", "b"]

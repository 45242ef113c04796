"""Citations, names, addresses, discovery and notes on literal cases."""

import pytest
from pyspark.sql import functions as F

from colophon.functions import citations as c
from colophon.functions import names as n
from colophon.functions import urls as u
from colophon.operators import citations as oc
from colophon.operators import discovery as d
from colophon.operators import notes as o


def one(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_line_shapes(spark):
    lines = [
        "Smith, John, and Ann Lee. 2010. Courts in the west. Journal of Things.", "OECD, 2014. A report on everything that grows.", "Smith and Lee wrote on courts (2010) at length.",
        "A line about 2010 without a name in front of it all", "short 2010", "References", "42", "© 2010 Smith, John, and Co. with rights", "",
    ]
    assert one(spark, c.citation_line, lines) == [True, True, True, False, False, False, False, False, False]
    assert one(spark, c.dropped_line, lines) == [False, False, False, False, False, True, True, True, True]
    assert one(spark, c.garbled, ["§§§§§§§§§§§§§§§§ab", "–—–—–—–— 12 34 56 78", "an ordinary line of text", "§§§§§§"]) == [True, True, False, False]
    assert one(spark, c.running_header, ["Vol. 3 of this", "Journal of Law (2010) 3–9", "no. 4 of all 12", "Text"]) == [True, True, True, False]


def test_cleaning(spark):
    assert one(spark, c.finished, ["a  b , c ( d ) ; "]) == ["a b, c (d)"]
    assert one(spark, c.compare_key, ["Müller, Vol. 3, pp.9 doi: 10.1/x http://a.b/c É"]) == ["muller vol 3 9 10 1 x e"]
    assert one(spark, c.after_heading, ["a\nReferences\nb\n  BIBLIOGRAPHY \nc", "plain"]) == ["\nc", "plain"]
    line = "Smith, Ann, 2010. Title one. Jones, Bob, 2011. Title two."
    assert one(spark, c.split_inline, [line, "plain"]) == [["Smith, Ann, 2010. Title one.", "Jones, Bob, 2011. Title two."], ["plain"]]


def test_titles(spark):
    texts = [
        'Smith, John. 2010. “The Courts of the West.” Journal of Law 3.', "Lee, Ann. 2011. Growth and trade in towns. In Handbook of Towns.",
        "Smith, John. 2012. 'Roads and rails', World Review 4.", "No year and no quotes at all", "Doe, J. 2001. Civil conflict and peace. Oxford: Press.", None,
    ]
    assert one(spark, c.titles, texts) == [["The Courts of the West"], ["Growth and trade in towns"], ["Roads and rails"], [], [], []]
    assert one(spark, c.cleaned_title, ["A title here, Journal of Law", "U S roads. Cambridge 3", "Some words. Then More of it"]) == ["A title here", "US roads", "Some words"]
    rows = spark.createDataFrame([(1, '2010. "The Courts of X."'), (2, '2010. "The courts of x."')], "i int, t string")
    assert [tuple(r) for r in oc.reference_titles(rows, "t", "i").collect()] == [("the courts of x", "The Courts of X")]


CITE = "Smith, John, and Ann Lee. 20{:02d}. Courts in the west number {}."


def page(k, start=0):
    return "\n".join(CITE.format(i, "abcdefghij"[i]) for i in range(start, start + k))


def test_reference_pages(spark):
    rows = [("h", 1, "text"), ("h", 2, "body\nReferences\n" + page(1)), ("h", 3, page(3)), ("h", 4, "Appendix\n" + page(1)), ("h", 5, page(5))]
    rows += [("d", i, "text") for i in (1, 2)] + [("d", 3, page(5)), ("d", 4, page(5)), ("d", 5, "text"), ("d", 6, page(6)), ("n", 1, "text"), ("e", 1, None)]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    got = sorted(tuple(r) for r in oc.reference_pages(pages, "doc", "page").collect())
    assert got == [("d", 3, "density"), ("d", 4, "density"), ("h", 2, "header"), ("h", 3, "header")]


def test_parsed_references(spark):
    rows = [("a", 2, "body text 1999\nReferences\n" + page(1) + "\nmore of it\n" + page(1, 1)), ("a", 3, page(1, 1) + "\n\n7\nlast line"), ("b", 1, None)]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    got = [tuple(r)[:3] for r in oc.parsed_references(pages, "doc", "page").orderBy("reference_index").collect()]
    assert got == [("a", 1, CITE.format(0, "a") + " more of it"), ("a", 2, CITE.format(1, "b")), ("a", 3, CITE.format(1, "b") + " last line")]


def test_two_columns(spark):
    wide = "\n".join(f"left {i:050d}".ljust(75) + f"right {i}" for i in range(20))
    got = one(spark, oc.two_columns, [wide, "plain", None])
    assert got[1:] == [None, None]
    assert got[0].split("\n") == [f"left {i:050d}" for i in range(20)] + [""] + [f"right {i}" for i in range(20)]


def test_names(spark):
    assert one(spark, n.surname_slug, ["Ludwig van Beethoven", "Müller, Jan", "Ann O'Neil", "", None, "Plato"]) == ["van_beethoven", "muller", "o_neil", "", "", "plato"]
    got = one(spark, n.bib_name, ["JOHN SMITH", "Ludwig Van Beethoven", "De La CRUZ, ana b", "{The Group}", "Plato", None, "J R Smith &amp; Co"])
    assert got == ["Smith, John", "van Beethoven, Ludwig", "de la Cruz, ana B", "{The Group}", "Plato", "", "Co, J R Smith &"]
    rows = spark.createDataFrame([(1, ["A Smith", "", "B Jones"]), (2, None)], "i int, names array<string>")
    assert sorted(tuple(r) for r in n.bib_names(rows, "i", "names").collect()) == [(1, "Smith, A and Jones, B"), (2, "")]
    assert one(spark, n.journal_code, ["World Politics", "Science", "The American Political Science Review", "Nothing Known", ""]) == ["wpol", "ajps", "apsr", "", ""]
    assert one(spark, n.source_code, ["Journal of Law", "Nature", "", "the"]) == ["JL", "NATURE", "MISC", "THE"]
    assert one(spark, n.stem_parts, ["smith_2010_apsr_2", "smith", "van_dyke_1999_a_b", "2"]) == [
        ("smith", "2010", "apsr", "2", "smith_2010_apsr"), ("smith", "", "", "", "smith"), ("van_dyke", "1999", "a", "b", "van_dyke_1999_a"), ("", "", "", "2", "")
    ]


def test_entry_type(spark):
    rows = [("", "World Politics", "", "", "", ""), ("", "NBER Working Paper", "", "", "", ""), ("book", "", "Routledge", "", "", ""), ("", "", "Oxford University Press", "chapter 3", "", ""),
            ("", "Harvard University", "", "", "", ""), ("", "", "", "", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, v string, p string, n string, t string, c string")
    out = df.select("i", n.entry_type(F.col("g"), F.col("v"), F.col("p"), F.col("n"), F.col("t"), F.col("c"), F.lit(False)).alias("k")).orderBy("i")
    assert [r.k for r in out.collect()] == ["article", "techreport", "book", "incollection", "phdthesis", "misc"]


def test_urls(spark):
    got = one(spark, u.guessed_pdfs, ["https://www.jstor.org/stable/123?x=1", "https://onlinelibrary.wiley.com/doi/10.1111/ab.1", "https://www.sciencedirect.com/pii/S1", "http://x.y", None])
    assert got == [
        ["https://www.jstor.org/stable/pdf/123.pdf"], ["https://onlinelibrary.wiley.com/doi/pdfdirect/10.1111/ab.1", "https://onlinelibrary.wiley.com/doi/pdf/10.1111/ab.1"],
        ["https://www.sciencedirect.com/science/article/pii/S1/pdfft?isDTMRedir=true&download=true", "https://www.sciencedirect.com/science/article/pii/S1/pdfft"], [], [],
    ]
    rows = spark.createDataFrame([(1, "http://a", "10.1/X", "techreport"), (2, "https://doi.org/10.1/x/", "10.1/X", "misc"), (3, "http://a", "", "article"), (4, None, None, "misc")], "i int, u string, d string, k string")
    assert [r.x for r in rows.select("i", u.bib_url(F.col("u"), F.col("d"), F.col("k")).alias("x")).orderBy("i").collect()] == ["http://a", "", "", ""]


def test_law_terms(spark):
    rows = [("Courts and lawyers", "", ""), ("Law of gravity", "", ""), ("Law and order", "1", "30"), ("International law", "", ""), ("International law in court", "", ""),
            ("Courts", "1", "3"), ("Courts", "S1", "S3"), ("Review of courts", "", ""), ("", "", ""), (None, None, None), ("The rule of the law", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a string, b string")
    got = [r.x for r in df.select("i", d.law_terms(F.col("t"), F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [["court", "lawyer"], [], ["law"], [], ["court", "law"], [], ["court"], [], [], [], ["law", "rule of law"]]


def test_fetch_outcomes(spark):
    urls = spark.createDataFrame([(1, ["a", "b"]), (2, ["p"]), (3, []), (4, ["b", "gone", "x"])], "id int, urls array<string>")
    log = spark.createDataFrame(
        [("a", "A", 404, "", b"", None), ("b", "B", 200, "text/html", b"", ["i", "j"]), ("i", "I", 200, "text/html", b"", None), ("j", "J", 200, "", b"%PDF-1", None),
         ("p", "P", 200, "text/html", b"", ["i"]), ("x", "X", 200, "", b"zip", None)], "url string, final_url string, status int, content_type string, body binary, links array<string>")
    got = sorted(tuple(r) for r in d.fetch_outcomes(urls, log, "id", ["urls"]).collect())
    assert got == [(1, True, "J", "downloaded from J"), (2, False, "", "P: no PDF link found in landing page"), (3, False, "", "no candidate URLs"), (4, True, "J", "downloaded from J")]


NOTE = "dir string, stem string, title string, doi string, status string, tags array<string>, aliases array<string>, body string"


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(
        [("d", "smith_2010_apsr", "On Courts", "10.1/a", "organized", [], ["old one"], "text"), ("d", "smith_2010_apsr_2", "On Courts", "", "", [], None, "one two three"),
         ("d", "jones_2011_x", "Trade", "", "imported-metadata", ["metadata-review"], [], ""), ("d", "lee_2012_old", "Growth of towns", "", "synthesized", [], ["lee"], "w ## Core Argument"),
         ("d", "lee_2012_new", "Growth of town", "", "", [], [], "")], NOTE)


def test_notes(spark, notes):
    rows = {r.stem: r for r in notes.select("stem", o.quality(F.col("status"), F.col("tags"), F.col("body")).alias("q"), o.is_stub(F.col("status"), F.col("tags"), F.col("body")).alias("s")).collect()}
    assert [rows[k].q for k in ("smith_2010_apsr", "smith_2010_apsr_2", "jones_2011_x", "lee_2012_old")] == [181, 3, -340, 424]
    assert rows["jones_2011_x"].s and not rows["smith_2010_apsr"].s
    files = spark.createDataFrame([("d", "smith_2010_apsr"), ("d", "lee_2012_new"), ("d", "jones_2011_x")], "dir string, stem string")
    pairs = o.copies(notes, files)
    assert [tuple(r) for r in pairs.collect()] == [("d", "smith_2010_apsr_2", "smith_2010_apsr")]
    moved = o.renamed(notes, files).where("stem <> 'smith_2010_apsr_2'")
    assert [tuple(r) for r in moved.collect()] == [("d", "lee_2012_old", "lee_2012_new")]
    got = {r.stem: r for r in o.merged(notes, pairs.unionByName(moved)).collect()}
    assert (got["lee_2012_new"].winner, got["lee_2012_new"].aliases) == ("lee_2012_old", ["lee", "lee_2012_new", "lee_2012_old"])
    assert got["smith_2010_apsr"].winner == "smith_2010_apsr"


def test_links(spark, notes):
    texts = spark.createDataFrame([(1, "a [[d/old one|x]] b [[d/jones_2011_y]] [[f.pdf]] [[d/zzz]] c"), (2, "[[Notes/d/smith_2010_apsr]] plain"), (3, "none"), (4, None)], "id int, t string")
    got = [tuple(r) for r in o.repaired_links(texts, "id", "t", notes).collect()]
    assert got == [(1, "a [[Notes/d/smith_2010_apsr|x]] b [[Notes/d/jones_2011_x]] [[f.pdf]] [[d/zzz]] c")]


def test_sections(spark):
    bodies = ["## A\nold\n## B\nkeep\n", "## B\nx", "", "## A\n$1 \\2"]
    assert one(spark, lambda b: o.with_section(b, "A", F.lit("new $1")), bodies) == ["## A\nnew $1\n\n## B\nkeep\n", "## B\nx\n\n## A\nnew $1\n\n", "## A\nnew $1\n\n", "## A\nnew $1\n"]
    body = "## Related Notes\n- [[n]]\nno\n## Related Papers\n- [[p|q]]\n- [[n|again]]\n"
    got = one(spark, lambda b: o.merged_bullets(o.related_bullets(b), F.array(F.lit("- [[z]]"), F.lit("- [[p]]"))), [body])
    assert got == ["- [[p|q]]\n- [[n|again]]\n- [[z]]"]
    assert one(spark, lambda b: o.merged_bullets(o.related_bullets(b), F.array().cast("array<string>")), [""]) == ["- "]


def test_rename_plan(spark):
    rows = [("d", "a", "s_2010_x", "h1", True, False), ("d", "b", "s_2010_x", "h2", True, False), ("d", "s_2010_x", "s_2010_x", "h3", True, False), ("d", "s_2010_x_2", None, "h4", False, False),
            ("d", "c", "q", "h1", True, True), ("d", "ee", "q", "h2", True, False), ("e", "f", "q", "h1", False, False), ("e", "q", "z", "h1", True, False)]
    df = spark.createDataFrame(rows, "dir string, stem string, desired string, sha256 string, noted boolean, stub boolean")
    got = sorted(tuple(r) for r in o.rename_plan(df).collect())
    assert got == [
        ("d", "a", "s_2010_x_3", "rename", "normalized_with_suffix"), ("d", "b", "s_2010_x_4", "rename", "normalized_with_suffix"),
        ("d", "c", "a", "archive", "exact_duplicate_in_folder"), ("d", "ee", "b", "review", "exact_duplicate_with_two_non_stub_notes"),
        ("d", "ee", "q", "rename", "normalized_name"), ("e", "f", "q", "archive", "exact_duplicate_in_folder"), ("e", "q", "z", "rename", "normalized_name"),
    ]
    assert o.rename_plan(df.limit(0)).count() == 0


def test_best_result(spark):
    from colophon.operators.records import best_result

    asked = spark.createDataFrame([(1, "Courts of law", "2010", "smith", "World Politics"), (2, "Trade", "", "", ""), (3, "Nothing like it", None, None, None)], "id int, title string, year string, author string, venue string")
    results = spark.createDataFrame(
        [(1, 0, "Courts of law", "2011", "a b", ""), (1, 1, "Courts of law", "2010", "John Smith", "World politics"), (2, 0, "Trade", "1", "", ""), (2, 1, "Trade", "", "", ""), (3, 0, "zzz", None, None, None)],
        "id int, place int, title string, year string, authors string, venue string")
    got = sorted((r.id, r.place, round(r.score, 6)) for r in best_result(asked, results, "id", 0.76).collect())
    assert got == [(1, 1, 1.19), (2, 0, 1.0)]
    assert sorted((r.id, round(r.score, 6)) for r in best_result(asked, results, "id", 0.82, author=False).collect()) == [(1, 1.08), (2, 1.0)]


def test_merged_header(spark):
    from colophon.operators.records import merged_header

    note = "struct<title:string,aliases:array<string>,authors:array<string>,year:string,venue:string,publisher:string,status:string,doi:string,url:string,entry_type:string,journal_abbr:string,tags:array<string>>"
    found = "struct<title:string,authors:array<string>,year:string,venue:string,publisher:string,doi:string,url:string,entry_type:string,journal_abbr:string,abstract:string,source:string>"
    rows = spark.createDataFrame(
        [("d", "s_2010", ("Mine", ["x"], ["A B"], "2010", "World Politics", None, "organized", "10.1/A", None, "", "", ["wpol", "own"]), ("Theirs", ["C D"], "2011", "Other", "P", "10.2/b", "", "", "", "an audit study", "crossref")),
         ("d", "t_2011", ("", None, ["A B"], "2010", "", None, "imported-metadata", None, None, "", "", ["metadata-review"]), ("Theirs", ["C D"], "2011", "Annals of X", "P", "10.2/B", "", "article", "", None, "crossref")),
         ("d", "u_v", ("", None, None, None, None, None, None, None, None, None, None, None), None)], f"dir string, stem string, note {note}, found {found}")
    got = {r.stem: r for r in merged_header(rows, "Law Cases", "2020-01-01", F.lit(False), ("fixed", "source-note")).collect()}
    a, b, c_ = got["s_2010"], got["t_2011"], got["u_v"]
    assert (a.title, a.authors, a.year, a.venue, a.publisher, a.doi, a.url, a.entry_type, a.journal_abbr) == ("Mine", ["A B"], "2010", "World Politics", "P", "10.1/a", "https://doi.org/10.1/a", "article", "wpol")
    assert a.tags == ["own", "fixed", "source-note", "law-cases", "wpol", "article", "audit-correspondence", "audit-study"] and a.aliases == ["x", "s_2010"]
    assert (b.title, b.authors, b.year, b.doi, b.journal_abbr) == ("Theirs", ["C D"], "2011", "10.2/b", "annals_of_x")
    assert b.tags == ["fixed", "source-note", "law-cases", "annals_of_x", "article", "needs-summary"]
    assert (c_.title, c_.doi, c_.entry_type) == ("u v", "", "misc") and "metadata-review" in c_.tags


def test_generic_titles(spark, notes):
    titles = ["", None, "Working Paper Series", "\\renewcommand x of a long title", "w12345 ab", "SHOUTED TITLE", "abc", "A title with enough letters 2010"]
    assert one(spark, o.generic_title, titles) == [True] * 7 + [False]
    assert one(spark, lambda x: o.wants_title(x, F.lit("smith_2010")), ["", None, "Untitled", "Preface", "Smith, 2010", "Courts"]) == [True] * 5 + [False]
    files = spark.createDataFrame([("d", "smith_2010_apsr")], "dir string, stem string")
    rows = notes.withColumn("year", F.lit("")).withColumn("venue", F.lit(None).cast("string"))
    assert [tuple(r) for r in o.prunable(rows, files).collect()] == [("d", "jones_2011_x")]


def test_basic_information(spark):
    rows = spark.createDataFrame([(1, ["A", "B"], "2010", "V", None, "d/x.pdf", "3", None, ""), (2, None, None, None, None, None, None, None, None)],
                                 "i int, a array<string>, y string, v string, d string, f string, vo string, n string, p string")
    got = [r.x for r in rows.select("i", o.basic_information(*(F.col(k) for k in ("a", "y", "v", "d", "f", "vo", "n", "p"))).alias("x")).orderBy("i").collect()]
    assert got == ["- Authors: A, B\n- Year: 2010\n- Venue: V\n- DOI: \n- PDF: [[d/x.pdf]]\n- Volume / Issue / Pages: 3 /  / ", "- Authors: \n- Year: \n- Venue: \n- DOI: \n- PDF: [[]]"]

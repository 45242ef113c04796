"""Citations, names, addresses, discovery and notes on literal cases: the driver's tables hold no years, identifiers or PDF links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as c
from ..functions import names as n
from ..functions import urls as u
from ..operators import citations as oc
from ..operators import discovery as d
from ..operators import notes as o
from .records import _values
from .registry import query, table

_LAW = [
    (1, "Courts and lawyers", "", ""), (2, "Law of gravity", "", ""), (3, "Law and order", "1", "30"), (4, "International law", "", ""), (5, "International law in court", "", ""),
    (6, "Courts", "1", "3"), (7, "Courts", "S1", "S3"), (8, "Review of courts", "", ""), (9, "The rule of the law", "", ""), (10, "A judicial legal system", "5", "9"),
]


@query(rf"""WITH v AS (SELECT * FROM {_values(_LAW, "id, title, a, b")}),
h AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN '{k}' END" for k, p in d.LAW_TITLES)}], lambda x: x IS NOT NULL)) AS t FROM v)
SELECT id, array_to_string(t, '; ') AS terms FROM h WHERE len(t) > 0 AND NOT regexp_matches(title, '(?i){d.REVIEW_TITLES}')
AND NOT COALESCE(regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^[0-9]+$') AND TRY_CAST(b AS INT) - TRY_CAST(a AS INT) + 1 <= 3, false)
AND NOT (regexp_matches(title, '(?i){d.OTHER_LAW}') AND NOT regexp_matches(title, '(?i){d.COURT_WORDS}'))
AND NOT (t = ['law'] AND NOT regexp_matches(title, '(?i){d.LAW_CONTEXT}|{d.LAW_AND}'))""")
def law_titles(spark, sf_dir):
    rows = spark.createDataFrame(_LAW, "id int, title string, a string, b string")
    found = rows.select("id", d.law_terms(F.col("title"), F.col("a"), F.col("b")).alias("t")).where(F.size("t") > 0)
    return found.select("id", F.array_join("t", "; ").alias("terms"))


_URLS = [(1, "https://www.jstor.org/stable/123?x=1"), (2, "https://onlinelibrary.wiley.com/doi/10.1111/ab.1"), (3, "https://www.sciencedirect.com/pii/S1"), (4, "http://x.y"), (5, "https://www.journals.uchicago.edu/doi/10.1086/z9")]


@query(rf"""SELECT id, array_to_string(list_filter([
CASE WHEN regexp_matches(url, 'jstor\.org/stable/') THEN 'https://www.jstor.org/stable/pdf/' || regexp_extract(url, 'jstor\.org/stable/([^?]*)', 1) || '.pdf' END,
CASE WHEN contains(url, 'sciencedirect.com') AND contains(url, '/pii/') THEN 'https://www.sciencedirect.com/science/article/pii/' || regexp_extract(url, '/pii/([A-Z0-9]+)', 1) || '/pdfft?isDTMRedir=true&download=true' END,
CASE WHEN contains(url, 'sciencedirect.com') AND contains(url, '/pii/') THEN 'https://www.sciencedirect.com/science/article/pii/' || regexp_extract(url, '/pii/([A-Z0-9]+)', 1) || '/pdfft' END,
CASE WHEN contains(url, 'journals.uchicago.edu') THEN 'https://www.journals.uchicago.edu/doi/pdf/' || regexp_extract(url, '(10\.[0-9]+/.*)$', 1) END,
CASE WHEN contains(url, 'onlinelibrary.wiley.com') THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/' || regexp_extract(url, '(10\.[0-9]+/.*)$', 1) END,
CASE WHEN contains(url, 'onlinelibrary.wiley.com') THEN 'https://onlinelibrary.wiley.com/doi/pdf/' || regexp_extract(url, '(10\.[0-9]+/.*)$', 1) END], lambda x: x IS NOT NULL), ' ') AS urls FROM {_values(_URLS, "id, url")}""")
def guessed_pdf_urls(spark, sf_dir):
    return spark.createDataFrame(_URLS, "id int, url string").select("id", F.array_join(u.guessed_pdfs(F.col("url")), " ").alias("urls"))


_TRY = [(1, 0, "a"), (1, 1, "b"), (2, 0, "p"), (3, 0, "gone"), (3, 1, "a")]
_LOG = [("a", "A", 404, "text/html"), ("b", "B", 200, "application/pdf"), ("p", "P", 200, "application/zip")]


@query(rf"""WITH t AS (SELECT * FROM {_values(_TRY, "id, i, url")}), l AS (SELECT * FROM {_values(_LOG, "url, final_url, status, kind")}),
j AS (SELECT t.id, t.i, final_url, COALESCE(status < 400 AND contains(kind, 'application/pdf'), false) AS ok,
  CASE WHEN status IS NULL THEN t.url || ': request failed' WHEN status >= 400 THEN final_url || ': HTTP ' || status WHEN contains(kind, 'application/pdf') THEN 'downloaded from ' || final_url ELSE final_url || ': non-PDF content-type ' || kind END AS note FROM t LEFT JOIN l USING (url))
SELECT id, bool_or(ok) AS ok, COALESCE(arg_min(final_url, i) FILTER (WHERE ok), '') AS url, COALESCE(arg_min(note, i) FILTER (WHERE ok), arg_max(note, i)) AS note FROM j GROUP BY id""")
def fetch_decisions(spark, sf_dir):
    tries = spark.createDataFrame(_TRY, "id int, i int, url string").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "url"))).alias("t"))
    urls = tries.select("id", F.transform("t", lambda x: x["url"]).alias("urls"))
    log = spark.createDataFrame(_LOG, "url string, final_url string, status int, content_type string")
    return d.fetch_outcomes(urls, log.withColumn("body", F.lit(b"")).withColumn("links", F.array().cast("array<string>")), "id", ["urls"])


_ASKED = [(1, "World politics"), (2, "THE Economic JOURNAL"), (3, "Unknown Annals")]


@query(rf"""WITH s AS (SELECT slug, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM {_values([(k, v) for k, v in n.JOURNALS.items()], "slug, name")})
SELECT id, slug FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM {_values(_ASKED, "id, title").replace("AS v(", "AS w(")}) JOIN s USING (key)""")
def source_title_matches(spark, sf_dir):
    sources = spark.createDataFrame(list(n.JOURNALS.items()), "slug string, name string").withColumn("aliases", F.array().cast("array<string>"))
    rows = spark.createDataFrame(_ASKED, "id int, title string").select("id", F.array("title").alias("titles"))
    return d.of_sources(rows, "titles", sources, "slug", "name", "aliases").select("id", "slug")


_STEMS = [(1, "smith_2010_apsr_2"), (2, "smith"), (3, "van_dyke_1999_a_b"), (4, "jones_2001_x_c")]


@query(rf"""WITH b AS (SELECT id, regexp_extract(stem, '_([0-9]{{1,2}}|[a-z])$', 1) AS suffix, regexp_replace(stem, '_([0-9]{{1,2}}|[a-z])$', '') AS base FROM {_values(_STEMS, "id, stem")})
SELECT id, CASE WHEN regexp_matches(base, '_(19|20)[0-9]{{2}}(_|$)') THEN regexp_extract(base, '^(.*?)_((19|20)[0-9]{{2}})(_|$)', 1) ELSE split_part(base, '_', 1) END AS author,
regexp_extract(base, '_((19|20)[0-9]{{2}})(_|$)', 1) AS year, regexp_extract(base, '_(19|20)[0-9]{{2}}_(.*)$', 2) AS code, suffix FROM b""")
def stem_fields(spark, sf_dir):
    rows = spark.createDataFrame(_STEMS, "id int, stem string").select("id", n.stem_parts(F.col("stem")).alias("p"))
    return rows.select("id", "p.author", "p.year", "p.code", "p.suffix")


_REFERENCES = [
    (1, 'Smith, John. 2010. “The Courts of the West.” Journal of Law 3.'), (2, "Lee, Ann. 2011. Growth and trade in towns. In Handbook of Towns."),
    (3, "Smith, John. 2012. 'Roads and rails', World Review 4."), (4, "No year and no quotes at all"), (5, '2013. "The courts of the west."'),
]


@query()
def citation_titles(spark, sf_dir):
    """Titles of references; the patterns look behind, which the SQL engine's regexes cannot."""
    return oc.reference_titles(spark.createDataFrame(_REFERENCES, "id int, t string"), "t", "id")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(text, 'https?://\S+', ' ', 'g'))), '\bdoi\s*:?\s*', ' ', 'g'), '\bvols?\.\b|\bnos?\.\b|\bpp?\.\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def document_compare_keys(spark, sf_dir):
    """Comparison keys of whole documents; the accents are folded in Python."""
    return table(spark, sf_dir, "documents").select("doc_id", c.compare_key(F.col("text")).alias("norm"))


@query(r"""SELECT doc_id, sum(CASE WHEN trim(line) = '' OR regexp_matches(lower(trim(line)), '^(""" + c.HEADINGS + r""")$') OR regexp_matches(trim(line), '^[0-9]+$') OR regexp_matches(lower(trim(line)), '^(downloaded from |copyright |published online by)') OR starts_with(trim(line), '©') OR contains(lower(line), 'creativecommons.org/licenses')
  OR (length(line) >= 16 AND length(regexp_replace(line, '[A-Za-z0-9\x09-\x0D\x1C-\x20.,;:!?()\[\]{}''"/&%+\-=]', '', 'g')) >= 6 AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) < 0.45::DOUBLE * length(line)) THEN 1 ELSE 0 END)::BIGINT AS dropped
FROM (SELECT doc_id, trim(regexp_replace(replace(unnest(string_split(text, chr(10))), chr(173), ''), '""" + r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+" + r"""', ' ', 'g')) AS line FROM documents) GROUP BY doc_id""")
def dropped_lines(spark, sf_dir):
    """Lines of whole documents that are no part of a reference list's text."""
    rows = F.split("text", "\n")
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(F.filter(rows, c.dropped_line)).cast("long").alias("dropped"))


_FILES = [("d", "a", "s_2010_x", "h1", True, False), ("d", "b", "s_2010_x", "h2", True, False), ("d", "s_2010_x", "s_2010_x", "h3", True, False), ("d", "c", "q", "h1", True, True)]


@query()
def rename_plan(spark, sf_dir):
    """A fold over file names, which SQL has no form for."""
    return o.rename_plan(spark.createDataFrame(_FILES, "dir string, stem string, desired string, sha256 string, noted boolean, stub boolean"))

"""Record adapters, counts, links and literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.joins import unique_matches
from ..functions.bib import bib_entry
from ..operators.publish import bibliography
from .registry import query, table


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars < 500) AS short FROM documents GROUP BY ALL")
def source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"))


@query("""SELECT source, min(doc_id) AS sample, count(*) AS n, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs, arg_min(lang, doc_id) FILTER (WHERE lang <> 'en') AS first_other FROM documents GROUP BY source""")
def pending_queue(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("doc_id").alias("sample"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"),
        F.min_by("lang", F.when(F.col("lang") != "en", F.col("doc_id"))).alias("first_other"),
    )


@query("""SELECT page_id, len(l) AS n_links, len(list_distinct(l)) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def html_link_counts(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query()
def html_links(spark, sf_dir):
    """Absolute link targets in order, once each; SQL has no URL resolution."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(x.links("html", "url")).alias("link"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN contains(url, '?page=') THEN 'paged' WHEN contains(url, 'utm_') THEN 'campaign' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS kind, split_part(url, '?', 1) AS landing FROM pages""")
def host_rules(spark, sf_dir):
    url = F.col("url")
    kind = F.when(url.contains("?page="), "paged").when(url.contains("utm_"), "campaign").when(url.contains("?"), "query").otherwise("plain")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"), kind.alias("kind"), F.split(url, r"\?")[0].alias("landing"))


@query("""SELECT item_id, array_to_string(string_split(text, ' '), ' ') AS text FROM benchmark""")
def inverted_abstract(spark, sf_dir):
    """Round trip: texts become inverted indexes and texts again."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", x.rebuilt_abstract(F.col("index")).alias("text"))


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value, len(json_keys(props)) AS n_keys FROM events""")
def json_field(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("value"), F.size("m").cast("long").alias("n_keys"))


_DOIS = [(1, "https://doi.org/10.1000/AbC"), (2, "http://doi.org/10.1000/x "), (3, "10.1/y"), (4, ""), (5, "see 10.1234/ab.c); and 10.5/q")]


def _values(rows, names):
    body = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({names})"


@query(rf"""SELECT id, trim(regexp_replace(regexp_replace(raw, '^https://doi\.org/', ''), '^http://doi\.org/', '')) AS doi, lower(regexp_replace(regexp_extract(raw, '(?i)\b(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[).,;]+$', '')) AS found FROM {_values(_DOIS, "id, raw")}""")
def doi_forms(spark, sf_dir):
    rows = spark.createDataFrame(_DOIS, "id int, raw string")
    return rows.select("id", x.normalize_doi(F.col("raw")).alias("doi"), x.extract_doi(F.col("raw")).alias("found"))


_SPANS = [(1, "12-19"), (2, "1 - 3"), (3, "S12-S20"), (4, "7"), (5, ""), (6, "100-104")]


@query(rf"""SELECT id, a AS first, b AS last, CASE WHEN regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^[0-9]+$') THEN b::INT - a::INT + 1 END AS span FROM (SELECT id, split_part(replace(raw, ' ', ''), '-', 1) AS a, split_part(replace(raw, ' ', ''), '-', 2) AS b FROM {_values(_SPANS, "id, raw")})""")
def page_spans(spark, sf_dir):
    rows = spark.createDataFrame(_SPANS, "id int, raw string").select("id", x.page_range(F.col("raw")).alias("r")).select("id", "r.*")
    return rows.select("id", "first", "last", x.page_span(F.col("first"), F.col("last")).alias("span"))


_NAMES = [(1, "Ada Lovelace; Charles Babbage"), (2, "A, B and C"), (3, ""), (4, " ; X Y")]


@query(rf"""SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(raw, ';|,|\s+and\s+'), lambda n: trim(n)), lambda n: n <> ''), '|') AS names FROM {_values(_NAMES, "id, raw")}""")
def author_lists(spark, sf_dir):
    return spark.createDataFrame(_NAMES, "id int, raw string").select("id", F.array_join(x.split_names(F.col("raw")), "|").alias("names"))


_BIB = [(1, "b_2020", "article", "Old", "2020", ""), (2, "a_2019", "book", "A Book", "2019", "Press"), (3, "b_2020", "article", "New", "2020", "")]


@query(rf"""SELECT key, '@' || kind || '{{' || key || ',' || chr(10) || array_to_string(list_filter(['  title = {{' || title || '}},', '  year = {{' || yr || '}},', CASE WHEN publisher <> '' THEN '  publisher = {{' || publisher || '}},' END], lambda f: f IS NOT NULL), chr(10)) || chr(10) || '}}' AS entry
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM {_values(_BIB, "seq, key, kind, title, yr, publisher")}) WHERE n = 1""")
def bib_entries(spark, sf_dir):
    rows = spark.createDataFrame(_BIB, "seq int, key string, kind string, title string, yr string, publisher string")
    entry = bib_entry(F.col("kind"), F.col("key"), [("title", F.col("title")), ("year", F.col("yr")), ("publisher", F.col("publisher"))])
    return bibliography(rows.select("seq", "key", entry.alias("entry"))).select("key", "entry")


_ORPHANS = [(1, "mestre", "2020"), (2, "mestre", ""), (3, "", "2021"), (4, "", ""), (5, "nobody", "2020")]
_FILES = [("f1", "mestre", "2020"), ("f2", "silva", "2021"), ("f3", "silva", "2022")]


@query(rf"""SELECT id, file FROM (SELECT id, file, count(*) OVER (PARTITION BY id) AS n FROM {_values(_ORPHANS, "id, author, yr")} JOIN {_values(_FILES, "file, fauthor, fyr").replace("AS v(", "AS f(")} ON (author = '' OR author = fauthor) AND (yr = '' OR yr = fyr) AND NOT (author = '' AND yr = '')) WHERE n = 1""")
def unique_match_only(spark, sf_dir):
    left = spark.createDataFrame(_ORPHANS, "id int, author string, yr string")
    return unique_matches(left, spark.createDataFrame(_FILES, "file string, author string, yr string"), "id", ["author", "yr"])

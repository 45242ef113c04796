"""Keyword matching, tagging, classification and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import significant_tokens, strip_markup, title_words
from ..operators import matching as m
from ..operators.joins import last_wins
from .registry import query, table

_ANY = ["the", "from", "worthless"]


def _word(c: str, w: str) -> str:
    return rf"regexp_matches({c}, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_]){w}($|[^\p{{L}}\p{{N}}\p{{M}}_])')"


def _terms(c: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_word(c, w)} THEN '{w}' END" for w in sorted(words)) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, array_to_string(t, '; ') AS matched_terms FROM (SELECT doc_id, {_terms("text", _ANY)} AS t FROM documents) WHERE len(t) > 0""")
def keyword_match_any(spark, sf_dir):
    out = m.keyword_match(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], _ANY)
    return out.select("doc_id", F.array_join("matched_terms", "; ").alias("matched_terms"))


@query(f"""SELECT doc_id FROM documents WHERE {_word("text", "the")} AND {_word("text", "from")}""")
def keyword_match_all(spark, sf_dir):
    return m.keyword_match(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["the", "from"], "all").select("doc_id")


_FIELDS = ["the", "la", "der"]


@query(f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), '; ') AS matched_terms,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'title' END, CASE WHEN len(b) > 0 THEN 'body' END], lambda x: x IS NOT NULL), '; ') AS matched_fields
FROM (SELECT page_id, {_terms("title", _FIELDS)} AS a, {_terms("body", _FIELDS)} AS b
  FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages)) WHERE len(a) + len(b) > 0""")
def keyword_match_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("body")
    )
    out = m.keyword_match(rows, ["title", "body"], _FIELDS)
    return out.select("page_id", F.array_join("matched_terms", "; ").alias("matched_terms"), F.array_join("matched_fields", "; ").alias("matched_fields"))


@query(f"""WITH hit AS (SELECT doc_id, source, lang, md5(text) AS key, unnest({_terms("text", _ANY)}) AS term FROM documents)
SELECT key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, array_to_string(list_sort(list_distinct(list(term))), '; ') AS terms FROM hit GROUP BY key""")
def candidate_upsert(spark, sf_dir):
    """Each keyword's hits are one provider; the union is merged by content, first row wins, terms unite."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("key"), m.matched_terms(F.col("text"), _ANY).alias("all_"))
    hits = docs.select("key", "doc_id", "source", "lang", F.explode("all_").alias("t")).withColumn("terms", F.array("t")).drop("t")
    return m.upsert(hits, ["key"], ["doc_id"], ["terms"]).select("key", "doc_id", "source", "lang", F.array_join("terms", "; ").alias("terms"))


_TAGS = [("license", "license"), ("mail", r"[a-z0-9._]+@[a-z0-9.]+"), ("shout", r"!!"), ("table", r" \| ")]


@query(
    "SELECT doc_id, array_to_string(t, '; ') AS tags FROM (SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in _TAGS)
    + "], lambda x: x IS NOT NULL) AS t FROM documents) WHERE len(t) > 0"
)
def infer_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", m.tags(F.col("text"), _TAGS).alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", "; ").alias("tags"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'misc' WHEN regexp_matches(text, '(?i)license') THEN 'techreport' WHEN n_chars > 5000 THEN 'book' WHEN quality IS NULL THEN 'unknown' ELSE 'article' END AS entry_type
FROM documents LEFT JOIN labels USING (doc_id)""")
def entry_type_cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [
        (F.col("toxic") == 1, "flagged"), (F.col("quality") == 0, "misc"), (F.col("text").rlike("(?i)license"), "techreport"),
        (F.col("n_chars") > 5000, "book"), (F.col("quality").isNull(), "unknown"),
    ]
    return rows.select("doc_id", m.cascade(rules, "article").alias("entry_type"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4), ' ') AS words FROM documents""")
def long_words(spark, sf_dir):
    words = F.filter(F.split(title_words(F.col("text")), " "), lambda x: F.length(x) >= 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


_TOKENS = r"""SELECT doc_id, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda y: y.x), 1, 18), ' ') AS tokens
FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4) AS w FROM documents)"""


@query(_TOKENS)
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(significant_tokens(F.col("text"), 18), " ").alias("tokens"))


@query("""SELECT md5(text) AS key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1""")
def last_wins_by_content(spark, sf_dir):
    return last_wins(table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "source"), ["key"], ["doc_id"])


# white space of Unicode, spelled for a regex without Unicode classes
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS text FROM pages""")
def markup_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))

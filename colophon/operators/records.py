"""Records and notes: search results scored against a record, note headers merged with resolved metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import audit_tags, methods, regions, source_tag
from ..functions.names import JOURNALS, dropping_title_words, entry_type, unknown_journal
from ..functions.text import first_of, normalize_space, ratio, slug
from .notes import is_stub_text


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def best_result(asked: DataFrame, results: DataFrame, id_: str, least: float, author: bool = True) -> DataFrame:
    """(id, place, score): of a record's search results the one of highest score, the earlier on ties, if it reaches ``least``.

    ``asked``: id, title, year, author, venue.  ``results``: id, place, title, year, authors, venue (both texts).  Titles
    count by their similarity, an equal year 0.08 more; with ``author`` also a named author 0.06 and the venue 0.05.
    """
    given = asked.select(id_, dropping_title_words(F.col("title")).alias("t"), *(F.coalesce(k, F.lit("")).alias(k[0]) for k in ("year", "author", "venue")))
    met = given.join(results.select(id_, "place", F.col("title").alias("r_title"), F.col("year").alias("r_year"), F.col("authors").alias("r_a"), F.col("venue").alias("r_v")), id_)
    score = _ratio("t", dropping_title_words(normalize_space(F.coalesce("r_title", F.lit("")))))
    score = score + F.when((F.col("y") != "") & (F.col("r_year").cast("string") == F.col("y")), 0.08).otherwise(0.0)
    if author:
        score = score + F.when((F.col("a") != "") & F.lower("r_a").contains(F.lower("a")), 0.06).otherwise(0.0)
        venue = dropping_title_words(F.col("v"))
        score = score + F.when((venue != "") & dropping_title_words(F.lower("r_v")).contains(venue), 0.05).otherwise(0.0)
    best = met.select(id_, "place", score.alias("score")).groupBy(id_).agg(F.min_by(F.struct("place", "score"), F.struct(-F.col("score"), F.col("place"))).alias("b"))
    return best.select(id_, "b.place", "b.score").where((F.col("score") >= least) & (F.col("score") > 0))


def _clean(c: Column) -> Column:
    """A list's texts without surplus blanks and empty ones."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: normalize_space(x)), lambda x: x != "")


def merged_header(rows: DataFrame, category: str, today: str, replace_title: Column, fixed_tags: tuple[str, ...] = ("source-note",), folder: str | None = None) -> DataFrame:
    """A note's header (struct ``note``) merged with resolved metadata (struct ``found``); one row each, with dir and stem.

    The note's values stand unless it only holds imported metadata or awaits a review, then the resolved ones do.  A title
    is replaced where ``replace_title`` holds.  Methods and regions that the note does not name come from title and
    abstract.  Of the tags, those that name a source or type are made anew, after ``fixed_tags`` and the category's, and
    the review tags follow from what is known.  Fields that the note's struct lacks are missing values; ``folder`` is
    where its file lies (the note's dir, if not given).
    """
    has = set(rows.schema["note"].dataType.names)
    n = lambda k: F.col("note")[k] if k in has else F.lit(None).cast("string")
    listed = lambda k: _clean(F.col("note")[k]) if k in has else F.array().cast("array<string>")
    m = lambda k: F.col("found")[k]
    text = lambda c: normalize_space(F.coalesce(c.cast("string"), F.lit("")))
    old = listed("tags")
    renew = (F.lower(text(n("status"))) == "imported-metadata") | F.array_contains(old, "metadata-review")
    pick = lambda k: text(first_of(F.when(renew, m(k)), n(k), m(k)))
    title = F.when((replace_title | (text(n("title")) == "")) & (text(m("title")) != ""), text(m("title"))).otherwise(text(n("title")))
    whose = F.when((renew & (F.size(_clean(m("authors"))) > 0)) | (F.size(listed("authors")) == 0), _clean(m("authors"))).otherwise(listed("authors"))
    doi = F.lower(pick("doi"))
    either = lambda k: F.when(renew, first_of(m(k), n(k))).otherwise(first_of(n(k), m(k)))
    out = rows.select(
        "dir", "stem", "note", "found", F.lit("source-note").alias("type"), first_of(title, F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"),
        F.array_distinct(F.concat(listed("aliases"), F.array("stem"))).alias("aliases"), whose.alias("authors"), pick("year").alias("year"),
        pick("venue").alias("venue"), pick("publisher").alias("publisher"), F.lit(category).alias("category"),
        listed("topics").alias("topics"), listed("keywords").alias("keywords"),
        first_of(text(n("status")), F.lit("imported-metadata")).alias("status"), doi.alias("doi"),
        first_of(pick("url"), F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))).alias("url"), F.lit(today).alias("last_reviewed"),
        F.concat(F.lit("[["), F.lit(folder) if folder else F.col("dir"), F.lit("/"), "stem", F.lit(".pdf]]")).alias("pdf_local"),
        either("entry_type").alias("given"), either("journal_abbr").alias("code"), first_of(text(n("note")) if "note" in has else F.lit("")).alias("remark"),
    )
    told = lambda k, made: F.when(F.size(listed(k)) > 0, listed(k)).otherwise(made(F.col("title"), m("abstract")))
    out = out.withColumn("methods", told("methods", methods)).withColumn("regions", told("regions", regions))
    thesis = F.lit(category == "Good Dissertation")
    record = {"venue": F.col("venue"), "journal_abbr": F.col("code"), "entry_type": F.col("given"), "publisher": F.col("publisher"), "note": F.col("remark"), "title": F.col("title")}
    kind = entry_type(F.col("given"), F.col("venue"), F.col("publisher"), F.col("remark"), F.col("title"), F.col("code"), thesis)
    out = out.withColumn("entry_type", kind).withColumn("journal_abbr", source_tag(record, F.col("code"), thesis))
    # Tags that name a source or a type.
    gone = F.array(*map(F.lit, (*JOURNALS, "wp", "misc", "book", "wpol", "article")), F.lower(text(n("journal_abbr"))), F.lower(text(m("journal_abbr"))), unknown_journal(F.col("venue")))
    words = F.concat_ws(" ", "title", m("abstract"), F.array_join("methods", " "), F.array_join("keywords", " "), F.array_join("topics", " "))
    made = F.concat(
        F.array_except(old, gone), F.array(*map(F.lit, fixed_tags), F.replace(slug(F.lit(category)), F.lit("_"), F.lit("-"))),
        F.array_compact(F.array(F.nullif("journal_abbr", F.lit("")), F.when(F.col("entry_type") == "article", "article"))), audit_tags(words),
    )
    review = (text(m("source")) == "fallback") | (F.col("title") == "") | ((F.size("authors") == 0) & (F.col("venue") == ""))
    made = F.filter(F.array_distinct(made), lambda t: t != "metadata-review")
    made = F.when(review, F.concat(made, F.array(F.lit("metadata-review")))).otherwise(made)
    out = out.withColumn("tags", made).withColumn("tags", F.when(is_stub_text(F.col("status"), F.col("tags"), F.lit("")), F.array_union("tags", F.array(F.lit("needs-summary")))).otherwise(F.col("tags")))
    return out.drop("note", "found", "given", "code", "remark")

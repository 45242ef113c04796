"""Reference sections of page texts: which pages, which lines, which references, which titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import citations as c
from ..functions.text import bound, normalize_space, reference_id
from .references import similar_components
from .stages import settled, stored

_MARK = "\x01"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")


@F.pandas_udf(T.StringType())
def two_columns(texts: pd.Series) -> pd.Series:
    """A page laid out in two columns as one column, left then right; null for other pages.

    The columns part at the median middle of wide gaps; 45 % of the gaps must lie within 12 characters of it.
    """
    import re

    import numpy as np

    def one(text):
        rows = (text or "").splitlines()
        middles = np.array([sum(m.span()) // 2 for row in rows for m in re.finditer(" {14,}", row)])
        if len(middles) < 20:
            return None
        at = int(np.median(middles))
        if not 55 <= at <= 120 or (np.abs(middles - at) <= 12).mean() < 0.45:
            return None
        left = [x for x in (row[:at].rstrip() for row in rows) if x]
        right = [x for x in (row[at:].strip() for row in rows) if x]
        return "\n".join([*left, "", *right])

    return texts.map(one)


def scored_pages(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, refs, lines, heading, appendix): counts of lines shaped like references, per page, without a shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = lambda rows: F.struct(F.size(F.filter(rows, c.citation_line)).alias("refs"), F.size(rows).alias("lines"))
    said = F.filter(F.transform(_lines(F.col(text)), lambda x: normalize_space(x, soft_hyphen=True)), lambda x: x != "")
    found = bound(said, counts)
    return pages.select(
        doc, page, found.alias("n_"), body.rlike("(?U)" + c.HEADING).alias("heading"), body.rlike("(?U)" + c.APPENDIX).alias("appendix"),
    ).select(doc, page, "n_.refs", "n_.lines", "heading", "appendix")


def reference_pages(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, method) of the pages that hold the reference list.

    ``header``: from the last page with a heading, pages with references, up to the first page without any or with
    few before an appendix.  ``density``, for documents without a heading: of the last 25 pages the run with most
    reference lines (then the later, then the longer).  A document with neither has no rows.  Only counts are shuffled.
    """
    whole = Window.partitionBy(doc)
    few = F.greatest(F.col("lines"), F.lit(1))
    # counts of pages are read more than once, the texts are not
    rows = settled(scored_pages(pages, doc, page, text)).withColumn("start", F.max(F.when(F.col("heading"), F.col(page))).over(whole))
    rows = rows.withColumn("has", (F.col(page) == F.col("start")) | (F.col("refs") >= 3) | ((F.col("refs") >= 2) & (F.col("refs") / few >= F.lit(0.08))))
    ends = (F.col(page) > F.col("start")) & ~F.col("has") & (F.col("appendix") | (F.col("refs") == 0))
    rows = rows.withColumn("stop", F.min(F.when(ends, F.col(page))).over(whole)).withColumn("last", F.max(page).over(whole))
    headed = rows.where(F.col("has") & (F.col(page) >= F.col("start")) & (F.col("stop").isNull() | (F.col(page) < F.col("stop"))))
    strong = (F.col("refs") >= 5) | ((F.col("refs") >= 3) & (F.col("refs") / few >= F.lit(0.11)))
    dense = rows.where(F.col("start").isNull() & strong & (F.col(page) >= F.greatest(F.lit(1), F.col("last") - 24)))
    dense = dense.withColumn("run", F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page)))
    runs = dense.groupBy(doc, "run").agg(F.sum("refs").alias("s"), F.max(page).alias("l"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(doc).agg(F.max_by("run", F.struct("s", "l", "n")).alias("run"))
    return headed.select(doc, page, F.lit("header").alias("method")).unionByName(dense.join(best, [doc, "run"], "left_semi").select(doc, page, F.lit("density").alias("method")))


def page_lines(text: Column, first: Column) -> Column:
    """Lines of a page that belong to references: from the heading on (on the first page), without what the journal prints
    on top, without dropped lines, lines that hold several references divided."""
    rows = _lines(F.when(first, c.after_heading(F.coalesce(text, F.lit("")))).otherwise(text))
    keep = lambda x: (normalize_space(x, soft_hyphen=True) != "") & ~c.running_header(x)
    none = F.array().cast("array<string>")
    start = lambda rows: bound(F.array_position(F.transform(rows, keep), True), lambda at: F.when(at > 0, F.slice(rows, F.greatest(at, F.lit(1)).cast("int"), F.size(rows))).otherwise(none))
    body = bound(rows, start)
    return F.flatten(F.transform(F.filter(body, lambda x: ~c.dropped_line(x)), lambda x: c.split_inline(F.rtrim(F.replace(x, F.lit("­"), F.lit(""))))))


def page_references(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, place, reference): a reference runs from a line that starts one to the next, and ends with its page.

    Lines are marked and joined inside their row, so nothing is shuffled but the number of each document's first page.
    """
    firsts = pages.groupBy(doc).agg(F.min(page).alias("first_"))
    # a reference has a year, so a page without one has none
    rows = pages.select(doc, page, text).where(F.col(text).rlike("(?U)" + c.YEAR)).join(firsts, doc)
    rows = rows.select(doc, page, page_lines(F.col(text), F.col(page) == F.col("first_")).alias("l_"))
    clean = lambda x: normalize_space(F.translate(x, _MARK, " "), soft_hyphen=True)
    marked = F.transform(F.transform("l_", clean), lambda x: F.when(c.starts_reference(x), F.concat(F.lit(_MARK), x)).otherwise(x))
    parts = F.filter(F.transform(F.split(F.array_join(marked, " "), _MARK), c.finished), c.is_reference)
    return rows.select(doc, page, F.posexplode(parts).alias("place", "reference"))


def parsed_references(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, reference_index from 1, reference, norm): each document's references once, by comparison key of 20 characters or more."""
    rows = page_references(pages, doc, page, text).withColumn("norm", c.compare_key(F.col("reference"))).where(F.length("norm") >= 20)
    once = rows.groupBy(doc, "norm").agg(F.min_by(F.struct(page, "place", "reference"), F.struct(page, "place")).alias("r"))
    index = F.row_number().over(Window.partitionBy(doc).orderBy(f"r.{page}", "r.place"))
    return once.select(doc, index.alias("reference_index"), F.col("r.reference").alias("reference"), "norm")


def reference_titles(rows: DataFrame, text: str, order: str) -> DataFrame:
    """(key, title): titles of all references, of equal keys the first spelling."""
    found = rows.select(order, F.posexplode(c.titles(F.col(text))).alias("at_", "title")).withColumn("key", c.title_key(F.col("title")))
    return found.where("key <> ''").groupBy("key").agg(F.min_by("title", F.struct(order, "at_")).alias("title"))


def mined(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, method, reference_index, reference, norm): the references on the pages that hold each document's list."""
    held = settled(reference_pages(pages, doc, page, text))
    found = parsed_references(pages.join(held.select(doc, page), [doc, page], "left_semi"), doc, page, text)
    return found.join(held.select(doc, "method").distinct(), doc).select(doc, "method", "reference_index", "reference", "norm")


def mining_status(pages: DataFrame, references: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, pages, start, end, method, extracted, note) of every document, with or without a list."""
    held = reference_pages(pages, doc, page, text).groupBy(doc).agg(F.min(page).alias("start"), F.max(page).alias("end"), F.first("method").alias("method"))
    count = references.groupBy(doc).agg(F.count(F.lit(1)).alias("extracted"))
    every = pages.groupBy(doc).agg(F.max(page).alias("pages")).join(held, doc, "left").join(count, doc, "left")
    # Fixed value: what is noted where nothing was found.
    note = F.when(F.col("start").isNull(), "no standard references section detected").otherwise("")
    return every.select(doc, "pages", "start", "end", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("extracted", F.lit(0)).alias("extracted"), note.alias("note"))


def distinct_references(references: DataFrame, doc: str) -> DataFrame:
    """(reference_id, reference_text, source_pdf_count, source_pdfs) of references that are the same, in order of their key.

    Same are equal keys, and similar ones that begin with the same word and give the same year.
    """
    norm, year = F.col("norm"), F.regexp_extract(F.left("reference", F.lit(220)), f"(?U)({c.YEAR})", 1)
    rows = settled(references).withColumn("token_", F.split(norm, " ")[0]).withColumn("year_", year).where("norm <> ''").withColumn("id_", F.sha2(F.concat_ws("\x1f", "token_", "year_", "norm"), 256))
    firsts = stored(rows.select("token_", "year_", "norm", "id_").distinct())
    parts = similar_components(firsts, ["token_", "year_"], "id_", "norm").withColumnRenamed("id", "id_")
    made = rows.withColumnRenamed("reference", "text_").join(parts, "id_")
    best = made.groupBy("component").agg(F.min_by(F.struct("text_", "norm"), F.struct(-F.length("text_"), "text_")).alias("c_"), F.array_sort(F.collect_set(F.col(doc).cast("string"))).alias("o_"))
    out = best.select(
        reference_id(F.col("c_.norm")).alias("reference_id"), F.col("c_.text_").alias("reference_text"), F.size("o_").cast("long").alias("source_pdf_count"),
        F.array_join("o_", " | ").alias("source_pdfs"), F.col("c_.norm").alias("norm"),
    )
    return out.orderBy("norm", "reference_id").drop("norm")

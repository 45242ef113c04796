"""Texts of notes: links to files, headings, sections that are made anew, whole new notes, and legacy notes that move.

Nothing is written: what would be comes out as (dir, stem, text) rows or as actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_space
from ..sources.readers import header_yaml, section
from .notes import _rejoined, basic_information, is_stub_text, with_section

PDF_LINK = r"\[\[([^/\]|]+/[^|\]]+\.pdf(?:\|[^\]]+)?)\]\]"
_TEXTS = "array<string>"


def _links(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the pieces between a text's links to files, and the links' insides."""
    return rows.withColumn("pieces", F.split(text, PDF_LINK)).withColumn("links", F.regexp_extract_all(text, F.lit(PDF_LINK), F.lit(1)))


def repaired_file_links(texts: DataFrame, id_: str, text: str, folders: DataFrame, files: DataFrame, own: Column) -> DataFrame:
    """``texts`` with every link to a PDF in its collection's present folder (``folders``: folder, pdf_dir), and links to
    files (``files``: path) that are not there turned to the note's own file ``own``; labels stay.

    Links are looked up as rows, each distinct target once, and put back in place.
    """
    rows = _links(texts.withColumn("own_", own), text)
    one = rows.select(id_, "own_", F.posexplode("links").alias("i", "inner"))
    one = one.withColumn("folder", F.split("inner", "/", 2)[0]).withColumn("rest", F.substring("inner", F.length("folder") + 2, F.length("inner")))
    one = one.withColumn("name", F.split("rest", r"\|", 2)[0]).withColumn("label", F.regexp_extract("rest", r"(?s)^[^|]*(\|.*)$", 1))
    moved = one.join(folders.select("folder", "pdf_dir").dropDuplicates(["folder"]), "folder", "left").withColumn("to", F.concat(F.coalesce("pdf_dir", "folder"), F.lit("/"), "name"))
    there = files.select(F.col("path").alias("to"), F.lit(True).alias("there")).dropDuplicates(["to"])
    put = moved.join(there, "to", "left").select(id_, "i", F.concat(F.when(F.col("there"), F.col("to")).otherwise(F.col("own_")), "label").alias("new"))
    put = put.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("put"))
    new = F.transform("links", lambda x, i: F.concat(F.lit("[["), F.coalesce(F.element_at("put", i), x), F.lit("]]")))
    out = rows.join(put, id_, "left").withColumn("put", F.coalesce("put", F.create_map().cast("map<int,string>")))
    return out.withColumn(text, F.coalesce(_rejoined("pieces", new), F.col(text))).drop("pieces", "links", "put", "own_")


def headed(body: Column, title: Column) -> Column:
    """A body under its title: an old title is replaced, repeated ones go."""
    body = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+", "")
    head = F.concat(F.lit("# "), title)
    rest = F.when(body.startswith("# "), F.regexp_replace(body, r"^[^\n]*\n?", "")).otherwise(F.concat(F.lit("\n"), body))
    lines = F.split(rest, "\n")
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: F.trim(x) != head), True), F.lit(0))
    rest = F.when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")).otherwise("")
    end = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    return F.when(body == "", F.concat(head, F.lit("\n"))).otherwise(F.concat(end(F.concat(head, F.lit("\n"), rest)), F.lit("\n")))


def status_lines(source: Column, today: str) -> Column:
    """Lines on where a note's metadata comes from."""
    # The lines.
    guess = "- Metadata is still partially inferred from the local file; manual review is recommended."
    sure = "- Core citation fields were refreshed from the PDF and external metadata."
    return F.concat(F.lit(f"- Synced on {today} from local PDF and metadata lookup.\n"), F.when(source == "fallback", guess).otherwise(sure))


_INFORMATION = ("authors", "year", "venue", "doi")


def refreshed(rows: DataFrame, today: str) -> DataFrame:
    """(dir, stem, text, changed) of notes as they would be written.

    ``rows``: dir, stem, old (the file's text), header (the merged header as a struct with title, status and tags), body,
    found (resolved metadata: authors, year, venue, doi, volume, issue, pages, abstract, source) and pdf (the file).  Stubs
    get their sections anew; other notes get an abstract where they have none.  A new note has a null ``old``.
    """
    m = lambda k: F.col("found")[k]
    abstract = normalize_space(F.coalesce(m("abstract"), F.lit("")))
    held = section(F.col("body"), "Abstract / Extracted Summary")
    about = basic_information(*(m(k) for k in _INFORMATION), F.col("pdf"), m("volume"), m("issue"), m("pages"))
    body = headed(F.col("body"), F.col("header")["title"])
    stub = with_section(with_section(body, "Metadata Status", status_lines(m("source"), today)), "Basic Information", about)
    stub = F.when((abstract != "") | (held == ""), with_section(stub, "Abstract / Extracted Summary", abstract)).otherwise(stub)
    stub = F.when(section(stub, "Notes") == "", with_section(stub, "Notes", F.lit("- "))).otherwise(stub)
    full = F.when((abstract != "") & held.isin("", "-"), with_section(body, "Abstract / Extracted Summary", abstract)).otherwise(body)
    bare = is_stub_text(F.col("header")["status"], F.col("header")["tags"], body)
    made = F.regexp_replace(F.when(bare, stub).otherwise(full), r"(?U)\s+\z", "")
    out = rows.select("dir", "stem", "old", F.to_json("header", {"ignoreNullFields": "false"}).alias("h_"), made.alias("body"))
    text = F.concat(header_yaml("h_"), "body", F.lit("\n"))
    return out.select("dir", "stem", text.alias("text"), "old").select("dir", "stem", "text", (F.col("old").isNull() | (F.col("text") != F.col("old"))).alias("changed"))


def new_notes(rows: DataFrame, today: str) -> DataFrame:
    """(dir, stem, text) of notes for files that have none: rows as in ``refreshed``, without old and body."""
    m = lambda k: F.col("found")[k]
    about = basic_information(*(m(k) for k in _INFORMATION), F.col("pdf"), m("volume"), m("issue"), m("pages"))
    parts = [
        F.concat(F.lit("# "), F.col("header")["title"]), F.lit(""), F.lit("## Metadata Status"), status_lines(m("source"), today), F.lit(""), F.lit("## Basic Information"), about,
        F.lit(""), F.lit("## Abstract / Extracted Summary"), normalize_space(F.coalesce(m("abstract"), F.lit(""))), F.lit(""), F.lit("## Notes"), F.lit("- "), F.lit(""),
    ]
    tags = F.array_union(F.col("header")["tags"], F.array(F.lit("needs-summary")))
    header = F.col("header").withField("status", F.lit("imported-metadata")).withField("tags", tags)
    out = rows.select("dir", "stem", F.to_json(header, {"ignoreNullFields": "false"}).alias("h_"), F.array_join(F.array(*parts), "\n").alias("body"))
    return out.select("dir", "stem", F.concat(header_yaml("h_"), "body").alias("text"))


def redirected(notes: DataFrame, redirects: DataFrame) -> DataFrame:
    """(dir, stem, target, action, aliases): legacy notes that move to a new name (``move``) or go into the note that is
    there (``merge``), with the aliases that the target has then.  ``redirects``: dir, stem, target."""
    names = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(_TEXTS)), lambda x: normalize_space(x)), lambda x: x != "")
    old = redirects.join(notes.select("dir", "stem", F.col("aliases").alias("a_")), ["dir", "stem"])
    out = old.join(notes.select("dir", F.col("stem").alias("target"), F.col("aliases").alias("t_"), F.lit(True).alias("there")), ["dir", "target"], "left")
    base = F.when(F.col("there"), names("t_")).otherwise(names("a_"))
    aliases = F.array_distinct(F.concat(base, F.array("stem", "target"), names("a_")))
    return out.select("dir", "stem", "target", F.when(F.col("there"), "merge").otherwise("move").alias("action"), aliases.alias("aliases"))

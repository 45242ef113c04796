"""Readers: every boundary has an explicit schema."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_of, slug

WORK = (
    "id string, doi string, display_name string, title string, publication_year int, publication_date string, "
    "authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<landing_page_url: string, pdf_url: string, source: struct<display_name: string>>, "
    "best_oa_location struct<landing_page_url: string, pdf_url: string>, "
    "open_access struct<is_oa: boolean, oa_status: string, oa_url: string>, "
    "locations array<struct<landing_page_url: string, pdf_url: string>>, "
    "biblio struct<volume: string, issue: string, first_page: string, last_page: string>, "
    "keywords array<struct<display_name: string>>, concepts array<struct<display_name: string>>, "
    "abstract_inverted_index map<string, array<int>>, ids struct<doi: string>"
)
DATE = "struct<`date-parts`: array<array<int>>>"
ITEM = (
    "DOI string, URL string, type string, title array<string>, `container-title` array<string>, "
    "author array<struct<given: string, family: string>>, page string, volume string, issue string, publisher string, abstract string, "
    f"`published-print` {DATE}, `published-online` {DATE}, published {DATE}, issued {DATE}, created {DATE}, "
    "link array<struct<URL: string, `content-type`: string>>"
)
PENDING = ("code", "display_name", "openalex_source_id", "filename_slug", "publisher", "publisher_domains", "title_aliases", "collections", "note_count", "sample_note", "updated")


def works(spark: SparkSession, path: str) -> DataFrame:
    """Captured work records, one JSON object a line."""
    return spark.read.schema(WORK).json(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quoted line breaks and an optional byte-order mark; all columns are strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumnsRenamed({c: c.removeprefix("﻿") for c in rows.columns})


def pick(rows: DataFrame, *names: str):
    """The first non-empty of alternative columns, of those that exist."""
    return first_of(*(F.col(f"`{n}`") for n in names if n in rows.columns), F.lit(""))


def pending_sources(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path)
    out = rows.select(*(pick(rows, c).alias(c) for c in PENDING)).where("code <> '' AND display_name <> '' AND filename_slug <> ''")
    for c in ("publisher_domains", "title_aliases"):
        out = out.withColumn(c, F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""))
    return out


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: (path, size, header, body); empty files and names that begin with _ are skipped."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw")
    )
    head = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    return raw.where("size > 0 AND NOT startswith(name, '_')").select(
        "path", "size", F.regexp_extract("raw", head, 1).alias("header"), F.when(F.col("raw").rlike(head), F.regexp_extract("raw", head, 2)).otherwise(F.col("raw")).alias("body")
    )


def section(body, heading: str):
    """Text under ``## heading`` up to the next heading of that level."""
    found = F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?ms)^## \Q{heading}\E[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Notes with their header as a map of JSON values; a header that is no mapping or cannot be read is empty."""
    return notes(spark, path).withColumn("header", F.from_json(header_json("header"), "map<string,string>"))


@F.pandas_udf(T.StringType())
def header_json(s: pd.Series) -> pd.Series:
    """A YAML block as a JSON object: texts as they are, lists and numbers as JSON."""
    import json

    import yaml

    def one(block):
        try:
            got = yaml.safe_load(block or "") or {}
        except yaml.YAMLError:
            return "{}"
        if not isinstance(got, dict):
            return "{}"
        plain = {str(k): v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False, default=str) for k, v in got.items()}
        return json.dumps(plain, ensure_ascii=False)

    return s.map(one)


@F.pandas_udf(T.StringType())
def header_yaml(s: pd.Series) -> pd.Series:
    """A JSON object as the YAML block of a note: keys in order, characters as they are."""
    import json

    import yaml

    def one(x):
        return f"---\n{yaml.safe_dump(json.loads(x), sort_keys=False, allow_unicode=True, default_flow_style=False).strip()}\n---\n"

    return s.map(one)


# Directories that hold no collections, beside those whose names begin with a dot.
SYSTEM_DIRS = ("_Preprocess", "_Duplicates", "Notes", "Reading Notes", "Reference", "reference", "Diary")


def collections(files: DataFrame, known: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(pdf_dir, note_dir, category, bib_name, source) of the directories that hold a PDF directly.

    ``files`` has path (relative to the root).  A directory in ``known`` has what that says, any other its own name.
    ``wanted`` are names of directories (blanks for underscores), or of notes or categories that ``known`` gives them.
    """
    at = F.split("path", "/")
    dirs = files.where(F.col("path").rlike(r"^[^/]+/[^/]+\.pdf$")).select(at[0].alias("pdf_dir")).distinct()
    dirs = dirs.where(~F.col("pdf_dir").isin(*SYSTEM_DIRS) & ~F.col("pdf_dir").startswith("."))
    told = known.select("pdf_dir", F.col("note_dir").alias("n_"), F.col("category").alias("c_"), F.col("bib_name").alias("b_"))
    rows = dirs.join(told, "pdf_dir", "left")
    if wanted:
        named = F.col("pdf_dir").isin(*wanted) | F.replace("pdf_dir", F.lit("_"), F.lit(" ")).isin(*wanted)
        rows = rows.where(named | F.coalesce(F.col("n_").isin(*wanted) | F.col("c_").isin(*wanted), F.lit(False)))
    return rows.select(
        "pdf_dir", F.coalesce("n_", "pdf_dir").alias("note_dir"), F.coalesce("c_", "pdf_dir").alias("category"),
        F.coalesce("b_", F.concat(slug(F.col("pdf_dir"), "collection"), F.lit(".bib"))).alias("bib_name"), F.when(F.col("n_").isNull(), "auto").otherwise("explicit").alias("source"),
    )


def folder_names(rows: DataFrame) -> DataFrame:
    """(folder, pdf_dir): every name that a collection's folder goes by."""
    return rows.select(F.explode(F.array_distinct(F.array("pdf_dir", "note_dir", "category"))).alias("folder"), "pdf_dir")

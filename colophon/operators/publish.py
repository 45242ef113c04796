"""Publication: manifest sets, bibliographies of folders, summaries and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bib import bib_entry, bib_fields
from ..functions.names import bib_names, canonical_code, entry_type
from ..functions.text import first_of, normalize_space
from .joins import first_wins, last_wins

#: Fields that bibliographies leave out.
OMITTED = frozenset({"doi", "file"})
_NOTE = ("title", "year", "venue", "publisher", "volume", "issue", "pages", "note", "url", "doi", "journal_abbr", "entry_type")


def joined_set(c: str) -> Column:
    """A set column as text: sorted, separated by semicolons."""
    return F.array_join(F.array_sort(c), "; ")


def bibliography(entries: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Entries by key, the last of a key wins, sorted by key."""
    return last_wins(entries, [key], [order]).orderBy(key)


def folder_entries(files: DataFrame, notes: DataFrame, omit: frozenset[str] = OMITTED) -> DataFrame:
    """(dir, key, entry) of every file (dir, stem): from the note of its stem, or from its name alone.

    ``notes`` has dir, stem, authors and the columns title, year, venue, publisher, volume, issue, pages, note, url, doi,
    journal_abbr and entry_type as text.
    """
    text = lambda k: normalize_space(F.coalesce(F.col(k).cast("string"), F.lit("")))
    rows = files.select("dir", "stem").join(notes.select("dir", "stem", "authors", *(F.col(k).alias(f"n_{k}") for k in _NOTE)), ["dir", "stem"], "left")
    rows = rows.select("dir", "stem", "authors", *(text(f"n_{k}").alias(k) for k in _NOTE))
    rows = rows.withColumn("id_", F.struct("dir", "stem")).withColumn("title", first_of(F.col("title"), F.replace("stem", F.lit("_"), F.lit(" "))))
    names = bib_names(rows.select("id_", "authors"), "id_", "authors")
    thesis = F.col("dir") == "Good Dissertation"
    made = entry_type(F.lit(""), F.col("venue"), F.col("publisher"), F.col("note"), F.col("title"), F.col("journal_abbr"), thesis)
    rows = rows.join(names, "id_", "left").withColumn("kind", first_of(F.col("entry_type"), made))
    record = {k: F.col(k) for k in ("author", "title", "year", "venue", "publisher", "volume", "issue", "pages", "note", "url", "doi")}
    record["file"] = F.concat("dir", F.lit("/"), "stem", F.lit(".pdf"))
    return rows.select("dir", F.col("stem").alias("key"), bib_entry(F.col("kind"), F.col("stem"), bib_fields(F.col("kind"), record, omit)).alias("entry"))


def code_venues(known: dict[str, str], notes: DataFrame) -> DataFrame:
    """(code, venue): the known journals, then of the notes (path, venue, journal_abbr) the first venue of each code."""
    venue = normalize_space(F.coalesce("venue", F.lit("")))
    own = notes.select(canonical_code(F.col("journal_abbr"), venue).alias("code"), venue.alias("venue"), F.lit(1).alias("k"), F.col("path").alias("at"))
    spark = notes.sparkSession
    seed = spark.createDataFrame([(c, v, 0, "") for c, v in known.items()], "code string, venue string, k int, at string")
    return first_wins(seed.unionByName(own.where("code <> '' AND venue <> ''")), ["code"], ["k", "at"]).select("code", "venue")


def folder_counts(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(dir, pdf_count, note_count, metadata_review_count) of every directory of either (dir); notes have tags."""
    pdfs = files.groupBy("dir").agg(F.count(F.lit(1)).alias("pdf_count"))
    kept = notes.groupBy("dir").agg(F.count(F.lit(1)).alias("note_count"), F.count_if(F.array_contains("tags", "metadata-review")).alias("metadata_review_count"))
    return pdfs.join(kept, "dir", "full").select("dir", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("pdf_count", "note_count", "metadata_review_count")))


def mining_summary(status: DataFrame, references: int, distinct: int) -> DataFrame:
    """One row of counts and lists over ``status`` (doc, start, extracted): what was mined and from what."""
    lost, none = F.col("start").isNull(), F.col("start").isNotNull() & (F.col("extracted") == 0)
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("doc"))))
    return status.agg(
        F.count(F.lit(1)).alias("pdf_count"), F.count_if(~lost).alias("pdfs_with_detected_references"), F.lit(references).cast("long").alias("total_extracted_reference_rows"),
        F.lit(distinct).cast("long").alias("total_deduped_references"), names(lost).alias("pdfs_without_detected_references"), names(none).alias("pdfs_with_zero_parsed_entries"),
    )


def discovery_summary(rows: DataFrame, config: dict) -> DataFrame:
    """One row: the configuration as it is, and how many rows were downloaded or are metadata only (``downloaded`` yes or no)."""
    echo = [F.lit(v).alias(k) if not isinstance(v, list | tuple) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in config.items()]
    yes = F.col("downloaded") == "yes"
    counts = rows.agg(F.count(F.lit(1)).alias("total_candidates"), F.count_if(yes).alias("downloaded_rows"), F.count_if(~yes).alias("metadata_only_rows"))
    return counts.select(*echo, "total_candidates", "downloaded_rows", "metadata_only_rows")


def in_discovery_order(works: DataFrame, seq: str = "seq") -> DataFrame:
    """Works by the journal's slug, year (0 if unknown) and title; equal ones in the order they were found."""
    return works.orderBy(F.coalesce("source_slug", F.lit("")), F.coalesce("publication_year", F.lit(0)), F.coalesce("display_name", F.lit("")), seq)


def missing(rows: DataFrame, order: str = "index") -> DataFrame:
    """Rows that were not downloaded, in the order of the input."""
    return rows.where("downloaded = 'no'").orderBy(order)

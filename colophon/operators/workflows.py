"""The engine's operators put together: discovery, the mining of reference lists, and the state of a vault of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_of, normalize_doi
from . import citations as oc
from . import notes as o
from .discovery import fetch_outcomes
from .matching import discovered, upsert
from .publish import bibliography, folder_counts, folder_entries, in_discovery_order, mining_summary
from .relations import note_topics, related_lines, related_notes
from .stages import settled

PROVENANCE = ["matched_terms", "matched_fields", "search_queries", "discovery_strategies", "metadata_sources"]


def candidates(hits: list[tuple[DataFrame, str]], keywords: list[str], fields: tuple[str, ...] = ("title", "abstract"), mode: str = "any") -> DataFrame:
    """Works of all providers that the keywords find, one row a work, with where and how it was found.

    ``hits`` are (works with slug, query, strategy and seq, provider), in the order of the providers; the first row of a
    work stands, and what found it is united.  Rows come in the order of discovery.
    """
    every = None
    for k, (works, provider) in enumerate(hits):
        met = discovered(works, keywords, fields, mode)
        one = met.withColumns(
            {"search_queries": F.array("query"), "discovery_strategies": F.array("strategy"), "metadata_sources": F.array(F.lit(provider)), "provider_": F.lit(k)}
        ).drop("query", "strategy")
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    keyed = every.withColumn("key", first_of(normalize_doi(F.col("doi")), F.col("id")))
    out = upsert(keyed, ["key"], ["provider_", "seq"], PROVENANCE).drop("provider_")
    return in_discovery_order(out.withColumnRenamed("slug", "source_slug"))


def downloads(works: DataFrame, urls: DataFrame, log: DataFrame, columns: list[str]) -> DataFrame:
    """Works with whether a PDF of theirs could be fetched, from where, and what the last answer was."""
    got = fetch_outcomes(urls, log, "key", columns)
    return works.join(got.select("key", F.when(F.col("ok"), "yes").otherwise("no").alias("downloaded"), F.col("url").alias("pdf_url"), F.col("note").alias("download_note")), "key", "left")


def mining(pages: DataFrame, doc: str, page: str, text: str = "text") -> dict[str, DataFrame]:
    """From page texts to ``references`` (by document), ``distinct`` ones, ``titles``, ``status`` (by document) and a ``summary``."""
    found = settled(oc.mined(pages, doc, page, text))
    status = settled(oc.mining_status(pages, found, doc, page, text))
    distinct = settled(oc.distinct_references(found, doc))
    titles = oc.reference_titles(distinct.withColumn("at", F.struct("reference_text", "reference_id")), "reference_text", "at").orderBy("key")
    summary = mining_summary(status.withColumnRenamed(doc, "doc").select(F.col("doc").cast("string").alias("doc"), "start", "extracted"), found.count(), distinct.count())
    return {"references": found, "distinct": distinct, "titles": titles, "status": status, "summary": summary}


def vault(files: DataFrame, notes: DataFrame, root: str = "Notes") -> dict[str, DataFrame]:
    """What a vault needs, as rows: ``renames`` of files, notes that go into others (``merges``) or go (``prunes``), links that
    change (``links``), ``related`` lines, the ``bibliography`` and ``counts``.

    ``files``: dir, stem, desired, sha256, noted, stub.  ``notes``: dir, stem, category, title, authors, keywords, topics,
    tags, methods, regions, venue, publisher, year, journal_abbr, entry_type, volume, issue, pages, note, url, doi, status,
    aliases and body.
    """
    moved = o.copies(notes, files).unionByName(o.renamed(notes, files))
    topics = settled(note_topics(notes))
    texts = notes.select(F.concat("dir", F.lit("/"), "stem").alias("id"), F.col("body").alias("text"))
    return {
        "renames": o.rename_plan(files), "merges": o.merged(notes, moved.dropDuplicates(["dir", "stem"])), "prunes": o.prunable(notes, files),
        "links": o.repaired_links(texts, "id", "text", notes, root), "related": related_lines(related_notes(topics), topics, root),
        "bibliography": bibliography(folder_entries(files, notes).withColumn("seq", F.col("dir"))), "counts": folder_counts(files, notes),
    }



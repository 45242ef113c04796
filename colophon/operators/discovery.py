"""Discovery: title rules, journal lists, fetch decisions, manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_of, normalize_doi, page_span, split_names, surname, title_words
from ..functions.urls import distinct_urls, guessed_pdfs, is_pdf, landing
from .joins import first_wins
from .matching import tags

# The rules that decide which titles are on law and courts.
LAW_TITLES = [
    ("court", r"\bcourts?\b"), ("lawyer", r"\blawyers?\b"), ("judicial", r"\bjudicial\b"), ("legal", r"\blegal\b"),
    ("legal system", r"\blegal system\b"), ("rule of law", r"\brule of (?:the )?law\b"), ("law", r"\blaws?\b"),
]
LAW_CONTEXT = (
    r"\b(constitution(?:al)?|rights?|judge|judges|justice|court|courts|legal|lawyer|lawyers|judicial|attorney|attorneys|enforcement|litigation|rule)\b"
)
LAW_AND = r"\blaw and\b"
OTHER_LAW = r"\binternational law\b|\bdiplomac(?:y|ic)\b"
COURT_WORDS = r"\b(court|courts|judicial|judge|judges|justice|tribunal)\b"
REVIEW_TITLES = r"\bbook review\b|^\s*review essay\b|^\s*review of\b|\bedited by\b|\bPp\.\b|\.\s*By\s+[A-Z]"


def is_review(title: Column) -> Column:
    return title.rlike(f"(?iU){REVIEW_TITLES}")


def law_terms(title: Column, first_page: Column, last_page: Column) -> Column:
    """Labels of the law rules that a title meets, sorted.  Reviews, items of three pages or fewer, foreign-policy titles
    without a court and the lone word law without context have none."""
    title = F.trim(F.coalesce(title, F.lit("")))
    hits = F.array_sort(tags(title, [(label, f"(?U){p}") for label, p in LAW_TITLES]))
    short = F.coalesce(page_span(first_page, last_page) <= 3, F.lit(False))
    foreign = title.rlike(f"(?iU){OTHER_LAW}") & ~title.rlike(f"(?iU){COURT_WORDS}")
    lone = (hits == F.array(F.lit("law"))) & ~title.rlike(f"(?iU){LAW_CONTEXT}|{LAW_AND}")
    return F.when(is_review(title) | short | foreign | lone, F.array().cast("array<string>")).otherwise(hits)


def source_names(sources: DataFrame, slug: str, name: str, aliases: str) -> DataFrame:
    """(key, slug): every normalised spelling of every journal."""
    names = F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>")))))
    return sources.select(slug, names.alias("n_")).select(title_words(F.col("n_")).alias("key"), slug).where("key <> ''").distinct()


def of_sources(rows: DataFrame, titles: str, sources: DataFrame, slug: str, name: str, aliases: str) -> DataFrame:
    """Rows with the slug of each journal that one of their container titles spells; a row meets a journal once."""
    keyed = rows.withColumn("keys_", F.array_distinct(F.transform(F.col(titles), title_words)))
    met = keyed.withColumn("key", F.explode("keys_")).join(source_names(sources, slug, name, aliases), "key").drop("key", "keys_")
    groups = [c for c in met.columns if c != slug]
    return met.groupBy(*groups, slug).agg(F.count(F.lit(1)).alias("n_")).drop("n_")


def merged_sources(sources: DataFrame, slug: str, name: str, seq: str) -> DataFrame:
    """Journals once by lower-case slug and normalised name, the first of the list wins."""
    keyed = sources.withColumn("k1_", F.lower(slug)).withColumn("k2_", title_words(F.col(name)))
    return first_wins(keyed, ["k1_", "k2_"], [seq]).drop("k1_", "k2_").select(*sources.columns)


def fetch_outcomes(urls: DataFrame, log: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(id, ok, url, note): the first address in order whose captured answer is a PDF, else the last failure.

    ``urls``: id and the array columns in ``columns`` one after the other.  ``log``: url, final_url, status, content_type,
    body, and links (addresses in an HTML answer); an HTML answer is followed to its links, then to what the publishers'
    rules make of its address, before the next candidate is tried.
    """
    first = urls.select(id_, F.posexplode(distinct_urls(*(F.col(x) for x in columns))).alias("i", "url"))
    seen = log.select(
        "url", F.coalesce("final_url", "url").alias("final_url"), F.col("status"), is_pdf(F.col("content_type"), F.col("body")).alias("pdf"),
        F.lower(F.coalesce("content_type", F.lit(""))).alias("kind"), distinct_urls(F.col("links"), guessed_pdfs(F.coalesce("final_url", "url"))).alias("inner_"),
    ).dropDuplicates(["url"])
    hop = first.join(seen, "url", "left").withColumn("j", F.lit(-1))
    good = F.coalesce(F.col("status") < 400, F.lit(False))
    page = good & ~F.col("pdf") & F.col("kind").contains("html")
    inner = hop.where(page).select(id_, "i", F.posexplode("inner_").alias("j", "url")).join(seen, "url", "left")

    def note(html: str) -> Column:
        return (
            F.when(F.col("status").isNull(), F.concat("url", F.lit(": request failed")))
            .when(~good, F.concat("final_url", F.lit(": HTTP "), F.col("status").cast("string")))
            .when(F.col("pdf"), F.concat(F.lit("downloaded from "), "final_url")).otherwise(F.concat("final_url", F.lit(html)))
        )

    other = F.concat("final_url", F.lit(": non-PDF content-type "), F.when(F.col("kind") == "", "unknown").otherwise(F.col("kind")))
    outer = hop.select(
        id_, "i", F.when(page, F.lit(2_147_483_647)).otherwise(F.lit(-1)).alias("j"), (good & F.col("pdf")).alias("ok"), "final_url",
        F.when(good & ~F.col("pdf") & ~page, other).otherwise(note(": no PDF link found in landing page")).alias("note"),
    )
    tried = outer.unionByName(inner.select(id_, "i", "j", (good & F.col("pdf")).alias("ok"), "final_url", note(": HTML page without PDF payload").alias("note")))
    got = tried.groupBy(id_).agg(
        F.min_by(F.struct("final_url", "note"), F.when(F.col("ok"), F.struct("i", "j"))).alias("hit"), F.max_by("note", F.struct("i", "j")).alias("last")
    )
    # max_by over all tries is the last failure wherever there is no hit
    return urls.select(id_).join(got, id_, "left").select(
        id_, F.col("hit").isNotNull().alias("ok"), F.coalesce("hit.final_url", F.lit("")).alias("url"),
        F.coalesce("hit.note", "last", F.lit("no candidate URLs")).alias("note"),
    )


def manifest(works: DataFrame, outcome: Column, note: Column) -> DataFrame:
    """The 26 columns of a manifest from works with provenance; sets are sorted, missing values are empty strings."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    joined = lambda x: F.array_join(F.array_sort(F.coalesce(F.col(x), F.array().cast("array<string>"))), "; ")
    names = F.filter(F.transform("authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: n.isNotNull() & (n != ""))
    doi = normalize_doi(F.col("doi"))
    is_oa = F.when(F.col("open_access").isNull(), "").when(F.col("open_access.is_oa").isNull(), "None").otherwise(F.initcap(F.col("open_access.is_oa").cast("string")))
    return works.select(
        F.when(outcome != "", "yes").otherwise("no").alias("downloaded"), outcome.alias("local_filename"), text("source_display_name").alias("journal"),
        text("source_slug").alias("journal_code"), text("publisher").alias("publisher"), text("display_name").alias("title"),
        F.coalesce(F.array_join(names, "; "), F.lit("")).alias("authors"), surname(F.coalesce(names, split_names(F.lit("")))).alias("first_author"),
        text("publication_year").alias("year"), text("publication_date").alias("publication_date"), doi.alias("doi"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("").alias("doi_url"), text("id").alias("openalex_id"),
        text("biblio.volume").alias("volume"), text("biblio.issue").alias("issue"), text("biblio.first_page").alias("first_page"), text("biblio.last_page").alias("last_page"),
        landing(F.col("best_oa_location"), F.col("primary_location"), F.col("doi")).alias("landing_page_url"), is_oa.alias("is_oa"),
        first_of(F.col("open_access.oa_status")).alias("oa_status"),
        *(joined(x).alias(x) for x in ("matched_terms", "matched_fields", "search_queries", "discovery_strategies", "metadata_sources")), note.alias("download_note"),
    )

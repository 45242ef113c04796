"""Records of every provider in two shapes: works (discovery) and metadata (notes and bibliographies).

A work has id, doi, title, display_name, publication_year, publication_date, landing, authors, volume, issue, first_page,
last_page, keywords, concepts and abstract, beside the journal it was found for.  Metadata has METADATA's columns.  Missing
text is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import entry_type, journal_code
from ..functions.text import extract_doi, first_of, normalize_doi, normalize_space, page_range, rebuilt_abstract, split_names, strip_markup, unescaped
from ..sources.readers import pick
from .discovery import of_sources
from .joins import enriched

METADATA = ("title", "authors", "year", "venue", "journal_abbr", "doi", "url", "abstract", "volume", "issue", "pages", "publisher", "entry_type", "source")
_TEXTS = "array<string>"


def _text(c: Column) -> Column:
    return normalize_space(F.coalesce(c.cast("string"), F.lit("")))


def _plain(c: Column) -> Column:
    return normalize_space(unescaped(F.coalesce(c.cast("string"), F.lit(""))))


def _list(c: Column) -> Column:
    """A list's texts without surplus blanks and empty ones."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast(_TEXTS)), lambda x: normalize_space(x)), lambda x: x != "")


def _resolver(doi: Column) -> Column:
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def date_parts(c: Column) -> Column:
    """The first date of a date field, as its numbers."""
    return F.get(c["date-parts"], F.lit(0))


def item_date(rows: dict[str, Column]) -> Column:
    """The first of four dates that has parts, joined by hyphens as they are; a part that is null shows as None."""
    out = []
    for k in ("published-print", "published-online", "issued", "created"):
        p = date_parts(rows[k])
        out.append(F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), "-")))
    return F.coalesce(*out, F.lit(""))


def item_year(rows: dict[str, Column]) -> Column:
    """The year of the first of five dates whose first part is neither null nor zero."""
    firsts = [F.get(date_parts(rows[k]), F.lit(0)) for k in ("published-print", "published-online", "published", "issued", "created")]
    return F.coalesce(*(F.when(y != 0, y.cast("string")) for y in firsts), F.lit(""))


def item_authors(c: Column) -> Column:
    """``given family`` of every author that has either."""
    return _list(F.transform(c, lambda a: F.concat_ws(" ", a["given"], a["family"])))


_DATES = ("published-print", "published-online", "published", "issued", "created")


def item_works(items: DataFrame) -> DataFrame:
    """Crossref-shaped items as works; other columns (the journal's) stay.  The id names the first of DOI, address and title."""
    c = {k: F.col(f"`{k}`") for k in items.columns}
    doi, title = normalize_doi(c["DOI"]), F.coalesce(F.get(c["title"], F.lit(0)), F.lit(""))
    date, pages, link = item_date(c), page_range(c["page"]), first_of(c["URL"], _resolver(doi))
    used = {"DOI", "URL", "type", "title", "container-title", "author", "page", "volume", "issue", "publisher", "abstract", "link", *_DATES}
    return items.select(
        F.concat(F.lit("crossref:"), first_of(doi, c["URL"], title)).alias("id"), _resolver(doi).alias("doi"), title.alias("title"), title.alias("display_name"),
        F.split(date, "-")[0].try_cast("int").alias("publication_year"), date.alias("publication_date"), link.alias("landing"),
        F.coalesce(item_authors(c["author"]), F.array().cast(_TEXTS)).alias("authors"), first_of(c["volume"]).alias("volume"), first_of(c["issue"]).alias("issue"),
        pages["first"].alias("first_page"), pages["last"].alias("last_page"), F.lit("").alias("keywords"), F.lit("").alias("concepts"),
        strip_markup(c["abstract"]).alias("abstract"), *(c[k] for k in items.columns if k not in used),
    )


def row_works(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an imported CSV with alternative headers as works; ``keep`` stays."""
    got = {k: F.trim(pick(rows, *names)) for k, names in (
        ("title", ("Title", "title")), ("doi", ("DOI", "doi")), ("url", ("URL", "url", "Link", "link")), ("year", ("Year", "year")),
        ("abstract", ("Abstract", "abstract", "Summary", "summary")), ("authors", ("Authors", "authors", "Author", "author")))}
    doi, year = normalize_doi(got["doi"]), F.when(got["year"].rlike(r"^[+-]?[0-9]+$"), got["year"].try_cast("int"))
    return rows.select(
        F.concat(F.lit("scholar:"), first_of(doi, got["url"], got["title"])).alias("id"), _resolver(doi).alias("doi"), got["title"].alias("title"),
        got["title"].alias("display_name"), year.alias("publication_year"), F.when(year != 0, year.cast("string")).otherwise("").alias("publication_date"),
        first_of(got["url"], _resolver(doi)).alias("landing"), split_names(got["authors"]).alias("authors"),
        *(F.lit("").alias(k) for k in ("volume", "issue", "first_page", "last_page", "keywords", "concepts")), got["abstract"].alias("abstract"), *keep,
    )


def row_venue(rows: DataFrame) -> Column:
    return F.trim(pick(rows, "Publication", "publication", "Source", "source", "Journal", "journal", "Venue", "venue"))


def captured_works(works: DataFrame) -> DataFrame:
    """OpenAlex-shaped records as works; other columns stay."""
    names = _list(F.transform("authorships", lambda a: a["author"]["display_name"]))
    joined = lambda k: F.array_join(F.transform(F.coalesce(F.col(k), F.array().cast("array<struct<display_name:string>>")), lambda x: F.coalesce(x["display_name"], F.lit(""))), " ")
    used = {"authorships", "primary_location", "best_oa_location", "open_access", "locations", "biblio", "keywords", "concepts", "abstract_inverted_index", "ids"}
    base = ("id", "doi", "title", "display_name", "publication_year", "publication_date")
    title = F.trim(first_of(F.col("display_name"), F.col("title")))
    return works.select(
        first_of(F.col("id")).alias("id"), first_of(F.col("doi")).alias("doi"), title.alias("title"), title.alias("display_name"), "publication_year",
        first_of(F.col("publication_date")).alias("publication_date"),
        first_of(F.col("best_oa_location.landing_page_url"), F.col("primary_location.landing_page_url"), _resolver(normalize_doi(F.col("doi")))).alias("landing"),
        F.coalesce(names, F.array().cast(_TEXTS)).alias("authors"), *(first_of(F.col(f"biblio.{k}")).alias(k) for k in ("volume", "issue", "first_page", "last_page")),
        joined("keywords").alias("keywords"), joined("concepts").alias("concepts"),
        F.coalesce(rebuilt_abstract(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"), *(k for k in works.columns if k not in used and k not in base),
    )


_KEY, _FOUND = "doi_key_", "found_"


def with_lookup(works: DataFrame, lookup: DataFrame) -> DataFrame:
    """Works replaced by the lookup's record of the same identifier where it has one; the journal's columns stay."""
    shared = [k for k in works.columns if k in lookup.columns and k != "doi"]
    keyed = works.withColumn(_KEY, normalize_doi(F.col("doi")))
    known = lookup.withColumn(_KEY, normalize_doi(F.col("doi"))).where(F.col(_KEY) != "")
    return enriched(keyed, known, _KEY, [*shared, "doi"]).drop(_KEY)


def item_candidates(items: DataFrame, sources: DataFrame, lookup: DataFrame) -> DataFrame:
    """Works of the items whose container title spells a journal, once for each, enriched by identifier.

    ``items`` has an ``item_id``; ``sources`` has slug, display_name and title_aliases.
    """
    met = of_sources(items.select("item_id", F.col("container-title").alias("titles")), "titles", sources, "slug", "display_name", "title_aliases")
    return with_lookup(item_works(items.join(met.select("item_id", "slug"), "item_id")), lookup)


def row_candidates(rows: DataFrame, sources: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same for rows of an imported CSV (with an ``item_id``)."""
    venue = rows.select("item_id", F.array(row_venue(rows)).alias("titles")).where("titles[0] <> ''")
    met = of_sources(venue, "titles", sources, "slug", "display_name", "title_aliases")
    return with_lookup(row_works(rows.join(met.select("item_id", "slug"), "item_id"), ("item_id", "slug")), lookup)


def _metadata(rows: DataFrame, v: dict[str, Column], default: Column, thesis: Column, source: str, kind: Column | None = None) -> DataFrame:
    """METADATA's columns from values; the entry type by its rules unless ``kind`` says it; the journal's code from the venue."""
    code = F.coalesce(journal_code(v["venue"], default), F.lit(""))
    made = entry_type(v.get("given", F.lit("")), v["venue"], v["publisher"], F.lit(""), v["title"], code, thesis) if kind is None else kind
    every = v | {"journal_abbr": code, "entry_type": made, "source": F.lit(source)}
    return rows.select(*(k for k in rows.columns if k not in METADATA), *(every[k].alias(k) for k in METADATA))


def item_type(kind: Column, thesis: Column) -> Column:
    """Entry type of a Crossref type."""
    kind = F.lower(_text(kind))
    return (
        F.when(kind == "journal-article", "article").when(kind == "book", "book").when(kind == "book-chapter", "incollection")
        .when(kind.isin("posted-content", "report"), "techreport").when((kind == "dissertation") | thesis, "phdthesis").otherwise("misc")
    )


def item_metadata(items: DataFrame, id_: str, default: Column, thesis: Column) -> DataFrame:
    """Metadata of Crossref-shaped items: references decoded, identifier in lower case, abstract without markup."""
    c = {k: F.col(f"`{k}`") for k in items.columns}
    doi = F.lower(_text(c["DOI"]))
    v = {
        "title": _plain(F.get(c["title"], F.lit(0))), "authors": F.coalesce(item_authors(c["author"]), F.array().cast(_TEXTS)), "year": item_year(c),
        "venue": _plain(F.get(c["container-title"], F.lit(0))), "doi": doi, "url": _text(first_of(c["URL"], _resolver(doi))),
        "abstract": strip_markup(unescaped(F.coalesce(c["abstract"], F.lit("")))), "volume": _text(c["volume"]), "issue": _text(c["issue"]),
        "pages": _text(c["page"]), "publisher": _plain(c["publisher"]),
    }
    rows = items.select(id_, *(x.alias(f"{k}_") for k, x in v.items()), c["type"].alias("type_"), default.alias("default_"), thesis.alias("thesis_"))
    out = _metadata(rows, {k: F.col(f"{k}_") for k in v}, F.col("default_"), F.col("thesis_"), "crossref", item_type(F.col("type_"), F.col("thesis_")))
    return out.select(id_, *METADATA)


def work_metadata(works: DataFrame, id_: str, default: Column, thesis: Column) -> DataFrame:
    """Metadata of OpenAlex-shaped records; pages are ``first-last`` with no hyphen at an end."""
    doi = F.lower(F.replace(_text(F.col("doi")), F.lit("https://doi.org/"), F.lit("")))
    first, last = _text(F.col("biblio.first_page")), _text(F.col("biblio.last_page"))
    v = {
        "title": _plain(F.col("display_name")), "authors": F.coalesce(_list(F.transform("authorships", lambda a: a["author"]["display_name"])), F.array().cast(_TEXTS)),
        "year": first_of(F.when(F.col("publication_year") != 0, F.col("publication_year").cast("string"))), "venue": _plain(F.col("primary_location.source.display_name")),
        "doi": doi, "url": _text(first_of(F.col("ids.doi"), _resolver(doi))), "abstract": F.lit(""), "volume": _text(F.col("biblio.volume")),
        "issue": _text(F.col("biblio.issue")), "pages": F.regexp_replace(F.concat(first, F.lit("-"), last), "^-+|-+$", ""), "publisher": F.lit(""),
    }
    rows = works.select(id_, *(x.alias(f"{k}_") for k, x in v.items()), default.alias("default_"), thesis.alias("thesis_"))
    return _metadata(rows, {k: F.col(f"{k}_") for k in v}, F.col("default_"), F.col("thesis_"), "openalex").select(id_, *METADATA)


def override_metadata(asked: DataFrame, overrides: DataFrame, id_: str, thesis: Column) -> DataFrame:
    """Metadata that a table of corrections holds for the identifier of a row: ``asked`` has doi (any case) and abstract."""
    o = overrides.select(
        F.lower(_text(F.col("key"))).alias("key_"), *(_text(F.col(k)).alias(f"{k}_") for k in ("title", "year", "venue", "doi", "url", "volume", "issue", "pages", "publisher", "journal_abbr")),
        _list(F.transform(F.coalesce("authors", F.array().cast(_TEXTS)), lambda x: x)).alias("authors_"),
    ).dropDuplicates(["key_"])
    rows = asked.withColumn("key_", F.lower(_text(F.col("doi")))).select(id_, "key_", F.col("abstract").alias("abstract_")).join(o.where("key_ <> ''"), "key_")
    doi = F.lower(first_of(F.col("doi_"), F.col("key_")))
    v = {k: F.col(f"{k}_") for k in ("title", "authors", "year", "venue", "abstract", "volume", "issue", "pages", "publisher")}
    out = rows.withColumn("thesis_", thesis)
    v |= {"doi": doi, "url": first_of(F.col("url_"), _resolver(F.col("key_")))}
    return _metadata(out, v, F.col("journal_abbr_"), F.col("thesis_"), "local-override").select(id_, *METADATA)


def note_metadata(notes: DataFrame, id_: str, thesis: Column) -> DataFrame:
    """Metadata that a note's header holds: title, authors, year, venue, publisher, doi, url, entry_type, journal_abbr."""
    doi = F.lower(_text(F.col("doi")))
    v = {
        "title": _plain(F.col("title")), "authors": _list(F.col("authors")), "year": first_of(F.col("year").cast("string")), "venue": _plain(F.col("venue")), "doi": doi,
        "url": _text(first_of(F.col("url"), _resolver(doi))), "publisher": _plain(F.col("publisher")),
    }
    rows = notes.select(id_, *(x.alias(f"{k}_") for k, x in v.items()), F.lower(_text(F.col("journal_abbr"))).alias("default_"), thesis.alias("thesis_"))
    empty = {k: F.lit("") for k in ("abstract", "volume", "issue", "pages")}
    return _metadata(rows, {k: F.col(f"{k}_") for k in v} | empty, F.col("default_"), F.col("thesis_"), "note").select(id_, *METADATA)


def first_doi(*chunks: Column) -> Column:
    """The first identifier in the first text that holds one."""
    return first_of(*(extract_doi(c) for c in chunks))


def resolved_metadata(asked: DataFrame, providers: list[DataFrame], id_: str) -> DataFrame:
    """Metadata of every row of ``asked`` (id, abstract) from the first provider in order that has it; an abstract that the
    provider lacks is the row's own.  Providers hold METADATA by id; a row that none knows has nulls."""
    every = None
    for k, p in enumerate(providers):
        one = p.select(id_, F.lit(k).alias("k_"), F.struct(*METADATA).alias("m_"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(id_).agg(F.min_by("m_", "k_").alias("m_"))
    own = F.when(F.col("m_").isNotNull(), first_of(F.col("m_.abstract"), F.col("abstract_")))
    out = asked.select(id_, F.col("abstract").alias("abstract_")).join(best, id_, "left")
    return out.select(id_, *(own.alias(k) if k == "abstract" else F.col(f"m_.{k}").alias(k) for k in METADATA))

"""Addresses of full texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_of, normalize_doi, normalize_space

_NONE = "array<string>"


def distinct_urls(*parts: Column) -> Column:
    """Arrays one after the other, empty and repeated addresses dropped, order kept."""
    joined = F.flatten(F.array(*(F.coalesce(p, F.array().cast(_NONE)) for p in parts)))
    return F.array_distinct(F.filter(joined, lambda u: u.isNotNull() & (u != "")))


def guessed_pdfs(url: Column) -> Column:
    """Addresses of full texts that follow from a landing page's address by the publishers' rules."""
    url = F.coalesce(url, F.lit(""))
    stable = F.regexp_replace(F.regexp_extract(url, r"(?s)jstor\.org/stable/(.*)$", 1), r"(?s)\?.*$", "")
    stable = F.regexp_replace(stable, "^/+|/+$", "")
    pii = F.when(url.contains("sciencedirect.com"), F.regexp_extract(url, "/pii/([A-Z0-9]+)", 1)).otherwise("")
    doi = F.regexp_extract(url, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1)
    article = F.concat(F.lit("https://www.sciencedirect.com/science/article/pii/"), pii)
    at = lambda host: (doi != "") & url.contains(host)
    return distinct_urls(F.array(
        F.when(stable != "", F.concat(F.lit("https://www.jstor.org/stable/pdf/"), stable, F.lit(".pdf"))),
        F.when(pii != "", F.concat(article, F.lit("/pdfft?isDTMRedir=true&download=true"))), F.when(pii != "", F.concat(article, F.lit("/pdfft"))),
        F.when(at("journals.uchicago.edu"), F.concat(F.lit("https://www.journals.uchicago.edu/doi/pdf/"), doi)),
        F.when(at("onlinelibrary.wiley.com"), F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdfdirect/"), doi)),
        F.when(at("onlinelibrary.wiley.com"), F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdf/"), doi)),
    ))


def pdf_links(links: Column) -> Column:
    """Of an item's links (URL, content-type) those to PDF."""
    hits = F.filter(links, lambda x: F.lower(F.coalesce(x["content-type"], F.lit(""))).contains("pdf"))
    return distinct_urls(F.transform(hits, lambda x: x["URL"]))


def landing(best: Column, primary: Column, doi: Column) -> Column:
    """The best open copy's page, else the primary one, else the identifier's resolver."""
    doi = normalize_doi(doi)
    return first_of(best["landing_page_url"], primary["landing_page_url"], F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)))


def candidate_urls(best: Column, primary: Column, oa_url: Column, locations: Column, doi: Column, links: Column | None = None) -> Column:
    """All addresses of a work in order of preference, each followed by what the publishers' rules make of it."""
    doi = normalize_doi(doi)
    two = lambda x: F.array(x["pdf_url"], x["landing_page_url"])
    given = distinct_urls(
        two(best), two(primary), F.array(oa_url), F.flatten(F.transform(locations, two)), F.array(F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))),
        *([] if links is None else [pdf_links(links)]),
    )
    return distinct_urls(F.flatten(F.transform(given, lambda u: F.concat(F.array(u), guessed_pdfs(u)))))


def is_pdf(content_type: Column, body: Column) -> Column:
    """By the declared type or the first five bytes."""
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf") | F.coalesce(F.substring(body, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def bib_url(url: Column, doi: Column, kind: Column) -> Column:
    """An entry's address: only reports and miscellanea have one, and none that only resolves the identifier."""
    url, doi = normalize_space(F.coalesce(url, F.lit(""))), F.lower(normalize_space(F.coalesce(doi, F.lit(""))))
    resolves = (doi != "") & (F.regexp_replace(F.lower(url), r"^https?://(dx\.)?doi\.org/|/+$", "") == F.regexp_replace(doi, "/+$", "")) & F.lower(url).rlike(r"^https?://(dx\.)?doi\.org/")
    return F.when(kind.isin("techreport", "misc") & ~resolves, url).otherwise("")

"""What page text says about its paper: plausible titles, the title and the abstract, and the fields of a PDF's header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space

# Lines that are no titles, and identifiers.
NO_TITLE = ("abstract", "authors", "citation", "copyright information", "doi", "email", "keywords", "permalink", "publication date", "title")
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
BOILERPLATE = (
    r"^american political science review$", r"^the journal of politics$", r"^american economic review$", r"^publication date$", r"^permalink$", r"^doi$", r"^title$",
    r"^keywords$", r"^author[s]?$", r"^original article$", r"^research article$", r"^this pdf is a selection from", r"^terms of use:", r"^copyright",
    r"^downloaded from .*annualreviews\.org", r"^guest \(guest\) ip:", r"^published by", r"^working paper", r"^department of",
)
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def text_lines(c: Column) -> Column:
    """Lines without surplus blanks, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), _BREAK), lambda x: normalize_space(x)), lambda x: x != "")


def plausible_title(c: Column) -> Column:
    """Twelve characters or more, eight letters or more, no more digits than letters, and not the name of a field."""
    t = normalize_space(c)
    letters, digits = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Nd}]", ""))
    return (F.length(t) >= 12) & ~F.lower(t).isin(*NO_TITLE) & (letters >= 8) & (digits <= letters)


def _closed(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def _while(rows: Column, stop) -> Column:
    """The rows ahead of the first that ``stop`` holds for."""
    first = F.array_position(F.transform(rows, lambda x: F.coalesce(stop(x), F.lit(False))), True)
    return F.when(first > 0, F.slice(rows, F.lit(1), first.cast("int") - 1)).otherwise(rows)


def title_of(text: Column) -> Column:
    """The title that a page states after the word title (of the first 60 lines), else its first plausible line of the
    first 40 that is no boilerplate, address or identifier; empty if there is none."""
    lines = text_lines(text)

    def stated(line: Column, i: Column) -> Column:
        tail = normalize_space(F.regexp_replace(F.substring(line, 6, 1_000_000), r"^[ :.\-]+|[ :.\-]+$", ""))
        follow = _while(F.slice(lines, i + 2, F.lit(5)), lambda x: F.lower(x).isin(*NO_TITLE) | x.startswith("http") | (F.length(x) > 180) | x.rlike(DOI))
        joined = _closed(normalize_space(F.array_join(follow, " ")))
        found = F.when(plausible_title(tail), _closed(tail)).when(plausible_title(joined), joined)
        return F.when(F.lower(line).startswith("title"), found)

    told = F.get(F.array_compact(F.transform(F.slice(lines, 1, 60), stated)), F.lit(0))
    usual = "(?i)" + "|".join(BOILERPLATE)
    fit = F.filter(
        F.slice(lines, 1, 40),
        lambda x: ~F.lower(x).isin(*NO_TITLE) & ~x.rlike(usual) & ~x.startswith("http") & ~x.rlike(DOI) & F.length(x).between(12, 180) & plausible_title(x),
    )
    return F.coalesce(told, _closed(F.get(fit, F.lit(0))), F.lit(""))


def abstract_of(text: Column) -> Column:
    """What follows the word abstract (of the first 120 lines) up to keywords or the introduction, 50 to 2,200 characters,
    ended by the first closed line beyond 500; else the first of eight paragraphs of 350 to 1,800 without an identifier."""
    lines = text_lines(text)

    def stated(line: Column, i: Column) -> Column:
        low = F.lower(line)
        tail = normalize_space(F.regexp_replace(line, r"(?i)^abstract[:\s-]*", ""))
        start = F.struct(tail.alias("said"), F.lit(False).alias("done"))

        def step(at: Column, x: Column) -> Column:
            more = F.when(at["said"] == "", x).otherwise(F.concat(at["said"], F.lit(" "), x))
            lower = F.lower(x)
            ends = lower.startswith("keywords") | (lower == "introduction") | lower.rlike(r"^\d+\.?\s+introduction") | (F.length(more) > 2200)
            full = (F.length(more) > 500) & x.endswith(".")
            return F.when(at["done"], at).when(ends, F.struct(at["said"].alias("said"), F.lit(True).alias("done"))).otherwise(F.struct(more.alias("said"), full.alias("done")))

        said = normalize_space(F.aggregate(F.slice(lines, i + 2, F.lit(29)), start, step)["said"])
        return F.when(((low == "abstract") | low.startswith("abstract ")) & F.length(said).between(50, 2200), said)

    told = F.get(F.array_compact(F.transform(F.slice(lines, 1, 120), stated)), F.lit(0))
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: normalize_space(x)), lambda x: x != "")
    fit = F.filter(F.slice(parts, 1, 8), lambda x: F.length(x).between(350, 1800) & ~x.rlike(DOI))
    return F.coalesce(told, F.get(fit, F.lit(0)), F.lit(""))


def header_field(info: Column, name: str) -> Column:
    """A field of ``pdfinfo``'s output; of repeated ones the last."""
    rows = F.filter(F.split(F.coalesce(info, F.lit("")), _BREAK), lambda x: x.startswith(f"{name}:"))
    return normalize_space(F.coalesce(F.substring(F.get(rows, F.size(rows) - 1), len(name) + 2, 1_000_000), F.lit("")))

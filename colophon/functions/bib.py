"""BibTeX: pages, escapes and whole entries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_of, normalize_space


def bib_pages(c: Column) -> Column:
    """A dash between digits as the double hyphen of BibTeX."""
    return F.regexp_replace(normalize_space(F.coalesce(c, F.lit(""))), r"(?<=\d)\s*[–—-]\s*(?=\d)", "--")


def bib_escape(c: Column) -> Column:
    """Backslashes doubled, braces escaped, everything else as it is."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def bib_url(url: Column, doi: Column, entry_type: Column) -> Column:
    """The address of a report or of something else, unless it only resolves the identifier."""
    url, doi = normalize_space(F.coalesce(url, F.lit(""))), F.lower(normalize_space(F.coalesce(doi, F.lit(""))))
    plain = F.regexp_replace(F.lower(url), "/+$", "")
    same = F.regexp_replace(plain, r"^https?://(?:dx\.)?doi\.org/", "") == F.regexp_replace(doi, "/+$", "")
    resolves = (doi != "") & plain.rlike(r"^https?://(?:dx\.)?doi\.org/") & same
    return F.when(entry_type.isin("techreport", "misc") & ~resolves, url).otherwise("")


def bib_fields(kind: Column, record: dict[str, Column], omit: frozenset[str] = frozenset()) -> list[tuple[str, Column]]:
    """Fields of an entry in their order, each empty where the entry's type or the record has none.

    ``record`` has author (joined names), title, year, venue, publisher, volume, issue, pages, note, url, doi and file.
    """
    v = {k: normalize_space(F.coalesce(c.cast("string"), F.lit(""))) for k, c in record.items()}
    only = lambda types, c: F.when(kind.isin(*types), c).otherwise("")
    told = ("article", "phdthesis", "incollection", "book", "techreport")
    fields = [
        ("author", v["author"]), ("title", v["title"]), ("journal", only(["article"], v["venue"])), ("school", only(["phdthesis"], first_of(v["venue"], v["publisher"]))),
        ("booktitle", only(["incollection"], v["venue"])), ("institution", only(["techreport"], first_of(v["publisher"], v["venue"]))),
        # an article without a venue falls to what has no place of its own
        ("howpublished", F.when((kind == "article") & (v["venue"] == ""), v["publisher"]).when(~kind.isin(*told), first_of(v["venue"], v["publisher"])).otherwise("")),
        ("year", v["year"]), ("volume", only(["article"], v["volume"])), ("number", only(["article"], v["issue"])),
        ("pages", only(["article", "incollection"], bib_pages(v["pages"]))),
        ("publisher", F.when(kind == "incollection", v["publisher"]).when(kind == "book", first_of(v["publisher"], v["venue"])).otherwise("")),
        ("note", v["note"]), ("url", bib_url(v["url"], v["doi"], kind)), ("file", v["file"]),
    ]
    return [(name, c) for name, c in fields if name == "title" or name not in omit]


def bib_entry(kind: Column, key: Column, fields: list[tuple[str, Column]]) -> Column:
    """An entry with its title and its other non-empty fields in order, escaped, one a line."""
    shown = []
    for name, c in fields:
        line = F.concat(F.lit(f"  {name} = {{"), bib_escape(F.coalesce(c, F.lit(""))), F.lit("},"))
        shown.append(line if name == "title" else F.when(F.coalesce(c, F.lit("")) != "", line))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*shown)), "\n"), F.lit("\n}"))

"""Column functions for reference lists: line shapes, cleaning, comparison keys and titles inside citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, folded_key, normalize_space, strip_accents

# Patterns whose matches decide the results.
YEAR = r"\b(?:17|18|19|20)\d{2}[a-z]?\b"
HEADINGS = "references|bibliography|[a-z]+ cited"
HEADING = rf"(?im)^\s*({HEADINGS})\s*$"
APPENDIX = r"(?im)^\s*(appendix|online appendix|supplementary|supporting information|tables? |figures? )"
INLINE_BREAKS = (
    r"""(?<=[.?!”"\)])\s+(?=[A-Z]{2,}(?:\s+[A-Z]{2,})*,\s*\d{4}[a-z]?\b)""",
    r"""(?<=[.?!”"\)])\s+(?=[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+,\s+[^.\n]{0,120}\b(?:17|18|19|20)\d{2}[a-z]?\b)""",
    r"""(?<=[.?!”"\)])\s+(?=[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+)*\s+(?:et al\.|and)\b[^\n]{0,80}\(\d{4}[a-z]?\))""",
)
CITATION_BREAKS = (
    r"""(?<=[.?!”"])\s+(?=[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+,\s+[A-ZÀ-ÖØ-Ý])""",
    r"""(?<=[.?!”"])\s+(?=[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+\s*\(\d{4}[a-z]?\))""",
    r"""(?<=[.?!”"])\s+(?=[A-Z]{2,},\s*\d{4}[a-z]?\b)""",
)
CITATION_STARTS = (
    r"^[A-Z]{2,}(?:\s+[A-Z]{2,})*,\s*\d{4}[a-z]?\b",
    r"^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+)*\s+(?:et al\.|and)\b.*\(\d{4}[a-z]?\)",
    r"^[A-ZÀ-ÖØ-Ý][^.;]{0,80}\(\d{4}[a-z]?\)",
)
SURNAME_COMMA = r"^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+,"
JUNK_PREFIX = r"(?i)^(?:\d{4}\]|\d+\]?|advance access publication date:.*?|published by .*?|for permissions,.*?|all rights reserved\.?)\s*"
DOUBLE_QUOTED = r"""[“"]([^"”]{6,240})[”"]"""
SINGLE_QUOTED = r"""(?:^|[\s(])['‘]([^'’]{6,240})[’'](?=$|[\s,.;:?!)])"""
SOURCE_TAILS = (
    r"(?i),\s+(?:Journal|Review|Quarterly Journal|American Journal|American Economic Review|World Development|Landscape and Urban Planning|Sociology of Education|Regional Science and Urban Economics|Economic History Review)\b",
    r"\.\s+(?:J\.|Q\.|Am\.|Rev\.|Journal|Review|Quarterly|American|World|Regional|Landscape|Sociology|Economic|Explorations|Cambridge|Princeton|Stanford|Oxford|Palgrave|Springer|Elsevier|Harcourt|Wallstein|Fischer)\b",
    r"(?i),\s+vol\.",
    r"(?i),\s+pp\.",
    r"(?i)\.\s+vol\.",
    r"(?i)\.\s+pp\.",
    r"(?i),\s+(?:Working Paper|Official Document|Master'?s thesis|Diss:|Dissertation)\b",
    r"(?i)\.\s+(?:Working Paper|Official Document|Master'?s thesis|Diss:|Dissertation)\b",
    r"(?i),\s+(?:Cambridge|Princeton|Stanford|Oxford|New York|London|Berkeley|Delhi):\s",
    r"(?i)\bPolicy Research Working Papers\b",
    r"(?i)\bHarvard Dataverse\b",
    r"(?i)\bNational Bureau of Economic Research\b",
    r"(?i)\b(?:Cambridge|Princeton|Stanford|Oxford) University Press\b",
    r"(?i)\b(?:CRC Press|Palgrave Macmillan|Springer|Elsevier|Harcourt Brace|Wallstein Verlag|Fischer Verlag)\b",
    r"(?i)\bTransport Infrastruc",
    r"(?i)\bStatistik des Deutschen Reiches\b",
)
TITLE_ENDS = (r"\.\s+(?:[A-Z][a-z]+\.)", r"\.\s+In\b", r"\.\s+[A-Z][a-z]+:", r"\.\s+[A-Z][A-Za-z&\- ]{3,}$")
TITLE_EDGE = r"""[ '"‘’“”.,;:\-]"""
NO_TITLE = (
    r"^\d", r"^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÿ'`’.\-]+,\s+[A-ZÀ-ÖØ-Ý]", r"(?i)^[ivxlcdm]+\b",
    r"(?i)^(journal of|review of|american economic review|quarterly journal)",
    r"(?i)^(available at|published by|for permissions|all rights reserved)",
    r"(?i)https?://|doi\.org", r"(?i) vol\.| pp\.| published online|author\(s\)", r"(?i)^(references|bibliography)$",
    r"(?i)(journal|review|press)$", r"(?i) (j|rev|econ|res)$", r'"', r"'.*'.*'",
)


def _hit(c: Column, pattern: str) -> Column:
    """Regex search with classes and boundaries of Unicode."""
    return c.rlike("(?U)" + pattern)


def _cut(c: Column, pattern: str, put: str = " ") -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, put)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (_hit(c, p) for p in patterns))


def _count(c: Column, kind: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(c, f"(?U)[^{kind}]", ""))


def compare_key(c: Column) -> Column:
    """Key under which two spellings of a reference are equal: no addresses, accents, marks of volume or page."""
    c = F.lower(strip_accents(F.regexp_replace(c, r"(?U)https?://\S+", " ")))
    c = _cut(_cut(c, r"\bdoi\s*:?\s*"), r"\bvols?\.\b|\bnos?\.\b|\bpp?\.\b")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    return folded_key(c)


def garbled(c: Column) -> Column:
    """Lines of 16 characters or more, six or more of them odd, with less than 45 % letters."""
    odd = F.length(F.regexp_replace(c, r"""[A-Za-z0-9\x09-\x0D\x1C-\x20.,;:!?()\[\]{}'"/&%+\-=]""", ""))
    return (F.length(c) >= 16) & (odd >= 6) & (_count(c, r"\p{L}") < F.lit(0.45) * F.length(c))


def dropped_line(c: Column) -> Column:
    """Lines that are no part of a reference list's text: blanks, headings, page numbers, notices, garbled text."""
    return bound(normalize_space(c, soft_hyphen=True), _dropped)


def _dropped(s: Column) -> Column:
    low = F.lower(s)
    return (
        (s == "") | low.rlike(f"^({HEADINGS})$") | _hit(s, r"^\d+$") | low.startswith("published online by") | (s.startswith("https://doi.org/") & low.contains("published online by"))
        | low.startswith("downloaded from ") | low.startswith("copyright ") | s.startswith("©") | _hit(s, r"^\[[A-Za-z]+\s+\d{4}\]$")
        | low.contains("creativecommons.org/licenses") | garbled(s)
    )


def citation_line(c: Column) -> Column:
    """Lines with the shape of a reference's first line."""
    return bound(normalize_space(c, soft_hyphen=True), _cites)


def _cites(s: Column) -> Column:
    head = F.left(s, F.lit(220))
    before = F.regexp_replace(head, f"(?sU){YEAR}.*$", "")
    listed = _hit(s, SURNAME_COMMA) & (F.length(before) - F.length(F.replace(before, F.lit(","), F.lit(""))) >= 2)
    # most lines have no year: it is asked for first
    return (F.length(s) >= 20) & _hit(head, YEAR) & ~_dropped(s) & (_hit(s, "^[,—-]") | _any(s, CITATION_STARTS) | listed)


def starts_reference(c: Column) -> Column:
    return bound(normalize_space(c, soft_hyphen=True), lambda s: _hit(F.left(s, F.lit(220)), YEAR) & (_hit(s, "^[,—-]") | _cites(s)))


def running_header(c: Column) -> Column:
    """Headers that journals print on top of pages."""
    return bound(F.lower(normalize_space(c, soft_hyphen=True)), _runs)


def _runs(low: Column) -> Column:
    return (
        low.startswith("vol. ") | _hit(low, r"\b(?:journal|review|quarterly|economic)\b.*\(\d{4}\)\s+\d+[–-]\d+")
        | (_hit(low, r"\bno\.\s+\d") & _hit(low, r"\b\d{2,4}$")) | _hit(low, r"\bpublished online by\b")
    )


def after_heading(c: Column) -> Column:
    """Text after the last heading of a reference list, the whole text where there is none."""
    return F.regexp_replace(c, rf"(?is)^.*(?m:^)(?U:\s)*({HEADINGS})(?U:\s)*(?m:$)", "")


def finished(c: Column) -> Column:
    """No blanks before closing or after opening punctuation; blanks and semicolons off both ends."""
    c = _cut(normalize_space(c, soft_hyphen=True), r"\s+([,.;:])", "$1")
    c = _cut(_cut(c, r"([(\[])\s+", "$1"), r"\s+([)\]])", "$1")
    return F.regexp_replace(c, "^[ ;]+|[ ;]+$", "")


def split_inline(line: Column) -> Column:
    """The references that one line runs together."""
    for p in INLINE_BREAKS:
        line = _cut(line, p, "\n")
    return F.filter(F.split(line, "\n"), lambda x: normalize_space(x) != "")


def is_reference(c: Column) -> Column:
    """A year among the first 220 characters and at least 35 characters."""
    return _hit(F.left(c, F.lit(220)), YEAR) & (F.length(c) >= 35)


def cleaned_reference(c: Column) -> Column:
    """Plain quotes and dashes, without addresses, identifiers and publishers' notices."""
    c = F.translate(c, "’“”–—", "'\"\"--")
    for p in (r"https?://\S+", r"(?i)\bdoi:\s*\S+", r"(?i)©\s*The Author\(s\).*", r"(?i)Published by .*", r"(?i)Advance Access Publication Date:.*", r"\b[fileUNF]\b"):
        c = _cut(c, p)
    return normalize_space(c, soft_hyphen=True)


def cleaned_title(c: Column) -> Column:
    """A title without the source, publisher or sentence that follows it."""
    edge = f"^{TITLE_EDGE}+|{TITLE_EDGE}+$"
    c = F.regexp_replace(normalize_space(c, soft_hyphen=True), edge, "")
    c = _cut(_cut(c, r"\s+([,.;:?!])", "$1"), r"\b([A-Z])\s+([A-Z])\b", "$1$2")
    for p in SOURCE_TAILS:
        c = F.regexp_replace(c, f"(?sU){p}.*$", "")
    c = F.regexp_replace(c, r"(?sU)\.\s+[A-ZÀ-ÖØ-Ý][a-zà-ÿ]{2,}.*$", ".")
    c = _cut(_cut(c, r"\.\s+[A-Z]$", ""), r",\s+[A-Z][a-z]{0,2}$", "")
    return F.regexp_replace(normalize_space(c, soft_hyphen=True), edge, "")


def is_title(c: Column) -> Column:
    """6 to 240 characters, two words, five letters, and none of the shapes of names, sources or notices."""
    return F.length(c).between(6, 240) & _hit(c, r"\S\s+\S") & ~_any(c, NO_TITLE) & (_count(c, r"\p{L}") >= 5)


def quoted_titles(c: Column) -> Column:
    found = [F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(1)) for p in (DOUBLE_QUOTED, SINGLE_QUOTED)]
    return F.filter(F.transform(F.concat(*found), cleaned_title), is_title)


def unquoted_title(c: Column) -> Column:
    """The title after the year, up to the earliest sign of a source, else one sentence, else 220 characters; else null."""
    return bound(_cut(c, JUNK_PREFIX, ""), _after_year)


def _after_year(text: Column) -> Column:
    tail = F.regexp_replace(text, f"(?sU)^.*?{YEAR}", "")
    tail = _cut(tail, r"^[\s\]\).,:;'-]+", "")
    return F.when(_hit(text, YEAR), bound(tail, _before_source))


def _before_source(tail: Column) -> Column:
    # the tail begins with no full stop, so a sign is never at its start
    ends = [F.nullif(F.length(F.regexp_extract(tail, f"(?sU)^(.*?){p}", 1)), F.lit(0)) + 1 for p in TITLE_ENDS]
    sentence = F.nullif(F.length(F.regexp_extract(tail, r"(?U)^(.{6,220}?[.?!])(?:\s|$)", 1)), F.lit(0))
    title = cleaned_title(F.left(tail, F.coalesce(F.least(*ends), sentence, F.lit(220))))
    return bound(title, lambda x: F.when(is_title(x), x))


def titles(c: Column) -> Column:
    """All titles in a reference text: of each citation the quoted ones, else the one after the year."""
    text = cleaned_reference(F.coalesce(c, F.lit("")))
    for p in CITATION_BREAKS:
        text = _cut(text, p, "\n")

    def of(chunk: Column) -> Column:
        return bound(quoted_titles(chunk), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(unquoted_title(chunk)))))

    return F.flatten(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: normalize_space(x)), lambda x: x != ""), of))

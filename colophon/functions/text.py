"""Scalar functions over columns.  Empty string is the missing value throughout, never null."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_of(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once: inside a lambda Spark computes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def normalize_space(c: Column, soft_hyphen: bool = False) -> Column:
    """Runs of white space as one blank, trimmed; optionally without soft hyphens."""
    c = F.regexp_replace(c, "­", "") if soft_hyphen else c
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_doi(c: Column) -> Column:
    """Without one leading resolver address; the case stays."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^https://doi\.org/", "")
    return F.trim(F.regexp_replace(c, r"^http://doi\.org/", ""))


def extract_doi(c: Column) -> Column:
    """The first identifier of the form 10.registrant/suffix in a text, lower case, without closing punctuation."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1)
    return F.lower(F.regexp_replace(found, r"[).,;]+$", ""))


def title_words(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one blank, trimmed (accented letters become blanks)."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return s.map(lambda x: x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def folded_key(c: Column) -> Column:
    """``title_words`` after accents are stripped, so that accented spellings compare equal."""
    return title_words(strip_accents(c))


def slug(c: Column, default: str = "unknown") -> Column:
    """ASCII file-name component: other characters as underscores."""
    made = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^\x00-\x7F]", "")
    made = F.regexp_replace(F.regexp_replace(made, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", default).otherwise(made)


def keyword_pattern(keyword: str) -> str:
    """A literal, case-insensitive, whole-word pattern; word characters are those of Unicode."""
    quoted = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return rf"(?iU)(?<!\w){quoted}(?!\w)"


def page_range(c: Column) -> Column:
    """first and last page of ``a-b``, blanks removed; a single page has an empty last."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""), "-", 2)
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last"))


def page_span(first: Column, last: Column) -> Column:
    """Pages from first to last where both are plain numbers, else null."""
    plain = first.rlike("^[0-9]+$") & last.rlike("^[0-9]+$")
    return F.when(plain, last.try_cast("int") - first.try_cast("int") + 1)


def split_names(c: Column) -> Column:
    """Names separated by semicolons, commas or the word and; blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r";|,|\s+and\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def surname(names: Column) -> Column:
    """Slug of the last word of the first name."""
    first = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    return slug(F.regexp_extract(F.trim(first), r"(\S+)$", 1))


def strip_markup(c: Column) -> Column:
    return normalize_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def significant_tokens(c: Column, limit: int, stopwords: tuple[str, ...] = (), least: int = 4) -> Column:
    """The first ``limit`` distinct words of at least ``least`` letters that are no stopwords."""
    words = F.split(title_words(c), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords) if stopwords else F.length(w) >= least)
    return F.slice(F.array_distinct(kept), 1, limit)


def reference_id(c: Column) -> Column:
    return F.left(F.sha1(c), F.lit(12))


def year_in(c: Column, within: int = 220) -> Column:
    """The first year 17xx to 20xx (with an optional letter) among the first characters, else empty."""
    return F.regexp_extract(F.left(c, F.lit(within)), r"\b((?:17|18|19|20)\d{2}[a-z]?)\b", 1)


def rebuilt_abstract(index: Column) -> Column:
    """Text of an inverted index (word to places): gaps are empty words, of two words in one place the later wins.

    Places are sorted once; every word then brings the empty words of the gap before it.
    """
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    by_place = F.array_sort(pairs)
    place = lambda i: F.coalesce(F.get(by_place, i)["p"], F.lit(-1))
    last = F.filter(by_place, lambda x, i: x["p"] != place(i + 1))
    words = F.flatten(F.transform(last, lambda x, i: F.concat(F.array_repeat(F.lit(""), x["p"] - F.coalesce(F.get(last, i - 1)["p"], F.lit(-1)) - 1), F.array(x["w"]))))
    return F.when(F.size(pairs) > 0, F.array_join(words, " ")).otherwise("")


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Character references of HTML decoded, which no built-in function does."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def ratio(a: str, b: str) -> float:
    """Longest-matching-blocks similarity of the standard library, popular characters ignored from 200 on."""
    import difflib

    return difflib.SequenceMatcher(None, a, b).ratio()


def gram_counts(text: str):
    """How often each three characters in a row occur, in 4,096 buckets."""
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.bincount(((c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D) >> np.uint64(7)) % 4096 if len(c) > 2 else [], minlength=4096).astype(np.int32)


def most_blocks(b: str) -> int:
    """How many matching blocks ``ratio(a, b)`` can find at most: from 200 characters on, all but one at the start hold a
    character that makes up about a hundredth of ``b`` or less."""
    from collections import Counter

    n = len(b)
    return n if n < 200 else 1 + sum(c for c in Counter(b).values() if c <= n // 100 + 1)


def long_runs(text: str):
    """The runs of eight characters, hashed, with their counts."""
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - 7, 0), np.uint64)
    for k in range(8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)]
    return np.unique(h, return_counts=True)


def blocks_reach(a: str, b: str, least: float) -> bool | None:
    """``ratio(a, b) >= least`` for a ``b`` of 200 characters or more, None where that is not known here.

    Finds the matching blocks of the standard library: each is the first of the longest runs of rare characters that a
    window of ``a`` and one of ``b`` share, widened as far as both agree.  Runs are looked up by their characters, and the
    search ends as soon as what is matched, or what is left, decides.
    """
    from bisect import bisect_left
    from collections import Counter

    total, few = len(a) + len(b), len(b) // 100 + 1
    need = math.ceil(least * total / 2 - 1e-6)
    rare = "".join(c for c, n in Counter(b).items() if n <= few)
    in_b: list[dict[str, list[int]]] = []
    in_a: list[list[int]] = []
    if rare:
        runs = re.compile(f"[{re.escape(rare)}]+")
        for m in runs.finditer(b):
            run, at = m[0], m.start()
            if len(run) > 100:
                return None
            for size in range(1, len(run) + 1):
                if len(in_b) < size:
                    in_b.append({})
                for k in range(len(run) - size + 1):
                    in_b[size - 1].setdefault(run[k : k + size], []).append(at + k)
        in_a = [[] for _ in in_b]
        for m in runs.finditer(a):
            run, at = m[0], m.start()
            for size in range(1, min(len(run), len(in_b)) + 1):
                in_a[size - 1] += [at + k for k in range(len(run) - size + 1) if run[k : k + size] in in_b[size - 1]]
    todo, done, left = [(0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while todo and done <= need <= done + left:
        alo, ahi, blo, bhi = todo.pop()
        left -= min(ahi - alo, bhi - blo)
        i, j, size = alo, blo, 0
        for n in range(min(len(in_b), ahi - alo, bhi - blo), 0, -1):
            places, known = in_a[n - 1], in_b[n - 1]
            for p in range(bisect_left(places, alo), bisect_left(places, ahi - n + 1)):
                js = known[a[places[p] : places[p] + n]]
                q = bisect_left(js, blo)
                if q < len(js) and js[q] + n <= bhi:
                    i, j, size = places[p], js[q], n
                    break
            if size:
                break
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            done += size
            for w in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if w[0] < w[1] and w[2] < w[3]:
                    todo.append(w)
                    left += min(w[1] - w[0], w[3] - w[2])
    return done > need or (done + left >= need and 2.0 * done / total >= least)


def reaches(a: str, b: str, least: float, counts: dict | None = None) -> bool:
    """``ratio(a, b) >= least``.  Matching blocks are a common subsequence, so two bounds rule pairs out before ``ratio`` is
    asked: an unmatched character breaks three runs of three characters, one put in between breaks two, so similar texts
    share many runs (``counts`` keeps them by text); and their longest common subsequence must be long, which is given up
    as soon as a start of ``a`` has lost too many characters.  Matching blocks are few where ``b`` is long (``most_blocks``)
    and share all their runs of eight but seven each, which is asked in between."""
    import numpy as np

    total = len(a) + len(b)
    need = math.ceil(least * total / 2 - 1e-6)
    lost = len(a) - need  # characters of a that may stay unmatched
    if min(len(a), len(b)) < need:
        return False
    kept = {} if counts is None else counts
    x, y = (kept[t] if t in kept else kept.setdefault(t, gram_counts(t)) for t in (a, b))
    if np.minimum(x, y).sum() < len(a) - 2 - 3 * lost - 2 * (len(b) - need):
        return False
    if len(b) >= 200 and (sure := need - 7 * most_blocks(b)) > 0:
        (x, m), (y, n) = (kept[t, 8] if (t, 8) in kept else kept.setdefault((t, 8), long_runs(t)) for t in (a, b))
        _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if np.minimum(m[p], n[q]).sum() < sure:
            return False
    if len(b) >= 200 and (known := blocks_reach(a, b, least)) is not None:
        return known
    at: dict[str, int] = {}
    for j, ch in enumerate(b):
        at[ch] = at.get(ch, 0) | (1 << j)
    free = full = (1 << len(b)) - 1  # bit by bit, characters of b not matched yet
    for i, ch in enumerate(a, 1):
        met = free & at.get(ch, 0)
        free = ((free + met) | (free - met)) & full
        if i % 32 == 0 and i - (len(b) - free.bit_count()) > lost:
            return False
    return ratio(a, b) >= least


@F.pandas_udf(T.ArrayType(T.StringType()))
def links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Targets of a page's links in order, absolute, once each."""
    from html import unescape
    from urllib.parse import urljoin

    href = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
    return pd.Series([
        None if h is None else list(dict.fromkeys(urljoin(b or "", unescape(m[1] or m[2] or m[3] or "")) for m in href.finditer(h))) for h, b in zip(html, base, strict=True)
    ])


@F.pandas_udf(T.ArrayType(T.StringType()))
def pdf_candidates(html: pd.Series, base: pd.Series) -> pd.Series:
    """Addresses of PDFs that a page names: in two meta elements, then links whose target ends like one or whose text says so.

    Absolute, in order, once each.  A link's text reaches to its end tag, or to the page's end where there is none.
    """
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Page(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.meta, self.anchors, self.open, self.silent = {}, [], [], 0

        def handle_starttag(self, tag, attrs):
            at = dict(attrs)
            if tag == "meta" and at.get("name") in ("citation_pdf_url", "wkhealth_pdf_url"):
                self.meta.setdefault(at["name"], at.get("content"))
            elif tag == "a":
                self.open.append([at.get("href"), []])
                if "href" in at:
                    self.anchors.append(self.open[-1])
            elif tag in ("script", "style"):
                self.silent += 1

        def handle_endtag(self, tag):
            if tag == "a" and self.open:
                self.open.pop()
            elif tag in ("script", "style"):
                self.silent = max(0, self.silent - 1)

        def handle_data(self, data):
            for a in self.open if not self.silent else ():
                a[1].append(data)

    def found(page, base):
        p = Page()
        p.feed(page)
        p.close()
        out = [urljoin(base, p.meta[k]) for k in ("citation_pdf_url", "wkhealth_pdf_url") if p.meta.get(k)]
        for target, said in p.anchors:
            to, low = urljoin(base, target or ""), " ".join(" ".join(said).split()).lower()
            path = to.lower()
            if path.endswith(".pdf") or ".pdf?" in path or ("pdf" in low and to.startswith("http")):
                out.append(to)
        return list(dict.fromkeys(x for x in out if x))

    return pd.Series([None if h is None else found(h, b or "") for h, b in zip(html, base, strict=True)])

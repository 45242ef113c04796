"""Names of people and journals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_space, strip_accents, title_words, unescaped

# Particles, stopwords, journals and hints that decide the results.
PARTICLES = ("al", "bin", "da", "de", "del", "della", "der", "di", "du", "la", "le", "san", "st", "van", "von")
CODE_STOPWORDS = ("and", "for", "in", "of", "on", "the")
JOURNALS = {
    "aer": "American Economic Review",
    "aej_app": "American Economic Journal: Applied Economics",
    "aejapplied": "American Economic Journal: Applied Economics",
    "aejmacro": "American Economic Journal: Macroeconomics",
    "aejmicro": "American Economic Journal: Microeconomics",
    "aej_micro": "American Economic Journal: Microeconomics",
    "aejpolicy": "American Economic Journal: Economic Policy",
    "ajls": "Asian Journal of Law and Society",
    "ajps": "American Journal of Political Science",
    "apsr": "American Political Science Review",
    "arlss": "Annual Review of Law and Social Science",
    "arps": "Annual Review of Political Science",
    "bjps": "British Journal of Political Science",
    "bmgs": "Byzantine and Modern Greek Studies",
    "cjls": "Canadian Journal of Law and Society / La Revue Canadienne Droit et Société",
    "cq": "The China Quarterly",
    "cps": "Comparative Political Studies",
    "ecma": "Econometrica",
    "eeh": "Explorations in Economic History",
    "ehdr": "Economic History of Developing Regions",
    "ej": "The Economic Journal",
    "ejdr": "The European Journal of Development Research",
    "hofstra": "Hofstra Law Review",
    "imago": "Imago Mundi",
    "io": "International Organization",
    "itinerario": "Itinerario",
    "jde": "Journal of Development Economics",
    "jeh": "The Journal of Economic History",
    "jeg": "Journal of Economic Geography",
    "jgh": "Journal of Global History",
    "ijpor": "International Journal of Public Opinion Research",
    "jas": "The Journal of Asian Studies",
    "jcc": "Journal of Contemporary China",
    "jcr": "Journal of Conflict Resolution",
    "jeea": "Journal of the European Economic Association",
    "jpopecon": "Journal of Population Economics",
    "jrs": "Journal of Regional Science",
    "jue": "Journal of Urban Economics",
    "jlc": "Journal of Law and Courts",
    "jop": "The Journal of Politics",
    "jpart": "Journal of Public Administration Research and Theory",
    "jpe": "Journal of Political Economy",
    "jpube": "Journal of Public Economics",
    "jpubeco": "Journal of Public Economics",
    "lsi": "Law & Social Inquiry",
    "lsr": "Law & Society Review",
    "pan": "Political Analysis",
    "polgeo": "Political Geography",
    "polbeh": "Political Behavior",
    "polcomm": "Political Communication",
    "poq": "Public Opinion Quarterly",
    "polgender": "Politics & Gender",
    "psrm": "Political Science Research and Methods",
    "qjps": "Quarterly Journal of Political Science",
    "qje": "Quarterly Journal of Economics",
    "jeps": "Journal of Experimental Political Science",
    "arecon": "Annual Review of Economics",
    "arpsych": "Annual Review of Psychology",
    "restat": "The Review of Economics and Statistics",
    "restud": "Review of Economic Studies",
    "arsoc": "Annual Review of Sociology",
    "rsue": "Regional Science and Urban Economics",
    "rte": "Research in Transportation Economics",
    "ssh": "Social Science History",
    "wpol": "World Politics",
}
JOURNAL_PHRASES = (
    ("american economic journal applied economics", "aejapplied"),
    ("american economic journal economic policy", "aejpolicy"),
    ("american economic journal macroeconomics", "aejmacro"),
    ("american economic journal microeconomics", "aejmicro"),
    ("journal of public economics", "jpubeco"),
    ("review of economic studies", "restud"),
    ("review of economics and statistics", "restat"),
    ("american political science review", "apsr"),
    ("american journal of political science", "ajps"),
    ("journal of contemporary china", "jcc"),
    ("journal of political economy", "jpe"),
    ("journal of development economics", "jde"),
    ("journal of the european economic association", "jeea"),
    ("the economic journal", "ej"),
    ("econometrica", "ecma"),
    ("quarterly journal of political science", "qjps"),
    ("quarterly journal of economics", "qje"),
    ("journal of experimental political science", "jeps"),
    ("british journal of political science", "bjps"),
    ("comparative political studies", "cps"),
    ("world politics", "wpol"),
    ("international organization", "io"),
    ("political analysis", "pan"),
    ("political science research and methods", "psrm"),
    ("political communication", "polcomm"),
    ("journal of law and courts", "jlc"),
)
PAPER_HINTS = (
    "cepr discussion paper", "discussion paper", "faculty research working paper", "job market paper", "manuscript", "mimeo",
    "nber working paper", "ssrn", "unpublished manuscript", "working draft", "working paper",
)
PUBLISHER_HINTS = (
    "cambridge university press", "columbia university press", "cornell university press", "harvard university press", "oxford university press",
    "princeton university press", "routledge", "stanford university press", "university of chicago press", "yale university press",
)


def ascii_only(c: Column) -> Column:
    """Accents folded, other characters beyond ASCII dropped."""
    return F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")


def dropping_title_words(c: Column) -> Column:
    """``title_words`` in which a letter that has no ASCII form vanishes instead of leaving a blank."""
    return title_words(ascii_only(c))


def _slug(c: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(ascii_only(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "collection").otherwise(made)


def surname_slug(c: Column) -> Column:
    """Slug of the family name: before a comma, else the last word with a particle before it; empty without a name."""
    name = normalize_space(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(ascii_only(name), F.lit("([A-Za-z]+(?:[-'][A-Za-z]+)?)"), F.lit(1))
    last, before = F.get(words, F.size(words) - 1), F.coalesce(F.get(words, F.size(words) - 2), F.lit(""))
    family = F.when(F.lower(before).isin(*PARTICLES), F.concat(before, F.lit("_"), last)).otherwise(last)
    return F.when(name == "", "").when(name.contains(","), _slug(F.split(name, ",", 2)[0])).when(F.size(words) == 0, "").otherwise(_slug(family))


@F.pandas_udf(T.StringType())
def bib_name(names: pd.Series) -> pd.Series:
    """``Family, Given`` of a person: shouted words get one capital, particles lower case; braces keep a name as it is."""
    import html
    import re

    word, gap = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), re.compile(r"\s+")

    def cased(part: str, family: bool) -> str:
        def one(m):
            w = m[0]
            if family and len(w) > 1 and w.lower() in PARTICLES:
                return w.lower()
            return w.capitalize() if len(w) > 1 and w.isupper() else w.upper() if len(w) == 1 else w

        return word.sub(one, part)

    def form(raw) -> str:
        name = gap.sub(" ", html.unescape(raw or "")).strip()
        if not name or (name[0] == "{" and name[-1] == "}"):
            return name
        if "," in name:
            family, given = (x.strip() for x in name.split(",", 1))
        else:
            given, _, family = name.rpartition(" ")
            rest, _, particle = given.rpartition(" ")
            if "".join(filter(str.isalpha, particle)).lower() in PARTICLES:
                given, family = rest, f"{particle} {family}"
        family, given = cased(family, True), cased(given, False)
        return f"{family}, {given}" if given else family

    return names.map(form)


def bib_names(rows, key: str, names: str, out: str = "author"):
    """(key, author): the names of a list in order, joined with the word and."""
    one = rows.select(key, F.posexplode_outer(names).alias("at_", "name_")).withColumn("name_", bib_name("name_"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("name_") != "", F.struct("at_", "name_")))), lambda x: x["name_"])
    return one.groupBy(key).agg(F.array_join(listed, " and ").alias(out))


def journal_code(venue: Column, given: Column | None = None) -> Column:
    """A known code stands; else the first phrase in the venue, else the first journal whose name holds or is held by it."""
    given = F.lit("") if given is None else F.lower(normalize_space(F.coalesce(given, F.lit(""))))
    name = dropping_title_words(venue)
    code = F.when(given == "wp", F.when(name.contains("world politics"), "wpol").otherwise("wp")).otherwise(given)
    found = [F.when(name.contains(phrase), short) for phrase, short in JOURNAL_PHRASES]
    for short, display in JOURNALS.items():
        plain = " ".join("".join(ch if ch.isalnum() else " " for ch in display.lower().replace("é", "e")).split())
        found.append(F.when(name.contains(plain) | F.lit(plain).contains(name), short))
    return F.when(code.isin(*JOURNALS) | (name == ""), code).otherwise(F.coalesce(*found, code))


def source_code(venue: Column) -> Column:
    """Capital initials of a venue's words, two to eight of them, else its first eight letters, else MISC."""
    plain = ascii_only(venue)
    words = F.filter(F.regexp_extract_all(plain, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: (w != "") & ~F.lower(w).isin(*CODE_STOPWORDS))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
    short = F.left(F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]+", "")), F.lit(8))
    return F.when(F.length(initials).between(2, 8), initials).when(short == "", "MISC").otherwise(short)


def _holds(c: Column, hints: tuple[str, ...]) -> Column:
    return c.rlike("|".join(hints))


def canonical_code(code: Column, venue: Column) -> Column:
    """A journal's code in lower case; the code of working papers is a journal's where the venue names it."""
    code = F.lower(normalize_space(F.coalesce(code, F.lit(""))))
    return F.when(code == "wp", F.when(dropping_title_words(venue).contains("world politics"), "wpol").otherwise("wp")).otherwise(code)


def unknown_journal(venue: Column) -> Column:
    """The slug of a venue that has no code."""
    venue = normalize_space(unescaped(F.coalesce(venue, F.lit(""))))
    return F.when(venue == "", "").otherwise(_slug(venue))


def paper_like(given: Column, venue: Column, publisher: Column, note: Column, title: Column) -> Column:
    """Reports, and what a series or a state of unpublished papers is named in."""
    return (given == "techreport") | _holds(dropping_title_words(F.concat_ws(" ", venue, publisher, note, title)), PAPER_HINTS)


def book_like(given: Column, venue: Column, publisher: Column, note: Column, title: Column) -> Column:
    """Chapters, what a publisher of books is named in, and books and chapters of any press."""
    parts = dropping_title_words(F.concat_ws(" ", venue, publisher, note))
    chapter = parts.contains("book chapter") | (parts.contains("chapter") & ~parts.contains("working paper"))
    return chapter | _holds(parts, PUBLISHER_HINTS) | (given.isin("book", "incollection") & _holds(parts, ("press", "routledge")))


def entry_type(given: Column, venue: Column, publisher: Column, note: Column, title: Column, code: Column, thesis: Column) -> Column:
    """article, techreport, book, incollection, phdthesis or misc; the first rule that holds decides."""
    given = F.lower(normalize_space(F.coalesce(given, F.lit(""))))
    args = (given, venue, publisher, note, title)
    chapter = (given == "incollection") | dropping_title_words(F.concat_ws(" ", venue, publisher, note)).contains("chapter")
    return (
        F.when(thesis, "phdthesis").when(journal_code(venue, code).isin(*JOURNALS) | (given == "article"), "article").when(paper_like(*args), "techreport")
        .when(book_like(*args) & chapter, "incollection").when(book_like(*args), "book")
        .when(F.lower(venue).rlike("university|school|department"), "phdthesis").when(given == "phdthesis", given).otherwise("misc")
    )


def stem_parts(stem: Column) -> Column:
    """author, year, code and copy suffix of a file stem ``author_year_code[_suffix]``."""
    suffix = F.regexp_extract(stem, r"(?:^|_)(\d{1,2}|[a-z])$", 1)
    base = F.when(suffix == "", stem).when(F.length(stem) == F.length(suffix), "").otherwise(F.left(stem, F.length(stem) - F.length(suffix) - 1))
    tokens = F.split(base, "_")
    at = F.coalesce(F.array_position(F.transform(tokens, lambda t: t.rlike(r"^(19|20)\d{2}$")), True), F.lit(0)).cast("int")
    first = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    author = F.when(at > 1, F.array_join(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))), "_")).otherwise(first)
    code = F.when(at > 0, F.array_join(F.slice(tokens, F.greatest(at + 1, F.lit(1)), F.size(tokens)), "_")).otherwise("")
    year = F.when(at > 0, F.get(tokens, at - 1)).otherwise("")
    return F.struct(author.alias("author"), year.alias("year"), code.alias("code"), suffix.alias("suffix"), base.alias("base"))

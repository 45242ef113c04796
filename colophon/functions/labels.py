"""Labels that texts get from patterns: regions, methods, audit studies; suffixes and tags of sources; search filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import JOURNALS, book_like, canonical_code, entry_type, journal_code, paper_like, unknown_journal
from .text import first_of, normalize_space

# Labels and their patterns, in order.
REGIONS = [
    ("Afghanistan", r"\bafghanistan\b"), ("Bangladesh", r"\bbangladesh\b"), ("Brazil", r"\bbrazil\b"), ("China", r"\bchina\b|\bchinese\b"),
    ("France", r"\bfrance\b|\bfrench\b"), ("India", r"\bindia\b|\bindian\b"), ("Indonesia", r"\bindonesia\b|\bindonesian\b"), ("Kenya", r"\bkenya\b|\bkenyan\b"),
    ("Latin America", r"\blatin america\b"), ("Mexico", r"\bmexico\b|\bmexican\b"), ("Nigeria", r"\bnigeria\b|\bnigerian\b"),
    ("Pakistan", r"\bpakistan\b|\bpakistani\b"), ("Poland", r"\bpoland\b|\bpolish\b"), ("Russia", r"\brussia\b|\brussian\b"), ("South Africa", r"\bsouth africa\b"),
    ("United Kingdom", r"\bunited kingdom\b|\bbritain\b|\bbritish\b"), ("United States", r"\bunited states\b|\bu\.s\.\b|\bamerica\b|\bamerican\b"),
]
METHODS = [
    ("audit experiment", r"\baudit experiment(?:s)?\b|\baudit stud(?:y|ies)\b"),
    ("correspondence study", r"\bcorrespondence (?:study|studies|experiment|experiments|test|tests)\b|\bemail[- ]based audit experiment\b"),
    ("field experiment", r"\bfield experiment\b|\brandomized field\b"), ("survey experiment", r"\bsurvey experiment\b"), ("natural experiment", r"\bnatural experiment\b"),
    ("difference-in-differences", r"\bdifference[- ]in[- ]differences\b|\bdid\b"), ("regression discontinuity", r"\bregression discontinuity\b|\brdd\b"),
    ("instrumental variables", r"\binstrumental variables?\b|\biv\b"), ("panel data", r"\bpanel data\b"), ("administrative data", r"\badministrative data\b"),
    ("observational data", r"\bobservational data\b"), ("computational text analysis", r"\btext analysis\b|\bnlp\b|\bcomputational\b"),
    ("case study", r"\bcase study\b|\bcomparative case\b"), ("archival research", r"\barchival\b"), ("formal theory", r"\bformal model\b|\bformal theory\b"),
]
AUDIT_PARENT = "audit-correspondence"
AUDIT = [
    ("audit-study", r"\baudit experiment(?:s)?\b|\baudit stud(?:y|ies)\b"),
    ("correspondence-study", r"\bcorrespondence (?:study|studies|experiment|experiments|test|tests)\b|\bemail correspondence study\b|\bemail[- ]based audit experiment\b"),
]


def labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the rules that hit, in rule order; case is ignored and words are those of Unicode."""
    c = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(c.rlike(f"(?iU){p}"), label) for label, p in rules)))


def regions(*chunks: Column) -> Column:
    return labels(F.concat_ws("\n", *chunks), REGIONS)


def methods(*chunks: Column) -> Column:
    return labels(F.concat_ws(" ", *chunks), METHODS)


def audit_tags(text: Column) -> Column:
    """Labels of audit and correspondence studies in a text, after the tag that stands for both kinds."""
    found = labels(text, AUDIT)
    return F.when(F.size(found) > 0, F.concat(F.array(F.lit(AUDIT_PARENT)), found)).otherwise(found)


def name_suffix(record: dict[str, Column], fallback: Column, thesis: Column) -> Column:
    """What a file's name ends with: a known journal's code, wp, the venue's own slug, book, or misc.

    ``record`` has venue, journal_abbr, entry_type, publisher, note and title.
    """
    v = {k: normalize_space(F.coalesce(c, F.lit(""))) for k, c in record.items()}
    code, kind = F.coalesce(journal_code(v["venue"], first_of(v["journal_abbr"], fallback)), F.lit("")), F.lower(v["entry_type"])
    own = first_of(unknown_journal(v["venue"]), F.lit("misc"))
    args = (kind, v["venue"], v["publisher"], v["note"], v["title"])
    made = entry_type(*args, v["journal_abbr"], thesis)
    return (
        F.when(code.isin(*JOURNALS), code).when(canonical_code(fallback, v["venue"]) == "wp", "wp").when((kind == "article") & (v["venue"] != ""), own)
        .when(paper_like(*args), "wp").when(book_like(*args), "book").when(made == "techreport", "wp").when((made == "article") & (v["venue"] != ""), own).otherwise("misc")
    )


def source_tag(record: dict[str, Column], fallback: Column, thesis: Column) -> Column:
    """The tag of a source: a known journal's code, an article's venue as a slug, else the code given."""
    v = {k: normalize_space(F.coalesce(c, F.lit(""))) for k, c in record.items()}
    code = F.coalesce(journal_code(v["venue"], first_of(v["journal_abbr"], fallback)), F.lit(""))
    made = entry_type(v["entry_type"], v["venue"], v["publisher"], v["note"], v["title"], v["journal_abbr"], thesis)
    return F.when(code.isin(*JOURNALS), code).when((made == "article") & (v["venue"] != ""), unknown_journal(v["venue"])).otherwise(canonical_code(fallback, v["venue"]))


def search_filter(source_id: Column, strategy: Column, query: Column, year: Column) -> Column:
    """The filter that a paged search of works is asked with: titles, source, first year, articles that are no paratext."""
    return F.concat_ws(
        ",", F.when(strategy == "title_search", F.concat(F.lit("title.search:"), query)), F.concat(F.lit("primary_location.source.id:"), source_id),
        F.when(year.isNotNull(), F.concat(F.lit("from_publication_date:"), year.cast("string"), F.lit("-01-01"))), F.lit("type:article"), F.lit("is_paratext:false"),
    )


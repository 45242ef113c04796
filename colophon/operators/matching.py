"""Keyword matching with provenance, rule tagging and first-wins merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_pattern


def matched_terms(c: Column, keywords: list[str]) -> Column:
    """Keywords that occur in a text as whole words, sorted."""
    hits = F.array(*(F.when(c.rlike(keyword_pattern(k)), k) for k in sorted(keywords)))
    return F.array_compact(hits)


def keyword_match(rows: DataFrame, fields: list[str], keywords: list[str], mode: str = "any", weak: str = "", exclude: list[str] | None = None) -> DataFrame:
    """Rows that match, with ``matched_terms`` and ``matched_fields``.

    mode ``all`` asks for every keyword somewhere in the fields.  A row that matches in the field ``weak`` alone is
    dropped when one of the patterns ``exclude`` (case ignored) hits that field.
    """
    terms = [matched_terms(F.coalesce(F.col(f), F.lit("")), keywords).alias(f"t_{i}") for i, f in enumerate(fields)]
    out = rows.select("*", *terms)
    found = F.array_sort(F.array_distinct(F.concat(*(F.col(f"t_{i}") for i in range(len(fields))))))
    where = F.array_compact(F.array(*(F.when(F.size(F.col(f"t_{i}")) > 0, f) for i, f in enumerate(fields))))
    out = out.withColumn("matched_terms", found).withColumn("matched_fields", where).drop(*(f"t_{i}" for i in range(len(fields))))
    out = out.where(F.size("matched_terms") == len(set(keywords)) if mode == "all" else F.size("matched_terms") > 0)
    for pattern in exclude or [] if weak else []:
        alone = (F.size("matched_fields") == 1) & (F.get("matched_fields", F.lit(0)) == weak)
        out = out.where(~(alone & F.coalesce(F.col(weak), F.lit("")).rlike(f"(?i){pattern}")))
    return out


# Titles of reviews, and abstracts that use a keyword in another sense.
REVIEWS = (r"\bbook review\b", r"^\s*review essay\b", r"^\s*review of\b", r"\bedited by\b", r"\bPp\.\b", r"\.\s*By\s+[A-Z]")
OTHER_SENSES = (
    r"behavioral risk factor surveillance", r"developmental surveillance", r"surveillance department", r"post-market surveillance", r"budget surveillance", r"import surveillance",
)


def discovered(
    works: DataFrame, keywords: list[str], fields: tuple[str, ...] = ("title", "abstract"), mode: str = "any", reviews: tuple[str, ...] = REVIEWS,
    exclude: tuple[str, ...] = OTHER_SENSES,
) -> DataFrame:
    """Works that the keywords find: those without a title and reviews are dropped, then as ``keyword_match`` with the
    abstract as the weak field."""
    title = F.trim(F.coalesce("title", F.lit("")))
    kept = works.where(title != "")
    if reviews:
        kept = kept.where(~title.rlike("(?iU)" + "|".join(f"(?:{p})" for p in reviews)))
    return keyword_match(kept, list(fields), keywords, mode, weak="abstract", exclude=list(exclude))


def upsert(rows: DataFrame, key: list[str], order: list[str], sets: list[str]) -> DataFrame:
    """One row a key: scalars of the first row by ``order``, array columns ``sets`` united and sorted.

    Both parts combine before the shuffle.
    """
    scalars = [c for c in rows.columns if c not in (*key, *sets)]
    pick = F.min_by(F.struct(*scalars), F.struct(*order)).alias("first_")
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in sets]
    return rows.groupBy(*key).agg(pick, *union).select(*key, "first_.*", *sets)


def tags(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the rules (label, pattern) that hit, in rule order."""
    return F.array_compact(F.array(*(F.when(c.rlike(f"(?i){p}"), label) for label, p in rules)))


def cascade(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out

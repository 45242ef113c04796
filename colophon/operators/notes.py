"""Notes: quality, merging, orphans, links, related bullets, renaming plans.

A note is a row (dir, stem, title, doi, status, tags, aliases, body); nothing is written, actions come out as rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dropping_title_words, stem_parts
from ..functions.text import normalize_space, ratio
from ..sources.readers import section

LINK = r"\[\[([^\]]+)\]\]"
_TEXTS = "array<string>"


def _tags(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_TEXTS))


def words(body: Column) -> Column:
    """Words of a text."""
    return F.size(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1)))


def _status(c: Column) -> Column:
    return F.lower(normalize_space(F.coalesce(c, F.lit(""))))


def quality(status: Column, tags: Column, body: Column) -> Column:
    """Words plus what status, tags and sections are worth."""
    status, tags, body = _status(status), _tags(tags), F.coalesce(body, F.lit(""))
    # Worth of each sign.
    by_status = F.when(status == "synthesized", 300).when(status == "organized", 180).when(status == "imported-metadata", -180).otherwise(0)
    by_tag = [F.when(F.array_contains(tags, t), n).otherwise(0) for t, n in (("metadata-review", -160), ("needs-summary", -120))]
    by_part = [F.when(body.contains(f"## {h}"), n).otherwise(0) for h, n in (("One-Sentence Takeaway", 140), ("Core Argument", 120), ("Research Question", 80))]
    return sum([*by_tag, *by_part], words(body) + by_status)


def is_stub(status: Column, tags: Column, body: Column) -> Column:
    """Notes that hold metadata only: a missing note (null body) is one."""
    n, tags = words(body), _tags(tags)
    bare = (n < 180) & body.contains("## Basic Information") & body.contains("## Abstract / Extracted Summary")
    return body.isNull() | (_status(status) == "imported-metadata") | F.array_contains(tags, "metadata-review") | (F.array_contains(tags, "needs-summary") & (n < 280)) | bare


def is_stub_text(status: Column, tags: Column, body: Column) -> Column:
    tags = _tags(tags)
    return (_status(status) == "imported-metadata") | F.array_contains(tags, "metadata-review") | (F.array_contains(tags, "needs-summary") & (words(body) < 200))


def wants_title(title: Column, stem: Column) -> Column:
    """Titles that a resolved one replaces: none, a placeholder, a section's name, or the file's stem."""
    plain = F.lower(normalize_space(F.coalesce(title, F.lit(""))))
    # Names that are no titles.
    empty = plain.isin("", "untitled", "introduction", "preface", "editorial", "foreword") | plain.contains("metadata unresolved")
    return empty | (dropping_title_words(title) == dropping_title_words(F.replace(stem, F.lit("_"), F.lit(" "))))


def generic_title(title: Column) -> Column:
    """Titles that say nothing: series names, markup, codes with few letters, short shouts, fewer than eight letters."""
    title = F.coalesce(title, F.lit(""))
    plain, low = dropping_title_words(title), F.lower(title)
    count = lambda kind: F.length(F.regexp_replace(title, f"[^{kind}]", ""))
    letters, few = count(r"\p{L}"), F.size(F.regexp_extract_all(title, F.lit("([A-Za-z0-9]+)"), F.lit(1))) <= 3
    # Names of series and a macro that covers leave in titles.
    named = plain.isin("", "nber working paper series", "working paper series") | low.startswith("[renewcommand]") | low.contains("\\renewcommand")
    return named | ((count(r"\p{Nd}") > 0) & (letters <= 12) & few) | ((letters > 0) & (count(r"\p{Lu}") >= F.lit(0.7) * letters) & few) | (letters < 8)


def prunable(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, stem) of notes to drop: no file, imported metadata only, no identifier, venue or year, a title that says
    nothing, 500 words at most.  ``notes`` also has year and venue."""
    text = lambda c: normalize_space(F.coalesce(c, F.lit("")))
    bare = (_status(F.col("status")) == "imported-metadata") & (text("doi") == "") & (text("venue") == "") & ~text("year").rlike(r"^(19|20)\d{2}$")
    lost = notes.join(files.select("dir", "stem"), ["dir", "stem"], "left_anti")
    return lost.where(bare & (words(F.col("body")) <= 500)).where(generic_title(text("title"))).select("dir", "stem")


def basic_information(authors: Column, year: Column, venue: Column, doi: Column, pdf: Column, volume: Column, issue: Column, pages: Column) -> Column:
    """Lines of a note's section on its source; volume, issue and pages only where one is known."""
    v = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shown = [F.concat(F.lit(f"- {k}: "), x) for k, x in (("Authors", F.coalesce(F.array_join(authors, ", "), F.lit(""))), ("Year", v(year)), ("Venue", v(venue)), ("DOI", v(doi)))]
    numbers = [v(volume), v(issue), v(pages)]
    some = F.when(F.concat(*numbers) != "", F.concat(F.lit("- Volume / Issue / Pages: "), F.concat_ws(" / ", *numbers)))
    return F.concat_ws("\n", *shown, F.concat(F.lit("- PDF: [["), v(pdf), F.lit("]]")), some)


def copies(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, stem, target) of notes without a file whose stem, less its copy suffix, has one."""
    lost = notes.select("dir", "stem").join(files.select("dir", "stem"), ["dir", "stem"], "left_anti").withColumn("p", stem_parts(F.col("stem")))
    lost = lost.where("p.suffix <> ''").select("dir", "stem", F.col("p.base").alias("target"))
    return lost.join(files.select("dir", F.col("stem").alias("target")).distinct(), ["dir", "target"], "left_semi").select("dir", "stem", "target")


def renamed(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, stem, target) of notes without a file that fit one file only by author and year (either may be unknown) and
    agree with that file's note in identifier or title, or find no note there.

    One equi-join for each set of known parts; files are counted by key before they meet, so a key with many files adds
    one row for each note and no pairs.
    """
    parts = lambda rows: rows.withColumn("p", stem_parts(F.col("stem"))).withColumn("author", F.col("p.author")).withColumn("year", F.col("p.year"))
    lost = parts(notes.join(files.select("dir", "stem"), ["dir", "stem"], "left_anti").select("dir", "stem", "title", "doi"))
    have, found = parts(files.select("dir", "stem").distinct()), []
    for known in (["author", "year"], ["author"], ["year"], []):
        pick = [(F.col(k) != "") if k in known else (F.col(k) == "") for k in ("author", "year")]
        sole = have.groupBy("dir", *known).agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("target")).where("n = 1").drop("n")
        found.append(lost.where(pick[0] & pick[1]).join(sole, ["dir", *known]).select("dir", "stem", "title", "doi", "target"))
    one = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).where("stem <> target")
    plain = lambda x: dropping_title_words(F.col(x))
    there = notes.select("dir", F.col("stem").alias("target"), F.col("title").alias("t_title"), F.col("doi").alias("t_doi"), F.lit(True).alias("there"))
    met = one.join(there, ["dir", "target"], "left").withColumn("a", plain("title")).withColumn("b", plain("t_title"))
    doi = lambda x: F.lower(normalize_space(F.coalesce(F.col(x), F.lit(""))))
    same_doi = (doi("doi") != "") & (doi("doi") == doi("t_doi"))
    close = (F.col("a") != "") & (F.col("there").isNull() | ((F.col("b") != "") & ((F.col("a") == F.col("b")) | (_ratio("a", "b") >= 0.92))))
    return met.where(same_doi | close).select("dir", "stem", "target")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def merged(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dir, stem, winner, aliases, body) for every target of ``pairs``: of a target's note and the notes that go into it
    the one of highest quality, the target's own on ties, then the smaller stem; aliases of all, the winner's first."""
    named = pairs.select("dir", "stem", F.col("target").alias("into")).unionByName(pairs.select("dir", F.col("target").alias("stem"), F.col("target").alias("into")).distinct())
    rows = notes.join(named, ["dir", "stem"]).withColumn("q", quality(F.col("status"), F.col("tags"), F.col("body"))).withColumn("own", F.col("stem") == F.col("into"))
    rank = F.struct(-F.col("q"), ~F.col("own"), F.col("stem"))
    names = F.filter(F.transform(_tags(F.col("aliases")), lambda x: normalize_space(x)), lambda a: a != "")
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), names.alias("names"), F.col("stem").alias("s"))))
    best = rows.groupBy("dir", "into").agg(F.min_by(F.struct("stem", "body"), rank).alias("w"), listed.alias("all_"))
    aliases = F.concat(F.get("all_", F.lit(0))["names"], F.array("into"), F.array_sort(F.transform("all_", lambda x: x["s"])), F.flatten(F.transform("all_", lambda x: x["names"])))
    return best.select("dir", F.col("into").alias("stem"), F.col("w.stem").alias("winner"), F.array_distinct(aliases).alias("aliases"), F.col("w.body").alias("body"))


def link_index(notes: DataFrame, root: str = "Notes") -> DataFrame:
    """(path, fixed): every way to write a note, by its stem or an alias under each name of its directory; on clashes the
    note's own stem wins, then the greatest stem."""
    aliases = F.filter(F.transform(_tags(F.col("aliases")), lambda x: normalize_space(x)), lambda a: (a != "") & ~a.contains("/"))
    named = notes.select("dir", "stem", F.explode(F.array_distinct(F.concat(F.array("stem"), aliases))).alias("name"))
    fixed, own = F.concat(F.lit(f"{root}/"), "dir", F.lit("/"), "stem"), F.col("name") == F.col("stem")
    rows = named.select(F.explode(_parents(root)).alias("parent"), "name", "stem", own.alias("own"), fixed.alias("fixed"))
    return rows.groupBy(F.concat("parent", F.lit("/"), "name").alias("path")).agg(F.max_by("fixed", F.struct("own", "stem")).alias("fixed"))


def _parents(root: str) -> Column:
    # The folders that notes were kept in.
    return F.array_distinct(F.array(F.concat(F.lit(f"{root}/"), "dir"), F.concat(F.lit("Notes/"), "dir"), F.concat(F.lit("Reading Notes/"), "dir"), F.col("dir")))


def resolved(targets: DataFrame, notes: DataFrame, root: str = "Notes") -> DataFrame:
    """(target, fixed) of link targets: exact, else in the named directory the most similar stem (0.74 or more).

    Similar stems are sought for the targets left over only, each against its directory; author and year, where both
    sides know them, must agree unless no stem agrees.
    """
    path = F.regexp_replace(F.trim(F.replace("target", F.lit("\\"), F.lit("/"))), r"\.md$", "")
    asked = targets.select("target").distinct().withColumn("path", path)
    exact = asked.join(link_index(notes, root), "path")
    left = asked.join(exact.select("target"), "target", "left_anti").where(F.col("path").contains("/"))
    left = left.select("target", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1).alias("parent"), F.regexp_extract("path", r"(?s)([^/]*)$", 1).alias("want"))
    stems = notes.select("dir", F.explode(_parents(root)).alias("parent"), "stem").distinct().withColumn("h", stem_parts(F.col("stem")))
    met = left.withColumn("w", stem_parts(F.col("want"))).join(stems, "parent")
    clash = lambda k: (F.col(f"w.{k}") != "") & (F.col(f"h.{k}") != "") & (F.col(f"w.{k}") != F.col(f"h.{k}"))
    both = F.length("want") + F.length("stem")
    score = F.when(2 * F.least(F.length("want"), F.length("stem")) >= F.lit(0.74) * both, _ratio("want", "stem")).otherwise(0.0)
    met = met.select("target", "dir", "stem", (~(clash("author") | clash("year"))).alias("fits"), score.alias("score"))
    best = met.groupBy("target").agg(F.min_by(F.struct("dir", "stem", "score"), F.struct(~F.col("fits"), -F.col("score"), "stem")).alias("b")).where("b.score >= 0.74")
    return exact.select("target", "fixed").unionByName(best.select("target", F.concat(F.lit(f"{root}/"), "b.dir", F.lit("/"), "b.stem").alias("fixed")))


def _rejoined(pieces: str, links: Column) -> Column:
    """Texts between links and links in turn."""
    return F.array_join(F.zip_with(pieces, links, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")


def repaired_links(texts: DataFrame, id_: str, text: str, notes: DataFrame, root: str = "Notes") -> DataFrame:
    """(id, text) of texts whose links change: each link to a note by its present path, labels kept."""
    rows = texts.select(id_, F.col(text).alias("old"), F.split(text, LINK).alias("pieces"), F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("links"))
    one = rows.select(id_, F.posexplode("links").alias("i", "inner"))
    one = one.withColumn("target", F.split("inner", r"\|", 2)[0]).withColumn("label", F.regexp_extract("inner", r"(?s)^[^|]*(\|.*)$", 1))
    one = one.where(~F.col("target").endswith(".pdf") & ~F.col("target").startswith("http"))
    hits = one.join(resolved(one, notes, root), "target").where("fixed <> target AND fixed <> regexp_replace(target, '[.]md$', '')")
    put = hits.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("i", F.concat("fixed", "label")))).alias("put"))
    new = F.transform("links", lambda x, i: F.concat(F.lit("[["), F.coalesce(F.element_at("put", i), x), F.lit("]]")))
    return rows.join(put, id_).select(id_, _rejoined("pieces", new).alias(text)).where(F.col(text).isNotNull())


def with_section(body: Column, heading: str, content: Column) -> Column:
    """The body with a section's content replaced, or the section appended."""
    made = F.concat(F.lit(f"## {heading}\n"), F.trim(content), F.lit("\n"))
    place = rf"(?ms)^## \Q{heading}\E\n.*?(?=^## |\z)"
    end = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    cut = F.concat(end(F.regexp_replace(body, place, F.concat(F.replace(F.replace(made, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("\n")))), F.lit("\n"))
    return F.when(body.rlike(place), cut).when(end(body) == "", F.concat(made, F.lit("\n"))).otherwise(F.concat(end(body), F.lit("\n\n"), made, F.lit("\n")))


def related_bullets(body: Column) -> Column:
    """Bullets that link, from the sections that older notes keep them in."""
    # The old headings, in order.
    found = [F.split(section(body, h), "\n") for h in ("Related Papers", "Related Dissertations", "Related Articles", "Related Notes")]
    return F.filter(F.transform(F.flatten(F.array(*found)), F.trim), lambda x: x.startswith("- [["))


def bullet_key(c: Column) -> Column:
    key = F.regexp_extract(c, r"\[\[([^\]|]+)", 1)
    return F.when(key == "", c).otherwise(key)


def merged_bullets(existing: Column, generated: Column, limit: int = 8) -> Column:
    """Existing bullets, then new ones, one for each link, eight at most; a lone dash if there are none."""
    rows = F.concat(existing, generated)
    keys = F.transform(rows, bullet_key)
    once = F.filter(rows, lambda x, i: F.array_position(keys, bullet_key(x)) == i + 1)
    return F.when(F.size(rows) == 0, "- ").otherwise(F.array_join(F.slice(once, 1, limit), "\n"))


def standardized(stem: Column) -> Column:
    """Stems of the form author_year_code in plain lower case, their copy suffix aside."""
    base = stem_parts(stem)["base"]
    p = stem_parts(base)
    return base.rlike("^[a-z0-9_]+$") & (p["author"] != "") & (p["year"] != "") & (p["code"] != "")


def rename_plan(files: DataFrame) -> DataFrame:
    """(dir, stem, target, action, reason) for files (dir, stem, desired, sha256, noted, stub); a null ``desired`` stays.

    Of equal contents the best file stays: standardized name, full note, any note, short name.  The others are archived,
    or reviewed where both notes are more than stubs.  Then every file in order takes its desired name, or meets its
    equal there, or takes _2, _3, ...; later files see the names that earlier ones left and took.  The order makes it a
    fold, one directory a task, over names and hashes and never over contents.
    """
    rows = files.select("dir", "stem", "desired", "sha256", F.col("noted").alias("noted"), F.col("stub").alias("stub"), standardized(F.col("stem")).alias("std"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], {}
        stub = dict(zip(group["stem"], group["stub"] | ~group["noted"], strict=True))
        safe = lambda a, b: stub.get(a, True) or stub.get(b, True)
        at = dict(zip(group["stem"], group["sha256"], strict=True))

        def say(stem, target, action, reason):
            out.append((group["dir"].iloc[0], stem, target, action, reason))

        keyed = group.assign(size=group["stem"].str.len(), low=group["stem"].str.lower(), full=group["noted"] & ~group["stub"])
        for r in keyed.sort_values(["std", "full", "noted", "size", "low"], ascending=[False, False, False, True, True], kind="stable").itertuples():
            first = seen.setdefault(r.sha256, r.stem)
            if first != r.stem:
                if safe(r.stem, first):
                    del at[r.stem]
                    say(r.stem, first, "archive", "exact_duplicate_in_folder")
                else:
                    say(r.stem, first, "review", "exact_duplicate_with_two_non_stub_notes")
        for r in keyed.sort_values(["std", "noted", "size", "low"], ascending=[False, False, True, True], kind="stable").itertuples():
            want = r.desired
            if r.stem not in at or not isinstance(want, str) or want == r.stem:
                continue
            if at.get(want) == r.sha256:
                if safe(r.stem, want):
                    del at[r.stem]
                    say(r.stem, want, "archive", "exact_duplicate")
                else:
                    say(r.stem, want, "review", "duplicate_pdf_with_two_non_stub_notes")
                continue
            name, k = want, 1
            while name in at:
                k += 1
                name = f"{want}_{k}"
            at[name] = at.pop(r.stem)
            say(r.stem, name, "rename", "normalized_name" if k == 1 else "normalized_with_suffix")
        return pd.DataFrame(out, columns=["dir", "stem", "target", "action", "reason"])

    return rows.groupBy("dir").applyInPandas(plan, "dir string, stem string, target string, action string, reason string")

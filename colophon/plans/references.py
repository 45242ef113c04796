"""Lines, pages, segments, keys and duplicates of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_of, reference_id, title_words
from ..operators import joins as j
from ..operators import references as r
from ..operators.stages import stored
from .registry import query, table

_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LINES = "(SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i))"


def _lines(spark, sf_dir):
    return r.lines(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""SELECT key, arg_min(line, (doc_id, line_no)) AS line, count(*) AS n FROM (SELECT *, {_KEY.format("line")} AS key FROM {_LINES}) WHERE length(key) >= 20 GROUP BY key""")
def text_key_distinct(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("key", title_words(F.col("line"))).where(F.length("key") >= 20)
    return rows.groupBy("key").agg(F.min_by("line", F.struct("doc_id", "line_no")).alias("line"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT key, split_part(key, ' ', 1) AS block, min(doc_id * 100000 + line_no) AS id FROM (SELECT *, {_KEY.format("line")} AS key FROM {_LINES}) WHERE length(key) >= 20 GROUP BY key)
SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.block = y.block AND x.id < y.id
WHERE (contains(x.key, y.key) AND length(y.key) >= floor(length(x.key) * 0.72::DOUBLE)) OR (contains(y.key, x.key) AND length(x.key) >= floor(length(y.key) * 0.72::DOUBLE))""")
def near_dup_pairs_contain(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("norm", title_words(F.col("line"))).where(F.length("norm") >= 20)
    rows = rows.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), "norm", F.split("norm", " ")[0].alias("block"))
    return r.similar_references(rows, ["block"], "id", "norm")


@query(f"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {_KEY.format("text")} || ' ' AS d FROM documents) JOIN (SELECT item_id, ' ' || {_KEY.format("text")} || ' ' AS t FROM benchmark WHERE length({_KEY.format("text")}) > 0) ON contains(d, t)""")
def benchmark_contained(spark, sf_dir):
    """Documents that hold an item's words in a row: joined by the item's first words, then compared whole."""
    items = table(spark, sf_dir, "benchmark").select("item_id", title_words(F.col("text")).alias("t")).where("t <> ''").withColumn("w", F.split("t", " "))
    items = items.withColumn("k", F.least(F.size("w"), F.lit(5))).withColumn("lead", F.array_join(F.slice("w", 1, F.col("k")), " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", title_words(F.col("text")).alias("d")).withColumn("w", F.split("d", " "))
    sizes = [x.k for x in items.select("k").distinct().collect()]  # at most five numbers

    def runs(k: int):
        """All runs of k words."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))

    leads = [runs(k) for k in sizes]
    spread = docs.select("doc_id", "d", F.explode(F.array_distinct(F.concat(*leads) if leads else F.array().cast("array<string>"))).alias("lead"))
    met = spread.select("doc_id", "lead").join(items.select("item_id", "lead", "t"), "lead").select("doc_id", "item_id", "t").distinct()
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.join(docs.select("doc_id", "d"), "doc_id").where(pad("d").contains(pad("t"))).select("doc_id", "item_id")


@query(f"""SELECT doc_id, left(sha1({_KEY.format("text")}), 12) AS reference_id FROM documents""")
def reference_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reference_id(title_words(F.col("text"))).alias("reference_id"))


@query(f"""SELECT doc_id, line_no, line FROM {_LINES} WHERE length(line) >= 5 AND NOT (length(line) <= 200 AND (regexp_matches(line, '(?i)license') OR regexp_matches(line, '(?i)@') OR regexp_matches(line, '(?i)[0-9]{{3}}')))""")
def line_filter(spark, sf_dir):
    bad = r.boilerplate(F.col("line"), ["license", "@", "[0-9]{3}"], 200)
    return _lines(spark, sf_dir).where((F.length("line") >= 5) & ~bad).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '' AND length(trim(line)) < 20) AS reference_lines, count(*) FILTER (WHERE trim(line) <> '') AS lines FROM {_LINES} GROUP BY doc_id""")
def page_scores(spark, sf_dir):
    return r.page_scores(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), F.length("line") < 20)


@query(f"""SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {_LINES} WHERE length(line) < 80) GROUP BY doc_id, g""")
def contiguous_blocks(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(F.length("line") < 80).withColumn("line_no", F.col("line_no").cast("long"))
    return r.islands(rows, "doc_id", "line_no")


@query(f"""SELECT doc_id, greatest(s, 1) AS segment, string_agg(line, ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(CASE WHEN length(line) < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM {_LINES}) GROUP BY 1, 2""")
def segment_lines(spark, sf_dir):
    return r.segments(_lines(spark, sf_dir), "doc_id", "line_no", F.length("line") < 80, "line").select("doc_id", F.col("segment").cast("decimal(38,0)").alias("segment"), "text")


@query("""SELECT doc_id, len(p) AS n_parts, p[1] AS first_part, p[len(p)] AS last_part FROM (SELECT doc_id, string_split(text, ' | ') AS p FROM documents WHERE contains(text, ' | '))""")
def inline_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains(" | ")).select("doc_id", F.split("text", r" \| ").alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.element_at("p", 1).alias("first_part"), F.element_at("p", -1).alias("last_part"))


@query("""SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, c AS copies, CASE WHEN doc_id = f THEN 'primary' ELSE 'duplicate' END AS role FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE c > 1""")
def exact_duplicates(spark, sf_dir):
    return j.content_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("size", F.col("size").cast("long"))


@query()
def near_dup_components(spark, sf_dir):
    """Whole texts that are similar and begin with the same word are one; no SQL has the ratio."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"), title_words(F.col("text")).alias("norm"), "text").where("norm <> ''")
    rows = rows.withColumn("block", F.split("norm", " ")[0])
    firsts = stored(rows.groupBy("block", "norm").agg(F.min("doc_id").alias("id")))
    parts = r.similar_components(firsts, ["block"], "id", "norm")
    return rows.join(firsts, ["block", "norm"]).join(parts, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("origin")), " | ").alias("origins"))


_LOOKUP = """SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 'label' WHEN c.role IS NOT NULL THEN 'conversation' ELSE 'fallback' END AS provider,
  COALESCE('q' || l.quality, c.role, '') AS value FROM documents LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY 1) c ON c.conv_id = doc_id"""


@query(_LOOKUP)
def lookup_cascade(spark, sf_dir):
    """Providers in order of preference: labels, conversations, nothing."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).withColumnRenamed("conv_id", "doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(talk, "doc_id", "left")
    provider = F.when(F.col("quality").isNotNull(), "label").when(F.col("role").isNotNull(), "conversation").otherwise("fallback")
    return rows.select("doc_id", provider.alias("provider"), first_of(F.concat(F.lit("q"), F.col("quality").cast("string")), F.col("role")).alias("value"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, source, COALESCE(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM (SELECT doc_id, split_part(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ', 1) AS name FROM documents))""")
def name_allocation(spark, sf_dir):
    return j.allocated_names(table(spark, sf_dir, "documents").select("doc_id", F.split(title_words(F.col("text")), " ")[0].alias("name")), "doc_id", "name")


_FULL = """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_slice(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda y: y.x), 1, 18)) AS tok FROM w),
p AS (SELECT x.doc_id AS id, y.doc_id AS other, count(*) AS shared FROM t x JOIN t y ON x.tok = y.tok AND x.doc_id <> y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM p)
SELECT id, other, shared, least(1.8::DOUBLE, shared * 0.22::DOUBLE) AS score, rank FROM r WHERE rank <= 6"""


@query(_FULL)
def related_topk(spark, sf_dir):
    from ..functions.text import significant_tokens

    rows = table(spark, sf_dir, "documents").select("doc_id", significant_tokens(F.col("text"), 18).alias("tokens"))
    out = j.related(rows, "doc_id", "tokens")
    return out.select("id", "other", F.col("shared").cast("long").alias("shared"), "score", F.col("rank").cast("long").alias("rank"))

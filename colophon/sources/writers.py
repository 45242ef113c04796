"""Writers.  Set columns are sorted first, so that equal results give equal files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(rows: DataFrame) -> DataFrame:
    """Array columns as text: sorted and separated by semicolons."""
    return rows.select(*(F.array_join(F.array_sort(f.name), "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name for f in rows.schema))


def write_csv(rows: DataFrame, path: str, one_file: bool = False, fixed: bool = False) -> None:
    """CSV with a header; ``one_file`` is for manifests that fit one task.

    Without rows a manifest is an empty file; with ``fixed`` columns the header is written all the same.
    """
    out = flat(rows)
    if not fixed and rows.isEmpty():
        out.limit(0).select(F.lit("").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    if fixed and rows.isEmpty():
        spark = rows.sparkSession
        line = ",".join(f'"{c}"' if any(x in c for x in ',"') else c for c in out.columns)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_summary(row: DataFrame, path: str) -> None:
    """A summary of one row as JSON, lists and missing values included."""
    row.coalesce(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_bibliography(entries: DataFrame, path: str) -> None:
    """Entries (key, entry) sorted by key, a blank line between them."""
    entries.orderBy("key").select(F.concat("entry", F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    sets = {f.name: F.array_sort(f.name) for f in rows.schema if isinstance(f.dataType, T.ArrayType)}
    rows.withColumns(sets).write.mode("overwrite").json(path) if sets else rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)

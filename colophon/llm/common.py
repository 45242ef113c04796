"""What the operators share: tables, the shared folder, null-safe columns."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local session gets a
    folder of its own; on a cluster there is none that all could read, so the setting is required."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_colophon_dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that driver and executors share")
        at = sc._colophon_dir = tempfile.mkdtemp(prefix="colophon-")
    return at.rstrip("/")


_written: list[tuple[object, str]] = []


def _remove(sc, path: str) -> None:
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colophon/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark.sparkContext, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._colophon_path = path  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    path = getattr(df, "_colophon_path", None)
    if path:
        _remove(df.sparkSession.sparkContext, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _at_exit() -> None:
    for sc, path in _written:
        try:
            if sc._jsc is not None:
                _remove(sc, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            return


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model may see."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is in memory at both ends.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows or about BATCH_BYTES, with memory given back after every
    task.  The limits are settings of the session, which Spark reads when the plan runs: they are lowered, never raised."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):  # 0 and less mean no limit
            conf.set(key, str(most))

    def tidy(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def signed(a):
    """uint64 to int64, bit for bit."""
    import numpy as np

    return np.asarray(a).astype(np.uint64, copy=False).view(np.int64)

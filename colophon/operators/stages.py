"""Results at rest: a long plan is cut where its result is used more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, kept as a checkpoint in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset a local session gets a folder of its own; on a cluster the setting is required.
    """
    _shared(rows.sparkSession.sparkContext)
    return rows.checkpoint()


#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def in_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``rows.mapInArrow`` in small batches; the limits are settings of the session, lowered and never raised."""
    conf = rows.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):  # 0 and less mean no limit
            conf.set(key, str(most))

    def tidy(batches):
        yield from run(batches)
        trim()

    return rows.mapInArrow(tidy, schema)


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


_kept: list[tuple] = []


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, kept as a compressed Parquet table in the same folder: for whole texts."""
    sc = rows.sparkSession.sparkContext
    path = f"{_shared(sc)}/rows-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    _kept.append((sc, path))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    for sc, path in _kept:
        try:
            if sc._jsc is not None:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            pass


def _shared(sc) -> str:
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir is not set: a folder is needed that driver and executors share")
            at = tempfile.mkdtemp(prefix="colophon-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()

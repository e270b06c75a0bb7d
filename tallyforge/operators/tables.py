"""Tables that an operator writes on its way, and tables that are added to once."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset and the master is local, one
    of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tallyforge-base-{os.getuid()}")
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of the lineage that outlives executors. ``discard`` deletes it. The
    shuffle files of the write are deleted with its end."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallyforge_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` made; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_tallyforge_path", None):
            fs, p = _place(t.sparkSession, path)
            fs.delete(p, True)


def put(rows: DataFrame, path: str, batch: str, *by: str) -> bool:
    """Adds rows to a table once for each batch id: False, and nothing written, if that batch is there.

    The rows are written in the table's folder under a hidden name and published by one rename to ``_batch=<id>``; readers see a batch
    whole or not at all, where renames are atomic. What a killed writer left stays hidden until ``clear_pending``. Partitioned
    ``by`` columns within the batch. Usable in foreachBatch with the epoch as batch id.
    """
    spark = rows.sparkSession
    name = str(batch)
    if not name or any(c in name for c in "/=\\% ") or name.startswith((".", "_")):
        raise ValueError(f"not a batch id: {batch!r}")
    fs, done = _place(spark, f"{path}/_batch={name}")
    if fs.exists(done):
        return False
    own = f".pending-{name}-{uuid.uuid4().hex}"
    _, mine = _place(spark, f"{path}/{own}")
    rows.write.partitionBy(*by).parquet(mine.toString())
    _, inside = _place(spark, f"{path}/_batch={name}/{own}")
    if not fs.rename(mine, done):
        fs.delete(mine, True)
        return False
    if fs.exists(inside):
        # another writer was first, so ours was moved into its folder, where its hidden name keeps it from readers
        fs.delete(inside, True)
        return False
    return True


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All published rows of a table that ``put`` adds to; no rows if there is none. What is pending has a hidden name."""
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", _batch string").parquet(path).drop("_batch")


def clear_pending(spark: SparkSession, path: str, older_than_s: int = 86_400) -> int:
    """Deletes what killed writers left: pending folders that have not changed for so long. Returns how many."""
    fs, p = _place(spark, path)
    limit = (time.time() - older_than_s) * 1000
    left = [s for s in fs.listStatus(p) if s.getPath().getName().startswith(".pending-") and s.getModificationTime() < limit] if fs.exists(p) else []
    for s in left:
        fs.delete(s.getPath(), True)
    return len(left)

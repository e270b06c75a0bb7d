"""Shared folder, written tables, components and text buffers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset (tests), a folder of this machine serves,
    and only if the master is local.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tallyforge-{os.getuid()}")
    return found.rstrip("/")


# Tables of this application in the shared folder, by path, with what deletes them.
_tables: dict[str, Callable[[], None]] = {}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads neither recompute it nor need its executors. ``options`` are the writer's.

    It stays until ``discard``, or the end of the driver's process: results are lazy and may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    _tables[path] = lambda: place.getFileSystem(conf).delete(place, True)
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Deletes tables that ``written`` made (other data frames are left alone); nothing may read them any more."""
    for t in tables:
        if delete := _tables.pop(t if isinstance(t, str) else getattr(t, "_table_path", ""), None):
            delete()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it wrote on its way are deleted."""
    before = set(_tables)
    out = written(make(), name)
    discard(*(set(_tables) - before - {out._table_path}))
    return out


@atexit.register
def _discard_all() -> None:
    try:
        discard(*list(_tables))
    except Exception:  # the JVM may be gone already; what is left then belongs to a folder of its own
        _tables.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# A vertex with so many edges is a hub: its edges are dealt out to SPREAD tasks in a join.
HUB, SPREAD = 1000, 32
# Up to so many hubs are broadcast; beyond, edges are joined without them.
MOST_HUBS = 1_000_000
# Of a graph of up to so many edges the smallest neighbours, a row of two ids a vertex, are broadcast; no edge moves to meet them.
MOST_LOW = 1 << 19


def _met(edges: DataFrame, key: str, low: DataFrame, most: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the number that ``low`` (id, m) has for their ``key``, or null.

    ``low`` is broadcast if there are at most MOST_LOW edges. Else it is joined by a shuffle. Hubs, of which ``most`` edges can have ``most`` / HUB at most, are found by a sum that is combined before it is
    shuffled; each edge of a hub goes to one of SPREAD tasks, and the hub's row of ``low`` to all of these.
    """
    if most <= MOST_LOW:
        return edges.join(F.broadcast(low.withColumnRenamed("id", key)), key, "left").select("u", "v", "m")
    if most // HUB > MOST_HUBS:
        return edges.join(low.withColumnRenamed("id", key), key, "left")
    hubs = F.broadcast(edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= HUB).select(F.col(key).alias("hub")))
    other = F.col("v" if key == "u" else "u")
    e = edges.join(hubs, F.col(key) == F.col("hub"), "left").withColumn("salt", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.hash(other), F.lit(SPREAD)))).drop("hub")
    copies = F.when(F.col("hub").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    low = low.join(hubs, F.col("id") == F.col("hub"), "left").select(F.col("id").alias(key), "m", F.explode(copies).alias("salt"))
    return e.join(low, [key, "salt"], "left").select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every vertex of an undirected graph: (id, component_id).

    ``edges`` has two id columns, ``a`` and ``b``; rows with nulls are no edges. Large-star and small-star steps alternate
    until no edge changes; every step is a grouped minimum and a join: with a broadcast in a graph of at most MOST_LOW edges, so that
    a round has three shuffles, else one in which hubs are dealt out. Each round is written to
    the shared folder. An empty graph gives no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    spark = edges.sparkSession
    before = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    if not before[0]:
        return spark.createDataFrame([], "id bigint, component_id bigint")
    for _ in range(max_rounds):
        # large star: larger neighbours of a vertex hang on its smallest neighbour; without a smaller one, on it
        low = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
        large = _met(e, "v", low, before[0]).select("u", F.coalesce("m", "v").alias("v"))
        # equal edges do no harm but in the joins that deal them out
        large = large.distinct() if before[0] > MOST_LOW else large
        # small star: each vertex hangs its smaller neighbours and itself on the smallest of them
        low = large.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
        small = (
            _met(large, "u", low, before[0])
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        previous, e = e, written(small, "edges")
        discard(previous)
        # a star forest that no longer changes: its edges' count and checksum stay
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return leaves.union(leaves.select(F.col("component_id").alias("id"), "component_id").distinct())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without a copy; nulls have no bytes."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(1, np.int64), data[:0]
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that work arrays stay small; a longer text comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        if not batch.num_rows:
            continue
        offsets, _ = utf8(column)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end

"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in an Arrow batch; a longer row makes a batch of its own.
BATCH_BYTES = 8 << 20
#: A key with over 1 / HOT_SHARE of a table's rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000
#: Whether Spark deletes a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a new folder if the session runs on this machine alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ladle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python tasks by bytes: rows with long texts or packed blocks come a few at a time.

    Results are lazy, so the session keeps the option; a bound that it has already, if smaller, stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, None)
    if not given or not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system: Spark lets a Python worker live from task to task, and
    what it has kept of one stage adds to the next one's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ladle/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. It cuts lineage, and outlives a lost executor.

    The table stays until ``discard``, or until the application clears the folder: results are lazy and may need it.
    What the write has shuffled is deleted as soon as it ends: nothing else reads it."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once all that was made of them has been written itself."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, where: Column | None = None, split_from: int = 0) -> DataFrame:
    """Inner join of rows with keyed, which has a row per key and in ``count`` its number of rows, of ``total`` in all.

    Keys with over 1 / HOT_SHARE of all rows, fewer than HOT_SHARE by that, are broadcast, so that their rows
    stay where they are; the others' rows are shuffled. where: a condition on the joined rows. split_from: fewer rows
    than that are joined plainly, as one task may have them all."""
    hot = F.col(count) > max(1, total // HOT_SHARE)
    names = [c for c in keyed.columns if c not in keys and c != count]
    if total < split_from or hasattr(keyed, "written_to") and keyed.where(hot).isEmpty():
        out = rows.join(keyed.drop(count).hint("merge"), keys).select(*rows.columns, *names)
        return out if where is None else out.where(where)
    few = F.broadcast(keyed.where(hot).select(*keys, *names, F.lit(True).alias("is_hot")))
    met = rows.join(few, keys, "left")
    first = met.where("is_hot").drop("is_hot")
    rest = met.where("is_hot is null").select(*rows.columns).join(keyed.where(~hot).drop(count).hint("merge"), keys)
    out = first.select(*rows.columns, *names).union(rest.select(*rows.columns, *names))
    return out if where is None else out.where(where)


def left_join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of rows with keyed, a written table with a row per key and in ``count`` its number of rows, of ``total`` in all; its other columns are added.

    Rows of a key with over 1 / HOT_SHARE of all rows, and rows without a key, stay where they are; the others' are shuffled."""
    names = [c for c in keyed.columns if c not in (key, count)]
    hot = F.col(count) > max(1, total // HOT_SHARE)
    few = F.broadcast(keyed.where(hot).select(key, *names, F.lit(True).alias("is_hot")))
    met = rows.join(few, key, "left")
    here = F.coalesce(F.col("is_hot"), F.col(key).isNull())
    there = met.where(~here).select(*rows.columns).join(keyed.where(~hot).select(key, *names).hint("merge"), key, "left")
    return met.where(here).select(*rows.columns, *names).union(there.select(*rows.columns, *names))

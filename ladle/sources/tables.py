"""Reading and writing tables: typed and raw CSV, JSON, Parquet, and snapshots by date."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladle.sources.schemas import DATE_FORMAT, TIMESTAMP_FORMAT, as_strings, schema

FORMATS = {"dateFormat": DATE_FORMAT, "timestampFormat": TIMESTAMP_FORMAT, "timestampNTZFormat": TIMESTAMP_FORMAT}


def read_csv(spark: SparkSession, path: str, typed: StructType) -> DataFrame:
    """A CSV file or folder with a header; what doesn't parse as its type is null."""
    return spark.read.schema(typed).options(header=True, mode="PERMISSIVE", **FORMATS).csv(path)


def read_raw_csv(spark: SparkSession, path: str, typed: StructType) -> DataFrame:
    """The same columns as strings, as they stand in the file."""
    return spark.read.schema(as_strings(typed)).options(header=True).csv(path)


def read_table(spark: SparkSession, name: str, directory: str, raw: bool = False) -> DataFrame:
    """One of the thirteen source tables: directory/name.csv, a file or a folder."""
    return (read_raw_csv if raw else read_csv)(spark, f"{directory}/{name}.csv", schema(name))


def inferred_schema(spark: SparkSession, path: str, typed: StructType) -> DataFrame:
    """(column, declared, inferred, same) for each declared column; the types Spark infers from the file."""
    found = {f.name: f.dataType.simpleString() for f in spark.read.options(header=True, inferSchema=True, **FORMATS).csv(path).schema.fields}
    rows = [(f.name, f.dataType.simpleString(), found.get(f.name), found.get(f.name) == f.dataType.simpleString()) for f in typed.fields]
    return spark.createDataFrame(rows, "column string, declared string, inferred string, same boolean")


def write_csv(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """A folder of CSV files, in formats that read_csv reads back."""
    df.write.mode("overwrite").options(header=True, **FORMATS).partitionBy(*partition_by).csv(path)


def rewritten_csv(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """Writes df, reads the folder back and compares: one row (n_written, n_read, same)."""
    write_csv(df, path, partition_by)
    again = df.sparkSession.read.schema(df.schema).options(header=True, **FORMATS).csv(path)
    counts = df.agg(F.count("*").alias("n_written")).join(again.agg(F.count("*").alias("n_read")))
    return counts.withColumn("same", F.col("n_written") == F.col("n_read"))


def write_quarantine(quarantined: DataFrame, path: str) -> bool:
    """Writes rows with their reason, without helper columns (those that begin with _). Nothing is written if there are none."""
    if quarantined.isEmpty():
        return False
    quarantined.drop(*[c for c in quarantined.columns if c.startswith("_")]).write.mode("overwrite").parquet(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def with_parent_date(child: DataFrame, parent: DataFrame, key: str, day: str) -> DataFrame:
    """Adds the parent's date to its children; orphans get a null."""
    return child.join(parent.select(key, day), key, "left")


def write_by_month(df: DataFrame, path: str, day: str, year_col: str = "year", month_col: str = "month") -> None:
    """Parquet, partitioned by year and month of a date column. Rows of a month are gathered into as many files as their size asks for."""
    dated = df.withColumns({year_col: F.year(day), month_col: F.month(day)})
    dated.hint("rebalance", F.col(year_col), F.col(month_col)).write.mode("overwrite").partitionBy(year_col, month_col).parquet(path)


def write_snapshot(df: DataFrame, path: str, as_of: date) -> None:
    """Replaces the partition as_of_date=as_of of a table, and leaves the others."""
    df.withColumn("as_of_date", F.lit(as_of.isoformat())).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(path)


def snapshot_dates(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots a table has; reads folder names only."""
    return spark.read.parquet(path).select(F.col("as_of_date").cast("date").alias("as_of_date")).distinct()


def latest_snapshot(spark: SparkSession, *paths: str, before: date | None = None) -> date | None:
    """The last date of which every table has a snapshot; with before, the last one strictly before it."""
    common = snapshot_dates(spark, paths[0])
    for path in paths[1:]:
        common = common.intersect(snapshot_dates(spark, path))
    if before:
        common = common.where(F.col("as_of_date") < F.lit(before))
    return common.agg(F.max("as_of_date")).first()[0]


def read_snapshot(spark: SparkSession, path: str, as_of: date | None = None) -> DataFrame:
    """One snapshot of a table, the latest by default; only its partition is read."""
    as_of = as_of or latest_snapshot(spark, path)
    return spark.read.parquet(path).where(F.col("as_of_date").cast("date") == F.lit(as_of))


def rewrite(df: DataFrame, path: str, version: str) -> DataFrame:
    """Writes a changed table beside the one it was read from, as path/version, and reads that."""
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    return df.sparkSession.read.parquet(f"{path}/{version}")


def register(tables: dict[str, DataFrame]) -> None:
    """Makes each DataFrame a view for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. Where none is set: a new one if the session runs on this machine alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ladle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder that nothing else uses."""
    return f"{checkpoint_dir(spark)}/ladle/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new folder in the checkpoint folder and reads that: what it was made of is not made again, nor held any longer.

    What the write has shuffled is deleted as soon as it ends: nothing else reads it."""
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.written_to = path
    return again


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)

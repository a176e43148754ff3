"""Readers and writers of metric logs, the run registry and checkpoint listings; every schema is explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from granary.operators.metrics import REGISTRY, new_registry_rows

METRICS = "tag string, step long, wall_time double, value double"
#: Steps of a run that lie in one file, so far as tasks allow.
STEPS_PER_FILE = 1 << 22


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """run, tag, step, wall_time, value of CSV files: one a run and named after it, or as `write_metrics` leaves them.

    Filters on run reach the folders of the second form. A run without a name comes back null, an empty folder has no rows.
    """
    folder, store = _hadoop_path(spark, path)
    by_folder = bool(store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "run=*")))
    rows = spark.read.schema(f"run string, {METRICS}" if by_folder else METRICS).option("header", True).option("escape", '"').csv(path)
    name = F.col("run") if by_folder else F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.csv$", 1)
    return rows.select(name.alias("run"), "tag", "step", "wall_time", "value")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Writes run, tag, step, wall_time and value, a folder a run; other columns are left out.

    Rows are dealt by run and slices of its steps, so a long run is many tasks' work, and a short one lies in one file.
    """
    columns = metrics.select("run", "tag", "step", "wall_time", "value")
    dealt = columns.repartition("run", F.floor(F.col("step") / STEPS_PER_FILE))
    _exact_csv(dealt.write.partitionBy("run").mode("errorifexists")).csv(path)


def _exact_csv(writer: DataFrameWriter) -> DataFrameWriter:
    """CSV with a header that keeps white space at both ends of a value and quotes inside."""
    return writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).option("header", True).option("multiLine", True).option("enforceSchema", False).option("escape", '"').csv(path)


def append_registry(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Adds the rows that aren't there yet, their columns in the registry's order, and says how many."""
    folder, store = _hadoop_path(spark, path)
    exists = store.exists(folder)
    rows = rows.select(*spark.createDataFrame([], REGISTRY).columns)
    new = new_registry_rows(read_registry(spark, path) if exists else spark.createDataFrame([], REGISTRY), rows).cache()
    n = new.count()
    if n:
        _exact_csv(new.write.mode("append")).csv(path)
    new.unpersist()
    return n


def list_checkpoints(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, mtime_ns, bytes of the files in a folder, with `recursive` also of those below, sorted by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "modificationTime", "length")
    return files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("bytes")).orderBy("path")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from ..ship import ship

#: Word separators of every word-based contract: U+0020 and U+0009..U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


#: Rows and bytes of an Arrow batch where the session has Spark's defaults: ten thousand texts are tens of MB, held
#: by the JVM and by Python at once for each core, and a freed buffer of that size stays with the process.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", str(4 << 20))}


def ready(spark: SparkSession) -> None:
    """Send the package to the Python workers, and bound what they are sent at once."""
    ship(spark)
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, default).rstrip("b") == default:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the driver, by Arrow: rows as such would start further Python workers."""
    kinds = to_arrow_schema(DataType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds.types)] if rows else [pa.array([], t) for t in kinds.types], schema=kinds))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a local session gets a temporary folder and a cluster
    a folder in the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing that was written. Folders go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before, or this folder be gone
            continue


def parallelism(spark: SparkSession) -> int:
    """The partition count that the session plans shuffles with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside a row expression."""
    return F.transform(F.array(value), body)[0]


def ranked(df: DataFrame, group: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """Add ``rank``: each row's place (from 0) among the rows of its ``group``.

    No task ever gets a whole group, so a group may hold any share of the rows. Rows go to a
    ``bucket`` (by default one of 1024 by a hash of ``order``), are numbered within (bucket, group),
    and get the count of the same group's rows in lower buckets added. The order within a group is (bucket, order): the
    same in every run, and free otherwise. Rows equal in ``order`` may take each other's place.
    ``df`` is read twice, so it should be a table.
    """
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int") if bucket is None else bucket)
    within = spread.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket", group).orderBy(*order)) - 1)
    lower = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_bucket", group).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_bucket", group, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"))
    return within.join(base, ["_bucket", group]).withColumn("rank", F.col("_base") + F.col("_local")).drop("_bucket", "_local", "_base")

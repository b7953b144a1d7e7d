"""Session, checkpoint and prefix-sum helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_local_folder: str | None = None


def build_session(cpus: str = "8", app: str = "textmill", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares.

    The folder is read from ``spark.checkpoint.dir``; only where that is unset and Spark runs on
    one machine a temporary folder is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; for large frames.

    Unlike a checkpoint, whose plan keeps the estimates of the plan it replaced, the table is read
    back with its true size, so no join behind it is broadcast by a wrong guess; it is compressed
    as well. Lost executors lose nothing of it.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see; a cluster must name it, one machine may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="textmill-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sum(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Exclusive running sum of ``value`` per ``group`` without one task per group.

    ``bucket`` must be an integer that never decreases along ``order``, and should split a
    group into many buckets. Each (group, bucket) is summed on its own; a window over the
    short table of bucket totals gives every bucket its start, so a group that holds a third
    of all rows is still spread over its buckets.
    """
    keyed = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = keyed.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("double"))).drop("_t")
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.alias("k").join(
        starts.alias("s"),
        (F.col("k._b") == F.col("s._b")) & _null_safe(group),
        "inner",
    ).select("k.*", "_start")
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0).cast("double"))).drop("_b", "_v", "_start")


def _null_safe(group: list[str]) -> Column:
    cond = F.lit(True)
    for name in group:
        cond = cond & F.col(f"k.{name}").eqNullSafe(F.col(f"s.{name}"))
    return cond

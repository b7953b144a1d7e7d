"""Resumable annotation as a stream of files: each row is scored once, whatever is replayed."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.parse import annotation
from textmill.operators.models import score_batches, stub_scorer
from textmill.operators.sampling import not_done


def annotate(rows: DataFrame, scorer=stub_scorer, workers: int | None = None, pause: float = 0.0) -> DataFrame:
    """``id, probabilities, hard_label, confidence, thinking_preview``; rows whose reply cannot be read are left out.

    ``workers`` tasks call the scorer and wait ``pause`` seconds after each call.
    """
    replies = score_batches(rows, scorer, workers=workers, pause=pause)
    return replies.select("id", annotation(F.col("output")).alias("a")).where("a IS NOT NULL").select("id", "a.*")


def calls_a_second(workers: int, pause: float) -> float:
    """Most calls a second of all workers together."""
    return workers / pause


def run_annotation(spark: SparkSession, source: str, schema: T.StructType | str, out: str, checkpoint: str, scorer=stub_scorer, workers: int | None = None, pause: float = 0.0) -> int:
    """Annotate all rows of ``source`` that ``out`` lacks, in micro-batches; returns the rows of ``out``.

    Ids that the stream has met are kept as keyed state in ``checkpoint`` and cost a batch no more
    than its own rows. Only a run with a new checkpoint leaves out what earlier runs have stored,
    by an anti-join. Each batch is written under its run's and its own number, so a batch that is
    replayed after a failure overwrites itself.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source).select("id", "text").dropDuplicates(["id"])
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    earlier = _stored(spark, out).where(F.col("run") != run)
    resumed = not earlier.isEmpty()

    def write(batch: DataFrame, number: int) -> None:
        fresh = not_done(batch, _stored(batch.sparkSession, out).where(F.col("run") != run)) if resumed else batch
        annotate(fresh, scorer, workers, pause).write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _stored(spark, out).count()


STORED = "id string, probabilities array<double>, hard_label int, confidence double, thinking_preview string, run string, batch int"


def _stored(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(out)
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], STORED)


def append_lines(stream: DataFrame, path: str, checkpoint: str):
    """The rows of a stream as JSON lines, appended as they come; each is written once."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running count per key, for update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def first_of_each(stream: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """Each key once, with state kept for ``late``."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])

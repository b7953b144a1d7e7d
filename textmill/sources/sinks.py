"""Sinks: JSON lines, CSV, split folders and chart-ready frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.probs import default_soft


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON arrays, one in each part file, with signs outside ASCII as they are; no row passes the driver.

    A part is read back as a whole by ``readers.read_json`` (``multiLine``).
    """

    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([f"{before if i == 0 else ','}{line}" for i, line in enumerate(lines)])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")).mapInArrow(bracket, "value string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def baseline_rows(df: DataFrame) -> DataFrame:
    """``id, text, label`` with the defaults '', '' and 1."""
    return df.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("label", F.lit(1)).alias("label"))


def soft_label_rows(df: DataFrame) -> DataFrame:
    """Rows of the soft-label file; missing values get the defaults."""
    return df.select(
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), default_soft(F.col("soft_labels")).alias("probabilities"),
        F.coalesce("hard_label", F.lit(1)).alias("hard_label"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit("train").alias("split"),
    )


def fan_out(df: DataFrame) -> DataFrame:
    """Rows with a split of train, val or test; any other goes to train."""
    return df.withColumn("split", F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("train"))


def write_splits(df: DataFrame, path: str) -> None:
    fan_out(df).write.mode("overwrite").partitionBy("split").json(path)

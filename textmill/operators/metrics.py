"""Classification, calibration and latency metrics as grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.runtime import checkpoint

CLASSES = (0, 1, 2)


def _grid(df: DataFrame) -> DataFrame:
    """The 3 x 3 cells, so that empty ones are reported."""
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in CLASSES for p in CLASSES))).alias("c")
    return df.sparkSession.range(1).select(cells).select("c.t", "c.p")


def positional_join(truth: DataFrame, predicted: DataFrame, order: list[str]) -> DataFrame:
    """Rows paired by their place in either input; the longer one is cut to the shorter.

    Places come from range partitions: rows are counted per partition and numbered inside it,
    so no task sorts a whole input.
    """
    return _numbered(truth, order).join(_numbered(predicted, order), "place")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    # stored, as a second run of the range exchange may draw other bounds
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + inner).drop("_part", "_before")


def confusion(df: DataFrame, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``t, p, n`` for all nine cells; pairs out of range are left out."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    return _grid(df).join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, truth: str = "label", predicted: str = "pred", digits: int | None = 4) -> DataFrame:
    """``class, precision, recall, f1, support``; a division by zero gives 0."""
    cells = confusion(df, truth, predicted)
    rows = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("guessed"))
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = share(F.col("hit"), F.col("guessed")), share(F.col("hit"), F.col("support"))
    return rows.join(cols, "class").select(
        "class", shown(p).alias("precision"), shown(r).alias("recall"), shown(share(2 * p * r, p + r)).alias("f1"), "support"
    )


def summary(df: DataFrame, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``accuracy, f1_macro, total_samples``; macro F1 is the mean of the rounded class scores, rounded again.

    Predictions out of range stay in the accuracy's denominator.
    """
    macro = class_metrics(df, truth, predicted).agg(F.round(F.sum("f1") / len(CLASSES), 4).alias("f1_macro"))
    hit = (F.col(truth) == F.col(predicted)) & F.col(truth).isin(*CLASSES)
    overall = df.agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), 4).alias("accuracy"), F.count("*").alias("total_samples"))
    return overall.join(macro).select("accuracy", "f1_macro", "total_samples")


def unrounded_scores(df: DataFrame, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``macro_f1, weighted_f1`` from unrounded class scores, to six digits."""
    rows = class_metrics(df, truth, predicted, None)
    return rows.agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias("weighted_f1")
    )


def parsed_accuracy(df: DataFrame, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``total, parse_errors, valid, correct, accuracy_pct``: accuracy over parsed rows only."""
    good = F.col(predicted) != -1
    return df.agg(
        F.count("*").alias("total"), F.count_if(~good).alias("parse_errors"), F.count_if(good).alias("valid"),
        F.count_if(good & (F.col(predicted) == F.col(truth))).alias("correct"),
    ).withColumn("accuracy_pct", F.round(F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("valid")), F.lit(0.0)), 4))


def normalized_confusion(df: DataFrame, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """Cells with their share of the true class; an empty class is divided by 1."""
    cells = confusion(df, truth, predicted)
    whole = F.greatest(F.sum("n").over(Window.partitionBy("t")), F.lit(1))
    return cells.withColumn("share", F.round(F.col("n") / whole, 6))


def calibration_error(df: DataFrame, conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, closed on the left, the last on both sides.

    The bounds are multiples of the bin's width in doubles, so 0.3 lies below the third of ten
    (0.30000000000000004). Confidences outside 0..1 are in no bin but count in the whole.
    """
    rows = df.select(conf.alias("c"), correct.cast("int").alias("k")).where("c IS NOT NULL AND k IS NOT NULL")
    number = reduce(lambda a, i: a + (F.col("c") >= F.lit(i * (1.0 / bins))).cast("int"), range(1, bins), F.lit(0))
    inside = F.col("c").between(0, 1)
    per = rows.groupBy(F.when(inside, number).alias("b")).agg(F.count("*").alias("n"), F.avg("k").alias("acc"), F.avg("c").alias("conf"))
    gap = F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per.agg(F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def confidence_gap(df: DataFrame, conf: Column, correct: Column) -> DataFrame:
    got = df.agg(F.avg(conf).alias("c"), F.avg(correct.cast("int")).alias("a"))
    return got.select(
        F.round("c", 6).alias("avg_confidence"), F.round("a", 6).alias("accuracy"),
        F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"), F.round(F.col("c") - F.col("a"), 6).alias("signed_gap"),
    )


def uncertainty_buckets(df: DataFrame, conf: Column, correct: Column) -> DataFrame:
    """``bucket, n, accuracy`` for high (> .9), medium (.7 to .9) and low confidence; empty ones are absent."""
    bucket = F.when(conf > 0.9, "high").when(conf >= 0.7, "medium").otherwise("low")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(correct.cast("int")), 6).alias("accuracy"))


def latency(df: DataFrame, value: Column, groups: list[str], batch_size: int = 1) -> DataFrame:
    """Count, sum, mean, population deviation, range, exact percentiles and throughput of latencies in ms."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total_ms"), F.round(F.avg(value), 6).alias("mean_ms"),
        F.round(F.stddev_pop(value), 6).alias("std_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms"),
        F.round(F.avg(value) / batch_size, 6).alias("per_sample_ms"),
        F.round(F.try_divide(F.lit(1000.0 * batch_size), F.avg(value)), 4).alias("per_second"),
    )


def epoch_means(df: DataFrame, epoch: Column, **values: Column) -> DataFrame:
    """``epoch, n`` and the mean of each named value, with the range of the one named ``temp``."""
    parts = [F.round(F.avg(v), 6).alias(f"avg_{name}") for name, v in values.items()]
    if "temp" in values:
        parts += [F.min(values["temp"]).alias("min_temp"), F.max(values["temp"]).alias("max_temp")]
    return df.groupBy(epoch.alias("epoch")).agg(F.count("*").alias("n"), *parts)


def full_batches(df: DataFrame, place: Column, size: int, value: Column, group: str) -> DataFrame:
    """Sum of ``value`` per full batch of ``size`` rows by place; the rest at the end is dropped."""
    rows = df.withColumn("batch", F.floor((place - 1) / size)).groupBy(group, "batch").agg(F.count("*").alias("k"), F.round(F.sum(value), 4).alias("batch_ms"))
    return rows.where(F.col("k") == size).select(group, "batch", "batch_ms")


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """Score of two models by class and their rounded difference."""
    a = base.select("class", F.col("f1").alias("base_f1"))
    return other.select("class", F.col("f1").alias("other_f1")).join(a, "class").withColumn("delta", F.round(F.col("other_f1") - F.col("base_f1"), 4))


def relative_gain(a: Column, b: Column) -> Column:
    """(b - a) / a in per cent; null for a = 0."""
    return F.try_divide((b - a) * 100.0, a)

"""Report frames, ready for charts or rendering, and their text forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators import metrics, quality


def f1_grid(routes: dict[str, DataFrame]) -> DataFrame:
    """``metric`` rows (each class and macro) by route; the routes are few and named by the caller."""
    parts = []
    for name, df in routes.items():
        rows = metrics.class_metrics(df).select(F.lit(name).alias("route"), F.concat(F.lit("class_"), F.col("class").cast("string")).alias("metric"), F.col("f1").alias("value"))
        macro = metrics.summary(df).select(F.lit(name).alias("route"), F.lit("macro").alias("metric"), F.col("f1_macro").alias("value"))
        parts += [rows, macro]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("metric").pivot("route", list(routes)).agg(F.first("value"))


def label_share(df: DataFrame, label: Column, group: Column) -> DataFrame:
    """``route, label, n, share`` of labels within each route."""
    n = df.groupBy(group.alias("route"), label.alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("route")), 6))


def target_check(summary: DataFrame, baseline: float = 0.8650, target: float = 0.875) -> DataFrame:
    """Accuracy beside a baseline and a target."""
    a = F.col("accuracy")
    return summary.select("accuracy", F.round(a - baseline, 4).alias("over_baseline"), (a >= target).alias("target_met"))


def success_rate(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.round(F.coalesce(F.try_divide(F.count_if(ok) * 100.0, F.count("*")), F.lit(0.0)), 4).alias("pct"))


def quality_bundle(df: DataFrame) -> DataFrame:
    """All one-row quality reports of training rows as columns of structs."""
    parts = {"agreement": quality.rating_agreement(df), "soft": quality.soft_mismatch(df), "confidence": quality.confidence_stats(df), "cot": quality.cot_coverage(df), "fields": quality.data_quality(df)}
    out = None
    for name, part in parts.items():
        one = part.select(F.struct(*part.columns).alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out


def lookup(value: Column, table: dict, default) -> Column:
    """Dictionary lookup with a default, for tables short enough to stand in the plan."""
    out = F.lit(default)
    for key, found in table.items():
        out = F.when(value == key, found).otherwise(out)
    return out


#: Rows of a report that is rendered as text; a longer frame is no report.
MOST_ROWS = 1000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows: write it with a sink")
    return rows


def markdown(df: DataFrame) -> str:
    """A report frame of at most ``MOST_ROWS`` rows as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in _rows(df))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def comparison(routes: dict[str, DataFrame], seconds: dict[str, float], milliseconds: dict[str, float]) -> DataFrame:
    """``route, accuracy, f1_macro, train_seconds, ms_per_sample`` of a few named routes, the most accurate first."""
    parts = [
        metrics.summary(df).select(F.lit(name).alias("route"), "accuracy", "f1_macro", F.lit(seconds.get(name)).cast("double").alias("train_seconds"), F.lit(milliseconds.get(name)).cast("double").alias("ms_per_sample"))
        for name, df in routes.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.desc("accuracy"), "route")


def learning_curve(df: DataFrame, stage: str, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``stage, n, accuracy, gain`` in the order of the stages; ``gain`` is against the stage before."""
    per = df.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(predicted)).cast("int")), 6).alias("accuracy"))
    before = F.lag("accuracy").over(Window.orderBy("stage"))  # a row per stage
    return per.withColumn("gain", F.round(F.col("accuracy") - before, 6)).orderBy("stage")


def metrics_text(summary: DataFrame, per_class: DataFrame) -> str:
    top = summary.head().asDict()
    lines = [f"accuracy {top['accuracy']:.4f}  macro F1 {top['f1_macro']:.4f}  rows {top['total_samples']}"]
    lines += [f"class {r['class']}: P {r['precision']:.4f} R {r['recall']:.4f} F1 {r['f1']:.4f} n {r['support']}" for r in per_class.orderBy("class").collect()]
    return "\n".join(lines)


def from_stored(path_text: str) -> dict:
    """A stored result object; unreadable text gives an empty one."""
    try:
        return json.loads(path_text)
    except ValueError:
        return {}

"""Quality reports over training rows: distributions, agreement, histograms, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions.probs import argmax, confidence, default_soft
from textmill.functions.records import expected_label

#: Words that name a rating inside a reasoning. The first branch asks for a literal backslash, as in the checked producer.
RATING_WORDS = r"(?iu)(\\d星|星级|rating|给了|给.*分|star)"
RATING_WORDS_FIXED = r"(?iu)(\d\s*星|星级|\brating\b|给了|给.*分|\bstars?\b|звёзд|звезд|балл)"


def label_of(df: DataFrame) -> Column:
    names = [c for c in ("label", "hard_label") if c in df.columns]
    return F.coalesce(*map(F.col, names), F.lit(1))


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Count and per cent of each value."""
    n = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def rating_agreement(df: DataFrame) -> DataFrame:
    """Per cent of rows whose label is the one their rating suggests (label 1, rating 3 where missing)."""
    same = F.coalesce("label", F.lit(1)) == expected_label(F.coalesce("rating", F.lit(3)))
    return df.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")) * 100, 4).alias("consistent_pct"))


def balance_gap(df: DataFrame, target: int = 3000) -> DataFrame:
    """Rows each class lacks to ``target``; classes without rows included."""
    classes = df.sparkSession.range(3).select(F.col("id").cast("int").alias("label"))
    n = df.groupBy(label_of(df).alias("label")).agg(F.count("*").alias("n"))
    return classes.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(target) - F.coalesce("n", F.lit(0))).alias("gap"))


def soft_mismatch(df: DataFrame, soft: str = "soft_labels") -> DataFrame:
    """Rows whose soft label's largest class is not the hard label; both defaults apply where missing."""
    top = F.coalesce(argmax(default_soft(F.col(soft))), F.lit(2))
    bad = top != label_of(df)
    return df.agg(
        F.count("*").alias("n"), F.count_if(bad).alias("mismatches"), F.round(F.avg(bad.cast("int")) * 100, 4).alias("mismatch_pct"),
        F.round(100 - F.avg(bad.cast("int")) * 100, 4).alias("alignment_pct"),
    )


def confidence_stats(df: DataFrame, soft: str = "soft_labels") -> DataFrame:
    c = confidence(F.col(soft))
    return df.agg(
        F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.round(F.min(c), 6).alias("min"), F.round(F.max(c), 6).alias("max"),
        F.count_if(c < 0.6).alias("low"), F.round(F.count_if(c < 0.6) * 100.0 / F.count("*"), 4).alias("low_pct"),
    )


def confidence_histogram(df: DataFrame, soft: str = "soft_labels") -> DataFrame:
    """Counts in [.5, .6) to [.9, 1); 1 itself and values below .5 fall in no bucket but count in the share."""
    c = confidence(F.col(soft))
    buckets = [(0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0)]
    one = df.agg(F.count("*").alias("all"), *(F.count_if((c >= lo) & (c < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(buckets)))
    rows = F.explode(F.array(*(F.struct(F.lit(f"{lo:.1f}-{hi:.1f}").alias("bucket"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(buckets)))).alias("r")
    return one.select(rows, "all").select("r.bucket", "r.n", F.round(F.coalesce(F.try_divide(F.col("r.n") * 100.0, F.col("all")), F.lit(0.0)), 4).alias("pct"))


def mismatch_samples(df: DataFrame, soft: str = "soft_labels", n: int = 5) -> DataFrame:
    """The first ``n`` rows by id whose soft label's largest class is not the hard label."""
    top = F.coalesce(argmax(default_soft(F.col(soft))), F.lit(2))
    rows = df.select("id", label_of(df).alias("label"), top.alias("soft_argmax"), F.col(soft).alias("soft")).where("label <> soft_argmax")
    return rows.orderBy("id", "label", "soft_argmax", "soft").limit(n)


def multi_sample_mean(df: DataFrame, key: str = "id", probabilities: str = "probabilities") -> DataFrame:
    """Mean vector of the readable samples of each key with its largest share and class, and their number."""
    rows = df.select(F.col(key).alias(key), F.col(probabilities).alias("p")).where((F.size("p") == 3) & F.forall("p", lambda x: x.isNotNull()))
    means = rows.groupBy(key).agg(F.array(*(F.avg(F.col("p")[i]) for i in range(3))).alias("probabilities"), F.count("*").alias("n_samples"))
    return means.select(key, "probabilities", F.array_max("probabilities").alias("confidence"), argmax(F.col("probabilities")).alias("hard_label"), "n_samples")


def overall_accuracy(df: DataFrame, truth: Column, **guesses: Column) -> DataFrame:
    """One row: rows, and for each named guess the hits and their share."""
    hit = lambda g: F.coalesce(g == truth, F.lit(False)).cast("int")
    parts = [c for name, g in guesses.items() for c in (F.sum(hit(g)).alias(f"{name}_hits"), F.round(F.avg(hit(g)), 6).alias(f"{name}_accuracy"))]
    return df.agg(F.count("*").alias("n"), *parts)


def quarantine(df: DataFrame, languages: tuple[str, ...] = ("zh", "en", "ru")) -> tuple[DataFrame, DataFrame]:
    """Records that can be processed, and those that cannot with the ``reason``; every row is in one of the two."""
    flat = F.regexp_replace(F.coalesce("original_text", F.lit("")), r"(?U)\s+", "")
    reason = (
        F.when(F.col("id").isNull(), "no id").when(flat == "", "no text").when(F.col("language").isNull() | ~F.col("language").isin(*languages), "language")
        .when(F.col("sentiment_label").isNotNull() & ~F.col("sentiment_label").isin(0, 1, 2), "label").when(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), "rating")
    )
    told = df.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def cot_coverage(df: DataFrame, pattern: str = RATING_WORDS) -> DataFrame:
    """Reasonings (first assistant turn and ``cot`` field count apart) and those that name the rating."""
    reply = F.try_element_at(F.filter("conversations", lambda m: m["role"] == "assistant"), F.lit(1))["content"] if "conversations" in df.columns else F.lit(None).cast("string")
    cot = F.col("cot") if "cot" in df.columns else F.lit(None).cast("string")
    one = lambda c: (F.length(F.coalesce(c, F.lit(""))) > 0).cast("int")
    named = lambda c: F.coalesce(c.rlike(pattern), F.lit(False)).cast("int")
    got = df.agg(F.count("*").alias("n"), F.sum(one(reply) + one(cot)).alias("with_cot"), F.sum(named(reply) + named(cot)).alias("rating_mentioned"))
    return got.withColumn("mentioned_pct", F.round(F.coalesce(F.try_divide(F.col("rating_mentioned") * 100.0, F.col("with_cot")), F.lit(0.0)), 4))


def crosstab(df: DataFrame) -> DataFrame:
    """``rating, label, n, row_pct``; ratings default to 3."""
    n = df.groupBy(F.coalesce("rating", F.lit(3)).alias("rating"), label_of(df).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("row_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("rating")), 4))


def data_quality(df: DataFrame) -> DataFrame:
    """One row of totals; empty texts and arrays count as missing."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"), F.count_if(F.col("label") == 2).alias("label_2"),
        F.count_if(F.length(F.coalesce("cot", F.lit(""))) == 0).alias("missing_cot"),
        F.count_if(F.coalesce(F.size("soft_labels"), F.lit(0)) <= 0).alias("missing_soft"), F.count_if(F.col("label").isNull()).alias("missing_label"),
        F.round(F.avg(F.length(F.coalesce("cot", F.lit("")))), 4).alias("avg_cot_length"),
    )


def confidence_bands(df: DataFrame, conf: Column) -> DataFrame:
    band = F.when(conf > 0.8, "high").when(conf >= 0.6, "medium").otherwise("low")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def split_distribution(df: DataFrame, split: Column, label: Column) -> DataFrame:
    """Counts per split and label with both totals in one pass; totals carry null keys."""
    rows = df.select(split.alias("split"), label.alias("label"))
    return rows.rollup("split", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def class_accuracy(df: DataFrame, truth: Column, *guesses: tuple[str, Column]) -> DataFrame:
    return df.groupBy(truth.alias("label")).agg(F.count("*").alias("n"), *(F.round(F.avg((g == truth).cast("int")), 6).alias(name) for name, g in guesses))

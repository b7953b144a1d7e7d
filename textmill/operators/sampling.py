"""Order-dependent selection made reproducible: head samples, splits, dedup, anti-joins, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """Order of a seeded shuffle: a hash of the row's key, the same on any cluster."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def head_per_class(df: DataFrame, label: str, order: list[Column], per_class: int) -> DataFrame:
    """First rows of each class. The window keeps ``per_class`` rows per task before the shuffle (group limit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("rn") <= per_class)


def small_batch(df: DataFrame, size: int, order: list[Column], label: str = "label") -> DataFrame:
    """``size`` rows spread over classes 0, 1, 2; the remainder goes to classes 0, then 1."""
    base, rest = divmod(size, 3)
    quota = F.when(F.col(label) == 0, base + (rest > 0)).when(F.col(label) == 1, base + (rest > 1)).when(F.col(label) == 2, base)
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    # the fixed bound lets each task drop what no class can keep before the shuffle
    return ranked.where(F.col("rn") <= base + 1).where(F.col("rn") <= quota)


def hash_rank(df: DataFrame, key: Column, group: Column, seed: int = 42) -> DataFrame:
    """Rows with ``_rn``, the rank in the seeded shuffle of their group, and ``_n``, the group's size.

    No task sorts a group: rows are counted per leading three signs of the hash (4096 values) and
    ranked inside those alone.
    """
    rows = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_g", group).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    by_group = Window.partitionBy("_g")
    before = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_g").alias("_g2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"), F.sum("_c").over(by_group).alias("_n"))
    joined = rows.join(starts, rows["_g"].eqNullSafe(starts["_g2"]) & (rows["_b"] == starts["_b2"]))
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h"))
    return joined.withColumn("_rn", F.col("_s") + place).drop("_h", "_g", "_b", "_g2", "_b2", "_s")


def stratified_split(df: DataFrame, label: str, key: Column, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with ``split``: each class is cut by exact rank at the shares."""
    ranked = hash_rank(df, key, F.col(label), seed)
    split = F.when(F.col("_rn") <= F.floor(F.col("_n") * train), "train").when(F.col("_rn") <= F.floor(F.col("_n") * (train + val)), "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rn", "_n")


def cut_split(df: DataFrame, key: Column, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with ``split`` by exact rank in a seeded global shuffle."""
    ranked = hash_rank(df, key, F.lit(0), seed)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= a + b, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rn", "_n")


def curriculum(df: DataFrame, key: Column, sizes: list[int], seed: int = 42) -> DataFrame:
    """Nested training sets: each row with the smallest stage that holds it; a top-n, so no full sort."""
    top = df.orderBy(shuffle_key(key, seed)).limit(max(sizes))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(shuffle_key(key, seed))))
    stage = reduce(lambda acc, n: F.when(F.col("rank") <= n, n).otherwise(acc), sorted(sizes, reverse=True), F.lit(None).cast("int"))
    return ranked.withColumn("stage", stage)


def unused_by_prefix(df: DataFrame, reference: DataFrame, text: str = "text", signs: int = 100) -> DataFrame:
    """Rows whose first signs start no text of the reference; null texts count as empty."""
    cut = lambda d: F.substring(F.coalesce(d[text], F.lit("")), 1, signs)
    keys = reference.select(cut(reference).alias("_k")).distinct()
    return df.withColumn("_k", cut(df)).join(keys, "_k", "left_anti").drop("_k")


def not_done(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among those done; null keys are never done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key in the given order; rows without a key are one group."""
    w = Window.partitionBy(F.coalesce(F.col(key), F.lit(""))).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_annotations(parts: list[tuple[str, DataFrame]], min_confidence: float = 0.65) -> DataFrame:
    """Annotation files in order, filtered by confidence, first row per id; the category is that of the file's name."""
    rows = []
    for i, (name, df) in enumerate(parts):
        category = F.coalesce(F.nullif(F.try_element_at(F.split(F.lit(name), "_"), F.lit(2)), F.lit("")), F.lit("unknown"))
        rows.append(df.withColumn("category", category).withColumn("file_no", F.lit(i)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return keep_first(every.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence), "id", [F.col("file_no"), F.col("id")])


def best_so_far(df: DataFrame, score: str, step: str, patience: int = 2, group: str | None = None) -> DataFrame:
    """Each step with whether it is a new best, and whether training stops there (``patience`` steps without one)."""
    base = Window.partitionBy(*([group] if group else [])).orderBy(step)
    before = F.max(score).over(base.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("is_best", F.coalesce(F.col(score) > before, F.lit(True)))
    recent = F.max(F.col("is_best").cast("int")).over(base.rowsBetween(-(patience - 1), 0))
    full = F.count("*").over(base.rowsBetween(-(patience - 1), 0)) == patience
    return marked.withColumn("stops", full & (recent == 0))

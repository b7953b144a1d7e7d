"""Problem 2: splits that keep every record of one product (or category) together.

Stored values are vertices, spelling variants are edges. Connected components come from
random-mate contraction: each round every vertex draws a coin from a hash, edges from tails to
heads pull the tail into its smallest head neighbour, the edges are relabelled by joins, and the
rounds end when no edge is left; the merges are then unwound to labels. Components are assigned
to splits by cumulative weight.

Results for special input: null, blank and placeholder values name no product, so such a record
is a component of its own (keyed by its id). Whole rows delivered twice count once. An empty
table gives empty results. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.runtime import checkpoint, prefix_sum

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))

#: Stored words that stand for "no value".
PLACEHOLDERS = ("na", "none", "null", "nil", "nan", "unknown", "undefined", "missing", "tbd", "unk", "und", "notavailable", "нет", "无", "未知")

#: Url and catalogue prefixes before a product code.
CODE_PREFIX = r"^(?:https?://\S*?/)?(?:dp/|gp/product/|asin[:= ]*|sku[:= ]*|product[:= ]*|item[:= ]*|id[:= ]*)+"


def product_key(value: Column) -> Column:
    """The ten-sign code that a stored product value names, or null.

    Width, case, blanks, quotes, dashes and known prefixes are spelling; a decimal ``.0`` and
    lost leading zeros come from number columns and are repaired.
    """
    flat = F.lower(F.trim(F.translate(value, _WIDE, _NARROW)))
    flat = F.regexp_replace(flat, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    flat = F.regexp_replace(flat, CODE_PREFIX, "")
    flat = F.regexp_replace(flat, r"^(\d+)\.0+$", "$1")
    bare = F.upper(F.regexp_replace(flat, r"[^\p{L}\p{N}]+", ""))
    padded = F.when(bare.rlike(r"^[0-9]{4,9}$"), F.lpad(bare, 10, "0")).otherwise(bare)
    return F.when(padded.rlike(r"^[A-Z0-9]{10}$"), padded)


def category_key(value: Column) -> Column:
    """Category name without case, blanks, underscores and other signs, or null."""
    bare = F.regexp_replace(F.lower(F.translate(value, _WIDE, _NARROW)), r"[^\p{L}\p{N}]+", "")
    return F.when((F.length(bare) > 0) & ~bare.isin(*PLACEHOLDERS), bare)


def connected_components(edges: DataFrame, max_rounds: int = 200, seed: int = 7) -> DataFrame:
    """``node, component`` for every vertex of ``edges(a string, b string)``; component is its smallest vertex.

    Work and shuffle of a round follow the edges left, which halve in expectation. Self-loops and
    repeated edges are dropped. A hub with a third of all edges is contracted by one
    partially aggregated group-by and by joins that adaptive execution may split.
    """
    norm = checkpoint(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    nodes = norm.select(F.col("a").alias("node")).union(norm.select("b")).distinct()
    live = norm.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    merges: list[DataFrame] = []
    for round_no in range(max_rounds):
        live = checkpoint(live)
        if live.isEmpty():
            break
        heads = lambda c: F.pmod(F.xxhash64(F.lit(seed + round_no), F.col(c)), F.lit(2)) == 1
        both = live.union(live.select("b", "a"))
        # coins are hashes and ``live`` is stored, so every later use recomputes the same merges
        pull = both.where(~heads("a") & heads("b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("into"))
        merges.append(pull)
        left = live.join(pull.select(F.col("node").alias("a"), F.col("into").alias("ia")), "a", "left").select(F.coalesce("ia", "a").alias("a"), "b")
        left = left.join(pull.select(F.col("node").alias("b"), F.col("into").alias("ib")), "b", "left").select("a", F.coalesce("ib", "b").alias("b"))
        live = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    if not merges:
        return nodes.select("node", F.col("node").alias("component"))
    # unwind: a vertex is merged once at most, so the merges are parent pointers no deeper than
    # the rounds; doubling the pointers reaches the roots in log2(rounds) joins
    labels = checkpoint(reduce(DataFrame.union, merges))
    for _ in range(len(merges).bit_length()):
        up = labels.select(F.col("node").alias("into"), F.col("into").alias("top"))
        labels = checkpoint(labels.join(up, "into", "left").select("node", F.coalesce("top", "into").alias("into")))
    labels = labels.select("node", F.col("into").alias("root"))
    rooted = nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(names, "root").select("node", "component")


def value_components(df: DataFrame, column: str, key: Column) -> DataFrame:
    """``value, component`` for every stored value of ``column`` that names something."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    keyed = values.withColumn("key", key).where("key IS NOT NULL")
    # a star per key around its smallest spelling; a key with one spelling is a self-loop
    centre = keyed.groupBy("key").agg(F.min("value").alias("b"))
    edges = keyed.join(centre, "key").select(F.col("value").alias("a"), "b")
    return connected_components(edges).select(F.col("node").alias("value"), "component")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("product_id")
    parts = checkpoint(value_components(df, "product_id", product_key(F.col("value"))))
    a, b = parts.alias("a"), parts.alias("b")
    return (
        a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.value") < F.col("b.value")))
        .select(F.col("a.value").alias("product_id_a"), F.col("b.value").alias("product_id_b"))
        .distinct()
    )


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored value that names a product, the smallest value of its class, and how many spellings the class has."""
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("product_id")
    parts = checkpoint(value_components(df, "product_id", product_key(F.col("value"))))
    sizes = parts.groupBy("component").agg(F.count("value").alias("spellings"))
    return parts.join(sizes, "component").select(F.col("value").alias("product_id"), F.col("component").alias("class_id"), "spellings")


def assign_splits(components: DataFrame, targets: DataFrame, big_share: float = 0.002) -> DataFrame:
    """``scheme, component, split`` for ``components(component, weight)`` and ``targets(scheme, split, share)``.

    Components above ``big_share`` of all weight (at most ``1 / big_share`` of them, 500 by
    default) are placed one by one, largest first, in the split that is furthest below its
    target; all others are laid end to end in hash order and cut at the remaining targets by
    cumulative weight, so no split misses its target by more than one small component unless a
    big one already exceeds it.
    """
    total = components.agg(F.sum("weight").alias("w")).head()["w"] or 0
    spec: dict[str, list[tuple[str, float]]] = {}
    for row in targets.select("scheme", "split", "share").distinct().where("share > 0 AND scheme IS NOT NULL AND split IS NOT NULL").orderBy("scheme", F.desc("share"), "split").collect():
        spec.setdefault(row["scheme"], []).append((row["split"], row["share"]))
    limit = total * big_share
    big = components.where(F.col("weight") > limit).orderBy(F.desc("weight"), "component").collect()
    small = components.where(F.col("weight") <= limit)
    placed, bounds = [], []
    for scheme, shares in spec.items():
        whole = sum(s for _, s in shares)
        room = {split: total * share / whole for split, share in shares}
        for row in big:
            split = max(room, key=lambda s: (room[s], s))
            room[split] -= row["weight"]
            placed.append((scheme, row["component"], split))
        rest = sum(max(r, 0) for r in room.values()) or 1.0
        at = 0.0
        for split, r in room.items():
            bounds.append((scheme, split, at, at + max(r, 0) / rest))
            at += max(r, 0) / rest
    spark = components.sparkSession
    fixed = spark.createDataFrame(placed, "scheme string, component string, split string")
    cuts = spark.createDataFrame(bounds, "scheme string, split string, lo double, hi double")
    h = F.xxhash64(F.lit(11), F.col("component"))
    run = prefix_sum(small.withColumn("one", F.lit(1)), ["one"], F.shiftrightunsigned(h, 54).cast("int"), [h, F.col("component")], F.col("weight").cast("double"), "before")
    rest_weight = small.agg(F.sum("weight").cast("double").alias("rw"))
    # the cut table has one row per scheme and split, so this is no product of two large sides
    at = run.join(F.broadcast(rest_weight)).withColumn("x", (F.col("before") + F.col("weight") / 2) / F.col("rw"))
    cut = at.join(F.broadcast(cuts), (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("scheme", "component", "split")
    return fixed.unionByName(cut)


def record_components(df: DataFrame, column: str, key: Column) -> DataFrame:
    """``id, component``; a record whose value names nothing is a component of its own."""
    parts = value_components(df, column, key)
    rows = df.select("id", F.col(column).alias("value")).where("id IS NOT NULL").distinct()
    known = rows.join(parts, "value", "left").groupBy("id").agg(F.min("component").alias("component"))
    return known.select("id", F.coalesce(F.concat(F.lit("v:"), "component"), F.concat(F.lit("r:"), "id")).alias("component"))


_GROUPINGS = (("product", "product_id", product_key), ("category", "category", category_key))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", "product_id", "category")
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet")
    out = []
    for grouping, column, key in _GROUPINGS:
        rows = checkpoint(record_components(df, column, key(F.col("value"))))
        weights = rows.groupBy("component").agg(F.count("id").alias("weight"))
        placed = assign_splits(weights, targets)
        out.append(rows.join(placed, "component").select("id", F.lit(grouping).alias("grouping"), "component", "scheme", "split"))
    return reduce(DataFrame.unionByName, out)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every record by scheme, once by product and once by category."""
    return split_records(spark, sf_dir)


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of every split."""
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet").select("scheme", "split", "share").distinct()
    n = split_records(spark, sf_dir).groupBy("grouping", "scheme", "split").agg(F.count("id").alias("records"))
    whole = Window.partitionBy("grouping", "scheme")
    n = n.withColumn("actual_share", F.round(F.col("records") / F.sum("records").over(whole), 6))
    return n.join(F.broadcast(targets), ["scheme", "split"]).select("grouping", "scheme", "split", F.col("share").alias("target_share"), "records", "actual_share")

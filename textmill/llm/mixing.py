"""Problem 9: sources mixed to target shares of the total token size.

For each mix the largest total is taken that no source must exceed its ``max_repeats`` for; a
source's documents then have the same expected number of copies. Systematic sampling draws them:
the expected copies are prefix-summed within the source in order of size class, one random
offset per mix and source is added, and a document is emitted once per integer boundary that
its interval crosses. The order by size spreads every length evenly over the draw, which keeps
the actual shares close to the targets.

Results for special input: documents without text, id or a source in the mix are not drawn;
texts of no tokens have size 0; a source with no tokens keeps actual share 0 and the others
share the total as their targets do; whole rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.tokens import TOKENIZER, count_tokens
from textmill.runtime import prefix_sum, stored


def draw(docs: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, copies`` for ``docs(doc_id, source, n_tokens)``.

    ``targets`` has a row per mix and source and is small; the join with it is a broadcast.
    """
    sums = docs.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("size"))
    plan = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().where("target_share > 0 AND max_repeats > 0")
    plan = plan.join(sums, "source").where("size > 0")
    mix = Window.partitionBy("mix_name")
    plan = plan.withColumn("total", F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).over(mix))
    plan = plan.withColumn("rate", F.least(F.col("total") * F.col("target_share") / F.col("size"), F.col("max_repeats").cast("double")))
    plan = plan.withColumn("offset", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "source"), 11) / F.lit(float(1 << 53)))
    # sums has one row per source and targets one per mix and source: both stay within the size of targets
    rows = docs.join(F.broadcast(plan.select("mix_name", "source", "rate", "offset", "max_repeats")), "source")
    h = F.xxhash64(F.lit(seed + 1), F.col("doc_id"))
    size_class = F.floor(F.log2(F.col("n_tokens") + 1) * 64).cast("int")
    # buckets follow the order whatever their number, which only spreads the work: one for some ten thousand rows of a size class
    bits = min(max((docs.count() >> 14).bit_length(), 6), 20)
    bucket = size_class * (1 << bits) + F.shiftrightunsigned(h, 64 - bits).cast("int")
    ranked = prefix_sum(rows, ["mix_name", "source"], bucket, [h, F.col("doc_id")], F.lit(1.0), "k")
    upto = lambda k: F.floor(F.col("offset") + F.col("rate") * k)
    copies = F.least(upto(F.col("k") + 1) - upto(F.col("k")), F.col("max_repeats").cast("long"))
    return ranked.withColumn("copies", copies).where("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")


def draw_documents(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("doc_id IS NOT NULL AND source IS NOT NULL")
    sized = count_tokens(docs, "text", ["doc_id", "source"], tokenizer)
    sized = stored(sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")))
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    return draw(sized, targets), targets


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents of each mix with their number of copies."""
    return draw_documents(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of the total size, and most copies, for each mix and source."""
    drawn, targets = draw_documents(spark, sf_dir)
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("doc_id").alias("documents"), F.max("copies").alias("most_copies")
    )
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().join(got, ["mix_name", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy("mix_name")))
    return rows.select(
        "mix_name", "source", "target_share", F.round(share, 6).alias("actual_share"), "max_repeats",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"),
    )

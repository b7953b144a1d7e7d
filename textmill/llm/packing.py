"""Problem 8: texts put whole into containers of fixed capacity with little unused room.

Documents are spread over random groups of about ``group_size`` by a hash of their id. In each
group first-fit decreasing runs over a tournament tree of the bins' free room, so an item finds
its first fitting bin in log(bins) steps. The groups are independent tasks of bounded size.

A text longer than the capacity, and only such a text, is split: full pieces fill a container
each, the remainder is packed like any other item. Results for special input: null texts are
left out; a text of no tokens is a piece of size 0 in its group's first container; whole rows
delivered twice count once, and ties go by smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.tokens import TOKENIZER, count_tokens
from textmill.runtime import stored


#: Tasks the groups are spread over at most.
MOST_TASKS = 20_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; ``sizes`` must be in falling order and at most ``capacity``."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


def pack(docs: DataFrame, capacities: DataFrame, group_size: int = 1024) -> DataFrame:
    """``capacity_name, capacity_tokens, doc_id, piece_no, token_start, tokens, container`` for ``docs(doc_id, n_tokens)``.

    ``capacities`` is a short table (a row per container kind) and is read by the driver.
    """
    kinds = [(r["capacity_name"], r["capacity_tokens"]) for r in capacities.distinct().where("capacity_tokens > 0").orderBy("capacity_name").collect()]
    groups = max(1, -(-docs.count() // group_size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group = int(pdf["g"].iloc[0])
            for name, capacity in kinds:
                whole, loose = [], []
                for doc, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
                    full, rest = divmod(n, capacity)
                    whole.extend((doc, i, i * capacity, capacity) for i in range(full))
                    if rest or not full:
                        loose.append((doc, full, full * capacity, rest))
                loose.sort(key=lambda x: (-x[3], x[0], x[1]))
                spots = first_fit_decreasing([x[3] for x in loose], capacity)
                used = max(spots, default=-1) + 1
                rows = [(*x, used + i) for i, x in enumerate(whole)] + [(*x, s) for x, s in zip(loose, spots)]
                out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "tokens", "bin"])
                out["container"] = f"{name}-{group}-" + out.pop("bin").astype(str)
                out.insert(0, "capacity_tokens", capacity)
                out.insert(0, "capacity_name", name)
                yield out

    # a group per key, so a task holds one group of bounded size at a time
    keyed = docs.withColumn("g", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(groups)).cast("int"))
    # a number of partitions that is asked for is not merged by its bytes, which are few for the work behind them
    # four to a group, so that few groups meet in one
    keyed = keyed.repartition(min(4 * groups, MOST_TASKS), "g")
    schema = "capacity_name string, capacity_tokens int, doc_id long, piece_no int, token_start long, tokens int, container string"
    return keyed.groupBy("g").applyInPandas(lambda pdf: pd.concat(list(run(iter([pdf])))) if kinds else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)


def pack_documents(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    sized = stored(count_tokens(docs, "text", ["doc_id"], tokenizer).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    capacities = spark.read.parquet(f"{sf_dir}/pack_capacities.parquet").select("capacity_name", "capacity_tokens")
    return pack(sized, capacities)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every piece of every document, for each capacity."""
    return pack_documents(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and fill of each capacity."""
    pieces = pack_documents(spark, sf_dir)
    return pieces.groupBy("capacity_name", "capacity_tokens").agg(
        F.countDistinct("container").alias("containers"),
        F.count("doc_id").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.countDistinct("container") * F.first("capacity_tokens")), 6).alias("fill"),
    )

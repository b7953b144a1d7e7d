"""Bins are never overfull, nothing is lost; draws meet shares and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.llm import mixing, packing


def slow_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                out.append(i)
                break
        else:
            room.append(capacity - s)
            out.append(len(room) - 1)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tournament_tree_is_first_fit(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([0, 1, 5, 100, rng.randrange(101)]) for _ in range(rng.randrange(90))), reverse=True)
    assert packing.first_fit_decreasing(sizes, 100) == slow_first_fit(sizes, 100)


def test_packing(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, 3, 40, 63, 64, 65, 200, 1000])) for i in range(700)]
    kinds = spark.createDataFrame([("base", 64), ("long", 256)], "capacity_name string, capacity_tokens int")
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, n_tokens long"), kinds, group_size=200).toPandas()
    for name, capacity in (("base", 64), ("long", 256)):
        part = out[out.capacity_name == name]
        assert part.groupby("container").tokens.sum().max() <= capacity
        assert part.groupby("doc_id").tokens.sum().to_dict() == dict(docs)
        whole = part.groupby("doc_id").size()
        assert all(whole[i] == max(1, -(-n // capacity)) for i, n in docs)
        assert part.tokens.sum() / (part.container.nunique() * capacity) > 0.9


def test_mixing_meets_shares(spark):
    rng = random.Random(5)
    docs = [(i, "a" if i % 10 else "b", int(rng.lognormvariate(5, 1))) for i in range(6000)]
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 4), ("n", "a", 1.0, 2), ("n", "none", 0.2, 9)], "mix_name string, source string, target_share double, max_repeats int")
    out = mixing.draw(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), targets).toPandas()
    m = out[out.mix_name == "m"]
    size = (m.n_tokens * m.copies).groupby(m.source).sum()
    assert abs(size["a"] / size.sum() - 0.5) < 0.02
    assert m[m.source == "a"].copies.max() <= 1 and m[m.source == "b"].copies.max() <= 4
    assert out[out.mix_name == "n"].copies.eq(2).all() and len(out[out.mix_name == "n"]) == 5400
    assert not out.duplicated(["mix_name", "doc_id"]).any()


def test_draw_is_the_brute_force_systematic_sample(spark):
    docs = [(i, "a", 1 + i % 5) for i in range(500)]
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs + [(1000 + i, "b", 3) for i in range(100)], "doc_id long, source string, n_tokens long")
    out = mixing.draw(df, targets).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    n = {r["source"]: r["n"] for r in out}
    rate = 300 / sum(x[2] for x in docs)  # b is used once in full, so a gets the same size
    assert n["b"] == 100 and abs(n["a"] - rate * 500) <= 1

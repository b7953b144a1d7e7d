"""Components, splits and formatting duplicates against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.llm import format_dedup, group_split

from .conftest import raw


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 30), (2, 30, 60), (3, 60, 20)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"{rng.randrange(n):03}", f"{rng.randrange(n):03}") for _ in range(m)] + [("hub", f"{i:03}") for i in range(5)] + [("x", "x"), (None, "y")]
    got = {r["node"]: r["component"] for r in group_split.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == components([e for e in edges if e[0] is not None])


def test_long_chains_and_a_large_hub(spark):
    """A chain of 1500 vertices in random order, and a hub with 100 000 edges, a third of them twice."""
    names = [f"c{i:04}" for i in range(1500)]
    random.Random(1).shuffle(names)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    leaf = F.concat(F.lit("h"), F.format_string("%06d", F.col("id")))
    hub = spark.range(100_000).select(F.lit("hub").alias("a"), leaf.alias("b"))
    got = group_split.connected_components(chain.union(hub).union(hub.where(F.col("b") < "h033333").select("b", "a")))
    sizes = {(r["component"], r["n"]) for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("c0000", 1500), ("h000000", 100_001)}


@pytest.mark.parametrize(
    "value,code",
    [
        ("B0HK7Q2M4X", "B0HK7Q2M4X"), (" b0hk7q2m4x\t", "B0HK7Q2M4X"), ("#b0hk-7q2m4x", "B0HK7Q2M4X"), ("dp/B0HK7Q2M4X", "B0HK7Q2M4X"), ("№0707166787", "0707166787"),
        ("707166787", "0707166787"), ("18951125.0", "0018951125"), ("Ｂ０ＨＫ７Ｑ２Ｍ４Ｘ", "B0HK7Q2M4X"), ("N/A", None), ("unknown", None), ("-", None), ("", None), ("B0HK7Q2M4", None),
    ],
)
def test_product_key(spark, value, code):
    assert spark.createDataFrame([(value,)], "v string").select(group_split.product_key(F.col("v")).alias("k")).head()["k"] == code


def test_splits_keep_groups_whole(spark, tables):
    rng = random.Random(4)
    spell = [lambda c: c, str.lower, lambda c: f" {c}", lambda c: f"#{c}"]
    rows = []
    for i in range(900):  # one product holds a third of all rows
        code = "B000000000" if i % 3 == 0 else f"B{rng.randrange(60):09}"
        rows.append(raw(f"r{i}", "x", product=rng.choice(spell)(code), category=rng.choice(["Home Kitchen", "home_kitchen", None, "Lighting"])))
    rows += [raw(f"n{i}", "x", product=rng.choice([None, "", "N/A"])) for i in range(60)] + rows[:5]
    folder = tables(rows)
    out = group_split.p2_splits(spark, folder)
    assert out.groupBy("grouping", "scheme", "component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("grouping = 'product'").count() == 960
    shares = {r["split"]: r["actual_share"] for r in group_split.p2_shares(spark, folder).where("grouping = 'product'").collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["val"] - 0.1) < 0.03
    keys = {}
    for r in rows:
        keys.setdefault((r[6] or "").strip().strip("#").upper(), set()).add(r[6])
    want = {(a, b) for k, vs in keys.items() if len(k) == 10 for a in vs for b in vs if a < b}
    assert {tuple(r) for r in group_split.p2_found(spark, folder).collect()} == want


def _brute_key(text):
    """Multiset of the fields of a line text, by plain string work."""
    flat = "".join(c.lower() if c.isalnum() else " " for c in text)
    words = flat.split()
    if not words or words[0] not in format_dedup.FIELD_LABELS:
        return ("".join(words),)
    fields, current = [], []
    for w in words:
        if w in format_dedup.FIELD_LABELS and current:
            fields.append("".join(current))
            current = []
        current.append(w)
    fields.append("".join(current))
    return tuple(sorted(fields))


def test_formatting_against_brute_force(spark, tables):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        # a third of all rows is one text in several dresses
        parts = ["lid holds"] * 3 if i % 3 == 0 else [rng.choice(["lid holds", "pump leaks", "scent is fine"]) for _ in range(3)]
        fields = list(zip(["Pros", "Cons", "Comment"], parts))
        rng.shuffle(fields)
        text = rng.choice([
            "\n".join(f"{k}: {v}." for k, v in fields), " | ".join(f"{k}: {v}" for k, v in fields), "; ".join(f"{k} - {v}" for k, v in fields).upper(),
            "{" + ", ".join(f'"{k}": "{v}"' for k, v in fields) + "}", parts[0] + ", " + parts[1], parts[0].title() + " " + parts[1] + "!!!",
        ])
        rows.append(raw(f"r{i:03}", text))
    rows += rows[:9]
    groups = {}
    for r in rows:
        groups.setdefault(_brute_key(r[3]), set()).add(r[0])
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    folder = tables(rows)
    assert {tuple(r) for r in format_dedup.p6_found(spark, folder).collect()} == want
    copies = {r["id"]: r["copies"] for r in format_dedup.p6_collapsed(spark, folder).collect()}
    assert copies == {min(g): len(g) for g in groups.values()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab .,\n!-AB", min_size=1, max_size=30))
def test_case_blanks_and_signs_do_not_count(spark, text):
    rows = [("1", text), ("2", text.upper()), ("3", f"« {text} »")]
    got = {r["p"][0] for r in spark.createDataFrame(rows, "id string, t string").select(format_dedup.fields(F.col("t")).alias("p")).collect()}
    assert len(got) == 1


def test_collisions_are_told_apart(spark, monkeypatch):
    # with a fingerprint that always collides, the pairs themselves must still divide the records
    monkeypatch.setattr(format_dedup, "fingerprint", lambda pairs: F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("x"), F.lit(1).alias("n")))
    df = spark.createDataFrame([("1", "same one"), ("2", "Same, one!"), ("3", "other"), ("4", "OTHER"), ("5", "third")], "id string, original_text string")
    got = {r["id"]: r["class_id"] for r in format_dedup.collapse_formatting(df).collect()}
    assert (got["2"], got["4"], got["5"]) == ("1", "3", "5")

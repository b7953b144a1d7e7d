"""Round trips of sources and sinks, and replay of the annotation stream."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from textmill.schemas import TRAINING_ROW
from textmill.sources import readers, sinks
from textmill.streaming import annotate


def test_jsonl_round_trip(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/train.parquet")
    sinks.write_jsonl(df, str(tmp_path / "t.jsonl"))
    back = readers.read_json(spark, str(tmp_path / "t.jsonl"), TRAINING_ROW)
    assert back.count() == df.count() and back.select("id", "cot").exceptAll(df.select("id", "cot")).count() == 0


def test_json_array_and_wrapped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "text": "é"}, {"id": "2"}]))
    assert readers.read_json(spark, str(tmp_path / "a.json"), "id string, text string").count() == 2
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"text": "x"}]}))
    assert readers.read_wrapped(spark, str(tmp_path / "w.json"), "text string").head()["text"] == "x"


def test_bad_lines_are_dropped(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\nnot json\n{"id": "2"}\n')
    assert readers.read_json(spark, str(tmp_path / "b.jsonl"), "id string").count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b\nc', 2), (None, None, None)], "id string, text string, label int")
    sinks.write_csv(sinks.baseline_rows(df), str(tmp_path / "c"))
    rows = readers.read_csv(spark, str(tmp_path / "c"), ["id", "text", "label"]).collect()
    assert ("1", 'a "q", b\nc', "2") in [tuple(r) for r in rows]


def test_layout_projection(spark):
    df = spark.createDataFrame([("good", "4.9", "", "c"), ("  ", "3", "p", "c"), ("bad", "9", "p", "c")], "review_body string, stars string, product_id string, product_category string")
    got = readers.project(df, "reviews", "en", "amazon_hf").collect()
    assert [(r["original_text"], r["rating"], r["sentiment_label"], r["product_id"]) for r in got] == [("good", 4, 2, None)]


def test_csv_label_goes_before_rating(spark):
    df = spark.createDataFrame([("a", "0", "5"), ("b", "x", "3"), ("c", None, "7"), (" ", "1", "1")], "t string, l string, r string")
    got = {r["text"]: (r["label"], r["rating"]) for r in readers.csv_records(df, "t", "l", "r").collect()}
    assert got == {"a": (0, 5), "b": (1, 3)}


def test_split_files_get_ids(spark, tmp_path):
    for split, texts in (("train", ["a", "b"]), ("val", ["a"])):
        (tmp_path / f"{split}.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    rows = readers.read_splits(spark, str(tmp_path), ["train", "val"], "text string").collect()
    assert {(r["id"], r["text"]) for r in rows} == {("train_0", "a"), ("train_1", "b"), ("val_0", "a")}


def test_places_of_a_file_read_in_parts(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_splits(spark, str(tmp_path), ["train"], "n int")
        assert rows.rdd.getNumPartitions() >= 1 and {(r["id"], r["n"]) for r in rows.collect()} == {(f"train_{i}", i) for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_layouts_fill_their_places_and_label_unknown_ratings(spark, tmp_path):
    folder = tmp_path / "raw_review_Home"
    folder.mkdir()
    (folder / "a.json").write_text("".join(json.dumps({"text": t, "rating": r, "parent_asin": "p"}) + "\n" for t, r in (("\u00a0x\n", 9.0), ("x", None), ("y", 4.9), ("y", 4.9))))
    got = readers.read_layout(spark, "mcauley", str(tmp_path), "en", "amazon_mcauley", "Home").collect()
    assert sorted((r["original_text"], r["rating"], r["sentiment_label"]) for r in got if r["rating"]) == [("y", 4, 2), ("y", 4, 2)]
    assert [(r["original_text"], r["sentiment_label"]) for r in got if r["rating"] is None] == [("x", 1)]
    assert len({r["id"] for r in got}) == 3
    again = readers.read_layout(spark, "mcauley", str(tmp_path), "en", "amazon_mcauley", "Home").collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}


def test_a_source_that_fails_is_left_out(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert readers.union_languages({"en": df, "zh": lambda: spark.read.json("/nowhere/at/all"), "ru": None, "de": lambda: df}).count() == 2


def test_json_arrays_in_parts(spark, tmp_path):
    df = spark.createDataFrame([(i, "好" if i % 2 else None) for i in range(50)], "n int, t string").repartition(3)
    sinks.write_json_array(df, str(tmp_path / "a"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("part-*")]
    assert sorted(r["n"] for part in parts for r in part) == list(range(50)) and any("好" in p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert readers.read_json(spark, str(tmp_path / "a"), "n int, t string").count() == 50
    sinks.write_json_array(df.where("n < 0").coalesce(1), str(tmp_path / "e"))
    assert all(p.read_text().strip() in ("", "[]") for p in (tmp_path / "e").glob("part-*"))


def test_line_limit_counts_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\nbad\n{"id": "2"}\n{"id": "3"}\n')
    assert [r["id"] for r in readers.read_lines(spark, str(tmp_path / "l.jsonl"), "id string", 3).collect()] == ["1", "2"]


def test_alternative_names(spark):
    df = spark.createDataFrame([("", "in", "2", [0.1, 0.2, 0.7]), ("t", None, "x", None)], "text string, input string, output string, soft_label array<double>")
    got = [(r["text"], r["label"], round(r["confidence"], 2)) for r in readers.distillation_rows(df).collect()]
    assert got == [("in", 2, 0.7), ("t", None, 0.34)]
    assert readers.truth_labels(df).count() == 1
    assert not readers.has_soft_labels(df)
    clean = spark.createDataFrame([("t", 1, 2)], "text string, label int, cleaned_label int")
    assert readers.labelled_text(clean).head()["label"] == 2 and readers.labelled_text(clean, True).head()["label"] == 1


def test_split_folders(spark, tmp_path):
    df = spark.createDataFrame([("1", "train"), ("2", "odd"), ("3", None), ("4", "test")], "id string, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    back = spark.read.json(str(tmp_path / "s"))
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 3, "test": 1}


def test_annotation_stream_does_each_row_once(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", F.col("original_text").alias("text")).where("text IS NOT NULL")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows.repartition(5).write.parquet(src)
    n = annotate.run_annotation(spark, src, rows.schema, out, state)
    want = annotate.annotate(rows.dropDuplicates(["id"])).count()
    assert n == want
    rows.withColumn("id", F.concat("id", F.lit("x"))).limit(7).union(rows.limit(3)).write.mode("append").parquet(src)
    assert annotate.run_annotation(spark, src, rows.schema, out, state) == want + 7
    stored = annotate._stored(spark, out)
    assert stored.select("id").distinct().count() == stored.count()


def test_a_new_checkpoint_leaves_out_what_is_stored(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", F.col("original_text").alias("text")).where("text IS NOT NULL").limit(60)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(src)
    n = annotate.run_annotation(spark, src, rows.schema, out, str(tmp_path / "s1"))
    assert annotate.run_annotation(spark, src, rows.schema, out, str(tmp_path / "s2")) == n


def test_annotation_is_throttled(spark):
    rows = spark.createDataFrame([(str(i), "x") for i in range(16)], "id string, text string")
    began = time.time()
    assert annotate.annotate(rows, workers=2, pause=0.5).count() == 16
    assert time.time() - began >= 0.5 and annotate.calls_a_second(20, 0.05) == pytest.approx(400)


def test_streams_append_lines_and_drop_repeats(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0)), ("a", dt.datetime(2024, 1, 1, 0, 1)), ("b", dt.datetime(2024, 1, 1, 0, 2))], "k string, ts timestamp")
    df.write.parquet(src)
    stream = annotate.first_of_each(spark.readStream.schema(df.schema).parquet(src), "k", "ts", "1 hour")
    annotate.append_lines(stream, out, state).awaitTermination()
    annotate.append_lines(annotate.first_of_each(spark.readStream.schema(df.schema).parquet(src), "k", "ts", "1 hour"), out, state).awaitTermination()
    assert sorted(r["k"] for r in spark.read.json(out).collect()) == ["a", "b"]

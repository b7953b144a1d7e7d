"""Operators on small tables and golden matrices."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import chat, features, metrics, models, quality, reports, sampling, topics

GOLDEN = {
    "local_500": ([[157, 2, 0], [6, 190, 5], [0, 8, 132]], 0.958, 0.9586),
    "svm_500": ([[98, 55, 6], [49, 119, 33], [11, 51, 78]], 0.590, 0.5947),
    "adaptive_600": ([[122, 77, 1], [31, 162, 7], [1, 80, 119]], 0.6717, 0.6805),
    "soft_full_600": ([[170, 4, 26], [126, 1, 73], [111, 3, 86]], 0.4283, 0.3388),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_matrices(spark, name):
    matrix, accuracy, f1 = GOLDEN[name]
    rows = [(t, p) for t in range(3) for p in range(3) for _ in range(matrix[t][p])]
    df = spark.createDataFrame(rows, "label int, pred int")
    got = metrics.summary(df).head()
    assert got["accuracy"] == pytest.approx(accuracy, abs=1e-4) and got["f1_macro"] == pytest.approx(f1, abs=1e-4)
    cells = {(r["t"], r["p"]): r["n"] for r in metrics.confusion(df).collect()}
    assert cells == {(t, p): matrix[t][p] for t in range(3) for p in range(3)}


def test_out_of_range_predictions_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(0, 0), (1, -1), (2, -1), (2, 1)], "label int, pred int")
    assert metrics.summary(df).head()["accuracy"] == 0.25
    got = {r["class"]: r for r in metrics.class_metrics(df).collect()}
    assert got[1]["recall"] == 0.0 and got[2]["support"] == 1
    parsed = metrics.parsed_accuracy(df).head()
    assert (parsed["valid"], parsed["correct"], parsed["accuracy_pct"]) == (2, 1, 50.0)


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "label int, pred int")
    assert metrics.confusion(df).count() == 9
    assert metrics.class_metrics(df).where("f1 <> 0").count() == 0


def test_calibration(spark):
    df = spark.createDataFrame([(0.0, False), (0.1, True), (1.0, True), (None, True)], "c double, k boolean")
    assert metrics.calibration_error(df, F.col("c"), F.col("k")).head()["ece"] == pytest.approx(0.9 / 3, abs=1e-6)


def test_positional_join_cuts_to_the_shorter(spark):
    a = spark.createDataFrame([(f"{i}", i) for i in range(5)], "id string, truth int")
    b = spark.createDataFrame([(f"{i}", i) for i in range(4)], "id string, guess int")
    rows = metrics.positional_join(a, b.withColumnRenamed("id", "id"), ["id"]).select("place", "truth", "guess").orderBy("place").collect()
    assert [(r["truth"], r["guess"]) for r in rows] == [(i, i) for i in range(4)]


def test_histogram_leaves_out_one_and_low_values(spark):
    df = spark.createDataFrame([([c, 0.0, 0.0],) for c in (0.5, 0.6, 0.9, 1.0, 0.4)], "soft_labels array<double>")
    assert {r["bucket"]: r["n"] for r in quality.confidence_histogram(df).collect()} == {"0.5-0.6": 1, "0.6-0.7": 1, "0.7-0.8": 0, "0.8-0.9": 0, "0.9-1.0": 1}


def test_keep_first_collapses_null_ids(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 1)], "id string, pos int")
    got = sampling.keep_first(df, "id", [F.col("pos")]).collect()
    assert sorted((r["id"] or "", r["pos"]) for r in got) == [("", 1), ("a", 1)]


def test_prefix_anti_join(spark):
    df = spark.createDataFrame([("1", "x" * 100 + "a"), ("2", None), ("3", "y")], "id string, text string")
    ref = spark.createDataFrame([("x" * 100 + "b",)], "text string")
    assert sorted(r["id"] for r in sampling.unused_by_prefix(df, ref).collect()) == ["2", "3"]


def test_splits_are_disjoint_exact_and_stable(spark):
    df = spark.range(997).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("label"))
    cut = sampling.cut_split(df, F.col("id")).select("id", "split")
    n = {r["split"]: r["count"] for r in cut.groupBy("split").count().collect()}
    assert n == {"train": 797, "val": 99, "test": 101}
    again = sampling.cut_split(df.repartition(7), F.col("id")).select("id", "split")
    assert cut.exceptAll(again).count() == 0
    batch = sampling.small_batch(df, 7, [sampling.shuffle_key(F.col("id"))])
    assert {r["label"]: r["count"] for r in batch.groupBy("label").count().collect()} == {0: 3, 1: 2, 2: 2}
    stages = sampling.curriculum(df, F.col("id"), [10, 20]).groupBy("stage").count().collect()
    assert {r["stage"]: r["count"] for r in stages} == {10: 10, 20: 10}


def test_early_stop(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.5), (5, 0.7)], "epoch int, f1 double")
    rows = sampling.best_so_far(df, "f1", "epoch").orderBy("epoch").collect()
    assert [r["is_best"] for r in rows] == [True, True, False, False, True]
    assert [r["stops"] for r in rows] == [False, False, False, True, False]


def test_vocabulary_is_sorted_and_dense(spark):
    df = spark.createDataFrame([("b a",), ("c a",)], "t string")
    got = {r["word"]: r["word_id"] for r in features.vocabulary(df, F.split("t", " ")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "b c d")], "doc int, t string")
    w = features.tfidf(df, "doc", F.split("t", " "), min_df=1, max_df=1.0)
    assert all(abs(r["n"] - 1) < 1e-9 for r in w.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())


def test_padding_and_masks(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [7]), (3, [])], "id int, ids array<int>")
    rows = {r["id"]: r["padded"] for r in features.pad_to_batch(df, "ids", F.lit(0)).collect()}
    assert rows == {1: [5, 6], 2: [7, 0], 3: [0, 0]}
    masked = {r["id"]: r["m"] for r in df.select("id", features.masked_labels(F.col("ids"), F.lit(1)).alias("m")).collect()}
    assert masked == {1: [-100, 6], 2: [-100], 3: []}
    enc = df.select("id", features.fixed_length(F.col("ids"), 3).alias("e")).orderBy("id").head()["e"]
    assert enc["input_ids"] == [5, 6, 0] and enc["attention_mask"] == [1, 1, 0]


def test_conversations_hold_readable_json(spark):
    df = spark.createDataFrame([("1", "good", 2, 2, [0.1, 0.2, 0.7], 'says "so"\nhere', 5, None, "c")], "id string, text string, label int, hard_label int, soft_labels array<double>, cot string, rating int, confidence double, category string")
    built = chat.to_conversations(df)
    reply = built.head()["conversations"][2]["content"]
    body = json.loads(reply.partition("<channel|>\n")[2])
    assert body == {"sentiment": 2, "confidence": 0.7, "rationale": 'says "so"\nhere'}
    assert chat.format_violations(built).count() == 0


def test_format_violations(spark):
    df = spark.createDataFrame([("1", None), ("2", [("system", "s"), ("user", "u")])], "id string, conversations array<struct<role:string,content:string>>")
    got = {(r["id"], r["violation"]) for r in chat.format_violations(df).collect()}
    assert ("1", "turns") in got and ("2", "assistant") in got and ("2", "system") not in got


def test_history_keeps_thoughts_after_the_last_question(spark):
    turns = [("user", "a"), ("assistant", "<think>old</think>\nx"), ("user", "b"), ("assistant", "<think>new</think>\ny")]
    df = spark.createDataFrame([(turns,)], "c array<struct<role:string,content:string>>")
    got = df.select(chat.render_history(F.col("c")).alias("t")).head()["t"]
    assert "old" not in got and "<think>\nnew\n</think>\n\ny" in got


def test_few_shot(spark):
    df = spark.createDataFrame([("en",), ("fr",)], "l string")
    assert [r["n"] for r in df.select(F.size(chat.few_shot(F.col("l"), 2)).alias("n")).collect()] == [2, 0]


def test_mixture_finds_two_topics(spark):
    docs = [(i, "cat dog pet fur") for i in range(20)] + [(i, "bolt nut steel saw") for i in range(20, 40)]
    words = topics.doc_words(spark.createDataFrame(docs, "d int, t string"), "d", F.split("t", " "))
    got = {r["doc"]: r["cluster"] for r in topics.fit_mixture(words, 4, 6).collect()}
    assert len({got[i] for i in range(20)} & {got[i] for i in range(20, 40)}) == 0


def test_dominant_topic(spark):
    df = spark.createDataFrame([([0.2, 0.8],), ([],), (None,)], "p array<double>")
    got = [tuple(r["x"]) for r in df.select(topics.dominant_topic(F.col("p")).alias("x")).collect()]
    assert got[0] == (1, 0.8) and got[1][1] == 0.0 and got[2][1] == 0.0


def test_svm_learns_held_out_rows(spark):
    # labels of the embeddings table do not follow its vectors, so the fixture makes its own classes
    rows = [(i, i % 3, [float(i % 3 == k) + ((i * 7 + k) % 11) / 30 for k in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>").select("id", "label", models.as_vector(F.col("v")).alias("features"))
    got = models.fit_linear_svm(df.where("id % 5 <> 0"), rounds=10).transform(df.where("id % 5 = 0"))
    assert got.where("prediction = label").count() / got.count() > 0.95


def test_soft_regression_follows_the_soft_labels(spark):
    rows = [(i, [float(i % 2), 1.0 - i % 2], [0.9, 0.1] if i % 2 else [0.2, 0.8]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v array<double>, soft_labels array<double>").withColumn("features", models.as_vector(F.col("v")))
    got = models.fit_soft_labels(df).transform(df)
    assert got.where((F.col("prediction") == 0) == (F.col("id") % 2 == 1)).count() == 100


def test_scorer_failures_become_nulls(spark):
    def scorer(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("1", "a"), ("2", "bad")], "id string, text string").coalesce(1)
    got = {r["id"]: r["output"] for r in models.score_batches(df, scorer, batch=1).collect()}
    assert got == {"1": "A", "2": None}


def test_report_texts(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "label int, pred int")
    summary, per_class = metrics.summary(df), metrics.class_metrics(df)
    with pytest.raises(ValueError):
        reports.markdown(spark.range(reports.MOST_ROWS + 1))
    assert reports.markdown(summary).splitlines()[2] == "| 0.6667 | 0.5556 | 3 |"
    assert "class 1: P 0.5000 R 1.0000" in reports.metrics_text(summary, per_class)
    assert reports.target_check(summary).head()["target_met"] is False
    assert reports.from_stored("{bad") == {}
    grid = {r["metric"]: r["a"] for r in reports.f1_grid({"a": df}).collect()}
    assert grid["class_0"] == 1.0 and grid["macro"] == 0.5556


def test_coherence_of_words_that_always_meet(spark):
    docs = [(i, "cat dog") for i in range(4)] + [(i, "nut bolt") for i in range(4, 8)]
    words = topics.doc_words(spark.createDataFrame(docs, "d int, t string"), "d", F.split("t", " "))
    top = spark.createDataFrame([(0, "cat", 0.5, 1), (0, "dog", 0.5, 2), (1, "cat", 0.5, 1), (1, "nut", 0.5, 2)], "cluster int, word string, prob double, rank int")
    npmi = {r["cluster"]: r["npmi"] for r in topics.coherence_npmi(top, words).collect()}
    mass = {r["cluster"]: r["u_mass"] for r in topics.coherence_umass(top, words).collect()}
    assert npmi == {0: 1.0, 1: -1.0} and mass[0] > mass[1]


def test_topics_and_summary_of_lda(spark):
    docs = [(i, "cat dog pet fur") for i in range(10)] + [(i, "bolt nut steel saw") for i in range(10, 20)]
    model, rows = topics.lda(spark.createDataFrame(docs, "d int, t string"), "d", F.split("t", " "), 2, 10)
    top = {}
    for r in topics.lda_topics(model, 4).collect():
        top.setdefault(r["topic"], set()).add(r["word"])
    assert {frozenset(w) for w in top.values()} == {frozenset(("cat", "dog", "pet", "fur")), frozenset(("bolt", "nut", "steel", "saw"))}
    told = topics.lda_summary(model, rows)
    assert (told["topics"], told["vocabulary"], told["documents"]) == (2, 8, 20) and told["log_perplexity"] > 0


def test_a_language_without_a_template_is_an_error_where_asked(spark):
    df = spark.createDataFrame([("en",), ("xx",)], "l string")
    assert df.select(chat.system_prompt(F.col("l")).alias("p")).where("p IS NULL").count() == 1
    assert df.where("l = 'en'").select(chat.require_language(F.col("l")).alias("l")).head()["l"] == "en"
    with pytest.raises(Exception, match="no template for language xx"):
        df.select(chat.require_language(F.col("l"))).collect()


def test_latency_harness():
    rows = models.time_batches(models.stub_scorer, ["a"] * 20, (1, 8))
    assert [(s, i) for s, i, _ in rows if s == 8] == [(8, 0), (8, 1)] and len(rows) == 22


def test_grid_search_picks_the_smaller_penalty(spark):
    # a ring around a disc: only the radial kernel can tell them apart
    rows = [(i, i % 2, [(1 + 2 * (i % 2)) * math.cos(i), (1 + 2 * (i % 2)) * math.sin(i)]) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>").select("id", "label", models.as_vector(F.col("v")).alias("features"))
    found = models.grid_search(df, cs=(1,), gammas=("scale",), folds=2, rounds=8)
    assert [r["kernel"] for r in found] == ["rbf", "linear"] and found[0]["f1_macro"] > 0.9
    held_out = models.grid_search(df, cs=(1, 10), kernels=("linear",), folds=1, rounds=5)
    assert len(held_out) == 2


def test_macro_f1_gives_each_class_the_same_weight(spark):
    df = spark.createDataFrame([(0, 0)] * 8 + [(1, 0), (1, 1)], "label int, prediction int")
    assert models.macro_f1(df) == pytest.approx((16 / 17 + 2 / 3) / 2)


def test_platt_probabilities_follow_the_margins(spark):
    from pyspark.ml.functions import vector_to_array

    rows = [(i % 2, [float(i % 2) + (i % 5) / 10, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, v array<double>").withColumn("features", models.as_vector(F.col("v")))
    scored = models.fit_linear_svm(df).transform(df)
    got = models.fit_platt(scored).transform(scored).select("label", vector_to_array("probability")[1].alias("p")).collect()
    assert min(r["p"] for r in got if r["label"]) > max(r["p"] for r in got if not r["label"])


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rows = [(i, [float(i % 2), 1.0 - i % 2], [0.9, 0.1] if i % 2 else [0.2, 0.8]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>, soft_labels array<double>").withColumn("features", models.as_vector(F.col("v")))
    fit = models.fit_soft_labels(df)
    models.save_model(fit, str(tmp_path / "m"))
    assert LogisticRegressionModel.load(str(tmp_path / "m")).coefficientMatrix == fit.coefficientMatrix


def test_lda_gives_each_document_a_topic(spark):
    docs = [(i, "cat dog pet fur") for i in range(10)] + [(i, "bolt nut steel saw") for i in range(10, 20)]
    _, rows = topics.lda(spark.createDataFrame(docs, "d int, t string"), "d", F.split("t", " "), 2, 10)
    assert rows.count() == 20


@pytest.mark.parametrize("value,bin_", [(0.3, 2), (0.6, 5), (0.7, 6), (0.30000000000000004, 3), (0.1, 1), (1.0, 9), (0.0, 0)])
def test_calibration_bounds_are_multiples_of_a_tenth(spark, value, bin_):
    # a second row in the middle of the bin shares it: the two are judged together only then
    df = spark.createDataFrame([(value, True), (bin_ / 10 + 0.05, False)], "c double, k boolean")
    ece = metrics.calibration_error(df, F.col("c"), F.col("k")).head()["ece"]
    assert ece == pytest.approx(abs(0.5 - (value + bin_ / 10 + 0.05) / 2), abs=1e-6)


def test_confidence_out_of_range_counts_in_no_bin(spark):
    df = spark.createDataFrame([(1.5, True), (0.95, False)], "c double, k boolean")
    assert metrics.calibration_error(df, F.col("c"), F.col("k")).head()["ece"] == pytest.approx(0.95 / 2)


def test_samples_of_an_id_are_averaged(spark):
    rows = [("a", [0.2, 0.2, 0.6]), ("a", [0.4, 0.4, 0.2]), ("a", None), ("a", [0.1, None, 0.9]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0, 0.0])]
    got = {r["id"]: r for r in quality.multi_sample_mean(spark.createDataFrame(rows, "id string, probabilities array<double>")).collect()}
    assert set(got) == {"a", "c"} and got["a"]["n_samples"] == 2 and got["a"]["probabilities"] == pytest.approx([0.3, 0.3, 0.4]) and got["a"]["hard_label"] == 2


def test_quarantine_keeps_every_row(spark):
    rows = [("1", "en", "ok", 1, 3), (None, "en", "ok", 1, 3), ("2", "en", " \u00a0", 1, 3), ("3", "xx", "ok", 1, 3), ("4", "ru", "ok", 7, 3), ("5", "zh", "ok", None, 9), ("6", "zh", "ok", None, None)]
    good, bad = quality.quarantine(spark.createDataFrame(rows, "id string, language string, original_text string, sentiment_label int, rating int"))
    assert sorted(r["id"] for r in good.collect()) == ["1", "6"] and sorted(r["reason"] for r in bad.collect()) == ["label", "language", "no id", "no text", "rating"]


def _cooccurrence(tokens, top, size):
    import numpy as np

    windows = [set(t[i : i + size]) for t in tokens if t for i in range(max(len(t) - size, 0) + 1)]
    k = np.array([[sum(a in w and b in w for w in windows) for b in top] for a in top], float)
    return k, len(windows)


def test_window_coherence_against_brute_force(spark):
    import numpy as np

    rng = random.Random(4)
    tokens = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14))] for _ in range(30)]
    top = ["a", "b", "c", "d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc int, tokens array<string>")
    listed = spark.createDataFrame([(0, w, 0.1, i + 1) for i, w in enumerate(top)], "cluster int, word string, prob double, rank int")
    k, n = _cooccurrence(tokens, top, 5)
    p, single, eps = k / n, np.diag(k) / n, 1e-12
    pmi = np.log((p + eps) / np.outer(single, single))
    assert topics.coherence_uci(listed, docs, 5).head()["c_uci"] == pytest.approx(pmi[np.triu_indices(4, 1)].mean(), abs=1e-5)
    v = pmi / -np.log(p + eps)
    total = v.sum(0)
    cos = (v @ total) / (np.linalg.norm(v, axis=1) * np.linalg.norm(total))
    assert topics.coherence_cv(listed, docs, 5).head()["c_v"] == pytest.approx(cos.mean(), abs=1e-5)


def test_window_coherence_makes_no_row_per_window(spark):
    """Long documents, rows of one id and a listed word that never stands; places and windows are counted, not listed."""
    import numpy as np

    rng = random.Random(9)
    tokens = [[rng.choice("abcdefghijklmnop") for _ in range(n)] for n in (20_000, 3, 40, 1, 700, 40)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate([*tokens, [], None])], "doc int, tokens array<string>")
    top = ["a", "b", "c"]
    k, n = _cooccurrence(tokens, top, 12)
    got = {(r["wa"], r["wb"]): r["kk"] for r in topics._window_counts([*top, "absent"], docs, 12).collect()}
    assert got == {(None, None): n} | {(top[i], top[j]): int(k[i, j]) for i in range(3) for j in range(i, 3)}
    p, single = k / n, np.diag(k) / n
    pmi = np.log((p + 1e-12) / np.outer(single, single))
    listed = spark.createDataFrame([(0, w, 0.1, i + 1) for i, w in enumerate(top)], "cluster int, word string, prob double, rank int")
    measured = topics.coherence_uci(listed, docs, 12)
    assert measured.head()["c_uci"] == pytest.approx(pmi[np.triu_indices(3, 1)].mean(), abs=1e-5)
    assert "Generate" not in measured._jdf.queryExecution().toString()


def test_gibbs_parts_two_topics_and_predicts(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice(["cat", "dog", "pet"] if i % 2 else ["nut", "bolt", "saw"]) for _ in range(6)]) for i in range(60)] + [(99, [])]
    docs = spark.createDataFrame(rows, "doc long, tokens array<string>")
    found = topics.fit_gibbs(docs, clusters=4, iterations=15)
    got = {r["doc"]: r["cluster"] for r in found.collect()}
    assert got[99] == -1 and not {got[i] for i in range(0, 60, 2)} & {got[i] for i in range(1, 60, 2)}
    words = docs.select("doc", F.explode("tokens").alias("word")).groupBy("doc", "word").agg(F.count("*").alias("c"))
    known = found.where("cluster >= 0")
    counts, sizes = topics.cluster_words(words, known), topics.cluster_sizes(words, known, 4)
    best = {r["doc"]: r["cluster"] for r in topics.predict_mixture(docs, words, counts, sizes, 6).collect()}
    drawn = {r["doc"]: r["cluster"] for r in topics.predict_mixture(docs, words, counts, sizes, 6, seed=3).collect()}
    assert best[99] == -1 == drawn[99] and len(best) == 61
    assert not {best[i] for i in range(0, 60, 2)} & {best[i] for i in range(1, 60, 2)}


def test_cluster_labels_weigh_words_and_first_texts(spark):
    top = spark.createDataFrame([(0, "good", 1), (0, "bad", 2), (1, "okay", 1), (3, "lid", 1)], "cluster int, word string, rank int")
    assigned = spark.createDataFrame([(i, 0) for i in range(60)] + [(100, 1)], "doc int, cluster int")
    tokens = spark.createDataFrame([(0, "great"), (0, "great"), (1, "great"), (55, "awful"), (56, "awful"), (57, "awful"), (100, "fine"), (100, "fine")], "doc int, word string")
    got = {r["cluster"]: r["label"] for r in topics.cluster_labels(top, assigned, tokens, 5).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 0, 4: 1}


def test_subword_places(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    label_ids = F.array(*(F.lit(t.encode(str(k)).ids[-1]) for k in (0, 1, 2)))
    raw = 'reason <|endoftext|> {"sentiment":2}'
    df = spark.createDataFrame([(raw,), ("none",), (None,)], "o string")
    got = df.select(features.subword_ids(F.col("o"), path).alias("ids"), features.subword_label_place(F.col("o"), '"sentiment":', path, label_ids).alias("at")).collect()
    t.encode_special_tokens = True
    assert got[0]["ids"] == t.encode(raw).ids and got[0]["at"] == len(t.encode('reason <|endoftext|> {"sentiment":').ids)
    assert got[1]["at"] == -1 and got[2]["ids"] == []

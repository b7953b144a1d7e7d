"""Classifiers on vectors, soft-label regression, scorers and their evaluation frames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_vector(values: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(values.cast("array<double>"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with weight n / (k n_c); the table of classes is joined as its size allows."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    w = n.withColumn("weight", F.sum("_c").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_c"))).drop("_c")
    return df.join(w, label)


def fit_linear_svm(df: DataFrame, features: str = "features", label: str = "label", rounds: int = 20, c: float = 1.0):
    """One-vs-rest linear SVM with class weights; stands in for a kernel machine."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    rows = balanced_weights(df, label).withColumn(label, F.col(label).cast("double"))
    svm = LinearSVC(featuresCol=features, labelCol=label, weightCol="weight", maxIter=rounds, regParam=1.0 / (c * 1000))
    return OneVsRest(classifier=svm, featuresCol=features, labelCol=label, weightCol="weight", parallelism=4).fit(rows)


def fit_soft_labels(df: DataFrame, features: str = "features", soft: str = "soft_labels", rounds: int = 20):
    """Multinomial regression on every class of a row with the class's probability as weight: soft cross-entropy."""
    from pyspark.ml.classification import LogisticRegression

    rows = df.select(features, F.posexplode(soft).alias("label", "weight")).where("weight > 0").withColumn("label", F.col("label").cast("double"))
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", family="multinomial", maxIter=rounds).fit(rows)


def macro_f1(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> float:
    """Mean of the classes' F1 without weights, over the classes that occur on either side; 0 for no rows."""
    cells = df.groupBy(F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()  # classes squared
    classes = {r["t"] for r in cells} | {r["p"] for r in cells}
    scores = []
    for k in classes:
        hit = sum(r["n"] for r in cells if r["t"] == k == r["p"])
        both = sum(r["n"] * ((r["t"] == k) + (r["p"] == k)) for r in cells)
        scores.append(2 * hit / both if both else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def fourier_features(df: DataFrame, features: str, gamma: float, size: int = 128, seed: int = 42) -> DataFrame:
    """``features`` as random Fourier features of a radial kernel, so a linear model on them stands for that kernel."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    width = len(df.select(vector_to_array(features)).head()[0])
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(0, (2 * gamma) ** 0.5, (width, size)), rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def spread(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_list()) if len(values) else np.empty((0, width))
        return pd.Series(list((2 / size) ** 0.5 * np.cos(x @ turn + shift)))

    return df.withColumn(features, as_vector(spread(vector_to_array(features))))


def kernel_gamma(df: DataFrame, features: str, name: str) -> float:
    """``scale`` is 1 / (width x variance of all values), ``auto`` 1 / width."""
    from pyspark.ml.functions import vector_to_array

    row = df.select(F.size(vector_to_array(features)).alias("w"), F.explode(vector_to_array(features)).alias("x")).agg(F.max("w").alias("w"), F.var_pop("x").alias("v")).head()
    return 1.0 / (row["w"] * row["v"]) if name == "scale" and row["v"] else 1.0 / row["w"]


def grid_search(df: DataFrame, cs: tuple = (0.1, 1, 10), kernels: tuple = ("rbf", "linear"), gammas: tuple = ("scale", "auto"), folds: int = 3, key: str = "id", rounds: int = 10) -> list[dict]:
    """Settings with their mean macro F1 over ``folds`` folds, the best first; folds come from a hash of ``key``.

    With one fold a fifth of the rows is held out instead. Linear kernels do not depend on gamma and are fitted once.
    """
    part = F.pmod(F.xxhash64(F.lit(42), key), F.lit(folds if folds > 1 else 5))
    shapes = [("linear", None)] * ("linear" in kernels) + [("rbf", g) for g in gammas if "rbf" in kernels]
    out = []
    for kernel, name in shapes:
        rows = df if kernel == "linear" else fourier_features(df, "features", kernel_gamma(df, "features", name))
        rows = rows.select(key, "label", "features", part.alias("_fold")).persist()
        for c in cs:
            scores = []
            for fold in range(folds):
                model = fit_linear_svm(rows.where(F.col("_fold") != fold).select("label", "features"), rounds=rounds, c=c)
                scores.append(macro_f1(model.transform(rows.where(F.col("_fold") == fold))))
            out.append({"kernel": kernel, "gamma": name, "c": c, "f1_macro": sum(scores) / len(scores)})
        rows.unpersist()
    return sorted(out, key=lambda r: (-r["f1_macro"], r["kernel"], r["gamma"] or "", r["c"]))


def fit_platt(scored: DataFrame, raw: str = "rawPrediction", label: str = "label", rounds: int = 50):
    """Probabilities from the margins of a fitted classifier: a multinomial regression on them, for two classes the sigmoid."""
    from pyspark.ml.classification import LogisticRegression

    rows = scored.select(F.col(raw), F.col(label).cast("double").alias(label))
    return LogisticRegression(featuresCol=raw, labelCol=label, rawPredictionCol="plattRaw", predictionCol="plattPrediction", maxIter=rounds).fit(rows)


def score_batches(df: DataFrame, scorer: Callable[[list[str]], list[str]], text: str = "text", key: str = "id", batch: int = 8, workers: int | None = None, pause: float = 0.0) -> DataFrame:
    """``id, output`` of a scorer called per batch in Arrow workers; a row it fails on gets a null output.

    With ``workers`` the rows are spread over so many tasks, and each task waits ``pause`` seconds
    after a call: a service then sees at most ``workers / pause`` calls a second.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outputs: list = []
            texts = frame[text].fillna("").tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    outputs.extend(scorer(part))
                except Exception:  # noqa: BLE001 - one bad batch must not end the job
                    outputs.extend([None] * len(part))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame({key: frame[key], "output": outputs})

    rows = df.select(key, text)
    # a number that is asked for is not merged by adaptive execution
    rows = rows.repartition(workers) if workers else rows
    return rows.mapInPandas(run, f"{key} string, output string")


def stub_scorer(texts: list[str]) -> list[str]:
    """Deterministic offline stand-in for a language model."""
    return [f'{{"negative": {len(t) % 7}, "neutral": {len(t) % 5}, "positive": {len(t) % 3 + 1}}}' for t in texts]


def best_of_grid(df: DataFrame, score: str, names: list[str]) -> DataFrame:
    """The row of the largest score; of equal ones the first by name."""
    return ranked_grid(df, score, names).limit(1)


def ranked_grid(df: DataFrame, score: str, names: list[str]) -> DataFrame:
    """All settings, the largest score first and equal ones by name."""
    return df.orderBy(F.desc(score), *names)


def time_batches(scorer: Callable[[list[str]], list[str]], texts: list[str], sizes: tuple[int, ...] = (1, 8, 16), warm: int = 2) -> list[tuple[int, int, float]]:
    """``(batch size, batch number, milliseconds)`` of a scorer over full batches, after some warm-up calls."""
    for _ in range(warm):
        scorer(texts[: sizes[0]])
    out = []
    for size in sizes:
        for i in range(len(texts) // size):
            began = time.perf_counter()
            scorer(texts[i * size : (i + 1) * size])
            out.append((size, i, (time.perf_counter() - began) * 1000))
    return out


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)

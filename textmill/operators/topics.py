"""Topic models over token tables: mixture model scoring and fitting, topic words, coherence, LDA."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.runtime import checkpoint, stored
from textmill.schemas import SEEDS_NEGATIVE, SEEDS_NEUTRAL, SEEDS_POSITIVE


def doc_words(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``doc, word, c`` of documents with tokens."""
    return df.select(F.col(doc).alias("doc"), F.explode(tokens).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("c"))


def cluster_words(words: DataFrame, assigned: DataFrame) -> DataFrame:
    """``cluster, word, n``."""
    return words.join(assigned, "doc").groupBy("cluster", "word").agg(F.sum("c").alias("n"))


def mixture_scores(words: DataFrame, counts: DataFrame, sizes: DataFrame, vocabulary: int, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """``doc, cluster, score``: ln(n_k + alpha) + sum of ln((n_kw + beta) / (n_k. + V beta)) over the document's words.

    ``sizes(cluster, docs, tokens)`` has a row per cluster (tens) and is read by the driver. A word's
    counts in all clusters are one row, so a document's words are joined once, whatever the number
    of clusters, and summed cluster by cluster.
    """
    eps = 1e-10
    known = sorted((r["cluster"], r["docs"], r["tokens"]) for r in sizes.collect())
    per_word = counts.groupBy("word").agg(*(F.sum(F.when(F.col("cluster") == k, F.col("n"))).alias(f"n{k}") for k, _, _ in known))
    term = lambda k, tokens: F.log((F.coalesce(f"n{k}", F.lit(0)) + beta) / (tokens + vocabulary * beta) + eps)
    sums = words.join(per_word, "word", "left").groupBy("doc").agg(*(F.sum(F.col("c") * term(k, tokens)).alias(f"ll{k}") for k, _, tokens in known))
    cells = F.array(*(F.struct(F.lit(k).alias("cluster"), (F.lit(math.log(docs + alpha + eps)) + F.col(f"ll{k}")).alias("score")) for k, docs, _ in known))
    return sums.select("doc", F.explode(cells).alias("x")).select("doc", "x.cluster", "x.score")


def sampled_cluster(scores: DataFrame, seed: int = 1) -> DataFrame:
    """``doc, cluster`` drawn with the probabilities that the scores stand for: the largest score after Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc", "cluster"), 11) + 0.5) / F.lit(float(1 << 53))
    return best_cluster(scores.withColumn("score", F.col("score") - F.log(-F.log(u))))


def predict_mixture(docs: DataFrame, words: DataFrame, counts: DataFrame, sizes: DataFrame, vocabulary: int, seed: int | None = None) -> DataFrame:
    """``doc, cluster`` for every row of ``docs``: the best cluster, or with a ``seed`` a drawn one; -1 without words."""
    scores = mixture_scores(words, counts, sizes, vocabulary)
    found = best_cluster(scores) if seed is None else sampled_cluster(scores, seed)
    return docs.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def fit_gibbs(docs: DataFrame, clusters: int = 15, iterations: int = 50, alpha: float = 0.1, beta: float = 0.1, seed: int = 1, most_docs: int = 20_000) -> DataFrame:
    """``doc, cluster`` by collapsed Gibbs sampling, document after document, for ``docs(doc, tokens)``.

    The sampler is sequential, so it takes one group: at most ``most_docs`` documents, those of the
    smallest hashes. Give the rest their clusters by ``predict_mixture``. Documents without words get -1.
    """
    import numpy as np

    sample = docs.orderBy(F.xxhash64(F.lit(seed), "doc"), "doc").limit(most_docs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc")
        rng = np.random.default_rng(seed)
        held = [list(t) for t in pdf["tokens"]]
        ids = {w: i for i, w in enumerate(sorted({w for t in held for w in t}))}
        texts = [np.array([ids[w] for w in t], np.int64) for t in held]
        beta_all = len(ids) * beta
        mine = rng.integers(0, clusters, len(texts))
        docs_in, words_in, table = np.zeros(clusters), np.zeros(clusters), np.zeros((clusters, max(len(ids), 1)))
        filled = [i for i, t in enumerate(texts) if len(t)]

        def move(i: int, step: int) -> None:
            docs_in[mine[i]] += step
            words_in[mine[i]] += step * len(texts[i])
            np.add.at(table[mine[i]], texts[i], step)

        for i in range(len(texts)):
            move(i, 1)
        for _ in range(iterations):
            for i in filled:
                move(i, -1)
                logs = np.log(docs_in + alpha + 1e-10) + np.log((table[:, texts[i]] + beta) / (words_in + beta_all)[:, None] + 1e-10).sum(1)
                chances = np.exp(logs - logs.max())
                mine[i] = rng.choice(clusters, p=chances / chances.sum())
                move(i, 1)
        out = np.where([len(t) > 0 for t in texts], mine, -1)
        return pd.DataFrame({"doc": pdf["doc"], "cluster": out.astype("int32")})

    kind = docs.schema["doc"].dataType.simpleString()
    return sample.select("doc", "tokens", F.lit(0).alias("_group")).groupBy("_group").applyInPandas(run, f"doc {kind}, cluster int")


def best_cluster(scores: DataFrame) -> DataFrame:
    """Cluster of the largest score, the smaller number of equal ones."""
    top = F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("cluster")).alias("k"))).alias("m")
    return scores.groupBy("doc").agg(top).select("doc", (-F.col("m.k")).cast("int").alias("cluster"))


def cluster_sizes(words: DataFrame, assigned: DataFrame, clusters: int) -> DataFrame:
    spark = words.sparkSession
    docs = assigned.groupBy("cluster").agg(F.count("*").alias("docs"))
    tokens = words.join(assigned, "doc").groupBy("cluster").agg(F.sum("c").alias("tokens"))
    every = spark.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    return every.join(docs, "cluster", "left").join(tokens, "cluster", "left").select("cluster", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def fit_mixture(words: DataFrame, clusters: int = 15, rounds: int = 5, seed: int = 1) -> DataFrame:
    """``doc, cluster`` after some rounds of batch reassignment; each round is stored, so lineage stays short."""
    docs = words.select("doc").distinct()
    size = words.select("word").distinct().count()
    assigned = checkpoint(docs.withColumn("cluster", F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(clusters)).cast("int")))
    for _ in range(rounds):
        sizes = cluster_sizes(words, assigned, clusters)
        assigned = checkpoint(best_cluster(mixture_scores(words, cluster_words(words, assigned), sizes, size)))
    return assigned


def topic_words(counts: DataFrame, vocabulary: int, top: int = 10, beta: float = 0.1) -> DataFrame:
    """``cluster, word, prob, rank``: the most probable words of each cluster, ties by word."""
    total = F.sum("n").over(Window.partitionBy("cluster"))
    rows = counts.withColumn("prob", F.round((F.col("n") + beta) / (total + vocabulary * beta), 9))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("prob"), "word"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "word", "prob", "rank")


def cluster_sentiment(words: DataFrame) -> DataFrame:
    """``cluster, label``: the class whose seed words meet most of the cluster's words; the first of equal ones."""
    hit = lambda seeds: F.size(F.array_intersect(F.col("ws"), F.array(*map(F.lit, seeds))))
    got = words.groupBy("cluster").agg(F.collect_set("word").alias("ws"))  # at most the top words of a cluster
    scores = F.array(hit(SEEDS_NEGATIVE), hit(SEEDS_NEUTRAL), hit(SEEDS_POSITIVE))
    return got.select("cluster", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("label"))


def cluster_labels(top: DataFrame, assigned: DataFrame, tokens: DataFrame, clusters: int, looked: int = 50) -> DataFrame:
    """``cluster, label`` for every cluster: seed words among its top words, and a tenth for each negative and positive
    seed word in its first ``looked`` documents (by ``doc``); the first of equal classes, 1 for a cluster without words.

    ``tokens(doc, word)`` holds the documents' words. Seed words are joined first, so only hits are counted.
    """
    spark = top.sparkSession
    seeds = [(w, i, 1 if i == 1 else 2) for i, ws in enumerate((SEEDS_NEGATIVE, SEEDS_NEUTRAL, SEEDS_POSITIVE)) for w in ws]
    seeds = F.broadcast(spark.createDataFrame(seeds, "word string, class int, kind int"))
    by_words = top.select("cluster", "word").distinct().join(seeds, "word").groupBy("cluster", "class").agg(F.count("word").cast("double").alias("s"))
    first = assigned.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("doc"))).where(F.col("_r") <= looked)
    hits = tokens.select("doc", "word").distinct().join(seeds.where("kind = 2"), "word").join(first.select("doc", "cluster"), "doc")
    by_texts = hits.groupBy("cluster", "class").agg((F.count("word") * F.lit(0.1)).alias("s"))
    scores = by_words.union(by_texts).groupBy("cluster", "class").agg(F.round(F.sum("s"), 6).alias("s"))
    best = scores.groupBy("cluster").agg(F.max(F.struct("s", (-F.col("class")).alias("k"))).alias("m")).select("cluster", (-F.col("m.k")).cast("int").alias("label"))
    have = top.select("cluster").distinct().withColumn("_have", F.lit(0))
    every = spark.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    # a cluster with words but no hit scores 0 in all classes, and the first of them is 0
    return every.join(best, "cluster", "left").join(have, "cluster", "left").select("cluster", F.coalesce("label", "_have", F.lit(1)).cast("int").alias("label"))


def _window_counts(listed: list[str], tokens: DataFrame, size: int) -> DataFrame:
    """``wa, wb, kk``: sliding windows of ``size`` tokens that hold both of two ``listed`` words, ``wa <= wb``; all windows in the row of nulls.

    Each row of ``tokens(tokens)`` is a document. Neither windows nor places become rows: a place
    stands in a run of windows, and between two ends of runs all windows hold the same listed words,
    so a batch of documents is counted stretch by stretch, and a task gives one row for two words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = sorted(listed)
    wide = 8192  # stretches counted at once

    def run(batches):
        held, windows = np.zeros((len(names), len(names))), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            edges = column.offsets.to_numpy().astype(np.int64)
            words = column.values.slice(edges[0], edges[-1] - edges[0])
            edges -= edges[0]
            last = np.maximum(np.diff(edges) - size, 0)
            first = np.append(0, np.cumsum(last + 1))  # of each document's windows
            windows += int(first[-1])
            found = pc.index_in(words, value_set=pa.array(names, words.type), skip_nulls=True)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            word = found.drop_null().to_numpy()
            doc = np.searchsorted(edges, at, "right") - 1
            place = at - edges[doc]
            begin, end = first[doc] + np.maximum(place - size + 1, 0), first[doc] + np.minimum(place, last[doc]) + 1
            cuts = np.unique(np.concatenate([begin, end]))
            lengths = np.diff(cuts).astype(float)
            begin, end = np.searchsorted(cuts, begin), np.searchsorted(cuts, end)
            for left in range(0, len(lengths), wide):
                weight = lengths[left : left + wide]
                own = slice(np.searchsorted(end, left, "right"), np.searchsorted(begin, left + len(weight)))
                steps = np.zeros((len(names), len(weight) + 1))
                np.add.at(steps, (word[own], np.maximum(begin[own] - left, 0)), 1)
                np.add.at(steps, (word[own], np.minimum(end[own] - left, len(weight))), -1)
                there = (np.cumsum(steps[:, :-1], axis=1) > 0).astype(float)
                held += (there * weight) @ there.T
        a, b = np.nonzero(np.triu(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(names[i] for i in a)], pa.string()), pa.array([None, *(names[i] for i in b)], pa.string()), pa.array([windows, *held[a, b].astype(np.int64).tolist()], pa.int64())],
            names=["wa", "wb", "kk"],
        )

    parts = tokens.select("tokens").where(F.size("tokens") > 0).mapInArrow(run, "wa string, wb string, kk long")
    return stored(parts.groupBy("wa", "wb").agg(F.sum("kk").alias("kk")))


def _pair_measures(top: DataFrame, tokens: DataFrame, size: int) -> DataFrame:
    """``cluster, wi, wj, ki, kj, kij, windows`` for all ordered pairs of a cluster's top words, a word with itself included."""
    # stored, as the steps that made the top words are long and would run again behind every use
    listed = stored(top.select("cluster", "word").where("word IS NOT NULL").distinct())
    counts = _window_counts([r["word"] for r in listed.select("word").distinct().collect()], tokens, size)  # at most clusters x top
    single = counts.where("wa = wb").select(F.col("wa").alias("word"), F.col("kk").alias("k"))
    whole = counts.where("wa IS NULL").select(F.col("kk").alias("windows"))
    pairs = listed.select("cluster", F.col("word").alias("wi")).join(listed.select("cluster", F.col("word").alias("wj")), "cluster")
    pairs = pairs.withColumn("wa", F.least("wi", "wj")).withColumn("wb", F.greatest("wi", "wj"))
    pairs = pairs.join(counts, ["wa", "wb"], "left").join(single.select(F.col("word").alias("wi"), F.col("k").alias("ki")), "wi").join(single.select(F.col("word").alias("wj"), F.col("k").alias("kj")), "wj")
    return pairs.withColumn("kij", F.coalesce("kk", F.lit(0))).join(F.broadcast(whole))


def coherence_uci(top: DataFrame, tokens: DataFrame, size: int = 10) -> DataFrame:
    """``cluster, c_uci``: mean pointwise mutual information of the cluster's word pairs over sliding windows."""
    n, eps = F.col("windows"), 1e-12
    pmi = F.log((F.col("kij") / n + eps) / (F.col("ki") / n * F.col("kj") / n))
    return _pair_measures(top, tokens, size).where("wi < wj").groupBy("cluster").agg(F.round(F.avg(pmi), 6).alias("c_uci"))


def coherence_cv(top: DataFrame, tokens: DataFrame, size: int = 110) -> DataFrame:
    """``cluster, c_v``: mean cosine of each top word's vector of normalised mutual information with the sum of the cluster's vectors."""
    n, eps = F.col("windows"), 1e-12
    joint = F.col("kij") / n
    npmi = F.log((joint + eps) / (F.col("ki") / n * F.col("kj") / n)) / -F.log(joint + eps)
    cells = _pair_measures(top, tokens, size).select("cluster", "wi", "wj", npmi.alias("v"))
    cells = cells.withColumn("total", F.sum("v").over(Window.partitionBy("cluster", "wj")))
    dot, a, b = F.sum(F.col("v") * F.col("total")), F.sqrt(F.sum(F.col("v") * F.col("v"))), F.sqrt(F.sum(F.col("total") * F.col("total")))
    per = cells.groupBy("cluster", "wi").agg(F.coalesce(F.try_divide(dot, a * b), F.lit(0.0)).alias("cos"))
    return per.groupBy("cluster").agg(F.round(F.avg("cos"), 6).alias("c_v"))


def coherence_umass(top: DataFrame, words: DataFrame) -> DataFrame:
    """``cluster, u_mass``: mean of ln((D(a, b) + 1) / D(b)) over the cluster's word pairs, b ranked before a."""
    listed = top.select("cluster", "word", "rank")
    a = listed.select("cluster", F.col("word").alias("wa"), F.col("rank").alias("ra"))
    b = listed.select("cluster", F.col("word").alias("wb"), F.col("rank").alias("rb"))
    pairs = a.join(b, "cluster").where("rb < ra")
    wanted = listed.select("word").distinct()
    have = words.join(F.broadcast(wanted), "word").select("doc", "word").distinct()
    single = have.groupBy("word").agg(F.count("*").alias("d"))
    # per document its top words only (at most clusters x top), never all of its words
    both = have.alias("x").join(have.alias("y"), "doc").select(F.col("x.word").alias("wa"), F.col("y.word").alias("wb")).groupBy("wa", "wb").agg(F.count("*").alias("dd"))
    rows = pairs.join(both, ["wa", "wb"], "left").join(single.select(F.col("word").alias("wb"), "d"), "wb")
    return rows.groupBy("cluster").agg(F.round(F.avg(F.log((F.coalesce("dd", F.lit(0)) + 1) / F.col("d"))), 6).alias("u_mass"))


def coherence_npmi(top: DataFrame, words: DataFrame) -> DataFrame:
    """``cluster, npmi``: mean normalised pointwise mutual information of the cluster's word pairs over documents."""
    n_docs = words.select(F.countDistinct("doc").alias("n"))
    listed = top.select("cluster", "word", "rank")
    have = words.join(F.broadcast(listed.select("word").distinct()), "word").select("doc", "word").distinct()
    single = have.groupBy("word").agg(F.count("*").alias("d"))
    both = have.alias("x").join(have.alias("y"), "doc").where("x.word < y.word").select(F.col("x.word").alias("wa"), F.col("y.word").alias("wb")).groupBy("wa", "wb").agg(F.count("*").alias("dd"))
    a = listed.select("cluster", F.col("word").alias("wa"))
    b = listed.select("cluster", F.col("word").alias("wb"))
    pairs = a.join(b, "cluster").where("wa < wb").join(both, ["wa", "wb"], "left")
    pairs = pairs.join(single.select(F.col("word").alias("wa"), F.col("d").alias("da")), "wa").join(single.select(F.col("word").alias("wb"), F.col("d").alias("db")), "wb").join(F.broadcast(n_docs))
    joint = F.col("dd") / F.col("n")
    score = F.when(F.col("dd").isNull(), -1.0).when(joint == 1, 1.0).otherwise(F.log(joint * F.col("n") * F.col("n") / (F.col("da") * F.col("db"))) / -F.log(joint))
    return pairs.groupBy("cluster").agg(F.round(F.avg(score), 6).alias("npmi"))


def dominant_topic(distribution: Column) -> Column:
    """``struct(topic, prob)`` of the largest share; (-1, 0) for an empty or null distribution."""
    top = F.array_max(distribution)
    return F.struct(F.coalesce(F.array_position(distribution, top).cast("int") - 1, F.lit(-1)).alias("topic"), F.coalesce(top, F.lit(0.0)).alias("prob"))


def lda(df: DataFrame, doc: str, tokens: Column, topics: int = 15, iterations: int = 15, min_df: int = 2, max_df: float = 0.9):
    """Fitted pipeline of counts and online LDA."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rows = df.select(F.col(doc).alias("doc"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    model = Pipeline(stages=[CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, maxDF=max_df), LDA(k=topics, maxIter=iterations, optimizer="online", seed=42)]).fit(rows)
    return model, model.transform(rows)


def lda_topics(model, top: int = 10) -> DataFrame:
    """``topic, rank, word, weight`` of a fitted pipeline's topics."""
    words = model.stages[0].vocabulary
    rows = model.stages[1].describeTopics(top)
    entry = F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")
    names = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")  # bounded by the vocabulary kept
    return rows.select("topic", entry).select("topic", (F.col("rank") + 1).alias("rank"), F.get(names, F.col("t.termIndices")).alias("word"), F.col("t.termWeights").alias("weight"))


def lda_summary(model, rows: DataFrame) -> dict:
    """Number of topics, words and documents, and log perplexity on ``rows``."""
    fitted = model.stages[1]
    return {"topics": fitted.getK(), "vocabulary": len(model.stages[0].vocabulary), "documents": rows.count(), "log_perplexity": fitted.logPerplexity(rows)}


def perplexity_bound(log_likelihood: float, tokens: int) -> float:
    return math.exp(-log_likelihood / max(tokens, 1))

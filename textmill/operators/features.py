"""Token features: vocabulary, TF-IDF, padding and masking of id arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions.bind import bind
from textmill.runtime import checkpoint


def sklearn_tokens(text: Column) -> Column:
    """Lower-case words of two signs and more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then each two neighbours joined by a blank."""

    def add(words: Column) -> Column:
        later = F.slice(words, F.lit(2), F.size(words))
        earlier = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        return F.concat(words, F.zip_with(earlier, later, lambda a, b: F.concat_ws(" ", a, b)))

    return bind(tokens, add)


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """``word, word_id``: distinct words in order, numbered from 0 without a global sort."""
    words = df.select(F.explode(tokens).alias("word")).distinct()
    # stored, as a second run of the range exchange may draw other bounds
    ranged = checkpoint(words.repartitionByRange("word").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    place = F.col("_s") + F.row_number().over(Window.partitionBy("_p").orderBy("word")) - 1
    return ranged.join(F.broadcast(starts), "_p").select("word", place.alias("word_id"))


def tfidf(df: DataFrame, doc: str, terms: Column, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """``doc, term, weight``: (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), each document scaled to length 1.

    Terms outside the document-frequency range are dropped, then the most frequent are kept.
    The kept terms are at most ``max_features`` rows, so they are broadcast.
    """
    rows = df.select(F.col(doc).alias("doc"), F.explode(terms).alias("term"))
    tf = rows.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    docs = df.agg(F.countDistinct(doc).alias("n_docs"))
    kept = stats.join(F.broadcast(docs)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
    kept = kept.orderBy(F.desc("cf"), "term").limit(max_features).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    raw = tf.join(F.broadcast(kept.select("term", "idf")), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("weight"))


def pad_right(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def pad_to_batch(df: DataFrame, ids: str, batch: Column, pad: int = 0) -> DataFrame:
    """Id arrays padded to the longest of their batch."""
    rows = df.withColumn("batch", batch)
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    return rows.withColumn("padded", pad_right(F.col(ids), longest, pad))


def masked_labels(ids: Column, prefix: Column, limit: int = 512) -> Column:
    """-100 for the prompt's ``prefix`` ids, then the ids, cut at ``limit``."""

    def mask(x: Column) -> Column:
        k = F.least(prefix, F.size(x)).cast("int")
        return F.slice(F.concat(F.array_repeat(F.lit(-100), k), F.slice(x, k + 1, F.greatest(F.size(x), F.lit(1)))), 1, limit)

    return bind(ids, mask)


def fixed_length(ids: Column, length: int = 256, pad: int = 0) -> Column:
    """``struct(input_ids, attention_mask)`` cut and padded to one length."""

    def pad_both(cut: Column) -> Column:
        return F.struct(
            pad_right(cut, F.lit(length), pad).alias("input_ids"),
            pad_right(F.transform(cut, lambda x: F.lit(1)), F.lit(length), 0).alias("attention_mask"),
        )

    return bind(F.slice(ids, 1, length), pad_both)


def subword_ids(text: Column, tokenizer: str) -> Column:
    """Ids of a subword tokenizer's file (``.json`` of a tokenizers library, or ``.model`` of a sentence-piece one), read once per worker.

    Special signs in the text are ordinary text. Null gives an empty list.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _tokenizer(tokenizer)
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    return run(text)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [model.encode(t) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def subword_label_place(text: Column, needle: str, tokenizer: str, label_ids: Column, limit: int = 512) -> Column:
    """Token index of the label behind the last ``needle``: the number of ids of what stands before it, if that is below
    the number of ids (at most ``limit``) and the id there is one of ``label_ids``; else -1."""
    before = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, needle, -1)))
    both = F.struct(F.slice(subword_ids(text, tokenizer), 1, limit).alias("ids"), F.size(subword_ids(before, tokenizer)).alias("at"))
    found = lambda x: F.when(F.array_contains(label_ids, F.get(x["ids"], x["at"])), x["at"]).otherwise(-1)
    return F.when(text.contains(needle), bind(both, found)).otherwise(-1)


def label_token_place(text: Column, needle: str, tokens: Column) -> Column:
    """Token index of the sign after the last ``needle``, for tokens that are split at blanks; -1 if it is none of 0, 1, 2."""
    at = F.length(F.substring_index(text, needle, -1))
    before = F.substring(text, F.lit(1), F.length(text) - at)
    place = F.size(F.filter(F.split(before, r"\s+"), lambda x: F.length(x) > 0))
    token = F.get(tokens, place)
    return F.when(text.contains(needle) & F.coalesce(token.rlike("^[012]"), F.lit(False)), place).otherwise(-1)

"""Sources: files with explicit schemas, projected to the record model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textmill.functions.probs import argmax, default_soft
from textmill.functions.records import blank_to_null, has_text, rating_to_label, truncated_int, valid_label, valid_rating
from textmill.functions.text import strip
from textmill.schemas import RAW_RECORD

#: Column names of known dataset layouts; a new layout is a new entry. ``path`` may hold the places
#: ``{language}`` and ``{category}``; ``unknown_label`` is the label of rows whose rating is none of 1..5.
LAYOUTS = {
    "reviews": {"path": "{root}/reviews_{language}", "text": "review_body", "rating": "stars", "product_id": "product_id", "category": "product_category"},
    "yelp": {"path": "{root}/yelp", "text": "text", "rating": "label", "product_id": None, "category": None},
    "mcauley": {"path": "{root}/raw_review_{category}", "text": "text", "rating": "rating", "product_id": "parent_asin", "category": None, "unknown_label": 1},
}


def layout_path(layout: str, root: str, language: str = "", category: str = "") -> str:
    """Where a layout's files lie, with its places filled in."""
    return LAYOUTS[layout]["path"].format(root=root.rstrip("/"), language=language, category=category)


def read_layout(spark: SparkSession, layout: str, root: str, language: str, source: str, category: str = "") -> DataFrame:
    """Raw records of a layout's JSON files; a language or category picks the folder, so nothing else is read."""
    path = layout_path(layout, root, language, category)
    names = LAYOUTS[layout]
    columns = ", ".join(f"`{names[k]}` string" for k in ("text", "rating", "product_id", "category") if names.get(k))
    return project(spark.read.schema(columns).json(path), layout, language, source)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array, or JSON lines if the name ends in ``.jsonl``; bad lines become null rows and are dropped."""
    lines = path.endswith(".jsonl")
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    return df.dropna(how="all")


def read_wrapped(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows under the key ``data`` of one JSON object; ``item`` is the DDL of a row."""
    df = spark.read.schema(f"data array<struct<{item}>>").option("multiLine", True).json(path)
    return df.select(F.explode("data").alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with header; all columns as text, chosen by name."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*columns)


def read_splits(spark: SparkSession, folder: str, splits: list[str], schema: T.StructType | str) -> DataFrame:
    """``{split}.jsonl`` files with ``split`` and ``id``, the split's name and the row's place in its file from 0.

    Rows keep their order inside a block of a file; blocks are counted and a prefix sum over the
    short table of counts gives each its start, so a file is numbered in parts.
    """
    parts = [read_json(spark, f"{folder}/{s}.jsonl", schema).select("*", "_metadata.file_path", "_metadata.file_block_start").withColumn("split", F.lit(s)) for s in splits]
    every = reduce(DataFrame.unionByName, parts).withColumn("_row", F.monotonically_increasing_id())
    block = ["split", "file_path", "file_block_start"]
    before = Window.partitionBy("split").orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.groupBy(*block).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_row"))
    placed = every.join(starts, block).withColumn("_place", F.col("_before") + inside - 1)
    return placed.withColumn("id", F.concat_ws("_", "split", F.col("_place").cast("string"))).drop("file_path", "file_block_start", "_row", "_before", "_place")


def project(df: DataFrame, layout: str, language: str, source: str) -> DataFrame:
    """Rows of a known layout as raw records; rows without text or a rating are dropped, and those with a rating out of
    1..5 too unless the layout gives them a label.

    An id is the hash of the row's content and its place in the plan's partitions, so a task that is
    run again gives the same ids and equal rows stay apart.
    """
    names = LAYOUTS[layout]
    pick = lambda k: F.col(names[k]).cast("string") if names[k] and names[k] in df.columns else F.lit(None).cast("string")
    stars = truncated_int(pick("rating"))
    rating = valid_rating(stars)
    unknown = names.get("unknown_label")
    label = F.coalesce(rating_to_label(rating), F.lit(unknown)) if unknown is not None else rating_to_label(rating)
    content = F.md5(F.concat_ws("\u0001", F.lit(source), F.lit(language), *(F.coalesce(pick(k), F.lit("")) for k in ("text", "rating", "product_id", "category"))))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).select(
        F.concat_ws("-", content, F.col("_row").cast("string")).alias("id"), F.lit(language).alias("language"), F.lit(source).alias("source"), strip(pick("text")).alias("original_text"),
        F.when(stars.isNotNull(), label).alias("sentiment_label"), rating.alias("rating"), blank_to_null(pick("product_id")).alias("product_id"),
        blank_to_null(pick("category")).alias("category"), F.current_timestamp().alias("created_at"),
    )
    return rows.where(has_text(F.col("original_text")) & F.col("sentiment_label").isNotNull()).select(*[f.name for f in RAW_RECORD])


def csv_records(df: DataFrame, text: str, label: str | None, rating: str | None) -> DataFrame:
    """``text, label, rating``: the label column first, else the rating's label; rows with neither are dropped."""
    r = valid_rating(truncated_int(F.col(rating))) if rating else F.lit(None).cast("int")
    direct = valid_label(truncated_int(F.col(label))) if label else F.lit(None).cast("int")
    given = F.coalesce(direct, rating_to_label(r)) if label else rating_to_label(r)
    return df.select(strip(F.col(text)).alias("text"), given.alias("label"), r.alias("rating")).where(has_text(F.col("text")) & F.col("label").isNotNull())


def union_languages(parts: dict[str, DataFrame | Callable[[], DataFrame] | None]) -> DataFrame:
    """All languages' rows; a source may be a function that reads it, and one that cannot be read is left out."""
    found = []
    for part in parts.values():
        try:
            df = part() if callable(part) else part
            if df is not None:
                df.schema  # noqa: B018 - a missing file shows here
                found.append(df)
        except AnalysisException:
            continue
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def coalesce_label(df: DataFrame, names: tuple[str, ...] = ("ground_truth_label", "sentiment_label", "label", "output")) -> Column:
    """First label of the alternatives that are there, as a whole number."""
    return F.coalesce(*(F.col(n).cast("string").try_cast("int") for n in names if n in df.columns))


def soft_rows(df: DataFrame) -> DataFrame:
    """Annotation rows with the cleaned label and a split (``unknown`` where missing)."""
    return df.select("id", "text", argmax(F.col("probabilities")).alias("cleaned_label"), "probabilities", "confidence", F.coalesce("split", F.lit("unknown")).alias("original_split"))


def distillation_rows(df: DataFrame) -> DataFrame:
    """``text, label, soft_label, confidence`` from whichever names are there; empty texts count as missing."""
    have = lambda *names: [F.col(n) for n in names if n in df.columns]
    soft = default_soft(F.coalesce(*have("soft_label", "soft_labels")))
    text = F.coalesce(*(F.nullif(c, F.lit("")) for c in have("text", "input")), F.lit(""))
    return df.select(text.alias("text"), coalesce_label(df, ("label", "labels", "output")).alias("label"), soft.alias("soft_label"), F.array_max(soft).alias("confidence"))


def shuffled_take(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows of a seeded shuffle: a top-n, so each task keeps ``n`` rows at most."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}")))).limit(n)


def read_lines(spark: SparkSession, path: str, schema: str, n: int | None = None) -> DataFrame:
    """JSON lines where ``n`` counts lines, bad ones included; bad lines are dropped after the cut."""
    lines = spark.read.text(path)
    lines = lines.limit(n) if n is not None else lines
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*").dropna(how="all")


def truth_labels(df: DataFrame) -> DataFrame:
    """Rows with ``truth``, the first of the label names there; rows with none are skipped."""
    return df.withColumn("truth", coalesce_label(df)).where("truth IS NOT NULL")


def of_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; the filter reaches the scan, and prunes folders where they are split so."""
    return df.where(F.col("split") == split)


def labelled_text(df: DataFrame, original: bool = False) -> DataFrame:
    """``text, label`` with the given label, or the cleaned one where the caller asks for it and it is there."""
    name = "label" if original or "cleaned_label" not in df.columns else "cleaned_label"
    return df.select("text", F.col(name).cast("int").alias("label"))


def has_soft_labels(df: DataFrame) -> bool:
    """Whether the first row carries soft labels; trainers fall back to hard ones otherwise."""
    if "soft_labels" not in df.columns:
        return False
    row = df.select("soft_labels").head()
    return row is not None and row["soft_labels"] is not None

"""Views over the document table that give it ratings, soft labels and model outputs, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.runtime import table

_REVIEWS = [
    "doc_id", "text", "lang", "source",
    "CAST(1 + (doc_id*7+3) % 5 AS INT) AS rating",
    "CASE WHEN 1+(doc_id*7+3)%5 <= 2 THEN 0 WHEN 1+(doc_id*7+3)%5 = 3 THEN 1 ELSE 2 END AS label",
    "CAST(1+(doc_id*13)%17 AS DOUBLE) AS wn", "CAST(1+(doc_id*5)%11 AS DOUBLE) AS wu", "CAST(1+(doc_id*3)%23 AS DOUBLE) AS wp",
]
_PRED = ["*", "CASE WHEN doc_id % 4 = 0 THEN (label+1)%3 ELSE label END AS pred", "wn/(wn+wu+wp) AS p0", "wu/(wn+wu+wp) AS p1", "wp/(wn+wu+wp) AS p2"]
_OUT = """CASE doc_id % 7
 WHEN 0 THEN concat('<|channel>thought', chr(10), 'why<channel|>', chr(10), '{"sentiment": ', pred, ', "confidence": 0.9, "rationale": "r"}<turn|>')
 WHEN 1 THEN concat('<thinking>', chr(10), 'why', chr(10), '</thinking>', chr(10), '{"sentiment": ', pred, ', "confidence": 0.8}')
 WHEN 2 THEN concat('<think>maybe "sentiment": 0</think>', chr(10), '{"sentiment": ', pred, '}')
 WHEN 3 THEN concat('und_b8 why und_b8 {"sentiment": ', pred, '}')
 WHEN 4 THEN concat('Answer: ', pred)
 WHEN 5 THEN concat('sentiment: ', pred, ', confidence: 0.7')
 ELSE 'no label here' END AS output"""

#: The same views as common table expressions for DuckDB.
SQL = (
    f"WITH v_reviews AS (SELECT {', '.join(_REVIEWS)} FROM documents), "
    f"v_pred AS (SELECT {', '.join(_PRED)} FROM v_reviews), "
    f"v_out AS (SELECT doc_id, label, pred AS said, {_OUT} FROM v_pred) "
)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_REVIEWS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).selectExpr(*_PRED)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).selectExpr("doc_id", "label", "pred AS said", _OUT)


def soft(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.array("p0", "p1", "p2"))

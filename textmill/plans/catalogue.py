"""All queries of the core library with their DuckDB statements.

Names follow the operator they show; the inventory's ids stand in the comments. Every query runs
over its whole tables. A query without a statement cannot be said in SQL and is tested against
brute force in ``tests``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.functions import parse, probs, records, text
from textmill.operators import chat, features, metrics, models, quality, reports, sampling, topics
from textmill.plans import views
from textmill.runtime import checkpoint, prefix_sum, shared_folder, stored, table
from textmill.schemas import CLASSIFIER_STOPWORDS_ZH, SEEDS_NEGATIVE, SEEDS_NEUTRAL, SEEDS_POSITIVE, STOPWORDS, STOPWORDS_EN
from textmill.sources import readers, sinks

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in dict.fromkeys(values)) + "]"


_DEFAULT = "coalesce(soft_labels, [0.33::DOUBLE, 0.33::DOUBLE, 0.34::DOUBLE])"
_CONF = f"list_max({_DEFAULT})"
_LABEL = "coalesce(label, hard_label, 1)"

# ---- records: PRJ-1..4, FLT-1..3, 6, 7, MTH-10 ----------------------------------------------


@query(
    "q_rating_to_label",
    "SELECT id, rating, CASE WHEN rating IN (1, 2) THEN 0 WHEN rating = 3 THEN 1 WHEN rating IN (4, 5) THEN 2 END AS label, "
    "CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS expected FROM raw_records",
)
def _(s, d):
    return table(s, d, "raw_records").select("id", "rating", records.rating_to_label(F.col("rating")).alias("label"), records.expected_label(F.col("rating")).alias("expected"))


@query(
    "q_length_category",
    "WITH x AS (SELECT id, word_count, length_category, CASE WHEN word_count <= 15 THEN 'short' WHEN word_count <= 50 THEN 'medium' ELSE 'long' END AS expected FROM processed_records) "
    "SELECT id, word_count, expected, length_category IS NOT DISTINCT FROM expected AS consistent FROM x",
)
def _(s, d):
    e = records.length_category(F.col("word_count"))
    return table(s, d, "processed_records").select("id", "word_count", e.alias("expected"), F.col("length_category").eqNullSafe(e).alias("consistent"))


@query(
    "q_valid_records",
    "SELECT id, trim(original_text) AS original_text, sentiment_label, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating, nullif(trim(product_id), '') AS product_id "
    "FROM raw_records WHERE coalesce(regexp_matches(original_text, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]'), false) AND sentiment_label IN (0, 1, 2)",
)
def _(s, d):
    df = table(s, d, "raw_records").where(records.has_text(F.col("original_text")) & F.col("sentiment_label").isin(0, 1, 2))
    return df.select("id", F.trim("original_text").alias("original_text"), "sentiment_label", records.valid_rating(F.col("rating")).alias("rating"), F.trim(records.blank_to_null(F.col("product_id"))).alias("product_id"))


@query(
    "q_soft_label_valid",
    "SELECT id, soft_label IS NULL OR (len(soft_label) = 3 AND len(list_filter(soft_label, lambda x: coalesce(x >= 0 AND x <= 1, false))) = 3 "
    "AND abs(list_sum(list_transform(soft_label, lambda x: coalesce(x, 0))) - 1) <= 1e-6) AS valid FROM processed_records",
)
def _(s, d):
    return table(s, d, "processed_records").select("id", records.valid_soft_label(F.col("soft_label")).alias("valid"))


@query(
    "q_preview",  # PRJ-19
    "SELECT id, substring(original_text, 1, 50) AS p50, substring(original_text, 1, 100) AS p100 FROM raw_records",
)
def _(s, d):
    return table(s, d, "raw_records").select("id", records.preview(F.col("original_text"), 50).alias("p50"), records.preview(F.col("original_text"), 100).alias("p100"))


# ---- quality reports: AGG-1..12, JSN-12, FLT-9..11 -------------------------------------------


@query("q_label_dist", f"WITH x AS (SELECT {_LABEL} AS label, count(*) AS n FROM train GROUP BY 1) SELECT label, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS pct FROM x")
def _(s, d):
    df = table(s, d, "train")
    return quality.distribution(df, quality.label_of(df), "label")


@query("q_rating_dist", "WITH x AS (SELECT coalesce(rating, 3) AS rating, count(*) AS n FROM train GROUP BY 1) SELECT rating, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS pct FROM x")
def _(s, d):
    return quality.distribution(table(s, d, "train"), F.coalesce("rating", F.lit(3)), "rating")


@query(
    "q_rating_agreement",
    "SELECT count(*) AS n, round(avg(CASE WHEN coalesce(label, 1) = CASE WHEN coalesce(rating, 3) <= 2 THEN 0 WHEN coalesce(rating, 3) = 3 THEN 1 ELSE 2 END THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS consistent_pct FROM train",
)
def _(s, d):
    return quality.rating_agreement(table(s, d, "train"))


@query(
    "q_balance_gap",
    f"WITH x AS (SELECT {_LABEL} AS label, count(*) AS n FROM train GROUP BY 1) SELECT c.label, coalesce(n, 0) AS n, 3000 - coalesce(n, 0) AS gap "
    "FROM (SELECT unnest([0, 1, 2])::INT AS label) c LEFT JOIN x ON x.label = c.label",
)
def _(s, d):
    return quality.balance_gap(table(s, d, "train"))


@query(
    "q_soft_mismatch",
    f"WITH x AS (SELECT (coalesce(nullif(list_position({_DEFAULT}, list_max({_DEFAULT})), 0) - 1, 2) <> {_LABEL})::INT AS bad FROM train) "
    "SELECT count(*) AS n, sum(bad)::BIGINT AS mismatches, round(avg(bad) * 100, 4) AS mismatch_pct, round(100 - avg(bad) * 100, 4) AS alignment_pct FROM x",
)
def _(s, d):
    return quality.soft_mismatch(table(s, d, "train"))


@query(
    "q_confidence_stats",
    f"WITH x AS (SELECT {_CONF} AS c FROM train) SELECT round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(min(c), 6) AS \"min\", round(max(c), 6) AS \"max\", "
    "count(*) FILTER (c < 0.6) AS low, round(count(*) FILTER (c < 0.6) * 100.0::DOUBLE / count(*), 4) AS low_pct FROM x",
)
def _(s, d):
    return quality.confidence_stats(table(s, d, "train"))


@query(
    "q_confidence_hist",
    f"WITH x AS (SELECT {_CONF} AS c FROM train), b(bucket, lo, hi) AS (VALUES ('0.5-0.6', 0.5, 0.6), ('0.6-0.7', 0.6, 0.7), ('0.7-0.8', 0.7, 0.8), ('0.8-0.9', 0.8, 0.9), ('0.9-1.0', 0.9, 1.0)) "
    "SELECT bucket, (SELECT count(*) FROM x WHERE c >= lo::DOUBLE AND c < hi::DOUBLE) AS n, round((SELECT count(*) FROM x WHERE c >= lo::DOUBLE AND c < hi::DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM x), 4) AS pct FROM b",
)
def _(s, d):
    return quality.confidence_histogram(table(s, d, "train"))


@query(
    "q_cot_coverage",
    "WITH x AS (SELECT coalesce(cot, '') AS c FROM train), y AS (SELECT count(*) AS n, sum((len(c) > 0)::INT)::BIGINT AS with_cot, "
    r"sum(regexp_matches(c, '(?i)(\\d星|星级|rating|给了|给.*分|star)')::INT)::BIGINT AS rating_mentioned FROM x) "
    "SELECT *, round(rating_mentioned * 100.0::DOUBLE / with_cot, 4) AS mentioned_pct FROM y",
)
def _(s, d):
    return quality.cot_coverage(table(s, d, "train"))


@query(
    "q_cot_coverage_chat",
    "WITH x AS (SELECT coalesce(list_filter(conversations, lambda m: m.role = 'assistant')[1].content, '') AS c FROM conversation_rows), "
    "y AS (SELECT count(*) AS n, sum((len(c) > 0)::INT)::BIGINT AS with_cot, "
    r"sum(regexp_matches(c, '(?i)(\\d星|星级|rating|给了|给.*分|star)')::INT)::BIGINT AS rating_mentioned FROM x) "
    "SELECT *, round(rating_mentioned * 100.0::DOUBLE / with_cot, 4) AS mentioned_pct FROM y",
)
def _(s, d):
    return quality.cot_coverage(table(s, d, "conversation_rows"))


@query(
    "q_rating_label_crosstab",
    f"WITH x AS (SELECT coalesce(rating, 3) AS rating, {_LABEL} AS label, count(*) AS n FROM train GROUP BY 1, 2) SELECT rating, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY rating), 4) AS row_pct FROM x",
)
def _(s, d):
    return quality.crosstab(table(s, d, "train"))


@query(
    "q_data_quality",
    "SELECT count(*) AS total, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2, count(*) FILTER (len(coalesce(cot, '')) = 0) AS missing_cot, "
    "count(*) FILTER (coalesce(len(soft_labels), 0) = 0) AS missing_soft, count(*) FILTER (label IS NULL) AS missing_label, round(avg(len(coalesce(cot, ''))), 4) AS avg_cot_length FROM train",
)
def _(s, d):
    return quality.data_quality(table(s, d, "train"))


@query("q_category_counts", "SELECT coalesce(nullif(category, ''), 'unknown') AS category, count(*) AS n FROM train GROUP BY 1")
def _(s, d):
    return table(s, d, "train").groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("q_low_confidence", f"SELECT id, round({_CONF}, 6) AS c FROM train WHERE {_CONF} < 0.7")
def _(s, d):
    c = probs.confidence(F.col("soft_labels"))
    return table(s, d, "train").where(c < 0.7).select("id", F.round(c, 6).alias("c"))


@query("q_contaminated", "SELECT id FROM soft_labels_reviewed WHERE contains(text, '<|im_')")
def _(s, d):
    return table(s, d, "soft_labels_reviewed").where(F.col("text").contains("<|im_")).select("id")


@query("q_cot_sample", "SELECT id, substring(coalesce(CASE WHEN json_valid(cot) THEN json_extract_string(cot, '$.reasoning') END, substring(cot, 1, 100)), 1, 80) AS sample FROM train")
def _(s, d):  # JSN-12
    return table(s, d, "train").select("id", F.substring(F.coalesce(F.get_json_object("cot", "$.reasoning"), F.substring("cot", 1, 100)), 1, 80).alias("sample"))


@query(
    "q_split_label_dist",  # AGG-15
    "SELECT split, hard_label AS label, count(*) AS n, grouping_id(split, hard_label)::INT AS level FROM soft_labels_reviewed GROUP BY ROLLUP (split, hard_label)",
)
def _(s, d):
    return quality.split_distribution(table(s, d, "soft_labels_reviewed"), F.col("split"), F.col("hard_label"))


@query(
    "q_rating_matrix",  # MAP-1: nested counts as one map per rating
    f"WITH x AS (SELECT coalesce(rating, 3) AS rating, {_LABEL} AS label, count(*) AS n FROM train GROUP BY 1, 2) "
    "SELECT rating, coalesce(sum(n) FILTER (label = 0), 0)::BIGINT AS label_0, coalesce(sum(n) FILTER (label = 1), 0)::BIGINT AS label_1, coalesce(sum(n) FILTER (label = 2), 0)::BIGINT AS label_2 FROM x GROUP BY 1",
)
def _(s, d):
    df = quality.crosstab(table(s, d, "train")).groupBy("rating").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    return df.select("rating", *(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long").alias(f"label_{k}") for k in (0, 1, 2)))


# ---- annotation: ARR-1..5, AGG-13..19, FLT-4, SET-1, 2, JOIN-2, 3 -----------------------------

_ARGMAX = "CASE WHEN list_position({p}, list_max({p})) > 0 THEN list_position({p}, list_max({p})) - 1 END"


@query("q_argmax", f"SELECT id, ({_ARGMAX.format(p='probabilities')})::INT AS top, list_max(probabilities) AS conf FROM soft_labels_reviewed")
def _(s, d):
    return table(s, d, "soft_labels_reviewed").select("id", probs.argmax(F.col("probabilities")).alias("top"), F.array_max("probabilities").alias("conf"))


@query(
    "q_normalize",
    views.SQL + "SELECT doc_id, round(coalesce(w, 0.33) / (coalesce(w, 0.33) + wu + wp), 9) AS neg, round(wu / (coalesce(w, 0.33) + wu + wp), 9) AS neu, round(wp / (coalesce(w, 0.33) + wu + wp), 9) AS pos "
    "FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE wn END AS w FROM v_reviews)",
)
def _(s, d):
    df = views.reviews(s, d).withColumn("w", F.when(F.col("doc_id") % 3 != 0, F.col("wn")))
    p = probs.normalize3(F.col("w"), F.col("wu"), F.col("wp"))
    return df.select("doc_id", p.alias("p")).select("doc_id", *(F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("neg", "neu", "pos"))))


_CAL = (
    "WITH x AS (SELECT id, hard_label, probabilities AS p, list_reverse_sort(probabilities) AS q FROM soft_labels_reviewed WHERE len(probabilities) = 3 AND len(list_filter(probabilities, lambda v: v IS NULL)) = 0), "
    f"y AS (SELECT id, hard_label, (CASE WHEN q[1] < 0.6 AND q[1] - q[2] < 0.2 THEN 1 ELSE {_ARGMAX.format(p='p')} END)::INT AS calibrated, q[1] < 0.6 AS is_uncertain, list_max(p) AS conf FROM x) "
)


def _calibrated(s, d):
    df = table(s, d, "soft_labels_reviewed").where((F.size("probabilities") == 3) & ~F.exists("probabilities", lambda x: x.isNull()))
    c = probs.calibrate_neutral(F.col("probabilities"))
    return df.select("id", "hard_label", c["label"].alias("calibrated"), c["is_uncertain"].alias("is_uncertain"), F.array_max("probabilities").alias("conf"))


@query("q_calibrate", _CAL + "SELECT id, calibrated, is_uncertain FROM y")
def _(s, d):
    return _calibrated(s, d).select("id", "calibrated", "is_uncertain")


@query("q_class_accuracy", _CAL + "SELECT hard_label AS label, count(*) AS n, round(avg((calibrated = hard_label)::INT), 6) AS calibrated_acc FROM y GROUP BY 1")
def _(s, d):
    return quality.class_accuracy(_calibrated(s, d), F.col("hard_label"), ("calibrated_acc", F.col("calibrated")))


@query("q_confidence_bands", _CAL + "SELECT CASE WHEN conf > 0.8 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM y GROUP BY 1")
def _(s, d):
    return quality.confidence_bands(_calibrated(s, d), F.col("conf"))


@query(
    "q_multi_sample_mean",
    views.SQL + "SELECT source, count(*) AS n_samples, round(avg(p0), 6) AS neg, round(avg(p1), 6) AS neu, round(avg(p2), 6) AS pos FROM v_pred GROUP BY 1",
)
def _(s, d):
    df = views.soft(views.predictions(s, d))
    return df.groupBy("source").agg(F.count("*").alias("n_samples"), *(F.round(F.avg(F.col("p")[i]), 6).alias(n) for i, n in enumerate(("neg", "neu", "pos"))))


_MERGE = (
    "WITH a AS (SELECT id, label AS predicted_label, confidence, 'Beauty' AS category, 0 AS file_no FROM train), b AS (SELECT id, hard_label AS predicted_label, confidence, 'Home' AS category, 1 AS file_no FROM soft_labels_reviewed), "
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(id, '') ORDER BY file_no, id) AS rn FROM u WHERE coalesce(confidence, 0) >= 0.65) "
)


def _merged(s, d):
    a = table(s, d, "train").select("id", F.col("label").alias("predicted_label"), "confidence")
    b = table(s, d, "soft_labels_reviewed").select("id", F.col("hard_label").alias("predicted_label"), "confidence")
    return sampling.merge_annotations([("cot_Beauty_0", a), ("cot_Home_1", b)])


@query("q_merge_dedup", _MERGE + "SELECT id, category FROM f WHERE rn = 1")
def _(s, d):
    return _merged(s, d).select("id", "category")


@query(
    "q_merge_stats",
    _MERGE + "SELECT category, count(*) AS total, count(*) FILTER (coalesce(confidence, 0) >= 0.65) AS kept, count(*) FILTER (coalesce(confidence, 0) < 0.65) AS filtered, "
    "count(*) FILTER (coalesce(confidence, 0) >= 0.65 AND predicted_label = 0) AS neg, count(*) FILTER (coalesce(confidence, 0) >= 0.65 AND predicted_label = 1) AS pos FROM u GROUP BY 1",
)
def _(s, d):  # AGG-13: the count named pos takes label 1, as the checked producer does
    a = table(s, d, "train").select(F.lit("Beauty").alias("category"), F.col("label").alias("l"), "confidence")
    b = table(s, d, "soft_labels_reviewed").select(F.lit("Home").alias("category"), F.col("hard_label").alias("l"), "confidence")
    keep = F.coalesce("confidence", F.lit(0.0)) >= 0.65
    return a.unionByName(b).groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("filtered"), F.count_if(keep & (F.col("l") == 0)).alias("neg"), F.count_if(keep & (F.col("l") == 1)).alias("pos")
    )


@query(
    "q_unused_prefix",
    "SELECT id FROM raw_records r WHERE NOT EXISTS (SELECT 1 FROM train t WHERE substring(coalesce(t.text, ''), 1, 100) = substring(coalesce(r.original_text, ''), 1, 100))",
)
def _(s, d):
    raw = table(s, d, "raw_records").select("id", F.col("original_text").alias("text"))
    return sampling.unused_by_prefix(raw, table(s, d, "train").select("text")).select("id")


@query("q_resume_todo", "SELECT id FROM raw_records r WHERE NOT EXISTS (SELECT 1 FROM soft_labels_reviewed x WHERE x.id = r.id)")
def _(s, d):
    return sampling.not_done(table(s, d, "raw_records").select("id"), table(s, d, "soft_labels_reviewed"))


@query("q_union_languages", "SELECT language, count(*) AS n FROM (SELECT * FROM raw_records WHERE language = 'en' UNION ALL SELECT * FROM raw_records WHERE language = 'zh' UNION ALL SELECT * FROM raw_records WHERE language = 'ru') GROUP BY 1")
def _(s, d):
    raw = table(s, d, "raw_records")
    parts = {k: raw.where(F.col("language") == k) for k in ("en", "zh", "ru")}
    return readers.union_languages(parts | {"xx": None}).groupBy("language").agg(F.count("*").alias("n"))


# ---- selection: SMP-1..7, WIN-1..5, LIM-1 ------------------------------------------------------

_D = "WITH t AS (SELECT DISTINCT id, label FROM train WHERE label IS NOT NULL), h AS (SELECT *, md5(concat(id, ':42')) AS k FROM t) "


def _labelled(s, d):
    return table(s, d, "train").where("label IS NOT NULL").select("id", "label").distinct()


@query("q_stratified_head", _D + "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM h) WHERE rn <= 100")
def _(s, d):
    return sampling.head_per_class(_labelled(s, d), "label", [F.col("id")], 100).select("id", "label")


@query("q_small_batch", _D + "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rn FROM h) WHERE rn <= CASE label WHEN 0 THEN 234 WHEN 1 THEN 233 WHEN 2 THEN 233 END")
def _(s, d):
    return sampling.small_batch(_labelled(s, d), 700, [sampling.shuffle_key(F.col("id"))]).select("id", "label")


@query(
    "q_stratified_split",
    _D + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rn, count(*) OVER (PARTITION BY label) AS n FROM h) "
    "SELECT id, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r",
)
def _(s, d):
    return sampling.stratified_split(_labelled(s, d), "label", F.col("id")).select("id", "label", "split")


@query(
    "q_cut_split",
    _D + ", r AS (SELECT *, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM h) "
    "SELECT id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r",
)
def _(s, d):
    return sampling.cut_split(_labelled(s, d), F.col("id")).select("id", "split")


@query(
    "q_curriculum",
    _D + ", r AS (SELECT id, row_number() OVER (ORDER BY k) AS rank FROM h) SELECT id, rank::INT AS rank, CASE WHEN rank <= 120 THEN 120 WHEN rank <= 240 THEN 240 ELSE 480 END AS stage FROM r WHERE rank <= 480",
)
def _(s, d):
    return sampling.curriculum(_labelled(s, d), F.col("id"), [120, 240, 480]).select("id", "rank", "stage")


@query(
    "q_early_stop",  # WIN-5 on a score per event type and day
    "WITH x AS (SELECT event_type, date_trunc('day', ts)::DATE AS step, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), "
    "y AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM x) "
    "SELECT event_type, step, is_best, count(*) OVER w = 2 AND max(is_best::INT) OVER w = 0 AS stops FROM y WINDOW w AS (PARTITION BY event_type ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
)
def _(s, d):
    df = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))
    return sampling.best_so_far(df, "score", "step", 2, "event_type").select("event_type", "step", "is_best", "stops")


@query("q_best_of_grid", "SELECT event_type, round(avg(value), 6) AS score FROM events GROUP BY 1 ORDER BY score DESC, event_type LIMIT 1")
def _(s, d):  # SRT-1, SRT-3
    return models.best_of_grid(table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("score")), "score", ["event_type"])


# ---- probabilities and losses: MTH-1..9 -------------------------------------------------------

_P = views.SQL + ", v AS (SELECT *, greatest(p0, p1, p2) AS c, [p0 * 3, p1 * 3, p2 * 3] AS z FROM v_pred), "
_LS = (
    _P + "l AS (SELECT *, list_max(z) AS m, [z[1] / 2, z[2] / 2, z[3] / 2] AS zt FROM v), "
    "k AS (SELECT *, m + ln(exp(z[1] - m) + exp(z[2] - m) + exp(z[3] - m)) AS s1, m / 2 + ln(exp(zt[1] - m / 2) + exp(zt[2] - m / 2) + exp(zt[3] - m / 2)) AS s2 FROM l) "
)


def _logits(s, d):
    return views.soft(views.predictions(s, d)).withColumn("z", F.transform("p", lambda x: x * 3))


@query(
    "q_adaptive_temperature",
    _P[:-2] + " SELECT doc_id, round(CASE WHEN c > 0.9 THEN 1.5::DOUBLE WHEN c > 0.6 THEN 2.0 ELSE least(2.5 + (0.6 - c) * 2, 3.0) END, 6) AS t1, "
    "round(CASE WHEN c > 0.85 THEN 1.2::DOUBLE WHEN c > 0.6 THEN 1.8 ELSE least(2.0 + (0.6 - c) * 3, 4.0) END, 6) AS t2, round(3.0 - 2.0 * c, 6) AS t3 FROM v",
)
def _(s, d):
    c = probs.confidence(F.col("p"))
    return views.soft(views.predictions(s, d)).select("doc_id", *(F.round(probs.adaptive_temperature(c, v), 6).alias(f"t{v}") for v in (1, 2, 3)))


@query("q_softmax", _LS + "SELECT doc_id, round(exp(zt[1] - s2), 6) AS q0, round(exp(zt[2] - s2), 6) AS q1, round(exp(zt[3] - s2), 6) AS q2 FROM k")
def _(s, d):
    return _logits(s, d).select("doc_id", probs.softmax(F.col("z"), 2.0).alias("q")).select("doc_id", *(F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(3)))


@query(
    "q_kl_ce",
    _LS + "SELECT doc_id, round(p0 * (ln(p0) - (zt[1] - s2)) + p1 * (ln(p1) - (zt[2] - s2)) + p2 * (ln(p2) - (zt[3] - s2)), 6) AS kl, round(-(z[label + 1] - s1), 6) AS ce FROM k",
)
def _(s, d):
    kl = probs.kl_divergence(F.col("p"), probs.log_softmax(F.col("z"), 2.0))
    return _logits(s, d).select("doc_id", F.round(kl, 6).alias("kl"), F.round(probs.cross_entropy(F.col("z"), F.col("label")), 6).alias("ce"))


@query(
    "q_mixed_loss",
    _LS + ", x AS (SELECT source, p0 * (ln(p0) - (zt[1] - s2)) + p1 * (ln(p1) - (zt[2] - s2)) + p2 * (ln(p2) - (zt[3] - s2)) AS kl, -(z[label + 1] - s1) AS ce FROM k) "
    "SELECT source, round(0.7 * (avg(kl) * 4) + 0.3 * avg(ce), 6) AS loss FROM x GROUP BY 1",
)
def _(s, d):
    kl = probs.kl_divergence(F.col("p"), probs.log_softmax(F.col("z"), 2.0))
    df = _logits(s, d).select("source", kl.alias("kl"), probs.cross_entropy(F.col("z"), F.col("label")).alias("ce"))
    return df.groupBy("source").agg(F.avg("kl").alias("kl"), F.avg("ce").alias("ce")).select("source", F.round(probs.mixed_loss(F.col("kl") * 4, F.col("ce")), 6).alias("loss"))


@query("q_layer_rates", "SELECT i::INT AS layer, round(2e-5 * pow(0.95, 12 - i), 12) AS rate FROM range(0, 12) t(i)")
def _(s, d):
    return s.range(1).select(F.posexplode(probs.layer_rates(2e-5, 0.95, 12)).alias("layer", "rate")).select("layer", F.round("rate", 12).alias("rate"))


@query("q_schedule", "WITH x AS (SELECT count(*) AS n FROM train), y AS (SELECT (n // 16) * 3 AS total_steps FROM x) SELECT total_steps, greatest(1, floor(total_steps * 0.05::DOUBLE))::BIGINT AS warmup_steps FROM y")
def _(s, d):
    return table(s, d, "train").agg(F.count("*").alias("n")).select(probs.schedule(F.col("n"), 4, 4, 3).alias("x")).select("x.*")


# ---- reading model output: JSN-1..11, STR-13..16, PRJ-10 ---------------------------------------


def _sent(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, '\"sentiment\":\\s*([0-2])', 1), '')"


def _aft(expr: str, marker: str) -> str:
    return f"CASE WHEN contains({expr}, '{marker}') THEN substring({expr}, instr({expr}, '{marker}') + {len(marker)}) END"


_IN = _aft("output", "<|channel>thought")
_RUNGS_CHANNEL = [_sent(_aft(f"({_IN})", "<channel|>")), _sent(_IN), _sent("CASE WHEN contains(output, '<turn|>') THEN split_part(output, '<turn|>', 1) END"), _sent("output")]
_RUNGS_THINK = [_sent(_aft("output", "</thinking>")), _sent("CASE WHEN contains(output, 'und_b8') THEN split_part(output, 'und_b8', -1) END"), _sent("output")]
_RUNGS_PLAIN = ["nullif(regexp_extract(output, 'Answer:\\s*([0-2])', 1), '')", "nullif(regexp_extract(output, 'sentiment[:\\s]+([0-2])', 1), '')", "regexp_extract_all(output, '[0-2]')[-1]"]
_RUNGS_MODEL = [_sent(_aft("output", "</think>")), _sent(_aft("output", "</thinking>")), _sent("output")]
_RUNGS_BATCH = [_RUNGS_CHANNEL[0], *_RUNGS_MODEL]
_ladder = lambda rungs: f"coalesce({', '.join(rungs)}, '-1')::INT"


@query(
    "q_parse_outputs",
    views.SQL + f"SELECT doc_id, {_ladder(_RUNGS_CHANNEL)} AS channel, {_ladder(_RUNGS_THINK)} AS thinking, {_ladder(_RUNGS_PLAIN)} AS plain, {_ladder(_RUNGS_MODEL)} AS model, {_ladder(_RUNGS_BATCH)} AS batch FROM v_out",
)
def _(s, d):
    o = F.col("output")
    return views.outputs(s, d).select(
        "doc_id", parse.sentiment_channel(o).alias("channel"), parse.sentiment_thinking(o).alias("thinking"), parse.sentiment_plain(o).alias("plain"),
        parse.sentiment_model(o).alias("model"), parse.sentiment_batch(o).alias("batch"),
    )


@query(
    "q_parse_auto",
    views.SQL + f", x AS (SELECT doc_id, {_ladder(_RUNGS_CHANNEL)} AS a, {_ladder(_RUNGS_PLAIN)} AS c FROM v_out) SELECT doc_id, CASE WHEN a <> -1 THEN a ELSE c END AS label, CASE WHEN a <> -1 THEN 'gemma4' WHEN c <> -1 THEN 'simple' ELSE 'unknown' END AS format FROM x",
)
def _(s, d):
    return views.outputs(s, d).select("doc_id", parse.sentiment_any(F.col("output")).alias("x")).select("doc_id", "x.*")


_REPLY = "WITH r AS (SELECT id, label, list_filter(conversations, lambda m: m.role = 'assistant')[-1].content AS output FROM conversation_rows) "


def _replies(s, d):
    reply = F.try_element_at(F.filter("conversations", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    return table(s, d, "conversation_rows").select("id", "label", reply.alias("output"))


@query("q_parse_replies", _REPLY + f"SELECT id, {_ladder(_RUNGS_BATCH)} AS pred, {_ladder(_RUNGS_CHANNEL)} AS channel FROM r")
def _(s, d):
    return _replies(s, d).select("id", parse.sentiment_batch(F.col("output")).alias("pred"), parse.sentiment_channel(F.col("output")).alias("channel"))


@query(
    "q_confidence_extract",
    _REPLY + ", j AS (SELECT id, nullif(regexp_extract(output, '(?s)\\{[^{}]*\\}', 0), '') AS body, try_cast(nullif(regexp_extract(output, 'confidence[:\\s]+([0-9.]+)', 1), '') AS DOUBLE) AS t FROM r), "
    "k AS (SELECT id, CASE WHEN json_valid(body) THEN try_cast(json_extract_string(body, '$.confidence') AS DOUBLE) END AS c, t FROM j) "
    "SELECT id, coalesce(CASE WHEN c BETWEEN 0 AND 1 THEN c END, CASE WHEN t BETWEEN 0 AND 1 THEN t END) AS conf FROM k",
)
def _(s, d):
    return _replies(s, d).select("id", parse.stated_confidence(F.col("output")).alias("conf"))


@query(
    "q_thought_lengths",  # JSN-8 on the channel format, STR-15
    _REPLY + f", t AS (SELECT id, {_IN} AS inner_text FROM r) SELECT id, len(split_part(inner_text, '<channel|>', 1)) AS n FROM t WHERE contains(inner_text, '<channel|>')",
)
def _(s, d):
    inner = text.after_first(F.col("output"), "<|channel>thought")
    return _replies(s, d).select("id", F.length(text.before_first(inner, "<channel|>")).cast("long").alias("n")).where("n IS NOT NULL")


@query(
    "q_rationale",
    _REPLY + f", x AS (SELECT id, output, {_ladder(_RUNGS_CHANNEL)} AS a, {_IN} AS inner_text, nullif(regexp_extract(output, '(?s)\\{{[^{{}}]*\\}}', 0), '') AS body FROM r) "
    "SELECT id, coalesce(CASE WHEN a <> -1 AND contains(inner_text, '<channel|>') THEN regexp_replace(split_part(inner_text, '<channel|>', 1), '^\\s+|\\s+$', '', 'g') END, "
    "CASE WHEN json_valid(body) THEN coalesce(nullif(json_extract_string(body, '$.rationale'), ''), json_extract_string(body, '$.reasoning')) END) AS rationale FROM x",
)
def _(s, d):
    return _replies(s, d).select("id", parse.rationale(F.col("output")).alias("rationale"))


@query(
    "q_strip_thinking",
    views.SQL + "SELECT doc_id, trim(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), chr(10) || ' ') AS answer, nullif(trim(regexp_extract(output, '(?s)<think>(.*?)</think>', 1)), '') AS thinking FROM v_out",
)
def _(s, d):
    return views.outputs(s, d).select("doc_id", parse.strip_thinking(F.col("output")).alias("x")).select("doc_id", "x.*")


@query(
    "q_extract_review",
    "WITH u AS (SELECT id, list_filter(conversations, lambda m: m.role = 'user')[-1].content AS c FROM conversation_rows) "
    f"SELECT id, trim({_aft('c', 'Review: ')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8239) || chr(12288)) AS review FROM u",
)
def _(s, d):
    turn = F.try_element_at(F.filter("conversations", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    return table(s, d, "conversation_rows").select("id", parse.review_of_prompt(turn).alias("review"))


@query("q_last_position", _REPLY + "SELECT id, CASE WHEN contains(output, '\"sentiment\": ') THEN len(output) - len(split_part(output, '\"sentiment\": ', -1)) - 13 ELSE -1 END AS place FROM r WHERE output IS NOT NULL")
def _(s, d):
    return _replies(s, d).where("output IS NOT NULL").select("id", text.last_position(F.col("output"), '"sentiment": ').cast("long").alias("place"))


#: Replies of every shape: numbers, numbers as text, missing and null shares, words, nested and broken objects.
_SHAPES = """CASE ifnull(length(original_text), 0) % 9
 WHEN 0 THEN concat('<think>t ', id, '</think> {"negative": ', length(original_text) % 7, ', "positive": 1}')
 WHEN 1 THEN '{"negative": "0.5", "neutral": 1, "positive": 0.5}' WHEN 2 THEN '{"negative": null, "positive": 1}'
 WHEN 3 THEN '{"negative": "much", "positive": 1}' WHEN 4 THEN '{"negative": 0, "neutral": 0, "positive": 0, "confidence": 0.25}'
 WHEN 5 THEN 'so {"negative": 1, "confidence": "high"}' WHEN 6 THEN '<|begin_of_thought|>why<|end_of_thought|>{"neutral": 3, "confidence": 0.5}' WHEN 7 THEN 'no object' ELSE '{"a": {"b": 1}, "positive": 2' END"""


def _share(key: str, from_text: bool) -> str:
    text = f"WHEN json_type(j, '$.{key}') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.{key}') AS DOUBLE) " if from_text else ""
    return f"CASE WHEN NOT json_exists(j, '$.{key}') THEN 0.33::DOUBLE WHEN json_type(j, '$.{key}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.{key}') AS DOUBLE) {text}END"


_ANNOTATED = (
    f"WITH o AS (SELECT id, {_SHAPES} AS output FROM raw_records), t AS (SELECT id, coalesce(nullif(regexp_extract(output, '(?s)<think>(.*?)</think>', 1), ''), regexp_extract(output, '(?s)<\\|begin_of_thought\\|>(.*?)<\\|end_of_thought\\|>', 1)) AS thinking, "
    "regexp_replace(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), '(?s)<\\|begin_of_thought\\|>.*?<\\|end_of_thought\\|>', '', 'g') AS answer, output FROM o), "
)


def _annotated(from_text: bool, source: str) -> str:
    return (
        _ANNOTATED + f"b AS (SELECT id, thinking, {source} AS body FROM t), p AS (SELECT id, thinking, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b WHERE json_valid(body)), "
        f"v AS (SELECT id, thinking, j, {_share('negative', from_text)} AS a, {_share('neutral', from_text)} AS b, {_share('positive', from_text)} AS c FROM p), "
        "w AS (SELECT id, thinking, j, CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0.33 END AS p0, CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0.33 END AS p1, CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 0.34 END AS p2 FROM v WHERE a + b + c IS NOT NULL), "
        f"x AS (SELECT id, thinking, p0, p1, p2, CASE WHEN NOT json_exists(j, '$.confidence') THEN greatest(p0, p1, p2) WHEN json_type(j, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.confidence') AS DOUBLE) END AS confidence FROM w) "
        "SELECT id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)::INT AS hard_label, round(confidence, 9) AS confidence"
    )


_FLAT = "nullif(regexp_extract({t}, '(?s)\\{{[^{{}}]*\\}}'), '')"


def _replies_of_shapes(s, d):
    return table(s, d, "raw_records").selectExpr("id", f"{_SHAPES} AS output")


def _shares(a):
    return [F.round(a["probabilities"][i], 9).alias(f"p{i}") for i in range(3)]


@query("q_annotation_parse", _annotated(True, f"coalesce({_FLAT.format(t='answer')}, nullif(regexp_extract(answer, '(?s)\\{{.*\\}}'), ''))") + ", left(thinking, 200) AS thinking_preview FROM x WHERE confidence IS NOT NULL")
def _(s, d):  # JSN-1, 3
    a = _replies_of_shapes(s, d).select("id", parse.annotation(F.col("output")).alias("a")).where("a IS NOT NULL")
    return a.select("id", *_shares(F.col("a")), "a.hard_label", F.round("a.confidence", 9).alias("confidence"), "a.thinking_preview")


@query("q_annotation_batch", _annotated(False, f"coalesce({_FLAT.format(t='output')}, output)") + " FROM x")
def _(s, d):  # JSN-2
    a = _replies_of_shapes(s, d).select("id", parse.annotation_batch(F.col("output")).alias("a")).where("a IS NOT NULL")
    return a.select("id", *_shares(F.col("a")), "a.hard_label", F.round("a.confidence", 9).alias("confidence"))


# ---- metrics: AGG-20..30, JOIN-1, 5, RPT-1..6 --------------------------------------------------

_PARSED = views.SQL + f", pr AS (SELECT doc_id, label, {_ladder(_RUNGS_BATCH)} AS pred FROM v_out), "
_CM = _PARSED + "cm AS (SELECT t.t, p.p, (SELECT count(*) FROM pr WHERE label = t.t AND pred = p.p) AS n FROM (SELECT unnest([0,1,2])::INT AS t) t, (SELECT unnest([0,1,2])::INT AS p) p) "
_CLS = (
    _CM + ", a AS (SELECT t AS class, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS hit FROM cm GROUP BY 1), b AS (SELECT p AS class, sum(n) AS guessed FROM cm GROUP BY 1), "
    "c AS (SELECT class, support, coalesce(hit::DOUBLE / nullif(guessed, 0), 0) AS p, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS r FROM a JOIN b USING (class)), "
    "m AS (SELECT class, support, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c) "
)


def _parsed(s, d):
    return views.outputs(s, d).select("doc_id", "label", parse.sentiment_batch(F.col("output")).alias("pred"))


@query("q_confusion", _CM + "SELECT t, p, n FROM cm")
def _(s, d):
    return metrics.confusion(_parsed(s, d))


@query("q_class_metrics", _CLS + 'SELECT class, round(p, 4) AS "precision", round(r, 4) AS recall, round(f, 4) AS f1, support::BIGINT AS support FROM m')
def _(s, d):
    return metrics.class_metrics(_parsed(s, d))


@query("q_summary", _CLS + "SELECT round((SELECT avg((label = pred)::INT) FROM pr), 4) AS accuracy, round(sum(round(f, 4)) / 3, 4) AS f1_macro, (SELECT count(*) FROM pr) AS total_samples FROM m")
def _(s, d):
    return metrics.summary(_parsed(s, d))


@query("q_weighted_f1", _CLS + "SELECT round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM m")
def _(s, d):
    return metrics.unrounded_scores(_parsed(s, d))


@query(
    "q_accuracy_parsed",
    _PARSED[:-2] + " SELECT count(*) AS total, count(*) FILTER (pred = -1) AS parse_errors, count(*) FILTER (pred <> -1) AS valid, count(*) FILTER (pred <> -1 AND pred = label) AS correct, "
    "round(count(*) FILTER (pred <> -1 AND pred = label) * 100.0::DOUBLE / count(*) FILTER (pred <> -1), 4) AS accuracy_pct FROM pr",
)
def _(s, d):
    return metrics.parsed_accuracy(_parsed(s, d))


@query("q_reply_accuracy", _REPLY + f", pr AS (SELECT label, {_ladder(_RUNGS_BATCH)} AS pred FROM r) SELECT label, pred, count(*) AS n FROM pr GROUP BY 1, 2")
def _(s, d):
    return _replies(s, d).select("label", parse.sentiment_batch(F.col("output")).alias("pred")).groupBy("label", "pred").agg(F.count("*").alias("n"))


@query("q_confusion_normalized", _CM + "SELECT t, p, n, round(n::DOUBLE / greatest(sum(n) OVER (PARTITION BY t), 1), 6) AS share FROM cm")
def _(s, d):
    return metrics.normalized_confusion(_parsed(s, d))


@query(
    "q_error_sample",  # FLT-12, 13: the feature is a first-three report
    _PARSED[:-2] + " SELECT doc_id, label, pred FROM pr WHERE pred <> -1 AND pred <> label ORDER BY doc_id LIMIT 3",
)
def _(s, d):
    return _parsed(s, d).where("pred <> -1 AND pred <> label").orderBy("doc_id").limit(3)


@query(
    "q_positional_join",
    "WITH a AS (SELECT hard_label AS truth, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id, hard_label FROM train)), b AS (SELECT hard_label AS guess, row_number() OVER (ORDER BY id) AS place FROM (SELECT id, max(hard_label) AS hard_label FROM soft_labels_reviewed GROUP BY 1)) "
    "SELECT place, truth, guess FROM a JOIN b USING (place)",
)
def _(s, d):
    a = table(s, d, "train").select("id", F.col("hard_label").alias("truth")).distinct()
    b = table(s, d, "soft_labels_reviewed").groupBy("id").agg(F.max("hard_label").alias("guess"))
    return metrics.positional_join(a, b, ["id"]).select("place", "truth", "guess")


@query("q_ece", views.SQL + ", x AS (SELECT greatest(p0, p1, p2) AS c, (pred = label)::INT AS k FROM v_pred), y AS (SELECT len(list_filter([1 * 0.1::DOUBLE, 2 * 0.1::DOUBLE, 3 * 0.1::DOUBLE, 4 * 0.1::DOUBLE, 5 * 0.1::DOUBLE, 6 * 0.1::DOUBLE, 7 * 0.1::DOUBLE, 8 * 0.1::DOUBLE, 9 * 0.1::DOUBLE], lambda e: c >= e)) AS b, count(*) AS n, avg(k) AS acc, avg(c) AS conf FROM x GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM y")
def _(s, d):
    return metrics.calibration_error(views.soft(views.predictions(s, d)), F.array_max("p"), F.col("pred") == F.col("label"))


@query("q_calibration_gap", views.SQL + ", x AS (SELECT avg(greatest(p0, p1, p2)) AS c, avg((pred = label)::INT) AS a FROM v_pred) SELECT round(c, 6) AS avg_confidence, round(a, 6) AS accuracy, round(abs(c - a), 6) AS gap, round(c - a, 6) AS signed_gap FROM x")
def _(s, d):
    return metrics.confidence_gap(views.soft(views.predictions(s, d)), F.array_max("p"), F.col("pred") == F.col("label"))


@query("q_uncertainty", views.SQL + "SELECT CASE WHEN greatest(p0, p1, p2) > 0.9 THEN 'high' WHEN greatest(p0, p1, p2) >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM v_pred GROUP BY 1")
def _(s, d):
    return metrics.uncertainty_buckets(views.soft(views.predictions(s, d)), F.array_max("p"), F.col("pred") == F.col("label"))


@query(
    "q_latency_stats",
    "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, min(value) AS min_ms, max(value) AS max_ms, "
    "round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(avg(value) / 8, 6) AS per_sample_ms, round(8000.0::DOUBLE / avg(value), 4) AS per_second FROM events GROUP BY 1",
)
def _(s, d):
    return metrics.latency(table(s, d, "events"), F.col("value"), ["event_type"], 8)


@query(
    "q_batch_latency",
    "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events), "
    "y AS (SELECT event_type, floor((place - 1) / 16)::BIGINT AS batch, count(*) AS k, round(sum(value), 4) AS batch_ms FROM x GROUP BY 1, 2) SELECT event_type, batch, batch_ms FROM y WHERE k = 16",
)
def _(s, d):
    # ids rise with time, so ranges of them are the buckets of the running count
    rows = prefix_sum(table(s, d, "events"), ["event_type"], F.floor(F.col("event_id") / 4096).cast("long"), [F.col("event_id")], F.lit(1.0), "before")
    return metrics.full_batches(rows, F.col("before") + 1, 16, F.col("value"), "event_type")


@query("q_epoch_means", "SELECT date_trunc('day', ts)::DATE AS epoch, round(avg(value), 6) AS loss, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(s, d):  # AGG-31
    return table(s, d, "events").groupBy(F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(
    "q_route_pivot",
    "SELECT label, count(*) FILTER (source = 'amazon_hf') AS amazon_hf, count(*) FILTER (source = 'yelp_hf') AS yelp_hf, count(*) FILTER (source = 'ozon_local') AS ozon_local "
    "FROM (SELECT sentiment_label AS label, source FROM raw_records) GROUP BY 1",
)
def _(s, d):
    df = table(s, d, "raw_records").groupBy(F.col("sentiment_label").alias("label")).pivot("source", ["amazon_hf", "yelp_hf", "ozon_local"]).agg(F.count(F.lit(1)))
    return df.select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("amazon_hf", "yelp_hf", "ozon_local")))


@query(
    "q_model_delta",
    _CLS.replace("pr AS (", "pr AS (", 1) + ", m2 AS (SELECT class, round(f, 4) AS other_f1 FROM m) SELECT class, other_f1, 1.0::DOUBLE AS base_f1, round(other_f1 - 1.0, 4) AS delta FROM m2",
)
def _(s, d):  # JOIN-5 against a perfect model
    base = metrics.class_metrics(views.predictions(s, d).select("label", F.col("label").alias("pred")))
    return metrics.compare(base, metrics.class_metrics(_parsed(s, d)))


@query("q_relative_gain", "WITH x AS (SELECT source, avg(rating) AS a, avg(sentiment_label) AS b FROM raw_records GROUP BY 1) SELECT source, round((b - a) * 100 / nullif(a, 0), 4) AS gain_pct FROM x")
def _(s, d):
    df = table(s, d, "raw_records").groupBy("source").agg(F.avg("rating").alias("a"), F.avg("sentiment_label").alias("b"))
    return df.select("source", F.round(metrics.relative_gain(F.col("a"), F.col("b")), 4).alias("gain_pct"))


@query("q_report_lines", "SELECT source, printf('%.2f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM raw_records)) AS share FROM raw_records GROUP BY 1")
def _(s, d):  # STR-18, RPT-4
    n = quality.distribution(table(s, d, "raw_records"), F.col("source"), "source")
    return n.select("source", text.percent(F.col("n") * 100.0 / F.sum("n").over(_whole())).alias("share"))


def _whole():
    from pyspark.sql.window import Window

    return Window.partitionBy()


# ---- chat: PRJ-7..17, FLT-8 -------------------------------------------------------------------


@query(
    "q_conversation_build",
    "SELECT id, concat('Review: ', coalesce(text, '')) AS user_turn, concat('<|channel>thought', chr(10), coalesce(cot, ''), '<channel|>', chr(10), '{\"sentiment\": ', label, ', \"confidence\": ', "
    f"coalesce(confidence, {_CONF})::VARCHAR, ', \"rationale\": ', to_json(coalesce(cot, ''))::VARCHAR, '}}') AS reply, coalesce(category, 'unknown') AS category FROM train WHERE label IS NOT NULL",
)
def _(s, d):  # PRJ-7
    df = chat.to_conversations(table(s, d, "train").where("label IS NOT NULL"))
    return df.select("id", F.col("conversations")[1]["content"].alias("user_turn"), F.col("conversations")[2]["content"].alias("reply"), "category")


@query(
    "q_validate_format",
    "WITH r AS (SELECT id, coalesce(conversations, []) AS c FROM conversation_rows), q AS (SELECT id, c, coalesce(list_filter(c, lambda m: m.role = 'assistant')[-1].content, '') AS a FROM r) "
    "SELECT id, v AS violation FROM (SELECT id, unnest(list_filter([CASE WHEN len(c) <> 3 THEN 'turns' END, CASE WHEN coalesce(c[1].role, '') <> 'system' THEN 'system' END, CASE WHEN coalesce(c[2].role, '') <> 'user' THEN 'user' END, "
    "CASE WHEN coalesce(c[3].role, '') <> 'assistant' THEN 'assistant' END, CASE WHEN NOT contains(a, '<|channel>thought') THEN 'thought_open' END, CASE WHEN NOT contains(a, '<channel|>') THEN 'thought_close' END, "
    "CASE WHEN NOT contains(split_part(a, '<channel|>', -1), '\"sentiment\"') THEN 'sentiment' END], lambda x: x IS NOT NULL)) AS v FROM q)",
)
def _(s, d):
    return chat.format_violations(table(s, d, "conversation_rows"))


@query(
    "q_chatml",
    "SELECT id, CASE WHEN conversations IS NOT NULL THEN concat(array_to_string(list_transform(conversations, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), ''), '<|im_start|>assistant', chr(10)) END AS prompt FROM conversation_rows",
)
def _(s, d):
    return table(s, d, "conversation_rows").select("id", chat.chatml(F.col("conversations")).alias("prompt"))


_TURN = (
    "CASE WHEN contains(m.content, '</think>') THEN ltrim(split_part(m.content, '</think>', -1), chr(10)) ELSE m.content END",
    "CASE WHEN contains(m.content, '</think>') THEN trim(split_part(split_part(m.content, '</think>', 1), '<think>', -1), chr(10)) ELSE '' END",
)


@query(
    "q_render_history",
    "WITH x AS (SELECT id, conversations AS c, coalesce(list_max(list_filter(list_transform(conversations, lambda m, i: CASE WHEN m.role = 'user' THEN i END), lambda k: k IS NOT NULL)), 0) AS lu FROM conversation_rows), "
    f"y AS (SELECT id, c, list_transform(c, lambda m, i: '<|im_start|>' || m.role || chr(10) || CASE WHEN m.role = 'assistant' THEN CASE WHEN i > lu AND (i = len(c) OR len({_TURN[1]}) > 0) "
    f"THEN '<think>' || chr(10) || ({_TURN[1]}) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim({_TURN[0]}, chr(10)) ELSE {_TURN[0]} END ELSE m.content END || '<|im_end|>' || chr(10)) AS said FROM x) "
    "SELECT id, CASE WHEN c IS NOT NULL THEN coalesce(array_to_string(list_filter(said, lambda t: t IS NOT NULL), ''), '') || '<|im_start|>assistant' || chr(10) END AS prompt FROM y",
)
def _(s, d):
    return table(s, d, "conversation_rows").select("id", chat.render_history(F.col("conversations"), True).alias("prompt"))


@query(
    "q_chat_messages",
    "SELECT id, CASE WHEN language IN ('en', 'zh', 'ru') THEN 8 END AS turns, CASE language WHEN 'en' THEN concat('Review: \"', original_text, '\"') WHEN 'zh' THEN concat('评论：\"', original_text, '\"') WHEN 'ru' THEN concat('Отзыв: \"', original_text, '\"') END AS question "
    "FROM raw_records WHERE language IN ('en', 'zh', 'ru')",
)
def _(s, d):
    df = table(s, d, "raw_records").where(F.col("language").isin("en", "zh", "ru"))
    m = chat.chat_messages(F.col("original_text"), F.col("language"), chat.few_shot(F.col("language"), 3))
    return df.select("id", m.alias("m")).select("id", F.size("m").alias("turns"), F.element_at("m", -1)["content"].alias("question"))


@query("q_label_names", "SELECT id, CASE language WHEN 'en' THEN ['negative', 'neutral', 'positive'][sentiment_label + 1] WHEN 'zh' THEN ['负面', '中性', '正面'][sentiment_label + 1] WHEN 'ru' THEN ['негативный', 'нейтральный', 'позитивный'][sentiment_label + 1] END AS label_name FROM raw_records")
def _(s, d):
    return table(s, d, "raw_records").select("id", chat.label_name(F.col("sentiment_label"), F.col("language")).alias("label_name"))


@query("q_instruction_rows", "SELECT text AS input, hard_label::VARCHAR AS output, confidence FROM train")
def _(s, d):
    return chat.to_instructions(table(s, d, "train")).select("input", "output", "confidence")


# ---- text and features: STR-1..12, 17, ML-1, SET-5, ARR-6..10 ----------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '{p}'))"
_EN_TOK = _TOK.format(c="text_for_llm", p="^[a-z]+$")


@query("q_tokens_en", f"SELECT id, array_to_string({_EN_TOK}, ' ') AS tokens FROM processed_records WHERE text_for_llm IS NOT NULL")
def _(s, d):
    return table(s, d, "processed_records").where("text_for_llm IS NOT NULL").select("id", F.array_join(text.tokens_english(F.col("text_for_llm")), " ").alias("tokens"))


@query(
    "q_clean_nlp",
    "WITH x AS (SELECT id, CASE language WHEN 'en' THEN " + _EN_TOK + " WHEN 'ru' THEN " + _TOK.format(c="text_for_llm", p="^[\\x{0400}-\\x{04ff}]+$") + " WHEN 'zh' THEN regexp_extract_all(text_for_llm, '[\\x{4e00}-\\x{9fff}]') END AS t, "
    f"CASE language WHEN 'en' THEN {_words(STOPWORDS['en'])} WHEN 'ru' THEN {_words(STOPWORDS['ru'])} WHEN 'zh' THEN {_words(STOPWORDS['zh'])} END AS stop FROM processed_records WHERE language IN ('en', 'ru', 'zh') AND text_for_llm IS NOT NULL) "
    "SELECT id, array_to_string(list_filter(t, lambda w: len(w) > 1 AND NOT list_contains(stop, w)), ' ') AS nlp, len(list_filter(t, lambda w: len(w) > 1 AND NOT list_contains(stop, w))) AS words FROM x",
)
def _(s, d):
    df = table(s, d, "processed_records").where(F.col("language").isin("en", "ru", "zh") & F.col("text_for_llm").isNotNull())
    t = text.clean_tokens(F.col("text_for_llm"), F.col("language"))
    return df.select("id", t.alias("t")).select("id", F.array_join("t", " ").alias("nlp"), F.size("t").cast("long").alias("words"))


#: White space of any kind for RE2 classes, whose own \\s knows ASCII only.
_WHITE = r"'\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}'"


def _cleaned(raw: str) -> str:
    """The three entities that the tables hold, in one pass; links, addresses and tags; white space."""
    text = f"regexp_replace({raw}, '&(?:amp|AMP);?', chr(1), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '&(?:quot|QUOT);?', '\"', 'g'), '&nbsp;?', chr(160), 'g')"
    text = f"replace({text}, chr(1), '&')"
    w = r"\p{L}\p{N}\p{M}_"
    url = rf"(?i)https?://[-.{w}]+(?:[:\d]+)?(?:/[/.{w}]*(?:\?[&=%.{w}]*)?(?:#[.{w}]*)?)?"
    solid = f"'[^' || {_WHITE} || ']+'"
    text = f"regexp_replace({text}, '{url}', ' ', 'g')"
    text = f"regexp_replace({text}, {solid} || '@' || {solid} || '[.]' || {solid}, ' ', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({text}, '[' || {_WHITE} || ']+', ' ', 'g'))"


_CLEANED = f"WITH k AS (SELECT id, language, {_cleaned("coalesce(original_text, '')")} AS t FROM raw_records) "


@query("q_clean_llm", _CLEANED + "SELECT id, language, t AS text_for_llm, length(t)::INT AS char_count FROM k")
def _(s, d):
    df = table(s, d, "raw_records").select("id", "language", text.clean_for_llm(F.col("original_text")).alias("text_for_llm"))
    return df.withColumn("char_count", F.length("text_for_llm"))


@query(
    "q_process_records",
    _CLEANED + ", w AS (SELECT id, t, CASE language WHEN 'en' THEN " + _TOK.format(c="t", p="^[a-z]+$") + " WHEN 'ru' THEN " + _TOK.format(c="t", p="^[\\x{0400}-\\x{04ff}]+$") + " WHEN 'zh' THEN regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]') "
    f"ELSE list_filter(regexp_split_to_array(lower(t), '[' || {_WHITE} || ']+'), lambda x: len(x) > 0) END AS w, CASE language WHEN 'en' THEN {_words(STOPWORDS['en'])} WHEN 'ru' THEN {_words(STOPWORDS['ru'])} WHEN 'zh' THEN {_words(STOPWORDS['zh'])} ELSE [] END AS stop FROM k), "
    "f AS (SELECT id, t, list_filter(w, lambda x: len(x) > 1 AND NOT list_contains(stop, x)) AS w FROM w) "
    "SELECT id, t AS text_for_llm, array_to_string(w, ' ') AS text_for_nlp, len(w)::INT AS word_count, length(t)::INT AS char_count, CASE WHEN len(w) <= 15 THEN 'short' WHEN len(w) <= 50 THEN 'medium' ELSE 'long' END AS length_category FROM f",
)
def _(s, d):  # PRJ-5, 6
    df = table(s, d, "raw_records").select("id", text.processed(F.col("original_text"), F.col("language")).alias("x"))
    return df.select("id", "x.*", records.length_category(F.col("x.word_count")).alias("length_category"))


_TOPIC = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z' || {_WHITE} || ']', '', 'g')), '[' || {_WHITE} || ']+'), lambda w: len(w) >= 3 AND NOT list_contains({_words(STOPWORDS_EN)}, w))"


@query("q_topic_tokens", f"SELECT doc_id, len({_TOPIC}) AS n, coalesce(list_sort({_TOPIC})[1], '') AS first_word FROM documents WHERE lang = 'en'")
def _(s, d):
    t = text.tokens_topic(F.col("text"))
    return table(s, d, "documents").where("lang = 'en'").select("doc_id", F.size(t).cast("long").alias("n"), F.coalesce(F.get(F.array_sort(t), F.lit(0)), F.lit("")).alias("first_word"))


@query("q_vocabulary", f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT unnest({_TOPIC}) AS word FROM documents WHERE lang = 'en')")
def _(s, d):
    return features.vocabulary(table(s, d, "documents").where("lang = 'en'"), text.tokens_topic(F.col("text"))).select("word", F.col("word_id").cast("long").alias("word_id"))


_SK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: len(x) >= 2)"


@query(
    "q_tfidf",
    f"WITH t AS (SELECT id AS doc, {_SK} AS w FROM (SELECT DISTINCT id, text FROM train)), b AS (SELECT doc, list_concat(w, coalesce(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), [])) AS w FROM t), "
    "r AS (SELECT doc, unnest(w) AS term FROM b), tf AS (SELECT doc, term, count(*) AS tf FROM r GROUP BY 1, 2), nd AS (SELECT count(DISTINCT doc) AS n FROM t), "
    "st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1), kept AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM st, nd WHERE df >= 2 AND df <= n * 0.95::DOUBLE ORDER BY cf DESC, term LIMIT 10000), "
    "raw AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM tf JOIN kept USING (term)), u AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM raw) "
    "SELECT doc, count(*) AS terms, round(max(weight), 5) AS top_weight, round(sum(weight * weight), 5) AS norm FROM u GROUP BY 1",
)
def _(s, d):
    df = table(s, d, "train").select("id", "text").distinct()
    w = features.tfidf(df, "id", features.with_bigrams(features.sklearn_tokens(F.col("text"))))
    return w.groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 5).alias("top_weight"), F.round(F.sum(F.col("weight") * F.col("weight")), 5).alias("norm"))


_IDS = f"list_transform({_SK}, lambda x: len(x))"


def _ids(df):
    return F.transform(features.sklearn_tokens(df["text"]), lambda x: F.length(x))


@query(
    "q_pad_batch",
    f"WITH x AS (SELECT doc_id, doc_id % 64 AS batch, {_IDS} AS ids FROM documents), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM x) "
    "SELECT doc_id, batch, longest AS padded_length, len(ids) AS ids_length, coalesce(list_sum(ids), 0)::BIGINT AS total FROM m",
)
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "text")
    rows = features.pad_to_batch(df.withColumn("ids", _ids(df)), "ids", F.col("doc_id") % 64)
    total = F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "batch", F.size("padded").cast("long").alias("padded_length"), F.size("ids").cast("long").alias("ids_length"), total.alias("total"))


@query(
    "q_label_mask",
    f"WITH x AS (SELECT doc_id, {_IDS} AS ids FROM documents) SELECT doc_id, least(len(ids), 512) AS n, least(len(ids), 5) AS masked, coalesce(list_sum(list_slice(ids, 6, 512)), 0)::BIGINT AS kept FROM x",
)
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "text")
    m = features.masked_labels(_ids(df), F.lit(5))
    rows = df.select("doc_id", m.alias("m"))
    kept = F.aggregate(F.filter("m", lambda x: x != -100), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x == -100)).cast("long").alias("masked"), kept.alias("kept"))


@query("q_fixed_encode", f"WITH x AS (SELECT doc_id, {_IDS} AS ids FROM documents) SELECT doc_id, 256::BIGINT AS n, least(len(ids), 256) AS attended, coalesce(list_sum(list_slice(ids, 1, 256)), 0)::BIGINT AS total FROM x")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "text")
    rows = df.select("doc_id", features.fixed_length(_ids(df)).alias("e"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("e.input_ids").cast("long").alias("n"), add("e.attention_mask").alias("attended"), add("e.input_ids").alias("total"))


_BLANK_TOKENS = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: len(x) > 0)"
_BEFORE = "left(output, len(output) - len(split_part(output, '\"sentiment\": ', -1)))"


@query(
    "q_label_token",
    _REPLY + f", t AS (SELECT id, output, {_BLANK_TOKENS.format(t='output')} AS tokens, len({_BLANK_TOKENS.format(t=_BEFORE)})::INT AS spot FROM r WHERE output IS NOT NULL) "
    "SELECT id, CASE WHEN contains(output, '\"sentiment\": ') AND coalesce(regexp_matches(tokens[spot + 1], '^[012]'), false) THEN spot ELSE -1 END AS place FROM t",
)
def _(s, d):  # ARR-8 with a tokenizer that splits at blanks
    rows = _replies(s, d).where("output IS NOT NULL")
    tokens = F.filter(F.split("output", r"\s+"), lambda x: F.length(x) > 0)
    return rows.select("id", features.label_token_place(F.col("output"), '"sentiment": ', tokens).alias("place"))


# ---- topics and models: ML-2..9, AGG-34, WIN-6, SRT-4 -------------------------------------------

_MIX = (
    f"WITH dw AS (SELECT doc, word, count(*) AS c FROM (SELECT doc_id AS doc, unnest({_TOPIC}) AS word FROM documents WHERE lang = 'en') GROUP BY 1, 2), "
    "asg AS (SELECT DISTINCT doc, (doc % 5)::INT AS cluster FROM dw), cw AS (SELECT cluster, word, sum(c) AS n FROM dw JOIN asg USING (doc) GROUP BY 1, 2), "
    "tw AS (SELECT cluster, word, round((n + 0.1) / (sum(n) OVER (PARTITION BY cluster) + (SELECT count(DISTINCT word) FROM dw) * 0.1), 9)::DOUBLE AS prob FROM cw), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY prob DESC, word)::INT AS rank FROM tw QUALIFY rank <= 10) "
)


def _mixture(s, d):
    # stored, as every step of a mixture reads the words again
    words = stored(topics.doc_words(table(s, d, "documents").where("lang = 'en'"), "doc_id", text.tokens_topic(F.col("text"))))
    assigned = words.select("doc", (F.col("doc") % 5).cast("int").alias("cluster")).distinct()
    return words, assigned, words.select("word").distinct().count()


@query("q_topic_words", _MIX + "SELECT cluster, word, prob, rank FROM top")
def _(s, d):
    words, assigned, size = _mixture(s, d)
    return topics.topic_words(topics.cluster_words(words, assigned), size)


@query("q_cluster_sizes", _MIX + "SELECT cluster, count(DISTINCT doc) AS docs, sum(c)::BIGINT AS tokens FROM dw JOIN asg USING (doc) GROUP BY 1")
def _(s, d):
    words, assigned, _ = _mixture(s, d)
    return topics.cluster_sizes(words, assigned, 5)


@query(
    "q_cluster_sentiment",
    _MIX + f", z AS (SELECT cluster, [len(list_intersect(list(word), {_words(SEEDS_NEGATIVE)})), len(list_intersect(list(word), {_words(SEEDS_NEUTRAL)})), len(list_intersect(list(word), {_words(SEEDS_POSITIVE)}))] AS sc FROM cw GROUP BY 1) "
    "SELECT cluster, (list_position(sc, list_max(sc)) - 1)::INT AS label FROM z",
)
def _(s, d):
    words, assigned, _ = _mixture(s, d)
    return topics.cluster_sentiment(topics.cluster_words(words, assigned))


@query(
    "q_mixture_scores",
    _MIX + ", sz AS (SELECT a.cluster, count(DISTINCT doc) AS docs, sum(c) AS tokens FROM dw JOIN asg a USING (doc) GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM dw) "
    "SELECT dw.doc, sz.cluster, round(ln(first(docs) + 0.1 + 1e-10) + sum(c * ln((coalesce(cw.n, 0) + 0.1) / (tokens + v * 0.1) + 1e-10)), 4) AS score FROM dw CROSS JOIN sz CROSS JOIN v LEFT JOIN cw ON cw.cluster = sz.cluster AND cw.word = dw.word GROUP BY 1, 2",
)
def _(s, d):
    words, assigned, size = _mixture(s, d)
    scores = topics.mixture_scores(words, topics.cluster_words(words, assigned), topics.cluster_sizes(words, assigned, 5), size)
    return scores.select("doc", "cluster", F.round("score", 4).alias("score"))


@query("q_mixture_fit")
def _(s, d):
    words, _, _ = _mixture(s, d)
    return topics.fit_mixture(words).groupBy("cluster").agg(F.count("*").alias("docs"))


@query("q_coherence")
def _(s, d):
    words, assigned, size = _mixture(s, d)
    return topics.coherence_umass(topics.topic_words(topics.cluster_words(words, assigned), size), words)


@query("q_dominant_topic", f"SELECT id, (CASE WHEN list_position(soft_labels, list_max(soft_labels)) > 0 THEN list_position(soft_labels, list_max(soft_labels)) - 1 ELSE -1 END)::INT AS topic, coalesce(list_max(soft_labels), 0) AS prob FROM train")
def _(s, d):
    return table(s, d, "train").select("id", topics.dominant_topic(F.col("soft_labels")).alias("x")).select("id", F.coalesce("x.topic", F.lit(-1)).alias("topic"), "x.prob")


@query("q_lda")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    _, rows = topics.lda(table(s, d, "documents").where("lang = 'en'"), "doc_id", text.tokens_topic(F.col("text")))
    return rows.select("doc", topics.dominant_topic(vector_to_array("topicDistribution")).alias("x")).select("doc", "x.topic", F.round("x.prob", 4).alias("prob"))


@query("q_svm")
def _(s, d):
    df = table(s, d, "embeddings").select("vec_id", "label", models.as_vector(F.col("embedding")).alias("features"))
    return models.fit_linear_svm(df, rounds=10).transform(df).select("vec_id", F.col("prediction").cast("int").alias("pred"), "label")


@query("q_soft_regression")
def _(s, d):
    soft = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 0.91).otherwise(0.01))
    df = table(s, d, "embeddings").select("vec_id", "label", models.as_vector(F.col("embedding")).alias("features"), soft.alias("soft_labels"))
    return models.fit_soft_labels(df, rounds=10).transform(df).select("vec_id", F.col("prediction").cast("int").alias("pred"))


@query("q_balanced_weights", "WITH x AS (SELECT label, count(*) AS c FROM train WHERE label IS NOT NULL GROUP BY 1) SELECT label, round(sum(c) OVER ()::DOUBLE / (count(*) OVER () * c), 6) AS weight FROM x")
def _(s, d):
    return models.balanced_weights(table(s, d, "train").where("label IS NOT NULL").select("label")).select("label", F.round("weight", 6).alias("weight")).distinct()


# ---- sources, sinks, streams: SRC, SNK, STM ------------------------------------------------------


@query("q_soft_rows", f"SELECT id, ({_ARGMAX.format(p='probabilities')})::INT AS cleaned_label, coalesce(split, 'unknown') AS original_split FROM soft_labels_reviewed")
def _(s, d):  # SRC-14
    return readers.soft_rows(table(s, d, "soft_labels_reviewed")).select("id", "cleaned_label", "original_split")


@query("q_distillation_rows", f"SELECT coalesce(nullif(text, ''), '') AS text, label, round({_CONF}, 6) AS confidence FROM train")
def _(s, d):  # SRC-16, 17
    return readers.distillation_rows(table(s, d, "train").select("text", "label", "soft_labels")).select("text", "label", F.round("confidence", 6).alias("confidence"))


@query("q_baseline_rows", "SELECT coalesce(id, '') AS id, coalesce(text, '') AS text, coalesce(label, 1) AS label FROM train")
def _(s, d):  # SNK-4
    return sinks.baseline_rows(table(s, d, "train"))


@query("q_split_fan_out", "SELECT CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE 'train' END AS split, count(*) AS n FROM soft_labels_reviewed GROUP BY 1")
def _(s, d):  # SNK-7
    return sinks.fan_out(table(s, d, "soft_labels_reviewed")).groupBy("split").agg(F.count("*").alias("n"))


@query(
    "q_csv_records",
    "SELECT trim(original_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8239) || chr(12288)) AS text, coalesce(CASE WHEN sentiment_label IN (0, 1, 2) THEN sentiment_label END, CASE WHEN rating IN (1, 2) THEN 0 WHEN rating = 3 THEN 1 WHEN rating IN (4, 5) THEN 2 END) AS label, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating "
    "FROM raw_records WHERE coalesce(regexp_matches(original_text, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]'), false) AND coalesce(CASE WHEN sentiment_label IN (0, 1, 2) THEN sentiment_label END, CASE WHEN rating BETWEEN 1 AND 5 THEN 1 END) IS NOT NULL",
)
def _(s, d):  # SRC-4
    df = table(s, d, "raw_records").select("original_text", F.col("sentiment_label").cast("string").alias("l"), F.col("rating").cast("string").alias("r"))
    return readers.csv_records(df, "original_text", "l", "r")


def _stub(rows: str) -> str:
    """What the stub scorer says of ``rows(id, text)``, in SQL."""
    return (
        f"WITH r AS ({rows}), k AS (SELECT id, ifnull(length(text), 0) % 7 AS a, ifnull(length(text), 0) % 5 AS b, ifnull(length(text), 0) % 3 + 1 AS c FROM r), p AS (SELECT id, a::DOUBLE / (a + b + c) AS p0, b::DOUBLE / (a + b + c) AS p1, c::DOUBLE / (a + b + c) AS p2 FROM k) "
        "SELECT id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)::INT AS hard_label, round(greatest(p0, p1, p2), 9) AS confidence FROM p"
    )


def _annotations(df):
    return df.select("id", *(F.round(F.col("probabilities")[i], 9).alias(f"p{i}") for i in range(3)), "hard_label", F.round("confidence", 9).alias("confidence"))


@query("q_stub_annotation", _stub("SELECT DISTINCT id, original_text AS text FROM raw_records"))
def _(s, d):  # SRC-19, JOIN-4, ML-14, UDF-3
    from textmill.streaming.annotate import annotate

    return _annotations(annotate(table(s, d, "raw_records").select("id", F.col("original_text").alias("text")).distinct()))


@query("q_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):  # STM-1, 6: the stream of the event file drained in one go
    from textmill.streaming.annotate import running_counts

    src = table(s, d, "events")
    name = f"counts_{uuid.uuid4().hex}"
    folder = shared_folder(s).rstrip("/") + f"/{name}"
    stream = running_counts(s.readStream.schema(src.schema).parquet(f"{d}/events.parquet*"), "event_type")
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name)


# ---- reports and the rest of the inventory: RPT, AGG-32..35, WIN-4, JOIN-6, PRJ-12, 14, 18 -------


@query(
    "q_f1_grid",
    _CLS + ", x AS (SELECT 'class_' || class AS metric, round(f, 4) AS v FROM m UNION ALL SELECT 'macro', round(sum(round(f, 4)) / 3, 4) FROM m) SELECT metric, v AS parsed, 1.0::DOUBLE AS perfect FROM x",
)
def _(s, d):  # RPT-1, AGG-32
    perfect = views.predictions(s, d).select("label", F.col("label").alias("pred"))
    return reports.f1_grid({"parsed": _parsed(s, d), "perfect": perfect})


@query("q_label_share", "SELECT source AS route, sentiment_label AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM raw_records GROUP BY 1, 2")
def _(s, d):  # RPT-3
    return reports.label_share(table(s, d, "raw_records"), F.col("sentiment_label"), F.col("source"))


@query("q_target_check", _PARSED[:-2] + " SELECT round(avg((label = pred)::INT), 4) AS accuracy, round(round(avg((label = pred)::INT), 4) - 0.865, 4) AS over_baseline, round(avg((label = pred)::INT), 4) >= 0.875 AS target_met FROM pr")
def _(s, d):  # RPT-5
    return reports.target_check(metrics.summary(_parsed(s, d)))


@query(
    "q_quality_bundle",  # RPT-7
    f"WITH x AS (SELECT (coalesce(nullif(list_position({_DEFAULT}, list_max({_DEFAULT})), 0) - 1, 2) <> {_LABEL})::INT AS bad, {_CONF} AS c, cot FROM train) "
    "SELECT count(*) AS n, sum(bad)::BIGINT AS mismatches, count(*) FILTER (c < 0.6) AS low, count(*) FILTER (len(coalesce(cot, '')) = 0) AS missing_cot FROM x",
)
def _(s, d):
    b = reports.quality_bundle(table(s, d, "train"))
    return b.select("soft.n", "soft.mismatches", "confidence.low", "fields.missing_cot")


@query("q_success_rate", _REPLY + f", p AS (SELECT {_ladder(_RUNGS_BATCH)} AS pred FROM r) SELECT count(*) AS n, count(*) FILTER (pred <> -1) AS succeeded, round(count(*) FILTER (pred <> -1) * 100.0::DOUBLE / count(*), 4) AS pct FROM p")
def _(s, d):  # AGG-35
    return reports.success_rate(_replies(s, d), parse.sentiment_batch(F.col("output")) != -1)


@query("q_batches", "WITH x AS (SELECT DISTINCT id FROM train), y AS (SELECT (row_number() OVER (ORDER BY md5(concat(id, ':42'))) - 1) // 64 AS batch FROM x) SELECT batch, count(*) AS n FROM y GROUP BY 1")
def _(s, d):  # WIN-4, SMP-5
    ranked = sampling.hash_rank(table(s, d, "train").select("id").distinct(), F.col("id"), F.lit(0))
    return ranked.groupBy(F.floor((F.col("_rn") - 1) / 64).alias("batch")).agg(F.count("*").alias("n"))


@query("q_lookup", "SELECT id, CASE length_category WHEN 'short' THEN 0 WHEN 'medium' THEN 1 WHEN 'long' THEN 2 ELSE 9 END AS code FROM processed_records")
def _(s, d):  # JOIN-6
    return table(s, d, "processed_records").select("id", reports.lookup(F.col("length_category"), {"short": 0, "medium": 1, "long": 2}, 9).alias("code"))


@query("q_train_prompt", "SELECT id, concat('Sentiment (0=neg,1=neu,2=pos):', chr(10), coalesce(text, ''), chr(10), 'Answer:') AS prompt, replace('{\"q\": \"{text}\"}', '{text}', coalesce(text, '')) AS filled FROM train")
def _(s, d):  # PRJ-14, 18
    return table(s, d, "train").select("id", chat.train_prompt(F.col("text")).alias("prompt"), chat.fill_template('{"q": "{text}"}', F.col("text")).alias("filled"))


@query("q_shuffled_take", "SELECT id FROM (SELECT DISTINCT id FROM raw_records) ORDER BY md5(concat(id, ':42')) LIMIT 200")
def _(s, d):  # SRC-2: the feature is a sample of n
    return readers.shuffled_take(table(s, d, "raw_records").select("id").distinct(), 200)


@query("q_truth_labels", "SELECT id, sentiment_label AS truth FROM raw_records WHERE sentiment_label IS NOT NULL")
def _(s, d):  # SRC-10
    return readers.truth_labels(table(s, d, "raw_records").select("id", "sentiment_label")).select("id", "truth")


@query("q_split_rows", "SELECT id FROM soft_labels_reviewed WHERE split = 'val'")
def _(s, d):  # SRC-15
    return readers.of_split(table(s, d, "soft_labels_reviewed"), "val").select("id")


@query("q_classifier_tokens", f"SELECT doc_id, len(list_filter({_TOK.format(c='text', p='^[a-z]+$')}, lambda w: len(w) > 2 AND NOT list_contains({_words(STOPWORDS_EN)}, w))) AS n FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def _(s, d):  # STR-10, 11
    df = table(s, d, "documents").where("lang = 'en' AND text IS NOT NULL")
    return df.select("doc_id", F.size(text.tokens_classifier(F.col("text"), F.col("lang"))).cast("long").alias("n"))


@query("q_coherence_npmi")
def _(s, d):
    words, assigned, size = _mixture(s, d)
    return topics.coherence_npmi(topics.topic_words(topics.cluster_words(words, assigned), size), words)


# ---- the rest of the inventory: AGG-5, 14, 16, 19, 31, PRJ-6, 20, ML-3, 5, 7..9, RPT-4, 6, SRT-1, UDF-2, 5, STM-4 ----

_SAMPLES = "WITH u AS (SELECT id, probabilities AS p FROM soft_labels_reviewed UNION ALL SELECT id, soft_labels FROM train), g AS (SELECT id, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c, count(*) AS n_samples FROM u WHERE len(p) = 3 AND p[1] IS NOT NULL AND p[2] IS NOT NULL AND p[3] IS NOT NULL GROUP BY 1) "


@query("q_multi_sample_by_id", _SAMPLES + "SELECT id, round(greatest(a, b, c), 6) AS confidence, (CASE WHEN round(a, 9) >= round(b, 9) AND round(a, 9) >= round(c, 9) THEN 0 WHEN round(b, 9) >= round(c, 9) THEN 1 ELSE 2 END)::INT AS hard_label, n_samples FROM g")
def _(s, d):  # AGG-19
    rows = table(s, d, "soft_labels_reviewed").select("id", "probabilities").unionByName(table(s, d, "train").select("id", F.col("soft_labels").alias("probabilities")))
    got = quality.multi_sample_mean(rows)
    label = F.array_position(F.transform("probabilities", lambda x: F.round(x, 9)), F.array_max(F.transform("probabilities", lambda x: F.round(x, 9)))) - 1
    return got.select("id", F.round("confidence", 6).alias("confidence"), label.cast("int").alias("hard_label"), "n_samples")


@query("q_overall_accuracy", _CAL + "SELECT count(*) AS n, sum(coalesce(guess = truth, false)::INT)::BIGINT AS hard_hits, sum(coalesce(calibrated = truth, false)::INT)::BIGINT AS calibrated_hits FROM (SELECT hard_label AS truth, hard_label AS guess, calibrated FROM y)")
def _(s, d):  # AGG-16
    got = quality.overall_accuracy(_calibrated(s, d), F.col("hard_label"), hard=F.col("hard_label"), calibrated=F.col("calibrated"))
    return got.select("n", "hard_hits", "calibrated_hits")


@query("q_merge_distribution", _MERGE + "SELECT predicted_label AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM f WHERE rn = 1 GROUP BY 1")
def _(s, d):  # AGG-14
    return quality.distribution(_merged(s, d), F.col("predicted_label"), "label")


@query(
    "q_mismatch_samples",  # AGG-5: the feature is a sample of five
    f"WITH x AS (SELECT id, {_LABEL} AS label, (CASE WHEN list_position({_DEFAULT}, list_max({_DEFAULT})) > 0 THEN list_position({_DEFAULT}, list_max({_DEFAULT})) - 1 ELSE 2 END)::INT AS soft_argmax FROM train) SELECT id, label, soft_argmax FROM x WHERE label <> soft_argmax ORDER BY id, label, soft_argmax LIMIT 5",
)
def _(s, d):
    return quality.mismatch_samples(table(s, d, "train")).select("id", "label", "soft_argmax")


@query("q_file_category", "SELECT id, concat('/data/cot_', coalesce(category, ''), '_0.jsonl') AS path, coalesce(string_split(concat('cot_', coalesce(category, ''), '_0'), '_')[2], 'unknown') AS category FROM raw_records WHERE coalesce(category, '') NOT LIKE '%/%'")
def _(s, d):  # PRJ-20
    df = table(s, d, "raw_records").where("coalesce(category, '') NOT LIKE '%/%'").select("id", F.concat(F.lit("/data/cot_"), F.coalesce("category", F.lit("")), F.lit("_0.jsonl")).alias("path"))
    return df.withColumn("category", records.file_category(F.col("path")))


@query(
    "q_quarantine",
    "SELECT CASE WHEN id IS NULL THEN 'no id' WHEN regexp_replace(coalesce(original_text, ''), '[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g') = '' THEN 'no text' WHEN language IS NULL OR language NOT IN ('zh', 'en', 'ru') THEN 'language' "
    "WHEN sentiment_label NOT IN (0, 1, 2) THEN 'label' WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating' ELSE 'processed' END AS reason, count(*) AS n FROM raw_records GROUP BY 1",
)
def _(s, d):  # PRJ-6
    good, bad = quality.quarantine(table(s, d, "raw_records"))
    return good.select(F.lit("processed").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "q_learning_curve",
    views.SQL + ", x AS (SELECT lang AS stage, count(*) AS n, round(avg((label = pred)::INT), 6) AS accuracy FROM v_pred WHERE lang IS NOT NULL GROUP BY 1) SELECT stage, n, accuracy, round(accuracy - lag(accuracy) OVER (ORDER BY stage), 6) AS gain FROM x",
)
def _(s, d):  # RPT-6
    return reports.learning_curve(views.predictions(s, d).where("lang IS NOT NULL"), "lang")


@query(
    "q_comparison",
    _CLS + "SELECT 'parsed' AS route, round((SELECT avg((label = pred)::INT) FROM pr), 4)::DOUBLE AS accuracy, round(sum(round(f, 4)) / 3, 4)::DOUBLE AS f1_macro, 108.31::DOUBLE AS train_seconds, 2.139::DOUBLE AS ms_per_sample FROM m UNION ALL SELECT 'perfect', 1, 1, NULL, NULL",
)
def _(s, d):  # RPT-4, SRT-1
    perfect = views.predictions(s, d).select("label", F.col("label").alias("pred"))
    return reports.comparison({"parsed": _parsed(s, d), "perfect": perfect}, {"parsed": 108.31}, {"parsed": 2.139})


@query("q_ranked_grid", views.SQL + "SELECT source, lang, round(avg((label = pred)::INT), 6) AS accuracy FROM v_pred WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def _(s, d):  # SRT-1
    per = views.predictions(s, d).where("lang IS NOT NULL AND source IS NOT NULL").groupBy("source", "lang").agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 6).alias("accuracy"))
    return models.ranked_grid(per, "accuracy", ["source", "lang"])


@query("q_training_means", views.SQL + "SELECT (doc_id % 3)::INT AS epoch, count(*) AS n, round(avg(p0), 6) AS avg_loss, round(avg(1 + p1), 6) AS avg_temp, round(avg(p1), 6) AS avg_ce, round(avg(p2), 6) AS avg_kl, min(1 + p1) AS min_temp, max(1 + p1) AS max_temp FROM v_pred GROUP BY 1")
def _(s, d):  # AGG-31
    df = views.predictions(s, d)
    return metrics.epoch_means(df, (F.col("doc_id") % 3).cast("int"), loss=F.col("p0"), temp=1 + F.col("p1"), ce=F.col("p1"), kl=F.col("p2"))


_SEEDS = " UNION ALL ".join(f"SELECT unnest({_words(ws)}) AS word, {i} AS class" for i, ws in enumerate((SEEDS_NEGATIVE, SEEDS_NEUTRAL, SEEDS_POSITIVE)))


@query(
    "q_cluster_labels",
    _MIX + f", seeds AS ({_SEEDS}), fd AS (SELECT doc, cluster FROM asg QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY doc) <= 50), "
    "sc AS (SELECT cluster, class, count(*)::DOUBLE AS s FROM top JOIN seeds USING (word) GROUP BY 1, 2 UNION ALL SELECT cluster, class, count(*) * 0.1::DOUBLE FROM dw JOIN fd USING (doc) JOIN seeds USING (word) WHERE class <> 1 GROUP BY 1, 2), "
    "sm AS (SELECT cluster, class, round(sum(s), 6) AS s FROM sc GROUP BY 1, 2), bs AS (SELECT cluster, class FROM sm QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, class) = 1) "
    "SELECT k::INT AS cluster, coalesce(class, CASE WHEN k IN (SELECT cluster FROM top) THEN 0 END, 1)::INT AS label FROM range(6) t(k) LEFT JOIN bs ON cluster = k",
)
def _(s, d):  # ML-7
    words, assigned, size = _mixture(s, d)
    return topics.cluster_labels(topics.topic_words(topics.cluster_words(words, assigned), size), assigned, words, 6)


def _fitted(s, d):
    """Words, clusters fitted with the defaults, and the vocabulary's size, over the documents of one language (``en``)."""
    words, _, size = _mixture(s, d)
    return words, topics.fit_mixture(words), size


@query("q_fitted_topics")
def _(s, d):  # ML-5, 6
    words, assigned, size = _fitted(s, d)
    return topics.topic_words(topics.cluster_words(words, assigned), size)


@query("q_gibbs")
def _(s, d):  # ML-5, UDF-4: sampled on a bounded group, the rest by prediction
    docs = table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"), text.tokens_topic(F.col("text")).alias("tokens"))
    sampled = checkpoint(topics.fit_gibbs(docs)).where("cluster >= 0")
    words, _, size = _mixture(s, d)
    known = words.join(sampled.select("doc"), "doc")
    got = topics.predict_mixture(docs, words, topics.cluster_words(known, sampled), topics.cluster_sizes(known, sampled, 15), size)
    return got.groupBy("cluster").agg(F.count("*").alias("docs"))


def _token_lists(s, d):
    return table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"), text.tokens_topic(F.col("text")).alias("tokens"))


@query("q_coherence_uci")
def _(s, d):  # ML-9
    words, assigned, size = _mixture(s, d)
    return topics.coherence_uci(topics.topic_words(topics.cluster_words(words, assigned), size), _token_lists(s, d))


@query("q_coherence_cv")
def _(s, d):  # ML-9
    words, assigned, size = _mixture(s, d)
    return topics.coherence_cv(topics.topic_words(topics.cluster_words(words, assigned), size), _token_lists(s, d))


@query("q_lda_topics")
def _(s, d):  # ML-8
    model, _ = topics.lda(table(s, d, "documents").where("lang = 'en'"), "doc_id", text.tokens_topic(F.col("text")))
    return topics.lda_topics(model).select("topic", "rank", "word", F.round("weight", 6).alias("weight"))


@query("q_platt")
def _(s, d):  # ML-2, 4
    from pyspark.ml.functions import vector_to_array

    df = table(s, d, "embeddings").select("vec_id", "label", models.as_vector(F.col("embedding")).alias("features"))
    scored = models.fit_linear_svm(df, rounds=10).transform(df)
    got = models.fit_platt(scored).transform(scored.drop("probability"))
    return got.select("vec_id", "label", F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))


@query("q_library_tokens", f"SELECT id, array_to_string({_EN_TOK}, ' ') AS tokens FROM processed_records WHERE text_for_llm IS NOT NULL AND regexp_full_match(text_for_llm, '[ -~\\s]*')")
def _(s, d):  # UDF-2 with the fall-backs of a machine without the libraries
    df = table(s, d, "processed_records").where(F.col("text_for_llm").isNotNull() & F.col("text_for_llm").rlike(r"\A[ -~\s]*\z"))
    return df.select("id", F.array_join(text.library_tokens(F.col("text_for_llm"), "en"), " ").alias("tokens"))


SUBWORDS = "/opt/tokenizers/byte_bpe_50k.json"


@query("q_subwords")
def _(s, d):  # UDF-5, ARR-10
    df = table(s, d, "train").select("id", features.subword_ids(F.col("text"), SUBWORDS).alias("ids"))
    return df.select("id", F.size("ids").alias("n"), features.fixed_length(F.col("ids")).alias("e")).select("id", "n", F.aggregate("e.attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"))


@query("q_limited_annotation", _stub("SELECT DISTINCT id, text FROM conversation_rows"))
def _(s, d):  # STM-4: eight workers, each waits after a call
    from textmill.streaming.annotate import annotate

    rows = table(s, d, "conversation_rows").select("id", "text").distinct()
    return _annotations(annotate(rows, workers=8, pause=0.001))


@query(
    "q_metrics_text",
    _CLS + "SELECT printf('accuracy %.4f  macro F1 %.4f  rows %d', (SELECT round(avg((label = pred)::INT), 4) FROM pr), (SELECT round(sum(round(f, 4)) / 3, 4) FROM m), (SELECT count(*) FROM pr)) || "
    "(SELECT string_agg(printf('%sclass %d: P %.4f R %.4f F1 %.4f n %d', chr(10), class, round(p, 4), round(r, 4), round(f, 4), support::BIGINT), '' ORDER BY class) FROM m) AS report",
)
def _(s, d):  # RPT-8, SNK-9
    rows = _parsed(s, d)
    return s.range(1).select(F.lit(reports.metrics_text(metrics.summary(rows), metrics.class_metrics(rows))).alias("report"))


# ---- files written and read again: SRC-1, 5, 8, 9, 11, 13, SNK-1, 2, 5, 6, PRJ-8; FLT-14, 16, STR-16, JSN-13, STM-2, 3, 5 ----


def _folder(s) -> str:
    return f"{shared_folder(s).rstrip('/')}/{uuid.uuid4().hex}"


_TRAIN_FILE = "SELECT id, text, label FROM train"


@query("q_jsonl_file", _TRAIN_FILE)
def _(s, d):  # SRC-1, 9, SNK-2
    path = _folder(s) + ".jsonl"
    sinks.write_jsonl(table(s, d, "train").select("id", "text", "label"), path)
    return readers.read_json(s, path, "id string, text string, label int")


@query("q_json_array_file", _TRAIN_FILE)
def _(s, d):  # SRC-1, SNK-1
    path = _folder(s)
    sinks.write_json_array(table(s, d, "train").select("id", "text", "label"), path)
    return readers.read_json(s, path, "id string, text string, label int")


@query("q_json_lines_file", _TRAIN_FILE)
def _(s, d):  # SRC-5
    path = _folder(s)
    sinks.write_jsonl(table(s, d, "train").select("id", "text", "label"), path)
    return readers.read_lines(s, path, "id string, text string, label int")


@query("q_csv_file", "SELECT coalesce(id, '') AS id, coalesce(text, '') AS text, coalesce(label, 1)::VARCHAR AS label FROM train")
def _(s, d):  # SRC-11, 13, SNK-5
    path = _folder(s)
    sinks.write_csv(sinks.baseline_rows(table(s, d, "train")), path)
    return readers.read_csv(s, path, ["id", "text", "label"]).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("id", "text", "label")))


@query("q_soft_label_file", f"SELECT coalesce(id, '') AS id, coalesce(hard_label, 1) AS hard_label, coalesce(confidence, 0.5)::DOUBLE AS confidence, round({_DEFAULT}[1], 9)::DOUBLE AS negative, 'train' AS split FROM train")
def _(s, d):  # SNK-6
    path = _folder(s) + ".jsonl"
    sinks.write_jsonl(sinks.soft_label_rows(table(s, d, "train")), path)
    rows = readers.read_json(s, path, "id string, text string, probabilities array<double>, hard_label int, confidence double, split string")
    return rows.select("id", "hard_label", "confidence", F.round(F.col("probabilities")[0], 9).alias("negative"), "split")


@query("q_split_places", "SELECT split, count(*) AS n, count(*) AS ids, count(*) - 1 AS last_place FROM soft_labels_reviewed WHERE split IN ('train', 'val', 'test') GROUP BY 1")
def _(s, d):  # SRC-8
    folder = _folder(s)
    for name in ("train", "val", "test"):
        sinks.write_jsonl(table(s, d, "soft_labels_reviewed").where(F.col("split") == name).select("text", "hard_label"), f"{folder}/{name}.jsonl")
    rows = readers.read_splits(s, folder, ["train", "val", "test"], "text string, hard_label int")
    place = F.substring_index("id", "_", -1).cast("long")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(place).alias("last_place"))


@query("q_split_conversations", "SELECT CASE label WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM train WHERE label IS NOT NULL GROUP BY 1")
def _(s, d):  # PRJ-8
    df = table(s, d, "train")
    made = chat.split_conversations({name: df.where(F.col("label") == k) for k, name in enumerate(("train", "val", "test"))})
    return made.groupBy("split").agg(F.count("*").alias("n"))


@query("q_nonempty_tokens", f"SELECT doc_id FROM documents WHERE lang = 'en' AND len({_TOPIC}) > 0")
def _(s, d):  # FLT-14
    return _token_lists(s, d).where(F.size("tokens") > 0).select(F.col("doc").alias("doc_id"))


@query("q_label_mode", "SELECT CASE WHEN (SELECT soft_labels IS NOT NULL FROM (SELECT [0.2, 0.8] AS soft_labels)) THEN 'soft' ELSE 'hard' END AS with_soft, 'hard' AS without_soft")
def _(s, d):  # FLT-16
    mode = lambda df: "soft" if readers.has_soft_labels(df) else "hard"
    rows = table(s, d, "train").where("soft_labels IS NOT NULL")
    return s.range(1).select(F.lit(mode(rows)).alias("with_soft"), F.lit(mode(rows.drop("soft_labels"))).alias("without_soft"))


@query("q_remove_prefix", "SELECT id, CASE WHEN starts_with(t, '<bos>') THEN substring(t, 6) ELSE t END AS text FROM (SELECT id, CASE WHEN label = 1 THEN '<bos>' ELSE '' END || text AS t FROM train)")
def _(s, d):  # STR-16
    marked = table(s, d, "train").select("id", F.concat(F.when(F.col("label") == 1, "<bos>").otherwise(""), "text").alias("t"))
    return marked.select("id", text.remove_prefix(F.col("t"), "<bos>").alias("text"))


@query("q_json_encode", "SELECT id, to_json({'sentiment': label, 'rationale': cot})::VARCHAR AS body FROM train WHERE label IS NOT NULL AND cot IS NOT NULL")
def _(s, d):  # JSN-13
    df = table(s, d, "train").where("label IS NOT NULL AND cot IS NOT NULL")
    return df.select("id", F.to_json(F.struct(F.col("label").alias("sentiment"), F.col("cot").alias("rationale"))).alias("body"))


@query("q_resumed_annotation", "SELECT DISTINCT id FROM train")
def _(s, d):  # STM-2, 3, FLT-15: the same stream twice, from two checkpoints, annotates each row once
    from textmill.streaming.annotate import run_annotation

    out, schema = _folder(s), table(s, d, "train").schema
    for _ in range(2):
        run_annotation(s, f"{d}/train.parquet*", schema, out, _folder(s))
    return s.read.parquet(out).select("id")


@query("q_first_of_each", "SELECT DISTINCT event_type FROM events")
def _(s, d):  # STM-5
    from textmill.streaming.annotate import append_lines, first_of_each

    out, schema = _folder(s), table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    append_lines(first_of_each(stream, "event_type", "ts", "3650 days"), out, _folder(s)).awaitTermination()
    return s.read.schema("event_type string").json(out)


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_LOWER = f"WITH t AS (SELECT doc_id, lang, trim(lower(coalesce(text, '')), {_BLANKS}) AS f FROM documents) "
_EN_WORDS = f"list_filter({_TOK.format(c='f', p='^[a-z]+$')}, lambda w: len(w) > 2 AND NOT list_contains({_words(STOPWORDS_EN)}, w))"


@query(
    "q_classifier_text",
    _LOWER + f"SELECT doc_id, CASE WHEN lang = 'en' THEN array_to_string({_EN_WORDS}, ' ') WHEN lang = 'zh' THEN array_to_string(list_filter(regexp_extract_all(f, '[一-鿿]'), lambda w: NOT list_contains({_words(CLASSIFIER_STOPWORDS_ZH)}, w)), ' ') ELSE f END AS text FROM t",
)
def _(s, d):  # STR-10
    return table(s, d, "documents").select("doc_id", text.classifier_text(F.col("text"), F.col("lang")).alias("text"))


@query("q_topic_list", _LOWER + f"SELECT doc_id, array_to_string(CASE WHEN lang = 'en' THEN {_EN_WORDS} WHEN lang = 'zh' THEN [] ELSE list_filter(regexp_split_to_array(f, '[' || {_WHITE} || ']+'), lambda w: len(w) > 0) END, ' ') AS words FROM t")
def _(s, d):  # STR-11
    return table(s, d, "documents").select("doc_id", F.array_join(text.topic_list(F.col("text"), F.col("lang")), " ").alias("words"))


@query(
    "q_parse_json",
    views.SQL + f", r AS (SELECT doc_id, {_aft('(' + _IN + ')', '<channel|>')} AS rest FROM v_out), j AS (SELECT doc_id, CASE WHEN regexp_matches(rest, '\"sentiment\":\\s*[0-2]') THEN nullif(regexp_extract(rest, '(?s)\\{{[^{{}}]*\\}}'), '') END AS body FROM r) "
    "SELECT doc_id, CASE WHEN json_valid(body) THEN body END AS body FROM j",
)
def _(s, d):  # JSN-7: the object of the result
    return views.outputs(s, d).select("doc_id", parse.stated_json(F.col("output")).alias("body"))

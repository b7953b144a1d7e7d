"""Problem 5: the language of each record and of each segment in another language.

One model per language (see ``ppm``) is fitted on at most ``SAMPLE_DOCS`` labelled documents per
language plus a seed text, then frozen. Every sentence of every text is scored by its exact code
length under all models. The record's main language is the one that holds most letters; a
sentence is in a second language if that language codes it shorter than the main one by a margin.
Languages follow the words: Russian or Ukrainian in Latin letters is scored by models fitted on
transliterated text.

Results for special input: a null, empty or letterless text holds no language and gives no row;
labels are compared by their meaning (``eng``, ``en-US`` and ``English`` are ``en``), blanks and
placeholders count as missing; whole rows delivered twice give one row. Whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.ppm import LANGUAGES, WORD, Scorer, words

#: Bound of the fitting sample: documents per language, and signs per document.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 4000
#: Least words (or Han signs) of a sentence that stands on its own, and its least lead in bits: so many a word, and no more than the second.
LEAST_WORDS = 2
LEAD_A_WORD, LEAD_BITS = 16.0, 40.0

#: Spellings of language labels.
_ALIASES = {
    "en": ("en", "eng", "english", "englisch", "английский", "英语", "英文"),
    "zh": ("zh", "zho", "chi", "cn", "chinese", "mandarin", "cmn", "中文", "汉语", "китайский"),
    "ru": ("ru", "rus", "russian", "русский", "俄语"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "uk": ("uk", "ukr", "ua", "ukrainian", "українська"),
}
_LABEL = {alias: lang for lang, names in _ALIASES.items() for alias in names}
_NONE = ("", "unknown", "und", "n/a", "na", "none", "null", "-", "--", "?", "unk", "undefined", "other", "xx", "zxx", "mul", "nan", "not specified", "unspecified", "tbd", ".", "auto")

_NOISE = re.compile(
    r"<[^<>]{0,200}>|&#?[0-9A-Za-z]{1,8};|https?://[!-~]+|[0-9A-Za-z_.+-]{1,64}\s?(?:[@＠]|[\[(]at[\])])\s?[0-9A-Za-z_-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[0-9A-Za-z_-]+)*|[0-9A-Za-z_.+-]{1,64}\s(?:at|собака|эт)\s[0-9A-Za-z_-]+(?:\s(?:dot|точка)\s[0-9A-Za-z_-]+)+|[^\W一-鿿]{0,80}\d[^\W一-鿿]*", re.I
)
_SENTENCE = re.compile(r"[^.!?。！？…\n|]+[.!?。！？…\n|]*")


def label_language(label: str | None) -> str | None:
    """Language a label names; ``None`` if it names none, ``other`` if it is not one of the six."""
    flat = (label or "").strip().lower()
    if flat in _NONE:
        return None
    return _LABEL.get(flat) or _LABEL.get(re.split(r"[-_ ]", flat)[0]) or "other"


def sentences(scorer: Scorer, text: str) -> list[tuple[int, int, int, str, float, dict]]:
    """``start, end, letters, language, lead, bits`` of each sentence that holds words."""
    blank = _NOISE.sub(lambda m: " " * len(m[0]), text) if re.search(r"[<&@＠\d]|http| (?:dot|точка) ", text, re.I) else text
    lower = blank.lower()
    if len(lower) != len(blank):
        lower = blank
    out = []
    for m in _SENTENCE.finditer(lower):
        tokens = WORD.findall(m[0])
        if tokens:
            lang, lead, bits = scorer.best(tokens)
            out.append((m.start(), m.end(), len(tokens), lang, lead, bits))
    return out


def segments(scorer: Scorer, text: str) -> list[tuple[int, int, str, float]]:
    """``start, end, language, confidence`` of the runs of one language; empty if there are no words."""
    rows = sentences(scorer, text)
    if not rows:
        return []
    weight: Counter = Counter()
    for _, _, n, lang, lead, _ in rows:
        if n >= 3 and lead >= 4:
            weight[lang] += n
    if not weight:
        bits = {k: sum(r[5][k] for r in rows) for k in rows[0][5]}
        weight[min(bits, key=bits.get)] = 1
    main = max(weight, key=lambda k: (weight[k], k))
    out: list[list] = []
    for start, end, n, lang, lead, bits in rows:
        other = lang != main and n >= LEAST_WORDS and bits[main] - bits[lang] >= min(LEAD_BITS, LEAD_A_WORD * n) and lead >= 1
        name = lang if other else main
        rival = min(v for k, v in bits.items() if k != name)
        lead = rival - bits[name]
        if out and out[-1][2] == name:
            out[-1][1] = end
            out[-1][3] += lead
        else:
            out.append([start, end, name, lead])
    return [(s, e, name, round(1 / (1 + 2 ** -max(min(lead, 50), -50)), 4)) for s, e, name, lead in out]


def fit_counts(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts per language of the bounded sample of ``docs(doc_id, text, lang)``."""
    labelled = docs.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # six counts thin a large language by hash before anything is ranked
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = F.when(F.col("lang") == lang, F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (2 * SAMPLE_DOCS)))) == 0).otherwise(keep)
    pick = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
    rows = labelled.where(keep).select("lang", "text", "doc_id").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= SAMPLE_DOCS).select("lang", "text").collect()
    counts: dict[str, Counter] = {}
    for row in rows:
        counts.setdefault(row["lang"], Counter()).update(words(row["text"]))
    return {k: dict(v) for k, v in counts.items()}


_SCORERS: dict[int, Scorer] = {}


def worker_scorer(key: int, counts: dict) -> Scorer:
    """The scorer of this worker process; built once per fit."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(counts)
    return _SCORERS[key]


def content_key(counts: dict[str, dict[str, int]]) -> int:
    """Number that differs for fits with different words or counts, so a worker never uses a model of another fit."""
    lines = (f"{lang}\t{word}\t{n}\n" for lang in sorted(counts) for word, n in sorted(counts[lang].items()))
    return xxhash.xxh64_intdigest("".join(lines)) >> 1


def fit(spark: SparkSession, sf_dir: str):
    """Broadcast of the fitted word counts; bounded by the sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    counts = fit_counts(docs)
    return spark.sparkContext.broadcast((content_key(counts), counts))


def record_segments(df: DataFrame, model, id_col: str = "id", label_col: str = "language", text_col: str = "original_text") -> DataFrame:
    """``id, label, start, end, language, confidence`` of every segment of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(*model.value)
        for batch in batches:
            ids, labels, starts, ends, langs, confs = [], [], [], [], [], []
            for rid, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                for start, end, lang, conf in segments(scorer, text):
                    ids.append(rid), labels.append(label), starts.append(start), ends.append(end), langs.append(lang), confs.append(conf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(labels, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(langs, pa.string()), pa.array(confs, pa.float64())],
                names=["id", "label", "start", "end", "language", "confidence"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "id string, label string, start int, end int, language string, confidence double")


def record_issues(df: DataFrame, model) -> DataFrame:
    """``id, issue, true_lang``; computed where the texts are scored, so only the found rows move on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(*model.value)
        for batch in batches:
            out = []
            for rid, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                held = list(dict.fromkeys(s[2] for s in segments(scorer, text)))
                if not held:
                    continue
                given = label_language(label)
                if given is None:
                    out.extend((rid, "missing", x) for x in held)
                elif given not in held:
                    out.extend((rid, "wrong", x) for x in held)
                if len(held) > 1:
                    out.extend((rid, "mixed", x) for x in held)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["id", "issue", "true_lang"])

    rows = df.select("id", "language", "original_text").where("id IS NOT NULL AND original_text IS NOT NULL")
    return rows.mapInArrow(run, "id string, issue string, true_lang string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet")
    return record_issues(df, fit(spark, sf_dir)).distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's segments with language and confidence."""
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet")
    return record_segments(df, fit(spark, sf_dir)).select("id", "start", "end", "language", "confidence").distinct()

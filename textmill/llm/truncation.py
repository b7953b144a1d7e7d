"""Problem 1: texts cut off by field limits or in transfer.

Near-copies are found by min-hash banding over five-word shingles (five Han signs). Every record
of a band bucket meets all others of the bucket that have as many words or more; large buckets are
met block by block, and only pairs where the longer record holds the shorter one's last two words
are walked. A pair is verified on the words themselves: if a record's words are the opening words
of a longer copy (``NEAR`` or more of them in order) and it stops inside one of the copy's
sentences, it is cut. A record without such a copy is judged by its closing words: a
terminality model says how likely they end a sentence (see ``terminality``). A record that has an
end mark and whose closing words are whole can only be found whole by its copies, so it is met as a
copy of others, and buckets that hold no other records need no look.

Results for special input: null, blank and wordless texts are not cut; a signature, a code or a
pictograph may end a whole text; dots after a whole sentence are a choice; whole rows delivered
twice count once. Whole texts are read; only the model is fitted on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.terminality import SAMPLE_TEXTS, Terminality, fit, flatten, judge
from textmill.runtime import stored

SHINGLE, BANDS, ROWS = 5, 8, 3
#: Least share of a record's words that a longer copy must open with, in order.
NEAR = 0.8
#: Records of a bucket that one task holds of either side.
BLOCK = 1500

_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_CLOSED = re.compile(r"(?:(?<!\.)\.|[!?。！？])[\s\"'”’»)\]]*$")
_MULT = np.array([1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)
_RNG = np.random.default_rng(17)
_A = (_RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_B = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def text_words(text: str) -> list[str]:
    return _WORD.findall(flatten(text).casefold())


def band_keys(texts: list[list[str]], salt: int = 0) -> np.ndarray:
    """``BANDS`` keys per text from the minima of its shingle hashes; texts shorter than a shingle use what they have."""
    hashes: dict[str, int] = {}
    flat: list[int] = []
    sizes = []
    for ws in texts:
        ws = ws + [""] * (SHINGLE - len(ws)) if len(ws) < SHINGLE else ws
        for w in ws:
            h = hashes.get(w)
            if h is None:
                h = hashes[w] = crc32(w.encode())
            flat.append(h)
        sizes.append(len(ws))
    words = np.array(flat, np.uint64)
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shingle = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        shingle[: len(words) - k] += words[k:] * _MULT[k]
    shingle ^= shingle >> np.uint64(29)
    keep = np.ones(len(words), bool)
    for k in range(1, SHINGLE):
        keep[ends - k] = False
    shingle = (shingle & _LOW)[keep]
    at = starts - np.arange(len(sizes)) * (SHINGLE - 1)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            i = band * ROWS + row
            mixed = (shingle * _A[i] + _B[i]) & _LOW
            keys[:, band] = keys[:, band] * np.uint64(0x100000001B3) + np.minimum.reduceat(mixed, at)
        keys[:, band] = keys[:, band] * np.uint64(31) + np.uint64(band + salt)
    return keys.view(np.int64)


def _fitted(df: DataFrame, text_col: str) -> Terminality:
    """Model of the corpus from at most ``2 * SAMPLE_TEXTS`` texts spread over it by hash."""
    texts = df.where(F.col(text_col).isNotNull()).select(F.col("id"), F.col(text_col).alias("t"))
    every = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * SAMPLE_TEXTS).select("t").collect()
    return fit(sorted(r["t"] for r in sample))


def judge_records(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``table_name, id, cls, cut, open, score, bands``: the hash of the text, the verdict of its closing words, whether its copies may change it, and its band keys."""
    model = df.sparkSession.sparkContext.broadcast(_fitted(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("t").to_pylist()
            words = [text_words(t) for t in texts]
            cut, score = zip(*(judge(model.value, t) for t in texts))
            keys = band_keys(words, crc32(name.encode()))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(texts), pa.string()), batch.column("id"), batch.column("cls"), pa.array(cut, pa.bool_()), pa.array([c or not _CLOSED.search(t, max(0, len(t) - 64)) for c, t in zip(cut, texts)], pa.bool_()), pa.array(score, pa.float64()), bands],
                names=["table_name", "id", "cls", "cut", "open", "score", "bands"],
            )

    rows = df.select("id", F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL").withColumn("cls", text_class(name))
    return rows.mapInArrow(run, "table_name string, id string, cls long, cut boolean, open boolean, score double, bands array<long>")


def text_class(name: str) -> Column:
    """Hash of a table's text ``t``: exact copies are one class, so only different texts meet."""
    return F.xxhash64(F.lit(name), "t")


def stops_inside(short: str, long: str, short_words: list[str] | None = None, long_words: list[str] | None = None) -> bool | None:
    """Whether ``short`` ends inside a sentence of ``long``; ``None`` if it is not an opening of it.

    A record with an end mark of its own where the copy goes on was reworded: its closing words decide.
    """
    a, b = short_words or text_words(short), long_words or text_words(long)
    if len(a) < 4 or len(b) < len(a):
        return None
    # walk both in step; a word changed, added or dropped may shift them by a few places
    i = j = same = 0
    while i < len(a) - 1 and j < len(b):
        if a[i] == b[j]:
            same, i, j = same + 1, i + 1, j + 1
            continue
        for step in range(1, 5):
            if j + step < len(b) and a[i] == b[j + step]:
                j += step
                break
            if i + step < len(a) and a[i + step] == b[j]:
                i += step
                break
        else:
            i, j = i + 1, j + 1
    if same < NEAR * (len(a) - 1) or same < 3 or a[i - 1] != b[j - 1] or j >= len(b):
        return None
    if a[-1] == b[j]:
        j += 1
    elif not b[j].startswith(a[-1]):
        return None
    elif len(a[-1]) < len(b[j]):
        return None if _CLOSED.search(short) else True
    if j >= len(b):
        return None
    # the copy goes on: was there an end of a sentence between its words j-1 and j?
    flat = flatten(long)
    spots = [m.span() for m in _WORD.finditer(flat)]
    cased = len(spots) == len(b)
    if not cased:
        flat = flat.casefold()
        spots = [m.span() for m in _WORD.finditer(flat)]
    if not re.search(r"[.!?。！？…]", flat):
        return None  # a copy without any end marks cannot tell where its sentences end
    between = flat[spots[j - 1][1] : spots[j][0]]
    if re.search(r"[.!?。！？…\n|]", between):
        return False
    before, after = (flat[x:y] for x, y in (spots[j - 1], spots[j]))
    if cased and after[0].isupper() and not before[0].isupper():
        return None  # a capital may open a sentence whose forerunner lost its mark
    return None if _CLOSED.search(short) else True


def inside_any(members: list[tuple[int, str, bool]], across: bool) -> list[bool | None]:
    """What alignment with the others of a bucket says of each open ``(block, text, open)``: true if any copy goes on inside a sentence.

    With ``across`` only pairs from different blocks are looked at.
    """
    cut = [text_words(t) for _, t, _ in members]
    # a record can only align where the copy has its last two words, the last one perhaps longer
    flat = [f" {' '.join(w)}" for w in cut]
    sets = [set(w) for w in cut]
    order = sorted(range(len(members)), key=lambda i: len(cut[i]), reverse=True)
    said: list[bool | None] = [None] * len(members)
    known: dict[str, bool | None] = {}
    at_least = 0
    for i in order:
        a, (block, text, is_open) = cut[i], members[i]
        while at_least < len(order) and len(cut[order[at_least]]) >= len(a):
            at_least += 1
        if len(a) < 4 or not is_open:
            continue
        if not across and text in known:
            said[i] = known[text]
            continue
        ending, opening = f" {a[-2]} {a[-1]}", set(a[:-1])
        for j in order[:at_least]:
            if ending in flat[j] and j != i and not (across and members[j][0] == block) and len(a) - 1 - len(opening - sets[j]) >= NEAR * (len(a) - 1) and members[j][1] != text:
                inside = stops_inside(text, members[j][1], a, cut[j])
                if inside is not None:
                    said[i] = inside
                    if inside:
                        break
        known[text] = said[i]
    return said


def aligned(judged: DataFrame, texts: DataFrame) -> DataFrame:
    """``cls, inside``: what the alignment with longer near-copies says of a text, for ``judged(cls, open, bands)`` and ``texts(cls, t)``.

    Buckets with the same members are looked at once. A bucket of more than ``BLOCK`` texts is
    cut into blocks and every two blocks meet in one place, so none is left out and no task holds
    more than two blocks.
    """
    keyed = judged.groupBy("cls").agg(F.first("bands").alias("bands"), F.first("open").alias("open")).select("cls", "open", F.explode(F.array_distinct("bands")).alias("band"))
    held = keyed.groupBy("band").agg(F.count("cls").alias("k"), F.bit_xor(F.xxhash64("cls")).alias("members"), F.bool_or("open").alias("open")).where("k > 1 AND open")
    held = held.groupBy("k", "members").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    met = keyed.join(held.select("band", blocks.alias("b")).hint("merge"), "band").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("b")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    met = met.select("cls", "open", "band", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    # each text is fetched once, and each bucket's rows follow one another
    rows = met.join(texts.groupBy("cls").agg(F.min("t").alias("t")).hint("merge"), "cls").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def told(held: list[tuple]) -> list[tuple]:
            if len(held) < 2:
                return []
            said = inside_any([r[:3] for r in held], bucket[1] != bucket[2])
            return [(cls, inside) for (*_, cls), inside in zip(held, said) if inside is not None]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_())], names=["cls", "inside"])

        for batch in batches:
            out = []
            for band, x, y, own, text, is_open, cls in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, x, y) != bucket:
                    out.extend(told(held))
                    bucket, held = (band, x, y), []
                held.append((own, text, is_open, cls))
            yield batch_of(out)
        yield batch_of(told(held))

    found = rows.select("band", "x", "y", "own", "t", "open", "cls").mapInArrow(run, "cls long, inside boolean")
    return found.groupBy("cls").agg(F.max("inside").alias("inside"))


def verdicts(sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``table_name, id, cut, inside`` for ``(table, rows with id, text column)``: the records that may be cut.

    Those left out have an end mark and whole closing words; ``inside`` is null where no copy was aligned.
    """
    judged = stored(reduce(DataFrame.unionByName, [judge_records(df, col, name).drop("score") for name, df, col in sources]))
    texts = reduce(DataFrame.unionByName, [df.select(F.col(col).alias("t")).where("t IS NOT NULL").select(text_class(name).alias("cls"), "t") for name, df, col in sources])
    found = aligned(judged.select("cls", "open", "bands"), texts)
    return judged.where("open").select("table_name", "id", "cls", "cut").join(found.hint("merge"), "cls", "left").drop("cls")


def truncated(sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``table_name, id`` of cut records: the alignment decides, and the closing words where there is none."""
    return verdicts(sources).where(F.coalesce("inside", "cut")).select("table_name", "id").distinct()


def _sources(spark: SparkSession, sf_dir: str):
    raw = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", "original_text")
    train = spark.read.parquet(f"{sf_dir}/train.parquet").select("id", "cot")
    return [("raw_records", raw, "original_text"), ("train", train, "cot")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(_sources(spark, sf_dir))


def p1_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, cut records and their share per table and source; train takes its source by id."""
    cut = stored(p1_found(spark, sf_dir))
    of_table = lambda name: cut.where(F.col("table_name") == name).select("id", F.lit(None).cast("string").alias("source"), F.lit(1).alias("cut"))
    # verdicts are grouped with the rows they belong to, so each table's ids move once
    raw = spark.read.parquet(f"{sf_dir}/raw_records.parquet").where("id IS NOT NULL").select("id", "source", F.lit(0).alias("cut"))
    raw = raw.union(of_table("raw_records")).groupBy("id").agg(F.min("source").alias("source"), F.max("cut").alias("cut"))
    train = spark.read.parquet(f"{sf_dir}/train.parquet").where("id IS NOT NULL").select("id", F.lit(None).cast("string").alias("source"), F.lit(0).alias("cut"))
    train = train.union(of_table("train")).groupBy("id").agg(F.max("cut").alias("cut")).join(raw.select("id", "source").hint("merge"), "id", "left")
    rows = raw.select(F.lit("raw_records").alias("table_name"), "source", "cut").unionByName(train.select(F.lit("train").alias("table_name"), "source", "cut"))
    return rows.groupBy("table_name", "source").agg(F.count("cut").alias("records"), F.sum("cut").alias("cut_records"), F.round(F.sum("cut") / F.count("cut"), 6).alias("cut_share"))

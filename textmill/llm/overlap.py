"""Problem 7: records of evaluation splits that also stand, exactly or almost, in training.

Texts are normalised to words (Han signs), and texts that are then equal form one class. Every
training class meets every evaluation class of like length, so no pair depends on a key, a sample
or a number of holders. Classes meet as bitmaps: each word of a text, its repetitions told apart,
turns over one bit, so the bits in which two bitmaps differ are never more than the words that one
text has and the other has not. A pair that differs in more bits than ``CHANGED`` allows can't be
close; an exact word alignment decides the rest. Bitmaps grow with the text, so they keep long
texts apart as well. Classes are parted by length, as only those of like length can be close, and
into blocks that hold no more than ``BLOCK`` bitmaps of ``BITS`` bits; a task meets one block of
either side. The number of meetings grows with the square of the classes, a few nanoseconds each.

The overlap fraction of either record of a pair comes from content-defined chunks: a chunk ends
where the rolling hash of the last ``WINDOW`` words meets a mask, so cuts move with the text; the
lengths of the chunks that both texts have are summed.

Results for special input: null texts, texts without words and rows without a split take no
part; split names are compared by meaning (``dev`` and ``validation`` are ``val``); repeated rows
count once. Whole texts are cut and aligned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.runtime import stored

#: Words that the rolling hash looks at, the mask it must meet, and the least and most words of a chunk.
WINDOW, MASK, LEAST, MOST = 2, 4, 2, 16
#: Largest share of changed, added or dropped words of the longer text.
CHANGED = 0.21

#: Least bits of a bitmap, which has four bits a word at least, and the bitmaps of so many bits that a task meets of either side.
BITS, BLOCK = 512, 30_000
#: Near lengths differ by a factor of less than this, so they stand in one length band or two beside each other.
BAND = 0.78
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(MOST, 0xC2B2AE3D27D4EB4F, np.uint64))

_JOINER = re.compile(r"(?<=[0-9a-z])[-./'’](?=[0-9a-z])")
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def words(text: str) -> list[str]:
    return _WORD.findall(_JOINER.sub("", text.casefold()))


def split_name(split: Column) -> Column:
    """train, val or test for any spelling; null for the rest."""
    flat = F.regexp_replace(F.lower(F.trim(split)), r"[^a-z]", "")
    return (
        F.when(flat.isin("train", "training", "trn", "tr"), "train")
        .when(flat.isin("val", "valid", "validation", "dev", "development", "eval"), "val")
        .when(flat.isin("test", "testing", "tst"), "test")
    )


_HASHES: dict[str, int] = {}


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each word; a worker keeps those it has seen, up to a bound."""
    if len(_HASHES) > 1_000_000:
        _HASHES.clear()
    known = _HASHES.get
    out = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        h = known(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def chunk_starts(hashes: np.ndarray) -> np.ndarray:
    """Places where the chunks of a text begin: behind words where the rolling hash of ``WINDOW`` words meets the mask."""
    rolling = hashes.copy()
    for k in range(1, WINDOW):
        rolling[k:] += hashes[:-k] * _BASE**np.uint64(k)
    starts = [0]
    for at in np.flatnonzero((rolling * _SPREAD >> np.uint64(32)) % np.uint64(MASK) == 0) + 1:
        while at - starts[-1] > MOST:
            starts.append(starts[-1] + MOST)
        if at - starts[-1] >= LEAST:
            starts.append(int(at))
    while len(hashes) - starts[-1] > MOST:
        starts.append(starts[-1] + MOST)
    if starts[-1] == len(hashes):
        starts.pop()
    return np.array(starts, np.int64)


def chunk_digests(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest of each chunk of a text, each once, and the words of all its places."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    starts = chunk_starts(hashes)
    spans = np.diff(np.append(starts, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(starts, spans)
    sums = np.add.reduceat(hashes * _POWERS[place], starts) + spans.astype(np.uint64)
    digests = (sums ^ (sums >> np.uint64(31))) * _SPREAD
    unique, at = np.unique(digests, return_inverse=True)
    return unique.view(np.int64), np.bincount(at, spans, len(unique)).astype(np.int32)


def close(a: list[str], b: list[str]) -> bool:
    """Whether at most ``CHANGED`` of the longer text's words were changed, added or dropped."""
    limit = int(CHANGED * max(len(a), len(b)))
    if abs(len(a) - len(b)) > limit:
        return False
    left = Counter(a)
    left.subtract(b)
    if max(sum(v for v in left.values() if v > 0), -sum(v for v in left.values() if v < 0)) > limit:
        return False
    shorter, head = min(len(a), len(b)), 0
    while head < shorter and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= limit
    codes: dict[str, int] = {}
    x = [codes.setdefault(w, len(codes)) for w in a]
    y = np.array([codes.setdefault(w, len(codes)) for w in b])
    places = np.arange(len(y) + 1)
    row = places.copy()
    for i, w in enumerate(x, 1):
        step = np.minimum(row[:-1] + (y != w), row[1:] + 1)
        row = np.concatenate(([i], step))
        row = np.minimum.accumulate(row - places) + places
        if row.min() > limit:
            return False
    return int(row[-1]) <= limit


def overlap_fractions(a: list[str], b: list[str]) -> tuple[float, float]:
    """Share of the words of either text that stand in chunks both have."""
    (x, m), (y, n) = chunk_digests(word_hashes(a)), chunk_digests(word_hashes(b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], n[j]).sum())
    return shared / max(len(a), 1), shared / max(len(b), 1)


def members(df: DataFrame) -> DataFrame:
    """``id, side, split, cls, text``: rows that take part with the class of their text."""
    rows = df.select("id", split_name(F.col("split")).alias("split"), "text").where("id IS NOT NULL AND split IS NOT NULL AND text IS NOT NULL").distinct()
    flat = F.regexp_replace(F.lower(F.upper("text")), r"[^\p{L}\p{N}\p{M}]+", "")
    return rows.withColumn("flat", flat).where("flat <> ''").select(
        "id", (F.col("split") == "train").alias("train"), "split", F.xxhash64(F.md5("flat")).alias("cls"), "text"
    )


def class_pairs(rows: DataFrame) -> DataFrame:
    """``cls_t, cls_e, part_t, part_e``: different classes that are close, and their overlap fractions."""
    classes = rows.groupBy("cls", "train").agg(F.min("text").alias("text"))
    classes = stored(classes.mapInArrow(mapped, "cls long, train boolean, text string, n int, bits binary"))
    pairs = stored(near_pairs(classes))
    texts = classes.select("cls", "train", "text")
    both = pairs.join(texts.where("train").select(F.col("cls").alias("cls_t"), F.col("text").alias("tt")).hint("merge"), "cls_t")
    both = both.join(texts.where("NOT train").select(F.col("cls").alias("cls_e"), F.col("text").alias("te")).hint("merge"), "cls_e")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ct, ce, tt, te in zip(*(x.to_pylist() for x in batch.columns)):
                a, b = words(tt), words(te)
                if close(a, b):
                    out.append((ct, ce, *overlap_fractions(a, b)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=["cls_t", "cls_e", "part_t", "part_e"],
            )

    return both.select("cls_t", "cls_e", "tt", "te").mapInArrow(verify, "cls_t long, cls_e long, part_t double, part_e double")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits that the words of a text turn over, a word's second place another bit than its first; a power of two of them."""
    wide = BITS
    while wide < 4 * len(hashes):
        wide *= 2
    ordered = np.sort(hashes)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    again = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    mixed = (ordered + again.astype(np.uint64) * _SPREAD) * _BASE
    places = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)).astype(np.int64) & wide - 1
    return np.packbits((np.bincount(places, minlength=wide) & 1).astype(np.uint8), bitorder="little")


def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of words and the bitmap."""
    for batch in batches:
        hashed = [word_hashes(words(text)) for text in batch.column("text").to_pylist()]
        bits = pa.array([bitmap(h).tobytes() if len(h) else b"" for h in hashed], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(h) for h in hashed], pa.int32()), bits], names=["cls", "train", "text", "n", "bits"])


def near_pairs(classes: DataFrame) -> DataFrame:
    """``cls_t, cls_e`` of all different classes across the splits whose lengths and bitmaps are near enough to be close, each pair once."""
    kept = classes.where("n > 0").select("cls", "train", "n", "bits", F.floor(F.log("n") / -math.log(BAND)).cast("int").alias("band"))
    held = {(r["band"], r["train"]): r["size"] for r in kept.groupBy("band", "train").agg(F.sum(F.length("bits")).alias("size")).collect()}  # tens of rows
    cells = []
    for band in sorted(k for k, train in held if train):
        beside = sum(held.get((band + step, False), 0) for step in (-1, 0, 1))
        if beside:
            cells.append((band, *(-(-size * 8 // (BITS * BLOCK)) for size in (held[band, True], beside))))
    blocks = F.broadcast(classes.sparkSession.createDataFrame(cells, "band int, bt int, be int"))
    # an evaluation class meets the training classes of its length band and of those beside it
    beside = kept.where("NOT train").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block among those of its side, and in each block of the other side."""
        placed = rows.join(blocks, "band").withColumn(own, F.pmod(F.xxhash64("cls"), F.col(f"b{own}")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"b{other}") - 1))).select("band", "t", "e", "train", "cls", "n", "bits")

    tasks = max(1, sum(bt * be for _, bt, be in cells))
    spread = side(kept.where("train"), "t", "e").union(side(beside, "e", "t")).repartition(tasks, "band", "t", "e")
    return spread.sortWithinPartitions("band", "t", "e").mapInArrow(met, "cls_t long, cls_e long")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each cell; a cell's rows follow each other."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "t", "e")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for start, stop in pairwise(cuts):
            if start < stop:
                now = tuple(keys[:, start].tolist())
                if now != key and held:
                    yield from cell_pairs(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(start, stop - start))
    if held:
        yield from cell_pairs(pa.Table.from_batches(held))


def cell_pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's training and evaluation rows whose bitmaps differ in no more bits than their lengths allow."""
    train, cls, n = (cell.column(c).to_numpy() for c in ("train", "cls", "n"))
    bits = cell.column("bits").to_pylist()
    sizes = np.array([len(x) for x in bits])
    wide = int(sizes.min()) // 8
    planes = np.empty((wide, len(bits)), np.uint64)
    for size in np.unique(sizes):  # longer bitmaps are folded to the shortest
        at = np.flatnonzero(sizes == size)
        folded = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1, wide)
        planes[:, at] = np.bitwise_xor.reduce(folded, axis=1).T
    limit = np.floor(CHANGED * n).astype(np.int32)
    few, many = sorted((np.flatnonzero(train), np.flatnonzero(~train)), key=len)
    many = many[np.argsort(n[many], kind="stable")]
    across, lengths, limits, ids = np.ascontiguousarray(planes[:, many]), n[many], limit[many], cls[many]
    # lengths less their limit never fall as lengths grow, so the near ones stand together
    starts = np.searchsorted(lengths, n[few] - limit[few])
    stops = np.searchsorted(lengths - limits, n[few], "right")
    some = 3 * wide // 8  # planes that rule out nearly all
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        one, other = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        t, e = (one, other) if len(few) and train[few[0]] else (other, one)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(e)], names=["cls_t", "cls_e"])

    for i, start, stop in zip(few.tolist(), starts.tolist(), stops.tolist()):
        if start >= stop:
            continue
        near = lengths[start:stop]
        allowed = 2 * np.maximum(limits[start:stop], limit[i]) - np.abs(near - n[i])
        differ = np.zeros(stop - start, np.uint8 if some < 4 else np.uint32)
        for k in range(some):
            differ += np.bitwise_count(across[k, start:stop] ^ planes[k, i])
        at = np.flatnonzero(differ <= allowed)
        rest = np.bitwise_count(across[some:, start + at] ^ planes[some:, i, None]).sum(0, dtype=np.int64)
        at = at[(differ[at] + rest <= allowed[at]) & (ids[start + at] != cls[i])]
        if len(at):
            found.append((np.full(len(at), cls[i]), ids[start + at]))
            size += len(at)
        if size > 100_000:
            yield batch()
            found, size = [], 0
    yield batch()


def cross_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members, and pairs of classes across splits: equal ones have both fractions 1."""
    taking_part = members(df)
    rows = stored(taking_part.drop("text"))
    both = rows.groupBy("cls").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e")).where("t AND e")
    same = both.select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_e"), F.lit(1.0).alias("part_t"), F.lit(1.0).alias("part_e"))
    return rows, stored(class_pairs(taking_part).unionByName(same))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id pairs, as asked; the members of paired classes are expanded last."""
    rows, pairs = cross_split(spark.read.parquet(f"{sf_dir}/soft_labels_reviewed.parquet"))
    t = rows.where("train").select(F.col("cls").alias("cls_t"), F.col("id").alias("i")).distinct()
    e = rows.where("NOT train").select(F.col("cls").alias("cls_e"), F.col("id").alias("j")).distinct()
    out = pairs.select("cls_t", "cls_e").join(t.hint("merge"), "cls_t").join(e.hint("merge"), "cls_e").where("i <> j")
    return out.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def p7_record_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation record with a match in training: its largest overlap fraction and the number of matching texts."""
    rows, pairs = cross_split(spark.read.parquet(f"{sf_dir}/soft_labels_reviewed.parquet"))
    best = pairs.groupBy(F.col("cls_e").alias("cls")).agg(F.max("part_e").alias("overlap"), F.countDistinct("cls_t").alias("train_texts"))
    return rows.where("NOT train").select("id", "split", "cls").distinct().join(best, "cls").select("id", "split", F.round("overlap", 6).alias("overlap"), "train_texts")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per split and source, those with a match in training, and the number of pairs."""
    rows, pairs = cross_split(spark.read.parquet(f"{sf_dir}/soft_labels_reviewed.parquet"))
    sources = spark.read.parquet(f"{sf_dir}/raw_records.parquet").groupBy("id").agg(F.min("source").alias("source"))
    train_size = rows.where("train").groupBy(F.col("cls").alias("cls_t")).agg(F.countDistinct("id").alias("m"))
    per = pairs.join(train_size, "cls_t").groupBy(F.col("cls_e").alias("cls")).agg(F.sum("m").alias("pairs"))
    recs = rows.where("NOT train").select("id", "split", "cls").distinct().join(per, "cls", "left").join(sources, "id", "left")
    return recs.groupBy("split", "source").agg(
        F.countDistinct("id").alias("records"), F.count("pairs").alias("matched_records"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that takes part, the class of its text, and the number of classes it is close to across splits."""
    rows, pairs = cross_split(spark.read.parquet(f"{sf_dir}/soft_labels_reviewed.parquet"))
    ends = pairs.select(F.col("cls_t").alias("cls"), F.lit(True).alias("train"), F.col("cls_e").alias("to")).union(pairs.select("cls_e", F.lit(False), "cls_t"))
    links = ends.groupBy("cls", "train").agg(F.count("to").alias("links"))
    held = rows.select("id", "split", "train", "cls").distinct().join(links, ["cls", "train"], "left")
    return held.select("id", "split", F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

"""Problem 10: one consistent form for texts that look alike but hold other characters.

DuckDB runs inside each Arrow batch. One SQL expression folds compatibility forms (full width,
ligatures, radicals), composes accents with ``nfc_normalize``, drops invisible signs, makes all
blanks and hyphens one kind and maps look-alike letters to one script. The result depends only
on what can be seen, so two texts get the same form exactly if they look the same.

Letter case, accents, digits, line breaks and visible signs are kept. A word that holds a letter
only Cyrillic has is written in Cyrillic; other ambiguous words follow the script of the text.

Results for special input: a null text stays null and equals nothing; an empty text keeps the
empty form. Repeated rows count once. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.runtime import stored

#: Cyrillic and Greek letters and the Latin letters they look like.
_CYRILLIC = "аеорсухіјѕԁһԛԝѵӏАВЕКМНОРСТУХІЈЅԌԚԜҮ"
_CYRILLIC_AS = "aeopcyxijsdhqwvlABEKMHOPCTYXIJSGQWY"
_CYRILLIC_MARKED = "ёЁїЇ"
_CYRILLIC_MARKED_AS = "ëËïÏ"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ"
_GREEK_AS = "ABEZHIKMNOPTYXovc"
_LATIN = "ɑɡ"
_LATIN_AS = "ag"
#: Signs that look the same as another sign.
_SIGNS = "‐‑⁃﹣−ʼ‚․∶"
_SIGNS_AS = "-----’,.:"
#: Simplified radicals and the ideographs they look like.
_RADICALS = "⺁⺄⺈⺌⺍⺮⺼⻁⻄⻅⻆⻉⻋⻌⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻩⻬⻮⻰⻳"
_RADICALS_AS = "厂乙刀小小竹肉虎西见角贝车辶长门青韦页风飞食马骨鬼鱼鸟黄齐齿龙龟"
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}]"
_BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\t]"


def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """One-to-one pairs and replacements of compatibility forms, built from the Unicode tables of Python.

    Ranges: Kangxi radicals, CJK compatibility ideographs, half and full width forms, Latin
    ligatures, letter-like and mathematical letters, enclosed and small forms are left as they
    can be seen to differ, except those ranges named here.
    """
    import unicodedata

    one, many = {}, []
    for lo, hi in ((0x2E80, 0x2FE0), (0xF900, 0xFB00), (0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x2026, 0x2027)):
        for code in range(lo, hi):
            sign = chr(code)
            flat = unicodedata.normalize("NFKC", sign)
            if flat != sign:
                if len(flat) == 1:
                    one[sign] = flat
                else:
                    many.append((sign, flat))
    return "".join(one), "".join(one.values()), many


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalize_sql(column: str = "text") -> tuple[str, str]:
    """SQL of the skeleton of ``column``, and of the final form of a column ``sk`` with that skeleton."""
    one, flat, many = _compatibility()
    sql = f"translate({column}, {_quote(one + _RADICALS + _SIGNS)}, {_quote(flat + _RADICALS_AS + _SIGNS_AS)})"
    for sign, text in many:
        sql = f"replace({sql}, {_quote(sign)}, {_quote(text)})"
    sql = f"regexp_replace({sql}, {_quote(_INVISIBLE)}, '', 'g')"
    sql = f"regexp_replace({sql}, '\\r\\n?|[\\x{{0085}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    sql = f"regexp_replace({sql}, {_quote(_BLANKS)}, ' ', 'g')"
    sql = f"nfc_normalize({sql})"
    sql = f"translate({sql}, {_quote(_CYRILLIC + _CYRILLIC_MARKED + _GREEK + _LATIN)}, {_quote(_CYRILLIC_AS + _CYRILLIC_MARKED_AS + _GREEK_AS + _LATIN_AS)})"
    # accents that met a look-alike only now compose with it
    skeleton = f"nfc_normalize({sql})"
    back = f"translate(w, {_quote(_CYRILLIC_AS + _CYRILLIC_MARKED_AS)}, {_quote(_CYRILLIC + _CYRILLIC_MARKED)})"
    only_cyrillic = r"\p{Cyrillic}"
    # letters that neither alphabet shares: a word with one of them shows its script
    ambiguous = "^[" + "".join(sorted(set(_CYRILLIC_AS + _CYRILLIC_MARKED_AS))) + "]+$"
    words = r"regexp_extract_all(sk, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+')"
    cyr_text = (
        f"len(list_filter({words}, lambda w: regexp_matches(w, '{only_cyrillic}'))) > "
        f"len(list_filter({words}, lambda w: regexp_matches(w, '\\p{{Latin}}') AND NOT regexp_matches(w, '{only_cyrillic}') AND NOT regexp_matches(w, {_quote(ambiguous)})))"
    )
    form = (
        f"CASE WHEN NOT regexp_matches(sk, '{only_cyrillic}') THEN sk ELSE array_to_string(list_transform({words}, "
        f"lambda w: CASE WHEN regexp_matches(w, '{only_cyrillic}') OR (cyr AND regexp_matches(w, {_quote(ambiguous)})) THEN {back} ELSE w END), '') END"
    )
    return skeleton, f"SELECT id, raw, {form} AS form FROM (SELECT id, raw, sk, {cyr_text} AS cyr FROM skeletons)"


def _run_sql(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """``id, raw`` and the ``column`` asked for, ``form`` or ``sk``, from DuckDB inside each batch."""
    skeleton, form = normalize_sql("raw")
    con = duckdb.connect(config={"threads": 1})
    schema = pa.schema([("id", pa.int64()), ("raw", pa.string()), (column, pa.string())])
    for batch in batches:
        if batch.num_rows == 0:
            continue
        con.register("batch", pa.Table.from_batches([batch]))
        if column == "form":
            con.execute(f"CREATE OR REPLACE TEMP TABLE skeletons AS SELECT id, raw, {skeleton} AS sk FROM batch")
        out = con.sql(form if column == "form" else f"SELECT id, raw, {skeleton} AS sk FROM batch").to_arrow_table().cast(schema)
        con.unregister("batch")
        yield from out.to_batches()


def normalize_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, raw, form``: each text and its consistent form."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("raw"))
    return rows.mapInArrow(lambda batches: _run_sql(batches, "form"), "id long, raw string, form string")


def skeletons(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, raw, sk``: the skeleton alone, which two texts share exactly if they share their form, at half the cost."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("raw"))
    return rows.mapInArrow(lambda batches: _run_sql(batches, "sk"), "id long, raw string, sk string")


def look_classes(df: DataFrame) -> DataFrame:
    """``id, look, stored``: hashes of what a text looks like and of what it is stored as, for all rows with both."""
    rows = skeletons(df).where("id IS NOT NULL AND raw IS NOT NULL")
    return stored(rows.select("id", F.md5("sk").alias("look"), F.md5("raw").alias("stored")).distinct())


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look alike and differ in storage.

    Equal texts are one member with all its ids, so only different spellings of one form meet;
    their ids are expanded last, as the asked columns name documents.
    """
    keyed = look_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spellings = keyed.groupBy("look", "stored").agg(F.lit(1).alias("one"))
    mixed = spellings.groupBy("look").agg(F.count("stored").alias("k")).where("k > 1").select("look")
    spellings = spellings.join(mixed, "look").select("look", "stored")
    a, b = spellings.select("look", F.col("stored").alias("sa")), spellings.select("look", F.col("stored").alias("sb"))
    pairs = a.join(b, "look").where("sa < sb")
    ids = keyed.select("stored", "id")
    both = pairs.join(ids.select(F.col("stored").alias("sa"), F.col("id").alias("ia")), "sa").join(ids.select(F.col("stored").alias("sb"), F.col("id").alias("ib")), "sb")
    return both.where("ia <> ib").select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()


def p10_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's consistent form, and whether it differs from what is stored."""
    rows = normalize_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), F.col("form").alias("text"), (~F.col("raw").eqNullSafe(F.col("form"))).alias("changed")).distinct()


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of equal looks (named by its smallest id) and the number of spellings and documents of the class."""
    keyed = look_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spellings = keyed.groupBy("look", "stored").agg(F.min("id").alias("first"), F.countDistinct("id").alias("n"))
    classes = spellings.groupBy("look").agg(F.min("first").alias("class_id"), F.count("stored").alias("spellings"), F.sum("n").alias("documents"))
    return keyed.select("id", "look").distinct().join(classes, "look").select(F.col("id").alias("doc_id"), "class_id", "spellings", "documents").distinct()

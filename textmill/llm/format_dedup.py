"""Problem 6: records that are equal but for white space, case, punctuation or field order.

Every text becomes a multiset of (field name, value) pairs in normal form. Each pair is hashed,
the hashes are combined by a commutative sum and xor, records are grouped by that fingerprint,
and each member's pairs are compared with those of its group's first record, without sorting.

Results for special input: a null or blank text, or one of punctuation only, has no pairs and
belongs to no group (``class_id`` is its own id, ``copies`` counts its own id once). Whole rows
delivered twice count once. Other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.runtime import stored

#: Names of labelled fields, longest first where one holds another.
FIELD_LABELS = (
    "pros", "cons", "comment", "liked", "disliked", "verdict",
    "плюсы", "минусы", "итог", "достоинства", "недостатки", "комментарий",
    "优点", "缺点", "总结", "不满意", "满意", "备注",
)

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_MODULUS = (1 << 61) - 1


def _is_han(text: str) -> bool:
    return "一" <= text[0] <= "鿿"


def normal_form(text: Column) -> Column:
    """Width, case, punctuation and blanks folded away; one blank between words, none between Han signs."""
    flat = F.translate(F.regexp_replace(text, r"\\[nrt]", " "), _WIDE, _NARROW)
    flat = F.lower(F.upper(flat))
    flat = F.regexp_replace(flat, r"[^\p{L}\p{N}\p{M}]+", " ")
    han_joined = lambda x: F.when(x.rlike("[一-鿿]"), F.regexp_replace(x, r"(?<=[一-鿿]) (?=[一-鿿])", "")).otherwise(x)
    return F.trim(_let(flat, han_joined))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def fields(text: Column, labels: tuple[str, ...] = FIELD_LABELS) -> Column:
    """Array of ``label\\x02value`` with no blanks in the values; an unlabelled text is one pair without label."""
    words = "|".join(x for x in labels if not _is_han(x))
    han = "|".join(x for x in labels if _is_han(x))

    def split(norm: Column) -> Column:
        marked = F.regexp_replace(norm, rf"(?<![^ ])({words})(?![^ ])|({han})", "\u0001$1$2\u0002")
        labelled = norm.rlike(rf"^(?:(?:{words})(?![^ ])|(?:{han}))")
        pieces = F.split(F.when(labelled, marked).otherwise(F.concat(F.lit("\u0002"), norm)), "\u0001")
        return F.transform(F.filter(pieces, lambda x: F.length(x) > 0), lambda x: F.replace(x, F.lit(" "), F.lit("")))

    return _let(normal_form(text), split)


def fingerprint(pairs: Column) -> Column:
    """Commutative hash of a multiset: sum modulo 2^61-1, xor of a second hash, and size."""
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(F.xxhash64(x), 4)) % F.lit(_MODULUS))
    mixed = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(F.lit("second"), x)))
    return F.struct(total.alias("s"), mixed.alias("x"), F.size(pairs).alias("n"))


def _same_multiset(a: Column, b: Column) -> Column:
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: count(a, x) == count(b, x))


def collapse_formatting(df: DataFrame, id_col: str = "id", text_col: str = "original_text", task_rows: int = 20_000) -> DataFrame:
    """One row per distinct id: ``id, class_id`` (smallest id of its class) and ``copies`` of the class.

    The fingerprints alone are counted first; texts are taken up again only for groups of two
    and more. There the first record's pairs are copied to ``salts`` salts and members spread over
    them: a group with a third of all rows is compared in ``salts`` tasks.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")

    def summary(pairs: Column) -> Column:
        blank = F.forall(pairs, lambda x: x == "\u0002")
        return F.when(~blank, fingerprint(pairs))

    # stored, as it is read three times and costs a pass over all texts
    seen = stored(rows.select("id", _let(fields(F.col("t")), summary).alias("fp"))).where("fp IS NOT NULL")
    groups = seen.groupBy("fp").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.ceil(F.count("id") / task_rows).cast("int").alias("salts")).where("first_id < last_id")
    # only ids move here; the texts of groups of two and more are fetched and taken apart again
    wanted = seen.join(groups.select("fp", "first_id", "salts").hint("merge"), "fp").select("id", "fp", "first_id", "salts").distinct()
    members = stored(rows.join(wanted.hint("merge"), "id").withColumn("p", fields(F.col("t"))).drop("t"))
    own = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    first = members.where("id = first_id").groupBy("fp").agg(F.first("p").alias("q"), F.first("salts").alias("salts"))
    first = first.withColumn("salt", every).drop("salts")
    checked = (
        members.withColumn("salt", own).join(first.hint("merge"), ["fp", "salt"])
        .withColumn("same", _same_multiset(F.col("p"), F.col("q")))
    )
    # a record whose fingerprint collides is grouped with its equals by its own pairs
    key = F.when(F.col("same"), F.lit("")).otherwise(F.concat_ws("\u0001", F.array_sort("p")))
    classed = checked.select("id", "fp", "salts", key.alias("k")).distinct()
    sizes = classed.groupBy("fp", "k").agg(F.min("id").alias("class_id"), F.count("id").alias("copies"), F.first("salts").alias("salts"))
    sizes = sizes.withColumn("salt", every).drop("salts")
    grouped = classed.withColumn("salt", own).join(sizes.hint("merge"), ["fp", "k", "salt"]).select("id", "class_id", "copies")
    return grouped


def p6_found(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet")
    out = collapse_formatting(df)
    return out.where("id <> class_id").select(F.col("class_id").alias("first_id"), "id").distinct()


def p6_collapsed(spark, sf_dir):
    """One record per text with the number of its copies; singletons included."""
    df = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", "original_text")
    classes = collapse_formatting(df)
    ids = df.where("id IS NOT NULL").groupBy("id").agg(F.lit(1).alias("one")).drop("one")
    return (
        ids.join(classes, "id", "left")
        .select(F.coalesce("class_id", "id").alias("id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
        .distinct()
    )

"""Column expressions over review records: labels, lengths, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rating_to_label(rating: Column, strict: bool = False) -> Column:
    """1, 2 are negative, 3 neutral, 4, 5 positive; anything else is null, or an error if ``strict``."""
    known = F.when(rating.isin(1, 2), 0).when(rating == 3, 1).when(rating.isin(4, 5), 2)
    return known.otherwise(F.raise_error(F.lit("rating out of range")).cast("int")) if strict else known


def expected_label(rating: Column) -> Column:
    """Label a rating suggests, with no check of its range."""
    return F.when(rating <= 2, 0).when(rating == 3, 1).otherwise(2)


def length_category(words: Column, short_max: int = 15, medium_max: int = 50) -> Column:
    return F.when(words <= short_max, "short").when(words <= medium_max, "medium").otherwise("long")


def truncated_int(value: Column) -> Column:
    """Whole part of a number given as text (towards zero); null if it is none."""
    number = value.try_cast("double")
    return F.when(number.between(-2147483648, 2147483647), number.cast("int"))


def valid_rating(rating: Column) -> Column:
    return F.when(rating.between(1, 5), rating)


def valid_label(label: Column) -> Column:
    return F.when(label.isin(0, 1, 2), label)


def blank_to_null(value: Column) -> Column:
    return F.when(F.length(F.trim(value)) > 0, value)


def has_text(value: Column) -> Column:
    """True for text with at least one sign that is no white space (Unicode)."""
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def valid_soft_label(soft: Column, tolerance: float = 1e-6) -> Column:
    """Null passes; else three values in 0..1 with sum 1 within ``tolerance``."""
    total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    inside = F.forall(soft, lambda x: F.coalesce(x.between(0, 1), F.lit(False)))
    return soft.isNull() | ((F.size(soft) == 3) & inside & (F.abs(total - 1) <= tolerance))


def preview(value: Column, signs: int) -> Column:
    return F.substring(value, 1, signs)


def file_category(path: Column) -> Column:
    """Second part between underscores of a file's name without its ending; ``unknown`` where there is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce(F.get(F.split(stem, "_"), F.lit(1)), F.lit("unknown"))

"""Naming a value inside one expression, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is evaluated once.

    The optimizer inlines a projected expression into every use of it; for long expressions
    that blows the generated code up beyond what the JVM compiles.
    """
    return F.transform(F.array(value), use)[0]

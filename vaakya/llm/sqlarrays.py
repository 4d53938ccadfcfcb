"""Native array idioms: a value bound once inside an expression, and prefix sums in linear space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word class ``[^\x20\x09-\x0D]``, as a Java character class body.
WHITE = r"\x20\x09-\x0D"
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """Sum of all values before each place; chunked, so n values take about n * CHUNK steps."""

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int") - 1)
        sums = F.transform(chunks, lambda c: total(F.slice(v, c * CHUNK + 1, CHUNK)))
        return let(
            sums,
            lambda s: F.transform(
                v,
                lambda x, i: total(F.slice(s, F.lit(1), (i / CHUNK).cast("int")))
                + total(F.slice(v, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))

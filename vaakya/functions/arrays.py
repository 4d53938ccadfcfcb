"""Array idioms: a value bound once inside an expression, and running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of which a running count is taken at once.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda a, x: a + x)


def running(flags: Column) -> Column:
    """Sum of an array of whole numbers up to and with each place.

    Sums of chunks are taken first, so n elements take about n * CHUNK steps and n / CHUNK
    values beside the result.
    """

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int") - 1)
        sums = F.transform(chunks, lambda c: _count(F.slice(v, c * CHUNK + 1, CHUNK)))
        # sums of all chunks before each, over the few sums
        before = let(sums, lambda s: F.transform(s, lambda _, c: _count(F.slice(s, F.lit(1), c))))
        return let(
            before,
            lambda b: F.transform(
                v, lambda _, i: F.get(b, (i / CHUNK).cast("int")) + _count(F.slice(v, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1))
            ),
        )

    return let(flags, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))

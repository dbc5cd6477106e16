"""Column expressions: array arithmetic and seeded draws, all evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stforecast.functions.numeric import KEY_FACTORS, MIX_SHIFTS, PRIME


def square_even(x: Column) -> Column:
    """Square every second entry (the 2nd, 4th, ...) of an array."""
    return F.transform(x, lambda v, i: F.when(i % 2 == 1, v * v).otherwise(v))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def add_arrays(arrays: Column) -> Column:
    """Element-wise sum over an array of equally long arrays (at least one)."""
    return F.aggregate(
        F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))),
        arrays[0],
        lambda s, v: F.zip_with(s, v, lambda p, q: p + q),
    )


def pick(values: Column, positions: Column) -> Column:
    """``values[p]`` for every 0-based position."""
    return F.transform(positions, lambda p: F.get(values, p))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once for the row.

    Spark merges projections, so a computed column that is read inside a lambda would be
    computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seeded_int_sql(*parts: str | int) -> str:
    """Well-mixed integer in [0, PRIME) from up to six non-negative integer keys.

    Keys are SQL expressions over the row (column names, lambda variables) or numbers.
    SQL text keeps a long expression to one call into the JVM.
    """
    terms = " + ".join(
        f"(CAST({part} AS BIGINT) % {PRIME}L) * {factor}L"
        for factor, part in zip(KEY_FACTORS, parts, strict=False)
    )
    x = f"((12345L + {terms}) % {PRIME}L)"
    for shift in MIX_SHIFTS:
        x = f"(({x} * {x} + {x} * {shift}L + 11L) % {PRIME}L)"
    return x


def seeded_uniform_sql(*parts: str | int) -> str:
    return f"((CAST({seeded_int_sql(*parts)} AS DOUBLE) + 0.5D) / {float(PRIME)!r}D)"


def seeded_normal_sql(*parts: str | int) -> str:
    radius = f"sqrt(-2.0D * ln({seeded_uniform_sql(*parts, 1)}))"
    return f"({radius} * cos({2.0 * math.pi!r}D * {seeded_uniform_sql(*parts, 2)}))"


def seeded_int(*parts: str | int) -> Column:
    """Well-mixed integer in [0, PRIME)."""
    return F.expr(seeded_int_sql(*parts))


def seeded_uniform(*parts: str | int) -> Column:
    """Uniform draw in (0, 1)."""
    return F.expr(seeded_uniform_sql(*parts))


def seeded_normal(*parts: str | int) -> Column:
    """Standard normal draw (Box-Muller on two seeded uniforms)."""
    return F.expr(seeded_normal_sql(*parts))

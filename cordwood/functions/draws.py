"""Deterministic uniform draws by position, as column arithmetic.

The Mulberry32 generator adds a constant per step, so draw ``k`` depends on ``k`` alone and each
row can compute its own draws: the result does not depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The increment of Mulberry32 and its word size.
INCREMENT = 0x6D2B79F5
WORD = 0xFFFFFFFF


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _word(x: Column) -> Column:
    return x.bitwiseAND(_big(WORD))


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2^32; the right factor goes in 16-bit halves to stay inside a BIGINT."""
    low = a * b.bitwiseAND(_big(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(_big(0xFFFF))
    return _word(low + F.shiftleft(high, 16))


def with_draws(df: DataFrame, seed: int, row: Column, names: Sequence[str]) -> DataFrame:
    """Add one uniform column in [0, 1) per name; row ``r`` takes draws ``r*n+1 … r*n+n``.

    Each round of mixing is a projection of its own: written as one expression the rounds would
    repeat their input hundreds of times.
    """
    first = row.cast("bigint") * len(names)

    def each(f) -> dict[str, Column]:
        return {name: f(i, F.col(name)) for i, name in enumerate(names)}

    step = _big(INCREMENT)
    df = df.withColumns(
        each(lambda i, _: _word(_times(_word(first + (i + 1)), step) + _big(seed & WORD)))
    )
    df = df.withColumns(
        each(lambda _, t: _times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(_big(1))))
    )
    df = df.withColumns(
        each(
            lambda _, t: t.bitwiseXOR(
                _word(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(_big(61))))
            )
        )
    )
    return df.withColumns(
        each(lambda _, t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0))
    )


def pick(choices: Sequence[str], uniform: Column) -> Column:
    """The element a uniform draw falls on."""
    index = F.floor(uniform * len(choices)).cast("int")
    return F.array(*[F.lit(c) for c in choices])[index]

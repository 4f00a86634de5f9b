"""Column expressions: missing values, transforms, and keyed hashes that stand in for random draws.

A draw is a function of a seed and of key columns, so a lost task draws the same again and DuckDB can reproduce it.  A public seed gives
no privacy: ``privacy.Noise`` keeps the two modes apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that a categorical column may have.
MOST_LEVELS = 100_000
#: Stand-ins for missing values in encoded tables (fixed values).
MISSING_NUMBER, MISSING_TEXT = -9999999.0, "empty"


def is_missing(x: Column) -> Column:
    """NULL or NaN."""
    return x.isNull() | F.isnan(x.cast("double"))


def cleaned(x: Column) -> Column:
    """A double with NaN as NULL."""
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def remap(x: Column, values: dict, keep_others: bool = True) -> Column:
    """Values replaced by a mapping (to None for missing); the others stay, or turn to NULL."""
    if not values:
        return x
    out = None
    for old, new in values.items():
        out = (F if out is None else out).when(x == F.lit(old), F.lit(new))
    return out.otherwise(x) if keep_others else out


def log1p(x: Column) -> Column:
    return F.log1p(x)


def symmetric_log(x: Column) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(x) * F.log1p(F.abs(x))


def rounded(x: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def shifted_log(x: Column, least: float, eps: float = 1.0) -> Column:
    """ln(x) where the column's least value is positive, else ln(x - least + eps); missing stays missing."""
    return F.log(x) if least > 0 else F.log(x - F.lit(float(least)) + F.lit(float(eps)))


def unshifted_log(y: Column, least: float, eps: float = 1.0) -> Column:
    """The inverse of shifted_log."""
    return F.exp(y) if least > 0 else F.exp(y) + F.lit(float(least)) - F.lit(float(eps))


def with_stand_in(x: Column, kind: str) -> Column:
    """Missing values as the stand-in of their kind ("number" or "text"); blank texts are missing."""
    if kind == "number":
        return F.coalesce(cleaned(x), F.lit(MISSING_NUMBER))
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit(MISSING_TEXT)).otherwise(x)


def without_stand_in(x: Column, kind: str) -> Column:
    return F.when(x != F.lit(MISSING_NUMBER if kind == "number" else MISSING_TEXT), x)


def levels(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): the distinct values in order, numbered from 0.  A category of more than MOST_LEVELS is an error."""
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if (n := distinct.count()) > MOST_LEVELS:
        raise ValueError(f"{column} has {n} levels, more than the {MOST_LEVELS} of a category")
    return distinct.select(column, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1).cast("int").alias(code))


def level_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """df with the number of its value's level, null for a null."""
    return df.join(levels(df, column, code), column, "left")


def keyed_hash(seed: int | str, *keys: Column | str, start: int = 1) -> Column:
    """32 bits of md5(seed|key|...), from hex digit ``start``, as a long."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column | str, start: int = 1) -> Column:
    """A number in (0, 1)."""
    return (keyed_hash(seed, *keys, start=start) + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian(seed: int | str, *keys: Column | str) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(uniform(seed, *keys))) * F.cos(F.lit(2 * math.pi) * uniform(seed, *keys, start=9))


def shuffled(seed: int | str, *keys: str) -> list[Column]:
    """An order that shuffles rows by their keys; ties go by the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return [digest, *[F.col(k) for k in keys]]


# The same expressions as DuckDB text, for oracles.


def duck_hash(seed: int | str, *keys: str, start: int = 1) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST(('0x' || substr(md5({text}), {start}, 8)) AS BIGINT)"


def duck_uniform(seed: int | str, *keys: str, start: int = 1) -> str:
    return f"(({duck_hash(seed, *keys, start=start)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def duck_gaussian(seed: int | str, *keys: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({duck_uniform(seed, *keys)})) * cos({2 * math.pi!r}::DOUBLE * {duck_uniform(seed, *keys, start=9)}))"


def duck_order(seed: int | str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return ", ".join([f"md5({text})", *keys])

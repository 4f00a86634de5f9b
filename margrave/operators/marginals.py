"""Marginals (contingency tables) of many column sets in one scan, and what is derived from them.

A marginal is a long table (clique, cell, cnt): clique "a|b" names its columns, cell "3|0" their codes.  Only cells that occur are there;
``dense`` adds the others from the domain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column sets a scan: GROUPING SETS expands every row once a set.
SETS = 50


def powerset(names: Sequence[str], least: int = 1, most: int = 2) -> list[tuple[str, ...]]:
    """Column sets of least to most columns, in order."""
    return [c for k in range(least, most + 1) for c in combinations(names, k)]


def downward_closure(cliques: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """All non-empty subsets of the sets, by size."""
    return sorted({s for c in cliques for k in range(1, len(c) + 1) for s in combinations(c, k)}, key=lambda s: (len(s), s))


def clique_key(names: Sequence[str]) -> str:
    return "|".join(names)


def marginals(df: DataFrame, cliques: Sequence[Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., clique, cell, cnt) of all sets: the rows are counted once by all their columns, and GROUPING SETS expand those cells.

    The first count combines before its shuffle, so what each of the SETS multiplies are the cells that occur, not the rows.
    """
    parts, every = [], list(dict.fromkeys([*by, *sorted({n for c in cliques for n in c})]))
    df = df.groupBy(*every).agg(F.count(F.lit(1)).alias("_rows"))
    for at in range(0, len(cliques), SETS):
        sets = [tuple(c) for c in cliques[at : at + SETS]]
        names = sorted({n for c in sets for n in c})
        grouped = df.groupingSets([[F.col(x) for x in (*by, *c)] for c in sets], *[F.col(x) for x in (*by, *names)])
        counts = grouped.agg(F.sum("_rows").alias("cnt"), *[F.grouping(n).alias(f"_g_{n}") for n in names])
        clique, cell = None, None
        for c in sets:  # which set a row is of shows in the columns that are grouped
            here = reduce(lambda a, b: a & b, [F.col(f"_g_{n}") == int(n not in c) for n in names])
            clique = (F if clique is None else clique).when(here, F.lit(clique_key(c)))
            cell = (F if cell is None else cell).when(here, F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in c]))
        parts.append(counts.select(*by, clique.alias("clique"), cell.alias("cell"), "cnt"))
    return reduce(DataFrame.unionByName, parts)


def marginal(df: DataFrame, clique: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., the columns, cnt)."""
    return df.groupBy(*by, *clique).agg(F.count(F.lit(1)).alias("cnt"))


def grid(spark: SparkSession, domain: dict[str, int], clique: Sequence[str]) -> DataFrame:
    """All cells of a set as columns, from one range: no join."""
    size = 1
    for n in clique:
        size *= domain[n]
    out, rest = spark.range(size), F.col("id")
    columns = []
    for n in reversed(clique):
        columns.append((rest % domain[n]).cast("int").alias(n))
        rest = F.floor(rest / domain[n])
    return out.select(*reversed(columns))


def dense(counts: DataFrame, domain: dict[str, int], clique: Sequence[str]) -> DataFrame:
    """A marginal (the columns, cnt) with a row for each cell of the domain."""
    return grid(counts.sparkSession, domain, clique).join(counts, list(clique), "left").select(*clique, F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def pooled(counts: DataFrame, column: str, groups: Sequence[Sequence[int]]) -> DataFrame:
    """A marginal with one column's codes replaced by the groups that hold them, and summed."""
    group_of = F.create_map(*[F.lit(x) for g, cells in enumerate(groups) for c in cells for x in (c, g)])
    others = [c for c in counts.columns if c not in (column, "cnt")]
    order = [c for c in counts.columns if c != "cnt"]
    return counts.withColumn(column, F.try_element_at(group_of, F.col(column))).groupBy(*others, column).agg(F.sum("cnt").alias("cnt")).select(*order, "cnt")


def summed_over_clients(noisy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., y, sigma) of rows (keys..., y, sigma) of each client: counts add, variances add."""
    return noisy.groupBy(*keys).agg(F.sum("y").alias("y"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"))


def inverse_variance(df: DataFrame, keys: Sequence[str], value: str = "y", variance: str = "variance") -> DataFrame:
    """(keys..., y, variance): the estimate of least variance from independent ones."""
    w = 1.0 / F.col(variance)
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg((F.sum(F.col(value) * w) / F.sum(w)).alias("y"), (1.0 / F.sum(w)).alias("variance"))


def total_estimates(noisy: DataFrame) -> DataFrame:
    """(clique, total, variance) of rows (clique, cell, y, sigma): each marginal's sum is an estimate of the number of rows.

    The cells of a marginal partition the rows, so the solution of Q'v = 1 of least norm is v = 1, and the variances add.
    """
    return noisy.groupBy("clique").agg(F.sum("y").alias("total"), F.sum(F.col("sigma") * F.col("sigma")).alias("variance"))


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str = "a", right: str = "b") -> DataFrame:
    """(keys..., a, b): two marginals cell by cell, 0 where one has no such cell."""
    both = a.withColumnRenamed("cnt", left).join(b.withColumnRenamed("cnt", right), list(keys), "full_outer")
    return both.select(*keys, F.coalesce(left, F.lit(0)).alias(left), F.coalesce(right, F.lit(0)).alias(right))


def l1(a: Column, b: Column) -> Column:
    return F.sum(F.abs(a - b))

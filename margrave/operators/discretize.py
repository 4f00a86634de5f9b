"""Discretization: equal-width bins by repeated halving, zero and missing bins, levels, merging, decoding.

Bins live on the driver (tens for each column) and become expressions over the rows, so coding is one narrow projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, keyed_hash
from ..spec import ColumnSpec, TableSpec

#: What the upper bound is widened by, so that the maximum falls into the last bin; and the least positive value of a mixed column.
NUDGE = 1e-7
#: Rounds of halving after the first, and the factor of the merging threshold.
ROUNDS, THETA = 4, 6.0


@dataclass(frozen=True)
class Bin:
    """A bin: kind "range" [low, high), "zero", "missing" or "level" (label)."""

    id: int
    kind: str
    low: float | None = None
    high: float | None = None
    label: str | None = None


def halved(low: float, high: float, rounds: int) -> list[float]:
    """2^(rounds+1) + 1 edges from low to high by repeated halving, so that equal inputs give bit-equal edges."""
    edges = [low, high]
    for _ in range(rounds + 1):
        edges = [x for a, b in zip(edges, edges[1:], strict=False) for x in (a, (a + b) / 2)] + [edges[-1]]
    return edges


def bins_of(column: ColumnSpec, rounds: int = ROUNDS) -> list[Bin]:
    """The bins of a column from its public specification: never from the rows, which would leak them."""
    out: list[Bin] = []
    if column.role == "categorical":
        out = [Bin(i, "level", label=v) for i, v in enumerate(column.levels)]
    elif column.role == "ordinal":
        # Integer levels are halved until a bin holds one level.
        cells = _integer_bins(int(column.low), int(column.high), rounds)
        out = [Bin(i, "range", float(a), float(b)) for i, (a, b) in enumerate(cells)]
    else:
        low = column.low
        if column.role == "mixed":
            out, low = [Bin(0, "zero")], max(column.low, NUDGE)
        edges = halved(low, column.high + NUDGE, rounds)
        out += [Bin(i + len(out), "range", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return out + [Bin(len(out), "missing")] * column.may_be_missing


def _integer_bins(low: int, high: int, rounds: int) -> list[tuple[int, int]]:
    cells = [(low, high + 1)]
    for _ in range(rounds + 1):
        cells = [c for a, b in cells for c in ([(a, b)] if b - a < 2 else [(a, (a + b + 1) // 2), ((a + b + 1) // 2, b)])]
    return cells


def code(x: Column, bins: Sequence[Bin]) -> Column:
    """The id of the bin that holds x; NULL where none does (an unseen level, or a missing value without a bin for it)."""
    ranges = [b for b in bins if b.kind == "range"]
    levels = [b for b in bins if b.kind == "level"]
    missing = next((b.id for b in bins if b.kind == "missing"), None)
    if levels:
        known = F.create_map(*[F.lit(v) for b in levels for v in (b.label, b.id)])
        found = F.try_element_at(known, x.cast("string"))
        return found if missing is None else F.coalesce(found, F.when(x.isNull(), F.lit(missing)))
    number = x.cast("double")
    found = _range_code(number, [b.low for b in ranges] + [ranges[-1].high]) + F.lit(ranges[0].id)
    if zero := next((b for b in bins if b.kind == "zero"), None):
        found = F.when(number < F.lit(NUDGE), F.lit(zero.id)).otherwise(found)
    return F.when(is_missing(x), F.lit(missing).cast("int")).otherwise(found).cast("int")


def _range_code(x: Column, edges: Sequence[float]) -> Column:
    """How many inner edges are at or below x, in generated code without a loop over the edges.

    For (almost) equal widths the bin follows from the width up to one, and the exact edges settle it; else edges are compared one by one.
    """
    n, width = len(edges) - 1, (edges[-1] - edges[0]) / (len(edges) - 1)
    if n < 8 or any(abs(b - a - width) > 1e-6 * width for a, b in zip(edges, edges[1:], strict=False)):
        return reduce(lambda s, e: s + (x >= F.lit(float(e))).cast("int"), edges[1:-1], F.lit(0))
    guess = F.least(F.greatest(F.floor((x - F.lit(float(edges[0]))) / F.lit(width)), F.lit(0)), F.lit(n - 1)).cast("int")
    table = F.array(*[F.lit(float(e)) for e in edges])
    up = (guess < n - 1) & (x >= F.get(table, guess + 1))
    down = (guess > 0) & (x < F.get(table, guess))
    return guess + up.cast("int") - down.cast("int")


def coded(df: DataFrame, spec: TableSpec, bins: dict[str, list[Bin]], keep: Sequence[str] = ()) -> DataFrame:
    """The columns of spec as bin ids, after the columns to keep."""
    return df.select(*keep, *[code(F.col(f"`{c.name}`"), bins[c.name]).alias(c.name) for c in spec.columns])


def unseen(coded_df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """How many rows have no bin, by column: an error to be reported before any marginal is taken."""
    row = coded_df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    return {n: row[n] for n in names if row[n]}


def bins_table(spark: SparkSession, bins: dict[str, list[Bin]]) -> DataFrame:
    """(attr, bin_id, kind, lo, hi, label)."""
    rows = [(attr, b.id, b.kind, b.low, b.high, b.label) for attr, own in bins.items() for b in own]
    return spark.createDataFrame(rows, "attr string, bin_id int, kind string, lo double, hi double, label string")


def quantile_cuts(df: DataFrame, column: str, n: int = 32, positive: bool = False) -> list[float]:
    """Cuts halfway between the distinct exact quantiles 1/n .. 1 of the present (positive) values."""
    x = F.col(column).cast("double")
    got = exact_percentiles(df.filter(~is_missing(x) & ((x > 0) if positive else F.lit(True))), column, [i / n for i in range(1, n + 1)])
    levels = sorted(set(got))
    cuts = [(a + b) / 2 for a, b in zip(levels, levels[1:], strict=False)]
    return [NUDGE, *cuts] if positive else cuts


def exact_percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact percentiles, interpolated between neighbours; none of no rows.

    Distinct values are counted, cut into parts by approximate quantiles, and ranked by their part's offset and their place in it: only
    the values at the ranks asked for come to the driver, and no task holds all distinct values.
    """
    x = F.col(column).cast("double")
    facts = df.agg(F.count(x).alias("n"), F.percentile_approx(x, [i / 64 for i in range(1, 64)], 1000).alias("cuts")).first()
    if not facts["n"]:
        return []
    cuts = F.array(*[F.lit(c) for c in sorted(set(facts["cuts"]))])
    counts = df.filter(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("part", F.aggregate(cuts, F.lit(0), lambda s, c: s + (F.col("v") > c).cast("int")))
    sums = counts.groupBy("part").agg(F.sum("n").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("sum")).alias("before"))  # a row a part
    last = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v")) - 1
    places = [(facts["n"] - 1) * p for p in shares]
    wanted = F.array(*[F.lit(r) for r in sorted({r for p in places for r in (math.floor(p), math.ceil(p))})])
    ranked = counts.join(before, "part").withColumn("last", last)
    hit = ranked.filter(F.exists(wanted, lambda r: (r <= F.col("last")) & (r > F.col("last") - F.col("n")))).select("v", "last").collect()
    ordered = sorted((r["last"], r["v"]) for r in hit)
    at = lambda rank: next(v for end, v in ordered if rank <= end)
    return [at(math.floor(p)) if p == math.floor(p) else (math.ceil(p) - p) * at(math.floor(p)) + (p - math.floor(p)) * at(math.ceil(p)) for p in places]


def quantile_code(x: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are below x; one more than the last code for missing values."""
    below = reduce(lambda s, c: s + (x > F.lit(float(c))).cast("int"), cuts, F.lit(0))
    return F.when(is_missing(x), F.lit(len(cuts) + 1)).otherwise(below).cast("int")


# -- merging of levels -----------------------------------------------------------------------------------------------------


def merge_threshold(n_columns: int, mu_measure: float, n_clients: int, theta: float = THETA) -> float:
    """The noisy count below which a bin is merged."""
    return 2 * theta * math.sqrt(2 / math.pi) * math.sqrt(n_clients) / (mu_measure / math.sqrt(n_columns))


def round_sigmas(mu: float, rounds: int, share: float = 0.5) -> tuple[float, float]:
    """Standard deviations of the noise of each round's counts, and of the final counts."""
    return math.sqrt(rounds) / (mu * math.sqrt(share)), 1 / (mu * math.sqrt(1 - share))


def merged_groups(noisy_rounds: Sequence[Sequence[float]], n_final: int, threshold: float) -> list[list[int]]:
    """Groups of final bins: noisy_rounds[r] are counts of 2^(r+1) equal parts of the final bins, coarse to fine.

    A part below the threshold becomes one group with all its final bins, unless an earlier (coarser) part has taken them.
    """
    owner: dict[int, int] = {}
    groups: list[list[int]] = []
    for counts in noisy_rounds:
        size = n_final // len(counts)
        for j, n in enumerate(counts):
            cells = range(j * size, (j + 1) * size)
            if n < threshold and not any(c in owner for c in cells):
                groups.append(list(cells))
                owner |= dict.fromkeys(cells, len(groups) - 1)
    groups += [[c] for c in range(n_final) if c not in owner]
    return sorted(groups, key=min)


def pooled_levels(noisy: dict[str, float], threshold: float) -> dict[str, str]:
    """Level to pooled level: those below the threshold become "other", if more than two levels are there."""
    if len(noisy) <= 2:
        return {v: v for v in noisy}
    return {v: "other" if n < threshold else v for v, n in noisy.items()}


def pooling_matrix(groups: Sequence[Sequence[int]], n: int) -> list[list[int]]:
    """Rows of 0/1: which bins a group holds."""
    return [[int(i in set(g)) for i in range(n)] for g in groups]


def containment(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(attr, inner_id, outer_id): range bins of one hierarchy within those of another (tables of bins, tens of rows a column)."""
    a, b = inner.filter("kind = 'range'").alias("a"), outer.filter("kind = 'range'").alias("b")
    inside = (F.col("a.attr") == F.col("b.attr")) & (F.col("a.lo") >= F.col("b.lo")) & (F.col("a.hi") <= F.col("b.hi"))
    return a.join(F.broadcast(b), inside).select("a.attr", F.col("a.bin_id").alias("inner_id"), F.col("b.bin_id").alias("outer_id"))


def rediscretized(df: DataFrame, column: str, children: dict[int, list[int]], seed: int, keys: Sequence[str], name: str) -> DataFrame:
    """df with codes of a finer hierarchy: one of the children of the row's bin, picked by a keyed hash."""
    table = F.create_map(*[x for k, v in children.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    options = F.try_element_at(table, F.col(column))
    return df.withColumn(name, F.get(options, F.pmod(keyed_hash(seed, *keys), F.size(options).cast("long")).cast("int")))


# -- the inverse -----------------------------------------------------------------------------------------------------------


def decoded(x: Column, column: ColumnSpec, bins: Sequence[Bin], seed: int | str, *keys: str) -> Column:
    """A value of the original column for a code: a grid point of the bin (by keyed hash), the level, 0, or NULL.

    The grid has the column's decimals: whole numbers from ceil(10^d low) up to but not at ceil(10^d high), over 10^d; if there is none,
    round(10^d high).
    """
    if column.role == "categorical":
        labels = F.create_map(*[F.lit(v) for b in bins if b.kind == "level" for v in (b.id, b.label)])
        return F.try_element_at(labels, x)
    scale = 10**column.decimals if column.role != "ordinal" else 1
    ranges = [b for b in bins if b.kind == "range"]
    first = F.array(*[F.lit(math.ceil(scale * b.low)) for b in ranges])
    span = F.array(*[F.lit(max(0, math.ceil(scale * b.high) - math.ceil(scale * b.low))) for b in ranges])
    ends = F.array(*[F.lit(round(scale * b.high)) for b in ranges])
    at = x - F.lit(ranges[0].id)
    point = F.when(F.get(span, at) > 0, F.get(first, at) + F.pmod(keyed_hash(seed, *keys), F.get(span, at).cast("long"))).otherwise(F.get(ends, at))
    value = point.cast("double") / F.lit(float(scale))
    if zero := next((b for b in bins if b.kind == "zero"), None):
        value = F.when(x == zero.id, F.lit(0.0)).otherwise(value)
    if missing := next((b for b in bins if b.kind == "missing"), None):
        value = F.when(x != missing.id, value)
    return value

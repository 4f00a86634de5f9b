"""Which marginals to measure: scores against a model, spanning trees, votes, candidate filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pgm import Domain, junction_tree
from .privacy import exponential_choice

METHODS = ("standard", "local", "adjusted", "random")


def independent_pairs(client: DataFrame, total: DataFrame, names: tuple[str, str], domain: dict[str, int]) -> DataFrame:
    """(client_id, n, f, a, b, cnt, model): all cells of a pair for each client, with the model of independent columns.

    client: (client_id, a, b) codes; model: the product of the one-way counts of all rows over their number.
    """
    from .marginals import grid

    a, b = names
    n_total = total.agg(F.count(F.lit(1)).alias("n_total"))
    one = lambda c: total.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    sizes = client.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    cells = grid(client.sparkSession, domain, names).join(F.broadcast(one(a)), a, "left").join(F.broadcast(one(b)), b, "left")
    cells = cells.crossJoin(F.broadcast(n_total)).crossJoin(F.broadcast(sizes))  # a row a client and cell: the domain bounds it
    counts = client.groupBy("client_id", a, b).agg(F.count(F.lit(1)).alias("cnt"))
    model = F.coalesce(f"n_{a}", F.lit(0)) * F.coalesce(f"n_{b}", F.lit(0)) / F.col("n_total")
    return cells.join(counts, ["client_id", a, b], "left").select("client_id", "n", (F.col("n") / F.col("n_total")).alias("f"), a, b, F.coalesce("cnt", F.lit(0)).alias("cnt"), model.alias("model"))


def penalty(f: Column, mu: float, cells: Column) -> Column:
    """The L1 norm that noise alone is expected to add."""
    return F.lit(math.sqrt(2 / math.pi)) * F.sqrt(f) / F.lit(float(mu)) * cells


def pair_scores(cells: DataFrame, mu: float, method: str = "standard") -> DataFrame:
    """(client_id, score) of the rows of independent_pairs.

    standard: |n_c - f_c * model| less the penalty.  local: the model is the client's own, not scaled.  adjusted: half of standard less
    the largest one-way difference.  random: 0.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")
    if method == "random":
        return cells.select("client_id").distinct().withColumn("score", F.lit(0.0))
    f = F.greatest(F.col("f"), F.lit(0.0))
    model = F.col("model") if method == "local" else f * F.col("model")
    scores = cells.groupBy("client_id").agg((F.sum(F.abs(F.col("cnt") - model)) - penalty(F.max(f), mu, F.count(F.lit(1)))).alias("score"))
    if method != "adjusted":
        return scores
    a, b = [c for c in cells.columns if c not in ("client_id", "n", "f", "cnt", "model")]
    one_way = None
    for c in (a, b):
        sums = cells.groupBy("client_id", c).agg(F.sum("cnt").alias("cnt"), F.sum(f * F.col("model")).alias("model")).groupBy("client_id").agg(F.sum(F.abs(F.col("cnt") - F.col("model"))).alias("d"))
        one_way = sums if one_way is None else one_way.unionByName(sums)
    largest = one_way.groupBy("client_id").agg(F.max("d").alias("d"))
    return scores.join(largest, "client_id").select("client_id", (0.5 * (F.col("score") - F.col("d"))).alias("score"))


class Forest:
    """Disjoint sets of columns."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def private_tree(scores: dict[tuple[str, str], float], names: Sequence[str], mu: float, rng: np.random.Generator) -> list[tuple[str, str]]:
    """A spanning tree of the columns, edge by edge by the exponential mechanism; the budget is split evenly over its edges."""
    from .privacy import mechanism_eps

    eps = mechanism_eps(mu / math.sqrt(len(names) - 1))
    forest, tree = Forest(), []
    while len(tree) < len(names) - 1:
        open_edges = {e: s for e, s in scores.items() if forest.root(e[0]) != forest.root(e[1])}
        edge = exponential_choice(open_edges, eps, rng)
        forest.join(*edge)
        tree.append(edge)
    return tree


def edge_votes(choices: DataFrame, fractions: DataFrame) -> DataFrame:
    """(a, b, weight): choices (client_id, a, b) weighted by the clients' fractions (client_id, f)."""
    return choices.join(F.broadcast(fractions), "client_id").groupBy("a", "b").agg(F.sum("f").alias("weight"))


def spanning_tree(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The spanning tree of the largest weight; equal weights go by name."""
    forest = Forest()
    return [e for e in sorted(weights, key=lambda e: (-weights[e], e)) if forest.join(*e)]


def model_megabytes(domain: Domain, cliques: Sequence[Sequence[str]]) -> float:
    """The size of a junction tree for the cliques."""
    return sum(math.prod(domain[a] for a in c) for c in junction_tree(domain, cliques)[0]) * 8 / 2**20


def candidates(domain: Domain, workload: Sequence[tuple[str, ...]], measured: Sequence[tuple[str, ...]], n_rows: float, mu_measure: float, spent_share: float, clients: int, max_mb: float, theta: float = 6.0, pooled: Domain | None = None, again: bool = False) -> list[tuple[str, ...]]:
    """The sets worth nominating: of two columns or more, not too many cells for their noise, and the model stays small enough.

    The size allowed grows with the share of the budget (squared) spent; sets within measured ones never enlarge the model.  Measured sets
    themselves are left out, unless they are to be measured again.
    """
    cells = math.ceil(n_rows * mu_measure / (theta * math.sqrt(clients) * math.sqrt(2 / math.pi)))
    sizes = pooled or domain
    out = []
    for c in workload:
        if len(c) < 2 or not again and tuple(c) in {tuple(m) for m in measured} or math.prod(sizes[a] for a in c) > cells:
            continue
        if any(set(c) <= set(m) for m in measured) or model_megabytes(domain, [*measured, c]) <= max_mb * spent_share**2:
            out.append(tuple(c))
    return out

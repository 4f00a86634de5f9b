"""Whole plans: independent columns, the static tree and the iterative choice, from coded rows to a model.

The rows are read by one job a plan: the marginals of a workload, by client, in one scan (GROUPING SETS).  All that follows is on cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discretize, pgm, privacy, selection
from ..operators.discretize import Bin
from ..operators.marginals import clique_key, marginals, powerset


@dataclass(frozen=True)
class Settings:
    """Budgets and limits of a plan; shares are of mu squared."""

    mu: float = 1.0
    shares: tuple[float, ...] = (0.1, 0.1, 0.8)
    method: str = "standard"
    degree: int = 2
    max_mb: float = 5.0
    max_checks: int = 500
    theta: float = 6.0
    iterations: int = 1000
    engine: str = "IG"
    seed: int = 1
    #: The share of mu squared that goes to merging levels before anything else, where a plan is given the bins.
    merge_share: float = 0.1

    def __post_init__(self) -> None:
        if self.method not in selection.METHODS:
            raise ValueError(f"no method {self.method!r}")
        if self.degree < 1 or self.mu <= 0:
            raise ValueError("the degree and mu must be positive")


class Answers:
    """All marginals of a workload for each client: dense tables on the driver (clients times cells of the workload)."""

    def __init__(self, coded: DataFrame, domain: pgm.Domain, workload: Sequence[tuple[str, ...]]) -> None:
        self.domain, self.tables = domain, {}
        found = marginals(coded, workload, ["client_id"]).collect()
        self.clients = sorted({r["client_id"] for r in found})
        by_key = {clique_key(c): tuple(c) for c in workload}
        self.noisy_sums: dict[int, list[tuple[float, int, float]]] = {c: [] for c in self.clients}
        without: dict[str, int] = {}
        for r in found:
            clique = by_key[r["clique"]]
            codes = r["cell"].split("|")
            if "" in codes:
                if len(clique) == 1:
                    without[clique[0]] = without.get(clique[0], 0) + r["cnt"]
                continue
            table = self.tables.setdefault((r["client_id"], clique), np.zeros(domain.shape(clique)))
            table[tuple(map(int, codes))] = r["cnt"]
        if without:
            raise ValueError(f"rows without a level (of the specification) by column: {without}")

    def of(self, client: int, clique: Sequence[str]) -> np.ndarray:
        return self.tables.get((client, tuple(clique)), np.zeros(self.domain.shape(clique)))

    def measured(self, clique: tuple[str, ...], mu: float, rng: np.random.Generator, groups: dict[str, np.ndarray] | None = None) -> pgm.Measurement:
        """The sum of the clients' noisy answers, over groups of levels where there are some."""
        sigma, total = 1 / mu, 0.0
        bare = pgm.Measurement(clique, np.zeros(0), sigma, {n: g for n, g in (groups or {}).items() if n in clique})
        for client in self.clients:
            answer = bare.answer(self.of(client, clique))
            noisy = answer + rng.normal(0, sigma, answer.shape)
            self.noisy_sums[client].append((float(noisy.sum()), len(noisy), sigma))
            total = total + noisy
        return pgm.Measurement(clique, total, sigma * math.sqrt(len(self.clients)), bare.groups)

    def client_sizes(self) -> dict[int, float]:
        """Each client's number of rows from its noisy answers so far, by least variance; nothing new is released."""
        out = {}
        for client, sums in self.noisy_sums.items():
            weights = [1 / (n * sigma * sigma) for _, n, sigma in sums]
            out[client] = max(1.0, sum(w * total for w, (total, _, _) in zip(weights, sums, strict=True)) / sum(weights))
        return out


def merged_levels(answers: Answers, bins: dict[str, Sequence[Bin]], mu: float, mu_measure: float, rng: np.random.Generator) -> tuple[list[pgm.Measurement], dict[str, np.ndarray]]:
    """Noisy counts for merging, and the group of each level by column; all columns together cost mu.

    A column whose range bins halve evenly is counted in halves, quarters and so on, and each part below the threshold becomes one group;
    the counts of every round and of the bins are measurements.  Other columns of three levels or more are counted once, and those below
    the threshold become one group.  Bins for zeros and missing values stay as they are.
    """
    names = answers.domain.attrs
    threshold = discretize.merge_threshold(len(names), mu_measure, len(answers.clients))
    found, groups = [], {}
    for name in names:
        own = mu / math.sqrt(len(names))
        size, ranges = answers.domain[name], [b.id for b in bins[name] if b.kind == "range"]
        rounds = len(ranges).bit_length() - 1
        if len(ranges) >= 4 and len(ranges) == 1 << rounds:
            rest = [i for i in range(size) if i not in ranges]
            sigma, last = discretize.round_sigmas(own, rounds)
            counts = []
            for r in range(1, rounds + 1):
                of = np.zeros(size, dtype=int)
                of[ranges] = np.arange(len(ranges)) >> (rounds - r)
                of[rest] = (1 << r) + np.arange(len(rest))
                found.append(answers.measured((name,), 1 / sigma, rng, {name: of}))
                counts.append(found[-1].y[: 1 << r])
            found.append(answers.measured((name,), 1 / last, rng))
            parts = [[ranges[c] for c in cells] for cells in discretize.merged_groups(counts, len(ranges), threshold)] + [[i] for i in rest]
        elif size > 2:
            found.append(answers.measured((name,), own, rng))
            to = discretize.pooled_levels(dict(zip(map(str, range(size)), found[-1].y, strict=True)), threshold)
            other = [i for i in range(size) if to[str(i)] == "other"]
            parts = [[i] for i in range(size) if i not in other] + [other] * bool(other)
        else:
            continue
        if len(parts) < size:
            groups[name] = np.zeros(size, dtype=int)
            for g, cells in enumerate(parts):
                groups[name][cells] = g
    return found, groups


def _begun(answers: Answers, settings: Settings, ledger: privacy.Ledger, bins: dict[str, Sequence[Bin]] | None, mu_measure: float, rng: np.random.Generator) -> tuple[list[pgm.Measurement], dict[str, np.ndarray], float]:
    """What merging measures, its groups, and the budget that is left for the plan."""
    if bins is None:
        return [], {}, settings.mu
    mu = ledger.charge("levels", math.sqrt(settings.merge_share) * settings.mu)
    return *merged_levels(answers, bins, mu, mu_measure, rng), ledger.left


def _scores(answers: Answers, client: int, cliques: Sequence[tuple[str, ...]], model: pgm.Model, fraction: float, mu: float, method: str) -> dict[tuple[str, ...], float]:
    if method == "random":
        return dict.fromkeys(cliques, 0.0)
    f, out = max(fraction, 0.0), {}
    ones: dict[str, float] = {}
    for c in cliques:
        scale = 1.0 if method == "local" else f
        gap = float(np.abs(answers.of(client, c) - scale * model.project(c)).sum()) - math.sqrt(2 / math.pi) * math.sqrt(f) / mu * answers.domain.size(c)
        if method == "adjusted":
            for a in c:
                if a not in ones:
                    ones[a] = float(np.abs(answers.of(client, (a,)) - scale * model.project((a,))).sum())
            gap = 0.5 * (gap - max(ones[a] for a in c))
        out[c] = gap
    return out


def _rng(settings: Settings, noise: privacy.Noise) -> np.random.Generator:
    return np.random.default_rng(None if noise.private else [settings.seed, noise.seed])


def fit_independent(coded: DataFrame, domain: pgm.Domain, settings: Settings, noise: privacy.Noise, bins: dict[str, Sequence[Bin]] | None = None) -> tuple[pgm.Model, privacy.Ledger]:
    """One-way marginals alone, each with an equal part of the budget; with bins, over merged levels."""
    ledger, rng = privacy.Ledger(settings.mu), _rng(settings, noise)
    ones = [(a,) for a in domain.attrs]
    answers = Answers(coded, domain, ones)
    got, groups, mu = _begun(answers, settings, ledger, bins, settings.mu, rng)
    got += [answers.measured(c, ledger.charge("one-way", m), rng, groups) for c, m in zip(ones, privacy.split_budget(mu, [1.0] * len(ones)), strict=True)]
    return pgm.estimate(domain, got, settings.engine, settings.iterations), ledger


def fit_tree(coded: DataFrame, domain: pgm.Domain, settings: Settings, noise: privacy.Noise, bins: dict[str, Sequence[Bin]] | None = None) -> tuple[pgm.Model, privacy.Ledger, list[tuple[str, str]]]:
    """The static tree: one-way model, a private spanning tree at each client, the clients' vote, the tree's marginals, the final model."""
    ledger, rng = privacy.Ledger(settings.mu), _rng(settings, noise)
    ones, pairs = [(a,) for a in domain.attrs], powerset(domain.attrs, 2, 2)
    answers = Answers(coded, domain, [*ones, *pairs])
    got, groups, mu = _begun(answers, settings, ledger, bins, math.sqrt(settings.shares[2]) * settings.mu, rng)
    mu_one, mu_select, mu_edges = privacy.proportional(mu, settings.shares)
    got += [answers.measured(c, m, rng, groups) for c, m in zip(ones, privacy.split_budget(mu_one, [1.0] * len(ones)), strict=True)]
    ledger.charge("one-way", mu_one)
    first = pgm.estimate(domain, got, settings.engine, settings.iterations)

    sizes = answers.client_sizes()
    total, votes = sum(sizes.values()), {}
    for client in answers.clients:
        f = sizes[client] / total
        scores = _scores(answers, client, pairs, first, f, mu_edges / math.sqrt(len(ones) - 1), settings.method)
        for edge in selection.private_tree(scores, domain.attrs, mu_select, rng):
            votes[edge] = votes.get(edge, 0.0) + f
    ledger.charge("selection", mu_select)
    tree = selection.spanning_tree(votes)
    got += [answers.measured(e, m, rng, groups) for e, m in zip(tree, privacy.split_budget(mu_edges, [1.0] * len(tree)), strict=True)]
    ledger.charge("edges", mu_edges)
    return pgm.estimate(domain, got, settings.engine, settings.iterations, warm=first), ledger, tree


#: Of a round's budget (squared): nomination by clients, choice, measurement.
ROUND_SHARES = (0.1, 0.1, 0.8)


def _next_step(mu_step: float, left: float) -> float:
    """A round's budget, or all that is left where that is less than two rounds' worth."""
    return left if left**2 < 2 * mu_step**2 else mu_step


def fit_iterative(coded: DataFrame, domain: pgm.Domain, settings: Settings, noise: privacy.Noise, rounds: int | None = None, bins: dict[str, Sequence[Bin]] | None = None) -> tuple[pgm.Model, privacy.Ledger, list[tuple[str, ...]]]:
    """The iterative choice: rounds of nomination by clients (exponential mechanism), choice by noisy maximum, measurement and a new model.

    A round whose model moves less than its noise would doubles the next rounds' budget (squared), and so does one whose noise is too much
    for all sets that are open; the last round spends what is left.  Where even that opens no other set, measured ones are measured again.
    """
    ledger, rng = privacy.Ledger(settings.mu), _rng(settings, noise)
    ones = [(a,) for a in domain.attrs]
    workload = powerset(domain.attrs, 1, settings.degree)
    answers = Answers(coded, domain, workload)
    got, groups, mu = _begun(answers, settings, ledger, bins, math.sqrt(0.8) * settings.mu, rng)
    mu_one = math.sqrt(0.2) * mu
    got += [answers.measured(c, m, rng, groups) for c, m in zip(ones, privacy.split_budget(mu_one, [1.0] * len(ones)), strict=True)]
    ledger.charge("one-way", mu_one)
    model = pgm.estimate(domain, got, settings.engine, settings.iterations)
    n_clients, chosen = len(answers.clients), []
    merged = pgm.Domain({n: int(groups[n].max()) + 1 if n in groups else size for n, size in domain.sizes.items()})
    mu_step = math.sqrt(0.8 * mu**2 / (rounds or 10 * len(ones)))

    def opened(step: float, again: bool = False) -> list[tuple[str, ...]]:
        measure = privacy.proportional(step, ROUND_SHARES)[2]
        return selection.candidates(domain, workload, chosen, model.total, measure, ledger.spent / settings.mu, n_clients, settings.max_mb, settings.theta, merged, again)

    while ledger.left > 1e-6:
        sizes = answers.client_sizes()
        total = sum(sizes.values())
        mu_step = _next_step(mu_step, ledger.left)
        while not (open_sets := opened(mu_step)) and mu_step < ledger.left:
            mu_step = _next_step(math.sqrt(2) * mu_step, ledger.left)
        open_sets = open_sets or opened(mu_step, again=True)
        if not open_sets:
            break
        open_sets = checked_sets(open_sets, settings.max_checks, rng)
        nominate, choose, measure = privacy.proportional(mu_step, ROUND_SHARES)
        named = set()
        for client in answers.clients:
            scores = _scores(answers, client, open_sets, model, sizes[client] / total, measure, settings.method)
            named.add(privacy.exponential_choice(scores, privacy.mechanism_eps(nominate), rng))
        sums = {c: sum(_scores(answers, k, [c], model, sizes[k] / total, measure, settings.method)[c] for k in answers.clients) for c in sorted(named)}
        best = max(sums, key=lambda c: sums[c] + rng.normal(0, math.sqrt(n_clients) / choose))
        before = model.project(best)
        got.append(answers.measured(best, measure, rng, groups))
        ledger.charge("|".join(best), mu_step)
        chosen.append(best)
        model = pgm.estimate(domain, got, settings.engine, settings.iterations, warm=model)
        moved = float(np.abs(model.project(best) - before).sum())
        if moved <= math.sqrt(2 / math.pi) * math.sqrt(n_clients) / measure * domain.size(best):
            mu_step *= math.sqrt(2)
    return model, ledger, chosen


def checked_sets(sets: list[tuple[str, ...]], most: int, rng: np.random.Generator) -> list[tuple[str, ...]]:
    """At most so many of the sets: half of two columns and half of more, as far as there are."""
    if len(sets) <= most:
        return sets
    small, large = [c for c in sets if len(c) == 2], [c for c in sets if len(c) > 2]
    n_large = min(len(large), max(most // 2, most - len(small)))
    pick = lambda of, n: [of[i] for i in sorted(rng.choice(len(of), n, replace=False))] if n else []
    return pick(small, min(len(small), most - n_large)) + pick(large, n_large)


def for_plan(coded: DataFrame, plan: str) -> DataFrame:
    """The coded rows that a variant sees: "local" the first client's alone, "single" all as one client's, any other plan all."""
    if plan == "local":
        return coded.filter("client_id = 0")
    return coded.withColumn("client_id", F.lit(0)) if plan == "single" else coded


FITS = {"independent": fit_independent, "tree": fit_tree, "iterative": fit_iterative}


def experiments(settings: Sequence[str], budgets: Sequence[float], reps: int) -> list[tuple[str, float, int]]:
    """The grid of an experiment, in order: split setting, budget, repetition."""
    return [(s, m, r) for s in settings for m in budgets for r in range(reps)]


def model_table(spark, model: pgm.Model) -> DataFrame:
    """(column, parents, cell, p): a model as a table, for Parquet."""
    rows = [(n, "|".join(ps), "|".join(map(str, i)), float(p)) for n, ps, t in model.conditionals() for i, p in np.ndenumerate(t)]
    return spark.createDataFrame(rows, "column string, parents string, cell string, p double").withColumn("p", F.col("p"))


def read_model(table: DataFrame, domain: pgm.Domain) -> list[tuple[str, tuple[str, ...], np.ndarray]]:
    """The conditionals of a stored model_table(), parents before children: what rows are drawn from."""
    found: dict[tuple[str, tuple[str, ...]], np.ndarray] = {}
    for r in table.collect():  # a row a cell of the model
        parents = tuple(x for x in r["parents"].split("|") if x)
        cells = found.setdefault((r["column"], parents), np.zeros(domain.shape([*parents, r["column"]])))
        cells[tuple(map(int, r["cell"].split("|")))] = r["p"]
    out, known = [], set()
    while len(out) < len(found):
        ready = [(c, ps) for c, ps in found if c not in known and set(ps) <= known]
        if not ready:
            raise ValueError("the stored conditionals lack a parent")
        out += [(c, ps, found[c, ps]) for c, ps in ready]
        known |= {c for c, _ in ready}
    return out


def measurement_table(spark, measurements: Sequence[pgm.Measurement]) -> DataFrame:
    """(step, clique, cell, y, sigma, groups): what was released, for Parquet; groups is JSON by column."""
    import json

    rows = [(i, "|".join(m.clique), j, float(y), float(m.sigma), json.dumps({n: g.tolist() for n, g in sorted(m.groups.items())})) for i, m in enumerate(measurements) for j, y in enumerate(m.y)]
    return spark.createDataFrame(rows, "step int, clique string, cell int, y double, sigma double, groups string")


def ledger_table(spark, ledger: privacy.Ledger) -> DataFrame:
    """(step, name, mu): what was charged."""
    return spark.createDataFrame([(i, name, float(mu)) for i, (name, mu) in enumerate(ledger.steps)], "step int, name string, mu double")

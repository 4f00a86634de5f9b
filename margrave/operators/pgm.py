"""Graphical models from noisy marginals, on the driver: the work grows with the cells, not the rows.

Estimation follows McKenna, Sheldon and Miklau (2019): the model of largest entropy whose marginals fit the measurements best, by mirror
descent or its accelerated forms over the marginals of a junction tree, computed by belief propagation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


@dataclass(frozen=True)
class Domain:
    """Columns and their numbers of levels."""

    sizes: dict[str, int]

    def __getitem__(self, name: str) -> int:
        return self.sizes[name]

    @property
    def attrs(self) -> tuple[str, ...]:
        return tuple(self.sizes)

    def project(self, names: Sequence[str]) -> Domain:
        return Domain({n: self.sizes[n] for n in names})

    def shape(self, names: Sequence[str]) -> tuple[int, ...]:
        return tuple(self.sizes[n] for n in names)

    def size(self, names: Sequence[str] | None = None) -> int:
        return math.prod(self.shape(self.attrs if names is None else names))


@dataclass(frozen=True)
class Measurement:
    """Noisy counts y of a set of columns (row-major over its cells, or over groups of them), with standard deviation sigma.

    groups: for each column the group of each level, where levels were pooled.
    """

    clique: tuple[str, ...]
    y: np.ndarray
    sigma: float
    groups: dict[str, np.ndarray] = field(default_factory=dict)

    def answer(self, table: np.ndarray) -> np.ndarray:
        """The measured query on a table of counts."""
        for axis, name in enumerate(self.clique):
            if name in self.groups:
                g = self.groups[name]
                out = np.zeros((int(g.max()) + 1, *np.moveaxis(table, axis, 0).shape[1:]))
                np.add.at(out, g, np.moveaxis(table, axis, 0))
                table = np.moveaxis(out, 0, axis)
        return table.reshape(-1)

    def spread(self, values: np.ndarray, domain: Domain) -> np.ndarray:
        """The transpose of answer()."""
        shape = tuple(int(self.groups[n].max()) + 1 if n in self.groups else domain[n] for n in self.clique)
        table = values.reshape(shape)
        for axis, name in enumerate(self.clique):
            if name in self.groups:
                table = np.take(table, self.groups[name], axis)
        return table


def junction_tree(domain: Domain, cliques: Sequence[Sequence[str]]) -> tuple[list[tuple[str, ...]], list[tuple[int, int]]]:
    """Maximal cliques of a triangulated graph (by least fill, then least size) and the edges of a tree of them."""
    near: dict[str, set[str]] = {a: set() for a in domain.attrs}
    for c in cliques:
        for a, b in combinations(c, 2):
            near[a].add(b)
            near[b].add(a)
    found: list[set[str]] = []
    left = {a: set(b) for a, b in near.items()}
    while left:
        fill = {a: sum(1 for x, y in combinations(sorted(left[a]), 2) if y not in left[x]) for a in left}
        a = min(left, key=lambda v: (fill[v], domain.size([v, *left[v]]), v))
        own = {a, *left[a]}
        if not any(own <= f for f in found):
            found.append(own)
        for x, y in combinations(sorted(left[a]), 2):
            left[x].add(y)
            left[y].add(x)
        for x in left.pop(a):
            left[x].discard(a)
    nodes = [tuple(x for x in domain.attrs if x in f) for f in found]
    pairs = sorted(combinations(range(len(nodes)), 2), key=lambda e: -len(set(nodes[e[0]]) & set(nodes[e[1]])))
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    edges = []
    for i, j in pairs:
        if root(i) != root(j):
            parent[root(i)] = root(j)
            edges.append((i, j))
    return nodes, edges


def _logsum(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    if not axes:
        return x
    top = x.max(axis=axes, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axes, keepdims=True)) + top).squeeze(axes)


def _lift(values: np.ndarray, names: Sequence[str], onto: Sequence[str]) -> np.ndarray:
    """A table over names (in the order of onto) shaped to broadcast over onto."""
    return values.reshape(tuple(values.shape[list(names).index(n)] if n in names else 1 for n in onto))


class Model:
    """A junction tree with log-potentials and the expected number of rows."""

    def __init__(self, domain: Domain, cliques: Sequence[Sequence[str]], total: float) -> None:
        self.domain, self.total = domain, float(total)
        self.nodes, self.edges = junction_tree(domain, cliques)
        self.potentials = [np.zeros(domain.shape(c)) for c in self.nodes]
        self.tables: list[np.ndarray] = []

    def node_of(self, clique: Sequence[str]) -> int:
        """The smallest node that holds a set."""
        fit = [i for i, c in enumerate(self.nodes) if set(clique) <= set(c)]
        if not fit:
            raise KeyError(f"no node holds {clique}")
        return min(fit, key=lambda i: self.domain.size(self.nodes[i]))

    def propagate(self, potentials: list[np.ndarray]) -> list[np.ndarray]:
        """Counts of every node: two passes of messages in logarithms."""
        near: dict[int, list[int]] = {i: [] for i in range(len(self.nodes))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)
        order, seen = [], set()
        for start in near:
            stack = [(start, -1)] if start not in seen else []
            while stack:
                i, up = stack.pop()
                if i not in seen:
                    seen.add(i)
                    order.append((i, up))
                    stack += [(j, i) for j in near[i] if j != up]
        messages: dict[tuple[int, int], np.ndarray] = {}

        def send(i: int, j: int) -> None:
            own, both = self.nodes[i], [n for n in self.nodes[i] if n in self.nodes[j]]
            belief = potentials[i]
            for k in near[i]:
                if k != j:
                    belief = belief + _lift(messages[k, i], [n for n in own if n in self.nodes[k]], own)
            messages[i, j] = _logsum(belief, tuple(a for a, n in enumerate(own) if n not in both))

        for i, up in reversed(order):
            if up >= 0:
                send(i, up)
        for i, up in order:
            if up >= 0:
                send(up, i)
        out = []
        for i, own in enumerate(self.nodes):
            belief = potentials[i]
            for k in near[i]:
                belief = belief + _lift(messages[k, i], [n for n in own if n in self.nodes[k]], own)
            belief = belief - _logsum(belief, tuple(range(belief.ndim)))
            out.append(self.total * np.exp(belief))
        return out

    def fit_tables(self) -> None:
        self.tables = self.propagate(self.potentials)

    def divergence(self, a: list[np.ndarray], b: list[np.ndarray]) -> float:
        """The relative entropy of two distributions, given by their nodes' counts: the nodes' less the separators'."""

        def entropy(x: np.ndarray, y: np.ndarray) -> float:
            p, q = x / self.total, np.maximum(y / self.total, 1e-300)
            return float(np.sum(p * np.log(np.maximum(p, 1e-300) / q)))

        value = sum(entropy(x, y) for x, y in zip(a, b, strict=True))
        for i, j in self.edges:
            out = tuple(k for k, n in enumerate(self.nodes[i]) if n not in self.nodes[j])
            value -= entropy(a[i].sum(axis=out), b[i].sum(axis=out))
        return max(value, 0.0)

    def project(self, names: Sequence[str]) -> np.ndarray:
        """Expected counts of any set of columns (axes in the order given), by elimination over the tree's potentials."""
        for c, table in zip(self.nodes, self.tables, strict=True):
            if set(names) <= set(c):
                small = table.sum(axis=tuple(a for a, n in enumerate(c) if n not in names))
                kept = [n for n in c if n in names]
                return np.transpose(small, [kept.index(n) for n in names])
        factors = [(c, p) for c, p in zip(self.nodes, self.potentials, strict=True)]
        for n in sorted(set(self.domain.attrs) - set(names), key=lambda v: (self.domain.size(sorted({x for c, _ in factors if v in c for x in c})), v)):
            own = [f for f in factors if n in f[0]]
            scope = tuple(x for x in self.domain.attrs if any(x in c for c, _ in own))
            joint = sum((_lift(p, c, scope) for c, p in own), np.zeros(self.domain.shape(scope)))
            factors = [f for f in factors if n not in f[0]] + [(tuple(x for x in scope if x != n), _logsum(joint, (scope.index(n),)))]
        scope = tuple(x for x in self.domain.attrs if x in names)
        joint = sum((_lift(p, c, scope) for c, p in factors), np.zeros(self.domain.shape(scope)))
        table = self.total * np.exp(joint - _logsum(joint, tuple(range(joint.ndim))))
        return np.transpose(table, [scope.index(n) for n in names])

    def conditionals(self) -> list[tuple[str, tuple[str, ...], np.ndarray]]:
        """(column, parents, P(column | parents) with the column as last axis), parents before children: how rows are drawn."""
        out: list[tuple[str, tuple[str, ...], np.ndarray]] = []
        near: dict[int, list[int]] = {i: [] for i in range(len(self.nodes))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)
        known: set[str] = set()
        seen: set[int] = set()
        for start in near:
            stack = [start] if start not in seen else []
            while stack:
                i = stack.pop(0)
                if i in seen:
                    continue
                seen.add(i)
                stack += [j for j in near[i] if j not in seen]
                scope = [n for n in self.nodes[i] if n in known]
                for n in [n for n in self.nodes[i] if n not in known]:
                    table = self.project([*scope, n])
                    sums = table.sum(-1, keepdims=True)
                    out.append((n, tuple(scope), np.where(sums > 0, table / np.where(sums > 0, sums, 1), 1 / table.shape[-1])))
                    scope.append(n)
                    known.add(n)
        return out


def least_variance_total(measurements: Sequence[Measurement]) -> float:
    """The number of rows: each measurement's sum, weighted by the inverse of its variance; at least 1."""
    weights = [1 / (m.sigma**2 * len(m.y)) for m in measurements]
    return max(1.0, sum(w * float(m.y.sum()) for w, m in zip(weights, measurements, strict=True)) / sum(weights))


def check(domain: Domain, measurements: Sequence[Measurement]) -> None:
    for m in measurements:
        if m.sigma <= 0 or not set(m.clique) <= set(domain.attrs) or len(set(m.clique)) != len(m.clique):
            raise ValueError(f"measurement of {m.clique}: its columns must be distinct ones of the domain, its sigma positive")
        expected = math.prod(int(m.groups[n].max()) + 1 if n in m.groups else domain[n] for n in m.clique)
        if m.y.shape != (expected,) or any(len(g) != domain[n] for n, g in m.groups.items()):
            raise ValueError(f"measurement of {m.clique}: {expected} answers are needed")


Loss = Callable[[dict[tuple[str, ...], np.ndarray]], tuple[float, dict[tuple[str, ...], np.ndarray]]]


def measured_loss(measurements: Sequence[Measurement], domain: Domain, metric: str = "L2") -> Loss:
    """(loss, gradient by set): half the squared (L2) or the absolute (L1) differences, in standard deviations."""

    def loss(tables: dict[tuple[str, ...], np.ndarray]) -> tuple[float, dict[tuple[str, ...], np.ndarray]]:
        value, gradient = 0.0, {}
        for m in measurements:
            r = (m.answer(tables[m.clique]) - m.y) / m.sigma
            value += float(0.5 * r @ r) if metric == "L2" else float(np.abs(r).sum())
            g = m.spread((r if metric == "L2" else np.sign(r)) / m.sigma, domain)
            gradient[m.clique] = gradient.get(m.clique, 0) + g
        return value, gradient

    return loss


def estimate(domain: Domain, measurements: Sequence[Measurement], engine: str = "IG", iterations: int = 1000, metric: str | Loss = "L2", total: float | None = None, warm: Model | None = None, tolerance: float = 1e-6, callback: Callable[[int, float], None] | None = None) -> Model:
    """A model fitted to measurements, by a method that takes relative entropy as its distance.

    engine: MD, mirror descent under relative smoothness (Lu, Freund and Nesterov, 2018); RDA, the accelerated dual averaging of Nesterov
    (2005); IG, the improved interior gradient of Auslender and Teboulle (2006).  The smoothness is found by doubling, up to its bound.

    Every 100 steps the loss is compared with that before; a relative gain below the tolerance ends the run.  warm: a model whose
    potentials are the start.  metric: "L2", "L1" or a function of the marginals by set to (loss, gradient by set).
    """
    check(domain, measurements)
    if engine not in ("MD", "RDA", "IG"):
        raise ValueError(f"no engine {engine!r}")
    model = Model(domain, [m.clique for m in measurements], total or least_variance_total(measurements))
    loss = metric if callable(metric) else measured_loss(measurements, domain, metric)
    cliques = list(dict.fromkeys(m.clique for m in measurements))
    home = {c: model.node_of(c) for c in cliques}

    def view(tables: list[np.ndarray]) -> dict[tuple[str, ...], np.ndarray]:
        out = {}
        for c in cliques:
            node = model.nodes[home[c]]
            small = tables[home[c]].sum(axis=tuple(a for a, n in enumerate(node) if n not in c))
            kept = [n for n in node if n in c]
            out[c] = np.transpose(small, [kept.index(n) for n in c])
        return out

    def step_of(gradient: dict[tuple[str, ...], np.ndarray]) -> list[np.ndarray]:
        out = [np.zeros_like(p) for p in model.potentials]
        for c, g in gradient.items():
            node = model.nodes[home[c]]
            kept = [n for n in node if n in c]
            out[home[c]] = out[home[c]] + _lift(np.transpose(g, [c.index(n) for n in kept]), kept, node)
        return out

    theta = [p.copy() for p in model.potentials]
    if warm is not None:
        for c, p in zip(warm.nodes, warm.potentials, strict=True):
            try:
                i = model.node_of(c)
            except KeyError:
                continue
            theta[i] = theta[i] + _lift(p, c, model.nodes[i])
    mu = model.propagate(theta)
    value, gradient = loss(view(mu))
    # Counts are total * p.  In p, a node's part of the loss has no second derivative above total^2 times the sum of its 1 / sigma^2, and a
    # divergence of the whole is at least that of each node, which is at least half the squared distance.
    most = model.total**2 * sum(1 / m.sigma**2 for m in measurements)
    smooth = most / 1024  # doubled wherever the loss bends more than that

    def bends(to: list[np.ndarray], new: float) -> bool:
        """Whether the loss, from the tables at hand, is more convex than the smoothness tried allows."""
        linear = sum(float((d * (b - a)).sum()) for d, a, b in zip(slope, at, to, strict=True))
        return smooth < most and new - value - linear > smooth * model.divergence(to, at) + 1e-12 * abs(value)

    at, slope, before = mu, step_of(gradient), value
    average, sums, gamma = [x.copy() for x in mu], [np.zeros_like(p) for p in theta], 1.0
    start = theta
    for t in range(1, iterations + 1):
        if engine == "MD":
            smooth = smooth / 2
            share, forward = 1.0, slope
        else:
            # Both take the gradient between the average so far and the last tables.
            share = 2 / (t + 1) if engine == "RDA" else (math.sqrt(gamma * gamma + 4 * gamma) - gamma) / 2
            forward = step_of(loss(view([(1 - share) * a + share * m for a, m in zip(average, at, strict=True)]))[1])
            sums = [s + t / 2 * d for s, d in zip(sums, forward, strict=True)]
            gamma = share * share
        while True:
            pace = model.total / smooth
            trial = [a - pace * d for a, d in zip(start, sums, strict=True)] if engine == "RDA" else [a - pace / share * d for a, d in zip(theta, forward, strict=True)]
            tables = model.propagate(trial)
            new, gradient = loss(view(tables))
            if not bends(tables, new):
                break
            smooth = min(2 * smooth, most)
        theta, at, value, slope = trial, tables, new, step_of(gradient)
        average = at if engine == "MD" else [(1 - share) * a + share * m for a, m in zip(average, at, strict=True)]
        if callback or t % 100 == 0:
            now = value if engine == "MD" else loss(view(average))[0]
            if callback:
                callback(t, now)
            if t % 100 == 0:
                if before - now < tolerance * max(1.0, abs(before)):
                    break
                before = now
    model.tables = average
    model.potentials = theta if engine == "MD" else potentials_of(model, average)
    return model


def potentials_of(model: Model, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Log-potentials whose distribution has the given consistent node tables: each node's over its separator towards a root."""
    logs = [np.log(np.maximum(t, 1e-100) / model.total) for t in tables]
    out = [x.copy() for x in logs]
    near: dict[int, list[int]] = {i: [] for i in range(len(model.nodes))}
    for i, j in model.edges:
        near[i].append(j)
        near[j].append(i)
    seen: set[int] = set()
    for start in near:
        stack = [(start, -1)] if start not in seen else []
        while stack:
            i, up = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            if up >= 0:
                own, both = model.nodes[i], [n for n in model.nodes[i] if n in model.nodes[up]]
                out[i] = logs[i] - _lift(_logsum(logs[i], tuple(a for a, n in enumerate(own) if n not in both)), both, own)
            stack += [(j, i) for j in near[i]]
    return out

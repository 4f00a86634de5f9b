"""A conditional GAN for tables, trained over clients with clipped, noisy updates.

Encoding and decoding are column expressions over the rows.  Training keeps networks of numpy arrays; each client's clipped gradient sums
are computed by the executors that hold its rows (``mapInPandas``) and only those sums, of a fixed size, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..spec import ColumnSpec
from . import discretize, privacy, synth
from .privacy import gan_sigma

#: Components below this weight are dropped; encoded scalars keep within this bound; their unit is this many standard deviations.
LEAST_WEIGHT, BOUND, SPREAD = 0.005, 0.99, 4.0


@dataclass(frozen=True)
class Modes:
    """A mixture: weights, means and standard deviations, and the values that have a slot of their own (for mixed columns)."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    modal: tuple[float, ...] = ()


def fit_modes(df: DataFrame, column: str, most: int = 10, modal: Sequence[float] = (), seed: int = 1) -> Modes:
    """A Gaussian mixture of the present values other than modal ones, by EM; light components dropped.

    The components are MLlib's, not those of a Dirichlet-process mixture, so their number is at most ``most``, not chosen by a prior.
    """
    x = F.col(column).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x) & ~x.isin(*modal) if modal else x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    model = GaussianMixture(k=most, seed=seed, maxIter=50, featuresCol="v").fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(rows))
    kept = [(w, g.mean[0], math.sqrt(max(g.cov.toArray()[0][0], 1e-12))) for w, g in zip(model.weights, model.gaussians, strict=True) if w > LEAST_WEIGHT]
    total = sum(w for w, _, _ in kept)
    kept.sort(key=lambda t: t[1])
    return Modes(tuple(w / total for w, _, _ in kept), tuple(m for _, m, _ in kept), tuple(s for _, _, s in kept), tuple(modal))


def private_modes(df: DataFrame, column: ColumnSpec, ledger: privacy.Ledger, mu: float, noise: privacy.Noise, most: int = 10, rows: int = 10_000, modal: Sequence[float] = (), seed: int = 1) -> Modes:
    """Modes fitted to rows drawn from a noisy one-way marginal over the column's public bins: no row of df is seen otherwise."""
    ledger.charge(f"modes of {column.name}", mu)
    bins = discretize.bins_of(column)
    coded = df.select(discretize.code(F.col(f"`{column.name}`"), bins).alias("bin")).filter("bin is not null")
    every = df.sparkSession.range(len(bins)).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(F.broadcast(coded.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("cnt"))  # a row a bin
    noisy = {r["bin"]: max(r["y"], 0.0) for r in noise.add(counts, 1 / mu, ["bin"]).collect()}
    p = np.array([noisy[b.id] for b in bins]) + 1e-9
    drawn = synth.sampled(df.sparkSession, rows, [("bin", (), p / p.sum())], seed)
    value = discretize.decoded(F.col("bin"), column, bins, f"{seed}|modes", "id").alias(column.name)
    return fit_modes(drawn.select(value), column.name, most, modal, seed)


def encoded(x: Column, modes: Modes, seed: int | str, *keys: str) -> tuple[Column, Column]:
    """(scalar, slot): the mode is drawn by its responsibility for x, by keyed hash; modal values have the slots after the modes."""
    density = [F.lit(w / s) * F.exp(-0.5 * ((x - F.lit(m)) / F.lit(s)) ** 2) + F.lit(1e-300) for w, m, s in zip(modes.weights, modes.means, modes.stds, strict=True)]
    total = sum(density[1:], density[0])
    draw, running, slot = uniform(seed, *keys) * total, F.lit(0.0), F.lit(0)
    for d in density[:-1]:
        running = running + d
        slot = slot + (draw > running).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), slot)
    scalar = (x - pick(modes.means)) / (SPREAD * pick(modes.stds))
    scalar = F.least(F.greatest(scalar, F.lit(-BOUND)), F.lit(BOUND))
    for i, v in enumerate(modes.modal):
        scalar = F.when(x == F.lit(v), F.lit(0.0)).otherwise(scalar)
        slot = F.when(x == F.lit(v), F.lit(len(modes.means) + i)).otherwise(slot)
    return scalar, slot


def decoded(scalar: Column, slot: Column, modes: Modes, decimals: int | None = None) -> Column:
    """The value of a scalar and a slot."""
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), slot)
    value = scalar * SPREAD * pick(modes.stds) + pick(modes.means)
    for i, v in enumerate(modes.modal):
        value = F.when(slot == len(modes.means) + i, F.lit(float(v))).otherwise(value)
    return value if decimals is None else F.bround(value, decimals)


@dataclass(frozen=True)
class Layout:
    """The encoded row: blocks of ("tanh", 1) scalars and ("softmax", n) slots; the softmax blocks are the condition vector."""

    blocks: tuple[tuple[str, int], ...]

    @property
    def width(self) -> int:
        return sum(n for _, n in self.blocks)

    @property
    def slots(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for kind, n in self.blocks:
            if kind == "softmax":
                out.append((at, at + n))
            at += n
        return out

    @property
    def condition(self) -> int:
        return sum(b - a for a, b in self.slots)


class Network:
    """A perceptron with one hidden layer and leaky rectifiers; gradients for each row of a batch."""

    def __init__(self, sizes: Sequence[int], rng: np.random.Generator) -> None:
        self.w = [rng.normal(0, 1 / math.sqrt(a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.w, out.b = [x.copy() for x in self.w], [x.copy() for x in self.b]
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kept = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.where(x > 0, x, 0.2 * x)
            kept.append(x)
        return x, kept

    def backward(self, kept: list[np.ndarray], g: np.ndarray, clip: float | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Summed gradients (weights, then biases) and that of the input.  clip: the norm to which each row's gradient is cut first.

        The norm of a layer's gradient for one row is the product of the norms of its input and its output's gradient, so no row's
        gradient is ever formed.
        """
        deltas = []
        for i in reversed(range(len(self.w))):
            if i < len(self.w) - 1:
                g = g * np.where(kept[i + 1] > 0, 1.0, 0.2)
            deltas.append((i, g))
            g = g @ self.w[i].T
        scale = np.ones(len(g))
        if clip is not None:
            square = sum((kept[i] ** 2).sum(1) * (d**2).sum(1) + (d**2).sum(1) for i, d in deltas)
            scale = 1 / np.maximum(1, np.sqrt(square) / clip)
        grads_w, grads_b = [np.zeros_like(w) for w in self.w], [np.zeros_like(b) for b in self.b]
        for i, d in deltas:
            d = d * scale[:, None]
            grads_w[i], grads_b[i] = kept[i].T @ d, d.sum(0)
        return grads_w + grads_b, g

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        for p, d in zip(self.w + self.b, grads, strict=True):
            p -= rate * d


def activated(raw: np.ndarray, layout: Layout, rng: np.random.Generator, tau: float = 0.2) -> np.ndarray:
    """tanh of the scalars, Gumbel-softmax of the slots."""
    out, at = np.empty_like(raw), 0
    for kind, n in layout.blocks:
        z = raw[:, at : at + n]
        if kind == "softmax":
            z = (z - np.log(-np.log(rng.uniform(1e-12, 1, z.shape)))) / tau
            z = np.exp(z - z.max(1, keepdims=True))
            out[:, at : at + n] = z / z.sum(1, keepdims=True)
        else:
            out[:, at : at + n] = np.tanh(z)
        at += n
    return out


def activation_gradient(out: np.ndarray, g: np.ndarray, layout: Layout, tau: float = 0.2) -> np.ndarray:
    back, at = np.empty_like(g), 0
    for kind, n in layout.blocks:
        y, d = out[:, at : at + n], g[:, at : at + n]
        back[:, at : at + n] = (y * (d - (y * d).sum(1, keepdims=True)) / tau) if kind == "softmax" else d * (1 - y * y)
        at += n
    return back


def averaged(updates: Sequence[list[np.ndarray]], fractions: Sequence[float]) -> list[np.ndarray]:
    """The weighted mean of parameter lists."""
    total = sum(fractions)
    return [sum(f / total * u[i] for u, f in zip(updates, fractions, strict=True)) for i in range(len(updates[0]))]


def corrected(local: list[np.ndarray], own: list[np.ndarray], common: list[np.ndarray]) -> list[np.ndarray]:
    """A client's gradient less its control variate plus the common one (SCAFFOLD)."""
    return [g - c + s for g, c, s in zip(local, own, common, strict=True)]


#: What the logarithms of the cross-entropy loss are kept from zero by.
FLOOR = 1e-4


def pull(scores: np.ndarray, real: bool, loss: str) -> np.ndarray:
    """The loss's derivative by each score, for rows that should count as real or as drawn."""
    if loss == "wasserstein":
        return np.full_like(scores, -1.0 if real else 1.0)
    p = 1 / (1 + np.exp(-scores))
    return -p * (1 - p) / (p + FLOOR) if real else p * (1 - p) / (1 - p + FLOOR)


def value_of(scores: np.ndarray, loss: str) -> float:
    """The generator's loss: its rows should count as real."""
    return float(-scores.mean()) if loss == "wasserstein" else float(-np.log(1 / (1 + np.exp(-scores)) + FLOOR).mean())


class FederatedGan:
    """Discriminator updates are private (clipped, summed over a client's rows, noisy); the generator only sees the discriminator."""

    def __init__(self, layout: Layout, mu: float, clients: int, steps: int, *, noise_dim: int = 16, hidden: int = 32, clip: float = 1.0, rate: float = 0.05, weight_clip: float = 0.1, scaffold: bool = False, seed: int = 1, loss: str = "wasserstein", mode_weight: float = 0.0) -> None:
        if loss not in ("wasserstein", "bce"):
            raise ValueError(f"no loss {loss!r}")
        self.loss, self.mode_weight = loss, mode_weight
        self.layout, self.clip, self.rate, self.noise_dim, self.weight_clip, self.scaffold = layout, clip, rate, noise_dim, weight_clip, scaffold
        self.rng, self.steps = np.random.default_rng(seed), steps
        self.sigma = gan_sigma(mu, steps, clients, clip)
        self.generator = Network([noise_dim + layout.condition, hidden, layout.width], self.rng)
        self.critic = Network([layout.width, hidden, 1], self.rng)
        self.controls: dict[int, list[np.ndarray]] = {}
        self.levels = [np.full(b - a, 1 / (b - a)) for a, b in layout.slots]

    def learn_levels(self, rows: DataFrame, mu: float) -> None:
        """Sets the levels' shares from noisy counts over all rows, which cost mu; a row adds one to a level of each block."""
        sums = rows.agg(*[F.sum(F.col("row")[i]).alias(f"s{i}") for a, b in self.layout.slots for i in range(a, b)]).first()
        sigma = math.sqrt(len(self.layout.slots)) / mu
        for k, (a, b) in enumerate(self.layout.slots):
            noisy = np.clip([(sums[f"s{i}"] or 0.0) + self.rng.normal(0, sigma) for i in range(a, b)], 0, None)
            if noisy.sum() > 0:
                self.levels[k] = noisy / noisy.sum()

    def conditions(self, n: int) -> np.ndarray:
        """One slot block a row, uniformly, and a level of it by its share."""
        out, ends = np.zeros((n, self.layout.condition)), np.cumsum([0, *[len(p) for p in self.levels]])
        block = self.rng.integers(0, len(self.levels), n)
        for b, p in enumerate(self.levels):
            rows = np.flatnonzero(block == b)
            out[rows, ends[b] + self.rng.choice(len(p), len(rows), p=p)] = 1
        return out

    def generate(self, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        c = self.conditions(n)
        raw, kept = self.generator.forward(np.hstack([self.rng.normal(size=(n, self.noise_dim)), c]))
        return activated(raw, self.layout, self.rng), kept, c

    def client_sums(self, rows: DataFrame) -> dict[int, tuple[int, list[np.ndarray]]]:
        """Of rows (client_id, row array<double>): each client's number of rows and clipped gradient sums of the loss of real rows."""
        critic, clip, loss = self.critic, self.clip, self.loss
        width = sum(p.size for p in critic.w + critic.b)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, list] = {}
            for df in frames:
                for client, part in df.groupby("client_id"):
                    x = np.stack(part["row"].to_numpy())
                    scores, kept = critic.forward(x)
                    grads, _ = critic.backward(kept, pull(scores, True, loss), clip)
                    flat = np.concatenate([g.ravel() for g in grads])
                    n, total = sums.get(client, (0, np.zeros(width)))
                    sums[client] = (n + len(x), total + flat)
            if sums:
                yield pd.DataFrame({"client_id": [int(c) for c in sums], "n": [v[0] for v in sums.values()], "g": [v[1] for v in sums.values()]})

        parts = rows.mapInPandas(run, "client_id int, n long, g array<double>")
        total = parts.select("client_id", "n", F.posexplode("g").alias("i", "v")).groupBy("client_id", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        out: dict[int, tuple[int, list[np.ndarray]]] = {}
        for client, part in total.toPandas().groupby("client_id"):  # clients times parameters
            flat, grads, at = part.sort_values("i")["v"].to_numpy(), [], 0
            for p in critic.w + critic.b:
                grads.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            out[int(client)] = (int(part["n"].iloc[0]), grads)
        return out

    def round(self, rows: DataFrame, batch: int = 256) -> float:
        """One critic step at each client and one generator step; returns the generator's loss."""
        sums = self.client_sums(rows)
        fake, _, _ = self.generate(batch)
        scores, kept = self.critic.forward(fake)
        fake_grads, _ = self.critic.backward(kept, pull(scores, False, self.loss) / batch)
        updates, sizes = [], []
        for client, (n, grads) in sorted(sums.items()):
            noisy = [(g + self.rng.normal(0, self.sigma, g.shape)) / n + f for g, f in zip(grads, fake_grads, strict=True)]
            own = self.controls.get(client, [np.zeros_like(g) for g in noisy])
            if self.scaffold and self.controls:
                common = averaged(list(self.controls.values()), [1.0] * len(self.controls))
                self.controls[client] = noisy
                noisy = corrected(noisy, own, common)
            elif self.scaffold:
                self.controls[client] = noisy
            updates.append(noisy)
            sizes.append(n)
        self.critic.step(averaged(updates, sizes), self.rate)
        for p in self.critic.w + self.critic.b if self.loss == "wasserstein" else []:
            np.clip(p, -self.weight_clip, self.weight_clip, out=p)
        return self.generator_step(batch)

    def generator_step(self, batch: int = 256, warm_up: bool = False) -> float:
        """One step of the generator; a warm-up step learns conditions and levels alone, and asks the critic nothing.  Returns the loss."""
        fake, kept, condition = self.generate(batch)
        scores, inner = self.critic.forward(fake)
        g = np.zeros_like(fake) if warm_up else self.critic.backward(inner, pull(scores, True, self.loss) / batch)[1]
        gap = 0.0
        for p, (a, b) in zip(self.levels, self.layout.slots, strict=True):
            # The mode loss: the squared distance of a block's mean slots from the levels' shares.
            apart = fake[:, a:b].mean(0) - p
            gap += float(apart @ apart)
            g[:, a:b] += (self.mode_weight or float(warm_up)) * 2 * apart / batch
        raw_g = activation_gradient(fake, g, self.layout)
        # The conditioned block is pulled to its condition by cross-entropy.
        at = 0
        for a, b in self.layout.slots:
            c = condition[:, at : at + b - a]
            raw_g[:, a:b] += np.where(c.sum(1, keepdims=True) > 0, fake[:, a:b] - c, 0) / batch
            at += b - a
        grads, _ = self.generator.backward(kept, raw_g)
        self.generator.step(grads, self.rate)
        return gap if warm_up else value_of(scores, self.loss) + self.mode_weight * gap

    def fit(self, rows: DataFrame, batch: int = 256, warm_up: int = 0) -> list[float]:
        """The losses of all rounds, which spend the budget that sigma was set for; warm-up steps come before and see no rows."""
        for _ in range(warm_up):
            self.generator_step(batch, warm_up=True)
        return [self.round(rows, batch) for _ in range(self.steps)]

    def synthetic(self, rows: DataFrame, seed: int = 1) -> DataFrame:
        """(id, row) for each row of rows (id): generated by the executors, a row a function of its id's batch and the seed."""
        model = self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                if len(df):
                    model.rng = np.random.default_rng([seed, int(df["id"].iloc[0])])
                    yield pd.DataFrame({"id": df["id"], "row": list(model.generate(len(df))[0])})

        return rows.select("id").mapInPandas(run, "id long, row array<double>")

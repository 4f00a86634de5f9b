"""Gaussian differential privacy: noise, budgets, conversions, selection mechanisms."""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gaussian

_PHI = NormalDist().cdf


@dataclass
class Ledger:
    """A budget mu under quadratic composition: what is spent is the root of the sum of squares."""

    mu: float
    steps: list[tuple[str, float]] = field(default_factory=list)

    @property
    def spent(self) -> float:
        return math.sqrt(sum(m * m for _, m in self.steps))

    @property
    def left(self) -> float:
        return math.sqrt(max(0.0, self.mu**2 - self.spent**2))

    def charge(self, step: str, mu: float) -> float:
        if mu < 0 or math.sqrt(self.spent**2 + mu**2) > self.mu * (1 + 1e-9):
            raise ValueError(f"{step}: {mu:g} is more than the {self.left:g} left")
        self.steps.append((step, mu))
        return mu


@dataclass(frozen=True)
class Noise:
    """Where noise comes from.  "secret" draws from an unpublished seed of the operating system and is private; "keyed" is a function of
    a public seed and the cell, for tests and oracles, and gives no privacy."""

    mode: str = "secret"
    seed: int = 0

    @property
    def private(self) -> bool:
        return self.mode == "secret"

    def add(self, df: DataFrame, sigma: float, keys: Sequence[str], count: str = "cnt") -> DataFrame:
        """df with y = count + sigma * z and sigma.

        Secret noise is drawn once: the caller writes the result out (or persists it with a checkpoint) before using it twice, as a
        recomputation would draw anew and leak.  It hashes the secret seed with the cell, so a retried task draws the same.
        """
        if self.mode not in ("secret", "keyed"):
            raise ValueError(f"no noise mode {self.mode!r}")
        seed = secrets.token_hex(32) if self.private else str(self.seed)
        return df.withColumn("y", F.col(count) + F.lit(float(sigma)) * gaussian(seed, *keys)).withColumn("sigma", F.lit(float(sigma)))


def split_budget(mu: float, weights: Sequence[float]) -> list[float]:
    """mu_i = mu * w_i / |w|: the squares add up to mu squared."""
    norm = math.sqrt(sum(w * w for w in weights))
    return [mu * w / norm for w in weights]


def proportional(mu: float, shares: Sequence[float]) -> list[float]:
    """sqrt(share * mu^2) for shares that sum to 1."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    return [math.sqrt(s) * mu for s in shares]


def delta_of(mu: float, eps: float) -> float:
    """The delta that mu-GDP gives at eps."""
    return _PHI(-eps / mu + mu / 2) - math.exp(eps) * _PHI(-eps / mu - mu / 2)


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where an increasing function is zero, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def mu_of(eps: float, delta: float) -> float:
    """The mu whose delta at eps is the given one."""
    return _root(lambda m: delta_of(m, eps) - delta, 1e-6, 100.0)


def eps_of(mu: float, delta: float) -> float:
    """The eps at which mu-GDP gives delta."""
    return _root(lambda e: delta - delta_of(mu, e), 0.0, 200.0)


def mechanism_eps(mu: float) -> float:
    """The eps of an exponential mechanism that is mu-GDP: ln(1 / PHI(-mu/2) - 1), by the tail's expansion where it underflows."""
    tail = math.erfc(mu / math.sqrt(8)) / 2
    if tail < 1e-280:
        return mu * mu / 8 + math.log(mu / 2 * math.sqrt(2 * math.pi))
    return math.log((1 - tail) / tail)


def exponential_choice(scores: dict, eps: float, rng: np.random.Generator, sensitivity: float = 1.0):
    """A key drawn with probability proportional to exp(eps * score / (2 * sensitivity))."""
    keys = sorted(scores)
    logits = np.array([0.5 * eps * scores[k] / sensitivity for k in keys])
    p = np.exp(logits - logits.max())
    return keys[rng.choice(len(keys), p=p / p.sum())]


def noisy_max(scores: DataFrame, noise: Noise, mu: float, n_clients: int) -> DataFrame:
    """(clique, y): of rows (clique, score), the one whose score plus noise is largest; ties go to the smaller name."""
    noisy = noise.add(scores, math.sqrt(n_clients) / mu, ["clique"], "score")
    best = noisy.agg(F.max_by(F.struct("clique", "y"), F.struct("y", F.hash("clique"))).alias("best"))
    return best.select("best.clique", "best.y")


def gan_sigma(mu: float, steps: int, clients: int, clip: float = 1.0) -> float:
    return clip * math.sqrt(steps * clients) / mu


def gan_steps(mu: float, sigma: float, clients: int, clip: float = 1.0) -> int:
    return math.ceil((sigma * mu / (clip * math.sqrt(clients))) ** 2)


def gan_rounds(mu: float, most: int = 1000, share: float = 0.75) -> int:
    """The number of training steps for a budget."""
    return min(most, round(most * math.sqrt(share) * mu))

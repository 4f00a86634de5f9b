"""A whole table for the GAN: its rows as vectors by the specification and private metadata, and vectors as rows again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing
from ..spec import ColumnSpec, TableSpec
from . import discretize, gan, privacy


def _one_hot(slot: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == slot).cast("double"), F.lit(0.0)))


@dataclass(frozen=True)
class TableEncoder:
    """Per column a block of one-hot slots, for numbers after a scalar: levels of a category, integers of an ordinal, modes of a number.

    A mixed column has a slot for its zero, and a column that may be missing one more.  A category that the specification lacks has no
    slot set, and comes back missing.
    """

    spec: TableSpec
    modes: dict[str, gan.Modes]

    @classmethod
    def learned(cls, df: DataFrame, spec: TableSpec, ledger: privacy.Ledger, mu: float, noise: privacy.Noise, most: int = 10) -> TableEncoder:
        """Modes of each number from a noisy one-way marginal; together they cost mu."""
        names = [c for c in spec.columns if c.role in ("numerical", "mixed")]
        shares = privacy.split_budget(mu, [1.0] * len(names)) if names else []
        return cls(spec, {c.name: gan.private_modes(df, c, ledger, m, noise, most, modal=(0.0,) if c.role == "mixed" else ()) for c, m in zip(names, shares, strict=True)})

    def slots(self, column: ColumnSpec) -> int:
        if column.name in self.modes:
            n = len(self.modes[column.name].means) + len(self.modes[column.name].modal)
        else:
            n = len(column.levels) if column.role == "categorical" else int(column.high) - int(column.low) + 1
        return n + column.may_be_missing

    @property
    def layout(self) -> gan.Layout:
        return gan.Layout(tuple(block for c in self.spec.columns for block in ([("tanh", 1)] if c.name in self.modes else []) + [("softmax", self.slots(c))]))

    def _coded(self, column: ColumnSpec, seed: int | str, keys: Sequence[str]) -> tuple[Column | None, Column]:
        """The scalar, if the column has one, and the slot."""
        x, last = F.col(f"`{column.name}`"), F.lit(self.slots(column) - 1)
        missing = is_missing(x) if column.role != "categorical" else x.isNull()
        if column.name in self.modes:
            scalar, slot = gan.encoded(x.cast("double"), self.modes[column.name], f"{seed}|{column.name}", *keys)
            scalar = F.when(missing, F.lit(0.0)).otherwise(scalar)
        elif column.role == "categorical":
            scalar, slot = None, F.array_position(F.array(*[F.lit(v) for v in column.levels]), x.cast("string")) - 1
        else:
            scalar, slot = None, x.cast("int") - int(column.low)
        return scalar, F.when(missing, last if column.may_be_missing else F.lit(-1)).otherwise(slot).cast("int")

    def encoded(self, df: DataFrame, seed: int | str, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., row array<double>); the mode of a number is drawn by a keyed hash of keys."""
        parts = []
        for c in self.spec.columns:
            scalar, slot = self._coded(c, seed, keys)
            hot = _one_hot(slot, self.slots(c))
            parts += [hot] if scalar is None else [F.array(scalar), hot]
        return df.select(*keep, F.concat(*parts).alias("row"))

    def decoded(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., the columns of the specification) from rows with ``row``: the largest slot of a block counts, and what it stands for."""
        at, out = 1, []
        for c in self.spec.columns:
            scalar = F.get("row", F.lit(at - 1)) if c.name in self.modes else None
            at += scalar is not None
            n = self.slots(c)
            block = F.slice("row", at, n)
            slot = (F.array_position(block, F.array_max(block)) - 1).cast("int")
            none = (slot == n - 1) if c.may_be_missing else F.lit(False)
            at += n
            if scalar is not None:
                value = F.greatest(gan.decoded(scalar, slot, self.modes[c.name], c.decimals), F.lit(0.0)) if c.role == "mixed" else gan.decoded(scalar, slot, self.modes[c.name], c.decimals)
            elif c.role == "categorical":
                value, none = F.get(F.array(*[F.lit(v) for v in c.levels]), slot), none | (F.array_max(block) <= 0)
            else:
                value = slot + int(c.low)
            out.append(F.when(~none, value).alias(c.name))
        return rows.select(*keep, *out)

    def train(self, df: DataFrame, mu: float, clients: int, steps: int, seed: int, keys: Sequence[str], client: str = "client_id", level_share: float = 0.25, **options) -> gan.FederatedGan:
        """A GAN trained on the table's vectors, its levels' shares from noisy counts that cost a share of mu squared."""
        for_levels, for_training = privacy.proportional(mu, [level_share, 1 - level_share])
        rows = self.encoded(df, seed, keys, [F.col(client).cast("int").alias("client_id")])
        model = gan.FederatedGan(self.layout, for_training, clients, steps, seed=seed, **options)
        model.learn_levels(rows, for_levels)
        model.fit(rows)
        return model

    def synthetic(self, model: gan.FederatedGan, n: int, seed: int = 1) -> DataFrame:
        """(id, the columns): n rows drawn under the levels' shares, decoded."""
        from pyspark.sql import SparkSession

        return self.decoded(model.synthetic(SparkSession.active().range(n), seed), ["id"])


def own_conditions(rows: np.ndarray, layout: gan.Layout, rng: np.random.Generator) -> np.ndarray:
    """Condition vectors for real rows: a block each, uniformly, and the row's own slot of it."""
    sizes = [b - a for a, b in layout.slots]
    starts = np.cumsum([0, *sizes])
    out, block = np.zeros((len(rows), layout.condition)), rng.integers(0, len(sizes), len(rows))
    for k, (a, b) in enumerate(layout.slots):
        at = np.flatnonzero(block == k)
        out[at, starts[k] + rows[at, a:b].argmax(1)] = 1
    return out

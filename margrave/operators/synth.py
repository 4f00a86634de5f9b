"""Synthetic rows from conditional probability tables, column by column, by keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..spec import TableSpec
from .discretize import Bin, decoded

#: Cells of a conditional table up to which it is a literal of the plan; larger ones are joined.
LITERAL_CELLS = 4096


def sampled(spark: SparkSession, n: int, conditionals: Sequence[tuple[str, tuple[str, ...], np.ndarray]], seed: int | str) -> DataFrame:
    """(id, the columns as codes): n rows drawn from (column, parents, P(column | parents)), parents before children.

    The code is the number of cumulative probabilities at or below a uniform number hashed from the row's id and the column's name.
    """
    out = spark.range(n)
    for name, parents, table in conditionals:
        sums = np.cumsum(table, axis=-1)[..., :-1].reshape(-1, table.shape[-1] - 1)
        at = F.lit(0)
        for p, size in zip(parents, table.shape[:-1], strict=True):
            at = at * F.lit(int(size)) + F.col(p)
        if sums.size <= LITERAL_CELLS:
            row = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in r]) if len(r) else F.array().cast("array<double>") for r in sums]), at)
            out = out.withColumn("_cum", row)
        else:
            cells = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(sums)], "_at int, _cum array<double>")
            out = out.withColumn("_at", at.cast("int")).join(F.broadcast(cells), "_at").drop("_at")  # the model's cells bound it
        draw = uniform(seed, F.lit(name), "id")
        out = out.withColumn("_u", draw).withColumn(name, F.size(F.filter("_cum", lambda c: c <= F.col("_u")))).drop("_cum", "_u")
    return out


def decoded_rows(codes: DataFrame, spec: TableSpec, bins: dict[str, list[Bin]], seed: int | str) -> DataFrame:
    """The columns of spec in their original space."""
    return codes.select("id", *[decoded(F.col(c.name), c, bins[c.name], f"{seed}|{c.name}", "id").alias(c.name) for c in spec.columns])

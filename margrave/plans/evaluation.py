"""Evaluation of a model against held-out rows, and grids of experiments."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import with_stand_in
from ..operators import discretize, evaluate, privacy, split, synth
from ..operators.discretize import Bin
from ..operators.pgm import Domain, Model
from ..spec import TableSpec
from . import models

RESULTS = "setting string, mu double, rep int, model string, metric string, value double"


def in_space(df: DataFrame, spec: TableSpec, bins: dict[str, Sequence[Bin]], is_coded: bool, coded: bool, seed: int | str, key: str = "id") -> DataFrame:
    """df's columns as codes or in their original space, whichever is asked for; decoding draws by a hash of ``key``."""
    if is_coded == coded:
        return df.select(*spec.names)
    if coded:
        return discretize.coded(df, spec, bins)
    return synth.decoded_rows(df, spec, bins, seed).select(*spec.names)


def metrics(train: DataFrame, test: DataFrame, rows: DataFrame | None, spec: TableSpec, bins: dict[str, Sequence[Bin]], features: Sequence[str], degrees: Sequence[int] = (1, 2), trees: int = 0) -> list[tuple[str, float]]:
    """(metric, value) of synthetic rows, or of the training rows themselves if there are none: the baseline.

    train, test and rows are in the original space.  Marginal errors are over codes.  Discrimination and utility are by a logistic model
    on ``features`` (numbers; missing ones as their stand-in), and by a forest too where trees are asked for.
    """
    rows = train if rows is None else rows
    a, b = (in_space(x, spec, bins, False, True, 0) for x in (test, rows))
    out = [(f"marginal error {k}", evaluate.marginal_error(a, b, spec.names, k).first()["error"]) for k in degrees]
    label = F.col(spec.label)
    filled = lambda x: x.withColumns({c: with_stand_in(F.col(c), "number") for c in features})
    train, test, rows = filled(train), filled(test), filled(rows)
    for model in ["logistic"] + ["forest"] * bool(trees):
        got = evaluate.discriminator(test, rows, features, model, **({"trees": trees} if trees else {})).first()
        out += [(f"discriminator {model} accuracy", got["accuracy"]), (f"discriminator {model} skill", got["skill"])]
        positive = max(next(c for c in spec.columns if c.name == spec.label).levels)
        as_number = lambda x: x.select(*features, (label == F.lit(positive)).cast("int").alias("_y"))  # noqa: B023, E731
        used = evaluate.utility(as_number(rows), as_number(test), features, "_y", model, **({"trees": trees} if trees else {})).first()
        out += [(f"utility {model} {k}", used[k]) for k in ("accuracy", "f1", "auc", "skill")]
    return [(k, float("nan") if v is None else float(v)) for k, v in out]


def drawn(spark: SparkSession, model: Model, n: int, spec: TableSpec, bins: dict[str, Sequence[Bin]], seed: int) -> DataFrame:
    """n rows of a model in the original space."""
    return synth.decoded_rows(synth.sampled(spark, n, model.conditionals(), seed), spec, bins, seed)


def run_grid(df: DataFrame, keys: Sequence[str], spec: TableSpec, bins: dict[str, Sequence[Bin]], features: Sequence[str], settings: Sequence[str], budgets: Sequence[float], reps: int, plans: Iterable[str] = ("independent", "tree"), noise: privacy.Noise | None = None, keep: Callable[[int], bool] = lambda rep: True, seed: int = 1, **options) -> DataFrame:
    """The results (RESULTS) of every split setting, budget, repetition that ``keep`` selects, and plan, with the training baseline at mu 0.

    Each repetition splits df anew into test rows and clients; a plan "local" is the tree fitted to the first client alone, and
    "single" the tree fitted to all rows as one client.
    """
    spark, noise, out = df.sparkSession, noise or privacy.Noise(), []
    domain = Domain({n: len(b) for n, b in bins.items()})
    for setting in settings:
        label = (F.col(spec.label) == F.lit(max(next(c for c in spec.columns if c.name == spec.label).levels))).cast("int")
        dealt = split.repeated_splits(df.withColumn("_label", label), setting, reps, seed, keys, "_label").drop("_label")
        for rep in filter(keep, range(reps)):
            here = dealt.filter(F.col("rep") == rep)
            train, test = here.filter("split = 'train'"), here.filter("split = 'test'")
            out += [(setting, 0.0, rep, "training rows", *m) for m in metrics(train, test, None, spec, bins, features)]
            coded = discretize.coded(train, spec, bins, ["client_id"])
            n = 3 * test.count()
            for mu in budgets:
                for plan in plans:
                    fit = models.FITS["tree" if plan in ("local", "single") else plan]
                    rows = models.for_plan(coded, plan)
                    model = fit(rows, domain, models.Settings(mu=mu, seed=seed + rep, **options), noise)[0]
                    made = drawn(spark, model, n, spec, bins, seed + rep)
                    out += [(setting, float(mu), rep, plan, *m) for m in metrics(train, test, made, spec, bins, features)]
    return spark.createDataFrame(out, RESULTS)


def marginal_sample(names: Sequence[str], k: int, n: int, seed: int) -> list[tuple[str, ...]]:
    """n of the sets of k columns, drawn without replacement; all if there are fewer."""
    every = evaluate.powerset(names, k, k)
    at = np.random.default_rng(seed).choice(len(every), min(n, len(every)), replace=False)
    return [every[i] for i in sorted(at)]

"""Quality of synthetic tables: marginal error, discrimination, utility, and the metric kernels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .marginals import marginals, powerset
from .split import stratified_folds


#: Parts of [0, 1] by which probabilities are ranked.
BUCKETS = 1024


def marginal_errors(test: DataFrame, synth: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """(clique, error): the total-variation distance of each k-way marginal, synthetic counts scaled to the test's number of rows."""
    cliques = powerset(names, k, k)
    # Cells of both sides are few beside the rows; the two aggregations that follow read them, each once.
    both = marginals(test.select(*names, F.lit(1).alias("src")).unionByName(synth.select(*names, F.lit(0).alias("src"))), cliques, ["src"])
    totals = both.groupBy("clique", "src").agg(F.sum("cnt").alias("n"))
    sizes = totals.groupBy("clique").agg(F.max(F.when(F.col("src") == 1, F.col("n"))).alias("nt"), F.max(F.when(F.col("src") == 0, F.col("n"))).alias("ns"))
    cells = both.groupBy("clique", "cell").agg(F.sum(F.when(F.col("src") == 1, F.col("cnt")).otherwise(0)).alias("t"), F.sum(F.when(F.col("src") == 0, F.col("cnt")).otherwise(0)).alias("s"))
    gap = F.abs(F.col("t") - F.col("nt") / F.col("ns") * F.col("s"))
    return cells.join(F.broadcast(sizes), "clique").groupBy("clique").agg((F.sum(gap) / (2.0 * F.max("nt"))).alias("error"))


def marginal_error(test: DataFrame, synth: DataFrame, names: Sequence[str], k: int, compat: bool = False) -> DataFrame:
    """(k, error): the mean over the k-way marginals; compat leaves the first out, as the original measure does."""
    errors = marginal_errors(test, synth, names, k)
    if compat:
        errors = errors.filter(F.col("clique") != "|".join(powerset(names, k, k)[0]))
    return errors.agg(F.lit(k).alias("k"), F.avg("error").alias("error"))


def binary_metrics(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, brier, skill (against the base rate), f1, precision, recall, auc of probabilities, in aggregates.

    AUC is Mann and Whitney's, ties counted half.  Equal probabilities are counted first, so the running sums are over distinct values.
    """
    counts = df.groupBy(*by, prob).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    # Probabilities are cut into BUCKETS, so that no task sorts all distinct ones: a bucket's offset and the running sum in the bucket.
    counts = counts.withColumn("_bucket", F.least(F.greatest(F.floor(F.col(prob) * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int"))
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(prob).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "_bucket").agg(F.sum("neg").alias("_neg"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    offsets = sums.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by] + [F.col("_bucket") == F.col("_at")]
    ranked = counts.withColumn("_in", F.coalesce(F.sum("neg").over(in_bucket), F.lit(0))).join(offsets, same).withColumn("neg_below", F.col("_in") + F.col("_before"))
    p, pos, neg = F.col(prob), F.col("pos"), F.col("neg")
    tp, fp = F.sum(F.when(p >= 0.5, pos).otherwise(0)), F.sum(F.when(p >= 0.5, neg).otherwise(0))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    base = grouped.agg(
        tp.alias("tp"), fp.alias("fp"), n_pos.alias("n_pos"), n_neg.alias("n_neg"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / (n_pos + n_neg)).alias("brier"),
        (F.sum(pos * (F.col("neg_below") + 0.5 * neg)) / F.try_divide(n_pos * n_neg, F.lit(1))).alias("auc"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    rate = F.col("n_pos") / n
    return base.select(
        *by,
        ((F.col("tp") + F.col("n_neg") - F.col("fp")) / n).alias("accuracy"),
        "brier",
        (1 - F.try_divide(F.col("brier"), rate * (1 - rate))).alias("skill"),
        F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")).alias("f1"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"),
        "auc",
    )


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> list[Column]:
    """0/1 columns of the sorted levels but the first."""
    return [(F.col(column) == F.lit(v)).cast("int").alias(f"{column}_{v}") for v in sorted(levels)[1:]]


def _classifier(model: str, features: Sequence[str], trees: int):
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    last = {"logistic": LogisticRegression(labelCol="label", maxIter=100), "forest": RandomForestClassifier(labelCol="label", numTrees=trees, seed=1)}
    if model not in last:
        raise ValueError(f"no model {model!r}")
    return Pipeline(stages=[assembler, scaler, last[model]])


def _scored(fitted, df: DataFrame) -> DataFrame:
    return fitted.transform(df).withColumn("prob", vector_to_array("probability")[1])


def discriminator(real: DataFrame, synth: DataFrame, features: Sequence[str], model: str = "logistic", folds: int = 3, seed: int = 1, trees: int = 500) -> DataFrame:
    """(accuracy, neg_brier, skill): how well a classifier tells real from synthetic rows, the mean over stratified folds."""
    rows = real.select(*features, F.lit(0).alias("label")).unionByName(synth.select(*features, F.lit(1).alias("label")))
    dealt = stratified_folds(rows.withColumn("_id", F.monotonically_increasing_id()), "label", folds, seed, ["_id"]).persist()
    scored = []  # each fold's model is fitted here, once; what remains lazy is the scoring
    for k in range(folds):
        fitted = _classifier(model, features, trees).fit(dealt.filter(F.col("fold") != k))
        scored.append(_scored(fitted, dealt.filter(F.col("fold") == k)).select("label", "prob", "fold"))
    got = binary_metrics(reduce(DataFrame.unionByName, scored), "label", "prob", ["fold"])
    return got.agg(F.avg("accuracy").alias("accuracy"), (-F.avg("brier")).alias("neg_brier"), (1 - 4 * F.avg("brier")).alias("skill"))


def utility(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, model: str = "logistic", trees: int = 250) -> DataFrame:
    """binary_metrics on test of a classifier trained on train (synthetic or real rows)."""
    name = lambda df: df.select(*features, F.col(label).cast("int").alias("label"))
    return binary_metrics(_scored(_classifier(model, features, trees).fit(name(train)), name(test)), "label", "prob")


def by_budget(results: DataFrame) -> DataFrame:
    """(mu, mean, median, least, most, std_error) of results (rep, mu, value); NaN is missing."""
    present = results.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return present.groupBy("mu").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("std_error"))


def associations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, v): Cramer's V of pairs of columns, without bias correction, from their two-way marginals, which one scan counts.

    The cells without rows add their expected counts to the statistic, which are what the occupied cells leave of the total.
    """
    split = F.split("cell", "\\|")
    cells = marginals(df, pairs).select("clique", split[0].alias("x"), split[1].alias("y"), F.col("cnt").cast("double").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("clique", *c))
    margins = cells.select("clique", "x", "y", "n", w("x").alias("nx"), w("y").alias("ny"), w().alias("total"))
    terms = margins.groupBy("clique").agg(F.sum(F.col("n") * F.col("n") * F.col("total") / (F.col("nx") * F.col("ny"))).alias("s"), F.max("total").alias("total"), F.countDistinct("x").alias("lx"), F.countDistinct("y").alias("ly"))
    names = F.split("clique", "\\|")
    v = F.sqrt((F.col("s") - F.col("total")) / (F.col("total") * F.least(F.col("lx") - 1, F.col("ly") - 1)))
    return terms.select(names[0].alias("a"), names[1].alias("b"), v.alias("v"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(v) of one pair."""
    return associations(df, [(a, b)]).select("v")


def correlation_ratio(df: DataFrame, category: str, number: str) -> DataFrame:
    """(v): the root of the share of a number's variance that lies between the levels of a category."""
    rows = df.filter(F.col(category).isNotNull() & F.col(number).isNotNull())
    sums = rows.groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(number).alias("mean"), F.var_pop(number).alias("var"))
    total = sums.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("m") * F.col("m")
    return total.select(F.sqrt(F.try_divide(F.greatest(between, F.lit(0.0)), F.greatest(between, F.lit(0.0)) + F.col("within"))).alias("v"))


def histogram(df: DataFrame, column: str, low: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, cnt, density)."""
    bucket = F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("bucket")
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("density", F.col("cnt") / (F.sum("cnt").over(Window.partitionBy(*(by or [F.lit(0)]))) * F.lit(width)))

"""Closed-form facts, properties and errors of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from margrave.functions import scalars as S
from margrave.operators import discretize as D
from margrave.operators import gan as G
from margrave.operators import gan_table as GT
from margrave.operators import marginals as M
from margrave.operators import pgm
from margrave.operators import privacy as P
from margrave.operators import selection as X
from margrave.operators import split
from margrave.operators import synth
from margrave.plans import evaluation, models, q_models
from margrave.sources import tables
from margrave.spec import ColumnSpec, TableSpec, inferred_roles
from margrave.streaming.counts import noisy_windows


def values(df):
    return [tuple(r) for r in df.collect()]


def test_edges_and_codes(spark):
    assert D.halved(0, 8, 1) == [0, 2, 4, 6, 8]
    bins = D.bins_of(ColumnSpec("x", "numerical", low=0, high=8), 1)
    df = spark.createDataFrame([(2.5,), (0.0,), (8.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in values(df.select(D.code(F.col("x"), bins)))] == [1, 0, 3, None, None]


@pytest.mark.parametrize(("missing", "role", "n"), [(False, "numerical", 32), (False, "mixed", 33), (True, "mixed", 34)])
def test_number_of_bins(missing, role, n):
    assert len(D.bins_of(ColumnSpec("x", role, low=0, high=10, may_be_missing=missing))) == n


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-50, 150, allow_nan=False), min_size=1, max_size=40))
def test_fast_code_equals_comparisons(spark, xs):
    bins = D.bins_of(ColumnSpec("x", "numerical", low=0, high=100))
    edges = [b.low for b in bins]
    got = values(spark.createDataFrame([(float(x),) for x in xs], "x double").select(D.code(F.col("x"), bins)))
    assert [r[0] for r in got] == [sum(x >= e for e in edges[1:]) for x in xs]


def test_decoded_values_lie_in_their_bins(spark):
    spec = ColumnSpec("x", "numerical", decimals=2, low=0, high=100)
    bins = D.bins_of(spec)
    df = spark.range(500).select("id", (F.col("id") % 32).cast("int").alias("code"))
    df = df.withColumn("x", D.decoded(F.col("code"), spec, bins, 1, "id"))
    assert df.filter(D.code(F.col("x"), bins) != F.col("code")).count() == 0


def test_merging():
    assert D.merged_groups([[3, 100], [1, 2, 50, 2]], 4, 10) == [[0, 1], [2], [3]]
    assert D.pooled_levels({"a": 1.0, "b": 50.0, "c": 2.0}, 10) == {"a": "other", "b": "b", "c": "other"}
    assert D.pooled_levels({"a": 1.0, "b": 2.0}, 10) == {"a": "a", "b": "b"}
    assert D.pooling_matrix([[0], [1, 2], [3]], 4) == [[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]]


def test_pooled_marginal(spark):
    counts = spark.createDataFrame([(0, 5), (1, 1), (2, 2), (3, 9)], "x int, cnt long")
    assert sorted(values(M.pooled(counts, "x", [[0], [1, 2], [3]]))) == [(0, 5), (1, 3), (2, 9)]


def test_marginals_of_many_sets_sum_to_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7).alias("c"))
    got = M.marginals(df, M.powerset("abc", 1, 3)).groupBy("clique").agg(F.sum("cnt").alias("n"))
    assert values(got.select("n").distinct()) == [(1000,)] and got.count() == 7


def test_inverse_variance(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 4.0)], "y double, variance double")
    assert values(M.inverse_variance(df, [])) == [(12.0, 0.8)]


def test_split_sizes(spark):
    df = spark.range(10)
    got = split.split_iid(df, [0.5, 0.2, 0.1, 0.1, 0.1], 1, ["id"]).groupBy("client_id").count()
    assert sorted(values(got)) == [(0, 5), (1, 2), (2, 1), (3, 1), (4, 1)]
    assert split.sample_n(df, 20, 1, ["id"]).count() == 10
    with pytest.raises(ValueError, match="sum to 1"):
        split.split_iid(df, [0.5, 0.2], 1, ["id"])
    ones = df.withColumn("y", F.lit(1))
    with pytest.raises(ValueError, match="more rows of label 1"):
        split.split_label_skew(ones, "y", [0.2] * 5, [5, 2, 1, 1, 1], 1, ["id"])
    with pytest.raises(ValueError, match="no setting"):
        split.repeated_splits(df, "other", 1, 1, ["id"])


def test_privacy_conversions():
    assert P.mu_of(0.5, 1e-9) == pytest.approx(0.09368650, abs=1e-7)
    assert P.mu_of(1.0, 1e-9) == pytest.approx(0.18197481, abs=1e-7)
    assert P.eps_of(P.mu_of(0.7, 1e-6), 1e-6) == pytest.approx(0.7, abs=1e-6)
    assert [P.gan_rounds(m) for m in (0.01, 0.5, 1.0, 2.5)] == [9, 433, 866, 1000]
    assert P.gan_steps(1.0, P.gan_sigma(1.0, 100, 5), 5) in (100, 101)
    assert math.sqrt(sum(m * m for m in P.split_budget(0.7, [1, 2, 3]))) == pytest.approx(0.7)


def test_ledger_refuses_more_than_its_budget():
    ledger = P.Ledger(1.0)
    ledger.charge("a", 0.6)
    ledger.charge("b", 0.8)
    with pytest.raises(ValueError, match="more than"):
        ledger.charge("c", 0.1)


def test_noise(spark):
    cells = spark.range(4000).withColumn("cnt", F.lit(100))
    noisy = P.Noise("keyed", 1).add(cells, 2.0, ["id"]).agg(F.avg("y"), F.stddev("y")).first()
    assert noisy[0] == pytest.approx(100, abs=0.2) and noisy[1] == pytest.approx(2.0, abs=0.15)
    secret = P.Noise()
    assert secret.private and not P.Noise("keyed").private
    a, b = (values(secret.add(cells.limit(5), 2.0, ["id"]).select("y")) for _ in range(2))
    assert a != b


def test_trees():
    assert X.spanning_tree({("a", "b"): 1.0, ("b", "c"): 3.0, ("a", "c"): 2.0}) == [("b", "c"), ("a", "c")]
    tree = X.private_tree({("a", "b"): 100.0, ("b", "c"): 300.0, ("a", "c"): 0.0}, "abc", 50.0, np.random.default_rng(1))
    assert len(tree) == 2


@pytest.mark.parametrize("engine", ["MD", "RDA", "IG"])
def test_estimation_recovers_consistent_marginals(engine):
    rng = np.random.default_rng(0)
    domain = pgm.Domain({"a": 3, "b": 4, "c": 2})
    joint = rng.dirichlet(np.ones(24)).reshape(3, 4, 2) * 1000
    got = [pgm.Measurement(c, joint.sum(axis=tuple(i for i, n in enumerate("abc") if n not in c)).reshape(-1), 1.0) for c in (("a", "b"), ("b", "c"))]
    model = pgm.estimate(domain, got, engine, 3000, tolerance=1e-12)
    for m in got:
        assert np.abs(model.project(m.clique).reshape(-1) - m.y).sum() < 3
    expected = np.einsum("ab,bc->ac", joint.sum(2), joint.sum(0) / joint.sum((0, 2))[:, None])
    assert np.abs(model.project(("a", "c")) - expected).sum() < 3
    assert np.allclose(model.project(("c", "a")), model.project(("a", "c")).T)


def test_estimation_with_groups_and_errors():
    domain = pgm.Domain({"a": 4})
    m = pgm.Measurement(("a",), np.array([10.0, 30.0]), 1.0, {"a": np.array([0, 0, 1, 1])})
    model = pgm.estimate(domain, [m], "MD", 500)
    assert np.allclose(model.project(("a",)), [5, 5, 15, 15], atol=0.5)
    with pytest.raises(ValueError, match="answers are needed"):
        pgm.estimate(domain, [pgm.Measurement(("a",), np.zeros(3), 1.0)])
    with pytest.raises(ValueError, match="engine"):
        pgm.estimate(domain, [m], "SGD")


def test_junction_tree():
    domain = pgm.Domain(dict.fromkeys("abcd", 2))
    nodes, edges = pgm.junction_tree(domain, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert sorted(map(len, nodes)) == [3, 3] and len(edges) == 1


def test_sampled_rows_follow_the_tables(spark):
    p = np.array([[0.9, 0.1], [0.2, 0.8]])
    df = synth.sampled(spark, 4000, [("a", (), np.array([0.5, 0.5])), ("b", ("a",), p)], 1)
    got = {(r["a"], r["b"]): r["n"] / 4000 for r in df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[0, 0] == pytest.approx(0.45, abs=0.04) and got[1, 1] == pytest.approx(0.4, abs=0.04)


def test_plans_spend_their_budget(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("int").alias("client_id"), (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"), (F.col("id") % 3).cast("int").alias("c"))
    domain = pgm.Domain({"a": 2, "b": 4, "c": 3})
    s, noise = models.Settings(mu=5.0, iterations=200), P.Noise("keyed", 1)
    model, ledger, tree = models.fit_tree(df, domain, s, noise)
    assert ledger.spent == pytest.approx(5.0) and len(tree) == 2 and model.total == pytest.approx(600, rel=0.05)
    _, ledger, chosen = models.fit_iterative(df, domain, s, noise, rounds=2)
    assert ledger.spent <= 5.0 * (1 + 1e-9) and len(set(chosen)) == len(chosen)
    with pytest.raises(ValueError, match="method"):
        models.Settings(method="best")


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = G.Network([3, 4, 1], rng)
    x = rng.normal(size=(5, 3))
    _, kept = net.forward(x)
    grads, _ = net.backward(kept, np.ones((5, 1)))
    net.w[0][1, 2] += 1e-6
    up = net.forward(x)[0].sum()
    net.w[0][1, 2] -= 2e-6
    assert (up - net.forward(x)[0].sum()) / 2e-6 == pytest.approx(grads[0][1, 2], rel=1e-4)
    net.w[0][1, 2] += 1e-6
    clipped, _ = net.backward(kept, 100 * np.ones((5, 1)), clip=1.0)
    assert math.sqrt(sum((g**2).sum() for g in clipped)) <= 5 + 1e-9
    assert np.allclose(G.averaged([[np.array([1.0])], [np.array([4.0])]], [2, 1])[0], 2.0)


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (-3.0,), (None,)], "x double")
    assert [r[0] for r in values(df.select(S.rounded(F.col("x"), 0)))] == [2.0, -3.0, None]
    assert [r[0] for r in values(df.select(S.unshifted_log(S.shifted_log(F.col("x"), -3.0), -3.0)))][:2] == pytest.approx([2.5, -3.0])
    assert [r[0] for r in values(df.select(S.remap(F.col("x"), {2.5: None})))] == [None, -3.0, None]


def test_specifications(spark, tmp_path):
    with pytest.raises(ValueError, match="role"):
        ColumnSpec("x", "text")
    with pytest.raises(ValueError, match="negative"):
        ColumnSpec("x", "mixed", low=-1)
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert inferred_roles(df) == {"n": "numerical", "s": "categorical"}
    with pytest.raises(ValueError, match="no role"):
        inferred_roles(df.select(F.array("n").alias("l")))
    spec = TableSpec((ColumnSpec("n", "numerical", low=0, high=2), ColumnSpec("s", "categorical", levels=("a",))), "s", {"a": 1})
    tables.write_bundle(df, spec, str(tmp_path / "b"))
    back, same = tables.read_bundle(spark, str(tmp_path / "b"))
    assert same == spec and values(back) == [(1, "a")]


def test_declared_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("y;age;pdays;duration;nr.employed;job\nno;30;999;0;5191.0;admin\nyes;41;3;10;5228.1;tech\n")
    roles = {"age": "numerical", "pdays": "mixed", "duration": "mixed", "nr.employed": "numerical", "job": "categorical", "y": "categorical"}
    small = tables.Dataset(sep=";", roles=roles, label="y", label_map={"no": 0, "yes": 1}, missing={"pdays": (999,)}, log1p=("duration",), divide={"nr.employed": 10.0}, round_to={"nr.employed": 0})
    rows = values(small.load(spark, str(tmp_path / "a.csv"), None))
    assert rows[0] == (30.0, None, 0.0, 519.0, "admin", 0) and rows[1][2] == pytest.approx(math.log(11)) and rows[1][3] == 523.0
    assert {n: len(d.roles) for n, d in tables.DATASETS.items()} == {"adult": 14, "loan": 21, "credit": 31, "breast": 40}


def test_stream(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 2).alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = noisy_windows(stream, "ts", ["kind"], 1.0, P.Noise("keyed", 1))
    out.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").filter("cnt = 3").count() > 10


def test_levels_of_the_gan_follow_the_rows(spark):
    layout = G.Layout((("tanh", 1), ("softmax", 2)))
    gan = G.FederatedGan(layout, mu=5.0, clients=2, steps=1)
    rows = spark.range(1000).select((F.col("id") % 2).cast("int").alias("client_id"), F.array(F.lit(0.0), (F.col("id") % 10 == 0).cast("double"), (F.col("id") % 10 != 0).cast("double")).alias("row"))
    gan.learn_levels(rows, 5.0)
    assert gan.levels[0] == pytest.approx([0.1, 0.9], abs=0.01)
    assert gan.conditions(4000).mean(0) == pytest.approx([0.1, 0.9], abs=0.03)
    sums = gan.client_sums(rows.unionByName(rows.filter("client_id < 0")))  # with tasks that have no rows
    assert {c: n for c, (n, _) in sums.items()} == {0: 500, 1: 500}


def test_the_gan_trains_on_all_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G.FederatedGan, "fit", lambda self, rows, batch: seen.append(rows.count()))
    d = "/root/testdata/sf0.001"
    q_models.gan_train(spark, d)
    assert seen == [spark.read.parquet(f"{d}/lineitem.parquet").count()]


def small_table(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), ["u", "v", None][int(rng.integers(0, 3))], None if i % 50 == 0 else float(np.round(rng.normal(40, 9), 1)), float(max(0.0, np.round(rng.normal(0, 5), 1))), int(rng.integers(2, 6)), "y" if i % 4 == 0 else "x") for i in range(n)]
    spec = TableSpec((ColumnSpec("cat", "categorical", levels=("u", "v"), may_be_missing=True), ColumnSpec("num", "numerical", 1, 0.0, 100.0, may_be_missing=True), ColumnSpec("mix", "mixed", 1, 0.0, 50.0), ColumnSpec("ord", "ordinal", low=2, high=5), ColumnSpec("y", "categorical", levels=("x", "y"))), label="y")
    return spark.createDataFrame(rows, "id long, client_id int, cat string, num double, mix double, ord int, y string"), spec


def test_tables_through_the_encoder_and_the_gan(spark):
    df, spec = small_table(spark)
    ledger = P.Ledger(3.0)
    encoder = GT.TableEncoder.learned(df, spec, ledger, 2.0, P.Noise("keyed", 1), most=2)
    assert ledger.spent == pytest.approx(2.0) and len(ledger.steps) == 2
    rows = encoder.encoded(df, 1, ["id"], ["id"]).cache()
    assert {len(r["row"]) for r in rows.collect()} == {encoder.layout.width}
    back = {r["id"]: r for r in encoder.decoded(rows, ["id"]).collect()}
    for r in df.collect():
        b = back[r["id"]]
        assert (b["cat"], b["ord"], b["y"]) == (r["cat"], r["ord"], r["y"]) and (b["num"] is None) == (r["num"] is None)
        assert r["num"] is None or abs(r["num"] - b["num"]) < 8 and abs(r["mix"] - b["mix"]) < 8 and (r["mix"] != 0 or b["mix"] == 0)
    real = np.stack([r["row"] for r in rows.collect()])
    conditions = GT.own_conditions(real, encoder.layout, np.random.default_rng(1))
    assert (conditions.sum(1) == 1).all()
    model = encoder.train(df, 2.0, 3, 2, 1, ["id"], hidden=8, loss="bce", mode_weight=1.0)
    made = encoder.synthetic(model, 40).collect()
    assert len(made) == 40 and {r["y"] for r in made} <= {"x", "y"} and all(2 <= r["ord"] <= 5 and r["mix"] >= 0 for r in made)


def test_losses_are_derivatives():
    s = np.linspace(-3, 3, 7)[:, None]
    for loss in ("wasserstein", "bce"):
        by_hand = [(G.value_of(np.array([[x + 1e-5]]), loss) - G.value_of(np.array([[x - 1e-5]]), loss)) / 2e-5 for x in s[:, 0]]
        assert np.allclose(G.pull(s, True, loss)[:, 0], by_hand, atol=1e-4) and (G.pull(s, False, loss) > 0).all()


def test_warm_up_meets_the_levels():
    layout = G.Layout((("softmax", 3),))
    model = G.FederatedGan(layout, 1.0, 2, 1, hidden=16, rate=0.5, seed=3)
    model.levels = [np.array([0.7, 0.2, 0.1])]
    losses = [model.generator_step(128, warm_up=True) for _ in range(150)]
    assert np.mean(losses[-20:]) < np.mean(losses[:20])


def test_plans_with_merged_levels_charge_all_they_release(spark):
    df, spec = small_table(spark)
    bins = {c.name: D.bins_of(c) for c in spec.columns}
    domain = pgm.Domain({n: len(b) for n, b in bins.items()})
    coded = D.coded(df, spec, bins, ["client_id"])
    for plan, fit in models.FITS.items():
        got = fit(coded, domain, models.Settings(mu=1.5, iterations=100), P.Noise("keyed", 2), bins=bins)
        assert got[1].spent == pytest.approx(1.5) and got[1].steps[0][0] == "levels", plan
        assert got[0].total == pytest.approx(600, rel=0.2)
    answers = models.Answers(coded, domain, [(a,) for a in domain.attrs])
    found, groups = models.merged_levels(answers, bins, 0.5, 0.5, np.random.default_rng(1))
    assert groups and all(m.groups or len(m.y) == domain[m.clique[0]] for m in found) and all(len(g) == domain[n] for n, g in groups.items())
    sizes = answers.client_sizes()
    assert set(sizes) == {0, 1, 2} and all(abs(v - 200) < 60 for v in sizes.values())


def test_the_iterative_plan_spends_what_is_left(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("int").alias("client_id"), (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"))
    _, ledger, chosen = models.fit_iterative(df, pgm.Domain({"a": 2, "b": 4}), models.Settings(mu=3.0, iterations=100), P.Noise("keyed", 1), rounds=6)
    assert ledger.spent == pytest.approx(3.0) and set(chosen) == {("a", "b")} and len(chosen) > 1  # the only set there is, again
    wide = df.withColumn("b", (F.col("b") * 10).cast("int"))  # too many cells for the noise of a first round
    domain, s = pgm.Domain({"a": 2, "b": 40}), models.Settings(mu=1.5, iterations=100)
    assert not X.candidates(domain, [("a", "b")], [], 600, math.sqrt(0.8 * 0.8 / 20) * 1.5, 1.0, 3, s.max_mb)
    _, ledger, chosen = models.fit_iterative(wide, domain, s, P.Noise("keyed", 1))
    assert ledger.spent == pytest.approx(1.5) and chosen
    _, ledger, chosen = models.fit_iterative(df.drop("b"), pgm.Domain({"a": 2}), s, P.Noise("keyed", 1))
    assert chosen == [] and [name for name, _ in ledger.steps] == ["one-way"]  # no set of two columns


def test_rows_without_a_level_are_reported(spark):
    df, spec = small_table(spark, 60)
    bins = {c.name: D.bins_of(c) for c in spec.columns}
    coded = D.coded(df.withColumn("y", F.lit("neither")), spec, bins, ["client_id"])
    with pytest.raises(ValueError, match="'y': 60"):
        models.fit_independent(coded, pgm.Domain({n: len(b) for n, b in bins.items()}), models.Settings(), P.Noise("keyed", 2))


def test_stored_models_and_releases(spark):
    df, spec = small_table(spark, 120)
    bins = {c.name: D.bins_of(c) for c in spec.columns}
    domain = pgm.Domain({n: len(b) for n, b in bins.items()})
    model, ledger, _ = models.fit_tree(D.coded(df, spec, bins, ["client_id"]), domain, models.Settings(iterations=50), P.Noise("keyed", 2))
    stored = {(c, ps): t for c, ps, t in models.read_model(models.model_table(spark, model), domain)}
    assert all(np.allclose(stored[c, ps], t) for c, ps, t in model.conditionals())
    assert [r["mu"] for r in models.ledger_table(spark, ledger).orderBy("step").collect()] == [m for _, m in ledger.steps]
    sets = [("a", "b"), ("a", "c"), ("b", "c")] + [("a", "b", "c")] * 9
    some = models.checked_sets(sets, 6, np.random.default_rng(1))
    assert len(some) == 6 and sum(len(c) == 2 for c in some) == 3


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(0, 5, 700), 1), np.zeros(300)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [i / 13 for i in range(14)]
    assert np.allclose(D.exact_percentiles(df, "x", shares), np.quantile(x, shares))
    assert D.exact_percentiles(df.limit(0), "x", shares) == []


def test_a_small_grid(spark):
    df, spec = small_table(spark)
    df = df.fillna(1.0, ["num"]).drop("client_id")
    bins = {c.name: D.bins_of(c) for c in spec.columns}
    got = evaluation.run_grid(df, ["id"], spec, bins, ["num", "mix"], ["heterogeneous_equalsize"], [2.0], 2, ["local"], P.Noise("keyed", 4), keep=lambda rep: rep < 1, iterations=50).toPandas()
    assert set(got["model"]) == {"training rows", "local"} and set(got["rep"]) == {0}
    errors = got[got["metric"] == "marginal error 1"].set_index("model")["value"]
    assert errors.between(0, 1).all() and got["value"].notna().any()
    assert len(evaluation.marginal_sample("abcd", 2, 3, 1)) == 3 and len(evaluation.marginal_sample("abc", 3, 9, 1)) == 1

"""Queries: models, synthetic rows, evaluation, the GAN's encodings and training, streaming."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import duck_uniform
from ..operators import evaluate as E
from ..operators import gan as G
from ..operators import gan_table as GT
from ..operators import marginals as M
from ..operators import privacy as P
from ..operators import synth
from ..shared import shared_folder
from ..sources import tables as T
from ..spec import ColumnSpec
from ..streaming import counts as stream_counts
from . import evaluation, models
from .common import BINS, CODED, DOMAIN, KEYS, LINEITEM, NAMES, coded_lineitem, doubles, lineitem, r6, table

NOISE = P.Noise("keyed", 3)
FAST = models.Settings(mu=2.0, iterations=300, degree=2)
DRAWN = 2000


def pgm_independent(spark, d):
    model, _ = models.fit_independent(coded_lineitem(spark, d), DOMAIN, FAST, NOISE)
    return models.model_table(spark, model)


def pgm_tree_fit(spark, d):
    model, _, _ = models.fit_tree(coded_lineitem(spark, d), DOMAIN, FAST, NOISE)
    return models.model_table(spark, model)


def pgm_iterative_fit(spark, d):
    _, ledger, chosen = models.fit_iterative(coded_lineitem(spark, d), DOMAIN, FAST, NOISE, rounds=6)
    return spark.createDataFrame([("|".join(c), float(m)) for c, (_, m) in zip(chosen, ledger.steps[1:], strict=True)], "clique string, mu double")


def synth_independent(spark, d):
    """Rows drawn from the exact one-way shares of flag and disc, by keyed hash."""
    coded = coded_lineitem(spark, d)
    tables = []
    for name in ("flag", "disc"):
        counts = {r[name]: r["cnt"] for r in M.marginal(coded, [name]).collect()}
        p = np.array([counts.get(i, 0) for i in range(DOMAIN[name])], dtype=float)
        tables.append((name, (), p / p.sum()))
    return synth.sampled(spark, DRAWN, tables, 9)


def synth_tree(spark, d):
    model, _, _ = models.fit_tree(coded_lineitem(spark, d), DOMAIN, FAST, NOISE)
    return synth.decoded_rows(synth.sampled(spark, DRAWN, model.conditionals(), 9), LINEITEM, BINS, 9)


def marginal_error_1(spark, d):
    c = coded_lineitem(spark, d)
    return E.marginal_error(c.filter("client_id = 0"), c.filter("client_id <> 0"), NAMES, 1).select("k", r6(F.col("error")).alias("error"))


def marginal_error_2(spark, d):
    c = coded_lineitem(spark, d)
    return E.marginal_errors(c.filter("client_id = 0"), c.filter("client_id <> 0"), NAMES, 2).select("clique", r6(F.col("error")).alias("error"))


def _probabilities(spark, d):
    df = table(spark, d, "lineitem")
    return df.select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") * 8 + 0.1).alias("p"))


def metrics_kernel(spark, d):
    got = E.binary_metrics(_probabilities(spark, d), "y", "p")
    return got.select(*[r6(F.col(c)).alias(c) for c in got.columns])


def cramers_v(spark, d):
    return E.cramers_v(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(r6(F.col("v")).alias("v"))


def association_matrix(spark, d):
    got = E.associations(coded_lineitem(spark, d), M.powerset(["flag", "status", "disc", "tax"], 2, 2))
    return got.select("a", "b", r6(F.col("v")).alias("v"))


def association_mixed(spark, d):
    """Order priority (a category) with total price (a number)."""
    return E.correlation_ratio(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select(r6(F.col("v")).alias("v"))


def histogram(spark, d):
    got = E.histogram(table(spark, d, "events"), "value", 0.0, 20.0, ["event_type"])
    return got.select("event_type", "bucket", "cnt", F.round("density", 9).alias("density"))


def results_by_mu(spark, d):
    runs = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("mu"), F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    got = E.by_budget(runs)
    return got.select("mu", *[r6(F.col(c)).alias(c) for c in got.columns if c != "mu"])


def _features(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_linestatus") == "O").cast("int").alias("y"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _discriminator(model):
    def query(spark, d):
        # 20 trees here, where the operator's default is 500: the query shows the measure, at a tenth of its time and less.
        df = _features(spark, d)
        return E.discriminator(df.filter("l_orderkey % 2 = 0"), df.filter("l_orderkey % 2 = 1").withColumn("l_quantity", F.col("l_quantity") + 10), FEATURES, model, trees=20)

    return query


def _utility(model):
    def query(spark, d):
        # As above; the operator's default is 250 trees.
        df = _features(spark, d)
        return E.utility(df.filter("l_orderkey % 4 <> 0"), df.filter("l_orderkey % 4 = 0"), FEATURES, "y", model, trees=20)

    return query


# Modes given, so that the encoding can be checked in SQL.
MODES = G.Modes((0.3, 0.5, 0.2), (10.0, 60.0, 200.0), (5.0, 30.0, 80.0), (0.01,))


def gan_encode(spark, d):
    scalar, slot = G.encoded(F.col("value"), MODES, 21, "event_id")
    return table(spark, d, "events").select("event_id", F.round(scalar, 9).alias("scalar"), slot.cast("int").alias("slot"))


def gan_decode(spark, d):
    scalar, slot = G.encoded(F.col("value"), MODES, 21, "event_id")
    df = table(spark, d, "events").select("event_id", scalar.alias("s"), slot.alias("k"))
    return df.select("event_id", F.round(G.decoded(F.col("s"), F.col("k"), MODES), 4).alias("value"))


def gan_modes(spark, d):
    """Modes of rows drawn from a private one-way marginal of value, between public bounds."""
    column = ColumnSpec("value", "numerical", low=0.0, high=500.0, decimals=2)
    modes = G.private_modes(table(spark, d, "events"), column, P.Ledger(1.0), 0.5, NOISE, 3)
    return spark.createDataFrame([tuple(map(float, t)) for t in zip(modes.weights, modes.means, modes.stds, strict=True)], "weight double, mean double, std double")


def gan_train(spark, d):
    """A few rounds over the clients' encoded rows, then synthetic rows decoded."""
    rows = table(spark, d, "lineitem")
    modes = G.Modes((1.0,), (25.0,), (15.0,))
    scalar, _ = G.encoded(F.col("l_quantity"), modes, 1, *KEYS)
    flags = [(F.col("l_returnflag") == v).cast("double") for v in ("A", "N", "R")]
    encoded = rows.select((F.col("l_suppkey") % 5).cast("int").alias("client_id"), F.array(scalar, F.lit(1.0), *flags).alias("row")).persist()
    layout = G.Layout((("tanh", 1), ("softmax", 1), ("softmax", 3)))
    for_levels, for_training = P.split_budget(5.0, [0.25**0.5, 0.75**0.5])
    gan = G.FederatedGan(layout, mu=for_training, clients=5, steps=3, hidden=16, scaffold=True)
    gan.learn_levels(encoded, for_levels)
    gan.fit(encoded, 64)
    encoded.unpersist()
    made = gan.synthetic(spark.range(500))
    flag = F.array_position(F.slice("row", 3, 3), F.array_max(F.slice("row", 3, 3))) - 1
    return made.select("id", G.decoded(F.get("row", F.lit(0)), F.lit(0), modes, 0).alias("qty"), flag.cast("int").alias("flag"))


def _shared(spark) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


ENCODER = GT.TableEncoder(LINEITEM, {"qty": G.Modes((0.4, 0.6), (12.0, 35.0), (8.0, 9.0))})


def gan_table_encode(spark, d):
    """The vector of every line, as its scalar and the slot set in each block."""
    rows = ENCODER.encoded(lineitem(spark, d, *KEYS), 31, KEYS, KEYS)
    qty = 1 + ENCODER.slots(LINEITEM.columns[0]) + ENCODER.slots(LINEITEM.columns[1])
    hot = lambda at, n: (F.array_position(F.slice("row", at, n), 1.0) - 1).cast("int")
    return rows.select(*KEYS, F.round(F.get("row", F.lit(qty - 1)), 9).alias("scalar"), hot(qty + 1, 2).alias("qty_slot"), hot(1, 3).alias("flag_slot"), hot(4, 2).alias("status_slot"), hot(qty + 3, 11).alias("disc_slot"), F.size("row").alias("width"))


def gan_table_decode(spark, d):
    """Lines from their vectors: what wasn't clipped comes back."""
    return ENCODER.decoded(ENCODER.encoded(lineitem(spark, d, *KEYS), 31, KEYS, KEYS), KEYS).select(*KEYS, "flag", "status", F.round("qty", 4).alias("qty"), "disc", "tax", "line")


def baseline_error(spark, d):
    """The training baseline: the marginal error of client 0's rows as test rows and all others' as the synthetic ones."""
    rows = lineitem(spark, d)
    train, test = rows.filter("client_id <> 0"), rows.filter("client_id = 0")
    a, b = (evaluation.in_space(x, LINEITEM, BINS, False, True, 0) for x in (test, train))
    return E.marginal_error(a, b, NAMES, 1).select("k", r6(F.col("error")).alias("error"))


def brier_skill(spark, d):
    """1 + 4 (-Brier) of the probabilities by return flag."""
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") * 8 + 0.1).alias("p"))
    got = E.binary_metrics(rows, "y", "p", ["l_returnflag"])
    return got.select("l_returnflag", r6(1 + 4 * (-F.col("brier"))).alias("skill"))


def csv_round_trip(spark, d):
    """orders written as ';' CSV to the shared folder and read back by name."""
    path = f"{_shared(spark)}/orders-csv"
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return T.read_csv(spark, path, ["o_orderpriority", "o_orderkey", "o_totalprice"], ";").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", "o_orderpriority")


def streaming_counts(spark, d):
    """Hourly counts of events by type, by Structured Streaming over the table as a stream, run until it has been read."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    name = "margrave_windows"
    out = stream_counts.windowed_counts(stream, "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "cnt")
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _shared(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (pgm_independent, pgm_tree_fit, pgm_iterative_fit, synth_independent, synth_tree, marginal_error_1, marginal_error_2, metrics_kernel, cramers_v, association_matrix, association_mixed, histogram, results_by_mu)}
QUERIES |= {f"discriminator_{k}": _discriminator(m) for k, m in (("lr", "logistic"), ("rf", "forest"))} | {f"utility_{k}": _utility(m) for k, m in (("lr", "logistic"), ("rf", "forest"))}
QUERIES |= {f.__name__: f for f in (gan_encode, gan_decode, gan_modes, gan_train, gan_table_encode, gan_table_decode, baseline_error, brier_skill, csv_round_trip, streaming_counts)}


def _cell_tables(cliques) -> str:
    return " UNION ALL ".join(f"SELECT '{'|'.join(c)}' AS clique, concat_ws('|', {', '.join(c)}) AS cell, count(*) FILTER (WHERE client_id = 0) AS t, count(*) FILTER (WHERE client_id <> 0) AS s FROM coded GROUP BY 2" for c in cliques)


def _errors(k: int) -> str:
    return f"{CODED}, m AS ({_cell_tables(M.powerset(NAMES, k, k))}), z AS (SELECT clique, sum(t) AS nt, sum(s) AS ns FROM m GROUP BY 1), e AS (SELECT m.clique, sum(abs(t - nt / ns::DOUBLE * s)) / (2.0::DOUBLE * max(nt)) AS error FROM m JOIN z USING (clique) GROUP BY 1)"


def _v(source: str, a: str, b: str) -> str:
    return f"SELECT sqrt((sum(n * n * tot / (na * nb)) - any_value(tot)) / (any_value(tot) * least(count(DISTINCT {a}) - 1, count(DISTINCT {b}) - 1))) FROM (SELECT *, sum(n) OVER (PARTITION BY {a})::DOUBLE AS na, sum(n) OVER (PARTITION BY {b})::DOUBLE AS nb, sum(n) OVER ()::DOUBLE AS tot FROM (SELECT {a}, {b}, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2))"


def _cumulative(name: str) -> str:
    return f"{name}_c AS (SELECT list(c ORDER BY v) AS c FROM (SELECT v, sum(n) OVER (ORDER BY v) / (SELECT count(*) FROM coded)::DOUBLE AS c FROM (SELECT v, count({name}) AS n FROM range({DOMAIN[name]}) r(v) LEFT JOIN coded ON {name} = v GROUP BY v)) WHERE v < {DOMAIN[name] - 1})"


_DENSITY = [f"({w / s!r}::DOUBLE * exp(-0.5::DOUBLE * ((value - {m!r}) / {s!r}) * ((value - {m!r}) / {s!r})) + 1e-300)" for w, m, s in zip(MODES.weights, MODES.means, MODES.stds, strict=True)]
_U = duck_uniform(21, "event_id")
_SLOTS = f"""e AS (SELECT event_id, value, {_DENSITY[0]} AS d0, {_DENSITY[1]} AS d1, {_DENSITY[2]} AS d2, {_U} AS u FROM events),
k AS (SELECT *, CASE WHEN value = 0.01 THEN 3 ELSE (CASE WHEN u * (d0 + d1 + d2) > d0 THEN 1 ELSE 0 END + CASE WHEN u * (d0 + d1 + d2) > d0 + d1 THEN 1 ELSE 0 END) END AS slot FROM e),
z AS (SELECT event_id, value, slot, CASE WHEN slot = 3 THEN 0.0::DOUBLE ELSE least(greatest((value - {doubles(MODES.means)}[slot + 1]) / (4.0 * {doubles(MODES.stds)}[slot + 1]), -0.99), 0.99) END AS s FROM k)"""
_TABLE_U = duck_uniform("31|qty", *KEYS)
_QTY_DENSITY = [f"({w / s!r}::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - {m!r}) / {s!r}) * ((l_quantity - {m!r}) / {s!r})) + 1e-300)" for w, m, s in zip((0.4, 0.6), (12.0, 35.0), (8.0, 9.0), strict=True)]
_TABLE_SLOTS = f"z AS (SELECT *, CAST(CASE WHEN {_TABLE_U} * ({_QTY_DENSITY[0]} + {_QTY_DENSITY[1]}) > {_QTY_DENSITY[0]} THEN 1 ELSE 0 END AS INTEGER) AS qty_slot FROM coded)"
ORACLES = {
    "synth_independent": f"WITH {CODED}, {_cumulative('flag')}, {_cumulative('disc')} SELECT id, CAST(len(list_filter(flag_c.c, lambda x: x <= {duck_uniform('9|flag', 'id')})) AS INTEGER) AS flag, CAST(len(list_filter(disc_c.c, lambda x: x <= {duck_uniform('9|disc', 'id')})) AS INTEGER) AS disc FROM range({DRAWN}) t(id), flag_c, disc_c",
    "marginal_error_1": f"WITH {_errors(1)} SELECT 1 AS k, round(avg(error), 6) AS error FROM e",
    "marginal_error_2": f"WITH {_errors(2)} SELECT clique, round(error, 6) AS error FROM e",
    "metrics_kernel": """WITH x AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, l_discount * 8 + 0.1::DOUBLE AS p FROM lineitem),
r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM x),
a AS (SELECT sum(y)::DOUBLE AS np, sum(1 - y)::DOUBLE AS nn, count(*) FILTER (WHERE p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0)::DOUBLE AS fp,
      avg((y - p) * (y - p)) AS brier, sum(CASE WHEN y = 1 THEN rk END) AS sr FROM r)
SELECT round((tp + nn - fp) / (np + nn), 6) AS accuracy, round(brier, 6) AS brier, round(1 - brier / ((np / (np + nn)) * (nn / (np + nn))), 6) AS skill, round(2 * tp / (tp + fp + np), 6) AS f1,
       round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall, round((sr - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM a""",
    "cramers_v": f"SELECT round(({_v('orders', 'o_orderstatus', 'o_orderpriority')}), 6) AS v",
    "association_matrix": f"WITH {CODED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(({_v('coded', a, b)}), 6) AS v" for a, b in M.powerset(["flag", "status", "disc", "tax"], 2, 2)),
    "association_mixed": "WITH g AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mm FROM g), b AS (SELECT sum(n * (m - mm) * (m - mm)) AS b, sum(n * v) AS w FROM g, t) SELECT round(sqrt(b / (b + w)), 6) AS v FROM b",
    "histogram": "SELECT event_type, CAST(floor(value / 20.0) AS BIGINT) AS bucket, count(*) AS cnt, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 20.0::DOUBLE), 9) AS density FROM events GROUP BY 1, 2",
    "results_by_mu": "WITH r AS (SELECT CAST(user_id % 4 AS INTEGER) AS mu, CASE WHEN value >= 1 THEN value END AS value FROM events) SELECT mu, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_pop(value) / sqrt(count(value)), 6) AS std_error FROM r GROUP BY 1",
    "gan_encode": f"WITH {_SLOTS} SELECT event_id, round(s, 9) AS scalar, CAST(slot AS INTEGER) AS slot FROM z",
    "gan_decode": f"WITH {_SLOTS} SELECT event_id, round(CASE WHEN slot = 3 THEN 0.01 ELSE s * 4.0::DOUBLE * {doubles(MODES.stds)}[slot + 1] + {doubles(MODES.means)}[slot + 1] END, 4) AS value FROM z",
    "gan_table_encode": f"""WITH {CODED.replace("AS qty,", "AS qty, l_quantity,")}, {_TABLE_SLOTS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((l_quantity - [12.0, 35.0][qty_slot + 1]) / (4.0 * [8.0, 9.0][qty_slot + 1]), -0.99), 0.99), 9) AS scalar, qty_slot, flag AS flag_slot, status AS status_slot, disc AS disc_slot, CAST(35 AS INTEGER) AS width FROM z""",
    "gan_table_decode": f"""WITH {CODED.replace("AS qty,", "AS qty, l_quantity,")}, {_TABLE_SLOTS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE flag WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS flag, CASE status WHEN 0 THEN 'F' ELSE 'O' END AS status,
       round(round_even(least(greatest((l_quantity - [12.0, 35.0][qty_slot + 1]) / (4.0 * [8.0, 9.0][qty_slot + 1]), -0.99), 0.99) * 4.0 * [8.0, 9.0][qty_slot + 1] + [12.0, 35.0][qty_slot + 1], 0), 4) AS qty, disc, tax, line FROM z""",
    "baseline_error": f"WITH {_errors(1)} SELECT 1 AS k, round(avg(error), 6) AS error FROM e",
    "brier_skill": "SELECT l_returnflag, round(1 + 4 * (-avg((y - p) * (y - p))), 6) AS skill FROM (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, l_discount * 8 + 0.1::DOUBLE AS p FROM lineitem) GROUP BY 1",
    "csv_round_trip": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
    "streaming_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS cnt FROM events GROUP BY 1, 2",
}

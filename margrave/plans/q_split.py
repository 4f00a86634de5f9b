"""Queries: samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import duck_order
from ..operators import split
from .common import table

SEED, SAMPLE, REPS = 1234, 400, 2
DIFF, EQUAL = split.SETTINGS["homogeneous_diffsize"][0], split.SETTINGS["heterogeneous_equalsize"]


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def sample_n(spark, d):
    return split.sample_n(_orders(spark, d), SAMPLE, SEED, ["o_orderkey"]).select("o_orderkey")


def split_iid(spark, d):
    return split.split_iid(_orders(spark, d), DIFF, SEED, ["o_orderkey"]).select("o_orderkey", "client_id")


def split_label_skew(spark, d):
    return split.split_label_skew(_orders(spark, d), "y", *EQUAL, SEED, ["o_orderkey"]).select("o_orderkey", "y", "client_id")


def train_test(spark, d):
    dealt = split.split_iid(_orders(spark, d), DIFF, SEED, ["o_orderkey"])
    return split.train_test(dealt, 0.75, SEED, ["o_orderkey"]).select("o_orderkey", "client_id", "split")


def kfold(spark, d):
    return split.stratified_folds(_orders(spark, d), "o_orderstatus", 3, SEED, ["o_orderkey"]).select("o_orderkey", "fold")


def client_sizes(spark, d):
    return split.split_iid(_orders(spark, d), DIFF, SEED, ["o_orderkey"]).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


def repeated_splits(spark, d):
    out = split.repeated_splits(_orders(spark, d), "homogeneous_equalsize", REPS, 7, ["o_orderkey"])
    return out.groupBy("rep", "client_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ck"))


def _cuts(fractions, n, how):
    sums, total = [], 0.0
    for f in fractions[:-1]:
        total += f
        sums.append(how.format(f"{total!r}::DOUBLE * {n}"))
    return sums


def _client(rank, cuts):
    return "CAST(" + " + ".join(f"CASE WHEN {rank} > {c} THEN 1 ELSE 0 END" for c in cuts) + " AS INTEGER)"


def _iid(fractions, seed):
    return f"SELECT *, {_client('rn', _cuts(fractions, 'n', 'round_even({}, 0)'))} AS client_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {duck_order(seed, 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM orders)"


def _train(source, seed):
    return f"SELECT o_orderkey, client_id, CASE WHEN rk <= round_even(0.75 * nc, 0) THEN 'train' ELSE 'test' END AS split FROM (SELECT o_orderkey, client_id, row_number() OVER (PARTITION BY client_id ORDER BY {duck_order(seed, 'o_orderkey')}) AS rk, count(*) OVER (PARTITION BY client_id) AS nc FROM ({source}))"


_W = [w / sum(EQUAL[1]) for w in EQUAL[1]]
_ONES, _SIZES = _cuts(_W, "n1", "floor({} + 1e-9)"), _cuts(EQUAL[0], "n", "floor({} + 1e-9)")
QUERIES = {f.__name__: f for f in (sample_n, split_iid, split_label_skew, train_test, kfold, client_sizes, repeated_splits)}
ORACLES = {
    "sample_n": f"SELECT o_orderkey FROM orders ORDER BY {duck_order(SEED, 'o_orderkey')} LIMIT {SAMPLE}",
    "split_iid": f"SELECT o_orderkey, client_id FROM ({_iid(DIFF, SEED)})",
    "split_label_skew": f"""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {duck_order(SEED, 'o_orderkey')}) AS rn, count(*) OVER () AS n, sum(y) OVER () AS n1 FROM h)
SELECT o_orderkey, y, CASE WHEN y = 1 THEN {_client('rn', _ONES)} ELSE {_client('rn', [f'({s} - {o})' for s, o in zip(_SIZES, _ONES, strict=True)])} END AS client_id FROM r""",
    "train_test": _train(_iid(DIFF, SEED), SEED),
    "kfold": f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {duck_order(SEED, 'o_orderkey')}) - 1) % 3 AS INTEGER) AS fold FROM orders",
    "client_sizes": f"SELECT client_id, count(*) AS n FROM ({_iid(DIFF, SEED)}) GROUP BY 1",
    "repeated_splits": "SELECT rep, client_id, split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ck FROM (" + " UNION ALL ".join(f"SELECT {r} AS rep, * FROM ({_train(_iid([0.2] * 5, 7000 + r), 7000 + r)})" for r in range(REPS)) + ") GROUP BY 1, 2, 3",
}

"""Queries: metadata, projections, filters, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate
from .common import r6, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]


def col_minmax(spark, d):
    aggs = [(f(c) + 0.0).alias(f"{f.__name__}_{c}") for c in NUMBERS for f in (F.min, F.max)]  # no negative zero
    row = table(spark, d, "lineitem").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi")) for c in NUMBERS])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def distinct_levels(spark, d):
    df = table(spark, d, "lineitem")
    sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in TEXTS])  # declared categorical: few levels
    out = None
    for c in TEXTS:
        one = sets.select(F.lit(c).alias("attr"), F.posexplode(c).alias("level_id", "level"))
        out = one if out is None else out.unionByName(one)
    return out


def remap_nulls(spark, d):
    x = S.remap(F.col("p_size"), {50: None, 49: None, 1: 0})
    return table(spark, d, "part").select("p_partkey", x.cast("double").alias("p_size"))


def log1p_round(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.rounded(S.log1p(F.col("o_totalprice")), 6).alias("v"))


def symlog(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(S.symmetric_log(F.col("c_acctbal"))).alias("v"))


def divide_round(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.rounded(F.col("o_totalprice") / 10.0, 0).alias("v"))


def shift_ordinal(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


def label_map(spark, d):
    y = S.remap(F.col("o_orderstatus"), {"F": 1, "O": 0, "P": 0}, keep_others=False)
    return table(spark, d, "orders").select("o_orderkey", y.cast("int").alias("y"))


def label_map_majority(spark, d):
    df = table(spark, d, "lineitem")
    top = df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("l_linestatus", F.struct("n", "l_linestatus")).alias("top"))
    y = (F.col("l_linestatus") != F.col("top")).cast("int").alias("y")
    return df.crossJoin(F.broadcast(top)).groupBy("l_linestatus", y).agg(F.count(F.lit(1)).alias("cnt"))  # top is one row


def one_hot_drop_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *evaluate.one_hot(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"]))


def union_tagged(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    both = o.filter("o_orderkey % 2 = 0").withColumn("real", F.lit(1)).unionByName(o.filter("o_orderkey % 2 = 1").withColumn("real", F.lit(0)))
    return both.groupBy("real", "o_orderstatus").agg(F.count(F.lit(1)).alias("cnt"))


def union_split_back(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    both = o.filter("o_orderkey % 3 = 0").withColumn("temp", F.lit("train")).unionByName(o.filter("o_orderkey % 3 <> 0").withColumn("temp", F.lit("test")))
    return both.filter("temp = 'train'").drop("temp")


def level_union(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderkey % 2 = 0").select("o_orderpriority").union(o.filter("o_orderkey % 2 = 1").select("o_orderpriority")).distinct()


def missing_stand_in(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", S.with_stand_in(F.col("quality"), "number").alias("quality"), S.with_stand_in(F.when(F.col("quality").isNotNull(), F.col("lang")), "text").alias("lang"))


def missing_round_trip(spark, d):
    x = S.with_stand_in(F.col("quality"), "number")
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", S.without_stand_in(x, "number").alias("quality"))


def nan_predicate(spark, d):
    x = F.when(F.col("value") > 100, F.lit(float("nan"))).when(F.col("value") > 50, F.lit(None)).otherwise(F.col("value"))
    return table(spark, d, "events").select(S.is_missing(x).alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("cnt"))


def _least(df):
    return df.agg(F.min("c_acctbal").alias("m")).first()["m"]


def log_transform(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", r6(S.shifted_log(F.col("c_acctbal"), _least(df))).alias("v"))


def log_round_trip(spark, d):
    df = table(spark, d, "customer")
    least = _least(df)
    return df.select("c_custkey", F.round(S.unshifted_log(S.shifted_log(F.col("c_acctbal"), least), least), 4).alias("v"))


def label_encode(spark, d):
    return S.level_codes(table(spark, d, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


def label_decode(spark, d):
    df = table(spark, d, "customer")
    return label_encode(spark, d).join(S.levels(df, "c_mktsegment", "code"), "code").select("c_custkey", F.col("c_mktsegment").alias("segment"))


def cast_back(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").cast("double").cast("int").alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("cnt"))


def y_filter(spark, d):
    y = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, d, "orders").withColumn("y", y).filter("y = 1").agg(F.count(F.lit(1)).alias("n1"), F.sum("o_orderkey").alias("ck"))


def range_filter(spark, d):
    x = F.col("l_quantity")
    return table(spark, d, "lineitem").filter((x >= 10) & (x < 20)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("cnt"))


def zero_filter(spark, d):
    return table(spark, d, "customer").filter(F.greatest("c_acctbal", F.lit(0.0)) == 0.0).agg(F.count(F.lit(1)).alias("cnt"))


def modal_exclusion(spark, d):
    df = table(spark, d, "events")
    modal = df.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(3).select("value")
    return df.join(F.broadcast(modal), "value", "left_anti").agg(F.count(F.lit(1)).alias("cnt"), r6(F.avg("value")).alias("mean"))


def mean_y(spark, d):
    return table(spark, d, "labels").agg(r6(F.avg("toxic")).alias("mean_y"))


def value_counts_extremes(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("event_type", F.struct("n", "event_type")).alias("most"), F.min_by("event_type", F.struct("n", "event_type")).alias("least"))


def levels_with_rank(spark, d):
    df = table(spark, d, "part").select("p_size").distinct()
    return df.agg(F.array_sort(F.collect_list("p_size")).alias("l")).select(F.posexplode("l").alias("code", "p_size"))


QUERIES = {f.__name__: f for f in (
    col_minmax, distinct_levels, remap_nulls, log1p_round, symlog, divide_round, shift_ordinal, label_map, label_map_majority, one_hot_drop_first, union_tagged, union_split_back, level_union,
    missing_stand_in, missing_round_trip, nan_predicate, log_transform, log_round_trip, label_encode, label_decode, cast_back, y_filter, range_filter, zero_filter, modal_exclusion, mean_y, value_counts_extremes, levels_with_rank,
)}
ORACLES = {
    "col_minmax": " UNION ALL ".join(f"SELECT '{c}' AS attr, min({c}) + 0.0::DOUBLE AS lo, max({c}) + 0.0::DOUBLE AS hi FROM lineitem" for c in NUMBERS),
    "distinct_levels": " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS level_id, {c} AS level FROM (SELECT DISTINCT {c} FROM lineitem)" for c in TEXTS),
    "remap_nulls": "SELECT p_partkey, CAST(CASE WHEN p_size IN (49, 50) THEN NULL WHEN p_size = 1 THEN 0 ELSE p_size END AS DOUBLE) AS p_size FROM part",
    "log1p_round": "SELECT o_orderkey, round_even(ln(1 + o_totalprice), 6) AS v FROM orders",
    "symlog": "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS v FROM customer",
    "divide_round": "SELECT o_orderkey, round_even(o_totalprice / 10.0::DOUBLE, 0) AS v FROM orders",
    "shift_ordinal": "SELECT CAST(l_linenumber - 1 AS INTEGER) AS line, count(*) AS cnt FROM lineitem GROUP BY 1",
    "label_map": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 END AS y FROM orders",
    "label_map_majority": "WITH t AS (SELECT l_linestatus AS top FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) SELECT l_linestatus, CASE WHEN l_linestatus <> top THEN 1 ELSE 0 END AS y, count(*) AS cnt FROM lineitem, t GROUP BY 1, 2",
    "one_hot_drop_first": "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders",
    "union_tagged": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS real, o_orderstatus, count(*) AS cnt FROM orders GROUP BY 1, 2",
    "union_split_back": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0",
    "level_union": "SELECT DISTINCT o_orderpriority FROM orders",
    "missing_stand_in": "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), -9999999.0) AS quality, CASE WHEN quality IS NULL OR lang IS NULL OR trim(lang) = '' THEN 'empty' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)",
    "missing_round_trip": "SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "nan_predicate": "SELECT value > 50 AS missing, count(*) AS cnt FROM events GROUP BY 1",
    "log_transform": "SELECT c_custkey, round(ln(c_acctbal - (SELECT min(c_acctbal) FROM customer) + 1), 6) AS v FROM customer",
    "log_round_trip": "SELECT c_custkey, round(c_acctbal, 4) AS v FROM customer",
    "label_encode": "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer",
    "label_decode": "SELECT c_custkey, c_mktsegment AS segment FROM customer",
    "cast_back": "SELECT CAST(l_quantity AS INTEGER) AS q, count(*) AS cnt FROM lineitem GROUP BY 1",
    "y_filter": "SELECT count(*) AS n1, CAST(sum(o_orderkey) AS BIGINT) AS ck FROM orders WHERE o_orderstatus = 'F'",
    "range_filter": "SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 GROUP BY 1",
    "zero_filter": "SELECT count(*) AS cnt FROM customer WHERE c_acctbal <= 0",
    "modal_exclusion": "WITH m AS (SELECT value FROM events GROUP BY value ORDER BY count(*) DESC, value LIMIT 3) SELECT count(*) AS cnt, round(avg(value), 6) AS mean FROM events WHERE value NOT IN (SELECT value FROM m)",
    "mean_y": "SELECT round(avg(toxic), 6) AS mean_y FROM labels",
    "value_counts_extremes": "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT event_type FROM c ORDER BY n DESC, event_type DESC LIMIT 1) AS most, (SELECT event_type FROM c ORDER BY n, event_type LIMIT 1) AS least",
    "levels_with_rank": "SELECT CAST(row_number() OVER (ORDER BY p_size) - 1 AS INTEGER) AS code, p_size FROM (SELECT DISTINCT p_size FROM part)",
}

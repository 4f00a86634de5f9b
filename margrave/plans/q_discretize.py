"""Queries: discretization and marginals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import duck_hash
from ..operators import discretize as D
from ..operators import marginals as M
from ..spec import ColumnSpec
from .common import BINS, CODED, DOMAIN, LINEITEM, NAMES, coded_lineitem, duck_digitize, inner_edges, lineitem, table

MIXED = ColumnSpec("balance", "mixed", low=0.0, high=10_000.0)
MIXED_BINS = D.bins_of(MIXED)
PRICE = ColumnSpec("price", "numerical", decimals=2, low=0.0, high=110_000.0)
PRICE_BINS, PRICE_COARSE = D.bins_of(PRICE), D.bins_of(PRICE, 2)
QUALITY = ColumnSpec("quality", "ordinal", low=0, high=1, may_be_missing=True)
#: Children of each coarse price bin: 8 bins hold 4 of the 32 each.
CHILDREN = {i: list(range(4 * i, 4 * i + 4)) for i in range(8)}
QTY_GROUPS = [list(range(0, 8)), list(range(8, 16)), list(range(16, 32))]
PAIRS = M.powerset(NAMES, 1, 3)


def bins_equal_width(spark, d):
    return table(spark, d, "lineitem").select(D.code(F.col("l_quantity"), BINS["qty"]).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))


def bins_mixed_zero(spark, d):
    x = F.greatest("c_acctbal", F.lit(0.0))
    return table(spark, d, "customer").select("c_custkey", D.code(x, MIXED_BINS).alias("bin"))


def bins_missing(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy(D.code(F.col("quality"), D.bins_of(QUALITY)).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def bins_ordinal(spark, d):
    return lineitem(spark, d).groupBy(D.code(F.col("line"), BINS["line"]).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def bins_dimension(spark, d):
    return D.bins_table(spark, {"balance": MIXED_BINS, **BINS}).select("attr", "bin_id", "kind", "label")


def domain_sizes(spark, d):
    return D.bins_table(spark, BINS).groupBy("attr").agg(F.count(F.lit(1)).alias("size"))


def encode_categorical(spark, d):
    return lineitem(spark, d).groupBy(D.code(F.col("flag"), BINS["flag"]).alias("code")).agg(F.count(F.lit(1)).alias("cnt"))


def encode_unseen(spark, d):
    """Rows of a level that the specification lacks have no code and are counted."""
    short = D.bins_of(ColumnSpec("flag", "categorical", levels=("A", "N")))
    return lineitem(spark, d).select(D.code(F.col("flag"), short).alias("c")).agg(F.count_if(F.col("c").isNull()).alias("unseen"))


def decode(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.code(F.col("l_extendedprice"), PRICE_BINS).alias("code"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", D.decoded(F.col("code"), PRICE, PRICE_BINS, 11, "l_orderkey", "l_linenumber", "l_partkey").alias("price"))


def quantile_bins(spark, d):
    df = table(spark, d, "customer")
    cuts = D.quantile_cuts(df, "c_acctbal", 8)
    return df.groupBy(D.quantile_code(F.col("c_acctbal"), cuts).alias("code")).agg(F.count(F.lit(1)).alias("cnt"))


def quantile_bins_mixed(spark, d):
    df = table(spark, d, "customer").select(F.greatest("c_acctbal", F.lit(0.0)).alias("x"))
    cuts = D.quantile_cuts(df, "x", 8, positive=True)
    return df.groupBy(D.quantile_code(F.col("x"), cuts).alias("code")).agg(F.count(F.lit(1)).alias("cnt"))


def rediscretize(spark, d):
    coarse = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.code(F.col("l_extendedprice"), PRICE_COARSE).alias("coarse"))
    return D.rediscretized(coarse, "coarse", CHILDREN, 5, ["l_orderkey", "l_linenumber", "l_partkey"], "fine").groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("cnt"))


def bin_containment(spark, d):
    return D.containment(D.bins_table(spark, {"price": PRICE_BINS}), D.bins_table(spark, {"price": PRICE_COARSE}))


def marginal_1way(spark, d):
    return M.marginal(coded_lineitem(spark, d), ["qty"])


def marginal_2way(spark, d):
    return M.marginal(coded_lineitem(spark, d), ["flag", "qty"], ["client_id"])


def marginal_3way(spark, d):
    return M.marginal(coded_lineitem(spark, d), ["flag", "disc", "tax"])


def workload_grouping_sets(spark, d):
    return M.marginals(coded_lineitem(spark, d), PAIRS, ["client_id"])


def workload_closure(spark, d):
    rows = [("|".join(c), len(c)) for c in M.downward_closure([("flag", "status", "qty"), ("disc", "tax")])]
    return spark.createDataFrame(rows, "clique string, k int")


def pooled_marginal(spark, d):
    return M.pooled(M.marginal(coded_lineitem(spark, d), ["flag", "qty"]), "qty", QTY_GROUPS)


def dense_marginal(spark, d):
    some = coded_lineitem(spark, d).filter("client_id = 0 and disc < 3")
    return M.dense(M.marginal(some, ["flag", "disc"]), DOMAIN.sizes, ["flag", "disc"])


def aligned_marginals(spark, d):
    c = coded_lineitem(spark, d)
    return M.aligned(M.marginal(c.filter("client_id = 0"), ["disc", "tax"]), M.marginal(c.filter("client_id <> 0"), ["disc", "tax"]), ["disc", "tax"])


def marginal_l1(spark, d):
    return aligned_marginals(spark, d).agg(M.l1(F.col("a"), F.col("b")).cast("long").alias("l1"))


QUERIES = {f.__name__: f for f in (
    bins_equal_width, bins_mixed_zero, bins_missing, bins_ordinal, bins_dimension, domain_sizes, encode_categorical, encode_unseen, decode, quantile_bins, quantile_bins_mixed, rediscretize, bin_containment,
    marginal_1way, marginal_2way, marginal_3way, workload_grouping_sets, workload_closure, pooled_marginal, dense_marginal, aligned_marginals, marginal_l1,
)}


def _sets() -> str:
    return ", ".join("(client_id, " + ", ".join(c) + ")" for c in PAIRS)


def _case(value) -> str:
    names = sorted(NAMES)
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'grouping({n}) = {int(n not in c)}' for n in names)} THEN {value(c)}" for c in PAIRS) + " END"


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_STARTS = "[" + ", ".join(str(-int(-(b.low * 100) // 1)) for b in PRICE_BINS) + "]"
_ENDS = "[" + ", ".join(str(-int(-(b.high * 100) // 1)) for b in PRICE_BINS) + "]"
_FINE, _COARSE = duck_digitize("l_extendedprice", inner_edges(PRICE_BINS)), duck_digitize("l_extendedprice", inner_edges(PRICE_COARSE))


def _quantiles(source: str, x: str, keep: str = "true", first: str = "") -> str:
    return f"""WITH s AS ({source}), q AS (SELECT unnest(list_distinct(quantile_cont({x}, [{', '.join(str(i / 8) for i in range(1, 9))}]))) AS v FROM s WHERE {keep}),
c AS (SELECT list((v + w) / 2) AS cuts FROM (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM q) WHERE w IS NOT NULL)
SELECT CAST({first} len(list_filter(cuts, lambda e: e < {x})) AS INTEGER) AS code, count(*) AS cnt FROM s, c GROUP BY 1"""


ORACLES = {
    "bins_equal_width": f"SELECT {duck_digitize('l_quantity', inner_edges(BINS['qty']))} AS bin, count(*) AS cnt FROM lineitem GROUP BY 1",
    "bins_mixed_zero": f"SELECT c_custkey, CASE WHEN c_acctbal < 1e-7 THEN 0 ELSE 1 + {duck_digitize('c_acctbal', inner_edges(MIXED_BINS))} END AS bin FROM customer",
    "bins_missing": "SELECT CASE WHEN quality IS NULL THEN 2 ELSE CAST(quality AS INTEGER) END AS bin, count(*) AS cnt FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "bins_ordinal": "SELECT CAST(l_linenumber - 1 AS INTEGER) AS bin, count(*) AS cnt FROM lineitem GROUP BY 1",
    "bins_dimension": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b.id}, '{b.kind}', {'NULL' if b.label is None else repr(b.label)})" for a, own in {"balance": MIXED_BINS, **BINS}.items() for b in own) + ") t(attr, bin_id, kind, label)",
    "domain_sizes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({s} AS BIGINT))" for n, s in (("flag", 3), ("status", 2), ("qty", 32), ("disc", 11), ("tax", 9), ("line", 7))) + ") t(attr, size)",
    "encode_categorical": f"WITH {CODED} SELECT flag AS code, count(*) AS cnt FROM coded GROUP BY 1",
    "encode_unseen": "SELECT count(*) AS unseen FROM lineitem WHERE l_returnflag = 'R'",
    "decode": f"WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {_FINE} + 1 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CAST({_STARTS}[k] + {duck_hash(11, *_KEYS)} % ({_ENDS}[k] - {_STARTS}[k]) AS DOUBLE) / 100.0::DOUBLE AS price FROM c",
    "quantile_bins": _quantiles("SELECT c_acctbal AS x FROM customer", "x"),
    "quantile_bins_mixed": _quantiles("SELECT greatest(c_acctbal, 0.0) AS x FROM customer", "x", "x > 0", "CASE WHEN x > 1e-7 THEN 1 ELSE 0 END +"),
    "rediscretize": f"WITH c AS (SELECT *, {_COARSE} AS coarse FROM lineitem) SELECT coarse, CAST(4 * coarse + {duck_hash(5, *_KEYS)} % 4 AS INTEGER) AS fine, count(*) AS cnt FROM c GROUP BY 1, 2",
    "bin_containment": "SELECT 'price' AS attr, CAST(i AS INTEGER) AS inner_id, CAST(i // 4 AS INTEGER) AS outer_id FROM range(32) t(i)",
    "marginal_1way": f"WITH {CODED} SELECT qty, count(*) AS cnt FROM coded GROUP BY 1",
    "marginal_2way": f"WITH {CODED} SELECT client_id, flag, qty, count(*) AS cnt FROM coded GROUP BY 1, 2, 3",
    "marginal_3way": f"WITH {CODED} SELECT flag, disc, tax, count(*) AS cnt FROM coded GROUP BY 1, 2, 3",
    "workload_grouping_sets": f"WITH {CODED} SELECT client_id, {_case(lambda c: repr('|'.join(c)))} AS clique, {_case(lambda c: 'concat_ws(' + repr('|') + ', ' + ', '.join(c) + ')')} AS cell, count(*) AS cnt FROM coded GROUP BY GROUPING SETS ({_sets()})",
    "workload_closure": "SELECT * FROM (VALUES ('disc', 1), ('flag', 1), ('qty', 1), ('status', 1), ('tax', 1), ('disc|tax', 2), ('flag|qty', 2), ('flag|status', 2), ('status|qty', 2), ('flag|status|qty', 3)) t(clique, k)",
    "pooled_marginal": f"WITH {CODED} SELECT flag, CASE WHEN qty < 8 THEN 0 WHEN qty < 16 THEN 1 ELSE 2 END AS qty, count(*) AS cnt FROM coded GROUP BY 1, 2",
    "dense_marginal": f"WITH {CODED}, m AS (SELECT flag, disc, count(*) AS cnt FROM coded WHERE client_id = 0 AND disc < 3 GROUP BY 1, 2), g AS (SELECT CAST(a AS INTEGER) AS flag, CAST(b AS INTEGER) AS disc FROM range(3) x(a), range(11) y(b)) SELECT flag, disc, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN m USING (flag, disc)",
    "aligned_marginals": f"WITH {CODED} SELECT disc, tax, count(*) FILTER (WHERE client_id = 0) AS a, count(*) FILTER (WHERE client_id <> 0) AS b FROM coded GROUP BY 1, 2",
    "marginal_l1": f"WITH {CODED}, m AS (SELECT disc, tax, count(*) FILTER (WHERE client_id = 0) AS a, count(*) FILTER (WHERE client_id <> 0) AS b FROM coded GROUP BY 1, 2) SELECT CAST(sum(abs(a - b)) AS BIGINT) AS l1 FROM m",
}

"""Queries: noisy answers, budgets, selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import duck_gaussian
from ..operators import discretize as D
from ..operators import marginals as M
from ..operators import privacy as P
from ..operators import selection as X
from ..spec import ColumnSpec
from .common import CLIENTS, CODED, DOMAIN, NAMES, coded_lineitem, duck_digitize, inner_edges, r6, table

MU, SEED, TWO = 0.5, 77, ("flag", "disc")
NOISE = P.Noise("keyed", SEED)
PAIRS = M.powerset(NAMES, 2, 2)
#: Bins of lineitem's price between public bounds, and the noisy count below which a part of them is merged.
PRICE_BINS = D.bins_of(ColumnSpec("price", "numerical", low=900.0, high=105000.0))
MERGE_BELOW = D.merge_threshold(len(NAMES), MU, CLIENTS)


def noisy_marginal(spark, d):
    return NOISE.add(M.marginal(coded_lineitem(spark, d), TWO, ["client_id"]), 1 / MU, ["client_id", *TWO]).select("client_id", *TWO, r6(F.col("y")).alias("y"), "sigma")


def aggregate_clients(spark, d):
    noisy = NOISE.add(M.marginal(coded_lineitem(spark, d), TWO, ["client_id"]), 1 / MU, ["client_id", *TWO])
    return M.summed_over_clients(noisy, TWO).select(*TWO, r6(F.col("y")).alias("y"), r6(F.col("sigma")).alias("sigma"))


def _noisy_one_way(spark, d):
    return NOISE.add(M.marginals(coded_lineitem(spark, d), M.powerset(NAMES, 1, 1), ["client_id"]), 1 / MU, ["client_id", "clique", "cell"])


def total_estimates(spark, d):
    got = M.total_estimates(M.summed_over_clients(_noisy_one_way(spark, d), ["clique", "cell"]))
    return got.select("clique", r6(F.col("total")).alias("total"), r6(F.col("variance")).alias("variance"))


def inverse_variance_total(spark, d):
    totals = M.total_estimates(M.summed_over_clients(_noisy_one_way(spark, d), ["clique", "cell"]))
    return M.inverse_variance(totals, [], "total").select(r6(F.col("y")).alias("total"), r6(F.col("variance")).alias("variance"))


def client_fractions(spark, d):
    per = _noisy_one_way(spark, d).groupBy("client_id", "clique").agg(F.sum("y").alias("total"), F.sum(F.col("sigma") ** 2).alias("variance"))
    best = M.inverse_variance(per, ["client_id"], "total")
    return best.select("client_id", r6(F.col("y") / F.sum("y").over(Window.partitionBy(F.lit(0)))).alias("f"))  # a row a client


def hier_counts(spark, d):
    """Noisy counts of quantity's halves, quarters, eighths and sixteenths: each round's bin is the final one shifted."""
    counts = M.marginal(coded_lineitem(spark, d), ["qty"])
    rounds = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), F.shiftright("qty", 4 - r).alias("bin")) for r in range(4)])).alias("x")
    summed = counts.select(rounds, "cnt").groupBy("x.round", "x.bin").agg(F.sum("cnt").alias("cnt"))
    sigma, _ = D.round_sigmas(MU, 4)
    return NOISE.add(summed, sigma, ["round", "bin"]).select("round", "bin", r6(F.col("y")).alias("y"))


def level_merge(spark, d):
    """Groups of the price's bins, by noisy counts of its halves, quarters, eighths and sixteenths."""
    bins = table(spark, d, "lineitem").select(D.code(F.col("l_extendedprice"), PRICE_BINS).alias("bin"))
    counts = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    rounds = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), F.shiftright("bin", 4 - r).alias("bin")) for r in range(4)])).alias("x")
    summed = counts.select(rounds, "cnt").groupBy("x.round", "x.bin").agg(F.sum("cnt").alias("cnt"))
    every = spark.range(30).select((F.floor(F.log2(F.col("id") + 2)) - 1).cast("int").alias("round"), "id").select("round", (F.col("id") + 2 - F.expr("shiftleft(2, round)")).cast("int").alias("bin"))
    summed = every.join(summed, ["round", "bin"], "left").select("round", "bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    noisy = {(r["round"], r["bin"]): r["y"] for r in NOISE.add(summed, D.round_sigmas(MU, 4)[0], ["round", "bin"]).collect()}  # 30 rows
    groups = D.merged_groups([[noisy[r, j] for j in range(2 << r)] for r in range(4)], len(PRICE_BINS), MERGE_BELOW)
    return spark.createDataFrame([(int(c), g) for g, cells in enumerate(groups) for c in cells], "bin int, grp int")


def category_pool(spark, d):
    """Counts of event types, those whose noisy count is below the mean of all pooled."""
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    noisy = {r["event_type"]: r["y"] for r in NOISE.add(counts, 1 / MU, ["event_type"]).collect()}  # declared levels: few
    pooled = D.pooled_levels(noisy, float(np.mean(list(noisy.values()))))
    return table(spark, d, "events").groupBy(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(pooled.items()) for x in kv]), F.col("event_type")).alias("level")).agg(F.count(F.lit(1)).alias("cnt"))


def budget_ledger(spark, d):
    shares = [(1, 0.1), (2, 0.1), (3, 0.8)]
    steps = spark.createDataFrame([(i, m) for (i, _), m in zip(shares, P.proportional(MU, [s for _, s in shares]), strict=True)], "step int, mu double")
    so_far = Window.partitionBy(F.lit(0)).orderBy("step")  # a few steps
    return steps.select("step", r6(F.col("mu")).alias("mu"), r6(F.sqrt(F.sum(F.col("mu") * F.col("mu")).over(so_far))).alias("spent"))


def gdp_conversions(spark, d):
    rows = [("mu", P.mu_of(0.5, 1e-9)), ("mu", P.mu_of(1.0, 1e-9)), ("mechanism", P.mechanism_eps(0.1)), ("mechanism", P.mechanism_eps(0.5)), ("mechanism", P.mechanism_eps(1.0)), ("eps", P.eps_of(P.mu_of(1.0, 1e-9), 1e-9)), ("threshold", D.merge_threshold(14, 1.0, 5)), *[("steps", float(P.gan_rounds(m))) for m in (0.01, 0.5, 1.0, 2.5)]]
    return spark.createDataFrame(rows, "kind string, v double").select("kind", F.round("v", 5).alias("v"))


def _score(method):
    def query(spark, d):
        coded = coded_lineitem(spark, d).select("client_id", *TWO)
        return X.pair_scores(X.independent_pairs(coded, coded, TWO, DOMAIN.sizes), MU, method).select("client_id", r6(F.col("score")).alias("score"))

    query.__name__ = f"score_{method}"
    return query


def edge_vote(spark, d):
    """Each client votes for its largest two-way difference from independence, weighted by its share of the rows."""
    coded = coded_lineitem(spark, d)
    sizes = coded.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    f = sizes.select("client_id", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("f"))
    choices = None
    for pair in (("flag", "status"), ("flag", "disc"), ("disc", "tax")):
        one = X.pair_scores(X.independent_pairs(coded.select("client_id", *pair), coded, pair, DOMAIN.sizes), MU).select("client_id", F.lit(pair[0]).alias("a"), F.lit(pair[1]).alias("b"), "score")
        choices = one if choices is None else choices.unionByName(one)
    best = choices.groupBy("client_id").agg(F.max_by(F.struct("a", "b"), "score").alias("e")).select("client_id", "e.a", "e.b")
    return X.edge_votes(best, f).select("a", "b", r6(F.col("weight")).alias("weight"))


def noisy_max(spark, d):
    coded = coded_lineitem(spark, d)
    scores = M.marginals(coded, PAIRS).groupBy("clique").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return P.noisy_max(scores, NOISE, MU, CLIENTS).select("clique", r6(F.col("y")).alias("y"))


_SCORES = {f"score_{m}": _score(m) for m in X.METHODS}
QUERIES = {f.__name__: f for f in (noisy_marginal, aggregate_clients, total_estimates, inverse_variance_total, client_fractions, hier_counts, level_merge, category_pool, budget_ledger, gdp_conversions)} | _SCORES | {"edge_vote": edge_vote, "noisy_max": noisy_max}

_ONE = f"""{CODED}, m AS ({" UNION ALL ".join(f"SELECT client_id, '{n}' AS clique, CAST({n} AS VARCHAR) AS cell, count(*) AS cnt FROM coded GROUP BY 1, 3" for n in NAMES)}),
n AS (SELECT *, cnt + {1 / MU!r}::DOUBLE * {duck_gaussian(SEED, 'client_id', 'clique', 'cell')} AS y FROM m)"""
_VAR = 1 / MU**2
_TOTALS = f"t AS (SELECT clique, sum(y) AS total, count(*) * {_VAR!r}::DOUBLE AS variance FROM n GROUP BY 1)"


def _pair(a: str, b: str, method: str = "standard", name: str = "score") -> str:
    """Scores by client of a pair of columns, in DuckDB."""
    f = "f" if method != "local" else "1.0"
    da, db = DOMAIN[a], DOMAIN[b]
    grid = f"""SELECT s.client_id, s.f, ga, gb, coalesce(c.cnt, 0) AS cnt, {f} * coalesce(na.n, 0) * coalesce(nb.n, 0) / tot AS model
FROM (SELECT client_id, count(*) AS n, count(*) / (SELECT count(*) FROM coded)::DOUBLE AS f, (SELECT count(*) FROM coded)::DOUBLE AS tot FROM coded GROUP BY 1) s, range({da}) x(ga), range({db}) y(gb)
LEFT JOIN (SELECT {a} AS k, count(*) AS n FROM coded GROUP BY 1) na ON na.k = ga LEFT JOIN (SELECT {b} AS k, count(*) AS n FROM coded GROUP BY 1) nb ON nb.k = gb
LEFT JOIN (SELECT client_id, {a} AS ka, {b} AS kb, count(*) AS cnt FROM coded GROUP BY 1, 2, 3) c ON c.client_id = s.client_id AND c.ka = ga AND c.kb = gb"""
    base = f"SELECT client_id, sum(abs(cnt - model)) - {math.sqrt(2 / math.pi)!r}::DOUBLE * sqrt(max(f)) / {MU!r} * count(*) AS {name} FROM ({grid}) GROUP BY 1"
    if method != "adjusted":
        return base
    ones = " UNION ALL ".join(f"SELECT client_id, sum(abs(c - m)) AS w FROM (SELECT client_id, {g}, sum(cnt) AS c, sum(model) AS m FROM ({grid}) GROUP BY 1, 2) GROUP BY 1" for g in ("ga", "gb"))
    return f"SELECT client_id, 0.5 * (z.{name} - (SELECT max(w) FROM ({ones}) o WHERE o.client_id = z.client_id)) AS {name} FROM ({base}) z"


_EDGES = (("flag", "status"), ("flag", "disc"), ("disc", "tax"))
ORACLES = {
    "noisy_marginal": f"WITH {CODED}, m AS (SELECT client_id, flag, disc, count(*) AS cnt FROM coded GROUP BY 1, 2, 3) SELECT client_id, flag, disc, round(cnt + {1 / MU!r}::DOUBLE * {duck_gaussian(SEED, 'client_id', 'flag', 'disc')}, 6) AS y, {1 / MU!r}::DOUBLE AS sigma FROM m",
    "aggregate_clients": f"WITH {CODED}, m AS (SELECT client_id, flag, disc, count(*) AS cnt FROM coded GROUP BY 1, 2, 3) SELECT flag, disc, round(sum(cnt + {1 / MU!r}::DOUBLE * {duck_gaussian(SEED, 'client_id', 'flag', 'disc')}), 6) AS y, round(sqrt(count(*) * {_VAR!r}::DOUBLE), 6) AS sigma FROM m GROUP BY 1, 2",
    "total_estimates": f"WITH {_ONE}, {_TOTALS} SELECT clique, round(total, 6) AS total, round(variance, 6) AS variance FROM t",
    "inverse_variance_total": f"WITH {_ONE}, {_TOTALS} SELECT round(sum(total / variance) / sum(1 / variance), 6) AS total, round(1 / sum(1 / variance), 6) AS variance FROM t",
    "client_fractions": f"WITH {_ONE}, t AS (SELECT client_id, clique, sum(y) AS total, count(*) * {_VAR!r}::DOUBLE AS variance FROM n GROUP BY 1, 2), b AS (SELECT client_id, sum(total / variance) / sum(1 / variance) AS y FROM t GROUP BY 1) SELECT client_id, round(y / (SELECT sum(y) FROM b), 6) AS f FROM b",
    "hier_counts": f"WITH {CODED}, m AS (SELECT CAST(r AS INTEGER) AS round, CAST(qty >> (4 - r) AS INTEGER) AS bin, count(*) AS cnt FROM coded, range(4) t(r) GROUP BY 1, 2) SELECT round, bin, round(cnt + {D.round_sigmas(MU, 4)[0]!r}::DOUBLE * {duck_gaussian(SEED, 'round', 'bin')}, 6) AS y FROM m",
    "level_merge": f"""WITH b AS (SELECT {duck_digitize('l_extendedprice', inner_edges(PRICE_BINS))} AS bin FROM lineitem),
p AS (SELECT CAST(r AS INTEGER) AS round, CAST(j AS INTEGER) AS bin FROM range(4) t(r), range(16) u(j) WHERE j < (2 << r)),
m AS (SELECT CAST(r AS INTEGER) AS round, CAST(bin >> (4 - r) AS INTEGER) AS bin, count(*) AS cnt FROM b, range(4) t(r) GROUP BY 1, 2),
n AS (SELECT round, bin, coalesce(cnt, 0) + {D.round_sigmas(MU, 4)[0]!r}::DOUBLE * {duck_gaussian(SEED, 'round', 'bin')} AS y FROM p LEFT JOIN m USING (round, bin)),
o AS (SELECT CAST(c AS INTEGER) AS bin, (SELECT min(round) FROM n WHERE y < {MERGE_BELOW!r}::DOUBLE AND n.bin = c >> (4 - n.round)) AS r FROM range(32) t(c))
SELECT bin, CAST(dense_rank() OVER (ORDER BY CASE WHEN r IS NULL THEN bin ELSE (bin >> (4 - r)) << (4 - r) END) - 1 AS INTEGER) AS grp FROM o""",
    "category_pool": f"WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1), n AS (SELECT *, cnt + {1 / MU!r}::DOUBLE * {duck_gaussian(SEED, 'event_type')} AS y FROM c) SELECT CASE WHEN y < (SELECT avg(y) FROM n) THEN 'other' ELSE event_type END AS level, CAST(sum(cnt) AS BIGINT) AS cnt FROM n GROUP BY 1",
    "budget_ledger": "SELECT step, round(mu, 6) AS mu, round(sqrt(sum(mu * mu) OVER (ORDER BY step)), 6) AS spent FROM (VALUES (1, sqrt(0.1) * 0.5), (2, sqrt(0.1) * 0.5), (3, sqrt(0.8) * 0.5)) t(step, mu)",
    "gdp_conversions": "SELECT kind, CAST(v AS DOUBLE) AS v FROM (VALUES ('mu', 0.09369), ('mu', 0.18197), ('mechanism', 0.07980), ('mechanism', 0.40008), ('mechanism', 0.80697), ('eps', 1.0), ('threshold', 80.10697), ('steps', 9), ('steps', 433), ('steps', 866), ('steps', 1000)) t(kind, v)",
    "score_standard": f"WITH {CODED} SELECT client_id, round(score, 6) AS score FROM ({_pair(*TWO)})",
    "score_local": f"WITH {CODED} SELECT client_id, round(score, 6) AS score FROM ({_pair(*TWO, 'local')})",
    "score_adjusted": f"WITH {CODED} SELECT client_id, round(score, 6) AS score FROM ({_pair(*TWO, 'adjusted')})",
    "score_random": f"WITH {CODED} SELECT DISTINCT client_id, 0.0::DOUBLE AS score FROM coded",
    "edge_vote": f"WITH {CODED}, s AS ({' UNION ALL '.join(f'SELECT client_id, {a!r} AS a, {b!r} AS b, score FROM ({_pair(a, b)})' for a, b in _EDGES)}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC) AS r FROM s) WHERE r = 1), f AS (SELECT client_id, count(*) / (SELECT count(*) FROM coded)::DOUBLE AS f FROM coded GROUP BY 1) SELECT a, b, round(sum(f), 6) AS weight FROM best JOIN f USING (client_id) GROUP BY 1, 2",
    "noisy_max": f"WITH {CODED}, s AS ({' UNION ALL '.join(f'SELECT {repr("|".join(c))} AS clique, count(*) AS score FROM (SELECT DISTINCT {c[0]}, {c[1]} FROM coded)' for c in PAIRS)}) SELECT clique, round(score + {math.sqrt(CLIENTS) / MU!r}::DOUBLE * {duck_gaussian(SEED, 'clique')}, 6) AS y FROM s ORDER BY score + {math.sqrt(CLIENTS) / MU!r}::DOUBLE * {duck_gaussian(SEED, 'clique')} DESC LIMIT 1",
}

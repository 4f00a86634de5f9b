"""Samples, client splits, train/test splits and folds, by ranks in keyed-hash orders.

Ranks over whole tables avoid a single-task window: rows are range-partitioned by the hash, counted per partition, and numbered from the
partition's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed_hash, shuffled

#: Named settings: size fractions, and weights of the rows with label 1 (None: as the sizes).
SETTINGS: dict[str, tuple[list[float], list[float] | None]] = {
    "homogeneous_equalsize": ([0.2] * 5, None),
    "heterogeneous_equalsize": ([0.2] * 5, [5, 2, 1, 1, 1]),
    "homogeneous_diffsize": ([0.5, 0.2, 0.1, 0.1, 0.1], None),
}


def sample_n(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly n rows (all if fewer), without replacement; a top-n of the hash order, so no full sort."""
    return df.orderBy(*shuffled(seed, *keys)).limit(n)


def numbered(df: DataFrame, seed: int, keys: Sequence[str], within: Sequence[str] = (), name: str = "rn", buckets: int | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in the hash order, within groups.

    The first bits of the hash cut each group into buckets; a rank is the rows in the group's earlier buckets plus the rank in the bucket.
    No task holds more than a bucket's rows, whatever the group's size: buckets hold about 2^20 rows each, and are 1,024 at least.
    """
    buckets = buckets or min(1 << 20, max(1024, 1 << (df.count() >> 20).bit_length()))
    order = shuffled(seed, *keys)
    bucket = F.floor(keyed_hash(seed, *keys) / F.lit(2**32 // buckets)).cast("int")
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*within, "_bucket")]
    joined = ranked.alias("r").join(F.broadcast(offsets).alias("o") if not within else offsets.alias("o"), on)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_before") + F.col("_rank")).cast("long").alias(name))


def _cuts(fractions: Sequence[float], n: int, whole: bool = False) -> list[int]:
    """Cut points at the running sums of the fractions of n: rounded half to even, or cut down to whole numbers."""
    total, out = 0.0, []
    for f in fractions:
        total += f
        out.append(int(total * n + 1e-9) if whole else round(total * n))
    out[-1] = n
    return out


def _client(rank: Column, cuts: Sequence[int]) -> Column:
    """The client (from 0) whose cut is the first at or beyond the rank."""
    return sum([(rank > c).cast("int") for c in cuts[:-1]], F.lit(0))


def check_fractions(fractions: Sequence[float], y_weights: Sequence[float] | None) -> list[float] | None:
    """The normalised weights; an impossible setting is an error."""
    if not fractions or abs(sum(fractions) - 1) > 1e-9 or min(fractions) < 0:
        raise ValueError("size fractions must be non-negative and sum to 1")
    if y_weights is None:
        return None
    if len(y_weights) != len(fractions) or min(y_weights) < 0 or sum(y_weights) <= 0:
        raise ValueError("one non-negative weight a client is needed")
    return [w / sum(y_weights) for w in y_weights]


def split_iid(df: DataFrame, fractions: Sequence[float], seed: int, keys: Sequence[str]) -> DataFrame:
    """df with client_id: the hash order cut at the rounded running sums of the fractions."""
    check_fractions(fractions, None)
    n = df.count()
    return numbered(df, seed, keys).withColumn("client_id", _client(F.col("rn"), _cuts(fractions, n))).drop("rn")


def split_label_skew(df: DataFrame, label: str, fractions: Sequence[float], y_weights: Sequence[float], seed: int, keys: Sequence[str]) -> DataFrame:
    """df with client_id: rows of label 1 are dealt by y_weights, rows of label 0 fill every client up to its size."""
    shares = check_fractions(fractions, y_weights)
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label)), F.lit(0))).first()
    n, n1 = int(row[0]), int(row[1])
    ones, sizes = _cuts(shares, n1, whole=True), _cuts(fractions, n, whole=True)
    zeros = [s - o for s, o in zip(sizes, ones, strict=True)]
    if any(b < a for a, b in zip([0, *zeros], zeros, strict=False)):
        raise ValueError("a client would need more rows of label 1 than it has rows")
    client = F.when(F.col(label) == 1, _client(F.col("rn"), ones)).otherwise(_client(F.col("rn"), zeros))
    return numbered(df, seed, keys, [label]).withColumn("client_id", client).drop("rn")


def train_test(df: DataFrame, fraction: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """df (with client_id) with ``split``: of each client round(fraction * n) rows are "train"."""
    sizes = df.groupBy("client_id").agg(F.count(F.lit(1)).alias("_size"))  # a row a client
    ranked = numbered(df, seed, keys, ["client_id"]).join(F.broadcast(sizes), "client_id")
    train = F.col("rn") <= F.bround(F.lit(fraction) * F.col("_size"), 0)
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop("rn", "_size")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """df with ``fold`` (0 .. k-1), the rows of each label dealt in turn in hash order."""
    return numbered(df, seed, keys, [label]).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def repeated_splits(df: DataFrame, setting: str, reps: int, seed: int, keys: Sequence[str], label: str | None = None, fraction: float = 0.75) -> DataFrame:
    """``reps`` copies of df with rep, client_id and split under a named setting."""
    if setting not in SETTINGS:
        raise ValueError(f"no setting {setting!r}; there are {', '.join(SETTINGS)}")
    sizes, weights = SETTINGS[setting]
    out = None
    for rep in range(reps):
        own = seed * 1000 + rep
        dealt = split_iid(df, sizes, own, keys) if weights is None or label is None else split_label_skew(df, label, sizes, weights, own, keys)
        one = train_test(dealt, fraction, own, keys).withColumn("rep", F.lit(rep))
        out = one if out is None else out.unionByName(one)
    return out

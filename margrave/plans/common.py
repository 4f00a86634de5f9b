"""What the catalogue's queries share: tables, the specification of coded lineitem, and its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discretize
from ..operators.pgm import Domain
from ..spec import ColumnSpec, TableSpec

#: Number of data holders in the queries.
CLIENTS = 5
LINEITEM = TableSpec(
    (
        ColumnSpec("flag", "categorical", levels=("A", "N", "R")),
        ColumnSpec("status", "categorical", levels=("F", "O")),
        ColumnSpec("qty", "numerical", low=1.0, high=50.0),
        ColumnSpec("disc", "ordinal", low=0, high=10),
        ColumnSpec("tax", "ordinal", low=0, high=8),
        ColumnSpec("line", "ordinal", low=0, high=6),
    ),
    label="status",
)
NAMES = LINEITEM.names
BINS = {c.name: discretize.bins_of(c) for c in LINEITEM.columns}
DOMAIN = Domain({n: len(b) for n, b in BINS.items()})
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """client_id, the columns to keep, and the specification's columns in their original space."""
    df = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return df.select(
        (F.col("l_suppkey") % CLIENTS).cast("int").alias("client_id"), *keep, F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("qty"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), (F.col("l_linenumber") - 1).alias("line"),
    )


def coded_lineitem(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return discretize.coded(lineitem(spark, sf_dir, *keep), LINEITEM, BINS, ["client_id", *keep])


def r6(x: Column) -> Column:
    return F.round(x, 6)


def doubles(values) -> str:
    """A DuckDB list of doubles."""
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def duck_digitize(x: str, inner: list[float]) -> str:
    return f"CAST(len(list_filter({doubles(inner)}, lambda e: e <= {x})) AS INTEGER)"


def inner_edges(bins) -> list[float]:
    return [b.low for b in bins if b.kind == "range"][1:]


#: Coded lineitem in DuckDB.
CODED = f"""coded AS (
  SELECT CAST(l_suppkey % {CLIENTS} AS INTEGER) AS client_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS flag,
         CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status,
         {duck_digitize("l_quantity", inner_edges(BINS["qty"]))} AS qty,
         CAST(round(l_discount * 100) AS INTEGER) AS disc, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_linenumber - 1 AS INTEGER) AS line
  FROM lineitem)"""

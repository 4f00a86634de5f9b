"""Sources and sinks: CSV with declared options, Parquet bundles with their specification, results tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..spec import ColumnSpec, TableSpec


def read_csv(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = ",", escape: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The named columns, in that order, of one or more CSV files with headers; columns are matched by name, files united."""
    reader = spark.read.option("header", True).option("sep", sep)
    if escape:
        reader = reader.option("escape", escape)
    paths = [paths] if isinstance(paths, str) else paths
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    frames = [reader.csv(p).select(*[F.col(f"`{c}`") for c in columns]) for p in paths]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


@dataclass(frozen=True)
class Dataset:
    """What is declared about a public dataset: file format, columns and roles, and the clean-up of codes."""

    sep: str
    roles: dict[str, str]
    label: str
    label_map: dict | None = None
    escape: str | None = None
    decimals: dict[str, int] = field(default_factory=dict)
    remaps: dict[str, dict] = field(default_factory=dict)
    missing: dict[str, tuple] = field(default_factory=dict)
    log1p: tuple[str, ...] = ()
    symmetric_log: tuple[str, ...] = ()
    shift: dict[str, int] = field(default_factory=dict)
    divide: dict[str, float] = field(default_factory=dict)
    round_to: dict[str, int] = field(default_factory=dict)

    def clean(self, df: DataFrame) -> DataFrame:
        """The declared clean-up, as one projection: codes, missing codes, shifts, division, logarithms, rounding (half to even)."""
        out = []
        for name, role in self.roles.items():
            x = F.col(f"`{name}`")
            if name in self.remaps:
                x = scalars.remap(x.cast("string"), {str(k): str(v) for k, v in self.remaps[name].items()}, keep_others=False)
            if name in self.missing:
                x = F.when(~x.cast("string").isin(*map(str, self.missing[name])), x)
            if role != "categorical":
                x = scalars.cleaned(x)
                x = x + F.lit(self.shift.get(name, 0))
                if name in self.divide:
                    x = x / F.lit(self.divide[name])
                if name in self.log1p:
                    x = scalars.log1p(x)
                if name in self.symmetric_log:
                    x = scalars.symmetric_log(x)
                if name in self.round_to:
                    x = scalars.rounded(x, self.round_to[name])
                x = x.cast("int") if role == "ordinal" else x
            elif name == self.label and self.label_map:
                x = scalars.remap(x, self.label_map, keep_others=False)
            else:
                x = x.cast("string")
            out.append(x.alias(name))
        return df.select(*out)

    def load(self, spark: SparkSession, paths: str | list[str], sample: int | None = 40_000, seed: int = 1234) -> DataFrame:
        from ..operators.split import sample_n

        raw = read_csv(spark, paths, list(self.roles), self.sep, self.escape)
        if sample is not None:
            raw = sample_n(raw, sample, seed, list(self.roles))
        return self.clean(raw)


def _roles(**names: list[str]) -> dict[str, str]:
    return {n: role for role, own in names.items() for n in own}


# Columns, roles and codes of four public datasets.
ADULT = Dataset(
    sep=",",
    escape=".",
    label="income>50K",
    label_map={" <=50K": 0, " >50K": 1},
    roles=_roles(
        numerical=["age", "fnlwgt", "hours-per-week"],
        ordinal=["education-num"],
        mixed=["capital-gain", "capital-loss"],
        categorical=["workclass", "marital-status", "occupation", "relationship", "race", "sex", "native-country", "income>50K"],
    ),
    shift={"education-num": -1},
)
LOAN = Dataset(
    sep=";",
    label="y",
    label_map={"no": 0, "yes": 1},
    roles=_roles(
        numerical=["age", "campaign", "emp.var.rate", "cons.price.idx", "cons.conf.idx", "euribor3m", "nr.employed"],
        ordinal=["previous"],
        mixed=["duration", "pdays"],
        categorical=["job", "marital", "education", "default", "housing", "loan", "contact", "month", "day_of_week", "poutcome", "y"],
    ),
    missing={"pdays": (999,)},
    log1p=("duration",),
    divide={"nr.employed": 10.0},
    round_to={"cons.price.idx": 1, "cons.conf.idx": 0, "euribor3m": 1, "nr.employed": 0},
    decimals={"duration": 7, "emp.var.rate": 1, "cons.price.idx": 1, "euribor3m": 1},
)
CREDIT = Dataset(
    sep=",",
    label="Class",
    roles=_roles(
        numerical=["Time", "Amount", "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11", "V12", "V13", "V14", "V15", "V16", "V17", "V18", "V19", "V20", "V21", "V22", "V23", "V24", "V25", "V26", "V27", "V28"],
        categorical=["Class"],
    ),
    log1p=("Amount",),
    symmetric_log=tuple(f"V{i}" for i in range(1, 29)),
    decimals={"Amount": 7} | {f"V{i}": 7 for i in range(1, 29)},
)
BREAST = Dataset(
    sep=";",
    label="vit_stat",
    roles=_roles(
        numerical=["leeft", "vit_stat_int", "ond_lymf", "tum_afm"],
        ordinal=["incjr", "diag_basis", "diffgrad", "stadium", "cstadium", "pstadium", "her2_stat"],
        mixed=["pos_lymf"],
        categorical=["gesl", "vit_stat", "tumsoort", "topo_sublok", "later", "morf", "ct", "cn", "cm", "pt", "pn", "pm", "er_stat", "pr_stat", "dcis_comp", "multifoc", "swk_uitslag", "mari_uitslag", "okd", "org_chir", "uitgebr_chir_code", "dir_reconstr", "chemo", "target", "horm", "rt", "meta_rt", "meta_chir"],
    ),
    remaps={
        "stadium": {"0": 0, "1": 1, "1A": 1, "1B": 2, "2A": 3, "2B": 4, "3": 5, "3A": 5, "3B": 6, "3C": 7, "4": 8},
        "pstadium": {"0": 0, "1": 1, "1A": 1, "1B": 2, "2A": 3, "2B": 4, "3": 5, "3A": 5, "3B": 6, "3C": 7, "4": 8},
        "cstadium": {"0": 0, "1": 1, "1A": 1, "2A": 2, "2B": 3, "3": 4, "3A": 4, "3B": 5, "3C": 6, "4": 7},
        "diag_basis": {2: 0, 5: 1, 6: 2, 7: 3},
        "incjr": {2010: 0, 2011: 1, 2012: 2, 2013: 3, 2014: 4, 2015: 5, 2016: 6, 2017: 7, 2018: 8, 2019: 9},
    },
    missing={"tum_afm": (98, 99, 999), "ond_lymf": (98, 99, 999), "pos_lymf": (98, 99, 999), "her2_stat": (4, 7, 9), "diffgrad": (9,)},
    log1p=("tum_afm", "ond_lymf"),
    decimals={"ond_lymf": 7, "tum_afm": 7},
)
DATASETS = {"adult": ADULT, "loan": LOAN, "credit": CREDIT, "breast": BREAST}


def write_bundle(df: DataFrame, spec: TableSpec, path: str) -> None:
    """A table and its specification: Parquet and one JSON row, both through Spark's writers."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    text = json.dumps({"columns": [asdict(c) for c in spec.columns], "label": spec.label, "label_map": list(spec.label_map.items())})
    df.sparkSession.createDataFrame([(text,)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, TableSpec]:
    got = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])
    columns = tuple(ColumnSpec(**{**c, "levels": tuple(c["levels"])}) for c in got["columns"])
    return spark.read.parquet(f"{path}/table"), TableSpec(columns, got["label"], dict(got["label_map"]))


def write_results(results: DataFrame, path: str) -> None:
    """Results (rep, mu, metric, value), appended."""
    results.select("rep", "mu", "metric", "value").write.mode("append").parquet(path)

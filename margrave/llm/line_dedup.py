"""Line dedup by levelled sorted runs of line hashes.

A store keeps immutable runs of (h1, h2, n_docs, keeper), each hash-partitioned and sorted by the line's hash.  A new batch is
aggregated to one row per key, merge-anti-joined with the runs (keys seen before add only a count; fresh keys also name their keeper),
and added as a run of level 0; when a level holds ``fanout`` runs they are compacted into one run of the next level.  Batches come in
descending order of doc_id, so the batch in which a key is fresh holds its largest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, fingerprint, text_of

KEYS = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() agrees with the ASCII mapping on ASCII text and has a fast path there; translate() does the rest.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def line_hashes(line: Column, min_chars: int) -> Column:
    """struct(h1, h2) of a line's key, null where the key is shorter than min_chars code points."""
    short = F.char_length(F.btrim(line, F.lit(BLANKS))) < min_chars
    return F.when(~short, F.struct(*fingerprint(line_key(line))))


class LineRuns:
    """Levelled runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3) -> None:
        self.spark, self.fanout, self.scratch = spark, fanout, Scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def append(self, batch: DataFrame) -> None:
        """batch: a row (h1, h2, doc_id) for each distinct key of each document; its doc_ids are below those of earlier batches."""
        keys = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        if runs := self.runs():
            known = _union(runs).filter("fresh").select(*KEYS)
            fresh = keys.join(known, KEYS, "left_anti").withColumn("fresh", F.lit(True))
            seen = keys.join(known, KEYS, "left_semi").withColumn("keeper", F.lit(None).cast("long")).withColumn("fresh", F.lit(False))
            keys = fresh.unionByName(seen)
        else:
            keys = keys.withColumn("fresh", F.lit(True))
        self._add(keys, 0)

    def _add(self, keys: DataFrame, level: int) -> None:
        run = self.scratch.write(keys.select(*KEYS, "n_docs", "keeper", "fresh").sortWithinPartitions(*KEYS), f"level{level}")
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(_compacted(old), level + 1)
            self.scratch.drop(*old)

    def keys(self) -> DataFrame:
        """(h1, h2, n_docs, keeper), a row for each key of all batches."""
        return _compacted(self.runs()) if self.runs() else None


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def _compacted(runs: list[DataFrame]) -> DataFrame:
    return _union(runs).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 3) -> DataFrame:
    """All columns of docs, and ``kept``: struct(text, n_lines, n_dropped), in place of a column of that name.

    A key of at least min_chars code points that at least min_docs rows hold loses its lines in every row but those of its largest
    doc_id.  A null or empty text is one empty line.  Rows that repeat a doc_id count one by one and share decisions; a row without
    doc_id holds keys but is never the keeper.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, fanout)
    lines = F.split(text_of(), "\n")
    # One scan writes the narrow (key, doc_id) pairs, partitioned by batch; all later work on keys is on them.
    cuts = [x for x in (docs.select(F.percentile_approx("doc_id", [1 - i / batches for i in range(1, batches)], 1000)).first()[0] or [])]
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") >= F.lit(cut), i).otherwise(batch)
    keys = F.array_distinct(F.transform(lines, lambda x: line_hashes(x, min_chars)))
    pairs = docs.select("doc_id", batch.alias("batch"), F.explode(keys).alias("key"))
    pairs = store.scratch.write(pairs.filter("key is not null").select("doc_id", "key.h1", "key.h2", "batch"), "pairs", "batch")
    for i in range(len(cuts) + 1):
        store.append(pairs.filter(F.col("batch") == i).select("doc_id", *KEYS))
    # Written, so that the join has plain shuffles on both sides and Spark can split the documents of a very common line.
    heavy = store.scratch.write(store.keys().filter(F.col("n_docs") >= min_docs).select(*KEYS, "keeper"), "heavy")
    losers = pairs.join(heavy, KEYS).filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")) | F.col("keeper").isNull())
    drops = losers.groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias("drops"))
    # The columns travel in a struct, so that their names can't clash with ours.
    rows = docs.select(F.col("doc_id"), text_of().alias("text"), F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != "text"], F.col("text").isNull().alias("__null")).alias("row"))
    joined = rows.join(drops.withColumnRenamed("doc_id", "drop_id"), F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    has, lines = F.col("drops").isNotNull(), F.split("text", "\n")
    kept = F.when(has, F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("drops"), line_hashes(x, min_chars)), F.lit(False))))
    out = joined.withColumn("kept_lines", kept).withColumn("n_lines", F.size(lines).cast("long"))
    n_dropped = F.when(has, F.col("n_lines") - F.size("kept_lines")).otherwise(0).cast("long")
    new = F.struct(F.when(has, F.array_join("kept_lines", "\n")).otherwise(F.col("text")).alias("text"), "n_lines", n_dropped.alias("n_dropped")).alias("kept")
    old = [(F.when(~F.col("row.__null"), F.col("text")) if x == "text" else F.col("row").getField(x)).alias(x) for x in docs.columns if x != "kept"]
    return out.select(*old, new)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                                    generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
heavy AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, h.key IS NOT NULL AND l.doc_id < h.keeper AS gone FROM lines l LEFT JOIN heavy h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

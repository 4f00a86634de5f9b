"""Substring dedup by a log-structured index of window fingerprints.

A window is ``WIDTH`` consecutive words.  Its *anchor* is the least hash among its runs of ``GRAM`` words (leftmost if tied), so equal
windows have equal anchors at equal places, and successive windows mostly share one.  The windows that share an anchor span a stretch of
text; the index holds a row for each anchor: h, the anchor's hash, and c, the hash of the whole stretch.  That is about a fourteenth of
a row per word.  h tells anchors apart, c the stretches of one anchor, by 64 bits each.

* The index is a set of immutable sorted runs of (h, c, n, first place).  A batch becomes a run, merge-joined with the runs there are to
  tell which of its stretches are known; runs of one level are compacted into one of the next.
* A stretch with n > 1 is taken for repeated as a whole, and verified: its words are read again and hashed by two other functions, 128 bits,
  which must occur twice, too.  If an anchor occurs in stretches that differ, the windows of one stretch of each kind are compared one by
  one by 128-bit hashes: that resolves the edges of shared passages.
* Words covered by a repeated window go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of, worker_of

WIDTH, GRAM = 35, 8
PLACE_BITS = 28
KEY = ["did", "tk"]
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_U = np.uint64


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            fill = lambda b: np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, b, _U), dtype=_U)])
            self.up, self.down = fill(self.base), fill(self.inverse)
        return self.up[:n], self.down[:n]


_FIRST, _SECOND, _THIRD, _SALT = _Powers(_BASE | 1), _Powers(0xC2B2AE3D27D4EB4F | 1), _Powers(0x165667B19E3779F9), 0x27D4EB2F165667C5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Rolling:
    """Hashes of any spans of a word sequence, from prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray, powers: _Powers) -> None:
        up, self.down = powers.to(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[:-1], dtype=_U, out=self.sums[1:])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def anchors(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: row, first and last window (places in the whole), h and c of every anchor's stretch."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    n = len(words)
    if n < WIDTH:
        return none
    hashes = Rolling(words, _FIRST)
    at = np.arange(n - GRAM + 1)
    gram = hashes.span(at, at + GRAM)
    low = (gram >> _U(PLACE_BITS) << _U(PLACE_BITS)) | at.astype(_U)
    least, step, need = low, 1, WIDTH - GRAM + 1
    while 2 * step <= need:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < need:
        least = np.minimum(least[: len(least) - (need - step)], least[need - step :])
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + WIDTH <= offsets[1:][row])  # windows within one document
    if not len(starts):
        return none
    place = (least[starts] & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[starts][1:] != row[starts][:-1])])
    head = np.flatnonzero(new)
    first, last, place = starts[head], starts[np.concatenate([head[1:], [len(starts)]]) - 1], place[head]
    c = mixed(hashes.span(first, last + WIDTH) ^ ((last - first).astype(_U) << _U(8)) ^ (place - first).astype(_U))
    return row[first], first, last, gram[place], c


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and offsets of a column of lists without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(_U), offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch], words: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches' rows, so that no slice has more than so many words, or it is one row."""
    for batch in batches:
        ends, at = batch.column("words").offsets.to_numpy().astype(np.int64), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + words, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_of("substring_dedup")
    for batch in _slices(batches):
        words, offsets = _flat(batch.column("words"))
        row, first, last, h, c = anchors(words, offsets)
        base = offsets[:-1][row]
        yield pa.RecordBatch.from_arrays(
            [batch.column("did").take(pa.array(row)), batch.column("tk").take(pa.array(row)), batch.column("part").take(pa.array(row)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
            names=["did", "tk", "part", "i1", "i2", "h", "c"],
        )


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (did, tk, words, spans: list of (i1, i2, n)) to the span's windows, one by one, or where n is 0 to the span as a whole.

    start and stop are the first and last window; w1 and w2 hash the words from the former's first to the latter's last.
    """
    worker_of("substring_dedup")
    for batch in _slices(batches):
        words, offsets = _flat(batch.column("words"))
        spans = batch.column("spans")
        counts = np.diff(spans.offsets.to_numpy())
        i1, i2, n = (spans.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("i1", "i2", "n"))
        row = np.repeat(np.arange(len(counts)), counts)
        rows = np.where(n > 0, i2 - i1 + 1, 1)
        which = np.repeat(np.arange(len(row)), rows)
        start = i1[which] + np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
        stop = np.where(n[which] > 0, start, i2[which])
        base = offsets[:-1][row[which]]
        first, last = start + base, stop + base + WIDTH
        w1 = Rolling(mixed(words ^ _U(_SALT)), _THIRD).span(first, last)
        w2 = Rolling(mixed(words), _SECOND).span(first, last)
        at = pa.array(row[which])
        yield pa.RecordBatch.from_arrays(
            [batch.column("did").take(at), batch.column("tk").take(at), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(n[which]), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))],
            names=["did", "tk", "start", "stop", "n", "w1", "w2"],
        )


class FingerprintIndex:
    """Immutable sorted runs (h, c, n, first) in levels; first is a document that holds the stretch, null where an older run names it."""

    def __init__(self, scratch: Scratch, fanout: int = 3) -> None:
        self.scratch, self.fanout, self.levels = scratch, fanout, [[]]

    def append(self, batch: DataFrame) -> None:
        """batch: a row (h, c, did) for each stretch."""
        keys = batch.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first"))
        if runs := self.runs():
            # What the history knows already adds its count only.
            known = _union(runs).filter("first is not null").select("h", "c", F.lit(True).alias("known"))
            keys = keys.join(known, ["h", "c"], "left").withColumn("first", F.when(F.col("known").isNull(), F.col("first"))).drop("known")
        self._add(keys, 0)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _add(self, keys: DataFrame, level: int) -> None:
        run = self.scratch.write(keys.select("h", "c", "n", "first").sortWithinPartitions("h", "c"), f"run{level}")
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(self._merged(old), level + 1)
            self.scratch.drop(*old)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return runs[0] if len(runs) == 1 else _union(runs).groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def compacted(self) -> DataFrame:
        if len(runs := self.runs()) > 1:
            self.levels = [[]] * len(self.levels) + [[self.scratch.write(self._merged(runs).sortWithinPartitions("h", "c"), "run")]]
            self.scratch.drop(*runs)
        return self.runs()[0]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with did and tk: the doc_id (null as the least long) and a hash of the text, which tell rows apart that share a doc_id."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("tk", F.hash(text_of()))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.transform(words_of(text_of()), lambda w: F.xxhash64(w)))


def repeated_stretches(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(did, tk, spans): for each document with repeated windows, the ranges (i1, i2) of their starts."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    keyed = _keyed(docs.select("doc_id", "text"))
    parts = keyed.withColumn("part", F.pmod(F.hash("did", "tk"), F.lit(batches)))
    hashed = _hashed(parts).select(*KEY, "part", "words")
    places = scratch.write(hashed.mapInArrow(_anchor_batches, "did long, tk int, part int, i1 int, i2 int, h long, c long"), "stretches", "part")
    index = FingerprintIndex(scratch)
    for part in range(batches):
        index.append(places.filter(F.col("part") == part).select("h", "c", "did"))
    book = index.compacted()

    # One join marks the stretches: those repeated as a whole, and one of each kind of those whose anchor has several kinds.
    several = book.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h", F.lit(True).alias("several"))
    marked = book.join(several, "h", "left").filter("n > 1 or several").withColumn("several", F.coalesce("several", F.lit(False)))
    hits = places.join(marked, ["h", "c"]).select(*KEY, "i1", "i2", "n", (F.col("several") & (F.col("did") == F.col("first"))).alias("asked"))
    hits = scratch.write(hits, "hits")
    scratch.drop(places, *index.runs())
    # A span with n = 0 is to be verified as a whole, with the windows of the others.
    span = lambda n: F.struct("i1", "i2", n.cast("long").alias("n"))
    spans = F.array_compact(F.array(F.when(F.col("n") > 1, span(F.lit(0))), F.when(F.col("asked"), span(F.col("n")))))
    asked = hits.select(*KEY, F.explode(spans).alias("span")).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))
    texts = keyed.join(asked, KEY).dropDuplicates(KEY)
    windows = _hashed(texts).select(*KEY, "spans", "words").mapInArrow(_window_batches, "did long, tk int, start int, stop int, n long, w1 long, w2 long")
    windows = scratch.write(windows, "windows")
    scratch.drop(hits)
    again = windows.groupBy((F.col("n") == 0).alias("whole"), "w1", "w2").agg(F.sum(F.greatest("n", F.lit(1))).alias("total")).filter("total > 1").drop("total")
    # Written, so that the join has plain shuffles on both sides and Spark can split the places of a very common stretch.
    again = scratch.write(again, "again")
    repeated = windows.filter("n < 2").withColumn("whole", F.col("n") == 0).join(again, ["whole", "w1", "w2"]).select(*KEY, F.col("start").alias("i1"), F.col("stop").alias("i2"))
    return repeated.groupBy(*KEY).agg(F.collect_list(F.struct("i1", "i2")).alias("spans"))


def _kept(text: str, spans) -> tuple[int, int, bytes]:
    words = text.encode("utf-8").split()  # bytes.split() splits at the six ASCII blanks alone
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["i1"] for s in spans], 1)
    np.add.at(edge, [s["i2"] + WIDTH for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def dedup_substrings(docs: DataFrame, batches: int = 3, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs; with_text: all columns of docs, its text replaced by what is left.

    A null or empty text has no words.  Texts below WIDTH words keep all.  A row that repeats another counts as another place, so both
    lose their windows.  An empty table gives an empty table.
    """
    spans = repeated_stretches(docs, batches)
    if with_text:
        # The other columns travel under names of our own, so that theirs can't clash.
        order = docs.columns
        names = {x: f"c{i}" for i, x in enumerate(order) if x != "text"}
        base = docs.select("doc_id", "text", *[F.col(f"`{x}`").alias(n) for x, n in names.items()])

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_of("substring_dedup")
            for batch in batches:
                texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
                new = pa.array([None if t is None else _kept(t, s)[2].decode("utf-8") for t, s in zip(texts, spans, strict=True)], batch.schema.field("text").type)
                yield pa.RecordBatch.from_arrays([batch.column(names[x]) if x in names else new for x in order], names=order)

        return _keyed(base).join(spans, KEY, "left").select("text", "spans", *names.values()).mapInArrow(rewrite, docs.schema)

    joined = _keyed(docs.select("doc_id", "text")).join(spans, KEY, "left").drop(*KEY)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_of("substring_dedup")
        for df in frames:
            got = [_kept(t, s) for t, s in zip(df["text"], df["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_words": [x[0] for x in got], "n_removed": [x[1] for x in got], "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in got]})

    return joined.select(F.col("doc_id").cast("long"), text_of().alias("text"), "spans").mapInPandas(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM d WHERE len(words) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS g FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(c.gone), 0) AS n_removed,
             CASE WHEN c.gone IS NULL THEN d.words ELSE list_filter(d.words, lambda w, i: NOT list_contains(c.gone, i)) END AS kept
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. A document's shingles are its runs of five words (lower-cased, without punctuation at the ends); a shingle's weight is its count in
   the document times 1 + ln(documents / documents that hold it).  Frequencies are exact for each shingle that a share of RARE of the
   documents holds, or more; all rarer ones weigh as if that share held them.  So the table of frequencies has at most 1 / RARE entries
   times the mean number of a document's shingles, at any size of the corpus.  It takes two passes: each task counts lossily what it can't
   prove to be rare, and what may reach the share in the sum is then counted exactly.
2. Ioffe's improved consistent weighted sampling draws SAMPLES samples (shingle, level) of each document; two documents share a sample
   with the probability of their weighted Jaccard similarity.
3. ROWS samples make a band.  Members of a bucket are laid in the order of the band and the following samples, and each is paired with
   its predecessor and with the bucket's first member: pairs are at most two a member, in an order that puts similar ones together.
   The order is a range partitioning, so a bucket of any size is spread over tasks; the last row before a task's first is passed on.
4. Pairs whose samples agree enough are verified by the exact weighted Jaccard similarity of their texts; verified pairs and equal word
   sequences make the classes, which are connected components.
5. A bucket of three or more in which several classes are left may hold pairs that step 3 didn't lay side by side.  Their members are
   joined by an exact prefix filter: with shingles in ascending order of the members that hold them, two documents of similarity t or
   more share one among the first of each, those before which less than 1 - t of its weight lies; and at the first that they share, what
   lies from there on bounds what they share.  What only one member or one class holds falls away, and that is what tells the documents
   of a template apart; so a busy bucket costs the pairs that may be similar by these bounds, not all its pairs.  Pairs across classes
   are found block by block, so that a frequent shingle is spread over tasks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_rows, text_of, worker_of
from .components import connected
from .substring_dedup import mixed

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, ROWS = 42, 3
BANDS = SAMPLES // ROWS
#: Pairs whose share of equal samples is below this part of the threshold aren't verified: at similarity 0.8, 1 in 19,000.
LEAST_AGREEMENT = 0.66
#: Shingles that a smaller share (1 / RARE) of the documents holds weigh alike.
RARE = 1024
#: Members that hold a shingle, in a block whose samples are compared with those of another block.
BLOCK = 1024
#: Documents that a task counts at least, where there are as many; shingles that it holds back until it sorts them.
COUNTED, HELD = 1 << 14, 1 << 21
#: Entries of each table of random variates; samples draw on them by independent hashes.
POOL = 1 << 16
#: Rows, with their texts, that are handed to Python at once.
HANDED = 2048
#: Characters that are split into words at once.
CHARACTERS = 1 << 16
_U = np.uint64
_BLANK = re.compile(r"\s")
#: Characters whose lower case isn't one character, or depends on what stands beside them.
_ODD = re.compile("[\u0130\u03a3]")


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 0 if it is white space, 2 if a letter or digit, else 1; and a hash of its lower case."""
    kind, lower = np.ones(0x110000, np.uint8), np.arange(0x110000)
    for i, c in enumerate(map(chr, range(0x110000))):
        if c.isalnum():
            kind[i] = 2
        elif c.isspace():
            kind[i] = 0
        small = c.lower()
        if small != c and len(small) == 1:
            lower[i] = ord(small)
    return kind, mixed(lower.astype(_U) + _U(0x632BE59BD9B4E019))


def _factors(places: np.ndarray) -> np.ndarray:
    """A random odd factor of each place in a word."""
    return mixed(places.astype(_U) * _U(2) + _U(0x9E3779B97F4A7C15)) | _U(1)


@functools.lru_cache(maxsize=1)
def _first_factors() -> np.ndarray:
    return _factors(np.arange(4 * CHARACTERS))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _long_words(piece: str) -> np.ndarray:
    """What words_in() gives, word by word, with no more than some characters of a word in arrays at once."""
    out, hashes = [], _characters()[1]
    for word in piece.split():
        first = next((i for i, c in enumerate(word) if c.isalnum()), -1)
        if first >= 0:
            stop = next(i for i in range(len(word), 0, -1) if word[i - 1].isalnum())
            total = _U((stop - first))
            for at in range(first, stop, CHARACTERS):
                code = _codes(word[at : min(stop, at + CHARACTERS)])
                total = np.add(total, np.sum(hashes[code] * _factors(np.arange(len(code)) + (at - first)), dtype=_U), dtype=_U)
            out.append(total)
    return mixed(np.array(out, _U))


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of texts of some CHARACTERS in all, and their rows; a longer text comes in pieces cut at white space."""
    group, rows, n = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _BLANK.search(text, at + CHARACTERS) if len(text) - at > CHARACTERS else None
            stop = cut.start() if cut else len(text)
            piece, at = text[at:stop], stop
            piece = piece.lower() if _ODD.search(piece) else piece
            if group and len(piece) > CHARACTERS:
                yield group, rows
                group, rows, n = [], [], 0
            group.append(piece)
            rows.append(i)
            n += len(piece)
            if n >= CHARACTERS:
                yield group, rows
                group, rows, n = [], [], 0
    if group:
        yield group, rows


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, lower-cased and without punctuation at the ends, in order; each text's number of words.

    What is punctuation alone is no word.  A hash is the sum of the characters' hashes times factors of their places, mixed.
    """
    kinds, hashes = _characters()
    found, lengths = [np.zeros(0, _U)], np.zeros(len(texts), np.int64)
    for group, rows in _pieces(texts):
        if len(group[0]) > 2 * CHARACTERS:
            found.append(_long_words(group[0]))
            lengths[rows[0]] += len(found[-1])
            continue
        code = _codes(" ".join(group))
        kind = kinds[code]
        at = np.flatnonzero(kind == 2)
        if not len(at):
            continue
        # Letters and digits with white space between them lie in different words.
        run = np.cumsum(kind == 0, dtype=np.int32)[at]
        new = np.flatnonzero(run[1:] != run[:-1])
        start, stop = at[np.concatenate([[0], new + 1])], at[np.concatenate([new, [len(at) - 1]])] + 1
        size = stop - start
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        value = hashes[code[place + np.repeat(start, size)]] * _first_factors()[place]
        found.append(mixed(np.add.reduceat(value, ends - size) + size.astype(_U)))
        begins = np.cumsum([0, *(len(x) + 1 for x in group)])
        np.add.at(lengths, rows, np.diff(np.searchsorted(start, begins)))
    return np.concatenate(found), lengths


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: row and 56-bit hash of each run of five words, in order; the words' hashes and each text's number of them.

    A text of one to four words has one run, all its words; one of no words has none.
    """
    words, lengths = words_in(texts)
    n = len(words)
    firsts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(texts)), lengths)
    value = np.full(n, 0x51ED270B7A14D5A7, _U)
    padded = np.concatenate([words, np.zeros(SHINGLE, _U)])
    for k in range(SHINGLE):
        value = mixed(value * _U(31) + padded[k : k + n])
    whole = np.arange(n) - firsts[row] <= lengths[row] - SHINGLE if n else np.zeros(0, bool)
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        short = _U(0x51ED270B7A14D5A7)
        with np.errstate(over="ignore"):
            for word in words[firsts[i] : firsts[i] + lengths[i]]:
                short = mixed(short * _U(31) + word)
        value[firsts[i]], whole[firsts[i]] = short, True
    return row[whole], value[whole] >> _U(8), words, lengths


def shingled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: row, hash and count of each document's distinct shingles (by row, then hash); two fingerprints of each word sequence.

    A text without words has no shingle, and fingerprint 0.
    """
    row, value, words, lengths = runs(texts)
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    # The sequence's fingerprints are sums of its words' hashes mixed with their places.
    place = (np.arange(len(words)) - np.repeat(firsts, lengths)).astype(_U)
    prints = []
    for salt in (_U(0x632BE59BD9B4E019), _U(0xD6E8FEB86659FD93)):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(words * salt + mixed(place + salt)), dtype=_U)])
        prints.append(np.where(lengths > 0, mixed(sums[ends] - sums[firsts] + lengths.astype(_U)), _U(0)))
    if len(texts) <= 256:  # row and hash make one number
        both = np.sort(row.astype(_U) << _U(56) | value)
        row, value = (both >> _U(56)).astype(np.int64), both & _U((1 << 56) - 1)
    else:
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[head], value[head], np.diff(np.concatenate([head, [len(row)]])), prints[0], prints[1]


@dataclass
class Frequencies:
    """Documents with shingles, and the frequent shingles (sorted) with the number of documents that hold each."""

    n_docs: int
    shingles: np.ndarray
    counts: np.ndarray


class LossyCounts:
    """Lossy counting: after ``prune`` holds each shingle that a share of 1 / (8 * RARE) of the documents so far holds, or more.

    ``most`` bounds a shingle's documents from above: its places seen, and what may have been dropped before.
    """

    def __init__(self) -> None:
        self.shingles, self.most, self.n_docs, self.missed, self.held, self.n_held = np.zeros(0, _U), np.zeros(0, np.int64), 0, 0, [], 0

    def add(self, shingles: np.ndarray, n_docs: int) -> None:
        """shingles: those of n_docs documents."""
        self.held.append(shingles)
        self.n_docs, self.n_held = self.n_docs + n_docs, self.n_held + len(shingles)
        if self.n_held >= HELD:
            self.prune()

    def prune(self) -> None:
        new, count = np.unique(np.concatenate([self.shingles[:0], *self.held]), return_counts=True)
        at, known = _looked_up(self.shingles, new)
        self.most[at[known]] += count[known]
        shingles = np.concatenate([self.shingles, new[~known]])
        most = np.concatenate([self.most, count[~known] + self.missed])
        keep = most * 8 * RARE >= self.n_docs
        shingles, most = shingles[keep], most[keep]
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.most = shingles[order], most[order]
        self.missed, self.held, self.n_held = -(-self.n_docs // (8 * RARE)) - 1, [], 0

    def reported(self) -> tuple[np.ndarray, np.ndarray]:
        """The shingles that may reach a share of 1 / (4 * RARE), and ``most``."""
        self.prune()
        keep = self.most * 4 * RARE >= self.n_docs
        return self.shingles[keep], self.most[keep]


def _blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    worker_of("near_dedup", _forget)
    for df in frames:
        for at in range(0, len(df), 256):
            yield df.iloc[at : at + 256]


def frequencies(docs: DataFrame) -> Frequencies:
    """Exact document frequencies, over all rows, of the shingles that at least 1 / RARE of the documents, and two, hold."""
    texts, scratch = docs.select(text_of().alias("text")), Scratch(docs.sparkSession, "frequencies")

    def lossy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = LossyCounts()
        for part in _blocks_of(frames):
            _, value, _, lengths = runs(part["text"].tolist())
            counts.add(value, int((lengths > 0).sum()))
        shingles, most = counts.reported()
        # A shingle that isn't given is held by less than n_docs / (4 * RARE) of the task's documents.
        yield pd.DataFrame({"shingle": shingles.view(np.int64), "excess": most * 4 * RARE - counts.n_docs})
        yield pd.DataFrame({"shingle": [None], "excess": [counts.n_docs]}).astype({"shingle": "Int64"})

    # Tasks of few documents could prove nothing rare.
    tasks = max(1, docs.count() // COUNTED)
    found = scratch.write(texts.coalesce(tasks).mapInPandas(lossy, "shingle long, excess long").groupBy("shingle").agg(F.sum("excess").alias("excess")), "lossy")
    n_docs = int((found.filter("shingle is null").first() or {"excess": 0})["excess"])
    # The upper bound of the sum reaches n_docs / RARE; that holds for at most 4 / 3 * RARE times the mean number of shingles.
    asked = np.sort(found.filter(F.col("shingle").isNotNull() & (F.col("excess") >= 3 * n_docs)).select("shingle").toArrow()["shingle"].to_numpy().view(_U))
    scratch.drop(found)

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(asked), np.int64)
        for part in _blocks_of(frames):
            row, value, *_ = runs(part["text"].tolist())
            at, known = _looked_up(asked, value)
            once = np.unique(row[known] * len(asked) + at[known])  # a document counts once
            counts += np.bincount(once % len(asked), minlength=len(asked))
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"at": used, "n": counts[used]})

    if not len(asked):
        return Frequencies(n_docs, asked, np.zeros(0, np.int64))
    got = texts.mapInPandas(exact, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.col("n") * RARE >= n_docs)).toArrow().sort_by("at")
    return Frequencies(n_docs, asked[got["at"].to_numpy()], got["n"].to_numpy())


def _looked_up(table: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the shingle is there."""
    if not len(table):
        return np.zeros(len(shingles), np.int64), np.zeros(len(shingles), bool)
    at = np.minimum(np.searchsorted(table, shingles), len(table) - 1)
    return at, table[at] == shingles


def weights(shingles: np.ndarray, counts: np.ndarray, known: Frequencies) -> np.ndarray:
    at, frequent = _looked_up(known.shingles, shingles)
    share = np.full(len(shingles), max(1 / RARE, 1 / max(known.n_docs, 1)))
    share[frequent] = known.counts[at[frequent]] / known.n_docs
    return counts * (1 - np.log(share))


@functools.lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), beta ~ Uniform(0, 1), ln c with c ~ Gamma(2, 1); the same in every process."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    draw = lambda: -np.log(1 - rng.random(POOL)) - np.log(1 - rng.random(POOL))
    return draw().astype(np.float32), rng.random(POOL).astype(np.float32), np.log(draw()).astype(np.float32)


def _levels(log_w: np.ndarray | np.float32, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.floor(log_w / r + beta)


def _drawn(log_w: np.ndarray | np.float32, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """What is added to ln c."""
    return -r * (_levels(log_w, r, beta) - beta) - r


@functools.lru_cache(maxsize=8)
def _drawn_by(log_w: np.float32) -> np.ndarray:
    r, beta, _ = _variates()
    return _drawn(log_w, r, beta)


def _forget() -> None:
    for kept in (_characters, _first_factors, _variates, _drawn_by):
        kept.cache_clear()


def samples(row: np.ndarray, shingles: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x SAMPLES: a hash of each sample (shingle, level); 0 in rows without shingles.

    Most shingles weigh alike; what is drawn for that weight is looked up.
    """
    out = np.zeros((n_rows, SAMPLES), np.int32)
    if not len(row):
        return out
    r, beta, log_c = _variates()
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    here = row[head]
    lengths = np.diff(np.concatenate([head, [len(row)]]))
    log_w = np.log(weight).astype(np.float32)
    usual = np.partition(log_w, len(log_w) // 2)[len(log_w) // 2]
    other = np.flatnonzero(log_w != usual)
    table, log_other = _drawn_by(usual), log_w[other]
    for k in range(SAMPLES):
        seed = mixed(np.array([k + 1], _U))[0] | _U(1)
        # Two 16-bit places of the product, one for r and beta and one for c, so that two shingles hardly ever draw the same.
        product = shingles * seed
        at, at_c = (product >> _U(48)).view(np.int64), (product >> _U(16) & _U(POOL - 1)).view(np.int64)
        log_a = table[at]
        log_a[other] = _drawn(log_other, r[at[other]], beta[at[other]])
        log_a += log_c[at_c]
        hits = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, head), lengths))
        hit_rows = row[hits]
        first = hits[np.concatenate([[True], hit_rows[1:] != hit_rows[:-1]])]
        level = _levels(log_w[first], r[at[first]], beta[at[first]])
        out[here, k] = (mixed(shingles[first] ^ mixed(level.astype(np.int64).view(_U) + seed)) >> _U(33)).astype(np.int32)
    return out


def signatures(docs: DataFrame, known: Frequencies) -> DataFrame:
    """(doc_id, h, f1, f2, sig): the text's hash, the word sequence's fingerprints and the samples of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks_of(frames):
            row, value, count, f1, f2 = shingled(part["text"].tolist())
            sig = samples(row, value, weights(value, count, known), len(part))
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "f1": f1.view(np.int64), "f2": f2.view(np.int64), "sig": list(sig)})

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id long, h long, f1 long, f2 long, sig array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, ...): pairs (a, b, edge null) of each row with its predecessor and its bucket's first row, in this task.

    edge: the task's first and last rows, as (bucket, id, task, 0 or 1), for the pairs across tasks.
    """
    task = TaskContext.get().partitionId()
    names = ["a", "b", "bucket", "task", "side"]
    none = lambda n, kind: pa.nulls(n, kind)
    head = tail = lead = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ident = batch.column("bucket").to_numpy(), batch.column("id").to_numpy()
        if head is None:
            head = (bucket[0], ident[0])
        new = np.concatenate([[tail is None or tail[0] != bucket[0]], bucket[1:] != bucket[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), -1))
        first = np.where(at >= 0, ident[np.maximum(at, 0)], lead if lead is not None else 0)
        before = np.concatenate([[ident[0] if tail is None else tail[1]], ident[:-1]])
        same = ~new
        a, b = np.concatenate([before[same], first[same]]), np.concatenate([ident[same], ident[same]])
        tail, lead = (bucket[-1], ident[-1]), first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), pa.int32())], names=names)
    if head is not None:
        rows = [(head, 0), (tail, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[0][1]) for r in rows]), none(2, pa.int64()), pa.array([int(r[0][0]) for r in rows]), pa.array([task, task], pa.int32()), pa.array([r[1] for r in rows], pa.int32())], names=names)


def candidates(scratch: Scratch, heads: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of ids of heads (id, sig) that lie next to each other, or with the first, in a bucket of some band."""
    bands = []
    for k in range(BANDS):
        at = [F.col("sig")[(ROWS * k + j) % SAMPLES] for j in range(ROWS + 4)]
        order = [F.shiftleft(at[ROWS + j].cast("long"), 32).bitwiseOR(at[ROWS + j + 1].cast("long")) for j in (0, 2)]
        bands.append(F.struct(F.xxhash64(F.lit(k), *at[:ROWS]).alias("bucket"), order[0].alias("o1"), order[1].alias("o2")))
    rows = heads.select("id", F.explode(F.array(*bands)).alias("x")).select("x.bucket", "x.o1", "x.o2", "id")
    rows = scratch.write(rows, "bands")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = rows.repartitionByRange(parts, "bucket", "o1", "o2", "id").sortWithinPartitions("bucket", "o1", "o2", "id")
    found = scratch.write(laid.mapInArrow(_neighbours, "a long, b long, bucket long, task int, side int"), "laid")
    scratch.drop(rows)
    edges = found.filter("side is not null").select("a", "bucket", "task", "side")  # two rows a task
    ends, starts = edges.filter("side = 1").drop("side"), edges.filter("side = 0").select(F.col("a").alias("b"), "bucket", "task")
    nearest = starts.join(ends.withColumnRenamed("task", "before"), "bucket").filter("before < task").groupBy("b", "bucket", "task").agg(F.max_by("a", "before").alias("a"))
    pairs = found.filter("side is null").select("a", "b").unionByName(nearest.select("a", "b"))
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _agreeing(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shingle, l, r), two blocks a group, to the pairs (a, b, agree) across classes of a left and a right row that agree enough.

    Two rows outside the shingle's largest class meet on both sides, and count once.
    """

    def pairs(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ident, label, side, largest, total, rest, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
        right = np.flatnonzero(side == 1)
        for left in np.split(lefts := np.flatnonzero(side == 0), range(256, len(lefts), 256)):
            agree = np.zeros((len(left), len(right)), np.int8)
            for k in range(SAMPLES):
                agree += sig[left, k][:, None] == sig[right, k]
            # At the first shingle that two share, they share no more than what lies from there on in either.
            shared = np.minimum(rest[left][:, None], rest[right])
            near = shared >= threshold / (1 + threshold) * (1 - 1e-9) * (total[left][:, None] + total[right])
            hit = near & (agree >= LEAST_AGREEMENT * threshold * SAMPLES) & (label[left][:, None] != label[right]) & (largest[right] | (ident[left][:, None] < ident[right]))
            i, j = np.nonzero(hit)
            a, b = ident[left[i]], ident[right[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree[i, j].astype(np.int32))], names=["a", "b", "agree"])

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "l", "r")], 1)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "class", "side", "largest", "total", "rest")]
        columns.append(batch.column("sig").flatten().to_numpy().reshape(-1, SAMPLES))
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for at, stop in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[at]) != key:
                yield from pairs(held)
                held = []
            key = tuple(keys[at])
            held.append(tuple(c[at:stop] for c in columns))
    if held:
        yield from pairs(held)


def busy_members(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """(id): heads (id, sig) in a bucket of three or more that holds several classes (id, class); candidates() has the pair of a bucket of two."""
    bands = [F.xxhash64(F.lit(k), *[F.col("sig")[ROWS * k + j] for j in range(ROWS)]) for k in range(BANDS)]
    rows = heads.join(labels, "id").select("id", "class", F.explode(F.array(*bands)).alias("bucket"))
    facts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
    return rows.join(facts.filter("n > 2 and least <> most").select("bucket"), "bucket").select("id").distinct()


def prefixes(scratch: Scratch, texts: DataFrame, known: Frequencies, threshold: float) -> DataFrame:
    """(id, shingle, total, rest): of documents (doc_id, text), the shingles of the prefix filter that several of them hold, the document's
    weight, and the weight of the shingle and all after it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks_of(frames):
            row, value, count, *_ = shingled(part["text"].tolist())
            yield pd.DataFrame({"id": part["doc_id"].to_numpy()[row], "shingle": value.view(np.int64), "w": weights(value, count, known)})

    rows = scratch.write(texts.select("doc_id", text_of().alias("text")).mapInPandas(run, "id long, shingle long, w double"), "shingles")
    rows = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle")
    whole = Window.partitionBy("id")
    rest = whole.orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("id", "shingle", "n", F.sum("w").over(whole).alias("total"), F.sum("w").over(rest).alias("rest"))
    return rows.filter((F.col("rest") >= F.col("total") * threshold * (1 - 1e-9)) & (F.col("n") > 1)).select("id", "shingle", "total", "rest")


def across_classes(scratch: Scratch, held: DataFrame, heads: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, agree), a < b: every pair of rows (id, shingle, total, rest) that shares a shingle, agrees enough and lies across two classes (id, class).

    A shingle's rows outside its largest class are cut into blocks, as are all its rows; each of the former blocks meets each of the
    latter, by a join key of its own.
    """
    rows = held.join(labels, "id")
    each = rows.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n"))
    facts = each.groupBy("shingle").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("class", F.struct("n", "class")).alias("first"), F.count(F.lit(1)).alias("classes"))
    facts = scratch.write(facts.filter("classes > 1").drop("classes"), "shared")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    met = rows.join(facts, "shingle").withColumn("lefts", blocks(F.col("n") - F.col("most"))).withColumn("rights", blocks(F.col("n"))).withColumn("largest", F.col("class") == F.col("first"))
    own = lambda n: F.pmod(F.xxhash64("id", "shingle"), F.col(n)).cast("int")
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda x: F.struct(x.alias("l"), own("rights").alias("r"), F.lit(1).alias("side")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda x: F.struct(own("lefts").alias("l"), x.alias("r"), F.lit(0).alias("side")))
    met = met.join(heads, "id").select("shingle", "id", "class", "largest", "total", "rest", "sig", F.explode(F.concat(as_right, F.filter(as_left, lambda _: ~F.col("largest")))).alias("x"))
    met = met.select("shingle", "x.l", "x.r", "id", "class", "x.side", "largest", "total", "rest", "sig")
    found = met.repartition("shingle", "l", "r").sortWithinPartitions("shingle", "l", "r").mapInArrow(lambda batches: _agreeing(batches, threshold), "a long, b long, agree int")
    return found.distinct()


def similarity(known: Frequencies):
    """A mapInPandas function: (a, b, left, right) to (a, b, similarity), the exact weighted Jaccard similarity of two texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_of("near_dedup", _forget)
        for df in frames:
            for at in range(0, len(df), 128):
                part = df.iloc[at : at + 128]
                n = len(part)
                row, value, count, *_ = shingled(part["left"].tolist() + part["right"].tolist())
                weight = weights(value, count, known)
                pair, side = row % n, row // n
                order = np.lexsort((side, value, pair))
                pair, value, weight = pair[order], value[order], weight[order]
                total = np.bincount(pair, weight, n)
                both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
                shared = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), n)
                yield pd.DataFrame({"a": part["a"].to_numpy(), "b": part["b"].to_numpy(), "similarity": shared / np.maximum(total - shared, 1e-12)})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id), a row for each distinct doc_id; class_id is the least doc_id of the class.

    Documents without words (null, empty or punctuation alone) are classes of their own.  Of several texts of one doc_id that with the
    least hash counts; a null doc_id takes no part.  An empty table gives an empty table.
    """
    with arrow_rows(docs.sparkSession, HANDED):  # no Python runs in the plan that is returned
        return _classes(docs, threshold)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    known = frequencies(docs)
    signed = scratch.write(signatures(docs, known), "signatures")
    # One text a doc_id; then one head for equal word sequences, on which the other members hang.
    repeated = signed.groupBy("doc_id").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"), "least")
    repeated = scratch.write(repeated, "repeated")
    single = signed.join(repeated, F.col("doc_id") == F.col("again"), "left").filter("f1 <> 0 and (least is null or h = least)")
    heads = scratch.write(single.groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").alias("id"), "sig")).alias("head")).select("f1", "f2", "head.id", "head.sig"), "heads")
    copies = single.join(heads.select("f1", "f2", "id"), ["f1", "f2"]).filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct()
    copies = scratch.write(copies, "copies")
    sig = heads.select("id", "sig")

    def texts_of(ids: DataFrame) -> DataFrame:
        # A merge join at every size: ids that happen to be few would be broadcast, and the plan's needs would jump once they are not.
        rows = docs.select("doc_id", text_of().alias("text")).join(ids.hint("merge"), "doc_id", "left_semi")
        return scratch.write(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")

    def labelled(classes: DataFrame) -> DataFrame:
        every = sig.select("id").join(classes.select(F.col("u").alias("id"), "v"), "id", "left")
        return scratch.write(every.select("id", F.coalesce("v", "id").alias("class")), "labels")

    def joined(classes: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
        """The classes with the pairs (a, b) that are similar."""
        left, right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
        both = asked.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "left", "right")
        checked = both.mapInPandas(similarity(known), "a long, b long, similarity double")
        links = scratch.write(checked.filter(F.col("similarity") >= threshold).select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
        return classes if links.isEmpty() else connected(scratch, classes.unionByName(links))

    def settled(classes: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The classes when each of the pairs has been verified or lies within a class: the most alike pair of each document goes first."""
        best = scratch.write(pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b"), "best")
        classes = joined(classes, best, texts)
        labels = labelled(classes)
        label = lambda side: labels.select(F.col("id").alias(side), F.col("class").alias(f"{side}_class"))
        across = pairs.select("a", "b").join(label("a"), "a").join(label("b"), "b").filter("a_class <> b_class")
        return joined(classes, across.join(best, ["a", "b"], "left_anti"), texts)

    near = candidates(scratch, sig)
    equal = F.aggregate(F.zip_with("left", "right", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = near.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("left")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("right")), "b")
    near = scratch.write(near.select("a", "b", equal.alias("agree")).filter(F.col("agree") >= LEAST_AGREEMENT * threshold * SAMPLES), "pairs")
    involved = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    texts = texts_of(involved)
    classes = settled(copies, near, texts)
    scratch.drop(texts)
    # What lies apart in every bucket that it shares.
    labels = labelled(classes)
    busy = scratch.write(busy_members(sig, labels), "busy")
    texts = texts_of(busy.withColumnRenamed("id", "doc_id"))
    held = scratch.write(prefixes(scratch, texts, known, threshold), "prefixes")
    rest = scratch.write(across_classes(scratch, held, sig, labels, threshold).join(near.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        classes = settled(classes, rest, texts)
    every = signed.select("doc_id").distinct()
    return every.join(classes, F.col("doc_id") == F.col("u"), "left").select("doc_id", F.coalesce("v", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, and those without doc_id; all columns kept."""
    classes = near_duplicates(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(classes.hint("merge"), docs["doc_id"] == F.col("__gone"), "left_anti")

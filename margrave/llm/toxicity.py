"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult, threat, target, negation, report or other.  Small transducers rewrite the symbols of a clause, each adding
a mark to those in its scope: a target aims all of the clause (one transducer reads it from either end), a negation marks the next words,
a report what follows it.  The transducers that read forward are composed into one, with the scorer, which emits one of PATHS for each
insult or threat.  Arcs that emit a path carry its weight; a document's score is the logistic of the weighted sum of its paths (as log1p
of their number).  A clause ends at a line's end, and after ``.!?;:``, be they followed by quotation marks or brackets.

Insult stems and the path weights are learned; the closed classes are fixed.  Learning uses a sample of at most ``SAMPLE`` labelled
documents of each label whose crc32(doc_id) mod 3 is not 1, taken in the order of a hash of doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, worker_of

#: Labelled documents of either label that are learned from, at most.
SAMPLE = 6000
#: A stem's least association with label 1 (G squared; with few labels, half of what a perfect stem has) and least share of label 1 among
#: its documents, odds put on equal classes.
LEAST_G2, LEAST_SHARE = 26.0, 0.9
STEM_LENGTHS = (3, 4, 5, 6)
#: What ends a clause, and what may follow that.
ENDS, CLOSING = frozenset(".!?;:"), "\"'»”’)]}*_"

# Closed word classes in the corpus' four languages.
THREATS = frozenset("kill hurt destroy attack murder beat stab shoot töten schlagen umbringen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours they them he she him her du dich dir dein ihr euch sie tu te toi vous ton votre ils elles usted ustedes ellos ellas ti tus".split())
NEGATIONS = frozenset("not no never nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco".split())
REPORTS = frozenset("said says wrote claimed called quoted sagte sagt schrieb behauptete dit écrit affirme dijo dice escribió llamó".split())

#: Kinds of symbols, as bits of what a run of non-blanks holds.
INSULT, THREAT, TARGET, NEGATION, REPORT, END = 1, 2, 4, 8, 16, 32
OTHER = 0
#: The order in which a run's own symbols are read.
KINDS = (NEGATION, REPORT, TARGET, THREAT, INSULT)
MARKS = ("negated", "reported", "aimed")
PATHS = tuple(f"{kind}_{mark}" for kind in ("insult", "threat") for mark in ("plain", "aimed", "negated", "reported"))
#: Prior means of the path weights: what a path that no labelled document shows is worth.
PRIOR = np.array([1.5, 1.5, 0.4, 0.4, 0.1, 0.5, 0.05, 0.05])
#: How many words a negation reaches.
SCOPE = 3
WORDS = re.compile(r"[^\W\d_]+")

Symbol = tuple[int, frozenset]


@dataclass(frozen=True)
class Transducer:
    """States 0 (the start), 1, ...; arcs: (state, input) to (state, output)."""

    arcs: dict

    def run(self, symbols: Iterable) -> list:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state, x]
            out.append(y)
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: what other makes of this one's output, over the pairs of states that the start reaches."""
        inputs, number, arcs, todo = {x for _, x in self.arcs}, {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            for x in inputs:
                a2, y = self.arcs[a, x]
                b2, z = other.arcs[b, y]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                arcs[number[pair], x] = number[a2, b2], z
        return Transducer(arcs)


def _symbols(marks: tuple[str, ...]) -> list[Symbol]:
    """All symbols with any of the marks."""
    sets = [frozenset()]
    for m in marks:
        sets += [s | {m} for s in sets]
    return [(kind, s) for kind in (OTHER, *KINDS) for s in sets]


def marker(trigger: int, mark: str, scope: int, marks: tuple[str, ...]) -> Transducer:
    """Marks the symbols after a trigger: the next ``scope`` of them (0: all); the state is how many are left.  marks: those of the input."""
    arcs = {}
    for left in range((scope or 1) + 1):
        for kind, had in _symbols(marks):
            after = (scope or 1) if kind == trigger else left if not scope else max(0, left - 1)
            arcs[left, (kind, had)] = after, (kind, had | {mark} if left else had)
    return Transducer(arcs)


def scorer() -> Transducer:
    """One state: an insult or threat emits its path, by the first of MARKS that it has; all else emits -1."""
    arcs = {}
    for kind, had in _symbols(MARKS):
        mark = next((m for m in MARKS if m in had), "plain")
        arcs[0, (kind, had)] = 0, PATHS.index(f"{'insult' if kind == INSULT else 'threat'}_{mark}") if kind in (INSULT, THREAT) else -1
    return Transducer(arcs)


#: Read backward: what a target follows; then forward, composed.
BACKWARD = marker(TARGET, "aimed", 0, ())
FORWARD = marker(TARGET, "aimed", 0, ("aimed",)).then(marker(NEGATION, "negated", SCOPE, ("aimed",))).then(marker(REPORT, "reported", 0, ("aimed", "negated"))).then(scorer())


@dataclass
class Grammar:
    """The learned parts: stems ("abc" a prefix, "abc$" a whole word), the bias and the path weights."""

    stems: frozenset = frozenset()
    bias: float = -4.0
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    _symbols: dict = field(default_factory=dict, repr=False)

    def symbol(self, chunk: str) -> int:
        """The symbols of a lower-cased run of non-blanks, as bits."""
        found = self._symbols.get(chunk)
        if found is None:
            found = END if chunk.rstrip(CLOSING)[-1:] in ENDS else 0
            for w in WORDS.findall(chunk):
                if any(w[:k] in self.stems for k in STEM_LENGTHS if k <= len(w)) or w + "$" in self.stems:
                    found |= INSULT
                found |= THREAT * (w in THREATS) | TARGET * (w in TARGETS) | NEGATION * (w in NEGATIONS) | REPORT * (w in REPORTS)
            if len(self._symbols) > 500_000:
                self._symbols.clear()
            if len(chunk) <= 64:
                self._symbols[chunk] = found
        return found

    def paths(self, text: str) -> list[int]:
        """How often the transducers take each of PATHS in a text."""
        counts = [0] * len(PATHS)
        text = text.lower()
        if not any(x & (INSULT | THREAT) for x in set(map(self.symbol, text.split()))):
            return counts
        for line in text.split("\n"):
            clause = []
            for x in map(self.symbol, line.split()):
                clause.append(x)
                if x & END:
                    self._clause(clause, counts)
                    clause = []
            self._clause(clause, counts)
        return counts

    @staticmethod
    def _clause(clause: list[int], counts: list[int]) -> None:
        if not any(x & (INSULT | THREAT) for x in clause):
            return
        # A run without symbols is one of kind other, so that a scope counts words.
        kinds = [(kind, frozenset()) for x in clause for kind in [k for k in KINDS if x & k] or [OTHER]]
        aimed = BACKWARD.run(reversed(kinds))[::-1]
        for path in FORWARD.run(aimed):
            if path >= 0:
                counts[path] += 1

    def scores(self, paths: list[list[int]]) -> np.ndarray:
        x = np.log1p(np.asarray(paths, dtype=float).reshape(-1, len(PATHS)))
        return 1 / (1 + np.exp(-(self.bias + x @ self.weights)))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, text) of the sample, a row a doc_id (of several texts, the one that sorts first)."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = [F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.col("doc_id")]
    chosen = usable.filter("y = 1").orderBy(*order).limit(SAMPLE).unionByName(usable.filter("y = 0").orderBy(*order).limit(SAMPLE))
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("y", "text")


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sketch, y, text): the least hash of a document's shingles, which copies mostly share."""
    worker_of("toxicity")
    for batch in batches:
        words = [x.lower().split() for x in batch["text"]]
        yield batch.assign(sketch=np.array([min(hash_of(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words], dtype=np.uint64).view(np.int64))


def _stem_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch (key, positive, total): documents that hold a stem, and with an empty key those read."""
    worker_of("toxicity")
    for batch in batches:
        total, positive = Counter(), Counter()
        for y, text in zip(batch["y"], batch["text"], strict=True):
            words = set(WORDS.findall(text.lower()))
            stems = {w[:k] for w in words for k in STEM_LENGTHS if k <= len(w)} | {w + "$" for w in words} | {""}
            total.update(stems)
            if y:
                positive.update(stems)
        yield pd.DataFrame({"stem": list(total), "positive": [positive[s] for s in total], "total": list(total.values())})


def hash_of(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar learned from labelled documents; without labels of both kinds, one without stems, under which all score alike."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(_training(docs, labels), "sample")
    # One document for each sketch, so that groups of copies don't make their words look common.
    single = sample.mapInPandas(_sketched, "y int, text string, sketch long").groupBy("sketch").agg(F.min(F.struct("text", "y")).alias("row")).select("row.*")
    stems = single.mapInPandas(_stem_rows, "stem string, positive long, total long").groupBy("stem").agg(F.sum("positive").alias("a"), F.sum("total").alias("n"))
    stems = scratch.write(stems, "stems")
    base = stems.filter("stem = ''").first()
    if base is None or base["a"] == 0 or base["a"] == base["n"]:
        return Grammar()
    pos, neg = float(base["a"]), float(base["n"] - base["a"])
    a, b = F.col("a"), F.col("n") - F.col("a")
    share = (a / pos) / (a / pos + b / neg)
    part = lambda seen, rate: F.when(seen > 0, seen * F.log(seen / (F.col("n") * rate))).otherwise(0.0)
    g2 = 2 * (part(a, pos / (pos + neg)) + part(b, neg / (pos + neg)))
    least = min(LEAST_G2, pos * math.log((pos + neg) / pos))
    chosen = stems.filter("stem <> ''").filter((g2 >= least) & (share >= LEAST_SHARE)).select("stem").collect()  # of the sample's words
    grammar = Grammar(frozenset(r["stem"] for r in chosen))
    rows = sample.mapInPandas(lambda batches: _path_rows(grammar, batches), "y int, paths array<int>").collect()  # a short row a doc_id of the sample
    scratch.drop(sample, stems)
    grammar.bias, grammar.weights = _logistic(np.log1p(np.array([r["paths"] for r in rows], dtype=float)), np.array([r["y"] for r in rows], dtype=float))
    return grammar


def _path_rows(grammar: Grammar, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    worker_of("toxicity")
    for batch in batches:
        yield pd.DataFrame({"y": batch["y"].astype("int32"), "paths": [grammar.paths(x) for x in batch["text"]]})


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Newton's method on the log-likelihood with a Gaussian prior about PRIOR; weights don't fall below 0.

    The two labels weigh alike, whatever the sample's shares.
    """
    z = np.hstack([np.ones((len(x), 1)), x])
    prior, strength = np.concatenate([[-3.0], PRIOR]), np.array([0.02] + [0.2] * x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (y - p)) - strength * (w - prior)
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(strength), gradient)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, paths for each row of docs; a null or empty text has no paths and gets the bias alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_of("toxicity")
        for batch in batches:
            paths = [grammar.paths(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": grammar.scores(paths), "paths": paths})

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(run, "doc_id long, score double, paths array<int>")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the path counts."""
    out = score(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "paths")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; scored in place, with no shuffle."""
    grammar = fit(docs, labels)
    fields = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_of("toxicity")
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            if texts:
                yield batch.filter(pa.array(grammar.scores([grammar.paths(x) for x in texts]) < threshold))

    return docs.mapInArrow(run, fields)

"""The whole pipeline against plain Python on a small corpus, and over an empty one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from margrave.llm import common, near_dedup, packing, toxicity

from .test_pairs import brute_classes
from .test_texts import ASCII_LOWER, BLANKS, words

CLASSES = [(toxicity.NEGATIONS, "negation"), (toxicity.REPORTS, "report"), (toxicity.TARGETS, "target"), (toxicity.THREATS, "threat")]


def brute_score(text, grammar):
    """The score by looking at each clause's words: what precedes an insult or threat, and whether the clause has a target."""
    counts = Counter()
    for line in (text or "").lower().split("\n"):
        for clause in re.split(r"(?<=[.!?;:])[\"'»”’)\]}*_]*(?=\s|$)", line):
            seen = []
            for chunk in clause.split():
                own = []
                for w in re.findall(r"[^\W\d_]+", chunk):
                    own += [name for group, name in CLASSES if w in group]
                    if any(w.startswith(s) for s in grammar.stems if not s.endswith("$")) or w + "$" in grammar.stems:
                        own.append("insult")
                seen += [k for k in ("negation", "report", "target", "threat", "insult") if k in own] or ["other"]
            for i, kind in enumerate(seen):
                if kind in ("insult", "threat"):
                    mark = "negated" if "negation" in seen[max(0, i - 3) : i] else "reported" if "report" in seen[:i] else "aimed" if "target" in seen else "plain"
                    counts[f"{kind}_{mark}"] += 1
    return 1 / (1 + math.exp(-(grammar.bias + sum(w * math.log1p(counts[p]) for p, w in zip(toxicity.PATHS, grammar.weights, strict=True)))))


def brute_pipeline(rows, grammar):
    rows = [(i, t) for i, t in rows if brute_score(t, grammar) < 0.7]
    key = lambda line: line.strip(BLANKS).translate(ASCII_LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    heavy = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    rows = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not (key(x) in heavy and i < heavy[key(x)]))) for i, t in rows]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    count = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    out = []
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        left = "" if t is None else " ".join(x for k, x in enumerate(w) if k not in gone)
        ids = np.array([*lib.encode(left, add_special_tokens=False).ids, 2], dtype="<u4")
        start = 0
        while start < len(ids):
            length = min(4096, 1 << (len(ids) - start).bit_length() - 1)
            out.append((i, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
            start += length
    return sorted(out), {i for i, _ in rows}


def test_pipeline_equals_brute_force(spark, hard, hard_rows, tmp_path):
    rng = random.Random(4)
    more = [(100 + i, " ".join(rng.choice(["plain", "words", "here", "tree", "stone", "river"]) + str(rng.randrange(50)) for _ in range(40)) + (". you grumfan grumfo grumf." if i % 3 == 0 else ".")) for i in range(90)]
    extra = [F.lit(0).alias(n) for n in hard.columns[2:]]
    docs = hard.unionByName(spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", *extra))
    docs = docs.withColumn("kept", F.lit("mine")).withColumn("did", F.lit("theirs"))
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    grammar = toxicity.fit(docs, labels)
    expected, kept = brute_pipeline([*hard_rows, *more], grammar)
    assert not {100 + i for i in range(0, 90, 3)} & kept and {0, 1, 3, 53} <= kept
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got)) == expected


def test_pipeline_over_an_empty_table(spark, none, tmp_path):
    none.withColumn("n_chars", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_gives_back_what_another_operator_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    common.worker_of("packing", packing.word_ids.cache_clear)
    packing.word_ids(path)("some words")
    common.worker_of("packing", packing.word_ids.cache_clear)
    assert packing.word_ids.cache_info().currsize == 1  # the next task of the same operator
    list(near_dedup._blocks_of(iter([pd.DataFrame({"text": ["a b"]})])))
    assert packing.word_ids.cache_info().currsize == 0


def test_near_dedup_hands_bounded_rows_to_python(spark, monkeypatch):
    handed, most = type(spark.range(0)).mapInPandas, near_dedup.HANDED

    def bounded(self, run, schema, *args, **kwargs):
        def held(frames):
            for df in frames:
                if len(df) > most:
                    raise ValueError(f"{len(df)} rows")
                yield df

        return handed(self, lambda frames: run(held(frames)), schema, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", bounded)
    docs = spark.range(2 * most).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id") % 10).alias("text"))
    assert near_dedup.near_duplicates(docs).select("class_id").distinct().count() == 10

"""Near-duplicates and nearest neighbours against brute force."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from margrave.llm import components, near_dedup, nearest
from margrave.llm.common import Scratch

from .conftest import prose


def brute_classes(rows, threshold=0.8):
    """Classes from all pairs, with shingles, frequencies and weights of its own: the operator's words, as strings."""
    counts = []
    for _, text in rows:
        words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x.lower()) for x in (text or "").split()) if w]
        counts.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    held = Counter(s for c in counts for s in c)
    n = sum(map(bool, counts))
    idf = {s: 1 - math.log(k / n if k > 1 and k * 1024 >= n else max(1 / 1024, 1 / n)) for s, k in held.items()}
    docs = [{s: k * idf[s] for s, k in c.items()} for c in counts]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if docs[a] and docs[b]:
                shared = sum(min(w, docs[b][s]) for s, w in docs[a].items() if s in docs[b])
                if shared / (sum(docs[a].values()) + sum(docs[b].values()) - shared) >= threshold:
                    parent[root(a)] = root(b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return {d: min(g) for g in groups.values() for d in g}


def test_classes(hard, hard_rows):
    expected = brute_classes(hard_rows)
    assert len(set(expected.values())) < len(expected)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(hard).collect()}
    assert got == expected
    kept = near_dedup.keep_one(hard)
    assert kept.columns == hard.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(3)
    base = [f"t{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(120):
        w = list(base)
        w[rng.randrange(150)] = f"new{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(3000)}" for _ in range(80))) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {got[i] for i, _ in rows if i < 1000} == {0} and all(got[i] == i for i, _ in rows if i >= 1000)


def test_rows_without_words_repeated_ids_and_empty_tables(spark, none):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "a b"), (5, "A, b!"), (5, "A, b!"), (None, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect())) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]
    assert sorted((r["doc_id"] or 0) for r in near_dedup.keep_one(df).collect()) == [0, 1, 2, 3, 4]
    assert near_dedup.near_duplicates(none).count() == 0


def test_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(300):
        shingles = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
        left = rng.uniform(0.2, 8, 300)
        right = left * rng.uniform(0.5, 1.5, 300)
        sig = near_dedup.samples(np.repeat([0, 1], 300), np.concatenate([shingles, shingles]), np.concatenate([left, right]), 2)
        gaps.append((sig[0] == sig[1]).mean() - np.minimum(left, right).sum() / np.maximum(left, right).sum())
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.08  # a binomial share of 42 has 0.065


def bare_words(text):
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x.lower()) for x in text.split()) if w]


def test_hashes_of_words_are_those_of_the_plain_rule():
    rng = random.Random(1)
    pool = "aAbB zZ019_-.,!?\t\n\x0b\x1c\x85\xa0äÖßΣσςİıſK…“”’ 中文字ⅣⅠ²Ⓐⓐ\u0307\u3000😀É"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(1000)]
    texts += ["", "...", "x" * 300_000 + " y! Z", "a " * 100_000, "q" * 140_000 + "-" + "Q" * 10, "É" * 150_000, " " * 200_000 + "b", "ab" * 32_768]
    words, lengths = near_dedup.words_in(texts)
    expected = [bare_words(x) for x in texts]
    assert lengths.tolist() == list(map(len, expected))
    pairs = set(zip(sum(expected, []), words.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert near_dedup._long_words("É" * 150_000 + " -ab,").tolist() == near_dedup.words_in(["É" * 150_000, "ab"])[0].tolist()


def test_new_words_cost_less_than_one_by_one():
    texts = [" ".join(f"Word{i}x{j}," for j in range(300)) for i in range(500)]
    near_dedup.runs(["warm"])
    began = time.process_time()
    sum(len(bare_words(x)) for x in texts)
    by_one = time.process_time() - began
    began = time.process_time()
    assert len(near_dedup.runs(texts)[2]) == 150_000
    assert time.process_time() - began < 0.6 * by_one


def test_the_usual_weight_draws_as_any_other():
    shingles = np.sort(np.random.default_rng(2).integers(1, 2**56, 200).astype(np.uint64))
    weight = np.where(np.arange(200) < 190, 7.5, 3.0)
    together = near_dedup.samples(np.zeros(200, int), shingles, weight, 1)
    least = []  # each shingle alone, so that each weight is the usual one; then the row's samples are some of theirs
    for x, w in zip(shingles, weight, strict=True):
        least.append(near_dedup.samples(np.zeros(1, int), np.array([x]), np.array([w]), 1)[0])
    assert all(together[0, k] in {x[k] for x in least} for k in range(near_dedup.SAMPLES))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 199), (199, 200)]
    out = components.connected(Scratch(spark, "test"), spark.createDataFrame(edges, "u long, v long"))
    got = {r["u"]: r["v"] for r in out.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {200: 199}


def brute_nearest(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i in range(len(rows)):
        if ids[i] % every == 0:
            s = x @ x[i]
            s[i] = -np.inf
            order = np.lexsort((ids, -s))[: min(k, len(rows) - 1)]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_neighbours_with_copies_bad_vectors_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x[100:300] = x[100]
    x[400:] *= rng.uniform(0.2, 3, (100, 1))
    rows = [(i, [float(v) for v in x[i]]) for i in range(500)]
    bad = [(600, None), (620, [0.0] * 16), (640, [float("nan")] + [1.0] * 15), (660, [None] + [1.0] * 15), (680, [float("inf")] * 16), (700, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4).withColumn("id", F.lit(1)).withColumn("q", F.lit(2))
    got = nearest.search(df, F.col("vec_id") % 20 == 0).collect()
    expected, found = brute_nearest(rows, 20, 20), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-9)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    recall = np.mean([len(set(found[q]) & set(expected[q])) / 20 for q in expected])
    assert recall >= 0.95
    assert found[120] == expected[120] and found[120][3:] == list(range(100, 117))  # of equal scores the smaller ids


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["near copies", "a long vector", "lengths over six orders", "far clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(6)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, 48)))
    if kind == "near copies":
        x[:1200] = unit(x[0] + 0.06 * unit(rng.normal(size=(1200, 48))))
    elif kind == "a long vector":
        x[7] *= 100
    elif kind == "far clusters":  # more than a list holds, and no way between them
        x = unit(np.repeat(rng.normal(size=(60, 48)), 50, axis=0) + 0.01 * rng.normal(size=(3000, 48)))
    else:
        x *= 10 ** rng.uniform(-3, 3, (len(x), 1))
    x = x[rng.permutation(len(x))]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    found = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    expected = brute_nearest(rows, 20, 50)
    assert set(found) == set(expected) and np.mean([len(found[q] & set(e)) / 20 for q, e in expected.items()]) >= 0.95


def test_python_gets_a_bounded_part_of_the_graph_at_once(spark, monkeypatch):
    handed = type(spark.range(0)).mapInArrow

    def bounded(self, run, schema, *args, **kwargs):
        def held(batches):
            for batch in batches:
                if batch.nbytes > 16 << 20:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return handed(self, lambda batches: run(held(batches)), schema, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", bounded)
    x = np.random.default_rng(3).normal(size=(2000, 64))
    rows = [(i, [float(v) for v in x[i]]) for i in range(2000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 2 == 0).collect()
    expected, found = brute_nearest(rows, 20, 2), {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(expected) and np.mean([len(found[q] & set(e)) / 20 for q, e in expected.items()]) >= 0.95
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rows_of_a_key_stay_together():
    keys = np.array([1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5])
    for size in (1, 2, 3, 4, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size])], names=["u"]) for a in range(0, len(keys), size)]
        got = [b.column("u").to_pylist() for b in nearest._whole(iter([batches[0].slice(0, 0), *batches]), "u")]
        assert sum(got, []) == keys.tolist() and not any(set(a) & set(b) for a, b in zip(got, got[1:], strict=False))


def test_every_pair_of_a_shingle_across_classes_meets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    sig = rng.integers(1, 2**31, (120, near_dedup.SAMPLES))
    for i in range(0, 60, 2):
        sig[i + 1, 7:] = sig[i, 7:]
    sig[60:70, 10:] = sig[60, 10:]
    labels = [60 if 60 <= i < 65 or 80 <= i else i for i in range(120)]
    total = [100.0 + 50 * (i % 3 == 1) for i in range(120)]
    held = spark.createDataFrame([(i, s, total[i], total[i]) for i in range(120) for s in (1, 2) if s == 1 or i % 2], "id long, shingle long, total double, rest double")
    heads = spark.createDataFrame([(i, [int(v) for v in sig[i]]) for i in range(120)], "id long, sig array<int>")
    classes = spark.createDataFrame(list(enumerate(labels)), "id long, class long")
    expected = {(a, b): int((sig[a] == sig[b]).sum()) for a in range(120) for b in range(a + 1, 120) if labels[a] != labels[b] and total[a] == total[b]}
    expected = {p: n for p, n in expected.items() if n >= near_dedup.LEAST_AGREEMENT * 0.8 * near_dedup.SAMPLES}
    found = near_dedup.across_classes(Scratch(spark, "test"), held, heads, classes).collect()
    got = {(r["a"], r["b"]): r["agree"] for r in found}
    assert len(found) == len(got) and got == expected and len(got) > 10


def test_prefixes_of_similar_documents_meet(spark):
    rng = random.Random(5)
    base = [f"t{rng.randrange(400)}" for _ in range(500)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(500)] = f"n{rng.randrange(60)}"
        rows.append((i, " ".join(words[: rng.randrange(470, 501)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = near_dedup.frequencies(docs)
    held = {}
    for r in near_dedup.prefixes(Scratch(spark, "test"), docs, known, 0.8).collect():
        held.setdefault(r["id"], set()).add(r["shingle"])
    texts = [t for _, t in rows]
    pairs = [(a, b) for a in range(80) for b in range(a)]
    frame = pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "left": [texts[a] for a, _ in pairs], "right": [texts[b] for _, b in pairs]})
    alike = [(r.a, r.b) for part in near_dedup.similarity(known)(iter([frame])) for r in part.itertuples() if r.similarity >= 0.8]
    assert len(alike) > 50 and all(held[a] & held[b] for a, b in alike)


def test_frequencies_are_exact_where_a_share_holds_a_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RARE", 16)
    monkeypatch.setattr(near_dedup, "HELD", 300)
    monkeypatch.setattr(near_dedup, "COUNTED", 100)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{min(rng.randrange(3), rng.randrange(4))}" for _ in range(9))) for i in range(600)] + [(-1, None)]
    known = near_dedup.frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    _, value, *_ = near_dedup.shingled([t for _, t in rows[:-1]])
    shingles, counts = np.unique(value, return_counts=True)
    frequent = counts * 16 >= 600
    assert known.n_docs == 600 and 0 < frequent.sum() < len(shingles)
    assert known.shingles.tolist() == shingles[frequent].tolist() and known.counts.tolist() == counts[frequent].tolist()


def test_one_of_several_texts_of_a_doc_id_counts(spark):
    texts = [prose(seed, 60) for seed in (1, 2)]
    least = min(texts, key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first()["h"])
    other = next(t for t in texts if t != least)
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (1, other), (2, least), (3, least + " more")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect())) == [(1, 1), (2, 2), (3, 2), (5, 2)]


def test_pairs_that_lie_apart_in_every_bucket_are_linked(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"t{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(10):  # a template of which each document replaces a fifth of its own
        at = rng.randrange(300)
        words = list(base)
        for j in range(at, at + 60):
            words[j % 300] = f"w{rng.randrange(10**6)}"
        for k in range(6):
            words[at - 100 - 20 * k] = f"other{k}"
            rows.append((6 * i + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # The order of a bucket is left to chance; here no neighbours are alike.
    monkeypatch.setattr(near_dedup, "candidates", lambda scratch, heads: spark.createDataFrame([(0, 6)], "a long, b long"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 10

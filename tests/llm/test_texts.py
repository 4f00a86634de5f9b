"""Line dedup, quality rules and substring dedup against plain Python, on hard rows, and against SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from margrave.llm import line_dedup, quality, queries, substring_dedup

from ..oracle import compare
from .conftest import prose

BLANKS = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_lines(hard, hard_rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(ASCII_LOWER)
    for i, t in hard_rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    heavy = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert heavy
    expected = []
    for i, t in hard_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in heavy and i < heavy[key(x)])]
        expected.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert sorted(tuple(r) for r in line_dedup.line_dedup_digest(hard).collect()) == expected


def test_line_runs_are_levelled_and_batches_do_not_matter(spark):
    rows = [(i, f"shared line number {i % 3} which is longer than forty points\nown {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = [sorted(map(tuple, line_dedup.dedup_lines(df, batches=b, fanout=f).select("doc_id", "kept.text", "kept.n_dropped").collect())) for b, f in ((1, 2), (3, 2), (7, 3))]
    assert results[0] == results[1] == results[2] and sum(r[2] for r in results[0]) == 37


@pytest.fixture
def split_soon(spark):
    """Spark splits partitions of a few kilobytes that are larger than the others, and broadcasts nothing."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_documents_of_a_very_common_line_are_split(spark, split_soon):
    common, rare = "a line that all of the documents hold, of forty code points and more", "a line of forty code points and more that only group {} holds"
    df = spark.createDataFrame([(i, f"{common}\n{rare.format(i // 6)}") for i in range(3000)], "doc_id long, text string").repartition(6, "doc_id")
    out = line_dedup.dedup_lines(df).select("doc_id", "kept.n_dropped")
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {i: (i != 2999) + (i % 6 != 5) for i in range(3000)}
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_very_common_passage_are_split(spark, split_soon):
    passage = prose(5, 60)
    df = spark.createDataFrame([(i, f"{prose(100 + i, 20)} {passage} {prose(5000 + i, 20)}") for i in range(1200)], "doc_id long, text string").repartition(6, "doc_id")
    out = substring_dedup.repeated_stretches(df)
    assert sorted(r["did"] for r in out.collect()) == list(range(1200))
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_lines_of_repeated_and_nameless_rows(spark):
    line = "this line is long enough to be a key of its own, truly"
    df = spark.createDataFrame([(None, line), (7, line), (7, line), (3, line), (2, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_dropped"]) for r in line_dedup.line_dedup_digest(df).collect())
    assert got == [(-1, 1), (2, 1), (3, 1), (7, 0), (7, 0)]


def test_quality(hard, hard_rows):
    expected = {}
    for i, t in hard_rows:
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        base = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        expected[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), base)
    got = {r["doc_id"]: r for r in quality.quality_digest(hard).collect()}
    for i, e in expected.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == e, i
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations(spark, hard):
    book = quality.ledger(hard).cache()
    row = quality.ablation(book).first()
    kept = quality.apply_policy(book).filter("kept").count()
    assert row["n_kept"] == kept and row["n_docs"] == book.count()
    for i, name in enumerate(quality.RULES):
        alone = book.filter(F.col("failed") == (1 << i)).count()
        assert row[f"regained_{name}"] == alone
    assert quality.apply_policy(book, "v1").filter("kept").count() >= kept


def brute_substrings(rows, width=35):
    count = Counter(tuple(w[k : k + width]) for _, t in rows for w in [words(t)] for k in range(len(w) - width + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def test_substrings(hard, hard_rows):
    expected = brute_substrings(hard_rows)
    assert any(0 < e[2] < e[1] for e in expected)
    assert sorted(map(tuple, substring_dedup.dedup_substrings(hard).collect())) == expected


def test_substrings_of_few_words_and_repeated_rows(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b"]) for _ in range(rng.choice([34, 35, 60, 400])))) for i in range(40)]
    rows += [(99, "x y " * 40), (100, rows[0][1]), (100, rows[0][1])]
    rows += [(200 + i, " ".join(f"t{k + 7 * i}" for k in range(60))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_substrings(rows)
    for batches in (1, 5):
        assert sorted(map(tuple, substring_dedup.dedup_substrings(df, batches).collect())) == expected


def test_substrings_keep_all_columns(hard):
    out = substring_dedup.dedup_substrings(hard, with_text=True)
    assert out.columns == hard.columns and out.count() == hard.count()
    a = {r["doc_id"]: sha(r["text"] or "") for r in out.collect()}
    b = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.dedup_substrings(hard).collect()}
    assert a == b


def test_empty_tables(none):
    for f in (line_dedup.line_dedup_digest, quality.quality_digest, substring_dedup.dedup_substrings):
        assert f(none).count() == 0

"""Tool-call linking on a fixture, held-out accuracy of the toxicity score, and the pipeline stage by stage."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from margrave.llm import chat_format, packing, queries, toxicity

from ..oracle import SMALL


def chat(spark):
    call = lambda *calls, content=None: json.dumps({"content": content, "tool_calls": list(calls)})
    result = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    one = lambda i, name, arguments, *after: {"id": i, "name": name, "arguments": arguments, "after": list(after)}
    rows = [
        (1, 0, "user", "hello \"you\""),
        (1, 1, "assistant", call(one("a", "search", {"query": "x", "limit": 3}), one("b", "calculate", {"expression": 5}, "a"), content="wait")),
        (1, 2, "tool", result("b", "7")),
        (1, 3, "tool", result("a", "found")),
        (1, 4, "tool", result("zzz", "lost")),
        (1, 5, "assistant", call(one("a", "search", {}))),
        (2, 0, "assistant", call(one("a", "erase", {"z": 1, "b": 2}), one("p", "fetch", {"url": "u"}, "q"), one("q", "fetch", {"url": "u"}, "p"), one("n", "fetch", None, "gone"))),
        (2, 1, "user", None),
        (None, 0, None, "{not json"),
        (3, 0, "assistant", "{\"tool_calls\": []}"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash")).repartition(3)


def test_calls_and_results(spark):
    rows = chat_format.format_chats(chat(spark)).collect()
    by = {(r["conv_id"], r["turn"], r["kind"], r["call_id"]): r for r in rows}
    a, b = by[1, 1, "call", "a"], by[1, 1, "call", "b"]
    assert a["status"] == "ok" and a["errors"] == [] and json.loads(a["json"]) == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search", "role": "assistant"}
    assert a["json"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant"}'
    assert b["errors"] == ["expression: not of type string"]
    order = lambda r: (r["order_turn"], r["level"])
    assert order(a) < order(by[1, 3, "result", "a"]) < order(b) < order(by[1, 2, "result", "b"])
    assert by[1, 4, "result", "zzz"]["status"] == "orphan" and by[1, 5, "call", "a"]["status"] == "duplicate"
    assert by[1, 5, "call", "a"]["errors"] == ["query: missing"]
    assert by[1, 1, "message", None]["json"] == '{"content":"wait","role":"assistant"}'
    assert by[2, 0, "call", "a"]["errors"] == ["unknown tool"] and by[2, 0, "call", "a"]["status"] == "unanswered"
    assert by[2, 0, "call", "p"]["status"] == by[2, 0, "call", "q"]["status"] == "cyclic" and by[2, 0, "call", "p"]["level"] is None
    assert by[2, 0, "call", "n"]["errors"][0] == "arguments are not an object" and by[2, 0, "call", "n"]["status"] == "unanswered"
    assert by[2, 1, "message", None]["json"] == '{"content":null,"role":"user"}'
    assert by[None, 0, "message", None]["json"] == '{"content":"{not json","role":null}'
    assert Counter(r["kind"] for r in rows) == {"message": 5, "call": 7, "result": 3}


def test_no_chats(spark):
    assert chat_format.format_chats(chat(spark).limit(0)).count() == 0


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"p{i}" for i in range(400)]
    nasty = [stem + end for stem in ("grumf", "zlok") for end in ("", "an", "eri", "oso", "ich", "emu")]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(2, 5) * toxic):
            w[rng.randrange(len(w))] = rng.choice(nasty)
        docs.append((i, " ".join(w) + "."))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "grumf"), (None, "p1 p2")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda l: sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity.toxicity_digest(docs, l).collect())  # noqa: E731, E741
    assert key(labels) == key(other)
    rows = toxicity.toxicity_digest(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)


def test_grammar_weighs_clauses():
    g = toxicity.Grammar(frozenset(["grumf"]))
    paths = lambda t: dict(zip(toxicity.PATHS, g.paths(t), strict=True))
    assert paths("some grumfig here.")["insult_plain"] == 1
    assert paths("you are a grumf.")["insult_aimed"] == 1 and paths("you go. a grumf.")["insult_plain"] == 1
    assert paths("a grumf you are.")["insult_aimed"] == 1 and paths("a grumf\nyou are")["insult_plain"] == 1
    assert paths('"you go." a grumf.')["insult_plain"] == 1
    assert paths("he is not a grumf.")["insult_negated"] == 1 and paths("no one of all those is a grumf.")["insult_negated"] == 0
    assert paths("she said grumf.")["insult_reported"] == 1
    assert paths("we kill you.")["threat_aimed"] == 1 and paths("we kill time.")["threat_plain"] == 1 and paths("she said kill you")["threat_reported"] == 1
    aimed, negated = g.scores([g.paths("you grumf grumf grumf."), g.paths("not grumf.")])
    assert aimed > negated > g.scores([[0] * len(toxicity.PATHS)])[0]


def brute_paths(kinds):
    """Paths of a clause by looking at each insult or threat's surroundings."""
    out = [0] * len(toxicity.PATHS)
    for i, kind in enumerate(kinds):
        if kind in (toxicity.INSULT, toxicity.THREAT):
            negated, reported = toxicity.NEGATION in kinds[max(0, i - toxicity.SCOPE) : i], toxicity.REPORT in kinds[:i]
            mark = "negated" if negated else "reported" if reported else "aimed" if toxicity.TARGET in kinds else "plain"
            out[toxicity.PATHS.index(("insult_" if kind == toxicity.INSULT else "threat_") + mark)] += 1
    return out


def test_composition_equals_its_parts_and_brute_force():
    rng = random.Random(7)
    words = {toxicity.INSULT: "grumf", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.OTHER: "tree"}
    g = toxicity.Grammar(frozenset(["grumf"]))
    parts = [toxicity.marker(toxicity.TARGET, "aimed", 0, ("aimed",)), toxicity.marker(toxicity.NEGATION, "negated", toxicity.SCOPE, ("aimed",)), toxicity.marker(toxicity.REPORT, "reported", 0, ("aimed", "negated")), toxicity.scorer()]
    for _ in range(500):
        clauses = [[rng.choice(list(words)) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        assert g.paths(". ".join(" ".join(words[k] for k in c) for c in clauses)) == np.sum([brute_paths(c) for c in clauses], axis=0).tolist()
        symbols = toxicity.BACKWARD.run((k, frozenset()) for k in clauses[0])
        step = symbols
        for part in parts:
            step = part.run(step)
        assert step == toxicity.FORWARD.run(symbols)


def test_very_long_texts_repeated_ids_and_ties(spark):
    docs, labels = corpus(spark, 200)
    more = spark.createDataFrame([(5000, "p1 " * 60_000 + "x" * 50_000), (3, "another text"), (3, "another text")], "doc_id long, text string")
    got = toxicity.toxicity_digest(docs.unionByName(more), labels).collect()
    assert len(got) == docs.count() + 3 and len({r["score"] for r in got if r["doc_id"] in (5000, None)}) == 1
    assert all(r["held_out"] is not None and r["score"] is not None for r in got)


def test_without_labels(spark, none):
    docs, labels = corpus(spark, 20)
    assert len({r["score"] for r in toxicity.toxicity_digest(docs, labels.limit(0)).collect()}) == 1
    assert toxicity.toxicity_digest(none, labels).count() == 0


def test_keep_clean_is_the_score(spark):
    docs, labels = corpus(spark, 300)
    docs = docs.withColumn("score", F.lit("mine"))
    kept = toxicity.keep_clean(docs, labels)
    scored = toxicity.toxicity_digest(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in scored.filter("predicted = 0").collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SMALL)
        if name != "packing":
            assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, at.count()))
    assert [n for n, _ in seen] == ["toxicity", "line dedup", "MinHash near-dedup", "substring dedup", "packing"]
    assert docs.count() > seen[0][1] >= seen[1][1] > seen[2][1] == seen[3][1]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(*columns).collect())) == sorted(map(tuple, at.select(*columns).collect()))


def test_packing_wastes_nothing(spark):
    rows = queries.QUERIES["op6_packing"](spark, SMALL)
    assert rows.filter(F.col("length") != F.lit(2) ** F.col("bucket")).count() == 0
    assert np.all([sum(packing.binary_lengths(n, 4096)) == n for n in range(1, 9000, 37)])


@pytest.mark.parametrize("name", ["op5_toxicity", "op7_nearest_neighbours", "op9_token_counts", "op10_near_dedup"])
def test_queries_cover_their_tables(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0

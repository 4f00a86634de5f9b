"""BPE, edit-aware counts and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from margrave.llm import bpe, bpe_codec, packing, token_counts

PATTERN = public_tokenizers.PATTERN
MULTI, PLAIN, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "'s", "'re", "12", "$$", "…", "漢字", " ", "🙂", "\r\n", "x" * 70, "́"]


def reference(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [MULTI, PLAIN])
def test_tree_equals_the_library(path, monkeypatch):
    own, lib, rng = bpe.ByteBPE(path, PATTERN), reference(path), random.Random(1)
    for _ in range(400):
        monkeypatch.setattr(bpe, "LEAF", rng.choice([4, 9, 48]))
        monkeypatch.setattr(bpe, "TEXT_LEAF", rng.choice([7, 33, 200]))
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 60, 300])))
        assert own.ids(text) == lib.encode_ordinary(text)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(20_000))
    assert own.ids(long) == lib.encode_ordinary(long)


def test_every_token_is_its_own_encoding():
    own = bpe.ByteBPE(MULTI, PATTERN)
    assert all(own._leaf(t) == [i] for t, i in random.Random(1).sample(sorted(own.ranks.items()), 5000))


def test_codec(spark, hard, hard_rows, none):
    lib, expected = reference(MULTI), []
    for i, t in hard_rows:
        ids = lib.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe_codec.codec_digest(hard, MULTI, PATTERN).collect())) == expected
    encoded = bpe_codec.encode_documents(hard, MULTI, PATTERN)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe_codec.decode_documents(encoded, MULTI, PATTERN).collect()}
    assert back == {i: t or "" for i, t in hard_rows}
    assert bpe_codec.codec_digest(none, MULTI, PATTERN).count() == 0


def test_counts_under_edits():
    own, lib, rng = bpe.ByteBPE(PLAIN, PATTERN), reference(PLAIN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 60, 300])))
        tree = token_counts.CountTree(own, *token_counts.CountTree.cut(own, text))
        for _ in range(4):
            start = rng.randint(0, len(text) + 1)
            stop, new = start + rng.choice([0, 1, 5, 50]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3])))
            tree.edit(start, stop, new)
            a = min(start, len(text))
            text = text[:a] + new + text[max(a, min(stop, len(text))) :]
            assert tree.text() == text and tree.n_tokens == len(lib.encode_ordinary(text))


def test_an_edit_touches_few_segments():
    own = bpe.ByteBPE(PLAIN, PATTERN)
    tree = token_counts.CountTree(own, *token_counts.CountTree.cut(own, "word and " * 20_000))
    tree.edit(90_000, 90_004, "other")
    assert tree.encoded <= 3 * token_counts.WIDTH + 3


def test_large_insertions_are_split_into_leaves():
    own, lib = bpe.ByteBPE(PLAIN, PATTERN), reference(PLAIN)
    tree, text = token_counts.CountTree(own, *token_counts.CountTree.cut(own, "some words " * 40)), "some words " * 40
    for i in range(150):
        place, new = 100 + 37 * i, " inserted words" * (300 if i % 10 == 0 else 1)
        before = tree.encoded
        tree.edit(place, place, new)
        text = text[:place] + new + text[place:]
        assert i % 10 == 0 or tree.encoded - before <= 4 * token_counts.WIDTH  # also inside a large insertion
    assert tree.text() == text and tree.n_tokens == len(lib.encode_ordinary(text))
    assert max(len(own.segments(x.text)) for x in tree.leaves()) <= token_counts.WIDTH and tree.root.depth <= 64


def test_count_query(hard, hard_rows, none):
    lib = reference(PLAIN)

    def edited(t):
        n = len(t)
        for start, stop, new in ((n // 2, n // 2, " newly added words,"), (int(n * (1 / 3)), int(n * (1 / 3)) + 25, ""), (int(n * 0.75), int(n * 0.75) + 4, "'re 42"), (0, 0, "Re: ")):
            start = min(start, len(t))
            t = t[:start] + new + t[max(start, min(stop, len(t))) :]
        return t

    got = {r["doc_id"]: r for r in token_counts.token_count_digest(hard, PLAIN, PATTERN).collect()}
    for i, t in hard_rows:
        new = edited(t or "")
        assert (got[i]["n_tokens"], got[i]["n_tokens_edited"]) == (len(lib.encode_ordinary(t or "")), len(lib.encode_ordinary(new)))
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    assert token_counts.token_count_digest(none, PLAIN, PATTERN).count() == 0


def test_kept_trees(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some words " * 50), (2, None), (2, None)], "doc_id long, text string")
    edit = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(9).cast("long").alias("stop"), F.lit("thing").alias("text")))
    trees = spark.createDataFrame(token_counts.count_trees(docs, PLAIN, PATTERN).collect(), token_counts.TREES)
    lib, text, short = reference(PLAIN), "some words " * 50, ""
    for _ in range(2):  # each time to what the last edits left
        text, short = text[:3] + "thing" + text[9:], short[:3] + "thing" + short[9:]
        got = token_counts.apply_edits(trees.withColumn("edits", edit), PLAIN, PATTERN).collect()
        assert sorted((r["doc_id"], r["n_tokens_edited"]) for r in got) == [(1, len(lib.encode_ordinary(text)))] + [(2, len(lib.encode_ordinary(short)))] * 2
        trees = token_counts.apply_edits(trees.withColumn("edits", edit), PLAIN, PATTERN, with_trees=True)
        trees = spark.createDataFrame(trees.collect(), token_counts.TREES)
    kept = {r["doc_id"]: r for r in trees.collect()}
    assert kept[1]["text"] == text and sum(kept[1]["leaf_chars"]) == len(text) and sum(kept[1]["leaf_tokens"]) == kept[1]["n_tokens"]
    untouched = trees.withColumn("edits", F.lit(None).cast("array<struct<start: long, stop: long, text: string>>"))
    assert all(r["n_encoded"] == 0 and r["n_tokens"] == r["n_tokens_edited"] for r in token_counts.apply_edits(untouched, PLAIN, PATTERN).collect())


def test_packing(hard, hard_rows, none):
    lib = Tokenizer.from_file(WORD)
    lib.encode_special_tokens = True
    pieces = {}
    rows = packing.pack(hard, WORD).collect()
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in hard_rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]]))[:-1] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            assert r["length"] == 1 << r["bucket"] <= 4096 and r["offset"] == 0
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(x)) == 1 and sum(x) <= packing.BATCH_TOKENS for x in sizes.values())
    assert packing.word_ids(WORD).short
    assert packing.pack(none, WORD).count() == 0
    assert packing.binary_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(hard, WORD, 1000)


def test_pieces_with_ids(spark):
    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    lib = Tokenizer.from_file(WORD)
    rows = sorted(packing.pack(df, WORD, with_ids=True).collect(), key=lambda r: r["start"])
    assert [x for r in rows for x in r["ids"]] == [*lib.encode("hello there", add_special_tokens=False).ids, 2]

"""Edit-aware token counts.

Each document keeps a segment tree.  Its leaves are runs of ``WIDTH`` segments (see ``bpe``: texts cut where the split pattern has a
match boundary whatever surrounds it); every node holds the characters and the tokens below it.  An edit re-encodes the leaves that it
touches, with the leaf that holds the character before it and the one that holds the character after it, puts new leaves of ``WIDTH``
segments in their place, and sums anew on the paths from there to the root.  All other leaves keep their counts: both their edges are
still such boundaries.  Trees are kept as a table of their leaves (inner sums follow from those), which edits read and replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, encoder
from .common import Scratch, text_of

#: Segments in a leaf.
WIDTH = 16
TREES = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


class Node:
    """A leaf (text) or the sum of two nodes."""

    __slots__ = ("chars", "tokens", "depth", "text", "left", "right")

    def __init__(self, text: str | None, tokens: int, left: Node | None = None, right: Node | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.chars, self.tokens, self.depth = len(text), tokens, 0
        else:
            self.chars, self.tokens, self.depth = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.depth, right.depth)


def _joined(left: Node | None, right: Node | None) -> Node | None:
    return left or right if left is None or right is None else Node(None, 0, left, right)


def _built(leaves: list[Node]) -> Node | None:
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return Node(None, 0, _built(leaves[:half]), _built(leaves[half:]))


def _cut(node: Node | None, place: int) -> tuple[Node | None, Node | None]:
    """The tree left and right of an edge between leaves; only nodes on the path are made anew."""
    if node is None or place <= 0:
        return None, node
    if place >= node.chars:
        return node, None
    if place < node.left.chars:
        a, b = _cut(node.left, place)
        return a, _joined(b, node.right)
    a, b = _cut(node.right, place - node.left.chars)
    return _joined(node.left, a), b


class CountTree:
    """Characters and tokens of a text under edits; ``encoded`` counts the segments that edits encoded again."""

    def __init__(self, bpe: ByteBPE, leaves: list[str], tokens: list[int]) -> None:
        self.bpe, self.encoded = bpe, 0
        self.root = _built([Node(x, n) for x, n in zip(leaves, tokens, strict=True) if x])

    @staticmethod
    def cut(bpe: ByteBPE, text: str) -> tuple[list[str], list[int]]:
        """The leaves of a new tree and their tokens."""
        parts = bpe.split(text)
        groups = [parts[i : i + WIDTH] for i in range(0, len(parts), WIDTH)]
        return ["".join(g) for g in groups], [sum([bpe.count(x) for x in g]) for g in groups]

    def leaves(self) -> list[Node]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node.left is None:
                out.append(node)
            else:
                stack += [node.right, node.left]
        return out

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The edges of the leaf that holds the character at a place below the length."""
        node, before = self.root, 0
        while node.left is not None:
            if place - before >= node.left.chars:
                before += node.left.chars
                node = node.right
            else:
                node = node.left
        return before, before + node.chars

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start up to stop; places beyond the ends are moved to them."""
        length = self.root.chars if self.root else 0
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        first = self._leaf_at(max(start - 1, 0))[0] if length else 0
        last = self._leaf_at(min(stop, length - 1))[1] if length else 0
        before, rest = _cut(self.root, first)
        touched, after = _cut(rest, last - first)
        self.root = touched
        old = self.text()
        leaves, tokens = self.cut(self.bpe, old[: start - first] + new + old[stop - first :])
        self.encoded += len(leaves) * WIDTH
        self.root = _joined(_joined(before, _built([Node(x, n) for x, n in zip(leaves, tokens, strict=True)])), after)
        if self.root and self.root.depth > 64:  # joins may tilt the tree; its leaves stay as they are
            self.root = _built(self.leaves())

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def text(self) -> str:
        return "".join([x.text for x in self.leaves()])


def count_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, n_tokens, leaf_chars and leaf_tokens: the trees, to be written and edited later.

    A null or empty text has no leaves and 0 tokens; repeated rows have a tree each; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for batch in _slices(batches):
            cuts = [CountTree.cut(bpe, x) for x in batch["text"]]
            sizes = {"n_tokens": [sum(t) for _, t in cuts], "leaf_chars": [[len(x) for x in leaves] for leaves, _ in cuts], "leaf_tokens": [t for _, t in cuts]}
            yield batch.assign(**sizes)

    narrow = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return narrow.mapInPandas(run, TREES)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Few rows at a time, so that no frame of leaves is large."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield batch.iloc[at : at + 256]


def apply_edits(trees: DataFrame, path: str, pattern: str, with_trees: bool = False) -> DataFrame:
    """trees: rows of count_trees() with ``edits``: (start, stop, text), applied in order, each to what the last left; places in code points.

    Returns doc_id, n_tokens (before), n_edits, n_tokens_edited, n_leaves, n_encoded (segments encoded again, to a leaf) and
    edited_sha256; with_trees: the new rows of count_trees(), for later edits.  A null list has no edits, a null replacement is empty.
    Memory: one batch of texts, and the tree of one document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for batch in _slices(batches):
            rows = []
            for x in batch.itertuples(index=False):
                ends = np.cumsum(x.leaf_chars, dtype=np.int64).tolist()
                leaves = [x.text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                tree = CountTree(bpe, leaves, [int(t) for t in x.leaf_tokens])
                edits = [] if x.edits is None else list(x.edits)
                for e in edits:
                    tree.edit(e["start"], e["stop"], e["text"] or "")
                if with_trees:
                    now = tree.leaves()
                    rows.append((x.doc_id, tree.text(), tree.n_tokens, [n.chars for n in now], [n.tokens for n in now]))
                else:
                    sha = hashlib.sha256(tree.text().encode("utf-8")).hexdigest()
                    rows.append((x.doc_id, x.n_tokens, len(edits), tree.n_tokens, len(leaves), tree.encoded, sha))
            yield pd.DataFrame(rows, columns=names)

    schema = TREES if with_trees else "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_leaves long, n_encoded long, edited_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    return trees.select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", "edits").mapInPandas(run, schema)


def standard_edits(text: Column) -> Column:
    """The edit script of the registered query, from the text's length n: insert at n/2, delete at n/3, replace at 3n/4, prepend."""
    n = F.char_length(text).cast("long")
    at = lambda share: F.floor(n * share).cast("long")
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("text"))
    return F.array(edit(at(0.5), at(0.5), " newly added words,"), edit(at(1 / 3), at(1 / 3) + 25, ""), edit(at(0.75), at(0.75) + 4, "'re 42"), edit(F.lit(0).cast("long"), F.lit(0).cast("long"), "Re: "))


def token_count_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts of every document before and after the standard edits, which are applied to the trees as stored."""
    trees = Scratch(docs.sparkSession, "trees").write(count_trees(docs, path, pattern), "trees")
    return apply_edits(trees.withColumn("edits", standard_edits(F.col("text"))), path, pattern)

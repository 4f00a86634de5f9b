"""Byte-level BPE by a monoid tree: encode halves, join neighbours by re-encoding a growing window at the cut.

Two levels share the idea.

* Text: a text is cut into *segments* just before a space that follows a non-blank.  The split pattern has no look-behind, and none of
  its matches runs from a non-blank over such a space, so those cuts are match boundaries of the whole text and segments encode alone.
  Texts beyond ``TEXT_LEAF`` are halved; the segments next to a cut are joined and segmented anew.  The outer edges of that window are
  such boundaries, so outside it nothing can change: at this level the first window is already stable.
* Pre-token: bytes beyond ``LEAF`` are halved, and leaves are merged by rank.  Two encodings are joined by re-encoding the last and
  first k tokens, k growing, until the tokens at both edges of the window are compatible with their neighbours (encoding the two tokens'
  bytes gives the two back).  A token sequence all of whose neighbours are compatible is the encoding of its bytes, so the tokens outside
  are then final.

Decoding concatenates halves up a tree of ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Sequence
from itertools import chain

#: A leaf of the byte tree, in bytes, and of the text tree, in characters.
LEAF, TEXT_LEAF = 32, 1024
#: Ids that a leaf of the decoding tree holds.
IDS_LEAF = 1024
#: Entries that a worker's cache of segments may hold before it is emptied.
CACHE = 400_000


class ByteBPE:
    """An encoder for a rank file (lines of base64 token and rank) and a split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {b: a for a, b in self.ranks.items()}
        # A pattern that matches all of a text, so that the text is merged as one piece.
        self._whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self._pieces = regex.compile(pattern).findall
        self._cut = regex.compile(r"(?<=\S)(?= )").split
        self._odd = regex.compile(r"[^\S \n]").search
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    # -- bytes ---------------------------------------------------------------------------------------------------------------

    def piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern; one that fits a leaf is merged by the library."""
        data = text.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._whole(text) if len(data) <= LEAF else self._tree(data)

    def _leaf(self, data: bytes) -> list[int]:
        """Ids of a few bytes: the neighbours whose join has the least rank are merged, leftmost first, until no join has a rank."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        joins = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while known := [r for r in joins if r is not None]:
            i = joins.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(joins):
                joins[i] = ranks.get(parts[i] + parts[i + 1])
        return [ranks[x] for x in parts]

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self._leaf(data)
        half = len(data) // 2
        return self.join(self._tree(data[:half]), self._tree(data[half:]))

    def _compatible(self, a: int, b: int) -> bool:
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            known = self._fits[a, b] = self._leaf(self.vocabulary[a] + self.vocabulary[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes, from the encodings of two neighbours."""
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self._leaf(self.decode(left[a:] + right[:b]))
            if (a == 0 or self._compatible(left[a - 1], middle[0])) and (b == len(right) or self._compatible(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            k *= 2

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids; halves are concatenated up the tree."""
        if len(ids) <= IDS_LEAF:
            return b"".join(map(self.vocabulary.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    # -- text ----------------------------------------------------------------------------------------------------------------

    def segment_ids(self, segment: str) -> tuple[int, ...]:
        found = self._cache.get(segment)
        if found is None:
            found = tuple([i for piece in self._pieces(segment) for i in self.piece(piece)])
            if len(segment) <= 256:
                if len(self._cache) >= CACHE:
                    self._cache.clear()
                self._cache[segment] = found
        return found

    def count(self, segment: str) -> int:
        """The number of a segment's ids."""
        return len(self.segment_ids(segment))

    def segments(self, text: str) -> list[str]:
        """The text cut just before each space that follows a non-blank."""
        if not text:
            return []
        if "  " in text or "\n " in text or text[0] == " " or self._odd(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def split(self, text: str) -> list[str]:
        """segments(text), by the tree."""
        if len(text) <= TEXT_LEAF:
            return self.segments(text)
        half = len(text) // 2
        return self.join_segments(self.split(text[:half]), self.split(text[half:]))

    def join_segments(self, left: list[str], right: list[str]) -> list[str]:
        """The window begins as the segments that touch the cut.

        The left edge is a cut of the whole text or its start.  The right edge is one too, as every segment but a text's first begins
        at a cut that two characters of that half prove.  So the first window is stable, and one segment suffices on either side.
        """
        if not left or not right:
            return left or right
        return left[:-1] + self.segments(left[-1] + right[0]) + right[1:]

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.segment_ids, self.split(text))))


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process."""
    return ByteBPE(path, pattern)

"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document.  The ledger keeps the measurements and one bit for each failed rule; a policy is a named mask
of rules and a number of failures that it tolerates, so policies and ablations are bitwise operations on the ledger and read no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, text_of, words_of

#: Rules in the order of their bits: the condition under which a document fails.  They read the measurements alone.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """Reject a document with more than ``tolerate`` failures among the rules of ``mask``."""

    mask: int
    tolerate: int = 0


#: Versioned policies; a version is never changed, only superseded.
POLICIES = {"v1": Policy(0b000011), "v2": Policy(0b111111)}
CURRENT = "v2"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), a row for each row of docs.

    A null text has no words.  Everything is computed within the row, with no shuffle.
    """
    out = docs.select("doc_id", text_of().alias("text")).withColumn("words", words_of(F.col("text")))
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    size = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id",
        size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        size("lines").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that the array holds twice or more, the first included.

    Windows are compared by 64-bit hashes.  Only an array with a repeated window goes past the first test.  There, repeated windows are
    the neighbours that are equal in the sorted array; their starts, sorted, cover min(width, gap to the next start) words each.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = lambda h: F.sequence(F.lit(0), F.size(h) - width)
    windows = lambda h: F.transform(starts(h), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = lambda s, i: F.get(s, i)["h"]
        twice = lambda s: F.filter(F.transform(s, lambda x, i: F.when((at(s, i - 1) == x["h"]) | (at(s, i + 1) == x["h"]), x["i"])), lambda x: x.isNotNull())
        gaps = lambda t: F.aggregate(F.transform(t, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(t, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)
        return bound(pairs, lambda s: bound(F.sort_array(twice(s)), gaps))

    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(bound(hashes, lambda h: bound(windows(h), count)))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, with bit i set where rule i fails."""
    out = measure(docs)
    bits = None
    for i, rule in enumerate(RULES.values()):
        bit = F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return out.withColumn("failed", bits.cast("long"))


def rejects(policy: Policy) -> Column:
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask))) > policy.tolerate


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    base = F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~rejects(POLICIES[version]))


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many more would be kept without it.

    One aggregation over the ledger: the documents that only this rule rejects are those whose failures beyond the tolerated ones end
    when its bit is cleared.
    """
    policy = POLICIES[version]
    aggs = []
    for i, name in enumerate(RULES):
        if policy.mask >> i & 1:
            without = Policy(policy.mask & ~(1 << i), policy.tolerate)
            aggs += [F.count_if(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0).alias(f"fails_{name}"), F.count_if(rejects(policy) & ~rejects(without)).alias(f"regained_{name}")]
    return book.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~rejects(policy)).alias("n_kept"), *aggs)


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_lines, failed."""
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
       n_lines, CAST(failed AS BIGINT) AS failed
FROM f
"""

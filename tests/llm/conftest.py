import random

import pytest

WORDS = [f"w{i:03d}" for i in range(700)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): nulls, empty, blank, short and very long texts, copies, near copies, shared passages and lines, odd characters."""
    passage, line = prose(1, 60), "a line that is well over forty code points long, É"
    near = prose(2, 120).split(" ")
    rows = [(0, None), (1, ""), (2, "   \t\n "), (3, "one"), (4, "one two three four five"), (5, prose(3, 30_000)), (6, "x" * 50_000), (7, "the " * 3000)]
    rows += [(10 + i, prose(4, 80)) for i in range(4)]
    rows += [(20 + i, " ".join(near[: 15 * i] + [f"new{i}"] + near[15 * i + 1 :])) for i in range(6)]
    rows += [(30 + i, prose(50 + i, 40) + " " + passage + " " + prose(60 + i, 40)) for i in range(3)]
    rows += [(40 + i, prose(70 + i, 20) + "\n" + (line.upper() if i % 2 else "  " + line + " \t") + "\n" + prose(80 + i, 5)) for i in range(7)]
    rows += [(50, passage + " " + passage), (51, "naïve café 東京 🙂  \x1c ok 'Re's <|endoftext|> 12345 ½ \r\n\r\n end "), (52, "a\n\n\n b\n"), (53, None)]
    return rows


@pytest.fixture
def hard(spark, hard_rows):
    """The rows over several partitions, with extra columns whose names an operator might use itself."""
    df = spark.createDataFrame(hard_rows, "doc_id long, text string").repartition(3, "doc_id")
    from pyspark.sql import functions as F

    names = ["key", "h1", "id", "spans", "did", "tk", "drops", "drop_id", "gone_id", "words", "lines", "kept_text", "row", "n_chars", "score", "u", "v", "class_id", "batch"]
    return df.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")

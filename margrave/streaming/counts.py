"""An extension: marginals of an unbounded table, by event-time windows, with noise when a window closes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.privacy import Noise


def windowed_counts(stream: DataFrame, time: str, columns: Sequence[str], window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, columns..., cnt) of each closed window; rows later than the watermark are left out."""
    late = stream.withWatermark(time, lateness)
    return late.groupBy(F.window(time, window).alias("w"), *columns).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), *columns, "cnt")


def noisy_windows(stream: DataFrame, time: str, columns: Sequence[str], mu: float, noise: Noise, clients: int = 1, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """windowed_counts with y and sigma: a row is in one window, so each window costs mu and all of them do, too."""
    counts = windowed_counts(stream, time, columns, window, lateness)
    return noise.add(counts, math.sqrt(clients) / mu, ["start", *columns])

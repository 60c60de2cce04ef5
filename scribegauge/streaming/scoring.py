"""Scoring of sample streams.

Scoring is stateless, so a stream is scored by the batch plan.  Sums by event
time window use a watermark and built-in aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import guarded, sums, version_guard
from ..operators.scoring import Scorer, score_samples


def score_stream(samples: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Results of a streaming frame of samples; faulty samples carry their ``error``."""
    return score_samples(samples, scorer)


def windowed_counts(results: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Summed counts by event-time window; rates follow from the sums downstream, and mixed versions in one window are an error."""
    timed = results.withWatermark(time, late).groupBy(F.window(time, width).alias("window"))
    return guarded(timed.agg(*sums(), *version_guard()))

"""Quality rules over all labels, and exact thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribegauge.llm import quality, runtime


def test_every_labelled_row_counts(spark):
    labels = spark.range(41_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert [quality.labelled_ids(labels, q).count() for q in (0, 1)] == [20_500, 20_500]


@pytest.mark.parametrize("n", [1, 2, 57, 150_000])
@pytest.mark.parametrize("copies", [0, 0.4])
def test_quantiles_are_exact(spark, n, copies):
    x = np.random.default_rng(n).normal(size=n)
    x[: int(copies * n)] = np.median(x)
    scores = spark.createDataFrame([(float(v),) for v in x], "score double").repartition(4)
    for q in (0.005, 0.5, 0.995):
        assert quality.quantile(scores, q) == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-15)
    assert quality.quantile(scores.limit(0), 0.5) is None


def test_many_labels_meet_documents_by_shuffle(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}"), F.col("id") % (7 + k)) for k in range(12))).alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    want = quality.fit_ratio(docs, labels)
    asked = []
    monkeypatch.setattr(quality, "broadcast_if_small", lambda df: asked.append(df) or runtime.broadcast_if_small(df, -1))
    ratio, threshold = quality.fit_ratio(docs, labels)
    assert len(asked) == 3 and np.array_equal(ratio, want[0]) and threshold == pytest.approx(want[1], rel=1e-12)

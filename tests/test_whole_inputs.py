"""Queries and summaries that look at all of their input."""

from types import SimpleNamespace

from riskframe.ml import explain
from riskframe.plans import learning


def test_vectors_are_whole(spark):
    table = spark.createDataFrame([(1, 0, [float(i) for i in range(9)])], "vec_id long, label int, embedding array<float>")
    assert learning.vectors(SimpleNamespace(embeddings=table)).first()["v"] == [float(i) for i in range(9)]


def test_background_stands_for_all_rows(spark):
    """A thousand copies of one row are one point with its weight, and do not fill the background."""
    rows = spark.createDataFrame([([0.0, 5.0],)] * 1000 + [([float(i), 1.0],) for i in range(1, 301)], "v array<double>")
    centres = explain.summarised_background(rows, "v")
    assert 50 < len(centres) <= 100 and sum(n for _, n in centres) == 1300
    assert abs(sum(c[0] * n for c, n in centres) - sum(range(301))) < 1e-6
    few = explain.summarised_background(rows.where("v[0] < 3"), "v")
    assert few == [([0.0, 5.0], 1000), ([1.0, 1.0], 1), ([2.0, 1.0], 1)]

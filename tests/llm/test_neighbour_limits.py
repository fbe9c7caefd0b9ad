"""Nearest neighbours of very large vectors, and of few rows over many partitions."""

import numpy as np
import pytest

from twinreport.llm import neighbours


def recall(spark, x, every, kind="double", df=None):
    df = df or spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = neighbours.nearest(df, every=every).collect()
    hit = total = 0
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        want = np.argsort(d, kind="stable")[:10]
        own = {r["vec_id"] for r in got if r["query_id"] == q}
        hit, total = hit + len(own & set(want.tolist())), total + min(10, len(x) - 1)
    return hit / total


@pytest.mark.parametrize("scale", [1e20, 1e-30])
def test_components_of_any_size(spark, scale):
    x = np.random.default_rng(1).normal(size=(900, 12)) * scale
    assert recall(spark, x, 30) >= 0.9


def test_few_rows_over_many_partitions(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(60)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert recall(spark, x, 10, df=df) == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", old)

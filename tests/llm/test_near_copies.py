"""Neighbours within a large group of near copies."""

import numpy as np

from twinreport.llm import neighbours


def test_near_copies_are_ranked_by_the_original_vectors(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=64)
    base /= np.linalg.norm(base)
    x = np.concatenate([base + 1e-4 * r.normal(size=(1500, 64)), r.normal(size=(500, 64)) / 8]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for g in neighbours.nearest(df).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    full, hit = x.astype(float), 0
    for q in range(0, 1500, 100):
        d = ((full - full[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 150 >= 0.9


def test_a_hub_has_no_large_meeting(spark):
    """All vectors of a sphere list the one at its centre."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 32))
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), r.normal(size=(1, 32)) / 50]).astype(np.float32)
    pack = neighbours.packed_as("f")
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(pack(x))], "id long, vec binary")
    graph = neighbours.neighbour_graph(nodes, rounds=2)
    listed = graph.selectExpr("explode(nbrs) AS n").filter("n = 3000").count()
    assert listed > 1000
    sizes = neighbours._meetings(graph, neighbours.DEGREE).groupBy("center").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 2 * neighbours.DEGREE


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(i % 7), float(i), 1.0]) for i in range(60)] + [(100 + i, [float(i), 2.0]) for i in range(30)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=50).collect()
    own = {}
    for g in got:
        own.setdefault(g.query_id, []).append((g["rank"], g.vec_id))
    assert set(own) == {0, 50, 100} and sorted(own[100]) == [(1, 101), (2, 102), (3, 103)]
    assert all(v < 100 for q in (0, 50) for _, v in own[q])

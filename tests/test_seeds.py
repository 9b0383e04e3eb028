"""Spread-out seeds against the cover tree of all points."""

import numpy as np
import pytest
from test_models import frame

from quillmesh.operators import covertree, seeds


@pytest.mark.parametrize(("dim", "k"), [(2, 40), (3, 7), (16, 25)])
def test_spread_out_is_the_tree(spark, dim, k):
    x = np.random.default_rng(dim).normal(size=(300, dim))
    tree = covertree.Tree(np.arange(300), x)
    assert np.allclose(seeds.spread_out(frame(spark, x), k), x[tree.spread(k)])


def test_spread_out_edges(spark):
    same = [[1.0, 2.0]] * 5
    assert seeds.spread_out(frame(spark, same), 5).tolist() == same
    with pytest.raises(ValueError, match="fewer points"):
        seeds.spread_out(frame(spark, same), 6)


def test_spread_out_finds_one_remote_point(spark):
    n = 60_000
    points = spark.range(n).selectExpr("id", "array(double(id % 7), double(id % 11)) AS v")
    for remote in (n + 1, n + 2, n + 3):
        far = spark.createDataFrame([(remote, [1e4, 1e4])], "id long, v array<double>")
        assert [1e4, 1e4] in seeds.spread_out(points.unionByName(far), 3).tolist()

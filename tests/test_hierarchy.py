"""Trees by doubling: deep, wide and broken ones."""

import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import hierarchy as H
from tallyshelf.operators.catalog import category_rollup
from tallyshelf.sources.feeds import build_taxonomy


def plain(parent):
    """(ancestor, descendant, distance) by walking up from each node."""
    out = []
    for node in parent:
        at, n = node, 0
        while at is not None:
            out.append((at, node, n))
            at, n = parent.get(at), n + 1
    return sorted(out)


def frame(spark, parent):
    return spark.createDataFrame([(k, p, f"n{k}") for k, p in parent.items()], "node long, parent long, name string")


def test_random_forest(spark):
    r = random.Random(1)
    parent = {k: r.choice([None, *range(max(0, k - 5), k)]) if k else None for k in range(200)}
    nodes = frame(spark, parent)
    want = plain(parent)
    assert sorted(map(tuple, H.closure(nodes.union(nodes)).collect())) == want
    top = {d: (a, n) for a, d, n in want if parent[a] is None}
    assert {r.node: (r.root, r.level) for r in H.rooted(nodes).collect()} == top
    paths = {r.node: r.path for r in H.breadcrumbs(nodes, "/").collect()}
    assert paths == {k: "/".join(f"n{a}" for a, d, n in sorted(want, key=lambda x: -x[2]) if d == k) for k in parent}
    for start in (0, 3, 50):
        assert sorted(map(tuple, H.subtree(nodes, F.col("node") == start).collect())) == sorted((d, n) for a, d, n in want if a == start)
    assert H.subtree(nodes, F.col("node") == 999).count() == 0


def test_chain_of_a_thousand_levels(spark):
    nodes = spark.range(1000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("x").alias("name"))
    pairs = H.closure(nodes)
    assert pairs.count() == 1000 * 1001 // 2
    assert pairs.filter("distance <> descendant - ancestor").count() == 0
    assert tuple(H.breadcrumbs(nodes, "").agg(F.max("level"), F.max(F.length("path"))).first()) == (999, 1000)
    counts = spark.createDataFrame([(999, 3, 1.0, 2.0), (500, 4, 0.5, 1.0)], "node long, n long, min_price double, max_price double")
    got = {r.ancestor: (r.n, r.min_price, r.max_price) for r in category_rollup(pairs, counts).collect()}
    assert (len(got), got[0], got[501]) == (1000, (7, 0.5, 2.0), (3, 1.0, 2.0))


def test_two_million_nodes(spark):
    nodes = spark.range(2_000_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 20)).alias("parent"))
    levels = {r.level: r["count"] for r in H.rooted(nodes).groupBy("level").count().collect()}
    assert levels == {0: 1, 1: 20, 2: 400, 3: 8000, 4: 160_000, 5: 1_831_579}
    sums = H.closure(nodes).agg(F.count("*").alias("n"), F.sum("distance").alias("d")).first()
    assert (sums.n, sums.d) == (sum((k + 1) * n for k, n in levels.items()), sum(k * (k + 1) // 2 * n for k, n in levels.items()))


@pytest.mark.parametrize("parent", [{1: 1}, {1: 2, 2: 1}, {0: None, 1: 3, 2: 1, 3: 2, 4: 3}, {k: (k + 1) % 33 for k in range(33)}])
def test_cycles_are_told(spark, parent):
    nodes = frame(spark, parent)
    for f in (H.closure, H.rooted, H.breadcrumbs):
        with pytest.raises(ValueError, match="cycle"):
            f(nodes).count()


def test_odd_trees(spark):
    empty = frame(spark, {1: None}).limit(0)
    assert H.closure(empty).count() == H.rooted(empty).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (2, 9, "b"), (3, 2, "c"), (None, 1, "d"), (4, 1, None)], "node long, parent long, name string")
    assert sorted(map(tuple, H.closure(odd).collect())) == [(1, 1, 0), (1, 4, 1), (2, 2, 0), (2, 3, 1), (3, 3, 0), (4, 4, 0), (9, 2, 1), (9, 3, 2)]
    assert sorted(map(tuple, H.breadcrumbs(odd).collect())) == [(1, 0, "a"), (4, 1, None)]


def test_featured_children(spark):
    edges = [("Home", None, 0), ("Accessories", "Home", 0), ("Smartphones", "Home", 1), *((f"A {k}", "Accessories", k) for k in range(9)), *((f"S {k}", "Smartphones", k) for k in range(9))]
    got = build_taxonomy(spark.createDataFrame(edges, "name string, parent string, position int")).filter("is_featured")
    assert {r.name for r in got.collect()} == {"Accessories", "Smartphones", *(f"A {k}" for k in range(5)), *(f"S {k}" for k in range(8))}
    assert {r.path for r in got.filter("name = 'A 4'").collect()} == {"home/accessories/a-4"}

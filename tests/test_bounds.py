"""Loops end when nothing is left; a bound that is met with rows left raises."""

import pytest

from stratalith.operators import extraction, graph, ranking

N = 12


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(i, i + 1) for i in range(N)], "src long, dst long")


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([(i, (i + 1) % N) for i in range(N)], "src long, dst long")


def test_closure(spark, chain):
    seeds = spark.createDataFrame([(0,)], "seed long")
    assert {(r.id, r.level) for r in graph.transitive_closure(chain, seeds, N).collect()} == {(i, i) for i in range(1, N + 1)}
    with pytest.raises(ValueError, match="left"):
        graph.transitive_closure(chain, seeds, 5)


def test_paths(spark, chain):
    pairs = spark.createDataFrame([(0, N)], "start long, goal long")
    assert graph.shortest_paths(chain, pairs, N).first().path == list(range(N + 1))
    with pytest.raises(ValueError, match="left"):
        graph.shortest_paths(chain, pairs, 5)


def test_cycles(ring):
    assert {(r.id, r.cycle) for r in graph.cycle_members(ring).collect()} == {(i, 0) for i in range(N)}
    with pytest.raises(ValueError, match="left"):
        graph.cycle_members(ring, 5)


def test_levels(spark, chain):
    nodes = spark.range(N + 1)
    assert {(r.id, r.level) for r in graph.topological_levels(nodes, chain, N + 1).collect()} == {(i, i) for i in range(N + 1)}
    with pytest.raises(ValueError, match="left"):
        graph.topological_levels(nodes, chain, 5)


def test_deep_trees_and_types(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(20)], "id long, parent_id long, pos int")
    assert [(r.id, r.depth) for r in ranking.flatten_tree(tree).collect()] == [(i, i) for i in range(20)]
    with pytest.raises(ValueError, match="left"):
        ranking.flatten_tree(tree, 16)
    types = spark.createDataFrame([(1, "A" + "[]" * 9)], "id int, raw string")
    assert extraction.parse_types(types).count() == 10
    with pytest.raises(ValueError, match="left"):
        extraction.parse_types(types, 6)

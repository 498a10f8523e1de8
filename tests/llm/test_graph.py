"""Components of links: few shuffles a round, no round that only confirms, and forests that hand their last node on."""

import random

import pytest

from civlake.llm import graph


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of what components() writes, with shuffles that are left as many as they are set."""
    found, write = [], graph.stashed

    def noted(df, name):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "stashed", noted)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield found
    spark.conf.set(key, before)


def test_links_to_roots_are_written_once(spark, plans):
    links = spark.createDataFrame([(k, k // 50 * 50) for k in range(400)], "a long, b long").repartition(3)
    assert dict(graph.components(links).collect()) == {k: k // 50 * 50 for k in range(400)}
    assert len(plans) == 1


def test_a_round_has_few_shuffles_and_chains_take_few_rounds(spark, plans):
    rng = random.Random(8)
    names = rng.sample(range(1000), 90)
    pairs = [*zip(names, names[1:], strict=False), *((k, 5000) for k in range(2000, 2040)), *((k + 1, k) for k in range(3000, 3064))]
    want = graph.Forest()
    for a, b in pairs:
        want.link(a, b)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    assert dict(graph.components(links).collect()) == {x: want.root(x) for x in want.up}
    assert 2 <= len(plans) <= 8
    assert max(p.count("Exchange") for p in plans) <= 3


def test_a_node_whose_links_a_full_forest_parts_ties_its_ends(monkeypatch):
    monkeypatch.setattr(graph, "FOREST_NODES", 1)
    forests = [list(zip(*(c.to_pylist() for c in f.columns), strict=True)) for f in graph.spanning([([9], [1]), ([], []), ([9], [2]), ([], [])])]
    assert (2, 1) in sum(forests, [])

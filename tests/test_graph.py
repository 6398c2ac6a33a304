"""Communities against a brute-force greedy on small graphs."""

import itertools
import random

import pytest

from chronoloom.operators import graph as G


def modularity(edges, labels):
    total = 2 * sum(w for *_, w in edges)
    out = 0.0
    for c in set(labels.values()):
        within = sum(2 * w for a, b, w in edges if labels[a] == labels[b] == c)
        size = sum((labels[a] == c) * w + (labels[b] == c) * w for a, b, w in edges)
        out += within / total - (size / total) ** 2
    return out


def greedy(edges):
    """Join the two communities that gain most, until none gains."""
    labels = {v: v for a, b, _ in edges for v in (a, b)}
    now = modularity(edges, labels)
    while True:
        tried = [(modularity(edges, {v: (x if c == y else c) for v, c in labels.items()}), x, y) for x, y in itertools.combinations(sorted(set(labels.values())), 2)]
        best = max(tried, default=(now, 0, 0))
        if best[0] <= now + 1e-12:
            return now
        now, labels = best[0], {v: (best[1] if c == best[2] else c) for v, c in labels.items()}


def planted(seed, groups, size, inside, between):
    rng = random.Random(seed)
    of = {v: v % groups for v in range(groups * size)}
    return [(a, b, round(rng.uniform(0.5, 2), 2)) for a, b in itertools.combinations(of, 2) if rng.random() < (inside if of[a] == of[b] else between)]


def held(edges, found):
    labels = {r.v: r.community for r in found.collect()}
    assert set(labels) == {v for a, b, _ in edges for v in (a, b)}
    assert all(labels[c] == c and c == min(v for v, x in labels.items() if x == c) for c in set(labels.values()))
    return modularity(edges, labels)


@pytest.mark.parametrize("seed, groups, size, inside, between", [(1, 3, 6, 0.8, 0.05), (2, 4, 5, 0.7, 0.15), (3, 1, 14, 0.3, 0.3), (4, 2, 2, 1.0, 0.0)])
def test_small_graphs_against_greedy(spark, seed, groups, size, inside, between):
    edges = planted(seed, groups, size, inside, between)
    assert held(edges, G.modular_communities(spark.createDataFrame(edges, "a long, b long, weight double"))) == pytest.approx(greedy(edges))


def test_rounds_over_tasks_against_greedy(spark):
    """Without a task that finishes the rest: 95 % of what the greedy one reaches."""
    edges = planted(1, 3, 6, 0.8, 0.05)
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    found = G.modular_communities(df, one_task=0, levels=2)
    assert G.modularity(df, found) == pytest.approx(held(edges, found))
    assert held(edges, found) >= 0.95 * greedy(edges)


def test_odd_graphs(spark):
    assert G.modular_communities(spark.createDataFrame([], "a long, b long, weight double")).count() == 0
    rows = [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 2.0), (4, 4, 1.0)]
    labels = {r.v: r.community for r in G.modular_communities(spark.createDataFrame(rows, "a long, b long, weight double")).collect()}
    assert labels == {1: 1, 2: 1, 3: 3, 4: 3}

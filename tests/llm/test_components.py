"""Components against union-find in plain Python, with chunks so small that joins are needed."""

import random

import pytest

from lithoframe.llm import components as c


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u != v:
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("chunk", [20, c.CHUNK])
def test_paths_stars_and_repeats(spark, chunk, monkeypatch):
    rng = random.Random(5)
    path = list(range(1000, 1120))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(7, x) for x in range(2000, 2040)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    edges += edges[:30] + [(5, 5), (-4, 2), (2, -9)]
    rng.shuffle(edges)
    rounds, star = [], c._star
    monkeypatch.setattr(c, "_star", lambda e, large: rounds.append(large) or star(e, large))
    got = [tuple(r) for r in c.components(spark.createDataFrame(edges, "u long, v long").repartition(8), chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges)
    assert bool(rounds) == (chunk == 20)


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0

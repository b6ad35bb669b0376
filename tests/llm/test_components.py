"""Components against union-find, and how many rounds they take."""

import random

import pytest

from trapline.llm import components


def slow(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


RNG = random.Random(4)
CASES = {
    "none": [],
    "loops only": [(3, 3), (4, 4)],
    "stars": [(1, k) for k in range(2, 60)] + [(100, k) for k in range(101, 140)],
    "star with the largest in the middle": [(500, k) for k in range(60)],
    "path": [(k, k + 1) for k in range(70)],
    "shuffled path, both ways, repeated": [e for k in range(60) for e in [((k * 37) % 61, ((k + 1) * 37) % 61)] * 2] + [(5, 4)],
    "random": [(RNG.randrange(300), RNG.randrange(300)) for _ in range(220)],
    "signed": [(-5, 7), (7, -(1 << 62)), (1 << 62, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_against_union_find(spark, name):
    edges = spark.createDataFrame(CASES[name], "a long, b long")
    rows = components.component_roots(edges).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(got) == len(rows)
    assert got == slow(CASES[name])


def test_stars_take_no_round(spark, monkeypatch):
    asked = []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda e: asked.append(stars(e)) or asked[-1])
    components.component_roots(spark.createDataFrame(CASES["stars"], "a long, b long"))
    assert asked == [True]
    components.component_roots(spark.createDataFrame(CASES["star with the largest in the middle"], "a long, b long"))
    assert asked == [True, False, True]

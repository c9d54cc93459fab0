from __future__ import annotations

import hashlib

import numpy as np
import pytest

from gaugework.operators import factors, spectral
from helpers import frame


def edges(spark, data, parts=3):
    return frame(spark, data, "src long, dst long, weight double").repartition(parts)


def blocks(sizes, seed=2, bridges=2):
    rng = np.random.default_rng(seed)
    out, first, heads = [], 0, []
    for n in sizes:
        ids = range(first, first + n)
        out += [(a, b, float(rng.integers(1, 4))) for a in ids for b in ids if a < b and rng.random() < 0.7]
        out += [(first, b, 1.0) for b in ids if b > first]
        heads.append(first)
        first += n
    return out + [(a, b, 0.05) for a, b in zip(heads, heads[1:])][:bridges]


def by_hand(data, rounds):
    ids = sorted({x for a, b, _ in data for x in (a, b)})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b, x in data:
        if a != b:
            w[at[a], at[b]] += x
            w[at[b], at[a]] += x
    v = np.array([int(hashlib.md5(f"power:{i}".encode()).hexdigest()[:12], 16) / (1 << 48) for i in ids])
    v /= v.sum()
    for _ in range(rounds):
        v = w / w.sum(axis=1, keepdims=True) @ v
        v /= abs(v).sum()
    return dict(zip(ids, v))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_the_vector_equals_the_rounds_of_the_whole_matrix(spark, monkeypatch, parts):
    """Both directions, repeated pairs, loops and a hub whose links lie over several blocks."""
    monkeypatch.setattr(factors, "BLOCK_EDGES", 50)
    data = blocks([9, 12, 7]) + [(3, 1, 2.0), (1, 3, 2.0), (5, 5, 9.0)] + [(0, k, 1.0) for k in range(40, 120)]
    df = edges(spark, [*data, (None, 1, 1.0), (1, 2, None)], parts)
    got = {r["id"]: r["v"] for r in spectral.power_vector(df, 4, acceleration=0.0).collect()}
    exact = by_hand(data, 4)
    assert got.keys() == exact.keys() and all(got[k] == pytest.approx(exact[k], abs=1e-12) for k in exact)


def test_planted_clusters_are_found(spark):
    data = blocks([14, 14, 14])
    found = spectral.power_iteration_clustering(edges(spark, data), 3, 15).collect()
    clusters = {r["id"]: r["cluster"] for r in found}
    groups = [{clusters[i] for i in range(a, a + 14)} for a in (0, 14, 28)]
    assert len(clusters) == 42 and all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_rounds_end_when_the_vector_no_longer_turns(spark, monkeypatch):
    calls = []
    whole = factors.Blocks.meet
    monkeypatch.setattr(factors.Blocks, "meet", lambda self, *a: calls.append(1) or whole(self, *a))
    spectral.power_vector(edges(spark, [(a, b, 1.0) for a in range(6) for b in range(a)]), 30)
    assert len(calls) < 12


def test_no_edges(spark):
    assert spectral.power_iteration_clustering(edges(spark, [(1, 1, 1.0)]), 2, 3).count() == 0

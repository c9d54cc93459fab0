from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.functions import text
from gaugework.operators import graph
from helpers import frame, rows


def pagerank_numpy(edges, iterations, d):
    edges = set(edges)
    nodes = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(iterations):
        new = np.full(len(nodes), (1 - d) / len(nodes))
        for n in nodes:
            if out[n]:
                for b in out[n]:
                    new[at[b]] += d * rank[at[n]] / len(out[n])
            else:
                new += d * rank[at[n]] / len(nodes)
        rank = new
    return dict(zip(nodes, rank))


@pytest.mark.parametrize("iterations", [1, 7])
def test_pagerank_with_dangling_and_hot_vertices(spark, iterations):
    draw = random.Random(4)
    edges = [(0, n) for n in range(1, 150)] + [(draw.randrange(1, 100), draw.randrange(200)) for _ in range(200)]
    got = {r["node"]: r["rank"] for r in graph.pagerank(frame(spark, edges, "src int, dst int"), iterations).collect()}
    expected = pagerank_numpy(edges, iterations, 0.85)
    assert got.keys() == expected.keys()
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[n] == pytest.approx(expected[n]) for n in got)


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(frame(spark, [], "src int, dst int")).count() == 0


def paths_brute(edges, hops):
    step = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        step[a][b] += w
    paths = {a: dict(v) for a, v in step.items()}
    for _ in range(hops - 1):
        longer = {}
        for a, ends in paths.items():
            total = defaultdict(float)
            for middle, w in ends.items():
                for b, x in step[middle].items() if middle in step else ():
                    total[b] += w * x
            if total:
                longer[a] = dict(total)
        paths = longer
    return paths


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_n_hop_weight(spark, hops):
    draw = random.Random(5)
    edges = [(draw.randrange(30), 0, 1.0) for _ in range(30)] + [(0, n, float(n % 5)) for n in range(60)]
    edges += [(draw.randrange(30), draw.randrange(30), float(draw.randrange(1, 4))) for _ in range(100)]
    got = rows(graph.n_hop_weight(frame(spark, edges, "src int, dst int, weight double"), hops, 4))
    expected = [
        (a, b, w)
        for a, ends in paths_brute(edges, hops).items()
        for b, w in sorted(ends.items(), key=lambda e: (-e[1], e[0]))[:4]
    ]
    assert got == sorted(expected, key=repr)


def test_inverted_index_blocks_bound_the_postings(spark):
    docs = [(i, "the " + ("cat cat" if i % 3 == 0 else "dog")) for i in range(50)] + [(50, ""), (51, None)]
    index = graph.inverted_index(frame(spark, docs, "id bigint, text string"), "id", "text", block=8).collect()
    assert max(len(r["postings"]) for r in index) == 8
    whole = defaultdict(list)
    for r in sorted(index, key=lambda r: (r["term"], r["block"])):
        whole[r["term"]] += [tuple(p) for p in r["postings"]]
        assert r["df"] == {"the": 50, "cat": 17, "dog": 33}[r["term"]]
    assert whole["the"] == [(i, 1) for i in range(50)]
    assert whole["cat"] == [(i, 2) for i in range(0, 50, 3)]


def test_index_moves_each_posting_once_and_adds_rows_of_one_id(spark, capsys):
    data = [(None, "b b"), (0, "a b a"), (0, "a c"), (1, None), (3, "B"), (9, "b")] + [(k, "x") for k in range(100, 140)]
    docs = frame(spark, data, "doc int, text string").repartition(3)
    found = {(r["term"], r["block"]): (r["df"], [tuple(p) for p in r["postings"]]) for r in graph.inverted_index(docs, "doc", "text", block=4).collect()}
    assert found["a", 0] == (1, [(0, 3)]) and found["b", 0] == (4, [(0, 1), (3, 1)]) and found["b", 2] == (4, [(9, 1)])
    assert found["b", None] == (4, [(None, 2)]) and found["c", 0] == (1, [(0, 1)])
    assert sum(len(p) for (term, _), (_, p) in found.items() if term == "x") == 40 and found["x", 25] == (40, [(k, 1) for k in range(100, 104)])
    text.count_tokens(docs, "text", F.col("doc")).explain()
    assert "hashpartitioning" not in capsys.readouterr().out

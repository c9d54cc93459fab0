from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import jaccard_join
from gaugework.llm.bytewords import Words, shingle_sets


def sets_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            lists[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g] if j > k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def check(documents, rows):
    found = jaccard_join.near_duplicates(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components_by_hand(rows)


def altered(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.choice([5, 6, 8, 9, 12, 30, 80, 200]))]
        if rng.random() < 0.4:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randint(1, 6)):
            rows.append((n, " ".join(altered(rng, base, rng.randint(0, max(1, len(base) // 25))))))
            n += 1
    hot = [word() for _ in range(100)]
    rows += [(n + k, " ".join(altered(rng, hot, 1 + k % 3))) for k in range(150)]
    rows += [(2000 + k, " ".join(hot)) for k in range(50)]
    chain = [f"c{k}" for k in range(60)]
    for k in range(12):  # each is close to the next only
        rows.append((3000 + k, " ".join(chain[k * 3 :] + [f"d{j}" for j in range(k * 3)])))
    rows += [(4000, None), (4001, ""), (4002, " \n "), (4003, "one two"), (4004, "One TWO"), (4005, "one"), (4006, "É a b c d"), (4007, "é a b c d")]
    rows += [(4003, "one two"), (None, "one two"), (None, "null alone here"), (4008, "w " * 50_000), (4009, "w " * 40_000)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(documents, corpus):
    check(documents, corpus)


def test_blocks_parts_and_lists_of_frequent_shingles(documents, corpus, monkeypatch):
    for name, value in (("PART_ROWS", 8), ("BLOCK_ROWS", 8), ("LEAST_FREQUENT", 2), ("EMIT_ROWS", 50), ("COUNT_BLOCK", 500)):
        monkeypatch.setattr(jaccard_join, name, value)
    check(documents, corpus)


@pytest.mark.parametrize("limit", [0, 12, 64])
def test_any_boundary_gives_the_same(documents, corpus, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "boundary", lambda length, percent: limit)
    small = [r for r in corpus if r[1] is None or len(r[1]) < 600]
    check(documents, small)


def test_boundary_grows_with_the_lists():
    assert jaccard_join.boundary(1.0, 75) <= jaccard_join.boundary(2.0, 75) <= jaccard_join.boundary(5.0, 75)


def test_empty_table_and_clashing_columns(documents):
    assert jaccard_join.near_duplicates(documents([])).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    extra = documents([(1, text), (2, text + " x"), (3, "other text of some words")]).withColumn("fp", F.lit(1)).withColumn("label", F.lit(1))
    left = jaccard_join.drop_near_duplicates(extra)
    assert left.columns == extra.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_rounds_before_the_last_hand_on_few_pairs_of_a_large_group(documents, monkeypatch):
    rng = random.Random(5)
    hot = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(altered(rng, hot, 2 + k % 2))) for k in range(250)]
    met, write = [], jaccard_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "join-across":
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    check(documents, rows)
    assert met and max(met[: jaccard_join.BEST_ROUNDS]) < jaccard_join.PAIRS_A_MEMBER * len(rows)


def test_a_pair_of_many_lists_goes_on_from_one(documents, monkeypatch):
    rng = random.Random(6)
    hot = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(altered(rng, hot, 1 + k % 2))) for k in range(60)]
    met, write = [], jaccard_join.materialise

    def kept(df, name):
        out = write(df, name)
        if name == "join-met":
            pairs = [(r.a, r.b) for r in out.where("a is not null").collect()]
            met.append((len(pairs), len(set(pairs))))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", kept)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 1)
    check(documents, rows)
    assert met[0][1] and met[0][0] <= 1.2 * met[0][1]


def test_blocks_grow_with_their_list_and_each_two_members_meet_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    members = spark.range(100).selectExpr("7L as sig", "id as fp", "20 as n")
    labels = spark.createDataFrame([], "fp long, label long")
    rows = jaccard_join.blocks(members, spark.createDataFrame([(7,)], "sig long"), labels).collect()
    assert len(rows) <= jaccard_join.LIST_BLOCKS * 100
    meet = Counter()
    for chunk in {r.chunk for r in rows}:
        own = [r for r in rows if r.chunk == chunk]
        meet.update((a.fp, b.fp) for a in own for b in own if a.fp < b.fp and (a.side == 0 or a.side != b.side))
    assert len(meet) == 4950 and set(meet.values()) == {1}


def test_null_and_shared_ids_lose_only_their_own_copies(documents):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    a, b, x, y = (text(name) for name in "abxy")
    rows = [(None, a), (None, b), (5, b + " end"), (7, x), (9, x + " end"), (7, y), (3, y + " end"), (None, None), (5, "")]
    left = jaccard_join.drop_near_duplicates(documents(rows)).collect()
    stay = [(None, a), (5, b + " end"), (7, x), (3, y + " end"), (None, None), (5, "")]
    assert Counter((r.doc_id, r.text) for r in left) == Counter(stay)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A b\tc", "", None, "é É x", "y" * 200_000 + " a", "a " + "y" * 200_000, "b " * 70_000 + "a b c"]
    words = Words(pa.array(texts))
    hashes, seen = words.hashes(), {}
    for first, last, value in zip(words.first, words.last, hashes):
        assert seen.setdefault(bytes(words.lowered[first:last]), value) == value
    assert len(set(seen.values())) == len(seen)
    assert words.count.tolist() == [3, 0, 0, 3, 2, 2, 70_003]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [1, 0, 0, 1, 1, 1, 4]
    assert np.array_equal(shingle_sets(pa.array(["A B"]))[0], shingle_sets(pa.array(["a  b"]))[0])

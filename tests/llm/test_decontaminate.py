from __future__ import annotations

import random
import re

import pytest

from gaugework.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    found = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            size = min(10, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == w[k : k + size]:
                        hit.update(range(at, at + size))
                        names.add("" if item is None else str(item))
        found.append((doc_id, len(own), len(hit), sorted(names), bool(hit)))
    return sorted(found, key=repr)


def run(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontaminate.decontaminate(docs, items, **options).collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "D", "é", "ñandú", "x1", "don't", "Zwölf", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 25]))) for k in range(25)] + [(3, text(12)), (None, text(11)), (7, None), (8, "...")]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1] or ""
            parts += [rng.choice([passage, passage.upper(), passage[: len(passage) // 2]]), text(rng.randrange(8))]
        docs.append((k, rng.choice([" ", "\n"]).join(parts)))
    return docs + [(900, None), (901, ""), (902, "   "), (None, items[0][1]), (5, docs[5][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_brute_force(spark, seed):
    docs, items = made(seed)
    got = run(spark, docs, items)
    assert got == by_hand(docs, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_blocks_of_windows_give_the_same(spark):
    docs, items = made(3)
    assert run(spark, docs, items, block_windows=40) == by_hand(docs, items)


def test_windows_do_not_cross_documents_and_long_texts_are_whole(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    head, tail = passage.split(" ")[:6], passage.split(" ")[6:]
    long = "filler words " * 60_000 + passage + " more"
    docs = [(1, " ".join(head)), (2, " ".join(tail)), (3, long), (4, passage)]
    got = {r[0]: r[1:] for r in run(spark, docs, [(1, passage)])}
    assert got[1][1] == got[2][1] == 0
    assert got[3] == (120_013, 12, ["1"], True)
    assert got[4] == (12, 12, ["1"], True)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, item_id string").selectExpr("*", "1 AS _n", "2 AS items", "3 AS words")
    items = spark.createDataFrame([(4, "B", 1)], "item_id long, text string, doc_id long")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, items).collect()] == [(1, 3, 1, ["4"], True)]


def test_the_key_of_a_window_is_its_rarest_shingle(spark):
    block = decontaminate.Block(["a b c d"], [["1"]])
    first, second = (int(s) for s in block.shingles[0])
    for rare, place in ((first, 0), (second, 1)):
        keys, _, users = block.keys({first: 5, second: 5, rare: 2})[3]
        assert keys.tolist() == [rare] and users == [[(0, place)]]

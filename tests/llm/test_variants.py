from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from gaugework.llm import variants

LETTERS = "abcdéñ"


def edits(a, b):
    """Edit distance by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def changed(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(LETTERS) + word[k:], word[:k] + rng.choice(LETTERS) + word[k + 1 :]])


def by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in variants.RUN.findall(small):
            drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drawn % 199 == 0:
                run = run[: drawn % len(run)] + run[drawn % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, rows = {}, []
    for w, n in kept.items():
        close = [x for x in kept if abs(len(x) - len(w)) < 2 and edits(x, w) == 1]
        best = min(close, key=lambda x: (-kept[x], x), default=None)
        form = best if best and kept[best] >= 5 * n else None
        forms[w] = form
        rows.append((w, form, n, len(close), kept[form] if form else None))
    out = []
    for w, form, n, close, form_n in rows:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, form, root, n, close, form_n))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in variants.spelling_variants(df).collect()), key=repr)


def corpus(seed, words=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 11))) for _ in range(words)]
    bag = []
    for w in base:
        bag += [w] * rng.choice([5, 30, 400])
        for _ in range(rng.randrange(6)):
            near = changed(rng, w)
            bag += [near] * rng.choice([5, 6, 40]) + [changed(rng, near)] * rng.choice([1, 5, 9])
    rng.shuffle(bag)
    bag = [w.upper() if rng.random() < 0.1 else w for w in bag]
    return [(k, rng.choice([" ", "-", "\n1"]).join(bag[k::150])) for k in range(150)] + [(None, base[0]), (7, None), (8, ""), (9, "12 !")]


@pytest.mark.parametrize(("seed", "frequent", "members"), [(1, 256, 64), (2, 3, 64), (3, 3, 2), (4, 20, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, frequent, members):
    """With small bars the dictionary has longer grams and nearly all lists are cut up."""
    monkeypatch.setattr(variants, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(variants, "LIST_WORDS", members)
    docs = corpus(seed)
    got = run(spark, docs)
    assert got == by_hand(docs)
    assert sum(r[1] is not None for r in got) > 10 and any(r[2] not in (r[0], r[1]) for r in got)


@pytest.mark.parametrize("longest", [3, 4, 5])
def test_an_edit_loses_no_more_grams_than_the_bound(monkeypatch, longest):
    monkeypatch.setattr(variants, "LONGEST", longest)
    rng = random.Random(longest)
    draw = lambda n: "".join(rng.choice("abc") for _ in range(n))
    for _ in range(40):
        by = variants.Decomposer({draw(rng.randrange(3, longest + 1)) for _ in range(25)})
        for _ in range(40):
            word = draw(rng.randrange(3, 10))
            kept, lengths = by.decompose(word)
            bound = by.bound(word, kept, lengths)
            for k in range(len(word) + 1):
                for new in {word[:k] + c + word[k + d :] for c in "abcx" for d in (0, 1)} | {word[:k] + word[k + 1 :]}:
                    if len(new) < 2 or not variants.near(word, new):
                        continue
                    after = Counter((new[a : a + q], a) for a, q in by.decompose(new)[0])
                    shift = len(new) - len(word)
                    lost = sum(not (after[word[a : a + q], a] or after[word[a : a + q], a + shift]) for a, q in kept)
                    assert lost <= bound, (word, new, by.grams)


def test_near_is_one_edit(monkeypatch):
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
        assert variants.near(a, b) == (edits(a, b) == 1)


def test_pieces_cut_no_run():
    text = "abc déf, ghi " * 200
    assert "".join(variants.pieces(text, 7)) == text
    assert [r for p in variants.pieces(text, 7) for r in variants.RUN.findall(p)] == variants.RUN.findall(text)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short")]) == []
    df = spark.createDataFrame([(1, "palabra " * 6)], "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS root")
    assert [tuple(r) for r in variants.spelling_variants(df).collect()] == [("palabra", None, "palabra", 6, 0, None)]

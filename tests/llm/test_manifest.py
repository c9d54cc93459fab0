from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from gaugework.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*(field(v) for v in (doc_id, source, lang, n_chars, text)))


def small(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def walk(levels, pos, digest):
    """Siblings from the leaf up and the digest folded with them."""
    siblings = []
    for level in levels[:-1]:
        run = level[pos - pos % 16 : pos - pos % 16 + 16]
        siblings += run[: pos % 16] + run[pos % 16 + 1 :]
        digest = h(*run[: pos % 16], digest, *run[pos % 16 + 1 :])
        pos //= 16
    return siblings, digest


def by_hand(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0], leaf(row, row[1]), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    levels = {s: tree([x[1] for x in trees[s]]) for s in order}
    top = tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, (doc_id, digest, row) in enumerate(trees[s]):
            touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            start = leaf(row, small(row[1])) if touched else digest
            below, folded = walk(levels[s], pos, start)
            above, folded = walk(top, k, folded)
            root = top[-1][0]
            out.append((doc_id, digest, levels[s][-1][0], root, h(*below, *above), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in manifest.merkle_manifest(df).collect()), key=repr)


def test_manifest_equals_trees_built_by_hand(spark):
    rng = random.Random(4)
    sizes = {"a": 1, "b": 2, "ü": 16, "c": 17, None: 40, "": 3, "z": 300}
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Some Text", "ſharp ÜBER", "x" * 500])
            rows.append((rng.randrange(-(10**9), 10**9), text, rng.choice([None, "en"]), source, rng.choice([None, 5])))
    got = found(spark, rows)
    assert got == by_hand(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_more_than_two_rounds_of_levels(spark):
    rows = [(k, f"T{k}", "en", "one", k) for k in range(5000)]
    assert found(spark, rows) == by_hand(rows)


def test_ids_that_repeat_are_null_or_at_the_ends_of_words_and_chunks(spark):
    ids = [None, None, None, 0, 63, 64, 4095, 4096, -1, -64, -4096, 7, 7, 7, (1 << 62), -(1 << 62)]
    rows = [(i, f"Text {k % 5}", "en", "s", None) for k, i in enumerate(ids)]
    rows += [(9, "Same Row", "en", "s", 1)] * 40
    assert found(spark, rows) == by_hand(rows)


def test_a_crowd_of_equal_rows_is_written_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES", 8)
    rows = [(3, "Same Row", "en", "s", 1)] * 90 + [(k, "Other", "en", "s", 1) for k in range(60)]
    assert found(spark, rows) == by_hand(rows)


def test_one_row_an_empty_table_and_clashing_columns(spark):
    row = (5, "Only", None, None, None)
    assert found(spark, [row]) == by_hand([row])
    assert found(spark, []) == []
    df = spark.createDataFrame([row], SCHEMA).selectExpr("*", "1 AS g", "2 AS leaf", "3 AS pos", "4 AS root", "5 AS word")
    assert [tuple(r) for r in manifest.merkle_manifest(df).collect()] == by_hand([row])


def test_no_group_of_slots_grows_with_a_source(spark):
    rows = spark.createDataFrame([(k, "t", "en", "hot", 1) for k in range(3000)], SCHEMA)
    at = manifest.places(manifest.leaves(rows))
    assert sorted(r["pos"] for r in at.collect()) == list(range(3000))
    assert manifest.bitmaps(manifest.leaves(rows)).selectExpr("max(size(words))").first()[0] <= 64

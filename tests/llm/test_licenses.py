from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gaugework.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
ROWS = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "mit\nlicense and Apache license, MIT-License!"), (5, "the license of mit"),
    (6, "x " * 60_000 + "GNU General Public License v3"), (7, "code\n" + MIT + "\nmore"), (8, "permission is not hereby granted to any person"),
    (9, "ÉMIT license"), (10, "public license"), (1, "Released under the MIT License."), (None, "apache license"), (11, "Licensed under CC BY-NC 4.0."),
    (12, "under cc by nc"), (13, "word_license mit`license mit license"), (14, "license " * 3000 + "mit license"),
]


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def found(spark, checkpoint_folder):
    docs = spark.createDataFrame(ROWS + [(100 + i, f"the terms of software {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    return licenses.scan_licenses(docs.withColumn("template", F.lit(1))).collect()


def test_base(found):
    assert len(found) == len(ROWS) + 40
    for r in found:
        text = next((t for i, t in ROWS if i == r.doc_id), None) if r.doc_id is None or r.doc_id < 100 else f"the terms of software {r.doc_id - 100}"
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(text), r


def test_templates(found):
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].labels == "mit" and by_id[7].score == 1.0 and by_id[7].base_labels == ""
    assert by_id[11].labels == "cc-by-nc" and by_id[11].matches[0]["offset"] == 0
    assert by_id[8].labels == "" and by_id[8].score == 0.0
    assert by_id[1].score == 1.0 and by_id[None].score >= 0.5 and by_id[2].matches is None
    assert all(0 <= r.score <= 1 for r in found)


def test_file_with_all_notices(documents):
    notices = [t.text for t in licenses.TEMPLATES]
    rows = [(1, "\n\n".join(notices)), (2, "\n\n".join(reversed(notices)) + " any charge free copy"), (3, "can any copy into binary forms")]
    rows += [(10 + i, "the terms of the license and software in source and public work") for i in range(30)]
    for r in licenses.scan_licenses(documents(rows)).where("doc_id < 10").collect():
        words = re.findall("[a-z0-9]+", dict(rows)[r.doc_id].lower())
        whole = set()
        for number, template in enumerate(licenses.TEMPLATES):
            own = template.text.split()
            whole |= {(number, i) for i in range(len(words)) if words[i : i + len(own)] == own}
        assert {(m["template"], m["offset"]) for m in r.matches or [] if m["share"] == 1.0} == whole
        assert r.labels == ",".join(sorted({licenses.TEMPLATES[n].label for n, _ in whole}))


def test_rare_words_are_indexed():
    idf = {w: 1.0 for t in licenses.TEMPLATES for w in t.text.split()} | {"the": 0.0, "mit": 5.0}
    postings = licenses.build_postings(licenses.TEMPLATES[:1], idf, keep=2)
    assert postings["mit"] == [(0, 3)] and len(postings) == 2 and "the" not in postings


def test_native_and_empty(documents):
    assert licenses.scan_licenses(documents([])).count() == 0
    plan = licenses.scan_licenses(documents([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from gaugework.operators import textjobs
from gaugework.sources.feeds import read_text_lines
from helpers import frame, rows


def md5(text):
    return hashlib.md5(text.encode())


def test_fingerprint_rows(spark):
    df = frame(spark, [(3, "a"), (1, "é"), (2, "a")], "id int, text string")
    assert rows(textjobs.fingerprint_rows(df, "text", "id")) == sorted(
        [(md5("a").hexdigest(), 2, 2), (md5("é").hexdigest(), 1, 1)], key=repr
    )


LISTS = [["a", "b"], ["it's", 'say "hi"'], ["both ' and \"", "back\\slash", "tab\tline\nend\r"], [], ["é", ""]]


@pytest.mark.parametrize("items", LISTS)
def test_fingerprint_lists_equals_the_definition(spark, items):
    whole = hashlib.md5()
    for item in items:
        whole.update(md5(repr(item)).digest())
    df = frame(spark, [(items,)], "items array<string>")
    assert textjobs.fingerprint_lists(df, "items").first()["fp"] == whole.hexdigest()


def test_grep_first_line(spark):
    df = frame(spark, [("one\ntwo a.b\nthree a.b",), ("axb",), ("",), (None,)], "text string")
    got = [r["line"] for r in textjobs.grep_first_line(df, "text", "a.b").collect()]
    assert got == ["two a.b", None, None, None]


def test_filter_by_pattern(spark):
    texts = ["call 555-1234", "none", "55-12"]
    got = textjobs.filter_by_pattern(frame(spark, [(t,) for t in texts], "text string"), "text", r"[0-9]{3}-[0-9]{2,4}")
    assert rows(got) == [(t,) for t in texts if re.findall(r"[0-9]{3}-[0-9]{2,4}", t)]


def test_power2_histogram(spark):
    values = [0.3, 0.7, 1.0, 1.4, 1.5, 3.0, 5.0, 6.0, 100.0, 1000.0]
    expected = {}
    for v in values:
        bucket = float(pow(2, int(math.log(v, 2) + 0.5)))
        expected[bucket] = expected.get(bucket, 0) + 1
    df = frame(spark, [(v,) for v in [*values, 0.0, -4.0, None]], "v double")
    got = dict(rows(textjobs.power2_histogram(df, "v")))
    assert got.pop(None) == 3
    assert got == expected


def test_text_lines(spark, tmp_path):
    text = "one  \ntwo\t\r\n\n  three \x0bfour five\x1f\n"
    (tmp_path / "t").write_bytes(text.encode())
    got = [r["value"] for r in read_text_lines(spark, str(tmp_path / "t")).collect()]
    assert got == [line.rstrip() for line in text.splitlines()]
    assert read_text_lines(spark, str(tmp_path / "t")).where(F.col("value") == "").count() == 1

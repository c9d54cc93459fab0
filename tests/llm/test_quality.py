from __future__ import annotations

import re

from pyspark.sql import functions as F

from gaugework.llm import quality


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 30, "a b c d e f g\na b c d e f g\n\n \nq",
    "tab\tform\x0cvert\x0bret\r\nnb sp   é# $%&|<>* end", "w1 w2 w3 w4 w5 w6 " * 3 + "tail", "line\nline\nline\n line\n", "🙂 🙂 🙂 🙂 🙂 🙂 🙂",
]


def test_counts(documents):
    rows = list(enumerate([*TEXTS, "a b c d e f g"]))
    found = {r.doc_id: tuple(r)[1:] for r in quality.judge(documents(rows).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    for i, text in rows:
        assert found[i] == by_hand(text), text


def test_verdicts(documents):
    prose = "The law of the land is that it was for all of us and not for the few. " * 1 + "Here are more words of plain prose to read."
    rows = [(1, prose), (2, "short one"), (3, "### $$$ %%% &&& ||| <<< >>> *** ### $$$ a b"), (4, "the same five words here " * 20),
            (5, " ".join(f"xq{i}z" for i in range(200))), (6, None), (1, prose), (7, " ".join(f"the w{i}" for i in range(50_000)))]
    found = {r.doc_id: r for r in quality.judge(documents(rows)).collect()}
    assert found[1].kept and not found[1].base_failed and found[7].kept
    assert found[2].base_failed and "length" in found[2].failed_rules
    assert found[3].failed_rules == ["symbols"] and not found[3].kept
    assert found[4].base_failed
    assert found[5].failed_rules == ["stop_words"] and not found[5].base_failed
    assert found[6].n_words == 0 and not found[6].kept
    assert quality.judge(documents(rows)).where("doc_id = 1").count() == 2


def test_empty_table_and_clashing_columns(documents):
    assert quality.judge(documents([])).count() == 0
    out = quality.judge(documents([(1, "a b")]).withColumn("kept", F.lit("mine")).withColumn("_words", F.lit(3)))
    assert out.columns.count("kept") == 1 and out.first().n_words == 2 and out.first().kept is False


def test_no_user_function_and_no_shuffle(documents):
    plan = quality.judge(documents([(1, "a")], 1).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1  # the one of the fixture's repartition


def test_words_parted_by_bars_fail_the_symbols_rule(documents):
    """One bar for every two or more words, far below one a word; a sign in a hundred words is let pass."""
    words = "the quick brown fox jumps over lazy dogs and cats while nobody looks at them today".split()
    barred = " | ".join(" ".join(words[k : k + 3]) for k in range(0, 15, 3))
    clean = " ".join(f"{w}{k}" for k in range(7) for w in words) + " R&D"
    found = {r["doc_id"]: r for r in quality.judge(documents([(1, barred), (2, clean)])).collect()}
    assert found[1].failed_rules == ["symbols"] and not found[1].kept
    assert "symbols" not in found[2].failed_rules

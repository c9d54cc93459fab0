"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import SPACES

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages; a text of some length without any of them is no prose.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "at", "by", "a"],
    "de": ["der", "die", "und", "das", "den", "im", "mit", "ist", "ein", "eine", "zu", "auf", "nicht", "von", "dem"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "pour", "est", "du", "en", "par"],
    "es": ["el", "la", "los", "de", "que", "en", "un", "una", "las", "por", "con", "su", "del", "y", "se", "al"],
}


@dataclass(frozen=True)
class Rule:
    """A text fails when ``metric`` is outside ``[low, high]``, judged only from ``least_words`` words on."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    least_words: int = 10


RULES = [
    Rule("length", "n_words", low=10, least_words=0),
    Rule("word_length", "mean_word_chars", low=1.5, high=25),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.002, least_words=100),
    Rule("repeated_lines", "dup_line_ratio", high=0.7),
]


def text_columns(text: Column) -> dict[str, Column]:
    """First step of the measures: the trimmed text's words and the lines that hold a word."""
    trimmed = F.trim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0)
    return {
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        "_lines": lines,
    }


def _windows(words: Column, width: int) -> Column:
    def window(word: Column, i: Column) -> Column:
        return F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, width)])

    starts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, window)


def _covered(windows: Column, width: int) -> Column:
    """Words that lie in a window found twice or more: sort (window, place), keep neighbours that are equal, merge."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(sorted_windows: Column) -> Column:
        def mark(x: Column, k: Column) -> Column:
            same = lambda y: F.coalesce(F.get(sorted_windows, y)["w"] == x["w"], F.lit(False))
            return F.when(same(k - 1) | same(k + 1), x["i"]).otherwise(F.lit(-1))

        return F.sort_array(F.filter(F.transform(sorted_windows, mark), lambda i: i >= 0))

    def merged(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda s, p: F.struct(
                (s["n"] + (p + width - F.greatest(p, s["end"])).cast("long")).alias("n"), (p + width).alias("end")
            ),
            lambda s: s["n"],
        )

    # transform over a single-element array binds a value once instead of repeating its expression
    places = F.transform(F.array(placed), repeated)
    return F.get(F.transform(places, merged), 0)


def measure(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Add the counts and ratios the rules speak of. Null and empty texts have no words, lines or symbols."""
    keep = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    split = docs.select(*keep, body.alias("_body")).select("*", *[c.alias(n) for n, c in text_columns(F.col("_body")).items()])
    counted = split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        _windows(F.col("_words"), width).alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        counted.withColumn(
            "n_repeat_words", F.when(repeats, _covered(F.col("_windows"), width)).otherwise(F.lit(0)).cast("long")
        )
        .drop("_windows")
        .withColumns(
            {
                "mean_word_chars": ratio("word_chars", "n_words"),
                "symbol_ratio": ratio("n_symbols", "n_words"),
                "stop_word_ratio": ratio("n_stop_words", "n_words"),
                "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            }
        )
    )


def compile_rules(rules: list[Rule]) -> Column:
    """One array column with the names of the rules a measured text fails."""
    failed = []
    for rule in rules:
        value = F.col(rule.metric)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        failed.append(F.when(bad & (F.col("n_words") >= rule.least_words), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def judge(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Measures of every row, ``base_failed``, the names of the ``failed_rules`` and ``kept``.

    No shuffle: each row is judged by itself, whatever its id; repeated rows get equal verdicts. A null or empty text
    has zero words and fails. Columns of the input come through; one named like a measure is replaced by it.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"}
    made |= {"mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "base_failed", "failed_rules", "kept"}
    clash = [c for c in docs.columns if c.lower() in made or c in {"_body", "_words", "_lines", "_windows"}]
    measured = measure(docs.drop(*clash), text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )

"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words of the whole text, split at white space, without the empty ones."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word != "")


def explode_tokens(df: DataFrame, text: str, *keep: Column | str, name: str = "word") -> DataFrame:
    """One row per word of the whole text; the empty ones go after the explode, inside generated code."""
    pieces = F.explode(F.split(F.lower(text), r"\s+")).alias(name)
    return df.select(*keep, pieces).where(F.col(name) != "")


def count_tokens(df: DataFrame, text: str, key: Column, name: str = "word") -> DataFrame:
    """``doc, word, tf``: how often each row of ``df`` has each word of the whole text, without a shuffle; ``doc`` is its ``key``."""
    rows = df.select(key.alias("doc"), F.split(F.lower(text), r"\s+").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
                found = batch.column(1).flatten().dictionary_encode()
                code, some = found.indices.to_numpy(), max(1, len(found.dictionary))
                cell, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * some + code, return_counts=True)
                word = found.dictionary.take(pa.array(cell % some))
                made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cell // some)), word, pa.array(n, pa.int64())], ["doc", name, "tf"])
                yield made.filter(pc.not_equal(word, ""))

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {name} string, tf long")


def words(text: Column) -> Column:
    """Fields of a line, split at any run of white space."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def strip_line_end(text: Column) -> Column:
    """Without white space of any script at the end."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")


def first_line_with(text: Column, word: str) -> Column:
    """First line that contains ``word``, null if none does."""
    return F.get(F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit(word))), F.lit(0))


def quoted(text: Column) -> Column:
    """A string as a quoted literal: single quotes, or double ones if it only holds single quotes."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def list_fingerprint(items: Column) -> Column:
    """md5 over the joined md5 digests of the quoted elements, as hex."""
    digests = F.transform(items, lambda item: F.md5(quoted(item).cast("binary")))
    return F.md5(F.unhex(F.array_join(digests, "")))

"""License scans: a positional index of rare licence words, aligned by relative position and verified by key phrases.

All of it is DataFrame expressions. Document counts of the templates' words give their IDF; each template is indexed by
its words of highest IDF with their places. In a file, places of those words propose (template, offset); proposals on
which words agree are kept, and the file's words there must hold the template's mandatory phrase.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import HOT_SHARE, look_up, materialise

#: Everything outside digits, ASCII letters and non-ASCII characters parts words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever their words stand together.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Template:
    """Words of a licence notice, its label, and the phrase without which a match does not count."""

    label: str
    text: str
    phrase: str


TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Words per template in the index, by falling IDF. All of them that a file holds are looked up.
INDEXED_WORDS = 4


def split_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


def word_idf(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, float]:
    """IDF of the given words over all documents; one count a word comes to the driver."""
    listed = F.array(*[F.lit(w) for w in words])
    found = docs.select(F.explode(F.concat(F.array_intersect(split_words(F.col(text)), listed), F.array(F.lit("")))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in words}


def build_postings(templates: list[Template], idf: dict[str, float], keep: int = INDEXED_WORDS) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place) for the ``keep`` words of highest IDF of each template; ties by the word."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        words = template.text.split()
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:keep]
        for place, word in enumerate(words):
            if word in rare:
                postings.setdefault(word, []).append((number, place))
    return postings


def _stands(words: Column, phrase: list[str], last: Column) -> Column:
    """Whether the phrase ends at place ``last`` of the words."""
    same = F.lit(True)
    for k, word in enumerate(reversed(phrase)):
        same = same & F.coalesce(F.get(words, last - k) == word, F.lit(False))
    return same


def _phrase_places(phrase: list[str], label: str) -> Column:
    """(i, label) of the places where the phrase begins, from the places of its last word."""
    ends = F.filter("_places", lambda x: (x["w"] == phrase[-1]) & _stands(F.col("_words"), phrase, x["i"]))
    return F.transform(ends, lambda x: F.struct((x["i"] - (len(phrase) - 1)).alias("i"), F.lit(label).alias("label")))


def scan_licenses(
    docs: DataFrame,
    templates: list[Template] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``matches`` are (template, offset, share) of verified alignments, where ``share`` is the part of the template's words
    that stand at their places; ``score`` is the largest share, at least 0.5 with a base label, 0 without a label. A null
    or empty text has no words, null places, empty labels and score 0. Rows are found again by id and a hash of their
    text, so repeated rows get equal results and a null id is no obstacle; only proposals are shuffled, and a file's
    proposals are counted before they meet.
    """
    template_words = [t.text.split() for t in templates]
    vocabulary = sorted({w for words in template_words for w in words})
    idf = word_idf(docs, vocabulary, text)
    postings = build_postings(templates, idf)
    ends = {p.split()[-1] for p, _ in phrases}
    wanted = F.array(*[F.lit(w) for w in sorted(set(postings) | ends)])
    indexed = sorted(postings)

    own = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        split_words(F.col(text)).alias("_words"),
    )
    placed = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(wanted, x["w"]))
    own = own.withColumn("_places", F.when(F.arrays_overlap("_words", wanted), placed).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    base = []
    for phrase, label in phrases:
        base.append(_phrase_places(phrase.split(), label))

    listed = F.map_from_arrays(
        F.array(*[F.lit(w) for w in indexed]),
        F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w]]) for w in indexed]),
    )
    texts = F.array(*[F.array(*[F.lit(w) for w in words]) for words in template_words])

    def proposals(x: Column) -> Column:
        def one(p: Column) -> Column:
            offset = x["i"] - p["p"]
            size = F.size(F.get(texts, p["t"]))
            return F.struct(
                p["t"].alias("template"), offset.alias("offset"), p["p"].alias("anchor"),
                F.slice("_words", F.greatest(offset, F.lit(0)) + 1, size + F.least(offset, F.lit(0))).alias("window"),
            )

        return F.transform(F.coalesce(F.element_at(listed, x["w"]), F.array().cast("array<struct<t:int,p:int>>")), one)

    kind = "array<struct<template:int,offset:int,anchor:int,window:array<string>>>"
    proposed = F.flatten(F.transform("_places", proposals)).cast(kind)
    own = own.withColumn("_base", F.concat(*base)).select(
        "doc_id",
        "_hash",
        F.size("_words").cast("long").alias("n_words"),
        F.transform("_base", lambda b: b["i"]).alias("_at"),
        F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"]))).alias("_labels"),
        F.when(F.size("_places") > 0, proposed).otherwise(F.array().cast(kind)).alias("_proposed"),
    )
    own = materialise(own, "license-places")

    named = F.array(*[F.lit(t.label) for t in templates])
    pairs = own.select("doc_id", "_hash", F.explode("_proposed").alias("x")).select("doc_id", "_hash", "x.*")
    agreed = pairs.groupBy("doc_id", "_hash", "template", "offset", "window").agg(F.count_distinct("anchor").alias("anchors"))
    spread = [len({w for w in postings if any(t == number for t, _ in postings[w])}) for number in range(len(templates))]
    of_template = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    # a notice cut by the begin of the file has its window shifted to the left
    moved = F.greatest(-F.col("offset"), F.lit(0))
    words = F.get(texts, F.col("template"))
    same = F.size(F.filter(F.transform(words, lambda w, k: F.get("window", k - moved) == w), lambda hit: hit))
    phrase = F.contains(F.concat(F.lit(" "), F.concat_ws(" ", "window"), F.lit(" ")), of_template([f" {t.phrase} " for t in templates]))
    fits = phrase & (F.col("anchors") >= of_template([min(2, n) for n in spread]))
    share = F.when(fits, same / F.size(words)).otherwise(F.lit(0.0))
    matched = agreed.withColumn("share", share).where("share > 0").withColumn("label", F.get(named, F.col("template")))
    found = matched.groupBy("doc_id", "_hash").agg(
        F.max("share").alias("_share"),
        F.collect_set("label").alias("_found"),
        F.array_sort(F.collect_list(F.struct("template", "offset", F.col("share").alias("share")))).alias("matches"),
    )
    sizes = own.where(F.size("_proposed") > 0).groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    found = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("_hash", "_key")
    found = found.join(sizes, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("_hash")))
    found = found.select(F.xxhash64("_id", "_key").alias("_row"), "_share", "_found", "matches", "_rows")
    bar = max(1, own.count() // HOT_SHARE)
    joined = look_up(own.withColumn("_row", F.xxhash64("doc_id", "_hash")), found, ["_row"], "_rows", bar)

    labels = F.array_sort(F.array_union("_labels", F.coalesce("_found", F.array().cast("array<string>"))))
    based = F.size("_labels") > 0
    return joined.select(
        "doc_id",
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(based, 0.5).otherwise(0.0), F.coalesce("_share", F.lit(0.0))).alias("score"),
        "matches",
    )

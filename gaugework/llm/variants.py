"""Spelling variants of the words of a corpus, by an index of variable-length grams.

Words that differ by one inserted, deleted or replaced code point are found through the grams they keep:

- a dictionary holds grams of two or three letters. A gram is lengthened only where its words are more than a share of all places,
  so the dictionary is bounded and frequent grams give way to longer, rarer ones;
- a word is decomposed into the longest dictionary gram at each place, without those inside an earlier one;
- for each place of the word the grams that an edit there can affect are counted: those that cover the place, those before it that the
  dictionary could lengthen up to it, and those that such a longer gram could swallow. The largest count is the word's bound b.

A word of g grams keeps g - b of them, at the same place or moved by the edit, so two near words share as many as the stricter
of both needs. List merging passes over the longest lists: of a list order by length, the first b + 1 grams of each word suffice.
Lists are keyed by gram, place and word length; a word one letter
longer probes the lists that it reaches by losing a letter before or behind the gram. Lists of up to ``LIST_WORDS`` entries
compare their members; a longer one is cut up by what its words look like without one letter outside the gram, which at
most an alphabet of words for each place share. Words that may lose all their grams (g <= b, on both sides) meet in one such list
without a gram. Every pair that meets is verified code point by code point.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import materialise
from gaugework.session import shuffle_partitions

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TO_SMALL = {code: code + 32 for code in range(65, 91)}
SHORTEST, LONGEST = 2, 3
#: A gram is lengthened where it has more than this many places, or their share below: fewer than so many grams can pass.
LEAST_FREQUENT = 256
MOST_FREQUENT = 20_000
#: Members of a list that are compared with each other.
LIST_WORDS = 64
#: Distinct words counted before they are handed on, and characters of a text that are searched at a time.
HELD_WORDS = 300_000
PIECE = 1 << 20


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that cut no run of letters."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and RUN.match(text[end]):
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def damaged(key: str, run: str, every: int) -> str:
    """The run without the letter that its checksum names, if that is divisible by ``every``."""
    drawn = zlib.crc32(f"{key}:{run}".encode())
    if drawn % every:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, every: int, least_length: int, least_count: int) -> DataFrame:
    """``word, n`` of the words long and frequent enough; counted by document, by task, then by word."""
    long_runs = re.compile(RUN.pattern.removesuffix("+") + f"{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own: Counter[str] = Counter()
                for piece in pieces(text.as_py() or ""):
                    own.update(long_runs.findall(piece.translate(TO_SMALL)))
                prefix = key.as_py() or ""
                for word, n in own.items():
                    word = damaged(prefix, word, every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    counted = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> set[str]:
    """Grams longer than the shortest whose head is frequent; shorter ones need no entry.

    Fewer than ``MOST_FREQUENT`` heads of each length pass, so the dictionary is at most as many times the alphabet.
    """
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    bar = max(LEAST_FREQUENT, places // MOST_FREQUENT + 1)
    grams = words.select("word", F.explode(F.sequence(F.lit(SHORTEST), F.lit(LONGEST))).alias("q")).where("length(word) >= q")
    grams = grams.select(F.expr("explode(transform(sequence(1, length(word) - q + 1), i -> substring(word, i, q)))").alias("gram"))
    counted = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "variant-grams")
    head = counted.where(F.col("n") > bar).select(F.col("gram").alias("_head"))
    longer = counted.where(F.length("gram") > SHORTEST).withColumn("_head", F.expr("substring(gram, 1, length(gram) - 1)"))
    return set(longer.join(head, "_head", "left_semi").select("gram").toArrow().column(0).to_pylist())


class Decomposer:
    """Decomposes words by a dictionary and bounds the grams that one edit can affect."""

    def __init__(self, grams: set[str]):
        self.grams = grams
        self.deepest: dict[str, int] = {}  # prefix of a dictionary gram -> length of the longest gram below it
        for gram in grams:
            for k in range(1, len(gram)):
                head = gram[:k]
                self.deepest[head] = max(self.deepest.get(head, 0), len(gram))

    def longest(self, word: str, at: int) -> int:
        for q in range(min(LONGEST, len(word) - at), SHORTEST, -1):
            if word[at : at + q] in self.grams:
                return q
        return SHORTEST

    def decompose(self, word: str) -> tuple[list[tuple[int, int]], list[int]]:
        """Place and length of the grams that stand, and the length at every place."""
        lengths = [self.longest(word, at) for at in range(len(word) - SHORTEST + 1)]
        kept, reach = [], 0
        for at, q in enumerate(lengths):
            if at + q > reach:
                kept.append((at, q))
                reach = at + q
        return kept, lengths

    def bound(self, word: str, kept: list[tuple[int, int]], lengths: list[int]) -> int:
        """The most grams of ``kept`` that one edit can affect."""
        worst = 0
        for edit in range(len(word) + 1):
            changed, reach = set(), 0
            for at in range(max(0, edit - LONGEST + 1), min(edit + 1, len(lengths))):
                stands_over = edit < at + lengths[at]
                deepest = max(self.deepest.get(word[at:edit], 0), SHORTEST) if at < edit else LONGEST
                if stands_over or deepest > max(lengths[at], edit - at):
                    changed.add(at)
                    reach = max(reach, at + deepest + 1)  # one more for an inserted letter
            # a gram behind a changed one may be swallowed by it
            first = min(changed, default=len(word))
            worst = max(worst, sum(at in changed or (at > first and at + q <= reach) for at, q in kept))
        return worst


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def decomposed(words: DataFrame, grams: set[str]) -> DataFrame:
    """``word, n, grams (gram, at), weak, needed``: the grams of a word, whether it may lose all of them, and b + 1."""
    shared = words.sparkSession.sparkContext.broadcast(grams)
    schema = "word string, n long, grams array<struct<gram: string, at: int>>, weak boolean, needed int"
    entry = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Decomposer(shared.value)
        for batch in batches:
            lists, weak, needed = [], [], []
            for word in batch.column(0).to_pylist():
                kept, lengths = by.decompose(word)
                b = by.bound(word, kept, lengths)
                lists.append([{"gram": word[at : at + q], "at": at} for at, q in kept])
                weak.append(len(kept) <= b)
                needed.append(b + 1)
            made = [pa.array(lists, entry), pa.array(weak), pa.array(needed, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["word", "n", "grams", "weak", "needed"])

    return words.mapInArrow(run, schema)


def shortest_lists(entries: DataFrame) -> DataFrame:
    """``gram, at, word, n``: of each word the ``needed`` grams that the fewest words have."""
    one = entries.select("word", "n", "needed", F.inline("grams"))
    sizes = one.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    ranked = one.join(sizes, "gram").groupBy("word", "n", "needed").agg(F.sort_array(F.collect_list(F.struct("size", "gram", "at"))).alias("l"))
    # equal grams at two places are one element of the order, so all places of a gram that is needed enter
    ranked = ranked.withColumn("_bar", F.expr("l[least(needed, size(l)) - 1]"))
    within = F.expr("filter(l, e -> e.size < _bar.size or (e.size = _bar.size and e.gram <= _bar.gram))")
    return ranked.withColumn("l", within).select("word", "n", F.inline("l")).drop("size")


def met_lists(chosen: DataFrame, weak: DataFrame) -> DataFrame:
    """``key, role, word, n`` of all lists. Role 0 are words of the list's length; 1 and 2 are words a letter longer, which
    lose it behind and before the gram."""
    placed = chosen.select("word", "n", "gram", "at", F.length("gram").alias("q"), F.length("word").alias("len"))
    roles = F.expr(
        "array(named_struct('role', 0, 'place', at, 'size', len), named_struct('role', 1, 'place', at, 'size', len - 1), "
        "named_struct('role', 2, 'place', at - 1, 'size', len - 1))"
    )
    listed = placed.select("*", F.inline(roles)).where("place >= 0 and (role <> 1 or at + q < len)")
    listed = listed.withColumn("list", F.xxhash64("gram", "place", "size"))
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    sized = listed.join(sizes, "list")
    short = sized.where(F.col("_c") <= LIST_WORDS).select(F.col("list").alias("key"), "role", "word", "n")
    columns = ["list", "role", "at", "q", "len", "word", "n"]
    bare = weak.select(
        F.lit(0).cast("long").alias("list"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.lit(0).alias("at"),
        F.lit(0).alias("q"), F.length("word").alias("len"), "word", "n",
    )
    cut = sized.where(F.col("_c") > LIST_WORDS).select(*columns).unionByName(bare)
    places = "filter(sequence(0, len - 1), k -> if(role = 0, k < at or k >= at + q, if(role = 1, k >= at + q, k < at)))"
    less = f"transform({places}, k -> named_struct('k', if(role = 0, k, -1), 'less', concat(substring(word, 1, k), substring(word, k + 2))))"
    forms = f"if(role = 0, concat(array(named_struct('k', -1, 'less', word)), {less}), {less})"
    cut = cut.select("list", "role", "word", "n", F.inline(F.array_distinct(F.expr(forms))))
    return short.unionByName(cut.select(F.xxhash64("list", "k", "less").alias("key"), "role", "word", "n"))


def near_pairs(lists: DataFrame) -> DataFrame:
    """``a, n, b, m``: both directions of every pair of near words that share a list."""
    names = ["a", "n", "b", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            same = keys[1:] == keys[:-1]  # rows alone in their list are passed over; the batch's ends may go on
            shared = np.append(True, same) | np.append(same, True)
            found = []
            for k, role, word, n in zip(*(c.to_pylist() for c in batch.filter(pa.array(shared)).columns)):
                if k != key:
                    key, members = k, []
                for old, m in members:
                    if near(old, word):
                        found += [(old, m, word, n), (word, n, old, m)]
                if role == 0:
                    members.append((word, n))
            columns = zip(*found) if found else ((), (), (), ())
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    dealt = lists.repartition(shuffle_partitions(lists.sparkSession), "key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(run, "a string, n long, b string, m long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form that a word leads to, for words with a form. Counts grow along the way, so it ends.

    Each round looks up the form of the form so far, doubling the way that is done.
    """
    current = materialise(forms.select("word", F.col("form").alias("root")), "variant-forms")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(current.join(onward, "root", "left"), "variant-roots")
        current = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.where("_next is not null").isEmpty():
            return current


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    damage_every: int = 199,
) -> DataFrame:
    """Per word ``word, form, root, n, n_near, form_n``.

    Words are runs of letters, A-Z in lower case. Null and empty texts have none; a null id is an empty string in the checksum that damages
    runs. A run of one letter that is damaged vanishes. Rows that repeat count each time. Of near words equally frequent, the
    smallest in code-point order is the form. Without words there is no row. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_column).cast("string").alias("_id"), F.col(text).cast("string").alias("_text"))
    words = materialise(count_words(rows, damage_every, least_length, least_count), "variant-words")
    entries = materialise(decomposed(words, gram_dictionary(words)), "variant-grams-of")
    chosen = materialise(shortest_lists(entries), "variant-lists")
    lists = met_lists(chosen, entries.where("weak").select("word", "n"))
    pairs = near_pairs(lists)
    best = F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("best")
    found = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = materialise(found, "variant-best")
    judged = words.join(found.withColumnRenamed("a", "word"), "word", "left")
    led = -F.col("best.less") >= ratio * F.col("n")
    judged = judged.select(
        "word", F.when(led, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, -F.col("best.less")).alias("form_n"),
    )
    judged = materialise(judged, "variant-judged")
    led_to = roots(judged.where("form is not null"))
    return judged.join(led_to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


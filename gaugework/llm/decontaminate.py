"""Passages of benchmark items in documents, by a prefix-filtered set join.

A window is ten consecutive words of an item, or all words of a shorter one, seen as the set of its shingles of three words. A
document contains a window only if it contains every shingle, so one shingle of the window, the first in the order of
rarity, is all the prefix that the join needs:

- one scan counts in all documents the shingles that windows have; a window's rarest one is its key;
- a second scan meets the keys. The place of the shingle inside its window fixes where the window would begin (positional
  bound), and it must end before the document does (length bound);
- there all words of the window are compared, and those inside a window that occurs are hit.

Documents never move: a task holds the keys of all windows, and both scans are one pass over a text's bytes. Windows are dealt
into blocks of at most ``BLOCK_WINDOWS``, so what is broadcast is bounded; each block makes its two scans, and with more than one the
rows are written between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.bytewords import mix, text_bytes, word_hashes
from gaugework.llm.common import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
SHINGLE = 3
#: Windows whose keys, words and items are broadcast at a time: some 40 MB.
BLOCK_WINDOWS = 200_000
#: Documents whose words are held at a time, and the bytes after which fewer are.
BATCH_DOCS = 256
BATCH_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_SEEN_BITS = 20
_SEEN_MASK = np.uint64((1 << _SEEN_BITS) - 1)


class Words:
    """Words of a batch of texts: bytes, bounds, the first word of each text (plus the end) and 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        raw, text_start = text_bytes(texts)
        self.lowered = _LOWER[raw]
        inside = _IN_WORD[self.lowered]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(raw) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.first, self.last = edge[0::2], edge[1::2]  # every text is followed by a space, so each word ends
        self.start = np.searchsorted(self.first, text_start)
        self.hashed = word_hashes(self.lowered, self.first, self.last)

    def shingles(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on, whatever text they are of."""
        n = max(len(self.hashed) - width + 1, 0)
        rolled = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + self.hashed[k : k + n]
        return mix(rolled)

    def joined(self, begin: int, count: int) -> bytes:
        return b" ".join(self.lowered[a:b].tobytes() for a, b in zip(self.first[begin : begin + count], self.last[begin : begin + count]))


def cut(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts that are held together: a long text is alone, but whole."""
    begin = held = 0
    for at, size in enumerate(pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_pylist()):
        if at > begin and (held + size > BATCH_BYTES or at - begin >= BATCH_DOCS):
            yield begin, at
            begin, held = at, 0
        held += size
    if len(texts) > begin:
        yield begin, len(texts)


def windows(items: DataFrame, text: str = "text", id_column: str = "item_id", width: int = WINDOW) -> DataFrame:
    """``words, items``: the distinct windows of all items (words in lower case, one space between) and the ids that have them."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), LETTERS, SMALL), F.lit(WORD), F.lit(0))
    cut_up = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words.alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {width} + 1, 1))")
    cut_up = cut_up.withColumn("i", F.explode(starts)).select("item", F.expr(f"array_join(slice(w, i, {width}), ' ')").alias("words"))
    return cut_up.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _find(values: np.ndarray, seen: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are keys, and which key; a table of low bits passes over most others."""
    at = np.flatnonzero(seen[values & _SEEN_MASK])
    if not len(at):
        return at, at
    key = np.minimum(np.searchsorted(sorted_keys, values[at]), len(sorted_keys) - 1)
    same = sorted_keys[key] == values[at]
    return at[same], key[same]


def _seen(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _SEEN_BITS, dtype=bool)
    table[keys & _SEEN_MASK] = True
    return table


class Block:
    """The windows of one block as arrays: words of each, and its shingles by width."""

    def __init__(self, words: list[str], items: list[list[str]]):
        self.words, self.items = [w.encode() for w in words], items
        self.shingles: list[np.ndarray] = []
        self.length = self.width = np.zeros(0, np.int64)
        if not words:
            return
        cut_up = Words(pa.array(words, pa.string()))
        self.length = np.diff(cut_up.start)
        by_width = {w: cut_up.shingles(w) for w in range(1, SHINGLE + 1)}
        for begin, n in zip(cut_up.start[:-1].tolist(), self.length.tolist()):
            width = min(SHINGLE, n)
            self.shingles.append(by_width[width][begin : begin + n - width + 1])
        self.width = np.minimum(self.length, SHINGLE)

    def widths(self) -> list[int]:
        return sorted(set(self.width.tolist()))

    def of_width(self, width: int) -> np.ndarray:
        return np.unique(np.concatenate([s for s, w in zip(self.shingles, self.width) if w == width]))

    def keys(self, counts: dict[int, int]) -> dict[int, tuple]:
        """For each width the sorted keys with, for each key, the windows that have it and the place of the key in them."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {w: {} for w in self.widths()}
        for k, shingles in enumerate(self.shingles):
            place = min(range(len(shingles)), key=lambda i: (counts.get(int(shingles[i]), 0), int(shingles[i])))
            chosen[int(self.width[k])].setdefault(int(shingles[place]), []).append((k, place))
        made = {}
        for width, found in chosen.items():
            keys = np.array(sorted(found), dtype=np.uint64)
            made[width] = (keys, _seen(keys), [found[int(key)] for key in keys])
        return made


def shingle_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each shingle of the block's windows occurs in all texts."""
    tables = {w: block.of_width(w) for w in block.widths()}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {w: np.zeros(len(t), np.int64) for w, t in shared.value.items()}
        seen = {w: _seen(t) for w, t in shared.value.items()}
        for batch in batches:
            for a, b in cut(batch.column(0)):
                words = Words(batch.column(0).slice(a, b - a))
                for w, t in shared.value.items():
                    totals[w] += np.bincount(_find(words.shingles(w), seen[w], t)[1], minlength=len(t))
        for w, t in shared.value.items():
            met = totals[w] > 0
            yield pa.RecordBatch.from_arrays([pa.array(t[met].view(np.int64)), pa.array(totals[w][met])], ["shingle", "n"])

    counted = docs.select("_text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    shingles = counted.column("shingle").to_numpy().view(np.uint64)
    return dict(zip(shingles.tolist(), counted.column("n").to_pylist()))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as the fewest that cover the same places."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def search(docs: DataFrame, block: Block) -> DataFrame:
    """The rows with ``_n`` (words), ``_spans`` (begin and end of the hit words) and ``_items``, those of earlier blocks included."""
    shared = docs.sparkSession.sparkContext.broadcast((block.words, block.items, block.length.tolist(), block.keys(shingle_counts(docs, block))))
    columns = docs.columns
    at_text, at_spans, at_items = (columns.index(c) for c in ("_text", "_spans", "_items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window_words, window_items, length, keys = shared.value

        def hits(words: Words) -> dict[int, tuple[list, set]]:
            found: dict[int, tuple[list, set]] = {}
            for width, (sorted_keys, seen, users) in keys.items():
                at, key = _find(words.shingles(width), seen, sorted_keys)
                doc = np.searchsorted(words.start, at, side="right") - 1
                for p, k, d in zip(at.tolist(), key.tolist(), doc.tolist()):
                    for window, place in users[k]:
                        begin = p - place
                        if begin < words.start[d] or begin + length[window] > words.start[d + 1]:
                            continue
                        if words.joined(begin, length[window]) == window_words[window]:
                            spans, items = found.setdefault(d, ([], set()))
                            spans.append((begin - int(words.start[d]), begin - int(words.start[d]) + length[window]))
                            items.update(window_items[window])
            return found

        for batch in batches:
            counts, spans, items = [], batch.column(at_spans).to_pylist(), batch.column(at_items).to_pylist()
            for a, b in cut(batch.column(at_text)):
                words = Words(batch.column(at_text).slice(a, b - a))
                counts.append(np.diff(words.start))
                for d, (more, names) in hits(words).items():
                    earlier = list(zip(spans[a + d][0::2], spans[a + d][1::2]))
                    spans[a + d] = [x for span in _union(earlier + more) for x in span]
                    items[a + d] = sorted(names.union(items[a + d]))
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at_spans], arrays[at_items] = pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total.astype(np.int64))], [*columns, "_n"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("_n")).schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, items, contaminated``: words inside windows of benchmark items, and the items found, sorted.

    A null or empty text has no words and is not contaminated; an item without words has no window, and items without an id
    count as one, named by an empty string. Items that share an id are one item, equal windows of several items count for each. Repeated rows are
    judged each for itself, an empty benchmark hits nothing. Other columns are not looked at.
    """
    empty = [F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items")]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("_text"), *empty)
    cut_up = materialise(windows(items), "decontaminate-windows")
    blocks = max(1, -(-cut_up.count() // block_windows))
    dealt = cut_up.withColumn("_block", F.expr(f"pmod(xxhash64(words), {blocks})"))
    for k in range(blocks):
        part = dealt.where(F.col("_block") == k).select("words", "items").orderBy("words").toArrow()
        block = Block(part.column("words").to_pylist(), part.column("items").to_pylist())
        if k:
            rows = materialise(rows.drop("_n"), "decontaminate-rows")
        rows = search(rows, block)
    hit = F.expr("aggregate(sequence(1, size(_spans) div 2), 0L, (s, k) -> s + _spans[2 * k - 1] - _spans[2 * k - 2])")
    hit = F.when(F.size("_spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    found = rows.select("doc_id", F.col("_n").alias("n_words"), hit.alias("n_hit"), F.col("_items").alias("items"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


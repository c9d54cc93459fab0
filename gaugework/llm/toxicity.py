"""Toxicity: a noisy channel restores obscured words, then a small model scores the restored text.

Words with digits or signs in place of letters, with letters set apart, or with letters repeated are lattices: each
observed byte is a letter, stands for others, is a gap or is nothing. A Viterbi search under a byte trigram model of all
documents picks the reading. All other words have a single reading, so nothing is searched for them. Evidence of a
word, and of its first letters, is learned from labelled documents; a logistic model joins the strongest evidence
of a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.bytewords import mix, text_bytes, word_hashes

CLASSES = 64
EVIDENCE_BITS = 22
#: Labelled documents that the model is fitted on: at most so many of each label, by the order of a hash.
SAMPLE_ROWS = 12_000
LEAST_DOCS = 4
TOP = 4
#: Lengths in bytes of the heads of words that carry evidence of their own; stems of insults take many endings.
PREFIXES = (4, 5, 6, 8)
THRESHOLD = 0.3
CACHED_CHUNKS = 100_000
STEP = 512

#: Signs and digits that stand for letters.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
GAPS = "._-*~ "
#: Natural logarithms of the channel: letter for sign, sign dropped, sign as a break; gap closed, gap kept.
SIGN, DROP, BREAK, CLOSE, KEEP = -0.7, -4.0, -2.0, -1.0, -0.5
#: A letter that repeats the one before: said again, or dropped; in runs of three or more.
TWICE, ONCE, RUN_SAID, RUN_DROPPED = -0.3, -1.5, -3.0, -0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.isin(np.arange(256), [ord(c) for c in STANDS_FOR])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_GAP = np.isin(np.arange(256), [ord(c) for c in GAPS if c != " "])
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 31)


def _bounds(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of byte-class trigrams over all texts, a table of fixed size; every other byte is the break between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                raw, _ = text_bytes(batch.column(0).slice(at, STEP))
                c = _CLASS[_LOWER[raw]]
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] if len(c) else c
                c = np.concatenate([[0, 0], c, [0]])
                table += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(table[seen])], ["gram", "n"])

    counted = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES**3)
    table[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return table.reshape(CLASSES, CLASSES, CLASSES)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class after two others, interpolated with shorter contexts."""
    pair, single = counts.sum(axis=0), counts.sum(axis=(0, 1))
    one = (single + 0.5) / (single.sum() + 0.5 * CLASSES)
    two = (pair + 2 * one) / (pair.sum(axis=1, keepdims=True) + 2)
    three = (counts + 4 * two[None]) / (counts.sum(axis=2, keepdims=True) + 4)
    return np.log(three)


class Restorer:
    """Viterbi search over the readings of a chunk; the state is the last two letters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.cache: dict[bytes, bytes] = {}

    def options(self, chunk: bytes, k: int) -> list[tuple[int, float]]:
        """(byte, log weight) of position k; byte 0 is nothing."""
        c = chunk[k]
        if _LETTER[c]:
            if k and chunk[k - 1] == c and c < 128:
                run = (k > 1 and chunk[k - 2] == c) or (k + 1 < len(chunk) and chunk[k + 1] == c)
                return [(c, RUN_SAID), (0, RUN_DROPPED)] if run else [(c, TWICE), (0, ONCE)]
            return [(c, 0.0)]
        sign = chr(c)
        if sign in STANDS_FOR:
            return [*((ord(x), SIGN) for x in STANDS_FOR[sign]), (0, DROP), (32, BREAK)]
        if sign in GAPS:
            return [(0, CLOSE), (32, KEEP)]
        return [(32, 0.0)]

    def restore(self, chunk: bytes) -> bytes:
        found = self.cache.get(chunk)
        if found is None:
            found = self.search(chunk)
            if len(self.cache) >= CACHED_CHUNKS:
                self.cache.clear()
            if len(chunk) <= 64:
                self.cache[chunk] = found
        return found

    def search(self, chunk: bytes) -> bytes:
        model, classes = self.model, _CLASS
        states = {(0, 0): (0.0, None)}
        for k in range(len(chunk)):
            made: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = [(b, w, int(classes[b])) for b, w in self.options(chunk, k)]
            for (p, q), (score, path) in states.items():
                row = model[p][q]
                for byte, weight, c in options:
                    if not byte:
                        state, value, way = (p, q), score + weight, path
                    elif byte == 32 and q == 0:
                        state, value, way = (p, q), score + weight, path
                    else:
                        state, value, way = (q, c), score + weight + row[c], (path, byte)
                    if state not in made or made[state][0] < value:
                        made[state] = (value, way)
            states = made
        best, path = max(((s + model[p][q][0] * (q != 0), w) for (p, q), (s, w) in states.items()), key=lambda x: x[0])
        out = bytearray()
        while path is not None:
            path, byte = path
            out.append(byte)
        return bytes(reversed(out))


def _obscured(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks have more than one reading worth a search, and which of them are no words as they stand.

    The others (numbers, words of signs alone or nearly so, words that a sign closes, which may be punctuation) count by
    their plain letters as well as by their reading.
    """
    n = len(low)
    letter, sign, digit, gap = _LETTER[low], _SIGN[low], _DIGIT[low], _GAP[low]
    event = np.zeros(n, bool)
    event[:-1] |= sign[:-1] & letter[1:]
    event[1:] |= digit[1:] & letter[:-1]
    same = letter[2:] & (low[2:] < 128) & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    event[2:] |= same
    if n > 4:
        event[4:] |= letter[:-4] & gap[1:-3] & letter[2:-2] & gap[3:-1] & letter[4:]
    either = letter | sign
    apart = np.zeros(n, bool)
    apart[:-1] |= sign[:-1] & either[1:]
    apart[1:] |= sign[1:] & either[:-1]
    if n > 4:
        apart[4:] |= either[:-4] & gap[1:-3] & either[2:-2] & gap[3:-1] & either[4:]

    def held(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[end] - total[begin]

    masked = (held(event) > 0) & (held(letter) >= 2)
    return masked | ((held(event | apart) > 0) & (held(either) >= 2)), masked


def _chains(member: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of three or more chunks that are members and joined to the one before."""
    linked = np.zeros(len(member), bool)
    linked[1:] = member[1:] & member[:-1] & joined
    return [(a, b) for a, b in zip((x - 1 for x in _bounds(linked)[0].tolist()), _bounds(linked)[1].tolist()) if b - a >= 3]


class Evidence:
    """Hashed features of the restored texts of a batch: the distinct words of each, whole and by their heads."""

    def __init__(self, model: np.ndarray):
        self.restorer = Restorer(model)

    def restored(self, low: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Begin, end and text of the plain words, and (text, reading) of the obscured chunks."""
        begin, end = _bounds(~_SPACE[low])
        odd, hidden = _obscured(low, begin, end) if len(begin) else np.zeros((2, 0), bool)
        single = end - begin == 1
        letter = single & _LETTER[low[begin]] & (low[begin] < 128)
        text_of = np.searchsorted(text_start, begin, side="right") - 1
        same_text = text_of[1:] == text_of[:-1]
        pieces: list[tuple[int, bytes]] = []
        plain = _chains(letter, same_text & (begin[1:] == end[:-1] + 1))
        for a, b in plain:
            hidden[a:b] = True
        # stand-ins and runs of white space too; a chain of letters inside a longer one is read by itself as well
        for a, b in sorted({*plain, *_chains(letter | (single & _SIGN[low[begin]]), same_text)}):
            pieces.append((int(text_of[a]), self.restorer.restore(" ".join(low[begin[a:b]].tobytes().decode()).encode())))
        for k in np.flatnonzero(odd):
            pieces.append((int(text_of[k]), self.restorer.restore(low[begin[k] : end[k]].tobytes())))
        masked = _LETTER[low]
        for k in np.flatnonzero(hidden):
            masked[begin[k] : end[k]] = False
        first, last = _bounds(masked)
        return first, last, np.searchsorted(text_start, first, side="right") - 1, pieces

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The text of every distinct word of each text, and the buckets of the word and of its heads (-1: too short)."""
        raw, start = text_bytes(column)
        low = _LOWER[raw]
        first, last, text, pieces = self.restored(low, start)
        texts, buckets = [text], [self.buckets(low, first, last)]
        if pieces:
            more = np.frombuffer(b"".join(p + b" " for _, p in pieces), dtype=np.uint8)
            of = np.repeat([t for t, _ in pieces], [len(p) + 1 for _, p in pieces])
            a, b = _bounds(_LETTER[more])
            texts.append(of[a])
            buckets.append(self.buckets(more, a, b))
        text, found = np.concatenate(texts), np.concatenate(buckets)
        _, distinct = np.unique(text.astype(np.int64) << EVIDENCE_BITS | found[:, 0], return_index=True)
        return text[distinct], found[distinct]

    @staticmethod
    def buckets(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.full((len(first), 1 + len(PREFIXES)), -1, dtype=np.int64)
        for column, length in enumerate((0, *PREFIXES)):
            pick = last - first > length
            end = first[pick] + length if length else last[pick]
            h = mix(word_hashes(low, first[pick], end) + np.uint64(length))
            out[pick, column] = (h >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64)
        return out


def held_out(id_column: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` ids of each label that may teach, by the order of a hash, with the ``weight`` that makes up for the others."""
    able = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    able = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in able.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        part = able.where(F.col("toxic") == label).orderBy(*order).limit(rows)
        part = part.withColumn("weight", F.lit(max(1.0, sizes.get(label, 0) / rows)))
        picked = part if picked is None else picked.union(part)
    return picked


def _top(evidence: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """The TOP largest values of each text and the logarithm of 1 + how many are strong."""
    out = np.zeros((count, TOP + 1))
    if len(text):
        order = np.lexsort((-evidence, text))
        t, e = text[order], evidence[order]
        begin = np.searchsorted(t, np.arange(count))
        rank = np.arange(len(t)) - begin[t]
        for k in range(TOP):
            at = rank == k
            out[t[at], k] = e[at]
        out[:, TOP] = np.log1p(np.bincount(t[e > 3], minlength=count))
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    odds = np.log((toxic + 0.5) / (all_toxic + 1) * (all_clean + 1) / (np.maximum(clean, 0) + 0.5))
    return np.where(toxic >= LEAST_DOCS, np.maximum(odds, 0), 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps with a quadratic penalty; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs: the language model, evidence of the feature buckets that have any, and the coefficients."""

    def __init__(self, trigrams: np.ndarray, buckets: np.ndarray, evidence: np.ndarray, weights: np.ndarray):
        self.trigrams, self.buckets, self.evidence, self.weights = trigrams, buckets, evidence, weights

    def table(self) -> np.ndarray:
        out = np.zeros((1 << EVIDENCE_BITS) + 1, dtype=np.float32)
        out[self.buckets] = self.evidence
        return out

    def score(self, features: Evidence, table: np.ndarray, column: pa.Array) -> np.ndarray:
        text, found = features.features(column)
        x = _top(table[found].max(axis=1), text, len(column))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of labelled documents; the language model is of all documents.

    Labels, languages, sources and ids are no inputs. The driver gets tables of fixed size (trigrams, buckets) and one
    row per sampled document. Evidence of a sampled document is taken without the document itself. With no labels
    of one kind every score is the share of the other.
    """
    trigrams = language_model(count_trigrams(docs, text))
    picked = F.broadcast(sample_labels(labels, rows))
    sample = docs.select("doc_id", F.col(text).alias("text")).join(picked, "doc_id").select("text", "toxic", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, space = Evidence(trigrams), 1 << EVIDENCE_BITS
        tables = np.zeros((2, space), dtype=np.int32)
        docs_seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, STEP):
                text_of, found = features.features(batch.column(0).slice(at, STEP))
                label = toxic[at : at + STEP]
                docs_seen += np.bincount(label, minlength=2)
                once = np.unique((text_of[:, None].astype(np.int64) << EVIDENCE_BITS | found)[found >= 0])
                of, bucket = once >> EVIDENCE_BITS, once & (space - 1)
                for k in (0, 1):
                    tables[k] += np.bincount(bucket[label[of] == k], minlength=space).astype(np.int32)
        seen = np.flatnonzero(tables.any(axis=0))
        made = [np.append(seen, -1), np.append(tables[1][seen], docs_seen[1]), np.append(tables[0][seen], docs_seen[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["bucket", "t", "c"])

    counted = sample.select("text", "toxic").mapInArrow(count, "bucket long, t long, c long")
    counted = counted.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"bucket = -1 or t >= {LEAST_DOCS}").toArrow()
    bucket, t, c = (counted.column(k).to_numpy() for k in range(3))
    totals = bucket == -1
    all_toxic, all_clean = float(t[totals].sum()), float(c[totals].sum())
    order = np.argsort(bucket[~totals])
    bucket, t, c = (x[~totals][order] for x in (bucket, t, c))
    if not all_toxic or not all_clean:
        share = (all_toxic + 0.01) / (all_toxic + all_clean + 1)
        return Model(trigrams, bucket[:0], np.zeros(0), np.append(np.zeros(TOP + 1), math.log(share / (1 - share))))
    usable = log_odds(t, c, all_toxic, all_clean) > 0
    bucket, t, c = bucket[usable], t[usable], c[usable]
    shared = docs.sparkSession.sparkContext.broadcast((bucket, t, c))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, t, c = shared.value
        toxic_docs, clean_docs = np.zeros((2, (1 << EVIDENCE_BITS) + 1))
        toxic_docs[known], clean_docs[known] = t, c
        features = Evidence(trigrams)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for begin in range(0, batch.num_rows, STEP):
                texts = batch.column(0).slice(begin, STEP)
                label = toxic[begin : begin + STEP]
                text_of, found = features.features(texts)
                own = label[text_of][:, None]
                left = log_odds(toxic_docs[found] - own, clean_docs[found] - (1 - own), all_toxic, all_clean)
                x = _top(left.max(axis=1), text_of, len(texts))
                rows = [pa.array(list(x), pa.list_(pa.float64())), pa.array(label, pa.int32()), batch.column(2).slice(begin, STEP)]
                yield pa.RecordBatch.from_arrays(rows, ["x", "toxic", "weight"])

    told = sample.mapInArrow(describe, "x array<double>, toxic int, weight double").toArrow()
    x = np.array(told.column(0).to_pylist(), dtype=float).reshape(-1, TOP + 1)
    weights = fit_logistic(x, told.column(1).to_numpy().astype(float), told.column(2).to_numpy())
    return Model(trigrams, bucket, log_odds(t, c, all_toxic, all_clean), weights)


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``score`` between 0 and 1.

    Each row by itself, by its whole text, without a shuffle. A null or empty text has the score of a text without
    evidence. A column named score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        features, table = Evidence(known.trigrams), known.table()
        for batch in batches:
            column = batch.column(len(keep))
            parts = [known.score(features, table, column.slice(at, STEP)) for at in range(0, batch.num_rows, STEP)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "score"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def restore_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, chunk, reading``: what the channel made of the obscured chunks of each text, for inspection."""
    shared = docs.sparkSession.sparkContext.broadcast(model.trigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Evidence(shared.value)
        for batch in batches:
            raw, start = text_bytes(batch.column(1))
            pieces = features.restored(_LOWER[raw], start)[3]
            ids = batch.column(0).take(pa.array([t for t, _ in pieces], pa.int64()))
            readings = pa.array([p.decode("utf-8", "replace") for _, p in pieces], pa.string())
            yield pa.RecordBatch.from_arrays([ids, readings], ["doc_id", "reading"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, reading string")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = train(docs, labels, text)
    keep = docs.columns
    scored = score_documents(docs.withColumnRenamed("score", "_own_score") if "score" in keep else docs, model, text)
    left = scored.where(F.col("score") < threshold).drop("score")
    return left.withColumnRenamed("_own_score", "score").select(*keep) if "score" in keep else left.select(*keep)

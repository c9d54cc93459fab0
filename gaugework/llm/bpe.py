"""Byte-level BPE as a streaming transducer with bounded lookahead, and a streaming decoder.

A vocabulary file gives the merge list. Text is cut into pieces by the usual pattern, each piece is merged in the order
of ranks, and a piece longer than the window is merged window by window: how far an unseen byte can still change
tokens to its left follows from the merge list alone (:func:`sufficient_lookahead`), so all tokens before that
distance are final and are emitted. Buffers and caches have a fixed size whatever the text is.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The public pattern of byte-level BPE vocabularies, with white space as Unicode defines it.
PIECES = regex.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A single space between two other characters: no piece spans the place before it.
_SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
BLOCK_CHARS = 1 << 16
WINDOW_BYTES = 1 << 12
CACHED_PIECES = 200_000
FLUSH_BYTES = 8 << 20
_ID_BITS = 32
_ID = (1 << _ID_BITS) - 1
_NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files: itself, or one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a place after which no further byte can change the tokens before it.

    Take what is known of a piece, and any continuation. Run the rules in order on both. The tokens left of some border
    agree, at first up to the end of the known bytes. A rule (a, b) moves the border only by consuming the agreed token
    ``a`` next to it in one of the two, so by len(a). The next to move it must be a later rule (x, y) whose ``y`` begins at
    the new border, so ``a`` is ``y`` or is on its left spine. The longest such chain, taken from the last rule down, bounds
    the total.
    """
    parts = {a + b: (a, b) for a, b in merges}
    reach: dict[bytes, int] = {}
    longest = 0
    for a, b in reversed(merges):
        total = len(a) + reach.get(a, 0)
        longest = max(longest, total)
        token = b
        while True:
            if reach.get(token, 0) < total:
                reach[token] = total
            if token not in parts:
                break
            token = parts[token][0]
    return longest + max((len(t) for t in parts), default=1)


class _Cache(dict):
    """Pieces seen lately and their ids, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("I", self.encode(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Transducer:
    def __init__(self, path: str, window: int = WINDOW_BYTES):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet = byte_alphabet()
        plain = lambda token: bytes(alphabet[c] for c in token)
        vocabulary = {plain(token): number for token, number in content["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        merges = [(plain(a), plain(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.rules = {(vocabulary[a], vocabulary[b]): rank << _ID_BITS | vocabulary[a + b] for rank, (a, b) in enumerate(merges)}
        self.first = [vocabulary[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(merges)
        self.window = window
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, number in vocabulary.items():
            self.tokens[number] = token
        for token, number in self.special.items():
            self.tokens[number] = token.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.cache = _Cache(self.encode_piece)
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the rules to the ids of a short run of bytes, lowest rank first, leftmost first."""
        find = self.rules.get
        ranks = [find(pair, _NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            ids[at] = best & _ID
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find((ids[at], ids[at + 1]), _NONE)
            if at:
                ranks[at - 1] = find((ids[at - 1], ids[at]), _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        rules, n = self.rules, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (rule := rules.get((ids[left], ids[right]))) is not None:
                heapq.heappush(heap, (rule, left, ids[left], ids[right]))

        for k in range(n - 1):
            offer(k)
        while heap:
            rule, left, a, b = heapq.heappop(heap)
            right = after[left]
            if ids[left] != a or right >= n or ids[right] != b:
                continue
            ids[left], ids[right] = rule & _ID, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        first = self.first
        if len(piece) <= 64:
            return self.merge([first[b] for b in piece])
        out: list[int] = []
        at, size = 0, self.window + self.lookahead
        while at < len(piece):
            known = piece[at : at + size]
            ids = self.merge_long([first[b] for b in known])
            if at + len(known) < len(piece):
                ends = np.cumsum(self.lengths[ids])
                stable = int(np.searchsorted(ends, len(known) - self.lookahead, side="right"))
                ids = ids[:stable]
                at += int(ends[stable - 1])
            else:
                at = len(piece)
            out += ids
        return out

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that no piece spans."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            cut = _SAFE_CUT.search(text, at + BLOCK_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        out = []
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                for block in self.blocks(part):
                    out.append(b"".join(map(self.cache.__getitem__, PIECES.findall(block))))
        return b"".join(out)

    def decode(self, ids: bytes, step: int = 1 << 16) -> str:
        """The text of ids: bytes of ``step`` ids at a time through a UTF-8 state machine that keeps open sequences."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers = np.frombuffer(ids, dtype="<u4")
        out = []
        for k in range(0, len(numbers), step):
            some = numbers[k : k + step]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.places[some] - (ends - lengths), lengths)
            out.append(machine.decode(self.bytes[shift + np.arange(len(shift))].tobytes()))
        out.append(machine.decode(b"", final=True))
        return "".join(out)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process."""
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """The columns ``keep`` (all by default) with ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded``.

    A null or empty text has no tokens and decodes to the empty text. No shuffle; each row by itself. ``path`` is
    the vocabulary file, which every executor must be able to open. Columns named like the new ones are replaced.
    """
    made = {"n_tokens", "ids", "decoded"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(
        [
            *fields,
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            *([T.StructField("decoded", T.StringType())] if decode else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            begin, held, ids, texts = 0, 0, [], []
            names = [*keep, "n_tokens", "ids", *(["decoded"] if decode else [])]

            def flush(end: int) -> pa.RecordBatch:
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                made += [pa.array(texts, pa.string())] if decode else []
                kept = [batch.column(k).slice(begin, end - begin) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *made], names=names)

            column = batch.column(len(keep))
            for k in range(len(column)):
                found = machine.encode(column[k].as_py() or "")
                ids.append(found)
                held += len(found)
                if decode:
                    texts.append(machine.decode(found))
                if held >= FLUSH_BYTES:
                    yield flush(k + 1)
                    begin, held, ids, texts = k + 1, 0, [], []
            yield flush(len(column))

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)

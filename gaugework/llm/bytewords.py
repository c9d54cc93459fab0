"""Words, lower-casing and 64-bit word hashes of a whole Arrow batch of texts, in numpy over the UTF-8 bytes.

White space is the six ASCII characters, so words can be cut on bytes without decoding. The hash of a word
is a polynomial over its bytes modulo 2^64, taken from running sums, and mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, each text followed by a space, and the start of each text (plus the end).

    A null is an empty text.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    starts = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    out = np.full(int(starts[-1]), 32, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[starts[1:] - 1] = False
    out[keep] = data
    return out, starts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        with np.errstate(over="ignore"):
            step = out[done - 1] * base
        out[done : done + take] = out[:take] * step
        done += take
    return out


_PLACES = _powers(1 << 16, _BASE)
_INVERSE = _powers(1 << 16, np.uint64(pow(int(_BASE), -1, 1 << 64)))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word; ``data`` ends in white space."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(lowered: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word ``lowered[first:last]``. Places repeat every 65,536 bytes, and the length enters too."""
    out = np.empty(len(first), dtype=np.uint64)
    block = 1 << 16
    # runs of words whose bytes lie in one stretch of at most a block; a longer word is a stretch of its own
    at = 0
    while at < len(first):
        begin = first[at]
        end = int(np.searchsorted(last, begin + block, side="right"))
        if end <= at:
            word = lowered[first[at] : last[at]].astype(np.uint64) + np.uint64(1)
            total = np.zeros(1, dtype=np.uint64)
            for k in range(0, len(word), block):
                piece = word[k : k + block]
                total = mix(total + (piece * _PLACES[: len(piece)]).sum(dtype=np.uint64))
            out[at] = total[0]
            at += 1
            continue
        span = lowered[begin : last[end - 1]].astype(np.uint64) + np.uint64(1)
        running = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(span * _PLACES[: len(span)], out=running[1:])
        a, b = first[at:end] - begin, last[at:end] - begin
        out[at:end] = (running[b] - running[a]) * _INVERSE[a]
        at = end
    return mix(out + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a batch: ``first``, ``last`` (bytes), ``text`` (index of the text) and ``start`` (first word of each text)."""

    def __init__(self, column: pa.Array):
        raw, self.text_start = text_bytes(column)
        self.raw = raw
        self.lowered = _LOWER[raw]
        self.first, self.last = word_bounds(raw) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.start = np.searchsorted(self.first, self.text_start)
        self.count = np.diff(self.start)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.lowered, self.first, self.last)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words = Words(column)
    hashed = words.hashes()
    n = len(hashed)
    rolled = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled = rolled * _BASE + hashed[k : k + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for begin, count in zip(words.start[:-1].tolist(), words.count.tolist()):
        if count >= width:
            sets.append(np.unique(rolled[begin : begin + count - width + 1]))
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for value in hashed[begin : begin + count]:
                    whole = whole * _BASE + value
            sets.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets

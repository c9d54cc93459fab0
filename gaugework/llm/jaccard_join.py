"""Near-duplicate join on word shingles: a size-aware heavy-light similarity join, and the components of its links.

Sets are ordered by one global order, rare shingles first. Two sets of Jaccard similarity t or more agree in the first
n - ceil(t n) + 1 elements of that order at least once, and in one more element at least twice. So

- light sets, up to a boundary size, enumerate all pairs of those elements (subsets of fixed size 2): many keys, but
  hardly any list of a key holds unrelated sets;
- heavy sets enter single elements, and the inverted lists of those are scanned; light sets that a heavy one may match
  enter there too;
- the boundary is the size up to which enumerating subsets costs less than scanning lists, by the mean list length.

A list is not expanded into all pairs. Each set has a signature, the parity of its elements in a few buckets an element; two signatures
differ in no more buckets than the sets differ in elements, so most pairs that cannot link are told by them where a list is
read. A pair that shares many lists goes on from the least of them: each set brings the least keys of its lists, and a list leaves out
the pairs that have a lesser one in common. Of its own pairs a part of a list hands on up to ``PAIRS_A_MEMBER`` for each member, or else
each member's nearest one. Those are compared by their whole texts, nearest first, and verified links give components. Lists that are longer than a
part, or that had more pairs, are read again in blocks, only for members of different components; in the last round all
pairs are handed on. Exact copies are one class throughout. So every link between classes is either verified or inside a component
of verified ones, and components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.bytewords import mix, shingle_sets
from gaugework.llm.common import HOT_SHARE, look_up, materialise, materialise_last
from gaugework.session import shuffle_partitions

#: Shingles counted together before they are handed on; outside the counted share, those that occur once are let go.
COUNT_BLOCK = 4_000_000
#: Of 64 equal ranges of shingle hashes, those that are counted exactly. They come first in the global order, so the
#: elements that lists are made of (a quarter of a set) are from the counted ones in most sets.
COUNTED_RANGES = 24
#: Rounds in which a part of a list hands on no more than ``PAIRS_A_MEMBER`` pairs for each of its members.
BEST_ROUNDS = 2
PAIRS_A_MEMBER = 4
#: Buckets of a signature: a power of two from this many times the elements, within these bounds.
BUCKETS_AN_ELEMENT, LEAST_BUCKETS, MOST_BUCKETS = 1, 64, 1 << 17
#: Frequent shingles are those above a count chosen so that no more than this many can exist.
MOST_FREQUENT = 16_000_000
LEAST_FREQUENT = 8
#: Members of one part of a frequent shingle's list, and of a block when members are compared.
PART_ROWS = 2000
BLOCK_ROWS = 2048
#: Blocks of a list that is read again, so copies of its members; more only where a block would have more rows than this.
LIST_BLOCKS, MOST_BLOCK_ROWS = 4, 16_384
#: Least lists of a set that tell whether two sets have met in another list.
KEYS_A_MEMBER = 16
#: Cost of comparing two entries of a list, in units of the cost of entering one.
SCAN_COST = 4.0
#: Bits of a bit map: a power of two from this many for each key, and no more than so many. Keys that share a bit cost a row.
BITS_A_KEY, MOST_BITS = 16, 1 << 28
#: Rows of lists, and words of signatures, that are held at once.
LIST_ROWS = 20_000
SIGN_WORDS = 4_000_000
EMIT_ROWS = 500_000
#: Edges of one file between the steps of the components.
EDGES_A_FILE = 100_000


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of sets of sizes n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def fingerprint(shingles: np.ndarray) -> int:
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def bit_map(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each key, by its low bits, in 64-bit words."""
    size = min(max(64, 1 << (BITS_A_KEY * keys.count()).bit_length()), MOST_BITS)
    bits = keys.select(F.expr(f"pmod({key}, {size})").alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    table = np.zeros(size // 64, np.int64)
    for part in words.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return table


def in_map(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.view(np.int64) & (len(table) * 64 - 1)
    return (table[bit >> 6] >> (bit & 63) & 1).astype(bool)


def signature(shingles: np.ndarray) -> bytes:
    """The parity of the shingles in each bucket. Halves folded by exclusive or are the signature with half as many buckets."""
    buckets = min(max(LEAST_BUCKETS, 1 << (BUCKETS_AN_ELEMENT * len(shingles) - 1).bit_length()), MOST_BUCKETS)
    bucket = (shingles & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


def survey(docs: DataFrame, width: int) -> DataFrame:
    """One scan: ``kind 0`` rows (id, fingerprint, size, hash of the text, signature) for documents, ``kind 1`` rows (shingle, count) for the shingles of
    the counted ranges and any that occur more than once in a block of documents, ``kind 2`` rows (occurrences, distinct) for
    each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "n", "text_hash", "sign"]
        held, size, known = [], 0, set()

        def count() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = (counts > 1) | _counted(values)
            kinds = np.append(np.full(int(twice.sum()), 1, np.int8), np.int8(2))
            a = np.append(values[twice].view(np.int64), counts.sum())
            b = np.append(counts[twice], len(values))
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())],
                names,
            )

        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 512):
                sets = shingle_sets(batch.column(1).slice(at, 512), width)
                prints = [fingerprint(s) if len(s) else None for s in sets]
                for s, print_ in zip(sets, prints):
                    if len(s) and print_ not in known:
                        known.add(print_)
                        held.append(s)
                        size += len(s)
                        if size >= COUNT_BLOCK:
                            yield count()
                            held, size, known = [], 0, set()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(sets), np.int8)),
                        ids.slice(at, 512),
                        pa.array(prints, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        batch.column(2).slice(at, 512),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names,
                )
        if held:
            yield count()

    return docs.mapInArrow(run, "kind byte, a long, b long, n int, text_hash long, sign binary")


def _counted(shingles: np.ndarray) -> np.ndarray:
    return (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)) < COUNTED_RANGES


def boundary(list_length: float, percent: int, most: int = 64) -> int:
    """The largest size up to which pairs of elements cost no more than single elements and the scan of their lists."""
    best = 0
    for n in range(2, most + 1):
        least = -(-percent * n // 100)
        singles, extended = n - least + 1, n - least + 2
        if extended * (extended - 1) / 2 <= singles * (1 + SCAN_COST * (list_length - 1)):
            best = n
        else:
            break
    return best


def _ordered(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in global order with the counts of its frequent shingles (0: not frequent)."""
    count = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        count = np.where(frequent[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, ~_counted(shingles), count))
    return shingles[order], count[order]


def entries(docs: DataFrame, width: int, percent: int, limit: int, frequent, repeated) -> DataFrame:
    """The list entries ``sig, part, fp, n`` of every class (once a task).

    ``repeated`` is a bit map of the counted shingles that occur twice or more: a list of any other one has a single member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = frequent.value
        seen: set[int] = set()
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            names = ["sig", "part", "fp", "n"]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)

        def add(keys: np.ndarray, count: np.ndarray, print_: int, n: int) -> None:
            parts = count // PART_ROWS
            part = np.where(parts > 0, (print_ & 0x7FFFFFFF) % np.maximum(parts + 1, 1), -1).astype(np.int32)
            some = len(keys)
            rows.append((keys.view(np.int64), part, np.full(some, print_, np.int64), np.full(some, n, np.int32)))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for s in shingle_sets(batch.column(0).slice(at, 512), width):
                    n = len(s)
                    if n < 2 or (print_ := fingerprint(s)) in seen:
                        continue
                    seen.add(print_)
                    least = -(-percent * n // 100)
                    s, count = _ordered(s, shingles, counts)
                    again = ~_counted(s) | in_map(repeated.value, s)
                    if n <= limit:
                        i, j = np.triu_indices(n - least + 2, 1)
                        both = again[i] & again[j]
                        i, j = i[both], j[both]
                        add(mix(s[i] * np.uint64(0x9E3779B97F4A7C15) + mix(s[j])), np.minimum(count[i], count[j]), print_, n)
                        held += len(i)
                    if n > limit or 100 * n >= percent * (limit + 1):
                        first = np.flatnonzero(again[: n - least + 1])
                        add(mix(s[first]), count[first], print_, n)
                        held += len(first)
                    if held >= EMIT_ROWS:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return docs.mapInArrow(run, "sig long, part int, fp long, n int")


def lists(listed: DataFrame, percent: int, limit: int) -> DataFrame:
    """Members ``sig, fp, n`` of every list that hold another one of a size that may link.

    They come by size in chunks of up to ``BLOCK_ROWS``; ``whole``: the list is one chunk. ``need`` is the least number of lists that
    a set shares with any of the others in this list if the two link.
    """
    names = ["sig", "chunk", "whole", "fp", "n", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def members(columns: list[np.ndarray]) -> pa.RecordBatch:
            sig, part, fp, n = columns
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (fp[1:] != fp[:-1])
            sig, part, fp, n = (c[fresh] for c in columns)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(sig)))
            place = (np.arange(len(sig)) - np.repeat(start, size)) // BLOCK_ROWS
            whole = (part < 0) & (np.repeat(size, size) <= BLOCK_ROWS)
            # the smallest and the largest member that may link, which need the fewest lists (but for one by rounding)
            wide = n.astype(np.int64)
            group, far, own = np.cumsum(new) << 32, 100 * wide // percent, np.arange(len(sig))
            low = np.searchsorted(group + wide, group - (-percent * wide // 100))
            high = np.searchsorted(group + wide, group + far, side="right") - 1
            need = np.minimum(
                np.where(low < own, needed_lists(wide, wide[low], percent), wide), np.where(high > own, needed_lists(wide, wide[high], percent), wide)
            )
            need = np.where((part >= 0) | (wide <= limit), 1, np.maximum(need - 1, 1)).astype(np.int32)
            keep = (low < own) | (high > own) | (part >= 0)
            made = [sig, (part.astype(np.int64) + 1 << 32) + place, whole, fp, n, need]
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in made], names)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            if not len(columns[0]):
                continue
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield members([c[:cut] for c in columns])
        if rest is not None and len(rest[0]):
            yield members(rest)

    parts = shuffle_partitions(listed.sparkSession)
    dealt = listed.repartition(parts, "sig", "part").sortWithinPartitions("sig", "part", "n", "fp")
    return dealt.mapInArrow(run, "sig long, chunk long, whole boolean, fp long, n int, need int")


def needed_lists(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Lists of single elements that linked sets of sizes n and m share at least."""
    return least_overlap(n, m, percent) + (-percent * np.maximum(n, m) // 100) + 1


def hopeful(members: DataFrame) -> DataFrame:
    """The members whose sets are in enough lists for some link: in k of those that need no more than k, for some k."""
    place = F.row_number().over(Window.partitionBy("fp").orderBy("need", "sig", "chunk"))
    enough = F.max(F.col("need") <= F.col("_place")).over(Window.partitionBy("fp"))
    return members.withColumn("_place", place).withColumn("_enough", enough).where("_enough").drop("_place", "_enough")


def distances(signs: pa.Array, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Buckets in which the signatures of rows ``p`` and ``q`` differ, the larger folded to the size of the smaller."""
    signs = signs.cast(pa.large_binary())
    offsets = np.frombuffer(signs.buffers()[1], np.int64)[signs.offset : signs.offset + len(signs) + 1]
    words = np.frombuffer(signs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    start, width = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8

    def folded(rows: np.ndarray, to: int) -> np.ndarray:
        made = np.empty((len(rows), to), np.uint64)
        wide = width[rows]
        for own in np.unique(wide):
            pick = wide == own
            full = words[start[rows[pick]][:, None] + np.arange(own)]
            made[pick] = np.bitwise_xor.reduce(full.reshape(-1, own // to, to), axis=1)
        return made

    least = np.minimum(width[p], width[q])
    out = np.empty(len(p), np.int64)
    for to in np.unique(least):
        same = np.flatnonzero(least == to)
        step = max(1, SIGN_WORDS // int(to))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            out[some] = np.bitwise_count(folded(p[some], to) ^ folded(q[some], to)).sum(axis=1, dtype=np.int64)
    return out


def padded_keys(keys: pa.ListArray) -> np.ndarray:
    """A row of ``KEYS_A_MEMBER`` keys for each list, filled up with the largest number."""
    offsets, values = keys.offsets.to_numpy(), keys.values.to_numpy()
    out = np.full((len(keys), KEYS_A_MEMBER), np.iinfo(np.int64).max)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(keys)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = values[offsets[0] : offsets[-1]]
    return out


def met_elsewhere(keys: np.ndarray, sig: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether rows ``p`` and ``q`` have a key in common that is less than that of their list."""
    out, step = np.zeros(len(p), bool), max(1, SIGN_WORDS // KEYS_A_MEMBER**2)
    for at in range(0, len(p), step):
        a, b = keys[p[at : at + step]], keys[q[at : at + step]]
        same = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[at : at + step] = (same & (a < sig[p[at : at + step], None])).any(axis=1)
    return out


def meet(dealt: DataFrame, percent: int, last: bool) -> DataFrame:
    """Pairs ``a, b, score`` of members of one ``sig, chunk`` whose labels differ and whose sizes and signatures allow a link.

    ``keys`` are the least keys of the lists that hold the member; a pair with a lesser key in common is left to that list.
    Members of side 1 meet those of side 2, members of side 0 each other. Unless it is the ``last`` round, a chunk with more than
    ``PAIRS_A_MEMBER`` such pairs a member gives each member's nearest one only, and a row with its list as ``more``.
    """
    names = ["a", "b", "score", "more"]

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, chunk, side, fp, n, label = (table.column(k).to_numpy() for k in range(6))
        n = n.astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (chunk[1:] != chunk[:-1])
        group = np.cumsum(new) - 1
        sign, keys = table.column(6).combine_chunks(), padded_keys(table.column(7).combine_chunks())
        empty = np.zeros(0, np.int64)
        found, first, second, held = [(empty, empty, empty / 1)], [], [], 0

        def sift() -> None:
            p, q = np.concatenate(first), np.concatenate(second)
            far, both = distances(sign, p, q), n[p] + n[q]
            near = far <= both - 2 * least_overlap(n[p], n[q], percent)
            p, q, score = p[near], q[near], far[near] / both[near]
            here = ~met_elsewhere(keys, sig, p, q)
            found.append((p[here], q[here], score[here]))

        x, step = np.arange(len(sig)), 1
        while True:
            x = x[x + step < len(sig)]
            x = x[group[x] == group[x + step]]
            y = x + step
            # members rise in size: whoever is too small for one is so for all that follow
            fit = least_overlap(n[x], n[y], percent) <= n[x]
            x, y = x[fit], y[fit]
            if not len(x):
                break
            fit = (label[x] != label[y]) & ((side[x] == 0) | (side[x] != side[y]))
            first.append(x[fit])
            second.append(y[fit])
            held += int(fit.sum())
            step += 1
            if held >= EMIT_ROWS:
                sift()
                first, second, held = [], [], 0
        if held:
            sift()
        p, q, score = (np.concatenate(c) for c in zip(*found))
        more = np.zeros(0, np.int64)
        if not last:
            many = np.bincount(group[p], minlength=group[-1] + 1) > PAIRS_A_MEMBER * np.bincount(group)
            more = np.unique(sig[many[group]])
            ends, at = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
            order = np.lexsort((at, score[at], ends))
            top = np.ones(len(order), bool)
            top[1:] = ends[order][1:] != ends[order][:-1]
            keep = ~many[group[p]]
            keep[at[order][top]] = True
            p, q, score = p[keep], q[keep], score[keep]
        if len(p):
            # a pair that meets in several lists of the batch goes on once
            a, b = np.minimum(fp[p], fp[q]), np.maximum(fp[p], fp[q])
            order = np.lexsort((b, a))
            a, b, score = a[order], b[order], score[order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            made = [pa.array(a[once]), pa.array(b[once]), pa.array(score[once]), pa.nulls(int(once.sum()), pa.int64())]
            whole = pa.RecordBatch.from_arrays(made, names)
            for at in range(0, len(whole), EMIT_ROWS):
                yield whole.slice(at, EMIT_ROWS)
        if len(more):
            empty = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty.cast(pa.float64()), pa.array(more)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) < LIST_ROWS:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            sig, chunk = table.column(0).to_numpy(), table.column(1).to_numpy()
            same = (sig == sig[-1]) & (chunk == chunk[-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = table.slice(cut).to_batches()
            if cut:
                yield from pairs(table.slice(0, cut).combine_chunks())
        if sum(map(len, rest)):
            yield from pairs(pa.Table.from_batches(rest).combine_chunks())

    parts = shuffle_partitions(dealt.sparkSession)
    dealt = dealt.select("sig", "chunk", F.col("side").cast("byte").alias("side"), "fp", "n", "label", "sign", "keys")
    dealt = dealt.repartition(parts, "sig", "chunk").sortWithinPartitions("sig", "chunk", "n")
    return dealt.mapInArrow(run, "a long, b long, score double, more long")


def blocks(members: DataFrame, todo: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the lists ``todo`` that hold more than one component, cut so that each two blocks of a list meet in a chunk of their own.

    Blocks grow with their list, so a member is copied ``LIST_BLOCKS`` times at most until they reach ``MOST_BLOCK_ROWS``.
    """
    named = members.select("sig", "fp", "n").join(todo, "sig", "left_semi").join(labels, "fp", "left")
    named = materialise(named.withColumn("label", F.coalesce("label", "fp")), "join-members")
    apart = named.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_size"))
    rows = F.greatest(F.lit(BLOCK_ROWS), F.least(F.ceil(F.col("_size") / LIST_BLOCKS), F.lit(MOST_BLOCK_ROWS)))
    apart = apart.where("_low != _high").select("sig", F.ceil(F.col("_size") / rows).cast("long").alias("_blocks"))
    cut = named.join(apart, "sig").withColumn("_own", F.expr("pmod(xxhash64(fp), _blocks)"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    chunk = F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")
    return cut.select("sig", chunk.alias("chunk"), side.alias("side"), "fp", "n", "label")


def best_partners(pairs: DataFrame) -> DataFrame:
    """For each set the pair with the partner of the nearest signature."""
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other"), "score")
    both = both.union(pairs.select("b", "a", "score"))
    best = both.groupBy("fp").agg(F.min(F.struct("score", "other")).alias("x")).select("fp", "x.other")
    return best.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        label = labels.select(F.col("fp").alias(end), F.col("label").alias(f"_{end}"))
        pairs = pairs.join(label, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a != _b").drop("_a", "_b")


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by their whole texts.

    A class is found again by the hash of one of its texts; a bit map tells the scan which texts may be needed. The end with more
    pairs leads; a leader and up to ``PART_ROWS`` of its partners meet in a task of their own.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("degree"))
    ends = materialise(ends.join(classes.select("fp", "text_hash"), "fp"), "join-ends")
    shared = spark.sparkContext.broadcast(bit_map(ends, "text_hash"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            pick = np.flatnonzero(in_map(shared.value, hashes))
            if len(pick):
                pick = pick[np.unique(hashes[pick], return_index=True)[1]]
                yield batch.take(pa.array(pick))

    found = docs.select("text", "text_hash").mapInArrow(wanted, "text string, text_hash long")
    texts = found.join(ends.select("fp", "text_hash"), "text_hash").dropDuplicates(["text_hash"]).select("fp", "text")
    texts = materialise(texts, "join-texts")
    degree = lambda end: ends.select(F.col("fp").alias(end), F.col("degree").alias(f"_{end}"))
    turned = pairs.join(degree("a"), "a").join(degree("b"), "b")
    swap = F.col("_a") < F.col("_b")
    turned = turned.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lead"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("fp"),
        F.ceil(F.greatest("_a", "_b") / PART_ROWS).cast("int").alias("_parts"),
    ).withColumn("part", F.expr("cast(pmod(xxhash64(fp), _parts) as int)"))
    turned = materialise(turned, "join-pairs")
    follow = turned.join(texts, "fp").select("lead", "part", F.lit(1).alias("place"), "fp", "text")
    leaders = turned.select("lead", "part").distinct()
    first = leaders.join(texts.withColumnRenamed("fp", "lead"), "lead").select(
        "lead", "part", F.lit(0).alias("place"), F.col("lead").alias("fp"), "text"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            leads, places, prints = (batch.column(k).to_numpy() for k in range(3))
            found: list[tuple[int, int]] = []
            for at in range(0, batch.num_rows, 512):
                for k, s in enumerate(shingle_sets(batch.column(3).slice(at, 512), width), at):
                    if fingerprint(s) != prints[k]:
                        raise ValueError("two texts share a hash")
                    if places[k] == 0:
                        lead, own = leads[k], s
                    elif lead == leads[k]:
                        shared = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(s) - shared):
                            found.append((int(lead), int(prints[k])))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = shuffle_partitions(spark)
    dealt = first.unionByName(follow).repartition(parts, "lead", "part").sortWithinPartitions("lead", "part", "place")
    return dealt.select("lead", "place", "fp", "text").mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``fp, label``: for every linked node but the least of its component, that least node.

    A large star step moves the neighbours above each node to the least of its neighbourhood, a small one those below and
    the node itself; they take turns until each node hangs on one root and no root on another. The least neighbours of hubs
    are looked up by broadcast.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "join-links")
    many = edges.count()
    bar = max(1, 2 * many // HOT_SHARE)
    files = min(shuffle_partitions(links.sparkSession), 1 + many // EDGES_A_FILE)

    def least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = rows.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("_n"))
        return look_up(rows, low, ["u"], "_n", bar), low

    while True:
        ends = edges.select(F.col("a").alias("x"), F.col("b").alias("up"), F.lit(0).alias("root")).union(
            edges.select(F.col("b"), F.lit(None).cast("long"), F.lit(1))
        )
        nodes = ends.groupBy("x").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("root").alias("root"))
        if not nodes.where("low != high or (root = 1 and low is not null)").limit(1).count():
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = least(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        large = materialise(large.distinct().coalesce(files), "join-large")
        near, low = least(large)
        small = near.where("v != low").select("v", "low").union(low.select("u", "low")).toDF("a", "b")
        edges = materialise(small.distinct().coalesce(files), "join-small")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 5, percent: int = 75
) -> DataFrame:
    """Per row ``doc_id, n_shingles, class_id, component_id, text_hash``.

    Texts link when 100 * intersection >= ``percent`` * union of their distinct ``width``-word shingles (A-Z in lower case,
    words between ASCII white space; a shorter text is one shingle). ``class_id`` is equal for equal sets; ``component_id`` is the
    smallest id that links reach. A null or empty text has the empty set, a null class and its own id as component. Null
    ids never name a component unless it has no other. Repeated rows are copies like any others.
    """
    spark = docs.sparkSession
    own = F.col(text)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), own.alias("text"), _text_hash(own).alias("text_hash"))

    def totalled() -> DataFrame:
        rows = materialise(survey(texts, width), "join-counted")
        sums = rows.where("kind = 1").groupBy("kind", "a").agg(F.sum("b").alias("b")).where("b > 1")
        return rows.where("kind != 1").unionByName(sums, allowMissingColumns=True)

    # the counts of the tasks go once they are summed
    surveyed = materialise_last(totalled, spark, "join-survey")
    light = surveyed.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), "n", "text_hash", "sign")
    totals = light.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows")).first()
    lengths = surveyed.where("kind = 2").agg(F.sum("a").alias("all"), F.sum("b").alias("distinct")).first()
    bar = max(LEAST_FREQUENT, (totals["all"] or 0) // MOST_FREQUENT + 1)
    counted = surveyed.where("kind = 1").select("a", F.col("b").alias("n"))
    repeated = spark.sparkContext.broadcast(bit_map(counted, "a"))
    counted = counted.where(F.col("n") >= bar).toArrow()
    shingles = counted.column(0).to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    frequent = spark.sparkContext.broadcast((shingles[order], counted.column(1).to_numpy()[order]))
    limit = boundary((lengths["all"] or 1) / (lengths["distinct"] or 1), percent)

    classes = light.where("fp is not null").groupBy("fp").agg(
        F.count(F.lit(1)).alias("_copies"), F.min("n").alias("_n"), F.max("n").alias("_m"),
        F.min("text_hash").alias("text_hash"), F.min("sign").alias("sign"),
    )
    same = F.when(F.col("_n") != F.col("_m"), F.raise_error(F.lit("two sets share a fingerprint"))).otherwise(F.col("_copies"))
    classes = materialise(classes.select("fp", same.alias("_copies"), "text_hash", "sign"), "join-classes")

    listed = entries(texts.select("text"), width, percent, limit, frequent, repeated)
    members = materialise(lists(listed, percent, limit), "join-lists")
    least = F.slice(F.sort_array(F.collect_list("sig")), 1, KEYS_A_MEMBER)
    signs = materialise(members.groupBy("fp").agg(least.alias("keys")).join(classes.select("fp", "sign"), "fp"), "join-signs")
    labels = spark.createDataFrame([], "fp long, label long")
    chunks = hopeful(members).withColumn("side", F.lit(0)).withColumn("label", F.col("fp"))
    todo = members.where("not whole").select("sig")
    for turn in range(BEST_ROUNDS + 1):
        met = materialise(meet(chunks.join(signs, "fp"), percent, turn == BEST_ROUNDS), "join-met")
        others = met.where("a is not null").groupBy("a", "b").agg(F.min("score").alias("score"))
        others = materialise(others, "join-across")
        pairs = others.count()
        for last in (False, True) if pairs > totals["rows"] else (True,):
            if not pairs:
                break
            # of many, first each set's nearest partner, which settles most; then all that is still open
            chosen = others.select("a", "b") if last else materialise(best_partners(others), "join-chosen")
            more = materialise(verify(texts, classes, chosen, width, percent), "join-links")
            labels = components(labels.toDF("a", "b").union(more))
            if not last:
                others = materialise(apart(others.join(chosen, ["a", "b"], "left_anti"), labels), "join-open")
                pairs = others.count()
        todo = materialise((todo if turn == 0 else todo.limit(0)).union(met.where("more is not null").select("more")).distinct(), "join-todo")
        if turn == BEST_ROUNDS or todo.isEmpty():
            break
        chunks = blocks(members, todo, labels)

    bar = max(1, (totals["rows"] or 0) // HOT_SHARE)
    classes = classes.select("fp", "_copies").join(labels, "fp", "left")
    light = light.drop("sign")
    named = look_up(light.where("fp is not null"), classes.select("fp", F.coalesce("label", "fp").alias("label"), "_copies"), ["fp"], "_copies", bar)
    named = materialise(named.select("doc_id", "n", "fp", "label", "text_hash"), "join-named")
    groups = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    placed = look_up(named, groups, ["label"], "_rows", bar).select("doc_id", "n", "fp", "component_id", "text_hash")
    alone = light.where("fp is null").select("doc_id", "n", "fp", F.col("doc_id").alias("component_id"), "text_hash")
    return placed.unionByName(alone).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("fp").alias("class_id"), "component_id", "text_hash"
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component: one document of each group, with all its columns.

    Rows of one id in one component are one document; all of them stay. Rows are found again by id and a hash of their text,
    so rows of other texts under a null or repeated id are judged by their own components.
    """
    found = near_duplicates(docs, text, id_column, width, percent)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    lost = lost.select(F.col("doc_id").alias("_lost"), F.col("text_hash").alias("_lost_hash")).distinct()
    same = docs[id_column].cast("long").eqNullSafe(F.col("_lost")) & (_text_hash(docs[text]) == F.col("_lost_hash"))
    return docs.join(lost, same, "left_anti")

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest

from gaugework.lineage import scratch_path
from gaugework.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (5, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, "http://c", "<p>same</p>"), (1, "http://d\r\nx", "é\r\n\r\nWARC/1.1"),
    (2, None, None), (4, "u", ""), (7, "u", "x" * 500_000), (8, "u", "only"), (8, "u", "only"), (None, "u", "only"), (None, None, "null id"),
]


def expected(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i if i is not None else 1 << 63)
    out = Counter()
    for payload, ids in groups.items():
        digest = warc.digest_of(payload)
        for place, i in enumerate(sorted(ids)):
            revisit = place > 0 and len(payload) >= least
            first = min(ids)
            out[(None if i == 1 << 63 else i, len(payload), digest, "revisit" if revisit else "response", first if revisit and first != 1 << 63 else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    index, folder = warc.archive_pages(make(spark, ROWS), least_bytes=least)
    found = warc.read_archives(index, folder)
    assert Counter(map(tuple, found.collect())) == expected(ROWS, least)
    payloads = {r.payload_digest: bytes(r.payload) for r in warc.read_archives(index, folder, payload=True).collect() if r.record_type == "response"}
    assert set(payloads.values()) == {(h or "").encode() for _, _, h in ROWS}


def test_sidecar_indexes_and_members(spark):
    index, folder = warc.archive_pages(make(spark, ROWS))
    beside = warc.read_index(spark, folder, index)
    assert Counter(map(tuple, beside.collect())) == Counter(map(tuple, index.collect()))
    store, root = warc.open_folder(folder)
    for name in {r.file for r in index.collect()}:
        data = store.open_input_stream(f"{root}/{name}", compression=None).read()
        own = sorted((r.offset, r.length) for r in index.collect() if r.file == name)
        assert own[0][0] == 0 and sum(n for _, n in own) == len(data)
        for offset, length in own:
            member = zlib.decompressobj(warc.GZIP)
            assert member.decompress(data[offset : offset + length]).startswith(b"WARC/1.1") and member.eof and not member.unused_data
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(own)


def test_crowd_of_equal_pages(spark):
    rows = [(i, "u", "crowd" if i % 3 else f"own {i}") for i in range(1, 300)]
    index, folder = warc.archive_pages(make(spark, rows))
    assert Counter(map(tuple, warc.read_archives(index, folder).collect())) == expected(rows)


def test_empty_table(spark):
    index, folder = warc.archive_pages(make(spark, []))
    assert index.count() == 0 and warc.read_archives(index, folder).count() == 0


def test_files_rotate(spark, monkeypatch):
    folder = scratch_path(spark, "warc-rotate")
    monkeypatch.setattr(warc, "ROTATE_BYTES", 1000)
    captured = warc.capture(make(spark, [(i, "u", "y" * 400) for i in range(30)]).coalesce(1), folder).collect()
    assert len({r.file for r in captured}) > 5 and [r.place & 0xFFFF for r in captured] == list(range(30))


def test_stream_over_member_borders_and_broken_end():
    records = [warc.record("response", k, "u", b"p" * k * 1000, k * 1000, warc.digest_of(b"p" * k * 1000), None) for k in range(5)]
    whole = gzip.compress(records[0] + records[1]) + gzip.compress(records[2][:100]) + gzip.compress(records[2][100:] + records[3])
    assert list(warc.inflate_records(io.BytesIO(whole))) == records[:4]
    fields, size, payload = warc.parse(records[4])
    assert (fields["x-page-id"], size, hashlib.sha1(payload).digest()) == ("4", 4000, hashlib.sha1(b"p" * 4000).digest())
    with pytest.raises(ValueError):
        list(warc.inflate_records(io.BytesIO(gzip.compress(records[4][:-50]))))

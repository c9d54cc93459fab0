"""WARC archives: capture as monolithic gzip files, normalise to one gzip member per record with an offset index, read back.

Files are written by the tasks into the shared folder through the file system its address names, under names of their
own for each attempt; only names that a finished task returns are ever read, so a lost or repeated task leaves at
most an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import HOT_SHARE, look_up, materialise
from gaugework.lineage import scratch_path
from gaugework.session import shuffle_partitions

GZIP = 31
CHUNK = 1 << 20
ROTATE_BYTES = 256 << 20
FLUSH_BYTES = 8 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()
#: Stands for a null id where ids are ordered: the largest.
_LAST = (1 << 63) - 1


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries the HTTP head only; ``size`` and ``digest`` are of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{kind}')}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {IDENTICAL}"] + ([] if refers_to is None else [f"X-Refers-To-Page: {refers_to}"])
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Fields, payload size by the HTTP head, and payload bytes of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, int(_fields(http)["content-length"]), payload


def inflate_records(stream) -> Iterator[bytes]:
    """The records of a gzip stream in order. The stream is inflated once, chunk by chunk, over member borders."""
    inflater, buffer, need, head_end = zlib.decompressobj(GZIP), bytearray(), 0, -1
    ended = False
    while True:
        while head_end < 0 or len(buffer) < need:
            if head_end < 0:
                head_end = buffer.find(b"\r\n\r\n")
                if head_end >= 0:
                    need = head_end + 4 + int(_fields(bytes(buffer[:head_end]))["content-length"]) + 4
                    continue
            if ended:
                if buffer:
                    raise ValueError("the archive ends inside a record")
                return
            chunk = stream.read(CHUNK)
            ended = not chunk
            while chunk:
                buffer += inflater.decompress(chunk)
                chunk = inflater.unused_data
                if inflater.eof:
                    inflater = zlib.decompressobj(GZIP)
        yield bytes(buffer[:need])
        del buffer[:need]
        head_end = -1


CAPTURED = "file string, place long, page_id long, payload_bytes long, payload_digest string"
INDEXED = "file string, offset long, length long, page_id long, record_type string, refers_to long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def capture(pages: DataFrame, folder: str, html: str = "html", level: int = 1) -> DataFrame:
    """Write all pages as response records into gzip files of one stream each; a row per record tells its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ordinal = TaskContext.get().partitionId(), 0
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        name, out, written = "", None, 0
        for batch in batches:
            rows = []
            for page_id, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or written >= ROTATE_BYTES:
                    if out is not None:
                        out.write(gzip.flush())
                        out.close()
                    name, written = f"capture-{task:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out, gzip = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                payload = (text or "").encode("utf-8", "replace")
                digest = digest_of(payload)
                data = record("response", page_id, url, payload, len(payload), digest, None)
                out.write(gzip.compress(data))
                written += len(data)
                rows.append((name, task << 36 | ordinal, page_id, len(payload), digest))
                ordinal += 1
            yield _rows(CAPTURED, rows)
        if out is not None:
            out.write(gzip.flush())
            out.close()

    return pages.select("page_id", "url", html).mapInArrow(run, CAPTURED)


def decide(captured: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``record_type, refers_to``. Of equal payloads of ``least_bytes`` or more the smallest page id is the response.

    Payloads are equal when digest and length are. A null id counts as the largest. Where one page is there twice with one
    payload, the record written first is the response. Crowds are combined in the map tasks and looked up by broadcast.
    """
    keys = ["payload_digest", "payload_bytes"]
    rows = captured.withColumn("_id", F.coalesce("page_id", F.lit(_LAST)))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    bar = max(1, captured.count() // HOT_SHARE)
    marked = look_up(rows, groups.where("_n > 1"), keys, "_n", bar)
    ties = marked.where("_id = _first").groupBy(*keys).agg(F.min("place").alias("_place"), F.max("_n").alias("_size"))
    marked = look_up(marked, ties, keys, "_size", bar)
    revisit = F.col("_n").isNotNull() & (F.col("place") != F.col("_place"))
    return marked.select(
        "file",
        "place",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit & (F.col("_first") != _LAST), F.col("_first")).alias("refers_to"),
    )


def normalise(decided: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite every captured file with a gzip member per record, and write its sidecar index beside it.

    A captured file belongs to the task that gets its rows; it is inflated once, record by record, in the order of the
    rows. Returns the index rows.
    """
    names = ["offset", "length", "page_id", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        source = records = out = index = None
        name, at = "", 0
        for batch in batches:
            rows = []
            for file, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file != source:
                    if out is not None:
                        out.close()
                        index.close()
                    source, at = file, 0
                    records = inflate_records(store.open_input_stream(f"{root}/{file}", compression=None))
                    name = f"{file.split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    index = store.open_output_stream(f"{root}/{name}.index.jsonl", compression=None)
                data = next(records)
                fields, size, _ = parse(data)
                page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
                if kind == "revisit":
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    data = record(kind, page_id, fields["warc-target-uri"], None, size, digest, refers_to)
                gzip = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                member = gzip.compress(data) + gzip.flush()
                out.write(member)
                entry = (at, len(member), page_id, kind, refers_to)
                index.write(json.dumps(dict(zip(names, entry))).encode() + b"\n")
                rows.append((name, *entry))
                at += len(member)
            yield _rows(INDEXED, rows)
        if out is not None:
            out.close()
            index.close()

    dealt = decided.repartition(shuffle_partitions(decided.sparkSession), "file").sortWithinPartitions("file", "place")
    return dealt.select("file", "record_type", "refers_to").mapInArrow(run, INDEXED)


def read_index(spark, folder: str, files: DataFrame | None = None) -> DataFrame:
    """The sidecar indexes of a folder as index rows; with ``files`` (column ``file``) only those archives."""
    found = spark.read.schema(INDEXED.split(", ", 1)[1]).json(f"{folder}/*.index.jsonl").withColumn(
        "file", F.regexp_extract("_metadata.file_name", r"^(.*)\.index\.jsonl$", 1)
    )
    found = found.select(*[f.split()[0] for f in INDEXED.split(", ")])
    return found if files is None else found.join(files.select("file").distinct(), "file", "left_semi")


def read_archives(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at the places of the index, one seek each; with ``payload`` their bytes too (revisits have none).

    A payload that does not fit its digest or length is an error.
    """
    schema = READ + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        name, archive = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if archive is not None:
                        archive.close()
                    name, archive = file, store.open_input_file(f"{root}/{file}")
                fields, size, body = parse(zlib.decompress(archive.read_at(length, offset), GZIP))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                if kind == "response" and (len(body) != size or digest_of(body) != digest):
                    raise ValueError(f"payload at {offset} of {file} does not fit its record")
                number = lambda key: int(fields[key]) if key in fields else None
                row = (number("x-page-id"), size, digest, kind, number("x-refers-to-page"))
                rows.append((*row, body) if payload else row)
                held += len(body)
                if held >= FLUSH_BYTES:
                    yield _rows(schema, rows)
                    rows, held = [], 0
            yield _rows(schema, rows)
        if archive is not None:
            archive.close()

    return index.select("file", "offset", "length").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, html: str = "html", least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Capture, decide and normalise all ``pages`` (``page_id, url`` and the html); the index rows and their folder.

    A null page is an empty payload, a null url an empty target; a null id is left out of the record. An empty table gives no
    file and an empty index. Payload size and digest are of the UTF-8 bytes.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    captured = materialise(capture(pages, folder, html), "warc-captured")
    decided = decide(captured, least_bytes)
    return materialise(normalise(decided, folder), "warc-index"), folder

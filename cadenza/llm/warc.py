"""WARC archives with a two-level capture index.

Writing: each task writes its rows as gzip members, one a record, to archive files of its own in the shared folder, and
gives back where each record lies. Of records with equal payloads of at least ``least`` bytes, the one with the smallest
page_id is a response and the others are revisits that refer to it, without the payload.

Index: the captures are range-sorted by reversed-host key. Each index file is a run of compressed blocks of BLOCK lines
and, at its end, a sparse directory with the first key of each block. A lookup finds the file by the files' first keys,
binary-searches the directory, and reads just the blocks that may hold the key; records are then read by ranges.

Which record is a revisit is decided on ids and digests alone, and revisits are written from these small rows. Responses
are the pages that aren't in the list of revisits: where that list is too large to broadcast, html is shuffled once, by
page, so that a payload which very many pages share isn't gathered.

A lookup deals a key's index files to several tasks and gives back a block at a time, so that a URL which very many
captures share is held by no task. A task that fails leaves files that nothing refers to: only what a successful task
gives back is kept.

Nulls: a null html is an empty payload; a null URL is the empty URL, with a key like any other; a null page_id is written
as such, is smaller than no other id, and isn't referred to unless all ids of its payload are null. Repeated rows are
records of their own; all rows with the smallest id of a payload are responses. Very long payloads are written whole.
Columns that aren't named are ignored. An empty table gives no records and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._work import TEXTS, fresh_dir, hot_join, written

DATE = "2026-01-01T00:00:00Z"
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Lines of an index block, captures of an index file, records that a reading task is sized for.
BLOCK = 500
INDEX_ROWS = 100_000
READ_ROWS = 4_000
#: Bytes that are read ahead where records follow each other.
AHEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, wbits=31)
    return squeeze.compress(data) + squeeze.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, *, known: tuple[str, int] | None = None) -> bytes:
    """One WARC record; a revisit (refers_to is given) has the HTTP head only. ``known``: the payload's digest and size,
    where the payload isn't at hand."""
    name_of, size = known or (digest(payload), len(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{name_of}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record as page_id, url, type, refers_to, payload (None for revisits), payload_bytes and payload_digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or len(block) != int(fields["Content-Length"]):
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    ident = lambda x: None if x is None or x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").rstrip(">"))
    if kind == "response" and digest(payload) != known:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    size = len(payload) if kind == "response" else int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": known,
    }


def url_key(url: Column) -> Column:
    """Reversed-host key: ``https://a.b.com/x?y`` becomes ``com,b,a)/x?y``."""
    host = F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[^:]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


PLACES = "url_key string, archive string, at long, size long"


def decided(pages: DataFrame, least: int) -> DataFrame:
    """A written table of (page_id, url, url_key, sha, bytes, refers_to, shared) of each page, without the html: refers_to
    for revisits, and whether a payload that counts comes more than once."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = written(pages.select("page_id", "url", url_key(F.col("url")).alias("url_key"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("bytes")), "digests")
    several = small.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    several = written(several, "payloads")
    known = small.where(F.col("bytes") >= least)
    shared = hot_join(known, several, ["sha"], "n").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    return written(shared.select("page_id", "url", "url_key", "sha", "bytes", "refers_to"), "shared")


def write(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write the archives; one row a record, with its key and place."""
    folder = fresh_dir(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    shared = decided(pages, least)
    revisits = shared.where("refers_to is not null")
    # a page is a revisit if its (page_id, sha) is in the list: what goes to the join is spread by page
    again = revisits.select(F.xxhash64("page_id").alias("_id"), F.col("sha").alias("_sha")).distinct()
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("url_key"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    responses = rows.join(again, (F.xxhash64("page_id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    empty = F.lit(None)
    tagged = responses.select("page_id", "url", "url_key", "payload", empty.cast("long").alias("refers_to"), empty.cast("string").alias("sha"), empty.cast("long").alias("bytes")).unionByName(
        revisits.select("page_id", "url", "url_key", empty.cast("binary").alias("payload"), "refers_to", "sha", "bytes")
    )

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            places = []
            for page_id, url, payload, refers_to, sha, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "sha", "bytes")), strict=True):
                if out is None:
                    path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                known = None if sha is None else (base64.b32encode(bytes.fromhex(sha)).decode(), size)
                data = gzipped(record(page_id, url, payload or b"", refers_to, known=known))
                out.write(data)
                places.append((f"{folder}/{path}", at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            archive, start, size = zip(*places, strict=True) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("url_key"), pa.array(archive, pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["url_key", "archive", "at", "size"])
        if out is not None:
            out.close()

    return written(tagged.mapInArrow(archives, PLACES), "captures", batches=TEXTS)


@dataclass
class Index:
    """files: one (path, first key, last key) an index file, sorted; the blocks and their directories are in the files."""

    files: list[tuple[str, str, str]]
    captures: int


def build(places: DataFrame) -> Index:
    folder = fresh_dir(places.sparkSession, "index")
    count = places.count()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}.idx"
        out, at, directory, held, last = None, 0, [], [], None

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = system.open_output_stream(opened(path)[1], compression=None)
            data = gzipped("\n".join(json.dumps(x) for x in held).encode())
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("url_key", "archive", "at", "size")), strict=True):
                held.append(line)
                last = line[0]
                if len(held) == BLOCK:
                    flush()
        if held:
            flush()
        if out is not None:
            foot = gzipped(json.dumps(directory).encode())
            out.write(foot + len(foot).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [directory[0][0]], "last": [last]})

    order = ["url_key", "archive", "at"]
    files = places.repartitionByRange(max(1, -(-count // INDEX_ROWS)), *order).sortWithinPartitions(*order).mapInArrow(runs, "path string, first string, last string")
    found = written(files, "index-files").collect()  # one row for INDEX_ROWS captures
    return Index(sorted(((r["path"], r["first"], r["last"]) for r in found), key=lambda x: (x[1].encode(), x[2].encode())), count)


def lookup(wanted: DataFrame, index: Index) -> DataFrame:
    """(url_key, archive, at, size) of every capture of the distinct keys of column ``url_key``."""
    files = index.files
    firsts, lasts = [x[1].encode() for x in files], [x[2].encode() for x in files]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The index files that may hold each key."""
        for batch in batches:
            keys = batch.column("url_key").to_pylist()
            found = [(k, key) for key in keys for k in range(bisect_left(lasts, key.encode()), bisect_right(firsts, key.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([key for _, key in found], pa.string())], ["file", "url_key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, open_, directory, keys, at_block, lines = None, -1, [], [], -1, {}
        for batch in batches:
            for k, key in zip(batch.column("file").to_pylist(), batch.column("url_key").to_pylist(), strict=True):
                code = key.encode()
                if k != open_:
                    system, path = opened(files[k][0])
                    stream = system.open_input_file(path)
                    end = stream.size()
                    foot = int.from_bytes(stream.read_at(8, end - 8), "little")
                    directory = json.loads(zlib.decompress(stream.read_at(foot, end - 8 - foot), wbits=31))
                    keys, at_block, open_ = [x[0].encode() for x in directory], -1, k
                for b in range(max(0, bisect_left(keys, code) - 1), bisect_right(keys, code)):
                    if b != at_block:  # keys come in order, so a block is read once
                        _, at, size = directory[b]
                        lines, at_block = {}, b
                        for line in zlib.decompress(stream.read_at(size, at), wbits=31).split(b"\n"):
                            x = json.loads(line)
                            lines.setdefault(x[0], []).append(x)
                    if key in lines:  # a block's captures at a time
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines[key], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["url_key", "archive", "at", "size"])

    parts = max(1, -(-index.captures // READ_ROWS))
    pairs = wanted.select("url_key").distinct().mapInArrow(places, "file int, url_key string")
    return pairs.repartitionByRange(parts, "file", "url_key").sortWithinPartitions("file", "url_key").mapInArrow(find, PLACES)


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read(places: DataFrame, captures: int, *, payloads: bool = True) -> DataFrame:
    """The records at the places (archive, at, size), read by ranges and checked against their digests."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, begin, held = None, None, 0, b""
        for batch in batches:
            out = []
            for archive, at, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "size")), strict=True):
                if archive != name:
                    system, path = opened(archive)
                    name, stream, begin, held = archive, system.open_input_file(path), 0, b""
                if not begin <= at <= at + size <= begin + len(held):
                    begin, held = at, stream.read_at(max(size, AHEAD), at)
                found = parse(zlib.decompress(held[at - begin : at - begin + size], wbits=31))
                out.append(found if payloads else found | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    parts = max(1, -(-captures // READ_ROWS))
    return places.repartitionByRange(parts, "archive", "at").sortWithinPartitions("archive", "at").mapInArrow(ranges, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

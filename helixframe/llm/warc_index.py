"""WARC archives with a two-level capture index.

Writing: each task writes records as gzip members into archive files of bounded size in the shared folder and gives
a capture row for each (key, file, offset, length). Of records with equal payloads of at least `LEAST_REVISIT` bytes the
one with the largest page id is the response, the others are revisits of it; owners come from a partial aggregation
by digest of ids only, and are few enough to be broadcast (their number is checked) or joined by a shuffle that splits hot
digests, so a third of all pages may be the same. Capture rows become a table first: a task that runs
again writes another file, and only files that the table names are ever read.

Index: captures sorted by their key (reversed host, path, then page id) are cut into blocks of `BLOCK_LINES` lines,
each block a gzip member; the sparse directory keeps a block's first and last key, file, offset and length. Lookup: a
sample of the directory (its root, bounded) is binary-searched for the directory segment; keys and directory rows of
a segment meet in one task in order, which holds the segment's rows and binary-searches them for each key; the block is
range-read and binary-searched, and the record itself is range-read and checked.

Null html is an empty payload, null urls have an empty host. Repeated rows give a record each (page ids needn't be
unique; equal ids and payloads beyond the first count as responses too). Very long pages are records like others. Control
characters of a URL are escaped in its key. Columns besides page_id, url and html are left out, so none can clash. An empty
table gives an empty result."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, shared_dir, small, written

LEAST_REVISIT, BLOCK_LINES, FILE_BYTES, ROOT_ROWS = 1000, 1000, 256 << 20, 20_000
#: Owners are broadcast up to so many rows (28 bytes each), and joined by a shuffle beyond.
BROADCAST_OWNERS = 200_000
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]")
_DEFAULT_PORT = {"http": "80", "https": "443"}


def _escaped(key: str) -> str:
    """key without characters that end a field or a line."""
    return _CONTROL.sub(lambda m: "".join(f"%{x:02X}" for x in m.group().encode()), key)


def surt(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, then port, path and query; without fragment, scheme and www."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host, port = (parts.hostname or "").lower().rstrip("."), parts.port
    except ValueError:
        return _escaped(")" + url.lower())
    host = re.sub(r"^www\d*\.", "", host)
    end = f":{port}" if port and str(port) != _DEFAULT_PORT.get(parts.scheme) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return _escaped(",".join(reversed(host.split("."))) + end + ")" + (parts.path or "/") + query)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The URL key and the page id, in an order that sorts ids of one URL by number."""
    return f"{surt(url)} {(page_id if page_id is not None else -1) + (1 << 63):020d}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit has no payload but keeps its size and digest."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return headers, rest[:n]


class _File:
    """A file of the shared folder that gzip members are appended to."""

    def __init__(self, uri: str) -> None:
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.at, self.out = uri, 0, system.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)


class Ranges:
    """Range reads of gzip members."""

    def __init__(self) -> None:
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            for f in self.open.values():
                f.close()
            self.open.clear()
            system, path = pafs.FileSystem.from_uri(uri)
            self.open[uri] = system.open_input_file(path)
        return zlib.decompress(self.open[uri].read_at(length, offset), 31)


CAPTURES = "key string, page_id long, url string, kind string, digest string, file string, offset long, length long"
_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages: page_id, url, html. Writes the archives below folder and gives the capture table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode(pages["html"], "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    owners = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    marked = rows.join(small(written(owners, f"{folder}/owners"), BROADCAST_OWNERS), "digest", "left")

    def write(batches):
        out: _File | None = None
        try:
            for batch in batches:
                found: list[tuple] = []
                for r in batch.to_pylist():
                    if out is None or out.at > file_bytes:
                        if out is not None:
                            out.out.close()
                        out = _File(f"{folder}/archives/{uuid.uuid4().hex}.warc.gz")
                    again = r["owner"] is not None and r["owner"] != r["page_id"] and len(r["payload"]) >= LEAST_REVISIT
                    kind = "revisit" if again else "response"
                    offset, length = out.add(record_bytes(r["page_id"], r["url"], r["payload"], kind, r["digest"], r["owner"]))
                    found.append((capture_key(r["url"], r["page_id"]), r["page_id"], r["url"], kind, r["digest"], out.uri, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_CAPTURES)], schema=_CAPTURES)
        finally:
            if out is not None:
                out.out.close()

    return written(marked.select("page_id", "url", "payload", "digest", "owner").mapInArrow(lean(write), CAPTURES), f"{folder}/captures")


DIRECTORY = "first string, last string, lines long, file string, offset long, length long"
_DIRECTORY = pa.schema([("first", pa.string()), ("last", pa.string()), ("lines", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted blocks below folder and gives the block directory."""

    def write(batches):
        out, lines = None, []
        done: list[tuple] = []

        def flush() -> None:
            nonlocal out
            out = out or _File(f"{folder}/index/{uuid.uuid4().hex}.cdx.gz")
            offset, length = out.add("".join(x[1] for x in lines).encode())
            done.append((lines[0][0], lines[-1][0], len(lines), out.uri, offset, length))
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                lines.append((r["key"], f"{r['key']}\t{r['file']}\t{r['offset']}\t{r['length']}\n"))
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(_DIRECTORY)], schema=_DIRECTORY)

    n = captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = captures.repartitionByRange(int(n), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(lean(write), DIRECTORY), f"{folder}/directory")


_PLACES = "key string, file string, offset long, length long"


def lookup(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """keys: column key. Gives key, file, offset, length of all captures with these keys."""
    blocks = directory.count()
    if not blocks:
        return keys.sparkSession.createDataFrame([], _PLACES)
    # the root: every so many-th first key, bounded whatever the number of blocks
    step = -(-blocks // ROOT_ROWS)
    firsts = directory.select("first").where(F.pmod(F.xxhash64("first"), F.lit(step)) == 0) if step > 1 else directory.select("first")
    root = sorted({r["first"] for r in firsts.collect()})

    def segments(batches):
        """Each key under its segment, and each block under every segment that it reaches into; blocks come first."""
        for batch in batches:
            at, own, kind = [], [], []
            for i, (key, last) in enumerate(zip(batch.column("key").to_pylist(), batch.column("last").to_pylist(), strict=True)):
                first = bisect_right(root, key)
                for segment in range(first, first + 1 if last is None else bisect_right(root, last) + 1):
                    at.append(i)
                    own.append(segment)
                    kind.append(int(last is None))
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(kind, pa.int32()), *columns], names=["segment", "kind", *batch.schema.names])

    def bisected(batches):
        segment, firsts, blocks = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["segment"] != segment:
                    segment, firsts, blocks = r["segment"], [], []
                if not r["kind"]:
                    firsts.append(r["key"])
                    blocks.append((r["last"], r["file"], r["offset"], r["length"]))
                    continue
                # captures of one key may fill several blocks, of which only the first begins before it
                at = bisect_left(firsts, r["key"])
                at = at - 1 if at and blocks[at - 1][0] >= r["key"] else at
                while at < len(blocks) and firsts[at] <= r["key"]:
                    out.append((r["key"], *blocks[at][1:]))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

    reach = directory.select(F.col("first").alias("key"), "last", "file", "offset", "length")
    wanted = keys.where("key IS NOT NULL").select("key").distinct().select("key", *[F.lit(None).cast(t).alias(c) for c, t in (("last", "string"), ("file", "string"), ("offset", "long"), ("length", "long"))])
    dealt = reach.union(wanted).mapInArrow(lean(segments), "segment long, kind int, key string, last string, file string, offset long, length long")
    met = dealt.repartition("segment").sortWithinPartitions("segment", "kind", "key", "last").mapInArrow(lean(bisected), _PLACES)

    def search(batches):
        ranges, place, lines, own_keys = Ranges(), None, [], []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if place != (r["file"], r["offset"]):
                    place = r["file"], r["offset"]
                    lines = ranges.read(r["file"], r["offset"], r["length"]).decode().split("\n")[:-1]
                    own_keys = [x.split("\t", 1)[0] for x in lines]
                at = bisect_left(own_keys, r["key"])
                while at < len(own_keys) and own_keys[at] == r["key"]:
                    _, file, offset, length = lines[at].split("\t")
                    out.append((r["key"], file, int(offset), int(length)))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

    # a key is searched once in each block, whatever segments the block reaches into
    places = met.distinct().repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return places.mapInArrow(lean(search), _PLACES)


RECORDS = "page_id long, url string, kind string, digest string, payload_bytes long, refers_to long, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(places: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Range-reads the records at (file, offset, length), checks responses against their digest, and parses them."""

    def read(batches):
        ranges = Ranges()
        for batch in batches:
            rows = batch.to_pylist()
            for first in range(0, len(rows), 500):
                out: list[tuple] = []
                for r in rows[first : first + 500]:
                    headers, payload = parse_record(ranges.read(r["file"], r["offset"], r["length"]))
                    kind, digest = headers["WARC-Type"], base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["X-Payload-Length"])):
                        raise ValueError(f"payload and digest differ at {r['file']}:{r['offset']}")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page")
                    out.append((int(page) if page else None, headers["WARC-Target-URI"], kind, digest, int(headers["X-Payload-Length"]), int(refers) if refers else None, payload if keep_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_RECORDS)], schema=_RECORDS)

    parts = places.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # ranges of (file, offset): neighbours stay together, and one large file is still dealt over many tasks
    ordered = places.repartitionByRange(int(parts), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(lean(read), RECORDS)


def keys_of(pages: DataFrame) -> DataFrame:
    """The capture keys of pages (page_id, url)."""

    def make(batches):
        for batch in batches:
            ids, urls = (batch.column(c).to_pylist() for c in ("page_id", "url"))
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for u, i in zip(urls, ids, strict=True)], pa.string())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(lean(make), "key string")


def archive_report(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes and indexes the pages, looks every page up in the index and reads its record back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or shared_dir(spark)
    pages = pages.select("page_id", "url", "html")
    directory = build_index(write_archives(pages, folder), folder)
    found = written(lookup(keys_of(pages), directory), f"{folder}/places")
    columns: list[Column] = [F.col("page_id"), F.col("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to")]
    return read_records(found, keep_payload=False).select(*columns)

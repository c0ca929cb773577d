"""Exact duplicates by Patricia-trie owners.

Texts are equal when identical after the white space of the contract is deleted. Each task puts the normalised byte
strings whole into a compressed radix trie; a terminal node holds the best row (most code points, then smallest id,
null ids last) and the number of rows. A trie whose strings and rows outgrow its budget spills its heaviest subtrees
downstream, about a quarter of it at a time, and the rest stays. What was spilled is dealt by length and content hash; the
tasks that own these parts meet them in order, insert them into tries of their own, and spill subtrees of finished parts
when over budget. So a text that a third of all rows repeat reaches its owner once or a few times for each task that
read it, and equal texts meet in one trie whatever their hashes.

Nulls count as empty texts; empty texts are equal to each other; very long texts are strings like others, larger than
the budget if need be. Of an empty table the result is empty. Rows that repeat the staying row whole, with its id, all say
kept = true in `dedup_report`; `owners` has one row a text, of equal rows with equal ids any one. Columns of any names are
carried in a struct."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import lean

SPACES = b" \t\n\x0b\x0c\r"
TRIE_MB = 64
#: Bytes that a node takes besides its label and value, about.
NODE_BYTES = 200
#: Shares of a trie's bytes: a spill frees the former, and looks for subtrees below any that holds more than the latter.
SPILL, WIDE = 0.25, 0.5


class PatriciaTrie:
    """A radix trie of byte strings; nodes are [label, children by first byte, terminal, bytes of the terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0]
        self.bytes = 0

    def add(self, key: bytes, value, merge, size: int = 0) -> None:
        """Inserts a value of so many bytes, or merges it with that of an equal key."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None, 0]
                self.bytes += len(key) - at + NODE_BYTES
            elif not key.startswith(child[0], at):
                cut = _agreeing(child[0], key, at)
                upper = [child[0][:cut], {child[0][cut]: child}, None, 0]
                child[0] = child[0][cut:]
                node[1][key[at]] = child = upper
                self.bytes += NODE_BYTES
            node, at = child, at + len(child[0])
        if node[2] is None:
            node[2], node[3] = value, size
        else:
            # either value may be what stays, so the larger size counts
            self.bytes -= node[3]
            node[2], node[3] = merge(node[2], value), max(node[3], size)
        self.bytes += node[3]

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Takes the heaviest subtrees out, until a good part of the trie is free, and gives their terminals."""
        weight = _weights(self.root)
        node, before, want = self.root, b"", SPILL * weight[id(self.root)]
        # where one subtree holds most, those below it are taken, so that its rest stays
        while node[1]:
            top = max(node[1].values(), key=lambda x: weight[id(x)])
            if weight[id(top)] <= WIDE * weight[id(self.root)] or not top[1]:
                break
            node, before = top, before + top[0]
        freed = 0
        for byte in sorted(node[1], key=lambda b: -weight[id(node[1][b])]):
            if freed >= want and freed:
                break
            child = node[1].pop(byte)
            freed += weight[id(child)]
            self.bytes -= weight[id(child)]
            yield from _terminals(child, before)
        if not freed and node[2] is not None:
            self.bytes -= node[3]
            value, node[2], node[3] = node[2], None, 0
            yield before, value

    def drain(self) -> Iterator[tuple[bytes, object]]:
        top, self.root, self.bytes = self.root, [b"", {}, None, 0], 0
        yield from _terminals(top, b"")


def _agreeing(label: bytes, key: bytes, at: int) -> int:
    """Length of the prefix that label shares with key from `at`; they differ somewhere or key ends."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _weights(top: list) -> dict[int, int]:
    """Bytes of the subtree below each node, by the node's id()."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node[1].values())
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = len(node[0]) + NODE_BYTES + node[3] + sum(out[id(x)] for x in node[1].values())
    return out


def _terminals(top: list, before: bytes) -> Iterator[tuple[bytes, object]]:
    todo = [(before, top)]
    while todo:
        prefix, node = todo.pop()
        key = prefix + node[0]
        if node[2] is not None:
            yield key, node[2]
        todo.extend((key, x) for x in node[1].values())


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def trie_part(norm: bytes) -> bytes:
    """Length and content hash: what the second tries are dealt by."""
    return struct.pack(">QQ", len(norm), xxhash.xxh3_64_intdigest(norm))


def _merge(a: tuple, b: tuple) -> tuple:
    """Values are (code points, id, rows, record); the record of the better one stays."""
    better = a if (-a[0], a[1] is None, a[1] if a[1] is not None else 0) <= (-b[0], b[1] is None, b[1] if b[1] is not None else 0) else b
    return better[0], better[1], a[2] + b[2], better[3]


def _size(value) -> int:
    """Bytes that a record takes in Python, about."""
    if isinstance(value, (str, bytes)):
        return len(value) + 56
    if isinstance(value, dict):
        return 100 + sum(_size(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return 60 + sum(map(_size, value))
    return 32


_OWN = [("part", T.BinaryType()), ("points", T.LongType()), ("rows", T.LongType()), ("id", T.LongType()), ("sha", T.StringType())]


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_mb: float = TRIE_MB) -> DataFrame:
    """One row for each distinct text: part, points (code points of the text that stays), rows (rows with this text),
    id, sha (SHA-256 of the normalised text) and record, a struct of all columns of the row that stays."""
    names = docs.columns
    plain = docs.select(F.struct(*[docs[c] for c in names]).alias("record"), docs[id_col].cast("long").alias("id"), F.coalesce(F.encode(docs[text_col], "UTF-8"), F.lit(b"")).alias("text"))
    partial = T.StructType([T.StructField(n, t) for n, t in _OWN] + [T.StructField("record", plain.schema["record"].dataType)])
    arrow = to_arrow_schema(partial)
    limit = int(trie_mb * (1 << 20))

    def packed(terminals, final: bool) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for key, (points, ident, count, record) in terminals:
            rows.append((trie_part(key), points, count, ident, hashlib.sha256(key).hexdigest() if final else None, record))
            size += len(key)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def combine(batches):
        trie = PatriciaTrie()
        for batch in batches:
            texts, ids, records = batch.column("text"), batch.column("id").to_pylist(), batch.column("record")
            for i, ident in enumerate(ids):
                text, record = texts[i].as_py(), records[i].as_py()
                trie.add(normal(text), (len(text.decode("utf-8", "replace")), ident, 1, record), _merge, _size(record))
                while trie.bytes > limit:
                    yield from packed(trie.spill(), False)
        yield from packed(trie.drain(), False)

    def own(batches):
        trie, part = PatriciaTrie(), None
        for batch in batches:
            parts, points, rows, ids = (batch.column(n).to_pylist() for n in ("part", "points", "rows", "id"))
            records = batch.column("record")
            for i, own_part in enumerate(parts):
                if own_part != part:
                    # all parts in the trie are complete, so any of its subtrees may go
                    while trie.bytes > limit:
                        yield from packed(trie.spill(), True)
                    part = own_part
                record = records[i].as_py()
                text = record[text_col]
                trie.add(normal(text.encode() if isinstance(text, str) else bytes(text or b"")), (points[i], ids[i], rows[i], record), _merge, _size(record))
        yield from packed(trie.drain(), True)

    first = plain.mapInArrow(lean(combine), partial)
    return first.repartition("part").sortWithinPartitions("part").mapInArrow(lean(own), partial)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_mb: float = TRIE_MB) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(F.encode(docs[text_col], "UTF-8"), F.lit(b"")).alias("text"))
    schema = "doc_id long, text_sha256 string, points long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def digest(batches):
        for batch in batches:
            shas, points = [], []
            for text in batch.column("text").to_pylist():
                shas.append(hashlib.sha256(normal(text)).hexdigest())
                points.append(len(text.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shas, pa.string()), pa.array(points, pa.int64())], schema=arrow)

    rows = narrow.mapInArrow(lean(digest), schema)
    best = owners(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text", trie_mb)
    best = best.select(F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), F.col("points").alias("best"), F.col("sha").alias("text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best"))
    return rows.join(best, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each distinct text: the owner, its columns as they were."""
    return owners(docs, id_col, text_col).select(*[F.col("record")[c].alias(c) for c in docs.columns])

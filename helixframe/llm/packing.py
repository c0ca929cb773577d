"""Best-fit packing with exact-complement hashing.

Documents become token ids and an end id; only those over the capacity are cut, into full pieces, with the shorter
piece first. What remains to pack is a histogram of at most `capacity` lengths, whatever the number of rows, so the
plan is made on the driver: longest first, gaps are filled exactly from an index of single, pair and triple sums of lengths
under their availability counts, each combination as often as counts allow; the residue goes best-fit. The plan is a list of
patterns with multiplicities, and for each length of runs (rank from, first sequence, offset). Pieces get their rank
among equal lengths from the task that made them and the counts of the tasks before, so no length is gathered
in one task.

A null or empty text is the end id alone, null ids stay null. Repeated rows are packed like others, and ties of equal
lengths go by task and place there; other columns are left out. An empty table gives an empty result. Texts may be of any
length. Token ids come from the vocabulary file (a parameter); when its merges are in rank order
the faster encoder over the same ranks is used, and texts that hold a special token go to the file's own tokenizer."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, pieces_of, text_buffer

CAPACITY = 2048
#: Ranks are broadcast up to so many rows of (task, length, first rank), of 24 bytes each, and joined by a shuffle beyond.
BROADCAST_RANKS = 500_000
# Fixed value: the public pre-tokenisation pattern of this byte-level vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of texts under a vocabulary file."""

    made: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model.get("added_tokens", ())]
        self.fast = _ranks_encoder(model)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.uint32)
            except ValueError:  # its regex engine gives up on extreme runs of spaces; the other one doesn't
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _ranks_encoder(model: dict):
    """An encoder over byte ranks where the vocabulary is byte-level BPE whose ids are in merge order."""
    bpe, pre = model["model"], model.get("pre_tokenizer") or {}
    if bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer"):
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, special = bpe["vocab"], {x["content"] for x in model.get("added_tokens", ())}
    for i, merge in enumerate(bpe["merges"]):
        if vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)] != 256 + i:
            return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, ids (if kept), task and rank, its place among the
    pieces of this length of that task."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
    sql = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    if keep_ids:
        fields, sql = [*fields, ("ids", pa.list_(pa.int32()))], sql + ", ids array<int>"
    schema = pa.schema(fields)

    def cut(batches):
        encoder, task, seen = Encoder.at(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ids_of, (data, offsets) = batch.column(0).to_pylist(), text_buffer(batch.column(1))
            raw = data.tobytes()
            for first, end, _, _ in pieces_of(data, offsets, 2 << 20):
                rows: list[tuple] = []
                for i in range(first, end):
                    ids = np.append(encoder.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                    n, at, k = len(ids), 0, 0
                    while at < n:
                        length = (n - 1) % capacity + 1 if at == 0 else capacity
                        own = ids[at : at + length]
                        rows.append((ids_of[i], k, at, length, zlib.crc32(own.tobytes()), task, seen[length], *([own.astype(np.int32)] if keep_ids else [])))
                        seen[length] += 1
                        at, k = at + length, k + 1
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.encode(docs["text"], "UTF-8"), F.lit(b""))).mapInArrow(lean(cut), sql)


@dataclass
class Plan:
    """For each length its runs: rank from which a run holds, its first sequence, its offset there."""

    starts: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int


class Complements:
    """Index of single, pair and triple sums of the available lengths, by sum.

    Counts only ever fall while exact fills are taken, so a combination that isn't available never comes back: the pairs
    of a sum are a list that is passed once, from the most even pair to the most uneven, and the triples of a sum are
    its largest members, each with the index entry of the rest, passed once likewise."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self._pair: dict[int, int] = {}
        self._triple: dict[int, int] = {}

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to the gap, the largest first."""
        if gap == 0:
            return ()
        return (gap,) if self.left[gap] else self.pair(gap) or self.triple(gap)

    def pair(self, total: int) -> tuple[int, int] | None:
        low = self._pair.get(total, total // 2)
        while low > 0 and not (self.left[low] and self.left[total - low] and (2 * low != total or self.left[low] > 1)):
            low -= 1
        self._pair[total] = low
        return (total - low, low) if low > 0 else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        top = self._triple.get(total, total - 2)
        found = None
        while top > 0 and found is None:
            found = self._pair_beside(total - top, top) if self.left[top] else None
            top -= found is None
        self._triple[total] = top
        return (top, *found) if found else None

    def _pair_beside(self, total: int, other: int) -> tuple[int, int] | None:
        """The first pair of a sum that is available together with another length."""
        first = self.pair(total)
        for low in range(first[1] if first else 0, 0, -1):
            items = (total - low, low, other)
            if all(self.left[x] >= items.count(x) for x in items):
                return items[:2]
        return None


def patterns_of(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Multisets of lengths with how many sequences hold them; together they use the histogram up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    left = left.tolist()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in items:
            need[x] += 1
        times = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        out.append((items, times))

    index = Complements(left)
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            found = index.fill(capacity - longest)
            left[longest] += 1
            if found is None:
                break
            take((longest, *found))
    # best fit of the residue, longest first, a whole run of equal lengths at a time
    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            gap = next((g for g in range(length, capacity + 1) if open_by_gap[g]), None)
            if gap is None:
                each = capacity // length
                if n >= each:
                    open_by_gap[capacity - each * length].append(((length,) * each, n // each))
                    n %= each
                else:
                    open_by_gap[capacity - n * length].append(((length,) * n, 1))
                    n = 0
                continue
            items, times = open_by_gap[gap].pop()
            now = min(n, times)
            if times > now:
                open_by_gap[gap].append((items, times - now))
            open_by_gap[gap - length].append(((*items, length), now))
            n -= now
    return out + [x for runs in open_by_gap.values() for x in runs]


def plan_of(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    total = 0
    for items, times in patterns_of(histogram, capacity):
        at = 0
        for x in items:
            runs[x].append((used[x], total, at))
            used[x] += times
            at += x
        total += times
    columns = [{x: np.array([r[i] for r in own], np.int64) for x, own in runs.items()} for i in range(3)]
    return Plan(*columns, total)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    work = Workspace(docs.sparkSession)
    table = work.kept(pieces(docs, vocabulary, capacity, end_id, keep_ids))
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = work.kept(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_of(histogram, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    sql = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "global"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, begins = np.unique(lengths[order], return_index=True)
            for x, rows in zip(values, np.split(order, begins[1:]), strict=True):
                run = np.searchsorted(plan.starts[int(x)], ranks[rows], "right") - 1
                sequence[rows] = plan.sequence[int(x)][run] + ranks[rows] - plan.starts[int(x)][run]
                offset[rows] = plan.offset[int(x)][run]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    few = firsts.count() <= BROADCAST_RANKS
    firsts = firsts.select("task", "length", "first")
    ranked = table.join(F.broadcast(firsts) if few else firsts.hint("merge"), ["task", "length"]).withColumn("global", F.col("first") + F.col("rank"))
    return ranked.select(*names, "global").mapInArrow(lean(place), sql)

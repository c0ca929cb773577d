"""Exact k-mer counting and joining by runs of k-mers that share a minimizer.

A k-mer's bucket depends on the least hashed m-letter word of it and of its reverse complement, so neighbours mostly share
one. Runs of them are shuffled as 2-bit packed letters with the read, place and length once a run, about two bytes a k-mer
instead of some thirty. All occurrences of a k-mer meet in one bucket, where they are counted, held against the band, and
paired, so neither occurrences nor k-mers are shuffled or written as rows. A bucket holds about half a million places of the
input, however large it is; of a k-mer above the band only as many occurrences stay in memory as show that."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import OverlapParams
from .kmers import _BASES, _CHUNK, _SCHEMA, OCCURRENCES, _buffer, _words

_FLUSH, _HELD, _PLACES, _ROWS, _MET, _SEEDS = 1 << 22, 1 << 21, 1 << 19, 1 << 17, 1 << 20, 1 << 20
_DEALT = "bucket int, runs long, bytes int, data binary"
_DEALT_SCHEMA = pa.schema([("bucket", pa.int32()), ("runs", pa.int64()), ("bytes", pa.int32()), ("data", pa.binary())])
COUNTS = "v long, h long, shared long"
_COUNTS = pa.schema([("v", pa.int64()), ("h", pa.int64()), ("shared", pa.int64())])
ESTIMATES = "v long, h long, seeds long, forward long, least long, most long"
_ESTIMATES = pa.schema([(c.split()[0], pa.int64()) for c in ESTIMATES.split(", ")])


@dataclass
class Entries:
    """Occurrences, by column; at: twice the place plus whether the word is canonical as it stands."""

    kmer: np.ndarray
    read: np.ndarray
    at: np.ndarray
    length: np.ndarray

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(self.kmer[rows], self.read[rows], self.at[rows], self.length[rows])

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return parts[0] if len(parts) == 1 else Entries(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("kmer", "read", "at", "length")))


def supported(params: OverlapParams) -> bool:
    """Whether the mode takes all positions as they stand; minimizers and syncmers are few, and take the plain way."""
    return not (params.window or params.syncmers or params.hopc)


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _order(*columns: np.ndarray) -> np.ndarray:
    """The rows' order by the columns, packed into one number with the row where that fits, which sorts several times as fast."""
    n, key, bits = len(columns[0]), None, 0
    if not n:
        return np.zeros(0, np.int64)
    for c in columns:
        low, width = int(c.min()), (int(c.max()) - int(c.min())).bit_length()
        if key is not None and bits + width > 62:
            key, bits = np.unique(key, return_inverse=True)[1], n.bit_length()
        if bits + width > 62:
            return np.lexsort(columns[::-1])
        own = c.astype(np.int64) - low
        key, bits = own if key is None else key << width | own, bits + width
    row = n.bit_length()
    return np.sort(key << row | np.arange(n)) & ((1 << row) - 1) if bits + row <= 62 else np.argsort(key, kind="stable")


def _runs(data: np.ndarray, offsets: np.ndarray, k: int, buckets: int, n_as_g: bool) -> tuple[np.ndarray, ...]:
    """First place, k-mers, bucket and read of each run, and the letters' codes."""
    bases = _BASES[data]
    if n_as_g:
        bases = np.where((data == 78) | (data == 110), 2, bases).astype(np.uint8)
    n, m = len(data) - k + 1, k if k < 12 else 9
    bad = np.concatenate([[0], np.cumsum(bases > 3, dtype=np.int32)])
    read = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    good = (read[:n] == read[k - 1 :]) & (bad[k:] == bad[:n])
    bases &= 3
    ahead, back = _words(bases, m, np.uint32)
    low = np.minimum(ahead, back) * np.uint32(0x9E3779B1)
    left, size = k - m, 1
    while left:
        step = min(size, left)
        low = np.minimum(low[:-step], low[step:])
        left, size = left - step, size + step
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(12)
    bucket = (low % np.uint32(buckets)).astype(np.int32)
    change = np.ones(n + 1, bool)
    change[1:n] = (bucket[1:] != bucket[:-1]) | (good[1:] != good[:-1]) | (read[1:n] != read[: n - 1])
    edges = np.flatnonzero(change)
    first, count = edges[:-1], np.diff(edges)
    keep = good[first]
    first, count = first[keep], count[keep]
    return first, count, bucket[first], read[first], bases


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    shift = first - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else first
    return np.repeat(shift, sizes) + np.arange(int(sizes.sum()))


def _planes(values: np.ndarray, dtype: type) -> bytes:
    v = np.ascontiguousarray(values, dtype)
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _unplaned(data: np.ndarray, n: int, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(-1, n).T).view(dtype).reshape(n)


def _dealt_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _DEALT_SCHEMA, strict=True)], schema=_DEALT_SCHEMA)


def deal(reads: DataFrame, params: OverlapParams, buckets: int, lengths: bool = True, only: int | None = None) -> DataFrame:
    """The reads' runs of k-mers, packed by bucket; without lengths these and the places in reads are 0. only: the one
    bucket that is wanted. reads: read_id, seq."""
    k, n_as_g = params.k, params.n_policy == "as_g"

    def run(batches):
        codec, held, letters = pa.Codec("zstd", compression_level=1), [], 0
        for batch in batches:
            ids = batch.column("read_id").to_numpy(zero_copy_only=False)
            data, offsets = _buffer(batch.column("seq"))
            first = 0
            while first < len(ids):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
                part, own = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
                if len(part) >= k:
                    at, count, bucket, read, bases = _runs(part, own, k, buckets, n_as_g)
                    if only is not None:
                        at, count, bucket, read = (c[bucket == only] for c in (at, count, bucket, read))
                    if len(at):
                        size, place = (np.diff(own)[read], at - own[:-1][read]) if lengths else (np.zeros(len(read)), np.zeros(len(read)))
                        held.append(((at + letters).astype(np.int32), count.astype(np.int32), bucket, ids[first:end][read], place.astype(np.int32), size.astype(np.int32), bases))
                        letters += len(bases)
                first = end
                if letters >= _FLUSH:
                    yield from _dealt_rows(_packed(held, codec))
                    held, letters = [], 0
        if held:
            yield from _dealt_rows(_packed(held, codec))

    def _packed(held, codec) -> Iterator[tuple]:
        at, count, bucket, read, place, length, bases = (np.concatenate(c) for c in zip(*held, strict=True))
        order = _order(bucket)
        at, count, bucket, read, place, length = (c[order] for c in (at, count, bucket, read, place, length))
        begin = _groups(bucket)
        for i, j in zip(begin, [*begin[1:], len(bucket)], strict=True):
            letters = bases[_spans(at[i:j], count[i:j] + k - 1)]
            letters = np.concatenate([letters, np.zeros(-len(letters) % 4, np.uint8)]).reshape(-1, 4)
            packed = letters[:, 0] << 6 | letters[:, 1] << 4 | letters[:, 2] << 2 | letters[:, 3]
            body = _planes(np.diff(read[i:j], prepend=0), np.int64) + b"".join(_planes(c[i:j], np.int32) for c in (place, count, length)) + packed.tobytes()
            yield int(bucket[i]), int(j - i), len(body), codec.compress(body, asbytes=True)

    plain = reads.select(F.col("read_id").cast("long"), F.coalesce(F.encode("seq", "US-ASCII"), F.lit(b"")).alias("seq"))
    return plain.mapInArrow(run, _DEALT)


def _opened(runs: int, size: int, data: bytes, k: int, codec: pa.Codec) -> Entries:
    raw = np.frombuffer(codec.decompress(data, size), np.uint8)
    read = np.cumsum(_unplaned(raw[: 8 * runs], runs, np.int64))
    place, count, length = (_unplaned(raw[(8 + 4 * i) * runs : (12 + 4 * i) * runs], runs, np.int32) for i in range(3))
    packed = raw[20 * runs :]
    bases = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()
    sizes = count.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + k - 1)[:-1]])
    forward, backward = _words(bases, k, np.int64)
    rows = _spans(first, sizes)
    forward, backward = forward[rows], backward[rows]
    at = _spans(place.astype(np.int64), sizes) * 2 + (forward <= backward)
    return Entries(np.minimum(forward, backward) + (np.int64(1) << (2 * k)), np.repeat(read, sizes), at, np.repeat(length, sizes))


def _compacted(e: Entries, upper: int) -> Entries:
    """The entries without those of a k-mer beyond upper + 1, which are enough to show that it is above the band."""
    e = e.take(_order(e.kmer))
    begin = _groups(e.kmer)
    rank = np.arange(len(e.kmer)) - np.repeat(begin, np.diff(begin, append=len(e.kmer)))
    return e.take(rank <= upper)


def in_band(e: Entries, lower: int, upper: int) -> Entries:
    """The last place in each read of k-mers whose total occurrences lie in the band, by k-mer and read."""
    order = _order(e.kmer)
    kmer = e.kmer[order]
    sizes = np.diff(_groups(kmer), append=len(kmer))
    kept = e.take(order[np.repeat((sizes >= lower) & (sizes <= upper), sizes)])
    kept = kept.take(_order(kept.kmer, kept.read, kept.at))
    begin = _groups(kept.kmer, kept.read)
    if not len(begin):
        return kept
    length = np.maximum.reduceat(kept.length, begin)
    last = kept.take(np.append(begin[1:], len(kept.kmer)) - 1)
    return Entries(last.kmer, last.read, last.at, length)


def _met(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of entries of one k-mer, the lesser read first."""
    left, right, d = [], [], 1
    rows = np.arange(len(e.kmer))
    while d < len(e.kmer):
        rows = rows[: len(e.kmer) - d] if d == 1 else rows[rows < len(e.kmer) - d]
        rows = rows[e.kmer[rows] == e.kmer[rows + d]]
        if not len(rows):
            break
        left.append(rows)
        right.append(rows + d)
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _batches(columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _ROWS], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _matrix_rows(buckets: Iterator[Entries]) -> Iterator[pa.RecordBatch]:
    for e in buckets:
        yield from _batches([e.read, e.kmer, e.at >> 1, (e.at & 1).astype(bool), e.length], _SCHEMA)


def _chunks(buckets: Iterator[Entries], columns: Callable[[Entries], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of the pairs of several buckets at a time, by v and h, those of two reads beside one another."""
    held, n = [], 0
    for e in itertools.chain(buckets, [None]):
        if e is not None:
            held.append(columns(e))
            n += len(held[-1][0])
        if n and (e is None or n >= _MET):
            found = [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
            order = _order(found[0], found[1])
            yield [c[order] for c in found]


def _packed_pairs(columns: list[np.ndarray], parts: int, codec: pa.Codec) -> Iterator[tuple]:
    """Rows of v, h and numbers, which are sorted by v and h, packed by what v hashes to."""
    of = _part(columns[0], parts)
    order = _order(of)
    of, columns = of[order], [c[order] for c in columns]
    begin = _groups(of)
    for i, j in zip(begin, [*begin[1:], len(of)], strict=True):
        body = _planes(np.diff(columns[0][i:j], prepend=0), np.int64) + _planes(columns[1][i:j], np.int64) + b"".join(_planes(c[i:j], np.int32) for c in columns[2:])
        yield int(of[i]), int(j - i), len(body), codec.compress(body, asbytes=True)


def _part(v: np.ndarray, parts: int) -> np.ndarray:
    mixed = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _opened_pairs(n: int, size: int, data: bytes, numbers: int, codec: pa.Codec) -> list[np.ndarray]:
    raw = np.frombuffer(codec.decompress(data, size), np.uint8)
    return [np.cumsum(_unplaned(raw[: 8 * n], n, np.int64)), _unplaned(raw[8 * n : 16 * n], n, np.int64), *(_unplaned(raw[(16 + 4 * i) * n : (20 + 4 * i) * n], n, np.int32) for i in range(numbers))]


# What a task's buckets give to pairs, by v and h, and what a pair's rows of all tasks come to.


def _counts(buckets: Iterator[Entries], k: int) -> Iterator[list[np.ndarray]]:
    for v, h in _chunks(buckets, lambda e: [e.read[x] for x in _met(e)]):
        begin = _groups(v, h)
        yield [v[begin], h[begin], np.diff(begin, append=len(v))]


def _summed(v, h, n) -> Iterator[pa.RecordBatch]:
    begin = _groups(v, h)
    yield from _batches([v[begin], h[begin], np.add.reduceat(n.astype(np.int64), begin)], _COUNTS)


def _placed(e: Entries) -> list[np.ndarray]:
    x, y = _met(e)
    return [e.read[x], e.read[y], e.length[x], e.length[y], e.at[x] >> 1, e.at[y] >> 1, (e.at[x] & 1) == (e.at[y] & 1)]


def seed_overlaps(pos_v: np.ndarray, len_v: np.ndarray | int, pos_h: np.ndarray, len_h: np.ndarray | int, forward: np.ndarray, k: int) -> np.ndarray:
    """functions.seq.seed_overlap over arrays."""
    begin = np.where(forward, pos_h, len_h - pos_h - k)
    return np.minimum(begin, pos_v) + np.minimum(len_h - begin - k, len_v - pos_v - k) + k


def _estimates(buckets: Iterator[Entries], k: int) -> Iterator[list[np.ndarray]]:
    for v, h, len_v, len_h, pos_v, pos_h, forward in _chunks(buckets, _placed):
        ov, begin = seed_overlaps(pos_v, len_v, pos_h, len_h, forward, k), _groups(v, h)
        least = np.minimum.reduceat(ov, begin)
        yield [v[begin], h[begin], np.diff(begin, append=len(v)), np.add.reduceat(forward.astype(np.int64), begin), least, np.maximum.reduceat(ov, begin) - least]


def _estimated(v, h, n, forward, least, more) -> Iterator[pa.RecordBatch]:
    begin = _groups(v, h)
    sums = [np.add.reduceat(c.astype(np.int64), begin) for c in (n, forward)]
    yield from _batches([v[begin], h[begin], *sums, np.minimum.reduceat(least, begin), np.maximum.reduceat(least + more, begin)], _ESTIMATES)


def _diagonals(buckets: Iterator[Entries], k: int) -> Iterator[list[np.ndarray]]:
    """Seeds that follow one another diagonally as one row: lengths, the first's place in v, twice that in h plus whether
    they are on one strand, and how many they are."""
    for v, h, len_v, len_h, pos_v, pos_h, forward in _chunks(buckets, _placed):
        diagonal = np.where(forward, pos_h - pos_v, pos_h + pos_v)
        order = _order(v, h, forward.astype(np.int64), diagonal, pos_v)
        v, h, len_v, len_h, pos_v, pos_h, forward, diagonal = (c[order] for c in (v, h, len_v, len_h, pos_v, pos_h, forward, diagonal))
        begin = _groups(v, h, forward, diagonal, pos_v - np.arange(len(v)))
        yield [v[begin], h[begin], len_v[begin], len_h[begin], pos_v[begin], pos_h[begin] * 2 + forward[begin], np.diff(begin, append=len(v))]


def _seeds_of_pairs(k: int, v, h, len_v, len_h, pos_v, pos_h, size) -> Iterator[tuple[np.ndarray, ...]]:
    """Some pairs at a time: v, h, both lengths and where the seeds of each begin, and the seeds' pos_v, pos_h and overlaps, in
    the order of places in a pair."""
    begin = _groups(v, h)
    # so many seeds at a time, as two long copies share thousands; a pair has some bytes of its own
    weight = np.cumsum(np.add.reduceat(size.astype(np.int64), begin) + 128) if len(begin) else begin
    cuts = np.unique(np.searchsorted(weight, np.arange(_SEEDS, weight[-1], _SEEDS), "right")) if len(begin) else []
    for some in np.split(begin, cuts):
        if not len(some):
            continue
        i, after = int(some[0]), np.searchsorted(begin, some[-1], "right")
        j = int(begin[after]) if after < len(begin) else len(v)
        n, heads = size[i:j].astype(np.int64), some - i
        step, forward = _spans(np.zeros(j - i, np.int64), n), np.repeat(pos_h[i:j] & 1, n) == 1
        at_v, at_h = np.repeat(pos_v[i:j], n) + step, np.repeat(pos_h[i:j] >> 1, n) + np.where(forward, step, -step)
        seeds, most = np.add.reduceat(n, heads), [np.maximum.reduceat(c[i:j], heads) for c in (len_v, len_h)]
        ov = seed_overlaps(at_v, np.repeat(most[0], seeds), at_h, np.repeat(most[1], seeds), forward, k)
        order = _order(np.repeat(np.arange(len(some)), seeds), at_v, at_h)
        yield v[some], h[some], *most, np.concatenate([[0], np.cumsum(seeds)[:-1]]), at_v[order], at_h[order], ov[order]


def _dealt(reads: DataFrame, params: OverlapParams, lengths: bool) -> tuple[DataFrame, int, int]:
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    letters = reads.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
    dealt = deal(reads, params, max(4 * parts, letters // _PLACES), lengths)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket"), parts, max(parts, letters // (8 * _PLACES))


def _buckets(batches: Iterator[pa.RecordBatch], params: OverlapParams) -> Iterator[Entries]:
    """The entries in the band, bucket by bucket."""
    codec, held, n, most, now = pa.Codec("zstd"), [], 0, _HELD, None
    for b, runs, size, data in _rows_of(batches):
        if b != now and held:
            yield in_band(Entries.joined(held), params.lower, params.upper)
            held, n, most = [], 0, _HELD
        now = b
        held.append(_opened(runs, size, data, params.k, codec))
        n += len(held[-1].kmer)
        if n > most:
            held = [_compacted(Entries.joined(held), params.upper)]
            n = len(held[0].kmer)
            most = max(most, 2 * n)
    if held:
        yield in_band(Entries.joined(held), params.lower, params.upper)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in ("bucket", "runs", "bytes", "data"))


def reduced(reads: DataFrame, params: OverlapParams) -> DataFrame:
    """The matrix of the reads' reliable k-mers, as matrix.occurrence_matrix gives it."""
    return _dealt(reads, params, True)[0].mapInArrow(lambda batches: _matrix_rows(_buckets(batches, params)), OCCURRENCES)


def reduced_pairs(reads: DataFrame, params: OverlapParams, kind: str, entries: bool = False) -> DataFrame:
    """One row a pair of reads that share reliable k-mers: `counts`, how many, or `estimates`, also how many are on one
    strand and the bounds of the overlaps that they imply. entries: rows without reads, in the place of shared the
    matrix's entries of a task."""
    give, take, numbers, schema = {"counts": (_counts, _summed, 1, COUNTS), "estimates": (_estimates, _estimated, 4, ESTIMATES)}[kind]
    return _pairs(reads, params, give, take, numbers, schema, kind != "counts", entries)


def folded_pairs(reads: DataFrame, params: OverlapParams, fold: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What fold makes of the columns that _seeds_of_pairs gives."""

    def take(*columns) -> Iterator[pa.RecordBatch]:
        for some in _seeds_of_pairs(params.k, *columns):
            yield fold(*some)

    return _pairs(reads, params, _diagonals, take, 5, schema, True, False)


def sampled(reads: DataFrame, params: OverlapParams) -> DataFrame:
    """The part of `reduced` in one of 4,096 buckets, exact there."""
    one = deal(reads, params, 4096, only=0).repartition(1, "bucket")
    return one.mapInArrow(lambda batches: _matrix_rows(_buckets(batches, params)), OCCURRENCES)


def _pairs(reads: DataFrame, params: OverlapParams, give, take, numbers: int, schema: str, lengths: bool, entries: bool) -> DataFrame:
    dealt, tasks, parts = _dealt(reads, params, lengths)

    def out(batches):
        codec, n = pa.Codec("zstd", compression_level=1), 0

        def counted() -> Iterator[Entries]:
            nonlocal n
            for e in _buckets(batches, params):
                n += len(e.kmer)
                yield e

        def rows() -> Iterator[tuple]:
            for columns in give(counted(), params.k):
                yield from _packed_pairs(columns, parts, codec)
            if entries:
                yield -1, n, 0, b""

        yield from _dealt_rows(rows())

    def back(batches):
        codec = pa.Codec("zstd")
        for b, some in itertools.groupby(_rows_of(batches), lambda r: r[0]):
            if b < 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([None], [None], [sum(r[1] for r in some)])], schema=_COUNTS)
                continue
            columns = [np.concatenate(c) for c in zip(*(_opened_pairs(*r[1:], numbers, codec) for r in some), strict=True)]
            order = _order(columns[0], columns[1])
            yield from take(*(c[order] for c in columns))

    return dealt.mapInArrow(out, _DEALT).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(back, schema)

"""k-mers of reads: extraction, minimizers, syncmers, counts, the reliable band and cardinality.

Sequences are packed 2 bits a base in NumPy over Arrow batches, whole batches at a time, so a shuffled k-mer is one
long. Codes have a leading one bit (see functions.seq.encode_kmer)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import OverlapParams
from ..functions.seq import ORDER_FACTOR, ORDER_MODULUS

_BASES = np.full(256, 4, np.uint8)
for _code, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _BASES[list(_letters)] = _code
OCCURRENCES = "read_id long, kmer long, pos int, forward boolean, length int"
_SCHEMA = pa.schema([("read_id", pa.int64()), ("kmer", pa.int64()), ("pos", pa.int32()), ("forward", pa.bool_()), ("length", pa.int32())])
_CHUNK = 1 << 20
EMPTY_BAND = "no k-mer is reliable; widen the band"


def order_keys(codes: np.ndarray) -> np.ndarray:
    return codes % ORDER_MODULUS * ORDER_FACTOR % ORDER_MODULUS


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(bases: np.ndarray, k: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed letters of all k-letter windows and of their reverse complements, joined from windows of powers of two."""
    power, back, size = bases.astype(dtype), 3 - bases.astype(dtype), 1
    forward = backward = None
    done = 0
    while True:
        if k & size:
            if forward is None:
                forward, backward = power, back
            else:
                n = len(bases) - done - size + 1
                forward, backward = (forward[:n] << dtype(2 * size)) + power[done : done + n], (back[done : done + n] << dtype(2 * done)) + backward[:n]
            done += size
        if done == k:
            return forward, backward
        n = len(power) - size
        power, back = (power[:n] << dtype(2 * size)) + power[size:], (back[size:] << dtype(2 * size)) + back[:n]
        size *= 2


def _strands(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all k-letter windows and of their reverse complements."""
    forward, backward = _words(bases, k, np.int64)
    return forward + (np.int64(1) << (2 * k)), backward + (np.int64(1) << (2 * k))


def _compressed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with each run of a base as one base, the lesser of both strands, and whether it is the one as it stands."""
    forward = np.full(len(codes), 1, np.int64)
    backward, length = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    before = np.full(len(codes), -1, np.int64)
    for j in reversed(range(k)):
        base = (codes >> (2 * j)) & 3
        new = base != before
        forward = np.where(new, forward * 4 + base, forward)
        backward = np.where(new, backward + ((3 - base) << (2 * length)), backward)
        length += new
        before = base
    backward += np.int64(1) << (2 * length)
    return np.minimum(forward, backward), forward <= backward


def _minimizers(keys: np.ndarray, read_of: np.ndarray, begin: np.ndarray, count: np.ndarray, w: int, compat: bool) -> np.ndarray:
    """Places of the window minima, each once; the leftmost of equal keys. A read with fewer k-mers than the window
    is one window. compat: windows start after the first w k-mers, which are never chosen."""
    if compat:
        chosen = []
        for b, n in zip(begin, count, strict=True):
            own = keys[b : b + n]
            last = -1
            for i in range(w, n):
                low = max(w, i - w + 1)
                at = low + int(np.argmin(own[low : i + 1]))
                if at != last:
                    chosen.append(b + at)
                    last = at
        return np.array(chosen, np.int64)
    found = []
    if len(keys) >= w:
        views = np.lib.stride_tricks.sliding_window_view(keys, w)
        whole = np.flatnonzero(read_of[w - 1 :] == read_of[: len(keys) - w + 1])
        for i in range(0, len(whole), _CHUNK):
            part = whole[i : i + _CHUNK]
            found.append(part + views[part].argmin(axis=1))
    found += [np.array([b + int(np.argmin(keys[b : b + n]))]) for b, n in zip(begin, count, strict=True) if 0 < n < w]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _syncmers(codes: np.ndarray, k: int, s: int) -> np.ndarray:
    """Whether no inner s-letter word is strictly before both end words in the order."""
    mask = (np.int64(1) << (2 * s)) - 1
    words = [order_keys((codes >> (2 * (k - s - i))) & mask) for i in range(k - s + 1)]
    if k - s < 2:
        return np.ones(len(codes), bool)
    inner = np.minimum.reduce(words[1:-1])
    return ~((inner < words[0]) & (inner < words[-1]))


def kmer_occurrences(reads: DataFrame, params: OverlapParams = OverlapParams(), lookup: bool = False) -> DataFrame:
    """(read_id, kmer, pos, forward, length) of every k-mer that the mode takes: all positions, minimizers or syncmers.
    forward: whether the word as it stands is the canonical one, so that two places are on one strand iff it is the same for
    both, and no sequence has to be met again for that. length: the read's. reads: read_id, seq. Reads shorter than k have none, null sequences count as empty. lookup: with compat syncmers, all canonical
    positions, as they are looked up; else counting and lookup take the same words."""
    k, p = params.k, params

    def extract(batches):
        for batch in batches:
            ids = batch.column("read_id").to_numpy(zero_copy_only=False)
            data, offsets = _buffer(batch.column("seq"))
            first = 0
            while first < len(ids):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
                own = offsets[first : end + 1] - offsets[first]
                yield from _of(ids[first:end], data[offsets[first] : offsets[end]], own)
                first = end

    def _of(ids, data, offsets):
        if len(data) < k:
            return
        bases = _BASES[data]
        if p.n_policy == "as_g":
            bases = np.where((data == 78) | (data == 110), 2, bases).astype(np.uint8)
        bad = np.concatenate([[0], np.cumsum(bases > 3)])
        n = len(data) - k + 1
        read = np.repeat(np.arange(len(ids)), np.diff(offsets))
        good = (read[:n] == read[k - 1 :]) & (bad[k:] == bad[:n])
        forward, backward = _strands(bases, k)
        at = np.flatnonzero(good)
        codes, read, ahead = np.minimum(forward, backward)[at], read[at], (forward <= backward)[at]
        if p.syncmers:
            raw = p.compat and not lookup
            if not (p.compat and lookup):
                tested = forward[at] if raw else codes
                keep = _syncmers(tested, k, p.smer)
                codes, read, at, ahead = tested[keep], read[keep], at[keep], ahead[keep]
        elif p.window:
            count = np.bincount(read, minlength=len(ids))
            begin = np.concatenate([[0], np.cumsum(count)])[:-1]
            keys = order_keys(codes)
            keep = _minimizers(keys, read, begin, count, p.window, p.compat)
            codes, read, at, ahead = codes[keep], read[keep], at[keep], ahead[keep]
        elif p.hopc:
            codes, ahead = _compressed(forward[at], k)
        pos = at - offsets[:-1][read]
        sizes = np.diff(offsets).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[read], pa.int64()), pa.array(codes), pa.array(pos.astype(np.int32)), pa.array(ahead), pa.array(sizes[read])], schema=_SCHEMA)

    plain = reads.select(F.col("read_id").cast("long"), F.coalesce(F.encode("seq", "US-ASCII"), F.lit(b"")).alias("seq"))
    return plain.mapInArrow(extract, OCCURRENCES)


def kmer_counts(occurrences: DataFrame) -> DataFrame:
    """(kmer, cnt): exact total occurrences."""
    return occurrences.groupBy("kmer").agg(F.count("*").alias("cnt"))


def reliable(counts: DataFrame, lower: int, upper: int) -> DataFrame:
    """The k-mers whose total occurrences lie in the band."""
    return counts.where(F.col("cnt").between(lower, upper))


def require_reliable(counts: DataFrame) -> DataFrame:
    """The same table, or an error if it is empty."""
    if counts.isEmpty():
        raise ValueError(EMPTY_BAND)
    return counts


def approximate_distinct(occurrences: DataFrame, log2_registers: int = 12) -> DataFrame:
    """One row: distinct k-mers by a HyperLogLog sketch."""
    return occurrences.agg(F.hll_sketch_estimate(F.hll_sketch_agg("kmer", log2_registers)).alias("distinct_kmers"))


def count_partitions(occurrences: DataFrame, splits: int) -> DataFrame:
    """Each k-mer's hash partition, as counting in rounds takes them; shuffles do this by themselves."""
    return occurrences.withColumn("split", F.pmod(F.xxhash64("kmer"), F.lit(splits)))

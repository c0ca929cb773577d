"""Candidate pairs of reads: the triangular k-mer join, seeds, bins of overlap estimates and the chosen seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import OverlapParams
from ..functions.seq import seed_overlap
from .kmers import kmer_counts, kmer_occurrences, reliable, require_reliable
from .matrix import occurrence_matrix
from .superkmers import folded_pairs, reduced, reduced_pairs, sampled, supported
from .tables import cut


def matrix_of(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """(read_id, kmer, pos, forward, length) over reliable k-mers. Where the mode takes all positions, runs of k-mers meet
    by minimizers; else words are taken from the reads once, written, then counted and looked up."""
    if supported(params):
        return reduced(reads, params)
    occurrences = cut(kmer_occurrences(reads, params))
    band = cut(reliable(kmer_counts(occurrences), params.lower, params.upper))
    looked_up = kmer_occurrences(reads, params, lookup=True) if params.syncmers and params.compat else occurrences
    return occurrence_matrix(looked_up, band)


def reliable_matrix(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """matrix_of, written; an error if no k-mer is reliable."""
    return require_reliable(cut(matrix_of(reads, params)))


def candidates_of(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """candidate_pairs of the reads' matrix; a task's k-mers of a pair are summed before the shuffle."""
    return reduced_pairs(reads, params, "counts") if supported(params) else candidate_pairs(matrix_of(reads, params))


def estimates_of(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """(v, h, seeds, forward, least, most): a pair's seeds, those on one strand, and the bounds of their estimates."""
    if supported(params):
        return reduced_pairs(reads, params, "estimates")
    table = seed_table(shared_seeds(matrix_of(reads, params)), params.k)
    return table.groupBy("v", "h").agg(F.count("*").alias("seeds"), F.count_if("forward").alias("forward"), F.min("ov").cast("long").alias("least"), F.max("ov").cast("long").alias("most"))


def chosen_of(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """chosen_seeds of the reads' seeds, with the reads' lengths; only runs of seeds are shuffled."""
    if not supported(params):
        seeds = seed_table(shared_seeds(matrix_of(reads, params)), params.k)
        lengths = reads.select("read_id", F.length("seq").alias("n"))
        side = lambda x: lengths.select(F.col("read_id").alias(x), F.col("n").alias(f"len_{x}"))
        return chosen_seeds(seeds, params).join(side("v"), "v").join(side("h"), "h")

    def fold(*found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(_chosen_columns(*found, params), _MEASURED, strict=True)], schema=_MEASURED)

    return folded_pairs(reads, params, fold, f"{CHOSEN}, len_v int, len_h int")


def shared_seeds(matrix: DataFrame) -> DataFrame:
    """(v, h, kmer, pos_v, pos_h, forward, len_v, len_h) of every k-mer that two reads share, v < h. forward: whether both
    places are on one strand. The band bounds a k-mer's rows to upper * (upper - 1) / 2, so no k-mer is hot here."""
    side = lambda x: matrix.select("kmer", F.col("read_id").alias(x), F.col("pos").alias(f"pos_{x}"), F.col("forward").alias(f"forward_{x}"), F.col("length").alias(f"len_{x}"))
    met = side("v").join(side("h"), "kmer").where("v < h")
    return met.select("v", "h", "kmer", "pos_v", "pos_h", (F.col("forward_v") == F.col("forward_h")).alias("forward"), "len_v", "len_h")


def candidate_pairs(matrix: DataFrame) -> DataFrame:
    """(v, h, shared): the pairs with the number of k-mers they share."""
    return shared_seeds(matrix).groupBy("v", "h").agg(F.count("*").alias("shared"))


def seed_table(seeds: DataFrame, k: int) -> DataFrame:
    """Seeds with the overlap that each implies, from places, strands and lengths alone."""
    ov = seed_overlap(F.col("pos_v"), F.col("len_v"), F.col("pos_h"), F.col("len_h"), F.col("forward"), k)
    return seeds.select("v", "h", "kmer", "pos_v", "pos_h", "len_v", "len_h", "forward", ov.alias("ov"))


def fold_bins(seeds: list[tuple[int, int, int]], bin_width: int, k: int) -> tuple[int, list[dict]]:
    """Folds seeds (pos_v, pos_h, ov) in ascending order into bins; gives the folded count and the bins, newest first.

    A new seed opens a bin. Each bin before whose estimate is less than bin_width away gives it those of its seeds that
    lie over k apart from the new one in both reads, each of which adds to support and to the count, and ends; the
    others stay behind it."""
    count, bins = 0, []
    for v, h, ov in sorted(seeds):
        new = {"ov": ov, "support": 1, "seeds": [(v, h)]}
        rest = []
        count += 1
        for old in bins:
            if abs(old["ov"] - ov) < bin_width:
                taken = [s for s in old["seeds"] if abs(s[0] - v) > k and abs(s[1] - h) > k]
                new["seeds"] += taken
                new["support"] += len(taken)
                count += len(taken)
            else:
                rest.append(old)
        bins = [new, *rest]
    return count, bins


def best_bin(bins: list[dict]) -> dict:
    """The bin of most support, the first of equals."""
    return max(bins, key=lambda b: b["support"])


CHOSEN = "v long, h long, shared long, count long, bins int, support long, ov long, pos_v int, pos_h int"
_CHOSEN = pa.schema([("v", pa.int64()), ("h", pa.int64()), ("shared", pa.int64()), ("count", pa.int64()), ("bins", pa.int32()), ("support", pa.int64()), ("ov", pa.int64()), ("pos_v", pa.int32()), ("pos_h", pa.int32())])
_MEASURED = pa.schema([*_CHOSEN, ("len_v", pa.int32()), ("len_h", pa.int32())])


def _chosen_row(v: int, h: int, found: list[tuple[int, int, int]], params: OverlapParams) -> tuple:
    if len(found) == 1:
        return v, h, 1, 1, 1, 1, found[0][2], *found[0][:2]
    count, bins = fold_bins(found, params.bin_width, params.k)
    best = best_bin(bins)
    return v, h, len(found), count, len(bins), best["support"], best["ov"], *best["seeds"][0]


def _chosen_columns(v, h, len_v, len_h, begin, pos_v, pos_h, ov, params: OverlapParams) -> list[np.ndarray]:
    """_chosen_row of many pairs, with their lengths, from seeds in the order of places. Where each seed joins the bin before
    and lies within k of the last one, it alone stays in it, so such pairs, which are most, need no fold: one bin of the last."""
    n = np.diff(begin, append=len(pos_v))
    joins = (np.abs(np.diff(ov)) < params.bin_width) & ((np.abs(np.diff(pos_v)) <= params.k) | (np.abs(np.diff(pos_h)) <= params.k))
    apart = np.concatenate([[False], ~joins])
    apart[begin] = False
    last, one = begin + n - 1, np.ones(len(n), np.int64)
    out = [v, h, n, n.copy(), one, one.copy(), *(c[last].astype(np.int64) for c in (ov, pos_v, pos_h))]
    for i in np.flatnonzero(np.logical_or.reduceat(apart, begin)).tolist():
        a, b = int(begin[i]), int(last[i]) + 1
        row = _chosen_row(int(v[i]), int(h[i]), list(zip(pos_v[a:b].tolist(), pos_h[a:b].tolist(), ov[a:b].tolist(), strict=True)), params)
        for column, x in zip(out[2:], row[2:], strict=True):
            column[i] = x
    return [*out, len_v, len_h]


def some_reliable(reads: DataFrame, params: OverlapParams) -> bool:
    """Whether any k-mer is reliable; a small part of all mostly shows it."""
    return supported(params) and not sampled(reads, params).isEmpty() or not matrix_of(reads, params).isEmpty()


def chosen_seeds(seeds: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """One row a pair: shared k-mers, the folded count, bins, and support, estimate and first seed of the best bin.
    seeds: v, h, pos_v, pos_h, ov. A pair's seeds are at most the shorter read's length, so a group fits a task; the
    fold's order is that of the positions, whatever the order of arrival."""

    def fold(batches):
        for batch in batches:
            rows = []
            for v, h, own in zip(*(batch.column(c).to_pylist() for c in ("v", "h", "seeds")), strict=True):
                rows.append(_chosen_row(v, h, [(s["pos_v"], s["pos_h"], s["ov"]) for s in own], params))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHOSEN)], schema=_CHOSEN)

    grouped = seeds.groupBy("v", "h").agg(F.collect_list(F.struct("pos_v", "pos_h", "ov")).alias("seeds"))
    return grouped.mapInArrow(fold, CHOSEN)


def product_statistics(matrix: DataFrame) -> DataFrame:
    """One row: nnz of the matrix, join rows of the triangular product, distinct pairs and their ratio."""
    return _statistics(candidate_pairs(matrix), matrix.select(F.lit(1).alias("entry")))


def statistics_of(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """product_statistics of the reads' matrix, which is not written where runs meet by minimizers."""
    if not supported(params):
        return product_statistics(reliable_matrix(reads, params))
    found = reduced_pairs(reads, params, "counts", entries=True)
    own = F.col("v").isNotNull()
    return _ratio(found.agg(F.coalesce(F.sum(F.when(~own, F.col("shared"))), F.lit(0)).alias("nnz"), F.coalesce(F.sum(F.when(own, F.col("shared"))), F.lit(0)).alias("flops"), F.count_if(own).alias("nnz_output")))


def _statistics(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    both = pairs.select(F.col("shared"), F.lit(1).alias("pair"), F.lit(0).alias("entry")).union(entries.select(F.lit(0).cast("long"), F.lit(0), "entry"))
    return _ratio(both.agg(F.sum("entry").alias("nnz"), F.coalesce(F.sum("shared"), F.lit(0)).alias("flops"), F.sum("pair").alias("nnz_output")))


def _ratio(sums: DataFrame) -> DataFrame:
    return sums.select("nnz", "flops", "nnz_output", F.round(F.try_divide(F.col("flops"), F.col("nnz_output")), 6).alias("compression"))

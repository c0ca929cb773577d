"""Scalar functions on sequences, k-mers, seeds and overlaps, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def reverse_complement(s: Column | str) -> Column:
    """Reverse complement; letters other than ACGT stay."""
    return F.reverse(F.translate(_c(s), "ACGT", "TGCA"))


def canonical(s: Column | str) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(_c(s), reverse_complement(s))


def homopolymer_compressed(s: Column | str) -> Column:
    """Each run of a letter as one letter; the result has a length of its own."""
    return F.regexp_replace(_c(s), r"(.)\1+", "$1")


def encode_kmer(s: Column | str) -> Column:
    """2-bit code below a leading one bit, so words of different lengths differ and words of one length sort as text."""
    return F.conv(F.concat(F.lit("1"), F.translate(F.upper(_c(s)), "ACGT", "0123")), 4, 10).cast("long")


def decode_kmer(code: Column | str) -> Column:
    return F.translate(F.substr(F.conv(_c(code).cast("string"), 10, 4), F.lit(2)), "0123", "ACGT")


def kmer_bits(code: Column | str, k: int) -> Column:
    """The 2-bit code of a word as 64 binary digits, left aligned."""
    return F.rpad(F.lpad(F.substr(F.conv(_c(code).cast("string"), 10, 2), F.lit(2)), 2 * k, "0"), 64, "0")


def kmer_hash(x: Column | str) -> Column:
    """A 64-bit hash for distribution."""
    return F.xxhash64(_c(x))


#: Modulus and factor of the order of k-mers: a multiplicative congruential step, the same arithmetic in any engine.
ORDER_MODULUS, ORDER_FACTOR = 2147483647, 48271


def order_key(code: Column | str) -> Column:
    """Position of a k-mer code in the pseudo-random order that minimizers and syncmers use; ties by the code."""
    return F.pmod(F.pmod(_c(code), F.lit(ORDER_MODULUS)) * ORDER_FACTOR, F.lit(ORDER_MODULUS))


def slope(error_rate: float) -> float:
    """Expected score of an overlapping base: p - (1 - p) with p = (1 - error)**2."""
    return 2 * (1 - error_rate) ** 2 - 1


def slope_column(error_rate: Column | str) -> Column:
    return 2 * F.pow(1 - _c(error_rate), F.lit(2.0)) - 1


def phred_error(quality: Column | str) -> Column:
    """Error probability of the first character of a Phred+33 string."""
    return F.pow(F.lit(10.0), -(F.ascii(_c(quality)) - 33) / F.lit(10.0))


def same_strand(seq_a: Column, pos_a: Column, seq_b: Column, pos_b: Column, k: int) -> Column:
    """Whether the seed's words are equal as they stand."""
    return F.substr(seq_a, pos_a + 1, F.lit(k)) == F.substr(seq_b, pos_b + 1, F.lit(k))


def flipped_begin(begin: Column | str, length: Column | str, k: int) -> Column:
    """A seed's begin on the other strand."""
    return _c(length) - _c(begin) - k


def seed_overlap(beg_v: Column, len_v: Column, beg_h: Column, len_h: Column, forward: Column, k: int) -> Column:
    """Overlap length that one seed implies."""
    b = F.when(forward, beg_h).otherwise(flipped_begin(beg_h, len_h, k))
    return F.least(b, beg_v) + F.least(len_h - (b + k), len_v - (beg_v + k)) + k


def span_overlap(beg_v, end_v, len_v, beg_h, end_h, len_h) -> Column:
    """Overlap length that an alignment implies: the shorter overhang on each side and the mean span."""
    beg_v, end_v, len_v, beg_h, end_h, len_h = map(_c, (beg_v, end_v, len_v, beg_h, end_h, len_h))
    half = F.floor(((end_v - beg_v) + (end_h - beg_h)) / 2).cast("long")
    return F.least(beg_v, beg_h) + F.least(len_v - end_v, len_h - end_h) + half


def flipped_span(begin: Column | str, end: Column | str, length: Column | str) -> tuple[Column, Column]:
    """A span on the other strand."""
    return _c(length) - _c(end), _c(length) - _c(begin)


def far_apart(h1: Column, v1: Column, h2: Column, v2: Column, k: int) -> Column:
    """Whether two seeds lie over k apart in both sequences."""
    return (F.abs(h1 - h2) > k) & (F.abs(v1 - v2) > k)


def divergence(kmers: Column | str, norm: Column | str, size: int = 17) -> Column:
    return F.log(1 / (_c(kmers) / _c(norm))) / size


def identity_score(overlap: Column | str, error_rate: float = 0.15) -> Column:
    return F.floor(F.lit((1 - error_rate) * (1 - error_rate)) * _c(overlap)).cast("long")


def percent_score(identity: Column | str, overlap: Column | str) -> Column:
    return F.floor(_c(identity) * _c(overlap) / 100).cast("long")


def strand_sign(forward: Column) -> Column:
    return F.when(forward, "+").otherwise("-")


def mapq_from_probability(p: Column | str) -> Column:
    """Mapping quality of an error probability: 0 gives 254, the most; values outside [0, 1] are an error."""
    p = _c(p)
    good = F.when(p == 0, 254).otherwise(F.least(F.lit(254), F.round(-10 * F.log10(p)).cast("int")))
    return F.when((p < 0) | (p > 1) | F.isnan(p), F.raise_error(F.lit("bad probability"))).otherwise(good).cast("int")


def mod_power_of_two(x: Column | str, power: int) -> Column:
    return F.pmod(_c(x), F.lit(1 << power))


def div_power_of_two(x: Column | str, power: int) -> Column:
    return F.shiftright(_c(x), power)


def strictly_between(x: Column | str, low: Column, high: Column) -> Column:
    return (_c(x) > low) & (_c(x) < high)


def nearly_equal(a: Column | str, b: Column | str, tolerance: float = 1e-3) -> Column:
    """Within the tolerance absolutely or relatively to the larger."""
    a, b = _c(a), _c(b)
    gap = F.abs(a - b)
    return (gap < tolerance) | (gap < tolerance * F.greatest(F.abs(a), F.abs(b)))


def reliable_bounds(coverage: int, error_rate: float, k: int, least: float) -> tuple[int, int]:
    """(lower, upper) multiplicities of a k-mer that is correct in binomially many of `coverage` reads: from the top and
    from two upwards, as many terms as it takes to gather the probability `least`, or until a term adds nothing."""
    p = (1 - error_rate) ** k

    def term(m: int) -> float:
        return math.comb(coverage, m) * p**m * (1 - p) ** (coverage - m) if 0 <= m <= coverage else 0.0

    def walk(m: int, step: int) -> int:
        total = 0.0
        while total < least:
            more = total + term(m)
            if more == total and total > 0 or not 0 <= m <= coverage:
                return m + step
            total, m = more, m + step
        return m

    return max(walk(2, 1) - 1, 2), walk(coverage, -1) + 1

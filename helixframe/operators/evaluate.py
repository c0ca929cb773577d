"""Ground truth from intervals, and recall, precision and F1 of overlapper outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import span_overlap

MIN_OVERLAP = 2000


def _span(a: str, b: str):
    return F.least(f"{a}_stop", f"{b}_stop") - F.greatest(f"{a}_start", f"{b}_start")


def interval_pairs(intervals: DataFrame, min_overlap: int = MIN_OVERLAP, bin_width: int | None = None) -> DataFrame:
    """(a, b, overlap): ordered pairs of different reads, both directions, whose intervals on one ref share at least
    min_overlap; of several placements the largest overlap stays. intervals: ref, read, start, stop.

    Intervals are dealt into bins of their ref and joined by (ref, bin). A pair is taken only in the bin where its
    overlap begins, so nothing is found twice; intervals shorter than min_overlap are left out before the join."""
    if bin_width is None:
        bin_width = max(1, int(intervals.agg(F.coalesce(F.percentile_approx(F.col("stop") - F.col("start"), 0.9), F.lit(1))).first()[0]))
    long = intervals.where(F.col("stop") - F.col("start") >= max(min_overlap, 0))
    binned = long.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.greatest(F.col("stop"), F.col("start")) / bin_width))))
    side = lambda x: binned.select("ref", "bin", F.col("read").alias(x), F.col("start").alias(f"{x}_start"), F.col("stop").alias(f"{x}_stop"))
    begin = F.floor(F.greatest("a_start", "b_start") / bin_width)
    met = side("a").join(side("b"), ["ref", "bin"]).where((F.col("a") != F.col("b")) & (F.col("bin") == begin) & (_span("a", "b") >= min_overlap))
    return met.groupBy("a", "b").agg(F.max(F.greatest(_span("a", "b"), F.lit(0))).cast("long").alias("overlap"))


def contained(intervals: DataFrame, queries: DataFrame, bin_width: int = 10_000) -> DataFrame:
    """(query, read): intervals that lie inside a query's interval on the same ref. queries: query, ref, start, stop."""
    side = queries.select("query", "ref", F.col("start").alias("q_start"), F.col("stop").alias("q_stop"), F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("stop") / bin_width))).alias("bin"))
    own = intervals.withColumn("bin", F.floor(F.col("start") / bin_width))
    return own.join(side, ["ref", "bin"]).where("start >= q_start AND stop <= q_stop").select("query", "read")


def best_reference_overlap(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """pairs (a, b) with `truth`: the largest overlap of any two placements of the reads on one ref, 0 without one."""
    side = lambda x: intervals.select(F.col("read").alias(x), F.col("ref").alias(f"{x}_ref"), F.col("start").alias(f"{x}_start"), F.col("stop").alias(f"{x}_stop"))
    names = pairs.select("a", "b").distinct()
    met = names.join(side("a"), "a").join(side("b"), "b").where("a_ref = b_ref")
    best = met.groupBy("a", "b").agg(F.max(F.greatest(_span("a", "b"), F.lit(0))).cast("long").alias("truth"))
    return names.join(best, ["a", "b"], "left").fillna(0, ["truth"])


def kept_pairs(pairs: DataFrame, min_overlap: int = MIN_OVERLAP, keep_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of different reads with enough overlap, each (a, b) once, and the short ones."""
    real = pairs.where("a <> b")
    if keep_all:
        return real.dropDuplicates(["a", "b"]), real.limit(0)
    return real.where(F.col("overlap") >= min_overlap).dropDuplicates(["a", "b"]), real.where(F.col("overlap") < min_overlap)


def filtered_by_overlap(found: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """Rows whose spans imply at least this overlap."""
    return found.where(span_overlap("beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h") >= least)


def scores(predicted: DataFrame, expected: DataFrame, lists_both: bool = True) -> DataFrame:
    """One row: recall, precision and f1 in percent, with the counts. A tool that lists each pair once is counted
    twice for recall when `lists_both`, as the truth has both directions."""
    p, g = predicted.select("a", "b").distinct(), expected.select("a", "b").distinct()
    # one aggregation over both sets instead of a join and two counts
    both = p.withColumn("side", F.lit(1)).union(g.withColumn("side", F.lit(2))).groupBy("a", "b").agg(F.sum("side").alias("side"))
    n = both.agg(F.count_if(F.col("side") == 3).alias("true"), F.count_if(F.col("side") != 2).alias("predicted"), F.count_if(F.col("side") != 1).alias("expected"))
    recall = F.try_divide(F.lit(2 if lists_both else 1) * F.col("true"), F.col("expected")) * 100
    precision = F.try_divide(F.col("true"), F.col("predicted")) * 100
    out = n.withColumns({"recall": F.coalesce(recall, F.lit(0.0)), "precision": F.coalesce(precision, F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))
    return out.select("true", "predicted", "expected", F.round("recall", 2).alias("recall"), F.round("precision", 2).alias("precision"), F.round(f1, 2).alias("f1"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def pair_differences(x: DataFrame, y: DataFrame) -> DataFrame:
    """(side, a, b): what either multiset of pairs, in both directions, has more than the other."""
    s, t = symmetric(x), symmetric(y)
    return s.exceptAll(t).withColumn("side", F.lit("left")).union(t.exceptAll(s).withColumn("side", F.lit("right"))).select("side", "a", "b")


def placement_scores(found: DataFrame, intervals: DataFrame, min_overlap: int = MIN_OVERLAP, doubled: bool = False) -> DataFrame:
    """The older evaluation: found has line_no, a, b and overlap (the estimate). A pair is true if any placements
    overlap enough; a pair that isn't counts as predicted iff its last line's estimate is enough. Expected are all
    interval pairs. doubled: the tool lists pairs once."""
    last = found.where("a <> b").groupBy("a", "b").agg(F.max_by("overlap", "line_no").alias("overlap"))
    state = last.join(best_reference_overlap(last, intervals), ["a", "b"])
    true = F.col("truth") >= min_overlap
    # all three counts in one aggregation
    counted = state.select(true.cast("long").alias("true"), (true | (F.col("overlap") >= min_overlap)).cast("long").alias("predicted"), F.lit(0).cast("long").alias("expected"))
    zero = F.lit(0).cast("long")
    n = counted.union(interval_pairs(intervals, min_overlap).select(zero, zero, F.lit(1).cast("long"))).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true", "predicted", "expected")])
    factor = 2 if doubled else 1
    return n.select("true", "predicted", "expected", F.round(F.coalesce(F.try_divide(F.lit(factor) * F.col("true"), F.col("expected")) * 100, F.lit(0.0)), 2).alias("recall"), F.round(F.coalesce(F.try_divide(F.col("true"), F.col("predicted")) * 100, F.lit(0.0)), 2).alias("precision"))

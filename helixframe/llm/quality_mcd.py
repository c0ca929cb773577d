"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each text gives counts (words, their code points, symbols, repeated lines, words in repeated 3-word windows). Their
logarithmic rates form a vector. For each language and source the subset of h rows is sought whose covariance has the least
determinant. Three starts are tried side by side, all around the medians: the absolute deviations alone, the
correlations of spatial signs, and those of hyperbolic tangents. From each, concentration steps (mean and covariance of the
h rows nearest under the estimate before) go on until no determinant falls any more; each step can only lower it. The start
with the least determinant stays (the least of all subsets where outliers stand clear, else the least that the starts reach), its covariance is corrected for the missing tail, and the mean and covariance of all rows
within the 0.975 quantile give the final estimate, corrected likewise. A document whose squared Mahalanobis distance lies
beyond the chi-square quantile is rejected.

Everything is summed over all rows by partial aggregation, so a source with a third of all rows is never gathered in a
task; only one row of moments for each group and start is handled in Python. The h-th distance is exact up to 10,000 rows a
group and off by a ten-thousandth of its rows at most beyond (the error of percentile_approx at its accuracy); rows tied
with it are all in. Determinants are those of the floored covariance, so a statistic that hardly varies can't make a
subset look tight.

Groups of fewer than `least_rows` rows are pooled with the other small groups of their language, and those of small
languages with each other; a pool that is still smaller rejects nothing. Null and empty texts have no words and fail
the base rules; very long texts count like others. Null languages and sources are groups of their own. Repeated rows count
each, and are judged alike. Columns of any names are carried in a struct. An empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, mix, per_value, pieces_of, small, text_buffer, trim, word_bounds, word_hashes

U64 = np.uint64
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = "struct<" + ",".join(f"{n}:long" for n in STATS) + ">"
#: Standard deviation that each transformed statistic has at least: log word length, then the three log rates. At 0.5 a
#: rate alone rejects from 17 of 100 words on in a group that has none.
FLOORS = (0.05, 0.5, 0.5, 0.5)
D = len(FLOORS)
#: Chi-square quantile with 4 degrees of freedom at 1 - 1e-6.
CUTOFF = 33.4
H_SHARE, MOST_STEPS, LEAST_ROWS, BROADCAST_GROUPS = 0.75, 50, 200, 20_000
STARTS = 3
#: Chi-square quantile with 4 degrees of freedom at 0.975, within which rows count for the final estimate.
REWEIGHT = 11.143
#: A determinant that falls by less than this share has stopped falling.
SETTLED = 1e-7


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The five counts of every text; no nulls."""
    data, offsets = text_buffer(column)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out: list[list[np.ndarray]] = [[] for _ in STATS]
    for _, _, part, off in pieces_of(data, offsets):
        starts, ends, first = word_bounds(part, off)
        words = np.diff(first)
        bytes_in = np.concatenate([[0], np.cumsum(ends - starts)])
        tails = (part & 0xC0) == 0x80
        raw = part.tobytes()
        hashes = word_hashes(part, starts, ends)
        covered = np.zeros(len(starts), np.int64)
        if len(starts) > 2:
            text_of = np.repeat(np.arange(len(words)), words)
            whole = text_of[2:] == text_of[:-2]
            key = mix(hashes[:-2] + mix(hashes[1:-1] + mix(hashes[2:] + text_of[2:].astype(U64))))[whole]
            ordered = np.sort(key)
            again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            at = np.flatnonzero(whole)[np.isin(key, again)]
            for k in range(3):
                covered[at + k] = 1
        repeated = np.concatenate([[0], np.cumsum(covered)])
        for values, x in zip(out, (words, bytes_in[first[1:]] - bytes_in[first[:-1]] - per_value(tails, off), per_value(symbol[part], off), np.array([_dup_lines(raw[off[i] : off[i + 1]]) for i in range(len(words))], np.int64), repeated[first[1:]] - repeated[first[:-1]]), strict=True):
            values.append(x.astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _stats(texts: pa.Array) -> pa.Array:
    counts = text_counts(texts)
    trim()
    return pa.StructArray.from_arrays([pa.array(x) for x in counts], names=list(STATS))


def stats_of(text: Column) -> Column:
    return F.arrow_udf(_stats, STATS_TYPE)(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """The transformed statistics; defined where there are words."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [F.log(F.greatest(s["word_chars"], F.lit(1)) / n), *(F.log(1 + 100 * s[c] / n) for c in STATS[2:])]


def floored(cov: np.ndarray, floors: tuple = FLOORS) -> np.ndarray:
    """cov with variances, in units of the floors' squares, of at least one in every direction."""
    values, axes = np.linalg.eigh(cov / np.outer(floors, floors))
    return (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floors, floors)


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def consistency(share: float) -> float:
    """What the covariance of the innermost share of normal rows must be multiplied by."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, D) < share else (low, middle)
    return share / chi_square(low, D + 2)


_TRIANGLE = [(i, j) for i in range(D) for j in range(i, D)]
_PARAMS = "gid long, start int, centre array<double>, inverse array<double>, det double"
_PARAMS_ARROW = pa.schema([("gid", pa.int64()), ("start", pa.int32()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("det", pa.float64())])


def _row(gid: int, start: int, centre: np.ndarray, cov: np.ndarray, factor: float, floors: tuple) -> dict:
    solid = floored(cov * factor, floors)
    inverse = np.linalg.inv(solid)
    return {"gid": gid, "start": start, "centre": list(map(float, centre)), "inverse": [float(inverse[i, j] * (1 + (i != j))) for i, j in _TRIANGLE], "det": float(np.linalg.det(solid))}


def _square(upper: list[float]) -> np.ndarray:
    out = np.zeros((D, D))
    for (i, j), x in zip(_TRIANGLE, upper, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _estimated(moments: DataFrame, factor: float, floors: tuple) -> DataFrame:
    """Rows of moments (n, sums, sums of products) as estimates."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                centre = np.array(r["s"]) / r["n"]
                rows.append(_row(r["gid"], r["start"], centre, _square(r["ss"]) / r["n"] - np.outer(centre, centre), factor, floors))
            yield pa.RecordBatch.from_pylist(rows, schema=_PARAMS_ARROW)

    return moments.mapInArrow(lean(run), _PARAMS)


def _moments(rows: DataFrame, x: Column) -> DataFrame:
    return rows.groupBy("gid", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(D)]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in _TRIANGLE]).alias("ss"))


def distance(x: Column, prefix: str = "") -> Column:
    """Squared Mahalanobis distance of array x under columns centre and inverse (with a prefix)."""
    d = [x[i] - F.col(f"{prefix}centre")[i] for i in range(D)]
    return sum((d[i] * d[j] * F.col(f"{prefix}inverse")[k] for k, (i, j) in enumerate(_TRIANGLE)), F.lit(0.0))


def _starts(work: Workspace, rows: DataFrame, least_rows: int, few: bool, floors: tuple) -> DataFrame:
    """The estimates that concentration starts from."""
    near = F.broadcast if few else (lambda df: df)
    x = F.col("x")
    middle = work.written(rows.groupBy("gid").agg(F.count("*").alias("n"), F.array(*[F.percentile_approx(x[i], 0.5, 10_000) for i in range(D)]).alias("m")).where(F.col("n") >= least_rows))
    off = rows.join(near(middle.select("gid", "m")), "gid")
    spread = off.groupBy("gid").agg(F.array(*[F.percentile_approx(F.abs(x[i] - F.col("m")[i]), 0.5, 10_000) for i in range(D)]).alias("d"))
    scale = F.array(*[F.greatest(1.4826 * F.col("d")[i], F.lit(floors[i])) for i in range(D)])
    scales = work.written(middle.join(spread, "gid").select("gid", "m", scale.alias("scale")))
    z = F.transform(F.arrays_zip(x, F.col("m"), F.col("scale")), lambda t: (t["x"] - t["m"]) / t["scale"])
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b))
    scaled = rows.join(near(scales), "gid").select("gid", z.alias("z")).select("gid", "z", length.alias("length"))
    sign = F.when(F.col("length") > 0, F.transform("z", lambda v: v / F.col("length"))).otherwise(F.col("z"))
    both = scaled.select("gid", F.explode(F.array(F.struct(F.lit(1).alias("start"), sign.alias("y")), F.struct(F.lit(2).alias("start"), F.transform("z", F.tanh).alias("y")))).alias("e")).select("gid", "e.*")
    moments = _moments(both, F.col("y")).join(scales, "gid")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                wide = np.array(r["scale"])
                cov = _square(r["ss"]) / r["n"]
                if r["start"] == 2:
                    mean = np.array(r["s"]) / r["n"]
                    cov = cov - np.outer(mean, mean)
                    out.append(_row(r["gid"], 0, r["m"], np.diag(wide**2), 1.0, floors))
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                out.append(_row(r["gid"], r["start"], r["m"], cov / np.outer(sd, sd) * np.outer(wide, wide), 1.0, floors))
            yield pa.RecordBatch.from_pylist(out, schema=_PARAMS_ARROW)

    return work.written(moments.mapInArrow(lean(run), _PARAMS))


def estimates(work: Workspace, rows: DataFrame, few: bool, least_rows: int = LEAST_ROWS, h_share: float = H_SHARE, floors: tuple = FLOORS) -> tuple[DataFrame, DataFrame]:
    """rows: a written table of gid and x (array). Gives the raw estimate of each group, its subset's mean and
    (uncorrected) floored covariance, and the reweighted one, as gid, centre, inverse and det."""
    near = F.broadcast if few else (lambda df: df)
    x = F.col("x")
    params = _starts(work, rows, least_rows, few, floors)
    for step in range(MOST_STEPS):
        far = rows.join(near(params.drop("det")), "gid").select("gid", "start", "x", distance(x).alias("d"))
        limits = work.written(far.groupBy("gid", "start").agg(F.percentile_approx("d", h_share, 10_000).alias("limit")))
        nearest = far.join(near(limits), ["gid", "start"]).where("d <= limit")
        new = work.written(_estimated(_moments(nearest, x), 1.0, floors))
        old = params.select("gid", "start", F.col("det").alias("old"))
        params = new
        # the starts' determinants are no subset's
        if step and new.join(old, ["gid", "start"]).where(F.col("det") < F.col("old") * (1 - SETTLED)).isEmpty():
            break
    best = params.groupBy("gid").agg(F.min(F.struct("det", "start", "centre", "inverse")).alias("b"))
    raw = work.written(best.select("gid", F.lit(0).alias("start"), "b.centre", "b.inverse", "b.det"))
    # distances under the corrected covariance are those under the raw one, divided by the factor
    near_rows = rows.join(near(raw.drop("det")), "gid").where(distance(x) <= REWEIGHT * consistency(h_share))
    return raw, work.written(_estimated(_moments(near_rows.select("gid", "start", "x"), x), consistency(0.975), floors))


def fit(work: Workspace, stats: DataFrame, least_rows: int = LEAST_ROWS, h_share: float = H_SHARE) -> DataFrame:
    """stats: columns lang, source and s (the counts). Gives lang, source, centre and inverse of every group that
    has an estimate; join it with `judged`."""
    good = stats.where(~base_failed(F.col("s"))).select(F.coalesce("lang", F.lit("\0")).alias("lang"), F.coalesce("source", F.lit("\0")).alias("source"), F.array(*vector(F.col("s"))).alias("x"))
    sizes = work.written(good.groupBy("lang", "source").count())
    # the pool of each group: itself, else the small groups of its language, else those of small languages
    few_rows = F.col("count") < least_rows
    languages = sizes.where(few_rows).groupBy("lang").agg(F.sum("count").alias("pooled"))
    pools = sizes.join(languages, "lang", "left").select("lang", "source", F.when(~few_rows, F.col("lang")).when(F.col("pooled") >= least_rows, F.col("lang")).otherwise("\1").alias("l"), F.when(~few_rows, F.col("source")).otherwise("\1").alias("p"))
    names = work.written(pools.select("l", "p").distinct().coalesce(1).withColumn("gid", F.monotonically_increasing_id()))
    pools = work.written(pools.join(names, ["l", "p"]).select("lang", "source", "gid"))
    few = pools.count() <= BROADCAST_GROUPS
    rows = work.written(good.join(F.broadcast(pools) if few else pools, ["lang", "source"]).select("gid", "x"))
    _, params = estimates(work, rows, few, least_rows, h_share)
    return work.kept(pools.join(params, "gid").select("lang", "source", "centre", "inverse"))


def judged(rows: DataFrame, params: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """rows (lang, source, s and any others) plus failed, d2 and stays."""
    own = small(params.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "centre", "inverse"), BROADCAST_GROUPS)
    met = (F.coalesce("lang", F.lit("\0")) == F.col("g_lang")) & (F.coalesce("source", F.lit("\0")) == F.col("g_source"))
    failed, d2 = base_failed(F.col("s")), F.when(F.col("centre").isNotNull(), distance(F.array(*vector(F.col("s")))))
    out = rows.join(own, met, "left").withColumns({"failed": failed, "d2": d2})
    return out.withColumn("stays", ~F.col("failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff))


def quality_report(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance2 of every row."""
    with Workspace(docs.sparkSession) as work:
        table = work.kept(docs.select("doc_id", "lang", "source", stats_of(docs["text"]).alias("s")))
        params = fit(work, table.select("lang", "source", "s"))
    return judged(table, params, cutoff).select("doc_id", *[F.col("s")[n].alias(n) for n in STATS], F.col("failed").alias("base_failed"), F.col("stays").alias("kept"), F.col("d2").alias("distance2"))


def drop_rejected(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that are rejected. Documents are written with their counts, which are taken once."""
    with Workspace(docs.sparkSession) as work:
        record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
        table = work.kept(docs.select(record, docs["lang"].alias("lang"), docs["source"].alias("source"), stats_of(docs["text"]).alias("s")))
        params = fit(work, table.select("lang", "source", "s"))
    return judged(table, params, cutoff).where("stays").select(*[F.col("record")[c].alias(c) for c in docs.columns])

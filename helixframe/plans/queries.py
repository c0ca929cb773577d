"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability, seq
from ..functions.params import OverlapParams
from ..operators import align, errors, evaluate, graph, kmers, matrix, pairs
from ..operators.tables import cut, numbered, shared_path
from ..sources import fastq, formats, generate, maf
from . import overlap, views
from .views import BASES, MATRIX, MERGED, ORDER_GRAPH, READS, SHIFTED, TRUTH, field_sql, interval_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: SQL that is too slow for larger tables; tests run it on the smallest.
SMALL_ORACLE: dict[str, str] = {}
K = 17
LEAST = evaluate.MIN_OVERLAP


def query(sql: str | None = None, small: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            (SMALL_ORACLE if small else ORACLE)[f.__name__] = sql
        return f

    return add


KMERS = READS + f""",
places AS (SELECT read_id, seq, unnest(range(length(seq) - {K} + 1)) AS pos FROM reads WHERE length(seq) >= {K}),
words AS (SELECT read_id, pos, substr(seq, pos + 1, {K}) AS f FROM places),
k AS (SELECT read_id, pos, f, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM words)"""
BAND = KMERS + """,
band AS (SELECT kmer, count(*) AS cnt FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
occ AS (SELECT read_id, kmer, max(pos) AS pos FROM k JOIN band USING (kmer) GROUP BY 1, 2)"""
SEEDS = BAND + ", seeds AS (SELECT x.read_id AS v, y.read_id AS h, x.pos AS pos_v, y.pos AS pos_h FROM occ x JOIN occ y ON x.kmer = y.kmer AND x.read_id < y.read_id)"
CODE = "list_sum(list_transform(range(length({0})), lambda i: (strpos('ACGT', substr({0}, i + 1, 1)) - 1) * CAST(pow(4, length({0}) - 1 - i) AS BIGINT)))"
ORDER = f"({{0}} % {seq.ORDER_MODULUS}) * {seq.ORDER_FACTOR} % {seq.ORDER_MODULUS}"


def _occurrences(spark: SparkSession, sf_dir: str, params: OverlapParams = OverlapParams()) -> DataFrame:
    return kmers.kmer_occurrences(views.reads(spark, sf_dir), params)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.matrix_of(views.reads(spark, sf_dir))


# --- k-mers ------------------------------------------------------------------------------------------------------


@query(f"WITH {KMERS} SELECT substr(kmer, 1, 4) AS prefix, count(DISTINCT kmer) AS distinct_kmers, count(*) AS occurrences FROM k GROUP BY 1")
def kmer_count(spark, sf_dir):
    counts = kmers.kmer_counts(_occurrences(spark, sf_dir)).select(F.substr(seq.decode_kmer("kmer"), F.lit(1), F.lit(4)).alias("prefix"), "cnt")
    return counts.groupBy("prefix").agg(F.count("*").alias("distinct_kmers"), F.sum("cnt").alias("occurrences"))


@query(f"WITH {KMERS}, c AS (SELECT count(*) AS cnt FROM k GROUP BY kmer) SELECT cnt, count(*) AS n_kmers FROM c GROUP BY 1")
def kmer_spectrum(spark, sf_dir):
    return kmers.kmer_counts(_occurrences(spark, sf_dir)).groupBy("cnt").agg(F.count("*").alias("n_kmers"))


@query(f"WITH {BAND} SELECT kmer, cnt FROM band")
def kmer_reliable(spark, sf_dir):
    return kmers.reliable(kmers.kmer_counts(_occurrences(spark, sf_dir)), 2, 8).select(seq.decode_kmer("kmer").alias("kmer"), "cnt")


@query(f"WITH {KMERS}, hw AS (SELECT regexp_replace(f, '(A)A+|(C)C+|(G)G+|(T)T+', '\\1\\2\\3\\4', 'g') AS w FROM k), c AS (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM hw GROUP BY 1) SELECT CAST(length(kmer) AS BIGINT) AS letters, cnt, count(*) AS n_kmers FROM c GROUP BY 1, 2")
def kmer_hopc_spectrum(spark, sf_dir):
    counts = kmers.kmer_counts(_occurrences(spark, sf_dir, OverlapParams(hopc=True)))
    return counts.groupBy(F.length(seq.decode_kmer("kmer")).cast("long").alias("letters"), "cnt").agg(F.count("*").alias("n_kmers"))


@query()
def hll_estimate(spark, sf_dir):
    return kmers.approximate_distinct(_occurrences(spark, sf_dir))


W = 10


@query(f"""WITH {KMERS}, c AS (SELECT read_id, pos, kmer, {ORDER.format(f'(CAST({1 << (2 * K)} AS BIGINT) + {CODE.format("kmer")})')} AS key FROM k),
n AS (SELECT read_id, count(*) AS n FROM c GROUP BY 1),
w AS (SELECT read_id, c.pos AS spot, min(struct_pack(key := key, pos := c.pos)) OVER (PARTITION BY read_id ORDER BY c.pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS best FROM c),
m AS (SELECT DISTINCT read_id, best.pos AS pos FROM w JOIN n USING (read_id) WHERE spot >= {W - 1} OR spot = n - 1)
SELECT read_id, count(*) AS minimizers, CAST(sum(pos) AS BIGINT) AS places FROM m GROUP BY 1""")
def minimizer_places(spark, sf_dir):
    return _occurrences(spark, sf_dir, OverlapParams(window=W)).groupBy("read_id").agg(F.count("*").alias("minimizers"), F.sum(F.col("pos").cast("long")).alias("places"))


@query(f"""WITH {KMERS}, c AS (SELECT read_id, pos, kmer, {ORDER.format(f'(CAST({1 << (2 * K)} AS BIGINT) + {CODE.format("kmer")})')} AS key FROM k),
n AS (SELECT read_id, count(*) AS n FROM c GROUP BY 1),
w AS (SELECT read_id, c.pos AS spot, min(struct_pack(key := key, pos := c.pos)) OVER (PARTITION BY read_id ORDER BY c.pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS best FROM c),
m AS (SELECT DISTINCT read_id, best.pos AS pos FROM w JOIN n USING (read_id) WHERE spot >= {W - 1} OR spot = n - 1)
SELECT kmer, count(*) AS cnt FROM m JOIN c USING (read_id, pos) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8""")
def minimizer_reliable(spark, sf_dir):
    return kmers.reliable(kmers.kmer_counts(_occurrences(spark, sf_dir, OverlapParams(window=W))), 2, 8).select(seq.decode_kmer("kmer").alias("kmer"), "cnt")


@query(f"""WITH {KMERS}, d AS (SELECT kmer, count(*) AS cnt FROM k GROUP BY 1),
s AS (SELECT kmer, cnt, list_transform(range({K - 4}), lambda j: (list_sum(list_transform(range(5), lambda i: (strpos('ACGT', substr(kmer, j + i + 1, 1)) - 1) * CAST(pow(4, 4 - i) AS BIGINT))) % {seq.ORDER_MODULUS}) * {seq.ORDER_FACTOR} % {seq.ORDER_MODULUS}) AS o FROM d)
SELECT cnt, count(*) AS n_kmers FROM s WHERE NOT (list_min(o[2:{K - 5}]) < o[1] AND list_min(o[2:{K - 5}]) < o[{K - 4}]) GROUP BY 1""")
def syncmer_spectrum(spark, sf_dir):
    return kmers.kmer_counts(_occurrences(spark, sf_dir, OverlapParams(syncmers=True))).groupBy("cnt").agg(F.count("*").alias("n_kmers"))


@query(f"WITH {KMERS} SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS reverse_complement, md5(least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))) AS canonical, CAST(length(regexp_replace(seq, '(A)A+|(C)C+|(G)G+|(T)T+', '\\1\\2\\3\\4', 'g')) AS BIGINT) AS compressed FROM reads")
def read_strands(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read_id", F.md5(seq.reverse_complement("seq")).alias("reverse_complement"), F.md5(seq.canonical("seq")).alias("canonical"), F.length(seq.homopolymer_compressed("seq")).cast("long").alias("compressed"))


@query(f"WITH {BAND} SELECT kmer, CAST({CODE.format('kmer')} + {1 << (2 * K)} AS BIGINT) AS code FROM band")
def kmer_codes(spark, sf_dir):
    return kmer_reliable(spark, sf_dir).select("kmer", seq.encode_kmer("kmer").alias("code"))


# --- error rates -------------------------------------------------------------------------------------------------


@query(f"WITH {BASES} SELECT round(avg(e), 9) AS error_rate FROM errors")
def phred_error_per_base(spark, sf_dir):
    return errors.error_per_base(views.with_quality(views.reads(spark, sf_dir))).select(F.round("error_rate", 9).alias("error_rate"))


@query(f"WITH {BASES}, r AS (SELECT read_id, avg(e) AS e FROM errors GROUP BY 1) SELECT round(avg(e), 9) AS error_rate FROM r")
def phred_error_per_read(spark, sf_dir):
    return errors.error_per_read(views.with_quality(views.reads(spark, sf_dir))).select(F.round("error_rate", 9).alias("error_rate"))


# --- candidate pairs ---------------------------------------------------------------------------------------------


@query(f"WITH {BAND} SELECT read_id, kmer, pos FROM occ")
def occurrence_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("read_id", seq.decode_kmer("kmer").alias("kmer"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {SEEDS} SELECT v, h, count(*) AS shared FROM seeds GROUP BY 1, 2")
def overlap_candidates(spark, sf_dir):
    return pairs.candidates_of(views.reads(spark, sf_dir))


@query(f"WITH {SEEDS}, p AS (SELECT v, h, count(*) AS n FROM seeds GROUP BY 1, 2) SELECT (SELECT count(*) FROM occ) AS nnz, CAST(sum(n) AS BIGINT) AS flops, count(*) AS nnz_output, round(sum(n) / count(*), 6) AS compression FROM p")
def spgemm_stats(spark, sf_dir):
    return pairs.statistics_of(views.reads(spark, sf_dir))


_OV = SEEDS + f""",
z AS (SELECT v, h, pos_v, pos_h, length(a.seq) AS len_v, length(b.seq) AS len_h, substr(a.seq, pos_v + 1, {K}) = substr(b.seq, pos_h + 1, {K}) AS forward FROM seeds JOIN reads a ON a.read_id = v JOIN reads b ON b.read_id = h),
o AS (SELECT *, CASE WHEN forward THEN pos_h ELSE len_h - pos_h - {K} END AS beg_h FROM z),
s AS (SELECT *, least(beg_h, pos_v) + least(len_h - beg_h - {K}, len_v - pos_v - {K}) + {K} AS ov FROM o)"""


@query(f"WITH {_OV} SELECT v, h, count(*) AS seeds, CAST(sum(CAST(forward AS INT)) AS BIGINT) AS forward, CAST(min(ov) AS BIGINT) AS least, CAST(max(ov) AS BIGINT) AS most FROM s GROUP BY 1, 2")
def seed_overlap_estimate(spark, sf_dir):
    return pairs.estimates_of(views.reads(spark, sf_dir))


# The fold as a reduction: each seed is a state of one bin, and a state takes the next seed in.
_FOLD = _OV + f""",
one AS (SELECT v, h, len_v, len_h, pos_v, pos_h, ov, {{'cnt': CAST(1 AS BIGINT), 'bins': [{{'ov': CAST(ov AS BIGINT), 'support': CAST(1 AS BIGINT), 'seeds': [{{'v': CAST(pos_v AS BIGINT), 'h': CAST(pos_h AS BIGINT)}}]}}]}} AS st FROM s),
many AS (SELECT v, h, any_value(len_v) AS len_v, any_value(len_h) AS len_h, list(st ORDER BY pos_v, pos_h) AS sts FROM one GROUP BY 1, 2),
folded AS (SELECT v, h, len_v, len_h, len(sts) AS shared, list_reduce(sts, lambda a, x: {{
  'cnt': a.cnt + 1 + len(flatten(list_transform(list_filter(a.bins, lambda b: abs(b.ov - x.bins[1].ov) < 500), lambda b: list_filter(b.seeds, lambda t: abs(t.v - x.bins[1].seeds[1].v) > {K} AND abs(t.h - x.bins[1].seeds[1].h) > {K})))),
  'bins': list_concat([{{'ov': x.bins[1].ov,
    'support': 1 + len(flatten(list_transform(list_filter(a.bins, lambda b: abs(b.ov - x.bins[1].ov) < 500), lambda b: list_filter(b.seeds, lambda t: abs(t.v - x.bins[1].seeds[1].v) > {K} AND abs(t.h - x.bins[1].seeds[1].h) > {K})))),
    'seeds': list_concat(x.bins[1].seeds, flatten(list_transform(list_filter(a.bins, lambda b: abs(b.ov - x.bins[1].ov) < 500), lambda b: list_filter(b.seeds, lambda t: abs(t.v - x.bins[1].seeds[1].v) > {K} AND abs(t.h - x.bins[1].seeds[1].h) > {K}))))}}],
    list_filter(a.bins, lambda b: abs(b.ov - x.bins[1].ov) >= 500))}}) AS f FROM many),
chosen AS (SELECT v, h, len_v, len_h, shared, f.cnt AS cnt, len(f.bins) AS n_bins, list_filter(f.bins, lambda b: b.support = list_max(list_transform(f.bins, lambda c: c.support)))[1] AS best FROM folded)"""


@query(f"WITH {_FOLD} SELECT v, h, shared, cnt AS count, CAST(n_bins AS INT) AS bins, best.support AS support, best.ov AS ov, CAST(best.seeds[1].v AS INT) AS pos_v, CAST(best.seeds[1].h AS INT) AS pos_h FROM chosen", small=True)
def chain_fold(spark, sf_dir):
    return pairs.chosen_of(views.reads(spark, sf_dir)).drop("len_v", "len_h")


@query()
def overlap_full(spark, sf_dir):
    return overlap.overlaps(views.reads(spark, sf_dir)).where("passed")


@query()
def overlap_banded(spark, sf_dir):
    """Aligned in an adaptive band of 31 cells."""
    return overlap.overlaps(views.reads(spark, sf_dir), OverlapParams(band=31, forward_coords=True)).where("passed")


@query()
def overlap_minimizers(spark, sf_dir):
    return overlap.overlaps(views.reads(spark, sf_dir), OverlapParams(window=W)).where("passed")


@query()
def xdrop_counters(spark, sf_dir):
    return overlap.counters(overlap.overlaps(views.reads(spark, sf_dir)))


@query()
def overlap_native_lines(spark, sf_dir):
    return formats.native_lines(overlap.overlaps(views.reads(spark, sf_dir)).where("passed"))


@query()
def overlap_paf_lines(spark, sf_dir):
    return formats.paf_lines(overlap.overlaps(views.reads(spark, sf_dir)).where("passed"))


@query(f"WITH {_FOLD} SELECT concat_ws('\t', 'read' || v, 'read' || h, shared, best.ov, len_v, len_h) AS value FROM chosen", small=True)
def overlap_only_lines(spark, sf_dir):
    return formats.overlap_lines(overlap.overlaps(views.reads(spark, sf_dir), OverlapParams(skip_alignment=True)))


@query(f"WITH {BAND}, i AS (SELECT kmer, row_number() OVER (ORDER BY kmer) AS kmer_id FROM band) SELECT concat_ws('\t', read_id + 1, kmer_id, pos) AS value FROM occ JOIN i USING (kmer)")
def matrix_dump(spark, sf_dir):
    return formats.matrix_lines(_matrix(spark, sf_dir))


# --- evaluation --------------------------------------------------------------------------------------------------


# Millions of pairs of intervals, summed by their first read.
def _by_read(found: DataFrame) -> DataFrame:
    return found.groupBy("a").agg(F.count("*").alias("partners"), F.sum("overlap").cast("long").alias("bases"), F.max("overlap").alias("largest"), F.min("b").alias("first"))


_BY_READ_SQL = "count(*) AS partners, CAST(sum(overlap) AS BIGINT) AS bases, max(overlap) AS largest, min(b) AS first"


@query(f"WITH {TRUTH}, {interval_sql('g', 'truth', LEAST)} SELECT a, {_BY_READ_SQL} FROM g GROUP BY 1")
def interval_truth(spark, sf_dir):
    return _by_read(evaluate.interval_pairs(views.truth(spark, sf_dir)))


@query(f"WITH {TRUTH} SELECT q.read AS query, count(*) AS inside, min(t.read) AS first FROM truth t JOIN truth q ON t.ref = q.ref AND t.start >= q.start AND t.stop <= q.stop GROUP BY 1")
def interval_contained(spark, sf_dir):
    t = views.truth(spark, sf_dir)
    return evaluate.contained(t, t.withColumnRenamed("read", "query"), 5000).groupBy("query").agg(F.count("*").alias("inside"), F.min("read").alias("first"))


_GS = f"{TRUTH}, {SHIFTED}, {interval_sql('g', 'truth', LEAST)}, {interval_sql('s', 'shifted', LEAST)}"


@query(f"""WITH {_GS}, n AS (SELECT (SELECT count(*) FROM g JOIN s USING (a, b)) AS t, (SELECT count(*) FROM s) AS p, (SELECT count(*) FROM g) AS e)
SELECT t AS "true", p AS predicted, e AS expected, round(100.0 * t / e, 2) AS recall, round(100.0 * t / p, 2) AS precision, round(2 * (100.0 * t / e) * (100.0 * t / p) / (100.0 * t / e + 100.0 * t / p), 2) AS f1 FROM n""")
def eval_prf(spark, sf_dir):
    return evaluate.scores(evaluate.interval_pairs(views.shifted_truth(spark, sf_dir)), evaluate.interval_pairs(views.truth(spark, sf_dir)), lists_both=False)


@query(f"""WITH {_GS}, x AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g), y AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s),
d AS (SELECT 'left' AS side, a, b FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT 'right', a, b FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x))
SELECT side, a, count(*) AS more, min(b) AS first, max(b) AS last FROM d GROUP BY 1, 2""")
def pair_diff_both_ways(spark, sf_dir):
    found = evaluate.pair_differences(evaluate.interval_pairs(views.truth(spark, sf_dir)), evaluate.interval_pairs(views.shifted_truth(spark, sf_dir)))
    return found.groupBy("side", "a").agg(F.count("*").alias("more"), F.min("b").alias("first"), F.max("b").alias("last"))


_BEST = "d AS (SELECT s.a, s.b, max(greatest(least(x.stop, y.stop) - greatest(x.start, y.start), 0)) AS truth FROM s JOIN truth x ON x.read = s.a JOIN truth y ON y.read = s.b AND x.ref = y.ref GROUP BY 1, 2)"


@query(f"WITH {_GS}, {_BEST} SELECT s.a, count(*) AS partners, CAST(sum(coalesce(d.truth, 0)) AS BIGINT) AS truth, CAST(max(coalesce(d.truth, 0)) AS BIGINT) AS largest FROM s LEFT JOIN d USING (a, b) GROUP BY 1")
def placement_overlap(spark, sf_dir):
    best = evaluate.best_reference_overlap(evaluate.interval_pairs(views.shifted_truth(spark, sf_dir)), views.truth(spark, sf_dir))
    return best.groupBy("a").agg(F.count("*").alias("partners"), F.sum("truth").cast("long").alias("truth"), F.max("truth").alias("largest"))


@query(f"""WITH {_GS}, {_BEST},
n AS (SELECT count(*) FILTER (coalesce(truth, 0) >= {LEAST}) AS t, count(*) FILTER (coalesce(truth, 0) >= {LEAST} OR CASE WHEN a < b THEN overlap - 1500 ELSE overlap END >= {LEAST}) AS p FROM s LEFT JOIN d USING (a, b)), e AS (SELECT count(*) AS e FROM g)
SELECT t AS "true", p AS predicted, e AS expected, round(100.0 * t / e, 2) AS recall, round(100.0 * t / p, 2) AS precision FROM n, e""")
def placement_evaluation(spark, sf_dir):
    """Pairs in ascending order have a second line, with a smaller estimate, which counts."""
    found = evaluate.interval_pairs(views.shifted_truth(spark, sf_dir))
    again = found.where("a < b").select("a", "b", (F.col("overlap") - 1500).alias("overlap"), F.lit(2).alias("line_no"))
    return evaluate.placement_scores(found.withColumn("line_no", F.lit(1)).union(again), views.truth(spark, sf_dir))


_SPAN = "least({bv}, {bh}) + least({lv} - {ev}, {lh} - {eh}) + (({ev} - {bv}) + ({eh} - {bh})) // 2"


def _span_sql(flip: str = "FALSE") -> str:
    f = views.FIELDS
    bh, eh, lh = (f"({f[x]})" for x in ("beg_h", "end_h", "len_h"))
    own = {"bv": f"({f['beg_v']})", "ev": f"({f['end_v']})", "lv": f"({f['len_v']})", "lh": lh}
    plain = _SPAN.format(**own, bh=bh, eh=eh)
    flipped = _SPAN.format(**own, bh=f"({lh} - {eh})", eh=f"({lh} - {bh})")
    return f"CASE WHEN {flip} THEN {flipped} ELSE {plain} END"


def _tool_query(tool: str) -> None:
    flip = f"{field_sql(tool, 'strand')} = '{'-' if tool == 'paf' else 'c'}'" if tool in ("paf", "daligner") else "FALSE"
    ov = f"({views.FIELDS['ov']})" if tool == "native" else _span_sql(flip)

    def pairs_of(spark, sf_dir):
        found = formats.evaluated(views.tool_lines(spark, sf_dir, tool), tool, _index(spark, sf_dir) if tool == "mecat" else None)
        kept, _ = evaluate.kept_pairs(found.groupBy("a", "b").agg(F.max("overlap").alias("overlap")), 1000)
        return kept

    pairs_of.__name__ = f"pairs_from_{tool}"
    name = "concat('r', {0})"
    query(f"SELECT a, b, CAST(max(overlap) AS BIGINT) AS overlap FROM (SELECT {name.format('l_orderkey')} AS a, {name.format('l_suppkey')} AS b, {ov} AS overlap FROM lineitem) WHERE a <> b GROUP BY 1, 2 HAVING max(overlap) >= 1000")(pairs_of)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    suppliers = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    lines = orders.union(suppliers).distinct().select(F.concat(F.col("id"), F.lit(" >r"), F.col("id")).alias("value"))
    return formats.read_index(lines)


def _paf_query(tool: str) -> None:
    f = lambda n: f"({field_sql(tool, n)})"
    ov = _span_sql()
    norm = f"greatest({f('end_v')} - {f('beg_v')}, {f('end_h')} - {f('beg_h')})"
    score = {"native": f"CAST(trunc({norm} * ln(1 / (({f('kmers')}) / {norm})) / 17) AS BIGINT)" if tool == "native" else "", "mecat": f"CAST(floor(CAST({f('ident') if tool == 'mecat' else '1'} AS DOUBLE) * ({ov}) / 100) AS BIGINT)", "blasr": f"substr({f('score') if tool == 'blasr' else '1'}, 2)"}.get(tool, f"CAST(floor(CAST(0.85 AS DOUBLE) * CAST(0.85 AS DOUBLE) * ({ov})) AS BIGINT)")
    plus = {"native": "n", "daligner": "n"}.get(tool, "0")
    last = norm if tool == "native" else ov
    mapq = f"CAST({f('mapq')} AS VARCHAR)" if tool == "blasr" else "'255'"

    def translate(spark, sf_dir):
        return formats.to_paf(views.tool_lines(spark, sf_dir, tool), tool, _index(spark, sf_dir) if tool == "mecat" else None)

    translate.__name__ = f"paf_from_{tool}"
    query(f"SELECT concat('r', l_orderkey) AS v, {f('len_v')} AS len_v, {f('beg_v')} AS beg_v, {f('end_v')} AS end_v, CASE WHEN {f('strand')} = '{plus}' THEN '+' ELSE '-' END AS strand, concat('r', l_suppkey) AS h, {f('len_h')} AS len_h, {f('beg_h')} AS beg_h, {f('end_h')} AS end_h, CAST({score} AS VARCHAR) AS score, CAST({last} AS BIGINT) AS ov, {mapq} AS mapq FROM lineitem")(translate)


for _tool in ("native", "paf", "mhap", "mecat", "blasr", "daligner"):
    _tool_query(_tool)
    if _tool != "paf":
        _paf_query(_tool)


@query("SELECT concat('chr', l_suppkey) AS ref, concat('r', l_orderkey) AS read, CAST(l_partkey AS INT) AS start, CAST(l_partkey + length(l_returnflag || l_linestatus) AS INT) AS stop FROM lineitem")
def sam_truth(spark, sf_dir):
    fields = ["concat('r', l_orderkey)", "'0'", "concat('chr', l_suppkey)", "l_partkey", "'60'", "'*'", "'*'", "'0'", "'0'", "concat(l_returnflag, l_linestatus)", "'*'"]
    lines = views.table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *[F.expr(f).cast("string") for f in fields]).alias("value"))
    return formats.sam_truth(lines)


@query("SELECT concat('c', l_suppkey) AS ref, concat('@r', l_orderkey) AS read, CAST(l_partkey AS INT) AS start, CAST(l_partkey + l_linenumber AS INT) AS stop FROM lineitem")
def truth_reader(spark, sf_dir):
    real = F.concat_ws(" ", F.concat(F.lit("c"), "l_suppkey"), F.concat(F.lit("r"), "l_orderkey"), "l_partkey", F.col("l_partkey") + F.col("l_linenumber"))
    return formats.truth(views.table(spark, sf_dir, "lineitem").select(real.alias("value")))


@query("SELECT DISTINCT concat('n', l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN '/1' ELSE '/2' END) AS normalised, concat('n', l_orderkey) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS direction FROM lineitem")
def read_names(spark, sf_dir):
    raw = F.concat(F.lit("n"), "l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.lit(" 1:Y:18:ATC")).otherwise(F.lit(" 2:N:0:GG")))
    plain = views.table(spark, sf_dir, "lineitem").select(fastq.normalised_name(raw).alias("normalised")).distinct()
    name, direction = fastq.name_and_direction(F.col("normalised"))
    return plain.select("normalised", name.alias("name"), direction.alias("direction"))


# --- scalar functions --------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT l_discount AS error_rate, round(2 * pow(1 - l_discount, 2) - 1, 9) AS slope, round(0.9 * (2 * pow(1 - l_discount, 2) - 1) * 1000, 6) AS threshold FROM lineitem")
def slope_threshold(spark, sf_dir):
    rate = views.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("error_rate")).distinct()
    slope = seq.slope_column("error_rate")
    return rate.select("error_rate", F.round(slope, 9).alias("slope"), F.round(0.9 * slope * 1000, 6).alias("threshold"))


@query("WITH p AS (SELECT DISTINCT l_discount / 7 AS p FROM lineitem) SELECT round(p, 9) AS p, CASE WHEN p = 0 THEN 254 ELSE CAST(least(254, round(-10 * log10(p))) AS INT) END AS mapq FROM p")
def mapq_from_prob(spark, sf_dir):
    p = views.table(spark, sf_dir, "lineitem").select((F.col("l_discount") / 7).alias("p")).distinct()
    return p.select(F.round("p", 9).alias("p"), seq.mapq_from_probability("p").alias("mapq"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 16 AS low, l_partkey >> 4 AS high, abs(l_quantity - l_linenumber) < 1e-3 OR abs(l_quantity - l_linenumber) < 1e-3 * greatest(abs(l_quantity), abs(l_linenumber)) AS equal, l_suppkey > 10 AND l_suppkey < 50 AS inside FROM lineitem")
def utility_functions(spark, sf_dir):
    t = views.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", seq.mod_power_of_two("l_partkey", 4).alias("low"), seq.div_power_of_two("l_partkey", 4).alias("high"), seq.nearly_equal("l_quantity", F.col("l_linenumber")).alias("equal"), seq.strictly_between("l_suppkey", F.lit(10), F.lit(50)).alias("inside"))


@query("SELECT DISTINCT l_quantity AS k, round(ln((1 - pow(0.7225, l_quantity)) / ((1 - 0.7225) * pow(0.7225, l_quantity))), 6) AS log_expected FROM lineitem")
def markov_expected(spark, sf_dir):
    k = views.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("k")).distinct()
    return k.select("k", F.round(F.ln(probability.expected_overlap_column(F.lit(0.85), F.col("k"))), 6).alias("log_expected"))


_Q = 0.85 * 0.85


@query(f"""WITH RECURSIVE t(n, s) AS (SELECT 0, list_concat([CAST(1 AS DOUBLE)], list_transform(range({K}), lambda i: CAST(0 AS DOUBLE)))
UNION ALL SELECT n + 1, list_concat([(1 - {_Q!r}) * list_sum(s[1:{K}])], list_transform(range(1, {K}), lambda i: {_Q!r} * s[i]), [s[{K + 1}] + {_Q!r} * s[{K}]]) FROM t WHERE n < 2000),
g AS (SELECT DISTINCT CAST(l_quantity * 40 AS INT) AS overlap FROM lineitem)
SELECT overlap, CAST(0.85 AS DOUBLE) AS p, {K} AS k, round(s[{K + 1}], 9) AS probability FROM g JOIN t ON t.n = g.overlap""")
def markov_probability(spark, sf_dir):
    grid = views.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 40).cast("int").alias("overlap")).distinct().select("overlap", F.lit(0.85).alias("p"), F.lit(K).alias("k"))
    return probability.with_probability(grid).withColumn("probability", F.round("probability", 9))


# --- sparse matrices ---------------------------------------------------------------------------------------------


@query(f"WITH {MERGED} SELECT col AS row, row AS col, val FROM a")
def coo_transpose(spark, sf_dir):
    return matrix.transpose(matrix.merge_duplicates(views.matrix(spark, sf_dir)))


@query(f"WITH {MERGED} SELECT row + 1 AS row, col + 1 AS col, val FROM a")
def coo_one_based(spark, sf_dir):
    return matrix.one_based(matrix.merge_duplicates(views.matrix(spark, sf_dir)))


@query(f"WITH {MERGED} SELECT row, col, CAST(val AS DOUBLE) AS val FROM a")
def matrix_market_round_trip(spark, sf_dir):
    """Written as numbered lines of a MatrixMarket file and read again."""
    a = cut(matrix.merge_duplicates(views.matrix(spark, sf_dir)))
    lines = formats.market_lines(a, *a.agg(F.max("row") + 1, F.max("col") + 1).first())
    return formats.matrix_text(lines.select((F.monotonically_increasing_id()).alias("line_no"), "value"))


@query(f"WITH {MATRIX}, x AS (SELECT row, col, sum(val) AS a, max(val) AS b FROM m GROUP BY 1, 2) SELECT row, col, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(abs(a - b) AS DOUBLE) AS diff FROM x WHERE NOT (abs(a - b) < 1e-3 OR abs(a - b) < 1e-3 * greatest(abs(a), abs(b)))")
def matrix_differences(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    return matrix.differences(matrix.merge_duplicates(m), matrix.merge_duplicates(m, F.max))


@query(f"WITH {MERGED} SELECT row, col, val FROM a WHERE row IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND col IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def spref_sets(spark, sf_dir):
    """Lists with repeats, taken as sets."""
    rows = views.table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    cols = views.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return matrix.submatrix(matrix.merge_duplicates(views.matrix(spark, sf_dir)), rows.union(rows), cols.union(cols), repeats=False)


@query(f"WITH {MERGED} SELECT row, col, val FROM a")
def coo_merge_duplicates(spark, sf_dir):
    return matrix.merge_duplicates(views.matrix(spark, sf_dir))


@query(f"WITH {MERGED} SELECT x.col AS row, y.col AS col, round(sum(x.val * y.val), 3) AS val FROM a x JOIN a y ON x.row = y.row GROUP BY 1, 2")
def spgemm_plain(spark, sf_dir):
    a = matrix.merge_duplicates(views.matrix(spark, sf_dir))
    return matrix.spgemm(matrix.transpose(a), a).select("row", "col", F.round("val", 3).alias("val"))


@query(f"WITH {MERGED} SELECT x.col AS row, y.col AS col, min(x.val + y.val) AS val FROM a x JOIN a y ON x.row = y.row AND x.col < y.col GROUP BY 1, 2")
def spgemm_min_plus(spark, sf_dir):
    a = matrix.merge_duplicates(views.matrix(spark, sf_dir))
    return matrix.spgemm(matrix.transpose(a), a, lambda x, y: x + y, F.min, F.col("i") < F.col("j"))


@query(f"WITH {MERGED}, c AS (SELECT row, count(*) AS n FROM a GROUP BY 1) SELECT col, CAST(sum(n) AS BIGINT) AS flops FROM a JOIN c USING (row) GROUP BY 1")
def spgemm_flops(spark, sf_dir):
    a = matrix.merge_duplicates(views.matrix(spark, sf_dir))
    return matrix.flops_by_column(matrix.transpose(a), a)


@query(f"WITH {MERGED}, p AS (SELECT DISTINCT x.col AS i, y.col AS j FROM a x JOIN a y ON x.row = y.row) SELECT j AS col, count(*) AS nnz FROM p GROUP BY 1")
def spgemm_nonzeros(spark, sf_dir):
    a = matrix.merge_duplicates(views.matrix(spark, sf_dir))
    return matrix.symbolic_nonzeros(matrix.transpose(a), a)


@query(f"WITH {MERGED}, r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part WHERE p_size <= 25), c AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS place FROM supplier WHERE s_acctbal > 0) SELECT r.place AS row, c.place AS col, val FROM a JOIN r ON r.id = a.row JOIN c ON c.id = a.col")
def spref(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.struct("p_retailprice", "p_partkey").alias("k"))
    cols = views.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.struct("s_acctbal", "s_suppkey").alias("k"))
    rows, cols = (numbered(x, "k", "place").select("id", "place") for x in (rows, cols))
    return matrix.submatrix(matrix.merge_duplicates(views.matrix(spark, sf_dir)), rows, cols)


@query(f"WITH {MATRIX}, x AS (SELECT row, col, sum(val) AS a, max(val) AS b FROM m GROUP BY 1, 2) SELECT row, col, a, b, abs(a - b) AS diff FROM x WHERE NOT (abs(a - b) < 0) AND abs(a - b) > 0 ORDER BY diff DESC, row, col LIMIT 10")
def largest_differences(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    return matrix.largest_differences(matrix.merge_duplicates(m), matrix.merge_duplicates(m, F.max))


@query("WITH c AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1) SELECT part, n, CAST(sum(n) OVER (ORDER BY part) AS BIGINT) AS total, CAST(sum(n) OVER (ORDER BY part) - n AS BIGINT) AS total_before, CAST(floor((sum(n) OVER (ORDER BY part) - n) / 1000) AS BIGINT) AS stage FROM c")
def prefix_sum_stages(spark, sf_dir):
    counts = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return matrix.stages(counts, "part", "n", 1000).select("part", "n", "total", "total_before", "stage")


# --- graphs ------------------------------------------------------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All reads, and the links between those that share a reliable k-mer, which aren't written yet."""
    edges = pairs.candidates_of(views.reads(spark, sf_dir)).select(F.col("v").alias("src"), F.col("h").alias("dst"))
    return views.reads(spark, sf_dir).select(F.col("read_id").alias("id")), edges


_LINKS = f"{SEEDS}, l AS MATERIALIZED (SELECT DISTINCT v AS src, h AS dst FROM seeds UNION SELECT DISTINCT h, v FROM seeds)"
_MIXED = "(id * 7919) % 1009"


def _greedy(order: str, links: str = "l") -> str:
    """SQL of the independent set that a pass in an order takes: vertices are numbered, and a list of those taken grows."""
    return f"""WITH RECURSIVE {_LINKS}, d2 AS MATERIALIZED (SELECT DISTINCT x.src, y.dst FROM l x JOIN l y ON x.dst = y.src WHERE x.src <> y.dst UNION SELECT * FROM l),
i AS MATERIALIZED (SELECT read_id AS id, row_number() OVER (ORDER BY {order.replace('id', 'read_id')}) AS n FROM reads),
b AS MATERIALIZED (SELECT i.id, i.n, coalesce(list(j.n) FILTER (j.n < i.n), []) AS near FROM i LEFT JOIN {links} e ON e.src = i.id LEFT JOIN i j ON j.id = e.dst GROUP BY 1, 2),
t(n, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT b.n, CASE WHEN list_has_any(taken, near) THEN taken ELSE list_append(taken, b.n) END FROM t JOIN b ON b.n = t.n + 1)
SELECT id FROM i JOIN (SELECT unnest(taken) AS n FROM (SELECT taken FROM t ORDER BY n DESC LIMIT 1)) USING (n)"""


@query(f"""WITH RECURSIVE {_LINKS}, t(id, root) AS (SELECT read_id, read_id FROM reads UNION SELECT l.dst, t.root FROM t JOIN l ON l.src = t.id WHERE l.dst > t.root), m AS (SELECT id, min(root) AS label FROM t GROUP BY 1),
s(id, label) AS (SELECT id, label FROM m) SELECT id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS component FROM s""")
def graph_components(spark, sf_dir):
    vertices, edges = _links(spark, sf_dir)
    return graph.components(vertices, cut(edges))


@query(f"WITH RECURSIVE {ORDER_GRAPH}, t(id, level) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT b.dst, level + 1 FROM t JOIN b ON b.src = t.id WHERE level < 12) SELECT id, min(level) AS level FROM t GROUP BY 1")
def graph_bfs(spark, sf_dir):
    return graph.breadth_first(views.order_graph(spark, sf_dir), 3)


@query(_greedy("id"))
def graph_mis(spark, sf_dir):
    return graph.independent_set(*_links(spark, sf_dir))


@query(_greedy(f"{_MIXED} DESC, id DESC"))
def graph_mis_weighted(spark, sf_dir):
    vertices, edges = _links(spark, sf_dir)
    return graph.weighted_independent_set(vertices.withColumn("y", F.pmod(F.col("id") * 7919, F.lit(1009))), edges)


@query(_greedy(f"{_MIXED} DESC, id DESC", "d2"))
def graph_mis_distance2(spark, sf_dir):
    vertices, edges = _links(spark, sf_dir)
    return graph.distance_k_set(vertices.withColumn("y", F.pmod(F.col("id") * 7919, F.lit(1009))), edges, 2)


@query(f"""WITH RECURSIVE {_LINKS}, i AS MATERIALIZED (SELECT read_id AS id, row_number() OVER (ORDER BY read_id) AS n FROM reads),
b AS MATERIALIZED (SELECT i.id, i.n, coalesce(list(j.n) FILTER (j.n < i.n), []) AS near FROM i LEFT JOIN l ON l.src = i.id LEFT JOIN i j ON j.id = l.dst GROUP BY 1, 2),
t(n, colors) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INT[]) UNION ALL SELECT b.n, list_append(colors, CAST(list_min(list_filter(range(len(near) + 1), lambda c: NOT list_contains(list_transform(near, lambda x: colors[x]), c))) AS INT)) FROM t JOIN b ON b.n = t.n + 1)
SELECT id, (SELECT colors FROM t ORDER BY n DESC LIMIT 1)[n] AS color FROM i""")
def graph_coloring(spark, sf_dir):
    return graph.coloring_by_sets(*_links(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = views.order_graph(spark, sf_dir)
    return views.vertices(edges).withColumn("y", F.pmod(F.col("id") * 7919, F.lit(1009)) / 1009), edges


@query()
def graph_coloring_jones_plassmann(spark, sf_dir):
    return graph.coloring_jones_plassmann(*_mixed(spark, sf_dir))


@query()
def graph_coloring_largest_degree(spark, sf_dir):
    return graph.coloring_largest_degree(*_mixed(spark, sf_dir))


@query(f"""WITH RECURSIVE {ORDER_GRAPH}, t(id, dist, hops) AS (SELECT CAST(3 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT dst, min(dist) , hops FROM (SELECT b.dst, t.dist + b.w AS dist, hops + 1 AS hops FROM t JOIN b ON b.src = t.id WHERE hops < 40) GROUP BY dst, hops)
SELECT id, min(dist) AS dist, CAST(0 AS BIGINT) AS centre FROM t GROUP BY 1""")
def graph_distances(spark, sf_dir):
    edges = views.order_graph(spark, sf_dir)
    seeds = spark.createDataFrame([(3, 0)], "id long, centre long")
    return graph.distances(edges, seeds)


@query()
def graph_lloyd(spark, sf_dir):
    edges = views.order_graph(spark, sf_dir)
    seeds = spark.createDataFrame([(3, 0), (5, 1), (7, 2), (9, 3)], "id long, centre long")
    return graph.lloyd(views.vertices(edges), edges, seeds)[0]


@query()
def generate_rmat(spark, sf_dir):
    return generate.rmat(spark, 10)


@query()
def generate_random(spark, sf_dir):
    return generate.random_edges(spark, 1000, 8000)


@query()
def generate_erdos_renyi(spark, sf_dir):
    return generate.erdos_renyi(spark, 500, 0.02)


@query()
def generate_cliques(spark, sf_dir):
    return generate.cliques(spark, 1000, 12)


# --- files -------------------------------------------------------------------------------------------------------


#: Two rows of a block by line number: 0 gaps in the upper, 1 in the lower, 2 in both, 3 in none.
_ROWS = (("ACGT--ACGT", "ACGTTTACGT"), ("ACGTTTACGT", "AC--TTAC-T"), ("ACGT--ACGT", "ACGTTTAC-T"), ("ACGTTTACGT", "ACCTTTACGA"))
_SHAPES = ("4,0:2,4", "2,2:0,4,1:0,1", "4,0:2,2,1:0,1", "10")


def _maf(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    """Blocks of varying names, places, strands and gaps from all line items, converted."""
    t = views.table(spark, sf_dir, "lineitem")
    kind = F.pmod(F.col("l_linenumber"), F.lit(len(_ROWS)))
    text = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in _ROWS]), (kind + 1).cast("int"))
    size = lambda i: F.length(F.replace(text(i), F.lit("-")))
    strand = F.when(F.col("l_linenumber") % 2 == 0, F.lit("-")).otherwise(F.lit("+"))
    row = lambda name, at, i, sign: F.concat_ws(" ", F.lit("s"), name, at, size(i), sign, F.lit(1000000), text(i))
    block = F.concat_ws("\n", F.concat(F.lit("a score="), F.col("l_partkey")), row(F.concat(F.lit("c"), "l_suppkey"), F.col("l_partkey"), 0, F.lit("+")), row(F.concat(F.lit("r"), "l_orderkey"), F.col("l_suppkey"), 1, strand))
    return maf.converted(t.select(block.alias("value")), to).select("value")


def _maf_sql(select: str) -> str:
    one = lambda what: f"[{', '.join(repr(x) for x in what)}][l_linenumber % 4 + 1]"
    sizes = [[len(r[i].replace("-", "")) for r in _ROWS] for i in (0, 1)]
    return f"""WITH t AS (SELECT *, {one(_SHAPES)} AS shape, {one([r[0] for r in _ROWS])} AS upper_row, {one([r[1] for r in _ROWS])} AS lower_row, {one(sizes[0])} AS n, {one(sizes[1])} AS m,
CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem) {select}"""


@query(_maf_sql("SELECT concat_ws('\t', 'c' || l_suppkey, l_partkey, n, '+', 1000000, 'r' || l_orderkey, l_suppkey, m, strand, 1000000, shape) AS value FROM t"))
def maf_to_tab(spark, sf_dir):
    return _maf(spark, sf_dir, "tab")


@query(_maf_sql("SELECT concat_ws(' ', 'c' || l_suppkey, CAST(l_partkey + 1 AS BIGINT), CAST(l_partkey + n AS BIGINT), 'r' || l_orderkey, CAST(l_suppkey + 1 AS BIGINT), CAST(l_suppkey + m AS BIGINT)) AS value FROM t"))
def maf_to_axt(spark, sf_dir):
    return _maf(spark, sf_dir, "axt")


@query(_maf_sql("SELECT 'Query' AS side, lower_row AS letters, count(*) AS blocks, CAST(sum(CASE WHEN strand = '-' THEN 1000000 - l_suppkey ELSE l_suppkey + 1 END) AS BIGINT) AS begins FROM t GROUP BY 2 UNION ALL SELECT 'Sbjct', upper_row, count(*), CAST(sum(l_partkey + 1) AS BIGINT) FROM t GROUP BY 2"))
def maf_blast_rows(spark, sf_dir):
    """The aligned rows that BLAST-like text shows, and where they begin."""
    part = lambda i: F.regexp_extract("value", r"^(Query|Sbjct): *([0-9]+) +([ACGT-]+) ", i)
    found = _maf(spark, sf_dir, "blast").select(part(1).alias("side"), part(3).alias("letters"), part(2).alias("begin")).where("side <> ''")
    return found.groupBy("side", "letters").agg(F.count("*").alias("blocks"), F.sum(F.col("begin").cast("long")).alias("begins"))


_FASTQ = f"WITH {READS}, q AS (SELECT *, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: chr(CAST(33 + (ascii(substr(seq, i, 1)) * 7 + i) % 41 AS INT))), '') AS qual FROM reads)"


def _fastq(spark: SparkSession, sf_dir: str, compression: str = "none", range_bytes: int = fastq.RANGE_BYTES) -> DataFrame:
    """All reads, empty ones too, written as FASTQ in their order, listed in a file of files and read again by ranges."""
    path = shared_path(spark)
    fastq.write_fastq(views.with_quality(views.reads(spark, sf_dir)), f"{path}/reads", compression, ordered=True)
    files = fastq.files_below(spark, f"{path}/reads", ".gz" if compression == "gzip" else ".txt")
    spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(f"{path}/list")
    return fastq.read_fastq(spark, sorted(fastq.file_list(spark, f"{path}/list")), range_bytes)


@query(f"{_FASTQ} SELECT CAST(row_number() OVER (ORDER BY read_id) - 1 AS BIGINT) AS read_id, nametag, md5(seq) AS seq, md5(qual) AS qual, CAST(length(seq) AS BIGINT) AS bases FROM q")
def fastq_round_trip(spark, sf_dir):
    """Ranges of 100,000 bytes, so that records are cut at any place."""
    return _fastq(spark, sf_dir, range_bytes=100_000).select("read_id", "nametag", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"), F.length("seq").cast("long").alias("bases"))


@query(f"{_FASTQ} SELECT nametag, md5(seq) AS seq, md5(qual) AS qual FROM q")
def fastq_gzip(spark, sf_dir):
    return _fastq(spark, sf_dir, "gzip").select("nametag", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(f"WITH {READS}, n AS (SELECT count(*) AS n, sum(length(seq)) AS bases, 10000000 / sum(2 * length(seq) + length(nametag) + 5) AS ratio FROM reads) SELECT CAST(round(n * ratio) AS BIGINT) AS reads, CAST(round(bases * ratio) AS BIGINT) AS bases FROM n")
def fastq_size(spark, sf_dir):
    """Reads and bases that ten million bytes hold, by a sample of all reads."""
    own = views.reads(spark, sf_dir)
    return fastq.estimated_size(own, own.count(), 10_000_000)


@query(f"WITH {READS} SELECT read_id, concat('r', lower(to_hex(read_id))) AS nametag, CAST(length(seq) AS BIGINT) AS bases FROM reads")
def fastq_names(spark, sf_dir):
    """Reads renamed by hexadecimal ids."""
    return fastq.renamed(views.reads(spark, sf_dir), "r").select("read_id", "nametag", F.length("seq").cast("long").alias("bases"))


_DUMP = {"v": "l_orderkey", "h": "l_suppkey", "strand": "CASE WHEN l_linenumber % 2 = 0 THEN 'n' ELSE 'c' END", "beg_v": "l_linenumber * 10", "end_v": "l_linenumber * 10 + 500", "len_v": "l_linenumber * 10 + 700", "beg_h": "l_partkey % 300", "end_h": "l_partkey % 300 + 500", "len_h": "l_partkey % 300 + 900"}


@query("SELECT 'read' || l_orderkey AS v, 'read' || l_suppkey AS h, " + ", ".join(f"{x} AS {n}" if n == "strand" else f"CAST({x} AS BIGINT) AS {n}" for n, x in _DUMP.items() if n not in ("v", "h")) + " FROM lineitem")
def ladump_named(spark, sf_dir):
    """Triplets of an alignment dump, with their numbers replaced by names that are zipped to them by position."""
    t = cut(views.table(spark, sf_dir, "lineitem").withColumn("id", F.monotonically_increasing_id())).select((F.col("id") * 3 + 2).alias("at"), *[F.expr(x).cast("string").alias(n) for n, x in _DUMP.items()])
    triplet = F.array(F.concat_ws(" ", F.lit("P"), "v", "h", "strand"), F.concat_ws(" ", F.lit("L"), "len_v", "len_h"), F.concat_ws(" ", F.lit("C"), "beg_v", "end_v", "beg_h", "end_h"))
    lines = t.select("at", F.posexplode(triplet).alias("i", "value")).select((F.col("at") + F.col("i")).alias("line_no"), "value")
    rows, ids = formats.ladump(lines)
    placed = cut(numbered(ids, "id", "line_no"))
    names = placed.select("line_no", F.concat(F.lit("read"), "id").alias("name"))
    return formats.renamed(rows, formats.zipped(placed, names))


@query(f"WITH x AS (SELECT {', '.join(f'{field_sql("native", n)} AS {n}' for n in formats.LAYOUTS['native'][1])} FROM lineitem) SELECT v, h, CAST(beg_v AS BIGINT) AS beg_v, CAST(beg_h AS BIGINT) AS beg_h, count(*) AS lines FROM x WHERE least(beg_v, beg_h) + least(len_v - end_v, len_h - end_h) + ((end_v - beg_v) + (end_h - beg_h)) // 2 >= 1200 GROUP BY ALL")
def overlap_filter(spark, sf_dir):
    """Lines whose spans imply an overlap of 1,200 at least."""
    found = evaluate.filtered_by_overlap(formats.parsed(views.tool_lines(spark, sf_dir, "native"), "native"), 1200)
    return found.groupBy("v", "h", "beg_v", "beg_h").agg(F.count("*").alias("lines"))


@query()
def xdrop_seed_extension(spark, sf_dir):
    """Best seeds of pairs extended in the band around the diagonal."""
    own = views.reads(spark, sf_dir)
    chosen = pairs.chosen_of(views.reads(spark, sf_dir)).select("v", "h", "support", "pos_v", "pos_h")
    side = lambda x: own.select(F.col("read_id").alias(x), F.col("seq").alias(f"seq_{x}"))
    return align.align_seeds(chosen.join(side("v"), "v").join(side("h"), "h"), band=15)

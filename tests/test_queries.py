"""Every registered query of the engine against its SQL, on whole tables of the smallest size."""

from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.functions.params import OverlapParams
from helixframe.operators import pairs
from helixframe.plans import overlap, views
from helixframe.plans.queries import ORACLE, QUERIES, SMALL_ORACLE

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE | SMALL_ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(shown(x) for x in r)) for r in df.select(*columns).collect())
    relation = duck.sql((ORACLE | SMALL_ORACLE)[name])
    assert sorted(relation.columns) == columns
    theirs = sorted(repr(tuple(shown(x) for x in r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == types


def test_candidate_pairs_grow_with_the_table(spark):
    assert QUERIES["overlap_candidates"](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["generate_rmat", "generate_random", "generate_erdos_renyi", "generate_cliques", "graph_lloyd"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_estimated_cardinality(spark):
    distinct = QUERIES["kmer_count"](spark, DATA).agg(F.sum("distinct_kmers")).first()[0]
    assert abs(QUERIES["hll_estimate"](spark, DATA).first()[0] - distinct) < 0.05 * distinct


@pytest.fixture(scope="module")
def reads(spark):
    return {r["read_id"]: r["seq"] for r in views.reads(spark, DATA).collect()}


@pytest.fixture(scope="module")
def aligned(spark):
    """All candidate pairs of the smallest size, aligned."""
    return [r.asDict() for r in overlap.overlaps(views.reads(spark, DATA)).collect()]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_alignments_of_all_pairs_are_possible(reads, aligned):
    """Spans, lengths and scores of every pair against its sequences: what a score needs must be there."""
    assert len(aligned) > 800 and sum(r["passed"] for r in aligned) > 10
    for r in aligned:
        v, h = reads[r["v"]], reads[r["h"]]
        h = rc(h) if r["strand"] == "c" else h
        assert (r["len_v"], r["len_h"]) == (len(v), len(h)) and 0 <= r["beg_v"] < r["end_v"] <= len(v) and 0 <= r["beg_h"] < r["end_h"] <= len(h)
        n, m = r["end_v"] - r["beg_v"], r["end_h"] - r["beg_h"]
        assert 17 - 14 <= r["score"] <= min(n, m) - abs(n - m)
        if r["score"] == n == m:
            assert v[r["beg_v"] : r["end_v"]] == h[r["beg_h"] : r["end_h"]]
        ov = min(r["beg_v"], r["beg_h"]) + min(len(v) - r["end_v"], len(h) - r["end_h"]) + (n + m) // 2
        assert r["ov"] == ov and r["passed"] == (r["score"] >= 0.9 * (2 * 0.85**2 - 1) * ov)


def test_scores_of_short_pairs_equal_the_whole_table(reads, aligned):
    """Alignments that the drop never ends: the score is that of the best path through the spans' whole table."""
    some = [r for r in aligned if r["passed"] and r["end_v"] - r["beg_v"] < 700][:25]
    assert some
    for r in some:
        h = rc(reads[r["h"]]) if r["strand"] == "c" else reads[r["h"]]
        a, b = reads[r["v"]][r["beg_v"] : r["end_v"]], h[r["beg_h"] : r["end_h"]]
        row = [-j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [-i]
            for j, y in enumerate(b, 1):
                new.append(max(new[-1] - 1, row[j] - 1, row[j - 1] + (1 if x == y else -1)))
            row = new
        assert r["score"] <= row[-1] <= r["score"] + 2 * 7


def test_lines_and_counters_hold_every_passed_pair(spark, aligned):
    passed = [r for r in aligned if r["passed"]]
    native = sorted(r["value"] for r in QUERIES["overlap_native_lines"](spark, DATA).collect())
    assert native == sorted("\t".join(str(r[c]) for c in ("name_v", "name_h", "shared", "score", "ov", "strand", "beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h")) for r in passed)

    def paf(r):
        beg, end = (r["beg_h"], r["end_h"]) if r["strand"] == "n" else (r["len_h"] - r["end_h"], r["len_h"] - r["beg_h"])
        return "\t".join(map(str, (r["name_v"], r["len_v"], r["beg_v"], r["end_v"], "+" if r["strand"] == "n" else "-", r["name_h"], r["len_h"], beg, end, r["score"], r["ov"], 255)))

    assert sorted(r["value"] for r in QUERIES["overlap_paf_lines"](spark, DATA).collect()) == sorted(map(paf, passed))
    c = QUERIES["xdrop_counters"](spark, DATA).first()
    span = lambda r: ((r["end_v"] - r["beg_v"]) + (r["end_h"] - r["beg_h"])) / 2
    other = [r for r in aligned if not r["passed"]]
    want = (len(aligned), sum(map(span, aligned)), sum(r["len_v"] + r["len_h"] for r in aligned) / 2 / len(aligned), len(passed), sum(map(span, passed)) / len(passed), sum(map(span, other)) / len(other))
    assert [float(x) for x in c] == pytest.approx(want)


def test_bands_and_minimizers_find_most_of_the_same(spark, aligned):
    passed = {(r["v"], r["h"]) for r in aligned if r["passed"]}
    for name in ("overlap_banded", "overlap_minimizers"):
        got = {(r["v"], r["h"]) for r in QUERIES[name](spark, DATA).collect()}
        assert len(got & passed) >= 0.75 * len(passed), name
    assert QUERIES["xdrop_seed_extension"](spark, DATA).count() == len(aligned)


def test_no_sequence_moves_with_a_seed(spark):
    """Until seeds are one a pair, no column of the plan is a sequence."""
    matrix = pairs.reliable_matrix(views.reads(spark, DATA))
    plan = pairs.chosen_seeds(pairs.seed_table(pairs.shared_seeds(matrix), 17))._jdf.queryExecution().optimizedPlan().toString()
    assert "seq" not in plan


def test_an_empty_band_is_an_error(spark):
    few = spark.createDataFrame([(0, "a", "ACGTACGTACGTACGTACGTAA"), (1, "b", "TTTTGGGGCCCCAAAATTTTGG")], "read_id long, nametag string, seq string")
    with pytest.raises(ValueError, match="reliable"):
        overlap.overlaps(few, OverlapParams(lower=5))


@pytest.mark.parametrize("kernel", ["graph_coloring_jones_plassmann", "graph_coloring_largest_degree"])
def test_colorings_of_the_whole_order_graph(spark, kernel):
    """The same rounds with sets and dictionaries."""
    near = defaultdict(set)
    for r in views.order_graph(spark, DATA).collect():
        near[r["src"]].add(r["dst"])
        near[r["dst"]].add(r["src"])
    color, k = dict.fromkeys(near, -1), 0
    while -1 in color.values():
        free = {v for v in near if color[v] == -1}
        key = {v: (v * 7919 % 1009 / 1009 + (len(near[v] & free) if "largest" in kernel else len(near[v])), v) for v in free}
        now = {v for v in free if all(key[v] > key[u] for u in near[v] & free)}
        before = dict(color)
        for v in now:
            before[v] = k
        for v in now:
            used = {before[u] for u in near[v]}
            color[v] = next(c for c in range(k + 1) if c == k or c not in used)
        k += 1
    assert {r["id"]: r["color"] for r in QUERIES[kernel](spark, DATA).collect()} == color

"""Runs of k-mers against the plain way through rows of occurrences."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.params import OverlapParams
from helixframe.operators import kmers, matrix, pairs, superkmers
from helixframe.plans import overlap, views
from helixframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_matrix(reads, params):
    occurrences = kmers.kmer_occurrences(reads, params)
    return matrix.occurrence_matrix(occurrences, kmers.reliable(kmers.kmer_counts(occurrences), params.lower, params.upper))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def reads(spark):
    """Copies, other strands, repeats in a read, letters other than ACGT, a hot word, short, empty, null and negative ids."""
    rng = np.random.default_rng(5)
    genome = "".join(rng.choice(list("ACGT"), 1500))
    out = [genome[i : i + int(n)] for i, n in zip(rng.integers(0, 1300, 60), rng.integers(5, 400, 60), strict=True)]
    out = [s if i % 3 else s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in enumerate(out)]
    out += [genome[:100] + "N" + genome[50:180] + genome[:100], "acgtNNNN" + genome[200:300].lower(), "", None, "AC", "A" * 300, "ACGTTGCA" * 12, genome[:60], genome[:60]]
    return spark.createDataFrame([(i * 7919 % 1000 - 400 + (1 << 40) * (i % 2), s) for i, s in enumerate(out)], "read_id long, seq string")


@pytest.mark.parametrize("params", [OverlapParams(), OverlapParams(k=5, upper=40), OverlapParams(k=1, upper=10**6), OverlapParams(k=12, lower=1, upper=3), OverlapParams(k=31), OverlapParams(n_policy="as_g", upper=20)], ids=str)
def test_runs_give_what_rows_give(reads, params):
    plain = plain_matrix(reads, params)
    assert rows(pairs.matrix_of(reads, params)) == rows(plain)
    assert rows(pairs.candidates_of(reads, params)) == rows(pairs.candidate_pairs(plain))
    assert rows(pairs.statistics_of(reads, params)) == rows(pairs.product_statistics(plain))
    seeds = pairs.seed_table(pairs.shared_seeds(plain), params.k)
    assert rows(pairs.chosen_of(reads, params).drop("len_v", "len_h")) == rows(pairs.chosen_seeds(seeds, params))
    plain = seeds.groupBy("v", "h").agg(F.count("*").alias("seeds"), F.count_if("forward").alias("forward"), F.min("ov").alias("least"), F.max("ov").alias("most"))
    assert rows(pairs.estimates_of(reads, params)) == rows(plain)


def test_compaction_and_small_chunks_change_nothing(reads, monkeypatch):
    params = OverlapParams(upper=6)
    want = rows(pairs.candidate_pairs(plain_matrix(reads, params)))
    sequences = [(r["read_id"], (r["seq"] or "").encode()) for r in reads.collect()]
    data, offsets = np.frombuffer(b"".join(s for _, s in sequences), np.uint8), np.cumsum([0, *(len(s) for _, s in sequences)])
    first, count, _, read, bases = superkmers._runs(data, offsets, params.k, 1, False)
    places = superkmers._spans(first, count)
    ahead, back = superkmers._words(bases, params.k, np.int64)
    ids = np.array([i for i, _ in sequences])
    at = (places - np.repeat(offsets[:-1][read], count)) * 2 + (ahead <= back)[places]
    every = superkmers.Entries(np.minimum(ahead, back)[places], np.repeat(ids[read], count), at, np.zeros(len(at), np.int32))
    parts = [superkmers._compacted(every.take(np.arange(i, len(at), 7)), params.upper) for i in range(7)]
    kept = superkmers._compacted(superkmers.Entries.joined(parts), params.upper)
    assert len(kept.kmer) < len(at)
    monkeypatch.setattr(superkmers, "_MET", 50)
    found = {}
    for v, h, n in superkmers._counts(iter([superkmers.in_band(kept, params.lower, params.upper)]), params.k):
        for x in zip(v.tolist(), h.tolist(), n.tolist(), strict=True):
            found[x[:2]] = found.get(x[:2], 0) + x[2]
    assert sorted((h, n, v) for (v, h), n in found.items()) == want


def test_order_packs_or_sorts():
    rng = np.random.default_rng(2)
    for high in (5, 1 << 20, 1 << 40, 1 << 61):
        columns = [rng.integers(-high, high, 500) for _ in range(4)]
        columns[0][:250] = columns[0][0]
        order = superkmers._order(*columns)
        assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns, strict=True))


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
def test_few_bytes_are_shuffled_per_kmer(spark):
    reads = views.reads(spark, DATA)
    n = kmers.kmer_occurrences(reads).count()
    assert superkmers.deal(reads, OverlapParams(), 16).agg(F.sum(F.length("data"))).first()[0] < 3 * n
    sizes = [superkmers.deal(reads, OverlapParams(), 16, lengths).agg(F.sum(F.length("data"))).first()[0] for lengths in (False, True)]
    assert sizes[0] < 0.85 * sizes[1]
    for name in ("occurrence_matrix", "overlap_candidates", "spgemm_stats", "seed_overlap_estimate", "chain_fold"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Repartition" in line]
        assert "bucket" in plan and all("bucket" in line or "doc_id" in line for line in dealt) and "Join" not in plan, name


def test_candidates_without_alignment_meet_no_sequence(spark):
    """Lengths come with the seeds and names from a narrow table."""
    text = "ACGTTGCAAC" * 3 + "TTGACCATGGCATCAGATTACAGGCT"
    reads = spark.createDataFrame([(i, f"r{i}", text[: 40 + i]) for i in range(3)], "read_id long, nametag string, seq string")
    found = overlap.overlaps(reads, OverlapParams(skip_alignment=True))
    assert "seq_" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["v"], r["h"], r["len_v"], r["len_h"], r["name_h"]) for r in found.collect()} == {(0, 1, 40, 41, "r1"), (0, 2, 40, 42, "r2"), (1, 2, 41, 42, "r2")}


def test_pairs_without_alignment_are_not_written_or_joined_by_a_shuffle(reads, monkeypatch):
    """Only runs of k-mers and packed pairs are shuffled, names are broadcast; an empty band is still an error at once."""
    named = reads.withColumn("nametag", F.concat(F.lit("r"), "read_id"))
    monkeypatch.setattr(overlap, "cut", lambda df: pytest.fail("written"))
    found = overlap.overlaps(named, OverlapParams(skip_alignment=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(bucket") == 2
    want = sorted((r["v"], r["h"], r["shared"], r["ov"], r["len_v"], r["len_h"], f"r{r['v']}", f"r{r['h']}") for r in pairs.chosen_of(reads).collect())
    assert sorted((r["v"], r["h"], r["shared"], r["ov"], r["len_v"], r["len_h"], r["name_v"], r["name_h"]) for r in found.collect()) == want
    with pytest.raises(ValueError, match="reliable"):
        overlap.overlaps(named.limit(0), OverlapParams(skip_alignment=True))


@pytest.mark.parametrize("width", [1, 40, 500])
def test_pairs_that_need_no_fold_equal_the_fold(width):
    rng, params = np.random.default_rng(7), OverlapParams(bin_width=width)
    seeds = [sorted({(int(a), int(a) + int(b)) for a, b in zip(rng.integers(0, rng.choice((9, 30, 900)), n), rng.integers(0, rng.choice((1, 3, 800)), n), strict=True)}) for n in rng.integers(1, 9, 300)]
    flat, begin = [s for own in seeds for s in own], np.cumsum([0, *map(len, seeds)])[:-1]
    at_v, at_h = np.array(flat).T
    ov, ids = rng.integers(0, 60, len(flat)), np.arange(300)
    got = list(zip(*(c.tolist() for c in pairs._chosen_columns(ids, ids + 1, ids, ids, begin, at_v, at_h, ov, params)), strict=True))
    triples = list(zip(at_v.tolist(), at_h.tolist(), ov.tolist(), strict=True))
    ends = [*begin[1:].tolist(), len(flat)]
    assert got == [(*pairs._chosen_row(i, i + 1, triples[a:b], params), i, i) for i, (a, b) in enumerate(zip(begin.tolist(), ends, strict=True))]


def test_seeds_are_computed_some_at_a_time(monkeypatch):
    """Pairs of many seeds: a part has the limit's seeds at most, or one pair, and the parts make the whole."""
    rng, n = np.random.default_rng(4), 40
    pair, size = np.sort(rng.integers(0, n, 3 * n)), rng.integers(1, 400, 3 * n).astype(np.int32)
    rows = [pair, pair + 1000, *(np.full(3 * n, 10**6, np.int32) for _ in range(2)), np.arange(0, 3 * n * 500, 500, dtype=np.int32), rng.integers(0, 10**5, 3 * n).astype(np.int32) * 2 + 1, size]
    every = list(superkmers._seeds_of_pairs(17, *rows))
    monkeypatch.setattr(superkmers, "_SEEDS", 2000)
    parts = list(superkmers._seeds_of_pairs(17, *rows))
    assert len(every) == 1 and all(len(p[0]) == 1 or len(p[5]) <= 2000 for p in parts) and len(parts) > 5
    for i in (0, 1, 2, 3, 5, 6, 7):
        assert np.array_equal(np.concatenate([p[i] for p in parts]), every[0][i])

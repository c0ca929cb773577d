import gzip
import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import probability, seq
from helixframe.functions.params import OverlapParams
from helixframe.operators import evaluate, graph, kmers, matrix
from helixframe.sources import fastq, formats, generate, maf
from helixframe.streaming.kmer_stream import read_stream, running_counts


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def reads_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def slow_kmers(s, k):
    return [(i, min(s[i : i + k], rc(s[i : i + k]))) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def test_kmers_drop_other_letters_and_short_reads(spark):
    seqs = ["ACGTNACGTACGGT", "", None, "ACG", "acgtacgttt"]
    got = kmers.kmer_occurrences(reads_of(spark, seqs), OverlapParams(k=5)).select("read_id", "pos", seq.decode_kmer("kmer")).collect()
    want = {(i, p, w) for i, s in enumerate(seqs) for p, w in slow_kmers((s or "").upper(), 5)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    as_g = kmers.kmer_occurrences(reads_of(spark, ["ACNTA"]), OverlapParams(k=5, n_policy="as_g")).select(seq.decode_kmer("kmer")).first()[0]
    assert as_g == min("ACGTA", rc("ACGTA"))
    assert kmers.kmer_occurrences(reads_of(spark, ["ACGT"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        kmers.require_reliable(kmers.reliable(kmers.kmer_counts(kmers.kmer_occurrences(reads_of(spark, ["ACGTA"]), OverlapParams(k=5))), 2, 8))


def test_compat_minimizers_skip_the_first_window(spark):
    s = generate.random_sequence(200, random.Random(2))
    w, k = 8, 17
    got = sorted(r["pos"] for r in kmers.kmer_occurrences(reads_of(spark, [s]), OverlapParams(window=w, compat=True)).collect())
    code = {c: i for i, c in enumerate("ACGT")}
    keys = []
    for _, x in slow_kmers(s, k):
        n = 1
        for c in x:
            n = n * 4 + code[c]
        keys.append(n % seq.ORDER_MODULUS * seq.ORDER_FACTOR % seq.ORDER_MODULUS)
    want = sorted({min(range(max(w, i - w + 1), i + 1), key=lambda j: (keys[j], j)) for i in range(w, len(keys))})
    assert got == want


def test_sequence_properties(spark):
    df = spark.createDataFrame([(generate.random_sequence(n, random.Random(n)),) for n in range(1, 30)], "s string")
    x = df.select("s", seq.reverse_complement(seq.reverse_complement("s")).alias("twice"), seq.canonical("s").alias("c"), seq.canonical(seq.reverse_complement("s")).alias("d"), seq.decode_kmer(seq.encode_kmer("s")).alias("e"))
    assert x.where("s <> twice OR c <> d OR s <> e").isEmpty()
    assert len(df.select(seq.kmer_bits(seq.encode_kmer(F.lit("ACGT")), 4)).first()[0]) == 64
    with pytest.raises(Exception, match="bad probability"):
        df.select(seq.mapq_from_probability(F.lit(1.5))).collect()


def test_overlap_estimate_is_the_same_after_flipping_both(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        lv, lh = rng.randint(50, 500), rng.randint(50, 500)
        bv, bh = rng.randint(0, lv - 40), rng.randint(0, lh - 40)
        rows.append((bv, bv + 40, lv, bh, bh + 40, lh))
    df = spark.createDataFrame(rows, "bv int, ev int, lv int, bh int, eh int, lh int")
    a = seq.span_overlap("bv", "ev", "lv", "bh", "eh", "lh")
    fv, fh = seq.flipped_span("bv", "ev", "lv"), seq.flipped_span("bh", "eh", "lh")
    assert df.where(a != seq.span_overlap(*fv, "lv", *fh, "lh")).isEmpty()


def test_reliable_bounds():
    assert seq.reliable_bounds(30, 0.15, 17, 0.9)[0] >= 2
    low, high = seq.reliable_bounds(40, 0.02, 17, 0.01)
    assert 2 <= low < high <= 40
    assert seq.slope(0.15) == pytest.approx(0.445)
    # by exact fractions: the terms from the top down, and from two upwards, until the chance is gathered
    p = (1 - Fraction(2, 100)) ** 17
    term = lambda m: math.comb(40, m) * p**m * (1 - p) ** (40 - m)
    upper = next(m for m in range(40, -1, -1) if sum(term(i) for i in range(m + 1, 41)) >= Fraction(1, 100)) + 1
    lower = max(next(m for m in range(2, 42) if sum(term(i) for i in range(2, m)) >= Fraction(1, 100)) - 1, 2)
    assert (low, high) == (lower, upper)


@pytest.fixture
def fastq_file(tmp_path):
    rng = random.Random(6)
    records = [(f"r{i}", s := generate.random_sequence(rng.randint(1, 80), rng), "".join(chr(rng.randint(33, 73)) for _ in s)) for i in range(300)]
    records = [(n, s, "@" + q[1:]) for n, s, q in records]  # quality lines that look like headers
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    return path, records


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_fastq_ranges(spark, fastq_file, size):
    path, records = fastq_file
    got = [(r["read_id"], r["nametag"], r["seq"], r["qual"]) for r in fastq.read_fastq(spark, [str(path), str(path)], size).orderBy("read_id").collect()]
    assert got == [(i, *r) for i, r in enumerate(records + records)]


@pytest.mark.parametrize("size", [17, 64, 200, 4096])
def test_fastq_ranges_with_empty_reads(spark, tmp_path, size):
    """Empty reads, qualities that begin with @ or +, names alike: every range size gives every record once."""
    rng = random.Random(size)
    records = []
    for i in range(200):
        s = generate.random_sequence(rng.choice([0, 0, 1, 2, 30]), rng)
        records.append((f"r{i}", s, "".join(rng.choice("@+I!") for _ in s)))
    path = tmp_path / "e.fastq"
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    got = [tuple(r)[1:] for r in fastq.read_fastq(spark, [str(path)], size).orderBy("read_id").collect()]
    assert got == records and sum(not r[1] for r in records) > 50


def test_fastq_is_written_in_the_order_of_ids(spark, tmp_path):
    rows = [(i, f"n{i}", "ACGT"[: i % 5], "IIII"[: i % 5]) for i in range(500)]
    table = spark.createDataFrame(rows, "read_id long, nametag string, seq string, qual string").repartition(7)
    fastq.write_fastq(table, f"file://{tmp_path}/w", ordered=True)
    files = fastq.files_below(spark, f"file://{tmp_path}/w", ".txt")
    assert [tuple(r) for r in fastq.read_fastq(spark, files, 100).orderBy("read_id").collect()] == rows


def test_fastq_gzip_list_and_messages(spark, fastq_file, tmp_path):
    path, records = fastq_file
    packed = tmp_path / "b.fastq.gz"
    packed.write_bytes(gzip.compress(path.read_bytes()))
    listing = tmp_path / "list.txt"
    listing.write_text(f"{packed}\n")
    assert fastq.read_fastq(spark, fastq.file_list(spark, str(listing))).count() == len(records)
    assert fastq.read_fastq_text(formats.numbered(spark, str(path))).count() == len(records)
    broken = tmp_path / "c.fastq"
    broken.write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_fastq(spark, [str(broken)]).collect()
    with pytest.raises(FileNotFoundError):
        fastq.read_fastq(spark, [str(tmp_path / "none")])
    size = fastq.estimated_size(fastq.read_fastq(spark, [str(path)]), 100, path.stat().st_size).first()
    assert abs(size["reads"] - 300) < 60


def test_matrix_files(spark, tmp_path):
    text = tmp_path / "m.mtx"
    text.write_text("%%MatrixMarket\n% note\n3 4 2\n1 2 0.5\n3 4 2\n")
    want = {(0, 1, 0.5), (2, 3, 2.0)}
    assert {tuple(r) for r in formats.matrix_text(formats.numbered(spark, str(text))).collect()} == want
    binary = tmp_path / "m.bin"
    binary.write_bytes(struct.pack("<3i", 3, 4, 2) + struct.pack("<4i", 0, 2, 1, 3) + struct.pack("<2d", 0.5, 2))
    coo = formats.matrix_binary(spark, str(binary))
    assert {tuple(r) for r in coo.collect()} == want
    lines = [r["value"] for r in formats.market_lines(coo, 3, 4).collect()]
    assert lines == ["%%MatrixMarket matrix coordinate real general", "3 4 2", "1 2 0.5", "3 4 2.0"]
    assert matrix.equal(coo, coo) and not matrix.equal(coo, matrix.one_based(coo))
    assert matrix.is_sorted(coo.withColumn("place", F.col("row")))


def test_ladump_and_names(spark, tmp_path):
    dump = tmp_path / "t.dump"
    dump.write_text("+ P 2\n% P 2\nP 1 315 n\nL 18722 16683\nC 3596 8194 4464 9184\nP 1 20 c\nL 18722 900\nC 1 2 3 4\n")
    rows, ids = formats.ladump(formats.numbered(spark, str(dump)))
    assert [tuple(r) for r in rows.orderBy("h").collect()][1] == (1, 315, "n", 3596, 8194, 18722, 4464, 9184, 16683)
    assert {r["id"] for r in ids.collect()} == {1, 20, 315}
    names = formats.zipped(spark.createDataFrame([(0, 1), (1, 20), (2, 315)], "line_no int, id long"), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "line_no int, name string"))
    assert {(r["v"], r["h"]) for r in formats.renamed(rows, names).collect()} == {("a", "c"), ("a", "b")}


def test_unknown_read_numbers_are_an_error(spark):
    line = "7\t8\t80.0\t1\t0\t0\t10\t20\t0\t0\t10\t20"
    with pytest.raises(Exception, match="no name for read 7"):
        formats.evaluated(spark.createDataFrame([(line,)], "value string"), "mecat", spark.createDataFrame([(8, "x")], "id long, name string")).collect()


def test_short_and_self_pairs(spark):
    pairs = spark.createDataFrame([("a", "a", 9999), ("a", "b", 3000), ("a", "b", 2500), ("b", "c", 10)], "a string, b string, overlap long")
    kept, short = evaluate.kept_pairs(pairs)
    assert kept.count() == 1 and short.count() == 1
    every, _ = evaluate.kept_pairs(pairs, keep_all=True)
    assert every.count() == 2


BLOCK = """a score=42 expect=1e-5 mismap=0.001
s chr1 10 8 + 100 ACGT--ACGT
s read/1 3 9 - 50 ACGTTTAC-T
p !!!!!5555IIIII
"""


def test_maf_formats(spark):
    block = maf.parse_block(BLOCK)
    assert maf.to_axt(block) == ["chr1 11 18 read/1 4 12"]
    assert maf.to_tab(block) == ["chr1\t10\t8\t+\t100\tread/1\t3\t9\t-\t50\t4,0:2,2,1:0,1\t1e-5\t0.001"]
    assert maf.to_psl(block)[0].split("\t")[:9] == ["7", "0", "0", "0", "1", "2", "1", "1", "-"]
    assert maf.to_psl(block)[0].split("\t")[17:] == ["3", "4,2,1,", "3,9,11,", "10,14,17,"]
    sam = maf.to_sam(block)[0].split("\t")
    assert sam[:6] == ["read", "83", "chr1", "11", "30", "3H4=2I2=1D1=38H"] and "NM:i:3" in sam and "AS:i:42" in sam
    assert any(x.startswith(" Identities = 7/10 (70%), Gaps = 3/10 (30%)") for x in maf.to_blast(block))
    assert '<span class="f">' in "".join(maf.to_html(block)) and maf.to_html(block)[0] == "<h3>Alignment score=42, expect=1e-5:</h3>"
    assert sorted(["chr10", "chr2", "chrM", "MT"], key=maf.karyotypic_key) == ["chrM", "chr2", "chr10", "MT"]
    assert maf.mapq("0") == "254" and maf.mapq("1") == "0"
    assert maf.sam_header({"chr2": 5, "chr1": 4}, "ID:x")[1:3] == ["@SQ\tSN:chr1\tLN:4", "@SQ\tSN:chr2\tLN:5"]
    assert maf.parse_block("# only a comment") is None
    rows = maf.converted(spark.createDataFrame([(BLOCK,), ("# no block",)], "value string"), "axt").collect()
    assert [r["value"] for r in rows] == ["chr1 11 18 read/1 4 12"]


def test_maf_file(spark, tmp_path):
    (tmp_path / "x.maf").write_text(f"# head\n\n{BLOCK}\n{BLOCK}\n")
    assert maf.read_maf(spark, str(tmp_path / "x.maf")).count() == 2


EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (7, 7)]


@pytest.fixture(scope="module")
def small_graph(spark):
    e = spark.createDataFrame([(a, b, 1.0 + a) for a, b in EDGES], "src long, dst long, w double")
    v = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(8)], "id long, y double")
    return v, e


def neighbours():
    out = {i: set() for i in range(8)}
    for a, b in EDGES:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_independent_sets(small_graph):
    v, e = small_graph
    near = neighbours()
    first = {r["id"] for r in graph.independent_set(v, e).collect()}
    greedy = set()
    for i in range(8):
        if not near[i] & greedy:
            greedy.add(i)
    assert first == greedy
    for chosen in (graph.weighted_independent_set(v, e), graph.distance_k_set(v, e, 1)):
        got = {r["id"] for r in chosen.collect()}
        assert all(not near[i] & got for i in got) and all(i in got or near[i] & got for i in range(8))
    far = {r["id"] for r in graph.distance_k_set(v, e, 2).collect()}
    assert all(not ({j} | near[j]) & near[i] for i in far for j in far if i != j)


@pytest.mark.parametrize("kernel", [graph.coloring_by_sets, graph.coloring_jones_plassmann, graph.coloring_largest_degree])
def test_colorings(small_graph, kernel):
    v, e = small_graph
    color = {r["id"]: r["color"] for r in kernel(v, e).collect()}
    assert len(color) == 8 and all(color[a] != color[b] for a, b in EDGES if a != b) and min(color.values()) == 0 and max(color.values()) <= 2


def plain_pass(order, near, k):
    """What a pass in order takes, each over k edges from those before."""
    taken, gone = [], set()
    for v in order:
        if v not in gone:
            taken.append(v)
            reach = {v}
            for _ in range(k):
                reach |= {u for x in reach for u in near[x]}
            gone |= reach
    return sorted(taken)


def plain_colors(near):
    color = {}
    for v in sorted(near):
        used = {color[u] for u in near[v] if u < v}
        color[v] = next(c for c in range(len(used) + 1) if c not in used)
    return color


@pytest.mark.parametrize(("size", "broadcast"), [(1, 10**6), (40, 10**6), (40, 0), (10**6, 10**6)])
def test_passes_in_blocks_equal_plain_passes(spark, monkeypatch, size, broadcast):
    """Loops, edges given twice, hubs, negative ids and vertices without edges, with blocks of few edges and of all."""
    monkeypatch.setattr(graph, "PASS_EDGES", size)
    monkeypatch.setattr(graph, "BROADCAST_VERTICES", broadcast)
    rng, n = random.Random(8), 12 if size == 1 else 60
    ids = [rng.choice((-1, 1)) * (10 * i + 3) for i in range(n + 5)]
    pairs = [(rng.choice(ids[:n]), rng.choice(ids[: rng.choice((4, n))])) for _ in range(3 * n)] + [(ids[0], ids[0])]
    weight, near = {v: v % 4 for v in ids}, {v: set() for v in ids}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    v = spark.createDataFrame([(x, float(y)) for x, y in weight.items()], "id long, y double")
    e = spark.createDataFrame(pairs, "src long, dst long")
    heavy = sorted(ids, key=lambda x: (-weight[x], -x))
    taken = lambda df: sorted(r["id"] for r in df.collect())
    assert taken(graph.independent_set(v, e)) == plain_pass(sorted(ids), near, 1)
    assert taken(graph.weighted_independent_set(v, e)) == plain_pass(heavy, near, 1)
    assert taken(graph.distance_k_set(v, e, 2)) == plain_pass(heavy, near, 2)
    assert {r["id"]: r["color"] for r in graph.coloring_by_sets(v, e).collect()} == plain_colors(near)


@pytest.mark.parametrize("kernel", [graph.coloring_by_sets, graph.independent_set, graph.weighted_independent_set, lambda v, e: graph.distance_k_set(v, e, 2)])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, kernel):
    """Each vertex waits for the one before, which took a table or more a vertex."""
    written, cut = [], graph.cut

    def few(df, **options):
        written.append(df)
        assert len(written) < 40
        return cut(df, **options)

    monkeypatch.setattr(graph, "cut", few)
    v = spark.range(120).select("id", (-F.col("id")).alias("y"))
    e = spark.range(119).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert kernel(v, e).count() in (120, 60, 40)


def test_paths_and_components(small_graph, spark):
    v, e = small_graph
    assert {r["id"]: r["level"] for r in graph.breadth_first(e, 0).collect()} == {0: 0, 1: 1, 3: 1, 2: 2}
    assert {r["id"]: r["component"] for r in graph.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2}
    near = {r["id"]: (r["dist"], r["centre"]) for r in graph.nearest_centres(v, e, spark.createDataFrame([(0, 0), (6, 1)], "id long, centre long")).collect()}
    assert near[2] == (3.0, 0) and near[4] == (11.0, 1) and near[7] == (float("inf"), -1)
    state, seeds = graph.lloyd(v, e, spark.createDataFrame([(0, 0), (2, 1)], "id long, centre long"))
    assert state.count() == 8 and seeds.count() == 2


def shortest(edges, seeds):
    """(dist, centre) by vertex, relaxed until nothing changes; seeds: (vertex, dist, centre)."""
    best = {}
    for v, d, c in seeds:
        best[v] = min(best.get(v, (math.inf, 0)), (float(d), c))
    while True:
        new = dict(best)
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in best:
                    new[y] = min(new.get(y, (math.inf, 0)), (best[x][0] + w, best[x][1]))
        if new == best:
            return best
        best = new


@pytest.fixture(scope="module")
def wide_graph(spark):
    """A small random graph with loops and parallel edges beside many pairs that no seed reaches."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(9))) for _ in range(110)] + [(1, 1, 2.0), (1, 2, 9.0), (2, 1, 1.0)]
    lone = [(1000 + 2 * i, 1001 + 2 * i, 1.0) for i in range(2000)]
    ids = sorted({x for a, b, _ in edges + lone for x in (a, b)})
    frames = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges + lone, "src long, dst long, w double")
    return edges, ids, *frames


@pytest.fixture
def rows_written(monkeypatch):
    """Rows of each table of vertices that a graph kernel writes."""
    found, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        if "src" not in out.columns:
            found.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return found


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_distances_write_only_what_is_reached(spark, wide_graph, rows_written, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "BROADCAST_FRONT", broadcast, raising=False)
    edges, ids, v, e = wide_graph
    want = shortest(edges, [(1, 0, 5), (2, 0, 4), (7, 0, 1)])
    got = graph.nearest_centres(v, e, spark.createDataFrame([(1, 5), (2, 4), (7, 1), (5555, 0)], "id long, centre long")).collect()
    assert {r["id"]: (r["dist"], r["centre"]) for r in got} == {i: want.get(i, (math.inf, -1)) for i in ids} and len(got) == len(ids)
    assert max(rows_written) <= 60


def test_lloyd_writes_only_what_is_reached(spark, wide_graph, rows_written):
    edges, ids, v, e = wide_graph
    seeds = [(1, 0), (20, 1), (40, 2)]
    near = shortest(edges, [(i, 0, c) for i, c in seeds])
    border = [x for a, b, _ in edges if a in near and near[a][1] != near[b][1] for x in (a, b)]
    inner = shortest(edges, [(x, 0, near[x][1]) for x in border])
    state, new = graph.lloyd(v, e, spark.createDataFrame(seeds, "id long, centre long"))
    own = {r["id"]: (r["centre"], r["to_border"]) for r in state.collect()}
    assert own == {i: (near.get(i, (0, -1))[1], inner.get(i, (math.inf, 0))[0]) for i in ids}
    assert sorted(rows_written)[-2] <= 60 and max(rows_written) == len(ids)
    best = {c: max((own[x][1], x == s, -x) for x in ids if own[x][0] == c) for s, c in seeds}
    assert {r["centre"]: r["id"] for r in new.collect()} == {c: -k[2] for c, k in best.items()}


def test_generators(spark):
    g = generate.rmat(spark, 6, 4)
    assert g.count() == 4 * 64 and g.where("src = dst OR src < 0 OR src > 63").isEmpty()
    assert generate.random_edges(spark, 10, 50).count() == 50
    assert 0 < generate.erdos_renyi(spark, 30, 0.1).count() < 900
    assert generate.cliques(spark, 40, 5).where("src = dst").isEmpty()
    assert generate.rmat(spark, 6, 4).exceptAll(g).isEmpty()


def test_markov():
    assert probability.expected_overlap(0.85, 17) == pytest.approx(float(np.linalg.inv(np.eye(17) - probability.run_chain(0.85, 17)[:-1, :-1])[0].sum()))
    assert probability.shared_kmer_probability(2, 0.9, 2) == pytest.approx(0.81**2)
    assert probability.several_kmers_probability(500, 0.85, 5, 1) == pytest.approx(probability.shared_kmer_probability(500, 0.85, 5))
    assert probability.several_kmers_probability(500, 0.85, 5, 3) < probability.several_kmers_probability(500, 0.85, 5, 1)


def test_stream_counts(spark, tmp_path):
    reads = spark.createDataFrame([(i, f"r{i}", generate.random_sequence(40, random.Random(i % 3)), "I" * 40) for i in range(12)], "read_id long, nametag string, seq string, qual string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_counts(read_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("kmer_counts").start()
    q.processAllAvailable()
    q.stop()
    batch = kmers.kmer_counts(kmers.kmer_occurrences(reads))
    assert spark.table("kmer_counts").exceptAll(batch).isEmpty() and spark.table("kmer_counts").count() == batch.count()

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing
from helixframe.llm.common import Workspace, written
from helixframe.llm.quality_mcd import STATS, consistency, drop_rejected, estimates, fit, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, docs, rows):
    more = [(900, "a b c a b c\nx\nx\n \n \ny é¿😀 # * ## <>", "en", "s", 1), (901, "a b a b a b\n\na b", "en", "s", 1)]
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([r[:4] for r in more], "doc_id long, text string, lang string, source string"))
    got = [tuple(r[c] for c in ("doc_id", *STATS, "base_failed")) for r in quality_report(table).collect()]
    want = [(r[0], *(c := counts(r[1])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in [*rows, *more]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(900):
        n = int(rng.integers(60, 200))
        w = ["x" * int(k) for k in rng.integers(2, 8, n)]
        w = [f"{x}{j % 97}" for j, x in enumerate(w)]
        bad = i % 30 == 0
        if bad:
            w = [x + "%%%" for x in w]
        out.append((i, " ".join(w), "en" if i % 3 else "de", f"s{i % 2}", bad))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, bad boolean")


def test_outliers_go_and_clean_documents_stay(corpus):
    report = quality_report(corpus).join(corpus.select("doc_id", "bad"), "doc_id")
    assert report.where("kept = bad").isEmpty()
    assert drop_rejected(corpus).columns == corpus.columns
    assert {r["bad"] for r in drop_rejected(corpus).select("bad").distinct().collect()} == {False}


def cov_of(x, floors):
    from helixframe.llm.quality_mcd import floored

    return floored(np.cov(x.T, bias=True), floors)


def test_estimate_equals_exhaustive_subsets_of_tiny_groups(spark):
    """The least determinant over all subsets of h rows, with outliers that pull the plain covariance."""
    rng, floors, groups = np.random.default_rng(3), (1e-3,) * 4, {}
    for gid in range(6):
        x = rng.normal(size=(12, 4)) @ rng.normal(size=(4, 4))
        x[:3] += 60 * rng.normal(size=(3, 4))
        groups[gid] = x
    rows = written(spark.createDataFrame([(g, x.tolist()) for g, own in groups.items() for x in own], "gid long, x array<double>"))
    with Workspace(spark) as work:
        raw, final = estimates(work, rows, True, least_rows=12, h_share=0.75, floors=floors)
        raw, final = ({r["gid"]: r for r in p.collect()} for p in (raw, final))
    for gid, x in groups.items():
        best = min(combinations(range(12), 9), key=lambda c: np.linalg.det(cov_of(x[list(c)], floors)))
        inner = x[list(best)]
        assert raw[gid]["det"] == pytest.approx(np.linalg.det(cov_of(inner, floors)), rel=1e-6)
        assert np.allclose(raw[gid]["centre"], inner.mean(axis=0))
        # corrected, reweighted and corrected again
        off = x - inner.mean(axis=0)
        d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov_of(inner, floors) * consistency(0.75)), off)
        near = x[d <= 11.143]
        assert np.allclose(final[gid]["centre"], near.mean(axis=0))
        assert final[gid]["det"] == pytest.approx(np.linalg.det(cov_of(near, (1e-9,) * 4) * consistency(0.975)), rel=1e-3)


def test_consistency_factors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400_000, 4))
    d = (x**2).sum(axis=1)
    for share in (0.75, 0.975):
        inner = x[d <= np.quantile(d, share)]
        assert 1 / inner.var(axis=0).mean() == pytest.approx(consistency(share), rel=0.01)


def test_estimates_of_groups_are_those_of_their_rows(corpus):
    """Concentration: the centre is the mean of the rows within the reweighting quantile, nearly."""
    from helixframe.llm.quality_mcd import stats_of

    stats = corpus.select("lang", "source", stats_of(corpus["text"]).alias("s"))
    with Workspace(corpus.sparkSession) as work:
        params = {(r["lang"], r["source"]): r for r in fit(work, stats).collect()}
    group = [r["s"] for r in stats.where("lang = 'en' AND source = 's1'").collect()]
    x = np.array([[np.log(s["word_chars"] / s["n_words"]), *(np.log(1 + 100 * s[c] / s["n_words"]) for c in STATS[2:])] for s in group])
    p = params["en", "s1"]
    full = np.zeros((4, 4))
    full[np.triu_indices(4)] = p["inverse"]
    full = (full + full.T) / 2
    d = np.einsum("ij,jk,ik->i", x - p["centre"], full, x - p["centre"])
    assert np.allclose(x[d <= 11.143].mean(axis=0), p["centre"], atol=0.02)


def test_each_statistic_alone_rejects(spark):
    """Texts that pass the base rules and whose only fault is repetition, lines or symbols."""
    clean = lambda i: [f"w{i}x{j}" for j in range(100)]
    texts = [" ".join(clean(i)) for i in range(400)]
    texts += [" ".join(clean(i)[:60] + ["so", "it", "goes", "on"] * 10) for i in (1001, 1002)]
    texts += ["\n".join(clean(i)[:60] + ["again"] * 2 + [f"{w}\nagain" for w in clean(i)[60:98]]) for i in (1003, 1004)]
    texts += [" ".join(w + "%" * (k % 4 == 0) for k, w in enumerate(clean(i))) for i in (1005, 1006)]
    table = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    report = {r["doc_id"]: r for r in quality_report(table).collect()}
    assert not any(r["base_failed"] for r in report.values())
    assert {i for i, r in report.items() if not r["kept"]} == set(range(400, 406))


def test_small_groups_are_pooled_or_kept(spark, empty):
    few = spark.createDataFrame([(i, "word " * 0 + " ".join(f"w{j}x{i}" for j in range(60)), "en", f"s{i}") for i in range(10)], "doc_id long, text string, lang string, source string")
    assert quality_report(few).where("kept").count() == 10
    assert quality_report(empty).count() == 0 and drop_rejected(empty).count() == 0


def rake_brute(cells, wanted):
    """Raking on an array, dimension by dimension, bounded by the cells."""
    keys = list(cells)
    w = {k: float(cells[k]) for k in keys}
    for _ in range(300):
        for d in range(3):
            total = defaultdict(float)
            for k in keys:
                total[k[d]] += w[k]
            for k in keys:
                w[k] = min(cells[k], w[k] * wanted[d][k[d]] / total[k[d]]) if total[k[d]] else 0.0
    return {k: w[k] / cells[k] for k in keys}


def level_brute(have, share, budget):
    """The common level by bisection."""
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(have[v], middle * share[v]) for v in have) < budget else (low, middle)
    return {v: min(have[v], low * share[v]) for v in have}


def test_levels_equal_bisection():
    rng = np.random.default_rng(4)
    for _ in range(200):
        have = {v: float(rng.integers(1, 1000)) for v in range(int(rng.integers(1, 8)))}
        share = {v: float(rng.random() + 0.01) for v in have}
        budget = float(rng.random() * sum(have.values()))
        got, want = mixing.filled(have, share, budget), level_brute(have, share, budget)
        assert all(got[v] == pytest.approx(want[v], rel=1e-6) for v in have)


def test_raking_equals_brute_force_by_both_ways(spark):
    rng = np.random.default_rng(1)
    cells = {(s, x, t): int(rng.integers(50, 500)) for s in "ab" for x in ("en", "de") for t in ("p", "q")}
    keyed = spark.createDataFrame([(*k, n) for k, n in cells.items()], "d_source string, d_lang string, d_topic string, tokens long")
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"p": 0.45, "q": 0.55}}
    for budget in (600.0, 0.8 * sum(cells.values())):
        wanted = []
        for d, name in enumerate(mixing.DIMENSIONS):
            have = Counter()
            for k, n in cells.items():
                have[k[d]] += n
            wanted.append(level_brute(have, targets[name], budget))
        want = rake_brute(cells, wanted)
        for driver_cells in (100, 1):
            got = {tuple(r)[:3]: r["probability"] for r in mixing.rake(keyed, targets, budget, driver_cells=driver_cells).select("d_source", "d_lang", "d_topic", "probability").collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_marginals_meet_their_targets(docs):
    own = docs.where("doc_id < 200 AND lang IS NOT NULL")
    cells = mixing.cells_of(own, budget_share=0.5)
    reached = {(r["dimension"], r["value"]): r for r in mixing.marginals(cells).collect()}
    for c in ("source", "lang"):
        p = {v: r["tokens"] ** mixing.TEMPER for (d, v), r in reached.items() if d == c}
        assert all(reached[c, v]["weight_share"] == pytest.approx(x / sum(p.values()), abs=1e-3) for v, x in p.items())
    total = sum(r["tokens"] for (d, _), r in reached.items() if d == "lang")
    assert sum(r["weight"] for (d, _), r in reached.items() if d == "lang") == pytest.approx(0.5 * total, rel=1e-6)


def test_a_scarce_value_throttles_nothing_whatever_the_size(spark):
    """One stray document of a rare language beside ever more others: the kept share of tokens stays the budget's."""
    for n in (200, 4000):
        table = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', 50) AS text", "if(id = 7, 'rare', 'en') AS lang", "if(id % 3 = 0, 'a', 'b') AS source")
        r = mixing.mixing_report(table).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens"), F.max(F.when(F.col("lang") == "rare", F.col("probability")))).first()
        assert r[0] == pytest.approx(mixing.BUDGET_SHARE, abs=0.01) and r[1] > 0.85


def test_targets_of_absent_values_are_an_error(docs):
    with pytest.raises(ValueError, match="no tokens of source nowhere"):
        mixing.mixing_report(docs, targets={"source": {"s0": 0.5, "nowhere": 0.5}})
    with pytest.raises(ValueError, match="not all zero"):
        mixing.mixing_report(docs, targets={"source": {"s0": 0.0}})
    assert mixing.mixing_report(docs, targets={"source": {"s0": 1.0}}).where("source = 's1' AND tokens > 0 AND chosen").isEmpty()


def test_unsettled_raking_warns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    keyed = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 10), ("b", "x", "q", 10), ("b", "y", "p", 100)], "d_source string, d_lang string, d_topic string, tokens long")
    with pytest.warns(UserWarning, match="settle"):
        mixing.rake(keyed, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 0.5, "q": 0.5}}, 100.0)


def test_decisions_are_stable_and_keep_columns(docs, empty, rows):
    a, b = mixing.sampled(docs), mixing.sampled(docs.repartition(5))
    assert a.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in a.collect()) == sorted(repr(r["doc_id"]) for r in b.collect())
    assert mixing.mixing_report(docs).count() == len(rows)
    assert mixing.mixing_report(empty).count() == 0 and mixing.sampled(empty).count() == 0

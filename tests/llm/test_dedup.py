import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import graph_cc, order_minhash
from helixframe.llm.exact_dedup import PatriciaTrie, dedup_report, drop_copies, owners
from helixframe.llm.graph_cc import components
from helixframe.llm.order_minhash import WHOLE, Sketches, all_linked, drop_near_copies, edits_within, linked, near_report

SPACE = re.compile(r"[\x20\x09-\x0D]")


def norm(text):
    return SPACE.sub("", text or "")


@pytest.mark.parametrize("trie_mb", [64, 0.02, 0])
def test_report_equals_brute_force(docs, rows, trie_mb):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    want = []
    for key, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in own:
            kept = r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            want.append((r[0], best[0], len(own), kept, hashlib.sha256(key.encode()).hexdigest()))
    got = [tuple(r) for r in dedup_report(docs, trie_mb=trie_mb).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_one_row_of_each_text_stays_with_its_columns(docs, rows):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(r[1]) for r in rows})
    assert owners(docs).where("rows > 1").count() >= 3


def test_empty_tables(empty):
    assert dedup_report(empty).count() == 0 and drop_copies(empty).count() == 0
    assert near_report(empty).count() == 0 and drop_near_copies(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_counts_like_a_dictionary(keys):
    trie, want = PatriciaTrie(), defaultdict(int)
    for k in keys:
        trie.add(k, 1, lambda a, b: a + b)
        want[k] += 1
    assert dict(trie.drain()) == dict(want)


def test_spills_take_heavy_subtrees_and_leave_the_rest():
    rng, trie, keys = random.Random(4), PatriciaTrie(), set()
    for _ in range(2000):
        key = b"same start " + bytes(rng.choice(b"abcdefgh") for _ in range(30))
        keys.add(key)
        trie.add(key, (key, b"x" * 100), lambda a, b: a, 100)
    weight = trie.bytes
    assert weight >= len(keys) * 100
    out = {k for k, _ in trie.spill()}
    # whole subtrees, a part of the keys, and the bytes go down by what left
    starts = {k[:12] for k in out}
    assert 0.2 * len(keys) < len(out) < 0.5 * len(keys) and out == {k for k in keys if k[:12] in starts}
    assert 0.5 * weight < trie.bytes < 0.8 * weight
    assert {k for k, _ in trie.drain()} == keys - out and trie.bytes == 0


def test_prefixes_terminals_and_large_values_spill():
    trie = PatriciaTrie()
    for key in (b"", b"a", b"ab", b"abc", b"b" * 5000):
        trie.add(key, (key,), lambda a, b: b, 10)
    seen = []
    while len(seen) < 5:
        before = len(seen)
        seen += [k for k, _ in trie.spill()]
        assert len(seen) > before
    assert sorted(seen) == [b"", b"a", b"ab", b"abc", b"b" * 5000]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 12))
def test_banded_alignment_is_exact(a, b, most):
    d = distance(a, b)
    assert edits_within(a, b, most) == (d if d <= most else None)


def near_brute(rows):
    """Classes by verifying all pairs of different texts."""
    texts = sorted({r[1] or "" for r in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    split = {t: t.encode().split() for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            n, m = len(split[a]), len(split[b])
            if min(n, m) >= 0.8 * max(n, m) and linked(split[a], split[b]):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for r in rows:
        ids[find(r[1] or "")].append(r[0])
    return {t: min((i for i in ids[find(t)] if i is not None), default=None) for t in texts}


def test_near_classes_equal_brute_force(docs, rows):
    want = near_brute(rows)
    got = near_report(docs).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"])) for r in got) == sorted((repr(r[0]), repr(want[r[1] or ""])) for r in rows)


def test_one_row_of_each_class_stays(docs, rows):
    want = near_brute(rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(want[r["text"] or ""]) for r in kept.collect()) == sorted({repr(x) for x in want.values()})


def test_hot_bucket_without_links(spark):
    """Many texts share a long passage and little else: no class, however hot the passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(7))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, passage + " " + " ".join(word() for _ in range(40))) for i in range(150)]
    rows += [(1000 + i, rows[0][1] + f" tail{i}") for i in range(30)]
    out = near_report(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("class_id").count().where("count > 1").collect()
    assert [(r["class_id"], r["count"]) for r in out] == [(0, 31)]


def test_copies_in_a_hot_bucket_are_linked(spark):
    """Pairs of alignment 0.9 that share only a hot passage's buckets link like in a bucket of two."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(7))
    passage, rows = [word() for _ in range(60)], []
    for i in range(60):
        own = [word() for _ in range(60)]
        rows.append((2 * i, " ".join(passage + own)))
        rows.append((2 * i + 1, " ".join(passage + [word() if k % 5 == 2 else w for k, w in enumerate(own)])))
    s = Sketches(pa.array([r[1].encode() for r in rows]))
    met = [i for i in range(60) if s.of(2 * i) & s.of(2 * i + 1)]
    assert len(met) > 50 and all(distance(*(r[1].split() for r in rows[2 * i : 2 * i + 2])) == 12 for i in met)
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - 1 if k % 2 and k // 2 in met else k for k in range(120)}


def near_rule(a, b):
    """The link rule by itself: a full alignment."""
    return 10 * distance(a, b) <= 2 * max(len(a), len(b))


def test_links_equal_the_rule_by_itself():
    rng = random.Random(21)
    got = []
    for n in [100] * 40 + [60] * 40:
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b, edits = list(a), rng.choice([n // 10, n // 5, n // 5, n // 5 + 1])
        for i in rng.sample(range(n), edits):
            b[i] = f"e{i}"
        got.append(linked(a, b))
        assert got[-1] == near_rule(a, b) == (5 * edits <= n)
    assert 20 < sum(got) < 80
    # edits that leave few shingles
    a = [f"w{i}" for i in range(100)]
    b = [f"e{i}" if i >= 30 and (i - 30) % 7 in (0, 3) else w for i, w in enumerate(a)]
    assert linked(a, b) and near_rule(a, b)
    # a phrase that both texts repeat counts as often as it stands there
    phrase = "so it goes".split() * 150
    a, b = (phrase + [f"{x}{i}" for i in range(40)] for x in "xy")
    assert linked(a, b) and near_rule(a, b)


def test_many_alignments_equal_one_by_one():
    rng, pairs = random.Random(1), []
    for _ in range(1500):
        a = [rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 5, 20, 60, 150]))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            i, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            if kind == 1:
                b.insert(i, rng.randrange(9))
            elif b:
                b[i % len(b) : i % len(b) + 1] = [rng.randrange(9)] * (kind == 0)
        if rng.random() < 0.2:
            b = b[5:] + b[:5]
        pairs.append((a, b))
    got = all_linked([(np.array(a, np.int32), np.array(b, np.int32)) for a, b in pairs])
    assert got.tolist() == [linked(a, b) for a, b in pairs] and 300 < got.sum() < 1400


def test_parities_never_exceed_the_edits():
    """The bounds that rule pairs out unverified, against edit distances, also of texts with moved parts."""
    rng, texts = random.Random(8), []
    for _ in range(400):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 7, 30, 64, 90, 130]))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            i, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            if kind == 1:
                b.insert(i, f"w{rng.randrange(90)}")
            elif b:
                b[i % len(b) : i % len(b) + 1] = [f"w{rng.randrange(90)}"] * (kind == 0)
        if rng.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        texts += [a, b]
    s = Sketches(pa.array([" ".join(x).encode() for x in texts]))
    bits, out = s.bits.view(np.uint64), 0
    for i in range(0, len(texts), 2):
        d, apart = distance(texts[i], texts[i + 1]), abs(len(texts[i]) - len(texts[i + 1]))
        differ = np.bitwise_count(bits[i] ^ bits[i + 1])
        assert int(differ[:WHOLE].sum()) + apart <= 2 * d
        if s.ends[i] == s.ends[i + 1]:
            assert int(differ[WHOLE:].sum()) <= 2 * d
            out += int(differ[WHOLE:].sum()) > 0.4 * max(len(texts[i]), len(texts[i + 1]))
    assert out > 40


def test_bags_never_exceed_the_edits():
    """Bags of texts of many lengths, folded to the smaller one, against edit distances; and they come near where words differ."""
    rng, texts = random.Random(9), []
    for _ in range(120):
        a = [f"w{rng.randrange(900)}" for _ in range(rng.choice([100, 129, 260, 500]))] + ["is", "so"] * rng.randrange(80)
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            i, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[i : i + (kind > 0)] = [f"w{rng.randrange(900)}"] * (kind < 2)
        texts += [a, b]
    s, near = Sketches(pa.array([" ".join(x).encode() for x in texts])), 0
    bags = [s.bags.view(np.uint64)[i:j] for i, j in zip(s.bag_offsets, s.bag_offsets[1:])]
    for i in range(0, len(texts), 2):
        x, y = sorted(bags[i : i + 2], key=len)
        assert len(x) * 64 >= 4 * len(texts[i]) or not len(x) or len(x) < len(y)
        if len(x) and len(y) <= 2 * len(x):
            y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
            d, apart = distance(texts[i], texts[i + 1]), abs(len(texts[i]) - len(texts[i + 1]))
            differ = int(np.bitwise_count(x ^ y).sum()) + apart
            assert differ <= 2 * d
            near += differ > 1.4 * d
    assert near > 40


def test_texts_that_repeat_one_phrase_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Heads of other words before a long run of one phrase: the texts share buckets, but their words rule links out."""
    rng, pairs = random.Random(4), []
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(240)] + ["is", "so"] * 280)) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" is so", " is", 20)) for i in range(10)]
    verified = order_minhash._verified
    monkeypatch.setattr(order_minhash, "_verified", lambda work, found, *rest: pairs.append(found.count()) or verified(work, found, *rest))
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i in [*range(60), *range(100, 110)]}
    assert sum(pairs) < 300 < 60 * 59 / 2


@pytest.mark.parametrize("words", [60, 150, 500])
def test_recall_of_candidates_up_to_twenty_percent_edits(words):
    """Pairs that the link rule accepts: random substitutions, insertions and deletions of up to a fifth of the words."""
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(10**9)}"
    for share in (0.05, 0.1, 0.15, 0.18, 0.2):
        texts = []
        for t in range(150):
            a = [word() for _ in range(words)]
            b = list(a)
            for i in rng.sample(range(words), int(words * share)):
                b[i] = word() if t % 2 or rng.random() < 0.6 else rng.choice(["", f"{b[i]} {word()}"])
            texts += [" ".join(a), " ".join(x for x in b if x)]
        s = Sketches(pa.array([x.encode() for x in texts]))
        accepted = [i for i in range(150) if linked(texts[2 * i].split(), texts[2 * i + 1].split())]
        found = sum(bool(s.of(2 * i) & s.of(2 * i + 1)) for i in accepted)
        assert len(accepted) > 100 and found >= (0.87 if share == 0.2 else 0.93) * len(accepted), (share, found, len(accepted))


def test_pairs_with_many_edits_are_linked_end_to_end(spark):
    """Over accepted pairs with 5 to 20 % of their words changed, in one table with a passage that all share."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, rows = [word() for _ in range(30)], []
    for i in range(200):
        a = passage + [word() for _ in range(120)]
        b = list(a)
        for j in rng.sample(range(150), int(150 * (0.05 + 0.15 * i / 199))):
            b[j] = word()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] in (k, k - k % 2) for k in got)
    assert sum(got[2 * i + 1] == 2 * i for i in range(200)) >= 0.95 * 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 140)] + [(200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_join_up_alike_in_one_task_and_in_steps(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i + 1, i) for i in range(500, 560)] + [(7, None)]
    links = spark.createDataFrame(edges, "a long, b long")
    once = {tuple(r) for r in components(links).collect()}
    monkeypatch.setattr(graph_cc, "LOCAL_LINKS", 0)
    assert once == {tuple(r) for r in components(links).collect()}


@pytest.mark.parametrize("parts, rows", [(8, 60_000), (50, 150), (0, 1)])
def test_pivots_that_are_sent_find_all_links_of_a_shared_passage(spark, monkeypatch, parts, rows):
    monkeypatch.setattr(order_minhash, "PIVOT_PARTS", parts)
    monkeypatch.setattr(order_minhash, "PIVOT_ROWS", rows)
    monkeypatch.setattr(order_minhash, "PIVOT_GROWTH", 4)
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, texts = words(60), []
    for c in range(25):
        own = words(30) + passage
        texts += [own, own[:2] + ["edit"] + own[3:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_report(docs).collect()}
    assert not any(linked(texts[i], texts[j]) for i in range(0, 50, 2) for j in range(i + 2, 50, 2))
    assert got == {i: i - i % 2 for i in range(50)}


def test_planted_near_copies_are_found(spark):
    rng = random.Random(8)
    rows, classes = [], {}
    for c in range(40):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(250)]
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(250)] = "edit"
            rows.append((c * 10 + k, " ".join(v)))
            classes[c * 10 + k] = c * 10
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(1))).collect()}
    assert got == classes

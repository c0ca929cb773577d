import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from helixframe.llm.packing import Complements, Encoder, pack, patterns_of, plan_of
from helixframe.llm.shard_shuffle import external_shuffle, shard_report

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def test_fast_ids_equal_the_tokenizer(rows):
    from tokenizers import Tokenizer

    slow, own = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    assert own.fast is not None
    for text in [r[1] or "" for r in rows] + ["<|endoftext|> a", "é¿😀  don't  \t\n x", " " * 5000]:
        assert own.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def checked(packed, rows, capacity=2048):
    encoder = Encoder(VOCABULARY)
    want = Counter()
    for r in rows:
        ids = [*encoder.encode(r[1] or "").tolist(), 0]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % capacity + 1 if at == 0 else capacity
            want[r[0], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(k[3] * n for k, n in want.items())


def test_packing_holds_every_token(docs, rows):
    out = pack(docs, VOCABULARY).collect()
    n, tokens = checked(out, rows)
    assert n <= -(-tokens // 2048) + 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)


def test_exact_complements_are_used():
    assert sorted(patterns_of({1500: 3, 548: 3}, 2048)) == [((1500, 548), 3)]
    assert len(patterns_of({1000: 1, 500: 1, 300: 1, 248: 1}, 2048)) == 1
    assert plan_of({7: 10_000_000}, 2048).sequences == -(-10_000_000 // 292)


def test_fills_are_found_whenever_there_are_any():
    """Single, pair and triple sums against all combinations, while counts fall."""
    rng = random.Random(6)
    for _ in range(60):
        left = [0] + [rng.choice([0, 0, 0, 1, 2]) for _ in range(24)]
        index = Complements(left)
        for _ in range(30):
            gap = rng.randint(1, 24)
            every = [c for k in (1, 2, 3) for c in combinations_with_replacement(range(1, gap + 1), k) if sum(c) == gap and all(left[x] >= c.count(x) for x in c)]
            found = index.fill(gap)
            assert bool(found) == bool(every), (left, gap, found, every)
            if found:
                assert tuple(sorted(found)) in every and len(found) == min(map(len, every))
                for x in found:
                    left[x] -= 1


def test_texts_that_the_fast_encoder_gives_up_on():
    text = " " * 2_000_000
    assert len(Encoder(VOCABULARY).encode(text)) > 0


def test_many_ranks_are_joined_by_a_shuffle(docs, rows, monkeypatch):
    from helixframe.llm import packing

    monkeypatch.setattr(packing, "BROADCAST_RANKS", 0)
    checked(pack(docs, VOCABULARY).collect(), rows)


def test_plans_use_the_histogram_up():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 20))}
        used = Counter()
        for items, times in patterns_of(histogram, 64):
            assert sum(items) <= 64 and times > 0
            for x in items:
                used[x] += times
        assert used == Counter(histogram)
        bins: list[int] = []
        for x in sorted(Counter(histogram).elements(), reverse=True):
            at = next((i for i, b in enumerate(bins) if b + x <= 64), None)
            if at is None:
                bins.append(x)
            else:
                bins[at] += x
        assert plan_of(histogram, 64).sequences <= 1.1 * len(bins) + 1  # first fit, longest first


def test_empty_table(empty):
    assert pack(empty, VOCABULARY).count() == 0 and shard_report(empty).count() == 0


@pytest.mark.parametrize("most_reducers", [4096, 2])
def test_shards_hold_every_row_once(docs, rows, most_reducers):
    out = shard_report(docs, seed=3, bucket_bytes=20_000, most_reducers=most_reducers).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shuffle_is_uniform_and_keeps_columns(spark, docs):
    assert external_shuffle(docs).select("record.*").columns == docs.columns
    n = 4000
    out = external_shuffle(spark.range(n).selectExpr("id AS doc_id", "cast(id AS string) AS text"), seed=1).selectExpr("record.doc_id AS d", "slot * 8 + shard AS p").collect()
    place = np.array([p for _, p in sorted((r["d"], r["p"]) for r in out)])
    assert sorted(place) == list(range(n))
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.06 and abs(np.mean(np.abs(np.diff(place))) / n - 1 / 3) < 0.03


def test_places_hold_when_a_task_runs_again(spark):
    """The same rows in another order within their tasks, as after a lost shuffle, go to the same places."""
    from pyspark.sql import functions as F

    def places(order):
        rows = spark.range(2000).selectExpr("id % 700 AS doc_id", "concat('text ', id % 700) AS text").repartition(5, F.col("doc_id") % 5)
        out = external_shuffle(rows.sortWithinPartitions(order), seed=2, bucket_bytes=1000)
        return Counter((r["record"]["doc_id"], r["shard"], r["slot"]) for r in out.collect())

    once = places("doc_id")
    assert sum(once.values()) == 2000 and places(F.desc("text")) == once


def test_buckets_follow_the_memory_not_the_input(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    for n in (1000, 3000):
        out = external_shuffle(table.where(f"doc_id < {n}"), seed=1, bucket_bytes=10_000)
        assert out.count() == n
    from helixframe.llm.shard_shuffle import LEAST_BUCKET_BYTES, default_bucket_bytes

    assert default_bucket_bytes(spark) >= LEAST_BUCKET_BYTES

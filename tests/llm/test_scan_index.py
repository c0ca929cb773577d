import base64
import gzip
import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.llm import license_patience as lp
from helixframe.llm import pii_weak as pii
from helixframe.llm import token_rollup as tr
from helixframe.llm import warc_index as wi

# --- PII ---

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base(text):
    out = [(m.start(), i, k, m.end()) for i, (k, r) in enumerate(BASE.items()) for m in r.finditer(text or "") if valid(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


TEXTS = [
    "a@b.c_d@e.f x@y..z q@w.e.r.t é@ü.de ñ 5@x.y🙂 a@b.cc", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111  4111  1111",
    "+1 (487) 555-7209+44 20 7946 0958 +1234 +1 2", None, "", "9" * 20000, "1 " * 5000 + "@" + "a." * 5000 + "@b.c" + ".d" * 5000, "page 12, version 4.0 and 3.",
]


def test_base_spans_equal_python(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab@. +-()0123456789é\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [" ".join(rng.choice(["4111111111111111", "10.0.0.1", "+1 487 555 7209", "x@y.org", "-", "7"]) for _ in range(8)) for _ in range(100)]
    out = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("secret")] == want


def test_secrets_are_added_and_plain_numbers_are_not(spark):
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'some words token = "{secret()}" more' for _ in range(60)] + [f"chapter {i} of version {i % 9}.0 holds {i} pages" for i in range(200)] + [f"mail x{i}@host.org now" for i in range(60)]
    out = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(out[i]["n_secret"] == 1 for i in range(60)) and all(out[i]["n_secret"] == 0 for i in range(60, 320))
    clean = pii.redacted(spark.createDataFrame([(1, f'a x@y.org token = "{secret()}" b')], "doc_id long, text string").union(spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string"))).where("doc_id = 1").first()["text"]
    assert clean == 'a [email] token = "[secret]" b'


def test_em_finds_reliable_labelers():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.3
        vote = lambda right: 0 if rng.random() < 0.2 else (1 if (rng.random() < right) == truth else -1)
        counts[vote(0.95), vote(0.9), vote(0.55), vote(0.85), vote(0.9)] += 1
    post, chances, share = pii.reliabilities(dict(counts))
    assert share == pytest.approx(0.3, abs=0.05)
    assert chances[0][1][1] > 0.7 > chances[2][1][1] and chances[0][1][0] < 0.1
    assert pii.reliabilities({})[0] == {} and pii.train([])[-1] == [0.0]


def test_pii_of_messy_and_empty_tables(docs, rows, empty):
    assert pii.pii_report(docs).count() == len(rows) and pii.pii_report(empty).count() == 0


# --- WARC ---


def pages(spark, more=()):
    rng = random.Random(3)
    body = lambda n: "<html>" + "".join(rng.choice("abcdé ") for _ in range(n)) + "</html>"
    big, small = body(2000), body(100)
    rows = [(i, f"https://www.host{i % 7}.example.com/p/{i % 11}?b=2&a={i}", body(rng.randint(0, 3000))) for i in range(300)]
    rows += [(1000 + i, f"http://copy.example/{i}", big) for i in range(40)] + [(2000 + i, "http://copy.example/same", small) for i in range(40)]
    rows += [(3000, None, None), (3001, "", ""), (3002, "not a url [", "x\r\n\r\nWARC/1.1\r\n" * 100), (None, "http://n.example/", "null id"), *more]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows, table = pages(spark)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i is not None and top[h or ""] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    got = [tuple(r) for r in wi.archive_report(spark, table, f"file://{tmp_path}/w").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # the archives are valid by themselves
    kinds = Counter()
    for path in Path(tmp_path, "w/archives").iterdir():
        raw = gzip.decompress(path.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            digest = re.search(rb"sha1:(\w+)", head)[1]
            kind = re.search(rb"WARC-Type: (\w+)", head)[1].decode()
            assert kind == "revisit" or base64.b32encode(hashlib.sha1(rest[:n]).digest()) == digest
            kinds[kind] += 1
            raw = rest[n + 4 :]
    assert kinds == Counter(r[3] for r in want)


def test_urls_with_line_separators_are_found(spark, tmp_path):
    marks = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\t\n\r"
    urls = [f"http://x.example/{i}{m}b" for i, m in enumerate(marks)] + [f"http://[x{m}b" for m in marks] + [f"http://x.example/p{i}" for i in range(50)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.col("url"))
    got = wi.archive_report(spark, table, f"file://{tmp_path}/w").collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    assert all(not set(wi.surt(u)) & set(marks) for u in urls)


def test_lookup_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wi, "ROOT_ROWS", 5)
    rows, table = pages(spark)
    captures = wi.write_archives(table, f"file://{tmp_path}/w", file_bytes=20_000)
    directory = wi.build_index(captures, f"file://{tmp_path}/w", block_lines=10)
    assert directory.count() >= 30
    keys = wi.keys_of(table.where("page_id % 3 = 0")).union(spark.createDataFrame([("no,such)/ 1",), ("zzz",), ("",)], "key string"))
    found = wi.read_records(wi.lookup(keys, directory)).collect()
    want = {r[0]: r for r in rows if r[0] is not None and r[0] % 3 == 0}
    assert {r["page_id"] for r in found} == set(want) and len(found) == len(want)
    assert all(r["kind"] == "revisit" or r["payload"] == (want[r["page_id"]][2] or "").encode() for r in found)


def test_lookup_equals_a_scan_of_the_captures(spark, tmp_path, monkeypatch):
    """Many captures of one key over several blocks, few roots, keys repeated, absent and before or past all."""
    monkeypatch.setattr(wi, "ROOT_ROWS", 3)
    rng = random.Random(4)
    keys = [f"k{rng.randrange(40):03d}" for _ in range(400)] + ["k007"] * 120
    captures = spark.createDataFrame([(k, f"f{i}", i, i + 1) for i, k in enumerate(keys)], "key string, file string, offset long, length long")
    directory = wi.build_index(captures, f"file://{tmp_path}/i", block_lines=10)
    asked = ["k007", "k007", "k000", "k039", "a", "z", "k0075", None] + [f"k{i:03d}" for i in range(0, 40, 3)]
    got = Counter(tuple(r) for r in wi.lookup(spark.createDataFrame([(k,) for k in asked], "key string"), directory).collect())
    assert got == Counter((k, f"f{i}", i, i + 1) for i, k in enumerate(keys) if k in set(asked))
    plan = wi.lookup(captures, directory)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_many_owners_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wi, "BROADCAST_OWNERS", 0)
    rows, table = pages(spark)
    got = wi.archive_report(spark, table, f"file://{tmp_path}/w").groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": len(rows) - 39, "revisit": 39}


def test_keys_and_empty_pages(spark, tmp_path):
    assert wi.surt("https://WWW.Example.com:443/a?z=1&b=2#x") == "com,example)/a?b=2&z=1"
    assert wi.surt("http://m.example.com:8080") == "com,example,m:8080)/"
    keys = [wi.capture_key("http://a.b/", i) for i in (None, 0, 9, 10, 123456)]
    assert keys == sorted(keys)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert wi.archive_report(spark, none, f"file://{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        wi.parse_record(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


# --- licences ---


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = lp.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
        assert lp.patience(a, a) == [(i, i) for i in range(len(a))]


def test_gaps_without_anchors_are_aligned_exactly():
    rng = random.Random(5)
    for n in (5, 40, 300):
        a, b = ([rng.choice("abcd") for _ in range(n)] for _ in range(2))
        pairs = lp._longest_common(a, b)
        assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def brute_finds(words, template, enough):
    """From left to right: the earliest end, over whole windows, at which some stretch aligns well enough; then on."""
    size, out, at = len(template), [], 0
    while at < len(words):
        window = words[at : at + 3 * size]
        end = next((e for e in range(1, len(window) + 1) if longest_common(window[:e], template) >= enough), None)
        if end is None:
            if at + 3 * size >= len(words):
                return out
            at += size
            continue
        start = next(s for s in reversed(range(end)) if longest_common(window[s:end], template) >= enough)
        out.append((at + start, at + end))
        at += end
    return out


def test_scans_equal_brute_force_on_whole_texts():
    """Small alphabets give templates that stand in each other and again and again; each find holds the brute force's."""
    rng = random.Random(9)
    total = 0
    for _ in range(150):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))]
        words: list[str] = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice("xyzab") for _ in range(rng.randint(0, 12))]
            words += [w for w in template if rng.random() < 0.93]
        scanner = lp.Scanner({"t": " ".join(template)}, 0.8)
        got = scanner.finds_of("t", words)
        want = brute_finds(words, template, scanner.enough["t"])
        total += len(got)
        assert bool(got) == bool(want)
        at = 0
        for k, i, j in got:
            assert i >= at and longest_common(words[i:j], template) >= k >= scanner.enough["t"]
            at = j
        # what a find takes in beyond the brute force's shorter one can't hold another whole find
        assert not brute_finds(words[at:], template, scanner.enough["t"])
        assert len(want) - 1 <= len(got) <= len(want)
    assert total > 150


@pytest.mark.parametrize("name", ["MIT-text", "GPL-notice", "Apache-2.0-notice", "BSD-3-Clause-text", "MIT"])
def test_copies_in_a_row_are_all_found(name):
    scanner = lp.Scanner(lp.TEMPLATES, 0.8)
    size = len(scanner.words[name])
    for n in range(1, 11):
        for between in ("", "filler words here ", "x " * 37):
            text = between.join([lp.TEMPLATES[name] + " "] * n)
            own = [x for x in scanner.scan(text, text.encode()) if x[0] == name]
            assert len(own) == n and all(x[3] == 1 for x in own), (n, between)
            assert [x[2] - x[1] for x in own] == [len(lp.TEMPLATES[name].rstrip(".")) for _ in own] and size


def test_templates_are_found_whole_anywhere(spark, docs, rows):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    mit = lp.TEMPLATES["MIT-text"]
    dropped = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    texts = [f"{filler(40)}\n{mit}\n{filler(3000)}", f"{filler(5)} {dropped}", filler(200), f"{mit} {filler(300)} {mit}", "the license of the software is open", None, "", f"{filler(10_000)} Released under the MIT License."]
    out = {r["doc_id"]: r for r in lp.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["license"] for i in range(8)] == ["MIT-text", "MIT-text", None, "MIT-text", None, None, None, "MIT"]
    assert out[0]["coverage"] == 1 and 0.85 < out[1]["coverage"] < 1 and out[3]["n_finds"] == 2
    s = out[0]["finds"][0]
    assert texts[0][s["start"] : s["end"]].startswith("Permission is hereby") and texts[0][s["start"] : s["end"]].endswith("SOFTWARE")
    messy = {r["doc_id"]: r for r in lp.scan_licenses(docs).collect()}
    assert lp.scan_licenses(docs).count() == len(rows) and not any(r["n_finds"] for r in messy.values())
    assert lp.scan_licenses(docs.limit(0)).count() == 0


def test_notices_in_very_long_texts(spark):
    """One notice per thousand words of a long text, and a long template within it."""
    rng = random.Random(12)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long = filler(1500)
    text = f" {lp.TEMPLATES['MIT-text']} ".join(filler(1000) for _ in range(21)) + " " + long
    found = lp.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), lp.TEMPLATES | {"long": long}).first()
    assert [x["template"] for x in found["finds"]] == ["MIT-text"] * 20 + ["long"] and text[found["finds"][-1]["start"] :] == long


# --- token counts ---


def test_rollup_follows_batches(spark, tmp_path):
    r = tr.TokenRollup(spark, f"file://{tmp_path}/r")
    batch = lambda *rows: spark.createDataFrame(list(rows), tr.BATCH)
    assert r.totals().count() == 0
    assert r.commit("1", batch((1, "v", "insert", "a", "en", 10, 0), (2, "v", "insert", "a", "en", 5, 0), (2, "v", "insert", "a", "en", 6, 1), (3, "v", "insert", None, "de", None, 0)))
    assert r.commit("2", batch((1, "v", "revise", "b", "en", 11, 0), (2, "v", "delete", None, None, None, 0), (9, "v", "delete", None, None, 1, 0), (None, "v", "insert", "a", "en", 4, 0), (None, "v", "delete", "a", "en", 1, 0)))
    want = {("b", "en", "v", 1, 11), (None, "de", "v", 1, 0), ("a", "en", "v", 0, 3)}
    assert {tuple(x) for x in r.totals().collect()} == want
    assert not r.commit("2", batch((1, "v", "delete", None, None, None, 0)))
    assert {tuple(x) for x in tr.TokenRollup(spark, f"file://{tmp_path}/r").totals().collect()} == want
    # what a failed try left behind isn't read
    spark.createDataFrame([("x", "x", "x", 1, 1)], tr._DELTA).write.parquet(f"file://{tmp_path}/r/deltas/left")
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.commit("3", spark.createDataFrame([], tr.BATCH)) and {tuple(x) for x in r.totals().collect()} == want


def test_commits_stay_small_over_many_batches(spark, tmp_path):
    """Compaction every three batches against a dictionary; retries of any batch, old or new, do nothing."""
    rng, state = random.Random(3), {}
    r = tr.TokenRollup(spark, f"file://{tmp_path}/r", buckets=4, compact_every=3)
    for b in range(9):
        rows = []
        for i in rng.sample(range(12), 4):
            op = rng.choice(["insert", "delete", "revise"])
            rows.append((i, "v", op, rng.choice("ab"), "en", rng.randrange(50), 0))
            if op == "delete":
                state.pop(i, None)
            else:
                state[i] = rows[-1][3], rows[-1][5]
        batch = spark.createDataFrame(rows, tr.BATCH)
        assert r.commit(f"b{b}", batch)
        if b in (4, 8):
            assert not r.commit(f"b{b}", batch) and not r.commit("b0", batch)
            want = Counter()
            for source, tokens in state.values():
                want[source, "docs"] += 1
                want[source, "tokens"] += tokens
            got = {(x["source"], k): x[k] for x in r.totals().collect() for k in ("docs", "tokens")}
            assert +Counter(got) == +want
            assert len(r.tail()[2]) <= 3 and len(list((tmp_path / "r/states").iterdir())) <= 4


def test_a_batch_that_dies_before_its_log_entry_is_not_there(spark, tmp_path, monkeypatch):
    r = tr.TokenRollup(spark, f"file://{tmp_path}/r")
    batch = spark.createDataFrame([(1, "v", "insert", "a", "en", 10, 0)], tr.BATCH)
    put = tr.TokenRollup._put

    def dies(self, name, value):
        if name.startswith("log/"):
            raise OSError("lost")
        put(self, name, value)

    monkeypatch.setattr(tr.TokenRollup, "_put", dies)
    with pytest.raises(OSError):
        r.commit("1", batch)
    monkeypatch.setattr(tr.TokenRollup, "_put", put)
    assert r.totals().count() == 0 and r.commit("1", batch) and not r.commit("1", batch)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v", 1, 10)]
    # one that dies after it is there, marked or not
    (Path(tmp_path) / "r" / r._id("1")).unlink()
    assert not r.commit("1", batch)


def test_report_equals_brute_force(docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    firsts = {}
    for r in rows:
        if r[0] is not None:
            firsts[r[1] or ""] = min(firsts.get(r[1] or "", r[0]), r[0])
    want = Counter()
    seen = set()
    for i, text, lang, source, _ in rows:
        text = text or ""
        if i is not None and (firsts[text] != i or i in seen):
            continue
        seen.add(i)
        n = len(slow.encode(text, add_special_tokens=False).ids)
        for version, k in (("words", len(text.encode().split())), ("byte_bpe_50k", n + (i is not None))):
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += k
    # rows without an id are inserted each
    got = Counter()
    for r in tr.rollup_report(docs, {"byte_bpe_50k": P.path("byte_bpe_50k.json")}).collect():
        got[r["source"], r["lang"], r["version"], "docs"] = r["docs"]
        got[r["source"], r["lang"], r["version"], "tokens"] = r["tokens"]
    assert got == want
    assert tr.rollup_report(empty, {}).count() == 0

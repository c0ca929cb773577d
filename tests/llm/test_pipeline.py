from collections import defaultdict

import pytest

import corpus_pipeline
from helixframe.llm.common import written
from helixframe.llm.quality_mcd import quality_report

P = pytest.importorskip("public_tokenizers")


def test_stages_work_on_what_the_one_before_kept(spark, rows, tmp_path):
    from tests.llm.conftest import SCHEMA

    table = spark.createDataFrame(rows, SCHEMA)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, sizes = [], []
    good = quality_report(docs).where("kept").count()
    for name, stage in corpus_pipeline.STAGES:
        before = {repr(tuple(r)) for r in docs.collect()}
        docs = written(stage(spark, docs, str(tmp_path)))
        names.append(name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == table.columns and {repr(tuple(r)) for r in docs.collect()} <= before
    assert sizes[0] == good and sizes == sorted(sizes[:4], reverse=True) + sizes[4:]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(packed) == sizes[-1]
    total = defaultdict(int)
    for r in packed:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 2048


def test_stages_equal_brute_force(spark, rows, tmp_path):
    """The first four stages by plain Python: the report's verdicts, equal texts, classes of all pairs, draws of ids."""
    import hashlib

    from helixframe.llm import mixing
    from tests.llm.conftest import SCHEMA
    from tests.llm.test_dedup import near_brute, norm

    docs = spark.createDataFrame(rows, SCHEMA)
    run = lambda name, d: written(dict(corpus_pipeline.STAGES)[name](spark, d, str(tmp_path)))
    shown = lambda rs: sorted(repr(tuple(r)) for r in rs)
    kept = {r["doc_id"] for r in quality_report(docs).where("kept").collect()}
    good = run("quality rules", docs)
    assert shown(good.collect()) == shown(r for r in rows if r[0] in kept and r[1] and len(r[1].split()) >= 50)
    groups = defaultdict(list)
    for r in map(tuple, good.collect()):
        groups[norm(r[1])].append(r)
    unique = run("exact dedup", good)
    assert shown(unique.collect()) == shown(min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values())
    left = [tuple(r) for r in unique.collect()]
    classes = near_brute(left)
    near = run("near dedup", unique)
    assert shown(near.collect()) == shown(r for r in left if classes[r[1]] == r[0])
    chance = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing.mixing_report(near).collect()}
    topics = {r["doc_id"]: (r["source"], r["lang"], r["topic"]) for r in mixing.mixing_report(near).collect()}
    draw = lambda i: int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:12], 16) / 16.0**12
    assert shown(run("mixture", near).collect()) == shown(r for r in near.collect() if draw(r["doc_id"]) < chance[topics[r["doc_id"]]])


def test_an_empty_table_passes_through(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_clashing_names_are_carried(spark, rows, tmp_path):
    """Columns named like those that the stages use themselves."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import SCHEMA

    names = ["record", "id", "node", "rows", "part", "points", "sha", "s", "centre", "inverse", "failed", "d2", "stays", "g_lang", "head", "again", "first_id", "__rows", "__lang", "__s", "__node", "d_topic", "probability", "chosen", "tokens"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.col("doc_id") * 2 + i for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [*SCHEMA.replace(",", "").split()[::2], *names], name
        assert docs.where(" OR ".join(f"`{n}` <> doc_id * 2 + {i}" for i, n in enumerate(names))).isEmpty(), name
    assert docs.count() > 100


def test_registered():
    import __spark_entry__

    every = __spark_entry__.queries()
    assert "pipeline" in every and {n.split("_")[0] for n in every if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(every)

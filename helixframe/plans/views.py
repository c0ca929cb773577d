"""Deterministic views of the driver's tables for the operators: reads, truth intervals, predicted pairs, matrices,
graphs and tool outputs; each beside the same view in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ALPHABET, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files are fewer, as a small single file would be one task; larger inputs stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, nametag, seq: the letters of each whole text mapped onto ACGT."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    letters = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    return docs.select(F.col("doc_id").alias("read_id"), F.concat(F.lit("read"), "doc_id").alias("nametag"), F.translate(letters, _ALPHABET, _BASES).alias("seq"))


READS = f"""reads AS (SELECT doc_id AS read_id, concat('read', doc_id) AS nametag,
  translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')), '{_ALPHABET}', '{_BASES}') AS seq FROM documents)"""


def with_quality(rows: DataFrame) -> DataFrame:
    """rows with `qual`: Phred+33 characters from each base and its place from 1."""

    def run(seqs: pa.Array) -> pa.Array:
        out = []
        for s in seqs.to_pylist():
            b = np.frombuffer(s or b"", np.uint8).astype(np.int64)
            out.append((33 + (b * 7 + np.arange(1, len(b) + 1)) % 41).astype(np.uint8).tobytes().decode("ascii"))
        return pa.array(out, pa.string())

    return rows.withColumn("qual", F.arrow_udf(run, "string")(F.encode("seq", "US-ASCII")))


BASES = READS + """,
bases AS (SELECT read_id, unnest(string_split(seq, '')) AS base, unnest(range(1, length(seq) + 1)) AS pos FROM reads WHERE seq <> ''),
errors AS (SELECT read_id, pow(10.0, -((ascii(base) * 7 + pos) % 41) / 10.0) AS e FROM bases)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, read, start, stop: line items as placements of reads."""
    part, length = F.col("l_partkey") * 10, F.col("l_quantity") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ref"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("read"), part.cast("int").alias("start"), (part + length).cast("int").alias("stop"))


TRUTH = """truth AS (SELECT CAST(l_suppkey AS VARCHAR) AS ref, concat(l_orderkey, '-', l_linenumber) AS read,
  CAST(l_partkey * 10 AS INT) AS start, CAST(l_partkey * 10 + l_quantity * 100 AS INT) AS stop FROM lineitem)"""


def shifted_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements moved by up to 600 bases, as a tool's view of the same reads."""
    by = F.pmod(F.col("l_orderkey") * 37, F.lit(13)) * 50
    part, length = F.col("l_partkey") * 10 + by, F.col("l_quantity") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ref"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("read"), part.cast("int").alias("start"), (part + length).cast("int").alias("stop"))


SHIFTED = """shifted AS (SELECT CAST(l_suppkey AS VARCHAR) AS ref, concat(l_orderkey, '-', l_linenumber) AS read,
  CAST(l_partkey * 10 + (l_orderkey * 37) % 13 * 50 AS INT) AS start, CAST(l_partkey * 10 + (l_orderkey * 37) % 13 * 50 + l_quantity * 100 AS INT) AS stop FROM lineitem)"""


def interval_sql(name: str, source: str, least: int) -> str:
    return f"""{name} AS (SELECT x.read AS a, y.read AS b, CAST(max(least(x.stop, y.stop) - greatest(x.start, y.start)) AS BIGINT) AS overlap
  FROM {source} x JOIN {source} y ON x.ref = y.ref AND x.read <> y.read AND least(x.stop, y.stop) - greatest(x.start, y.start) >= {least} GROUP BY 1, 2)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, val: part by supplier quantities, with repeated places."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))


MATRIX = "m AS (SELECT l_partkey AS row, l_suppkey AS col, l_quantity AS val FROM lineitem)"
MERGED = MATRIX + ", a AS (SELECT row, col, sum(val) AS val FROM m GROUP BY 1, 2)"


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: orders (odd ids) linked with the parts they hold (even ids)."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"), F.col("l_quantity").alias("w"))


ORDER_GRAPH = "e AS (SELECT l_orderkey * 2 + 1 AS src, l_partkey * 2 AS dst, l_quantity AS w FROM lineitem), b AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2)"


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


#: A tool's line from line items: SQL expressions by layout field, the same text in both engines.
_P, _Q, _L = "CAST(l_partkey AS BIGINT)", "CAST(l_quantity AS BIGINT)", "CAST(l_linenumber AS BIGINT)"
FIELDS = {
    "v": "concat('r', l_orderkey)", "h": "concat('r', l_suppkey)", "kmers": f"{_Q} + 1", "score": f"concat('-', {_P})", "ov": f"{_Q} * 40",
    "beg_v": f"{_L} * 10", "end_v": f"{_L} * 10 + {_Q} * 40", "len_v": f"{_L} * 10 + {_Q} * 40 + {_P} % 500",
    "beg_h": f"{_P} % 300", "end_h": f"{_P} % 300 + {_Q} * 41", "len_h": f"{_P} % 300 + {_Q} * 41 + {_L} * 7",
    "ident": "concat(CAST(70 + l_linenumber AS BIGINT), '.5')", "id": f"{_L}", "err": "'0.15'", "shared": f"{_Q}", "str_v": "'0'", "mapq": f"{_P} % 61",
}
STRANDS = {"native": "CASE WHEN l_linenumber % 2 = 0 THEN 'n' ELSE 'c' END", "daligner": "CASE WHEN l_linenumber % 2 = 0 THEN 'n' ELSE 'c' END", "paf": "CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END"}


def field_sql(tool: str, name: str) -> str:
    if name == "strand":
        return STRANDS.get(tool, "CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '1' END")
    if tool == "mecat" and name in ("v", "h"):
        return "CAST(l_orderkey AS VARCHAR)" if name == "v" else "CAST(l_suppkey AS VARCHAR)"
    if tool == "native" and name == "score":
        return _P
    return FIELDS[name]


def tool_lines(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """`value` lines of a tool's layout."""
    from ..sources.formats import LAYOUTS

    sep, names = LAYOUTS[tool]
    fields = [F.expr(field_sql(tool, n).replace("VARCHAR", "STRING")).cast("string") for n in names]
    return table(spark, sf_dir, "lineitem").select(F.concat_ws(sep, *fields).alias("value"))

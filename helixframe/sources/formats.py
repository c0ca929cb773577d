"""Text formats of overlappers, ground truth and matrices: readers from a `value` column of lines, and writers.

The common evaluated shape is (a, b, overlap). Lines that don't have a format's fields are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import divergence, flipped_span, identity_score, percent_score, span_overlap, strand_sign
from ..operators.tables import numbered as in_order

#: Columns of each tool's lines: separator, then the fields in order.
LAYOUTS = {
    "native": ("\t", ["v", "h", "kmers", "score", "ov", "strand", "beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h"]),
    "paf": ("\t", ["v", "len_v", "beg_v", "end_v", "strand", "h", "len_h", "beg_h", "end_h", "score", "ov", "mapq"]),
    "mecat": ("\t", ["v", "h", "ident", "id", "str_v", "beg_v", "end_v", "len_v", "strand", "beg_h", "end_h", "len_h"]),
    "mhap": (" ", ["v", "h", "err", "shared", "str_v", "beg_v", "end_v", "len_v", "strand", "beg_h", "end_h", "len_h"]),
    "blasr": (" ", ["v", "h", "score", "id", "str_v", "beg_v", "end_v", "len_v", "strand", "beg_h", "end_h", "len_h", "mapq"]),
    "daligner": (" ", ["v", "h", "strand", "beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h"]),
}
_INTS = ("kmers", "ov", "beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h")
#: Tools that list each pair once in both directions' stead.
LISTS_BOTH = {"native": True, "paf": True, "mecat": True, "mhap": False, "blasr": False, "daligner": False}


def parsed(lines: DataFrame, tool: str) -> DataFrame:
    """The named fields of each line that has them all; whole numbers as longs."""
    sep, names = LAYOUTS[tool]
    fields = F.split("value", sep)
    rows = lines.where(F.size(fields) == len(names)) if tool == "native" else lines.where(F.size(fields) >= len(names))
    return rows.select(*[(fields[i].try_cast("long") if n in _INTS else fields[i]).alias(n) for i, n in enumerate(names)])


def _estimate() -> Column:
    return span_overlap("beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h")


def evaluated(lines: DataFrame, tool: str, index: DataFrame | None = None, prefix: str = "@") -> DataFrame:
    """(a, b, overlap) of a tool's output without self pairs. Spans of h on the other strand are flipped before the
    overlap is estimated, where the format gives them so. index: (id, name) for tools that number reads."""
    rows = parsed(lines, tool)
    if tool == "native":
        return _named(rows.select(F.col("v").alias("a"), F.col("h").alias("b"), F.col("ov").alias("overlap")))
    if tool in ("paf", "daligner"):
        other = F.col("strand") == ("-" if tool == "paf" else "c")
        beg, end = flipped_span("beg_h", "end_h", "len_h")
        rows = rows.withColumns({"beg_h": F.when(other, beg).otherwise(F.col("beg_h")), "end_h": F.when(other, end).otherwise(F.col("end_h"))})
    if tool == "mecat":
        rows = resolved(rows, index)
    return _named(rows.select(F.col("v").alias("a"), F.col("h").alias("b"), _estimate().alias("overlap")))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b")


def resolved(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Numbers of reads replaced by names; an unknown number is an error. The index grows with the reads, so the
    engine chooses between a broadcast and a shuffle by its size."""
    out = rows
    for side in ("v", "h"):
        own = index.select(F.col("id").cast("string").alias(side), F.col("name").alias("__name"))
        known = F.when(F.col("__name").isNull(), F.raise_error(F.concat(F.lit("no name for read "), F.col(side)))).otherwise(F.col("__name"))
        out = out.join(own, side, "left").withColumn(side, known.cast("string")).drop("__name")
    return out


def read_index(lines: DataFrame) -> DataFrame:
    """(id, name) from lines `number >name`; other lines are sequences."""
    return lines.where(F.col("value").rlike(r"^[0-9]+ >")).select(F.regexp_extract("value", "^([0-9]+) >", 1).cast("long").alias("id"), F.regexp_extract("value", r"^[0-9]+ >(\S+)", 1).alias("name"))


def truth(lines: DataFrame, simulated: bool = False) -> DataFrame:
    """(ref, read, start, stop) from space-separated truth; read names get the @ of their FASTQ."""
    f = F.split("value", " ")
    order = (0, 3, 1, 2) if simulated else (0, 1, 2, 3)
    return lines.where(F.size(f) >= 4).select(f[order[0]].alias("ref"), F.concat(F.lit("@"), f[order[1]]).alias("read"), f[order[2]].cast("int").alias("start"), f[order[3]].cast("int").alias("stop"))


def sam_truth(lines: DataFrame) -> DataFrame:
    """(ref, read, start, stop) of the aligned lines of a SAM file: stop is the position plus the letters."""
    f = F.split("value", "\t")
    return lines.where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 10)).select(f[2].alias("ref"), f[0].alias("read"), f[3].cast("int").alias("start"), (f[3].cast("int") + F.length(f[9])).alias("stop"))


def ladump(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlap rows and the distinct ids from numbered lines (line_no, value) of P/L/C triplets after two headers."""
    body = lines.where("line_no >= 2").withColumn("n", F.floor((F.col("line_no") - 2) / 3)).withColumn("f", F.split("value", " "))
    kind = lambda c: F.max(F.when(F.col("f")[0] == c, F.col("f")))
    t = body.groupBy("n").agg(kind("P").alias("p"), kind("L").alias("l"), kind("C").alias("c"))
    n = lambda name, i: F.col(name)[i].cast("long")
    rows = t.select(n("p", 1).alias("v"), n("p", 2).alias("h"), F.col("p")[3].alias("strand"), n("c", 1).alias("beg_v"), n("c", 2).alias("end_v"), n("l", 1).alias("len_v"), n("c", 3).alias("beg_h"), n("c", 4).alias("end_h"), n("l", 2).alias("len_h"))
    return rows, rows.select(F.col("v").alias("id")).union(rows.select(F.col("h").alias("id"))).distinct()


def zipped(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) by position: tables with line_no and id, and with line_no and name."""
    return ids.join(names, "line_no").select("id", "name")


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with v and h replaced by their names in (id, name)."""
    out = rows
    for side in ("v", "h"):
        out = out.join(names.select(F.col("id").alias(side), F.col("name").alias("__name")), side).drop(side).withColumnRenamed("__name", side)
    return out.select(*rows.columns)


def matrix_text(lines: DataFrame) -> DataFrame:
    """(row, col, val), from 0, of a MatrixMarket-like text: numbered lines (line_no, value), comments with %, a header
    of sizes, then triples from 1."""
    body = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    header = body.agg(F.min("line_no")).first()[0]
    f = F.split(F.trim("value"), r"\s+")
    rows = body.where(F.col("line_no") > F.lit(header if header is not None else -1))
    return rows.select((f[0].cast("long") - 1).alias("row"), (f[1].cast("long") - 1).alias("col"), f[2].cast("double").alias("val"))


def matrix_binary(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) of binary matrices: three 32-bit sizes m, n, nnz, then rows, columns (32-bit) and values
    (doubles). Sizes that aren't positive are an error."""

    def parse(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                m, n, nnz = np.frombuffer(raw, "<i4", 3)
                if min(m, n, nnz) <= 0:
                    raise ValueError("the matrix has no positive size")
                parts = [pa.array(np.frombuffer(raw, "<i4", nnz, 12 + 4 * nnz * i).astype(np.int64)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(np.frombuffer(raw, "<f8", nnz, 12 + 8 * nnz))], names=["row", "col", "val"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "row long, col long, val double")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file whose lines have an order that matters; the file is read whole by a task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "value"))


# --- writers -----------------------------------------------------------------------------------------------------


def native_lines(found: DataFrame) -> DataFrame:
    """`value` lines of passed overlaps: names, shared k-mers, score, overlap, strand and both spans with lengths."""
    return found.select(F.concat_ws("\t", "name_v", "name_h", "shared", "score", "ov", "strand", "beg_v", "end_v", "len_v", "beg_h", "end_h", "len_h").alias("value"))


def paf_lines(found: DataFrame) -> DataFrame:
    """PAF lines; the span of h is on its own strand."""
    beg, end = flipped_span("beg_h", "end_h", "len_h")
    other = F.col("strand") == "c"
    return found.select(F.concat_ws("\t", "name_v", "len_v", "beg_v", "end_v", strand_sign(~other), "name_h", "len_h", F.when(other, beg).otherwise(F.col("beg_h")), F.when(other, end).otherwise(F.col("end_h")), "score", "ov", F.lit(255)).alias("value"))


def overlap_lines(found: DataFrame) -> DataFrame:
    """Six columns of candidates without alignment."""
    return found.select(F.concat_ws("\t", "name_v", "name_h", "shared", "ov", "len_v", "len_h").alias("value"))


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """read, k-mer number and place of an occurrence matrix, ids from 1; k-mers are numbered in their order."""
    ids = in_order(matrix.select("kmer").distinct(), "kmer", "kmer_id")
    return matrix.join(ids, "kmer").select(F.concat_ws("\t", F.col("read_id") + 1, F.col("kmer_id") + 1, "pos").alias("value"))


def market_lines(coo: DataFrame, rows: int, cols: int) -> DataFrame:
    """`value` lines of a MatrixMarket file in order: banner, sizes, triples from 1."""
    n = coo.count()
    spark = coo.sparkSession
    head = spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, 1, f"{rows} {cols} {n}")], "col long, row long, k int, value string")
    body = coo.select((F.col("col") + 1).alias("col"), (F.col("row") + 1).alias("row"), F.lit(2).alias("k"), F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val").alias("value"))
    return head.union(body).orderBy("col", "row", "k").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    """One complete output, by the commit protocol of the file sink."""
    lines.select("value").write.mode("overwrite").text(path)


# --- translators -------------------------------------------------------------------------------------------------


def to_paf(lines: DataFrame, tool: str, index: DataFrame | None = None, error_rate: float = 0.15, size: int = 17) -> DataFrame:
    """PAF columns of another tool's lines. Where a tool gives no alignment score, it is estimated from the overlap."""
    rows = parsed(lines, tool)
    ov, mapq = _estimate(), F.lit("255")
    if tool == "native":
        norm = F.greatest(F.col("end_v") - F.col("beg_v"), F.col("end_h") - F.col("beg_h"))
        sign, score, ov = strand_sign(F.col("strand") == "n"), (norm * divergence("kmers", norm, size)).cast("long"), norm
    elif tool == "mhap":
        sign, score = strand_sign(F.col("strand") == "0"), identity_score(ov, error_rate)
    elif tool == "mecat":
        rows = resolved(rows, index)
        sign, score = strand_sign(F.col("strand") == "0"), percent_score(F.col("ident").cast("double"), ov)
    elif tool == "blasr":
        sign, score, mapq = strand_sign(F.col("strand") == F.col("str_v")), F.substr("score", F.lit(2)), F.col("mapq")
    elif tool == "daligner":
        sign, score = strand_sign(F.col("strand") == "n"), identity_score(ov, error_rate)
    else:
        raise ValueError(f"no translation from {tool}")
    return rows.select("v", "len_v", "beg_v", "end_v", sign.alias("strand"), "h", "len_h", "beg_h", "end_h", score.cast("string").alias("score"), ov.cast("long").alias("ov"), mapq.alias("mapq"))

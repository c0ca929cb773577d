"""FASTQ sources.

Files are cut into byte ranges, one task each; a task starts at the first record that begins in its range and reads
past its end to finish the last one. Ids are global: reads in the order of files and offsets, numbered by the counts
of the ranges before. Gzip files are one range each. Paths are read through Arrow's file systems (local, HDFS, S3, GCS);
`read_fastq_text` takes lines from any Spark text source instead."""

from __future__ import annotations

import gzip
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import cut

READS = "read_id long, nametag string, seq string, qual string"
RANGE_BYTES = 64 << 20
_BLOCK = 4 << 20


def file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a file that lists one a line; an error if it lists none."""
    found = [r["value"].strip() for r in spark.read.text(path).where("length(trim(value)) > 0").collect()]
    if not found:
        raise FileNotFoundError(f"{path} lists no files")
    return found


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


def byte_ranges(paths: list[str], size: int = RANGE_BYTES) -> list[tuple[int, str, int, int]]:
    """(number, path, start, end) of all ranges in order."""
    out: list[tuple[int, str, int, int]] = []
    for path in paths:
        system, local = _system(path)
        info = system.get_file_info(local)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        step = max(1, info.size) if path.endswith(".gz") else size
        out += [(len(out) + i, path, at, min(at + step, info.size)) for i, at in enumerate(range(0, max(1, info.size), step))]
    return out


class _Lines:
    """Lines of a file from an offset on, with the offset of each."""

    def __init__(self, handle, at: int) -> None:
        self.handle, self.at, self.rest, self.done = handle, at, b"", False
        handle.seek(at)

    def next(self) -> tuple[int, bytes] | None:
        while (end := self.rest.find(b"\n")) < 0 and not self.done:
            more = self.handle.read(_BLOCK)
            self.done = not more
            self.rest += more
        if end < 0:
            if not self.rest:
                return None
            line, self.rest = self.rest, b""
        else:
            line, self.rest = self.rest[:end], self.rest[end + 1 :]
        begin, self.at = self.at, self.at + len(line) + (end >= 0)
        return begin, line.rstrip(b"\r")


def _is_record(lines: list[bytes]) -> bool:
    """Whether four lines can be a record, of an empty read too. Sequences begin with neither @ nor +, so lines that begin
    elsewhere in a record can't: a quality line may begin with @, but then a header stands where the sequence should, and
    the line of + begins with no @."""
    return len(lines) == 4 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1]) == len(lines[3]) and lines[1][:1] not in (b"@", b"+")


def parse_record(lines: list[bytes], where: str) -> tuple[str, str, str]:
    """name, sequence, quality; an error that says what is wrong."""
    if len(lines) < 4:
        raise ValueError(f"{where}: the last record has {len(lines)} of 4 lines")
    if lines[0][:1] != b"@":
        raise ValueError(f"{where}: a record must begin with @")
    if lines[2][:1] != b"+":
        raise ValueError(f"{where}: the third line of a record must begin with +")
    if len(lines[1]) != len(lines[3]):
        raise ValueError(f"{where}: sequence and quality differ in length")
    return lines[0][1:].decode(), lines[1].decode(), lines[3].decode()


def records_in(path: str, start: int, end: int):
    """Records that begin in [start, end) of a file."""
    system, local = _system(path)
    with system.open_input_file(local) as raw:
        handle = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        end = 1 << 62 if path.endswith(".gz") else end
        if start:
            lines = _Lines(handle, start - 1)
            lines.next()  # the rest of the line that the range begins in
            ahead: list[tuple[int, bytes]] = []
            while True:
                while len(ahead) < 4 and (x := lines.next()) is not None:
                    ahead.append(x)
                if len(ahead) < 4 or ahead[0][0] >= end:
                    return
                if _is_record([x[1] for x in ahead]):
                    break
                ahead.pop(0)
        else:
            lines, ahead = _Lines(handle, 0), []
        while True:
            while len(ahead) < 4 and (x := lines.next()) is not None:
                if ahead or x[1]:
                    ahead.append(x)
            if not ahead or ahead[0][0] >= end:
                return
            yield parse_record([x[1] for x in ahead], f"{path} at {ahead[0][0]}")
            ahead = []


def read_fastq(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """read_id, nametag, seq, qual of all files."""
    ranges = byte_ranges(paths, range_bytes)
    schema = pa.schema([("number", pa.int64()), ("local", pa.int64()), ("nametag", pa.string()), ("seq", pa.string()), ("qual", pa.string())])

    def scan(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                size = 0
                for local, record in enumerate(records_in(r["path"], r["start"], r["end"])):
                    rows.append((r["number"], local, *record))
                    size += len(record[1])
                    if size > _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    plan = spark.createDataFrame(ranges, "number long, path string, start long, end long").repartition(max(1, len(ranges)), "number")
    # parsed once, then counted and numbered
    found = cut(plan.mapInArrow(scan, "number long, local long, nametag string, seq string, qual string"))
    counts = found.groupBy("number").agg(F.max("local").alias("top"))
    starts = counts.select("number", F.coalesce(F.sum(F.col("top") + 1).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    starts = F.broadcast(starts) if len(ranges) <= 100_000 else starts  # a row for each range
    return found.join(starts, "number").select((F.col("begun") + F.col("local")).alias("read_id"), "nametag", "seq", "qual")


def read_fastq_text(lines: DataFrame) -> DataFrame:
    """Reads from a table (line_no, value) of numbered lines; line numbers are from 0 and without gaps."""
    parts = lines.groupBy(F.floor(F.col("line_no") / 4).alias("read_id")).agg(*[F.max(F.when(F.col("line_no") % 4 == i, F.col("value"))).alias(f"l{i}") for i in range(4)])
    bad = F.when(~F.startswith("l0", F.lit("@")), F.raise_error(F.lit("a record must begin with @"))).when(~F.startswith("l2", F.lit("+")), F.raise_error(F.lit("the third line of a record must begin with +"))).when(F.length("l1") != F.length("l3"), F.raise_error(F.lit("sequence and quality differ in length")))
    return parts.select(F.col("read_id").cast("long"), F.coalesce(bad.cast("string"), F.substr("l0", F.lit(2))).alias("nametag"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def normalised_name(name: Column) -> Column:
    """Without the comment after the first tab or space; `x 1:Y:18:ATC` becomes `x/1`."""
    plain = F.regexp_extract(name, r"^[^\t ]*", 0)
    mate = F.regexp_extract(name, r"^[^\t ]* ([12]):[YN]:[0-9]+:", 1)
    return F.when(mate != "", F.concat(plain, F.lit("/"), mate)).otherwise(plain)


def name_and_direction(name: Column) -> tuple[Column, Column]:
    """The name without its /1 or /2, and 1, 2, or 0 without one."""
    return F.regexp_replace(name, "/[12]$", ""), F.coalesce(F.nullif(F.regexp_extract(name, "/([12])$", 1), F.lit("")).cast("int"), F.lit(0))


def renamed(reads: DataFrame, prefix: str = "") -> DataFrame:
    """Reads named by their ids in hexadecimal."""
    return reads.withColumn("nametag", F.concat(F.lit(prefix), F.lower(F.hex("read_id"))))


def estimated_size(reads: DataFrame, sample: int, total_bytes: int) -> DataFrame:
    """One row: reads and bases that files of total_bytes hold, from the first `sample` reads."""
    first = reads.limit(sample).select(F.length("seq").alias("n"), (2 * F.length("seq") + F.length("nametag") + 5).alias("bytes"))
    ratio = F.lit(total_bytes) / F.sum("bytes")
    return first.agg(F.round(F.count("*") * ratio).cast("long").alias("reads"), F.round(F.sum("n") * ratio).cast("long").alias("bases"))


def write_fastq(reads: DataFrame, path: str, compression: str = "none", ordered: bool = False) -> None:
    """FASTQ files below path; with `ordered` by read_id over all files in the order of their names."""
    rows = reads.orderBy("read_id") if ordered else reads
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "nametag"), "seq", F.lit("+"), "qual")).write.option("compression", compression).text(path)


def files_below(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Paths of the files with an ending right below a folder of any file system, in the order of their names."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    return sorted(x.getPath().toString() for x in found if x.getPath().getName().endswith(ending))

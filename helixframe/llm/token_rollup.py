"""Delta-maintained token counts.

Totals by source, language and tokenizer version are sums of signed deltas, one small table for each committed batch.
A batch inserts, deletes or revises documents; for every (doc_id, version) that it touches, the delta is the new
state less the state before, so a revision that also moves a document to another source subtracts there and adds here.
Partial sums precede every shuffle.

Commits: a batch takes effect through one exclusively created log entry, written last, whose name is its number; of two
writers that try the same number one fails. A batch id that is committed already is ignored, and what a failed try left
behind is never read. States are written by buckets of their keys, and a batch reads only the buckets that it touches.
After `compact_every` batches their states become one snapshot of the last states, their deltas one table of totals, and
their log entries go, so a commit reads at most that many batches and one snapshot, however many batches there were.

Of several rows of a batch for one key that of the largest `seq` counts, then the largest row. A delete of an absent
key does nothing; a revision of one inserts; an insert of a present one revises. Rows with a null id or version have no
state: inserts add their tokens, deletes subtract them, revisions do nothing. Null sources and languages are cells of
their own, null token counts are 0; null, empty and very long texts are counted like others. An empty batch commits an
empty delta; no batches give no totals. Columns besides those of a batch are left out, so none can clash."""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, delete_dir, lean, pieces_of, shared_dir, small, text_buffer, word_bounds, written
from .packing import Encoder

KEY, CELL = ["doc_id", "version"], ["source", "lang", "version"]
BATCH = "doc_id long, version string, op string, source string, lang string, tokens long, seq long"
_STATE = "doc_id long, version string, source string, lang string, tokens long, alive boolean, batch_no long"
_DELTA = "source string, lang string, version string, docs long, tokens long"
BUCKETS, COMPACT_EVERY = 32, 8
#: Texts that several documents share are broadcast up to so many (60 bytes each), and joined by a shuffle beyond.
BROADCAST_TEXTS = 200_000


class TokenRollup:
    """The rollup kept below a folder that all executors share. One writer at a time; buckets: parts that states are
    written in, the same for the life of a rollup."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> None:
        self.spark, self.path, self.buckets, self.compact_every = spark, path.rstrip("/"), buckets, compact_every
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- the log

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._file(folder)):
            return []
        return sorted(n for x in self._fs.listStatus(self._file(folder)) if not (n := x.getPath().getName()).startswith((".", "_")))

    def _put(self, name: str, value: dict) -> None:
        """Creates a small file whole; fails if it is there."""
        out = self._fs.create(self._file(name), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()["value"])

    def tail(self) -> tuple[int, str | None, list[dict]]:
        """The last snapshot's number and folder, and the log entries after it, which are few."""
        snapshots = self._names("snapshots")
        last = int(snapshots[-1].split(".")[0]) if snapshots else 0
        folder = self._get(f"snapshots/{snapshots[-1]}")["folder"] if snapshots else None
        return last, folder, [self._get(f"log/{n}") for n in self._names("log") if int(n.split(".")[0]) > last]

    def _id(self, batch_id: str) -> str:
        return f"ids/{uuid.uuid5(uuid.NAMESPACE_URL, batch_id).hex}.json"

    # --- tables

    def _tables(self, kind: str, schema: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{f}" for f in folders]
        tables = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return functools.reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], schema)

    def _write_states(self, states: DataFrame, folder: str) -> DataFrame:
        path = f"{self.path}/states/{folder}"
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        # files by bucket; a bucket that is large for one task is written by several
        states.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(_STATE + ", bucket int").parquet(path)

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Applies a batch (columns of BATCH); False if it is committed already."""
        last, snapshot, entries = self.tail()
        if self._fs.exists(self._file(self._id(batch_id))) or any(e["id"] == batch_id for e in entries):
            return False
        if len(entries) >= self.compact_every:
            self.compact()
            last, snapshot, entries = self.tail()
        no, folder = last + len(entries) + 1, uuid.uuid4().hex
        rows = rows.select("doc_id", "version", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("seq", F.lit(0)).alias("seq"))
        named = F.col("doc_id").isNotNull() & F.col("version").isNotNull()
        newest = rows.where(named).groupBy(*KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("x"))
        new = newest.select(*KEY, "x.source", "x.lang", F.when(F.col("x.op") == "delete", 0).otherwise(F.col("x.tokens")).alias("tokens"), (F.col("x.op") != "delete").alias("alive"), F.lit(no).cast("long").alias("batch_no"))
        new = self._write_states(new, folder)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
        before = self._states(snapshot, entries)
        before = before if len(touched) == self.buckets else before.where(F.col("bucket").isin(touched))
        old = self._last(before.join(new.select(*KEY), KEY, "left_semi"))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        signed = (
            new.where("alive").select(*CELL, F.lit(1).alias("docs"), "tokens")
            .union(old.select(*CELL, F.lit(-1).alias("docs"), -F.col("tokens")))
            .union(rows.where(~named).select(*CELL, sign.alias("docs"), sign * F.col("tokens")))
        )
        delta = signed.groupBy(*CELL).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        written(delta.where("docs <> 0 or tokens <> 0"), f"{self.path}/deltas/{folder}")
        self._put(f"log/{no:012d}.json", {"id": batch_id, "no": no, "folder": folder})  # fails if another writer was first
        self._mark(batch_id, no)
        return True

    def _mark(self, batch_id: str, no: int) -> None:
        if not self._fs.exists(self._file(self._id(batch_id))):
            self._put(self._id(batch_id), {"id": batch_id, "no": no})

    def compact(self) -> None:
        """Replaces the snapshot and all batches after it by a new snapshot. A try that fails leaves the old one valid."""
        last, snapshot, entries = self.tail()
        if not entries:
            return
        folder = uuid.uuid4().hex
        states = self._last(self._states(snapshot, entries))
        self._write_states(states.select(*KEY, "source", "lang", "tokens", F.lit(True).alias("alive"), F.lit(entries[-1]["no"]).cast("long").alias("batch_no")), folder)
        written(self.totals(), f"{self.path}/deltas/{folder}")
        for e in entries:
            self._mark(e["id"], e["no"])
        self._put(f"snapshots/{entries[-1]['no']:012d}.json", {"folder": folder})
        for e in entries:
            delete_dir(self.spark, f"{self.path}/log/{e['no']:012d}.json")
        for old in [e["folder"] for e in entries] + [snapshot] * (snapshot is not None):
            delete_dir(self.spark, f"{self.path}/states/{old}")
            delete_dir(self.spark, f"{self.path}/deltas/{old}")
        if last:
            delete_dir(self.spark, f"{self.path}/snapshots/{last:012d}.json")

    def _states(self, snapshot: str | None, entries: list[dict]) -> DataFrame:
        return self._tables("states", _STATE + ", bucket int", [snapshot] * (snapshot is not None) + [e["folder"] for e in entries])

    @staticmethod
    def _last(states: DataFrame) -> DataFrame:
        last = states.groupBy(*KEY).agg(F.max(F.struct("batch_no", "source", "lang", "tokens", "alive")).alias("x"))
        return last.where("x.alive").select(*KEY, "x.source", "x.lang", "x.tokens")

    def state(self) -> DataFrame:
        """Present documents: doc_id, version, source, lang, tokens of the last committed state of each key."""
        _, snapshot, entries = self.tail()
        return self._last(self._states(snapshot, entries))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of the cells that aren't empty."""
        _, snapshot, entries = self.tail()
        deltas = self._tables("deltas", _DELTA, [snapshot] * (snapshot is not None) + [e["folder"] for e in entries])
        sums = deltas.groupBy(*CELL).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def count_tokens(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, text_md5, version, tokens: a row for each document and version. Version `words` counts
    words between white space; the others are vocabulary files."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("text_md5", pa.string()), ("version", pa.string()), ("tokens", pa.int64())])

    def count(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            raw = data.tobytes()
            words = [np.diff(word_bounds(part, off)[2]) for _, _, part, off in pieces_of(data, offsets)]
            found = {"words": np.concatenate(words)}
            for version, path in vocabularies.items():
                encoder = Encoder.at(path)
                found[version] = np.array([len(encoder.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))) for i in range(batch.num_rows)], np.int64)
            for version, tokens in found.items():
                own = [batch.column(c) for c in ("doc_id", "source", "lang", "text_md5")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([version] * batch.num_rows), pa.array(tokens, pa.int64())], schema=schema)

    text = F.coalesce(docs["text"], F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.md5(text).alias("text_md5"), F.encode(text, "UTF-8").alias("text"))
    return plain.mapInArrow(lean(count), "doc_id long, source string, lang string, text_md5 string, version string, tokens long")


def rollup_report(docs: DataFrame, vocabularies: dict[str, str], path: str | None = None) -> DataFrame:
    """Loads all documents, takes back all but the first of equal texts, revises the vocabulary counts by the end
    token of every document that stays, sends the second batch again, and gives the totals."""
    spark = docs.sparkSession
    change = lambda df, op: df.select("doc_id", "version", F.lit(op).alias("op"), "source", "lang", "tokens", F.lit(0).cast("long").alias("seq"))
    rollup = TokenRollup(spark, path or shared_dir(spark))
    with Workspace(spark) as work:
        counts = work.written(count_tokens(docs, vocabularies))
        rollup.commit("load", change(counts, "insert"))
        ids = counts.groupBy("text_md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        firsts = small(work.written(ids.select("text_md5", "first")), BROADCAST_TEXTS)
        copies = work.written(counts.join(firsts, "text_md5").where("doc_id <> first"))
        rollup.commit("copies", change(copies, "delete"))
        kept = rollup.state().where(F.col("version") != "words")
        rollup.commit("end token", change(kept.withColumn("tokens", F.col("tokens") + 1), "revise"))
        rollup.commit("copies", change(copies, "delete"))
    return rollup.totals()

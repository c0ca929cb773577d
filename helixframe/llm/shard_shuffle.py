"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters every record uniformly, by a seeded hash of its place, into buckets whose size is bounded by
`bucket_bytes` on average: by default a share of an executor core's memory, whatever the input's size. Pass two runs a
Fisher-Yates shuffle over each bucket, shuffle() of its array, and writes it. A record's global position is the rows of the
buckets before plus its place in its own bucket; position modulo the number of shards is its shard, so row counts are at
most one apart (law `rows`), and the quotient is its slot.

Buckets are reducers while there are at most `MOST_REDUCERS`; beyond, a first scatter writes groups of buckets, and the
second deals each group's rows to its own buckets, so a map task meets few of the reducers. A record's place is that
in its input task in the order of a hash of all its columns, so a task that runs again deals the same rows to the same
buckets in whatever order they arrive; rows with equal hashes are interchangeable.

Hot keys, repeated rows, equal texts and null ids scatter like others. A null text has no bytes; a text larger than a
bucket makes its bucket larger. An empty table gives an empty result. All columns are carried as they are in the struct
`record`, so no name can clash."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import prefix_sums
from .common import Workspace, shared_dir, small, written

#: Shares of an executor core's memory that a bucket takes: its rows are there several times while they are shuffled.
MEMORY_PARTS, LEAST_BUCKET_BYTES = 64, 4 << 20
MOST_REDUCERS = 4096
#: Bucket offsets are broadcast up to so many buckets (16 bytes each), and joined by a shuffle beyond.
BROADCAST_BUCKETS = 100_000


def default_bucket_bytes(spark: SparkSession) -> int:
    """What a bucket may hold, from the memory and cores of an executor."""
    conf = spark.sparkContext.getConf()
    local = conf.get("spark.master", "").startswith("local")
    size = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").strip().lower()
    number, unit = re.fullmatch(r"([0-9]+)([kmgt]?)b?", size).groups()
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(LEAST_BUCKET_BYTES, (int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]) // max(1, cores) // MEMORY_PARTS)


def external_shuffle(docs: DataFrame, text_col: str = "text", shards: int = 8, seed: int = 0, bucket_bytes: int | None = None, path: str | None = None, most_reducers: int = MOST_REDUCERS) -> DataFrame:
    """Writes docs shuffled below path (a new shared folder by default); returns record (struct), shard, slot."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / (bucket_bytes or default_bucket_bytes(spark))))
    # a hash can't take maps, whose order isn't defined; their text can
    content = [F.to_json(F.struct(docs[c])) if "map<" in t else docs[c] for c, t in docs.dtypes]
    settled = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), F.xxhash64(*content).alias("content")).sortWithinPartitions("content")
    place = F.monotonically_increasing_id()
    scattered = settled.select(F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets)).cast("int").alias("bucket"), F.struct(F.xxhash64(F.lit(seed + 1), place).alias("order"), F.col("record")).alias("item"))
    with Workspace(spark) as work:
        if buckets > most_reducers:
            groups = math.ceil(math.sqrt(buckets))
            scattered = work.written(scattered.repartition(groups, F.floor(F.col("bucket") / groups)))
        filled = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list("item").alias("items"))
        by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
        # maps can't be compared, so a record with one needs the slower form
        ordered = F.array_sort("items", by_order) if "map<" in str(docs.dtypes) else F.array_sort("items")
        shuffled = filled.select("bucket", F.size("items").alias("rows"), F.shuffle(ordered, seed).alias("items"))
        table = written(shuffled.select("bucket", "rows", F.posexplode("items").alias("place", "item")).select("bucket", "rows", "place", F.col("item.record").alias("record")), path or shared_dir(spark))
        counts = table.groupBy("bucket").agg(F.max("rows").cast("long").alias("rows"))
        # blocks of buckets are summed first, so that one row a block passes through a single task
        starts = work.kept(prefix_sums(counts, "bucket", "rows").select("bucket", F.col("total_before").alias("start")))
    position = F.col("start") + F.col("place")
    return table.join(small(starts, BROADCAST_BUCKETS), "bucket").select("record", F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 8, seed: int = 0, **parameters) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    out = external_shuffle(docs.select("doc_id", "text"), "text", shards, seed, **parameters)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

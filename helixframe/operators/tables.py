"""Tables written between the rounds of an iteration, so plans stay short and lost executors cost one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_made: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new folder's URI in the shared folder (spark.checkpoint.dir; a temp folder in local tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="helixframe-rounds-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        top = "file://" + _own[0]
    return f"{top.rstrip('/')}/round-{uuid.uuid4().hex}"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df computed once and read back from the shared folder. options: of the Parquet writer."""
    path = shared_path(df.sparkSession)
    _made.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables of rounds that this driver has written; call it when the results are consumed."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, key: str | Column, name: str) -> DataFrame:
    """df with `name`, the place of each row from 0 in the order of a unique key. Ranges of the key are numbered each by
    itself and shifted by the rows of the ranges before, so only one row a range passes through a single task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key).withColumn("__range", F.spark_partition_id())
    local = cut(ranged.withColumn("__local", F.row_number().over(Window.partitionBy("__range").orderBy(key))))
    sizes = local.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return local.join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__local") - 1).cast("long")).drop("__range", "__local", "__start")

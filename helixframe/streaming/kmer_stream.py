"""Blockwise counting: reads that arrive in files are counted as a stream of bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.params import OverlapParams
from ..operators.kmers import kmer_counts, kmer_occurrences


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Reads (read_id, nametag, seq, qual) from Parquet files as they come."""
    return spark.readStream.schema("read_id long, nametag string, seq string, qual string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_counts(reads: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """(kmer, cnt) so far; for an output mode of complete or update. The state is one row a distinct k-mer."""
    return kmer_counts(kmer_occurrences(reads, params))

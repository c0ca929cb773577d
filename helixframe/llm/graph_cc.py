"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, delete_dir, lean, shared_dir, written

#: Up to so many links (16 bytes each) between numbers are joined up in one task, which costs less than one step does.
LOCAL_LINKS = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links between numbers, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        # greater roots are hung below lesser ones, and then all nodes below their roots
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _local(links: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def join_up(batches):
        parts = list(batches)
        if parts:
            found = least_reached(*(np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in "ab"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    return links.coalesce(1).mapInArrow(lean(join_up), "node long, component long")


def components(links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """links (a, b) of any orderable type; gives node and component (its least node) of every linked node. Links with a
    null end and links of a node with itself say nothing; repeated links count once; no links give no rows. work: the
    workspace that deletes the table behind the result.

    Up to LOCAL_LINKS links between longs are joined up in one task. Beyond, each step is two aggregations and joins by key,
    written to the shared folder, so neither a large component nor a long chain is ever gathered in one task; a hot node's
    rows are split by the skew join."""
    spark = links.sparkSession
    path = shared_dir(spark)
    if all(kind == "bigint" for _, kind in links.select("a", "b").dtypes):
        own = links.where("a <> b").select("a", "b")
        if own.count() <= LOCAL_LINKS:
            if work is not None:
                work.paths.append(path)
            return written(_local(own), path)
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = shared_dir(spark)
        large = written(large, step)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = shared_dir(spark)
        edges = written(small, new)
        delete_dir(spark, step)
        delete_dir(spark, path)
        path = new
    if work is not None:
        work.paths.append(path)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Sparse matrices as coordinate tables (row, col, val)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import nearly_equal


def merge_duplicates(coo: DataFrame, add: Callable[[str], Column] = F.sum) -> DataFrame:
    """One entry for each place; `add` aggregates the values of a place."""
    return coo.groupBy("row", "col").agg(add("val").alias("val"))


def occurrence_matrix(occurrences: DataFrame, kmers: DataFrame) -> DataFrame:
    """(read_id, kmer, pos, forward, length) for the given k-mers: of several places in a read the last stays. Other k-mers
    go first; places are merged where the join has left them, by k-mer, which also serves a join of the result by k-mer."""
    given = occurrences.join(kmers.select("kmer"), "kmer", "left_semi")
    # the place and its strand in one number, so that sums are hashed
    last = given.groupBy("kmer", "read_id").agg(F.max(F.col("pos").cast("long") * 2 + F.col("forward").cast("long")).alias("at"), F.max("length").alias("length"))
    return last.select("read_id", "kmer", F.shiftright("at", 1).cast("int").alias("pos"), (F.col("at") % 2 == 1).alias("forward"), "length")


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def one_based(coo: DataFrame) -> DataFrame:
    return coo.select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "val")


def spgemm(a: DataFrame, b: DataFrame, multiply: Callable[[Column, Column], Column] | None = None, add: Callable[[Column], Column] = F.sum, where: Column | None = None) -> DataFrame:
    """a times b under a semiring: `multiply` combines two values, `add` aggregates products. where: a condition on
    i and j, the result's row and column, applied inside the join. A product of n entries a key costs n rows, so hot
    inner keys are split by the skew join; partial sums precede the second shuffle."""
    multiply = multiply or (lambda x, y: x * y)
    left = a.select(F.col("row").alias("i"), F.col("col").alias("__k"), F.col("val").alias("__x"))
    right = b.select(F.col("row").alias("__k"), F.col("col").alias("j"), F.col("val").alias("__y"))
    joined = left.join(right, "__k")
    joined = joined.where(where) if where is not None else joined
    products = joined.select("i", "j", multiply(F.col("__x"), F.col("__y")).alias("__z"))
    return products.groupBy("i", "j").agg(add(F.col("__z")).alias("val")).select(F.col("i").alias("row"), F.col("j").alias("col"), "val")


def flops_by_column(a: DataFrame, b: DataFrame) -> DataFrame:
    """(col, flops): products that each column of a times b takes. Counts are joined, not entries."""
    sizes = a.groupBy(F.col("col").alias("row")).agg(F.count("*").alias("n"))
    return b.join(sizes, "row").groupBy("col").agg(F.sum("n").alias("flops"))


def symbolic_nonzeros(a: DataFrame, b: DataFrame) -> DataFrame:
    """(col, nnz): distinct rows of each column of a times b."""
    left = a.select(F.col("row").alias("i"), F.col("col").alias("k"))
    right = b.select(F.col("row").alias("k"), F.col("col").alias("j"))
    return left.join(right, "k").select("i", "j").distinct().groupBy(F.col("j").alias("col")).agg(F.count("*").alias("nnz"))


def submatrix(coo: DataFrame, rows: DataFrame, cols: DataFrame, repeats: bool = True) -> DataFrame:
    """Entries of the listed rows and columns (tables with id), renumbered by their place in the lists. With repeats a
    listed id that comes twice gives its entries twice; without, the lists count as sets and ids stay."""
    if not repeats:
        r, c = rows.select(F.col("id").alias("row")).distinct(), cols.select(F.col("id").alias("col")).distinct()
        return coo.join(r, "row", "left_semi").join(c, "col", "left_semi").select("row", "col", "val")
    r, c = rows.select(F.col("id").alias("row"), F.col("place").alias("new_row")), cols.select(F.col("id").alias("col"), F.col("place").alias("new_col"))
    return coo.join(r, "row").join(c, "col").select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val")


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Places where the matrices differ beyond the tolerance (absent counts as zero): row, col, a, b, diff."""
    x = a.select("row", "col", F.col("val").cast("double").alias("a"))
    y = b.select("row", "col", F.col("val").cast("double").alias("b"))
    both = x.join(y, ["row", "col"], "full").fillna(0.0, ["a", "b"])
    return both.where(~nearly_equal("a", "b", tolerance)).withColumn("diff", F.abs(F.col("a") - F.col("b")))


def equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> bool:
    return differences(a, b, tolerance).isEmpty()


def largest_differences(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """The n places that differ most, ties by place."""
    return differences(a, b, 0.0).orderBy(F.desc("diff"), "row", "col").limit(n)


def sorted_in_columns(coo: DataFrame) -> DataFrame:
    """The matrix partitioned by column with rows in order."""
    return coo.repartition("col").sortWithinPartitions("col", "row")


def is_sorted(ordered: DataFrame) -> bool:
    """Whether the row ids of each column ascend in the order of the column `place`."""
    step = F.lag("row").over(Window.partitionBy("col").orderBy("place"))
    return ordered.withColumn("before", step).where(F.col("before") > F.col("row")).isEmpty()


def prefix_sums(counts: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """counts with `total_before` and `total`: running sums of `value` in the order of a dense integer column. Blocks are
    summed first, so only one row a block passes through a single task."""
    own = counts.withColumn("__block", F.floor(F.col(order) / block))
    blocks = own.groupBy("__block").agg(F.sum(value).alias("__sum"))
    starts = blocks.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = own.join(starts, "__block").withColumn("total", (F.col("__start") + inside).cast("long"))
    return out.withColumn("total_before", F.col("total") - F.col(value)).drop("__block", "__start")


def stages(counts: DataFrame, order: str, value: str, budget: int) -> DataFrame:
    """counts with the stage that a budget of products puts each row in."""
    return prefix_sums(counts, order, value).withColumn("stage", F.floor(F.col("total_before") / budget).cast("long"))

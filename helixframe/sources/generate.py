"""Generators of graphs and sequences. Every row derives from its number and the seed, so lost tasks repeat alike."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column | int) -> Column:
    """A number in [0, 1) from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def rmat(spark: SparkSession, scale: int, edge_factor: int = 8, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0, vary: float = 0.05) -> DataFrame:
    """(src, dst, w): 2**scale vertices and edge_factor times as many edges. At each level an edge falls into a
    quadrant by the shares, which are varied by up to `vary` and normalised; loops are drawn again."""
    edges = spark.range(edge_factor << scale).select(F.col("id"), F.lit(0).alias("attempt"))

    def quadrant(level: Column) -> Column:
        shares = [share * (1 - vary + 2 * vary * _uniform(seed, F.col("id"), F.col("attempt"), level, i)) for i, share in enumerate((a, b, c, 1 - a - b - c))]
        draw = _uniform(seed + 1, F.col("id"), F.col("attempt"), level) * (shares[0] + shares[1] + shares[2] + shares[3])
        return F.when(draw < shares[0], 0).when(draw < shares[0] + shares[1], 1).when(draw < shares[0] + shares[1] + shares[2], 2).otherwise(3)

    def placed(rows: DataFrame) -> DataFrame:
        """The quadrants of all levels, then the vertex numbers that their halves spell."""
        drawn = rows.withColumn("levels", F.transform(F.sequence(F.lit(1), F.lit(scale)), quadrant))
        spelt = lambda bit: F.aggregate("levels", F.lit(0).cast("long"), lambda acc, x: acc * 2 + bit(x))
        return drawn.select("id", "attempt", spelt(lambda x: F.floor(x / 2)).alias("src"), spelt(lambda x: x % 2).alias("dst"))

    done, todo = None, edges
    for _ in range(64):
        tried = placed(todo)
        good = tried.where("src <> dst")
        done = good if done is None else done.union(good)
        todo = tried.where("src = dst").select("id", (F.col("attempt") + 1).alias("attempt"))
        if scale < 1 or todo.isEmpty():
            break
    return done.select("src", "dst", _weight(seed, F.col("id")))


def _weight(seed: int, key: Column, most: int = 100) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed + 7), key), F.lit(most)) + 1).cast("double").alias("w")


def random_edges(spark: SparkSession, vertices: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst, w): so many edges with ends drawn uniformly."""
    end = lambda i: F.floor(_uniform(seed, F.col("id"), i) * vertices).cast("long")
    return spark.range(edges).select(end(0).alias("src"), end(1).alias("dst"), _weight(seed, F.col("id")))


def erdos_renyi(spark: SparkSession, vertices: int, p: float, seed: int = 0) -> DataFrame:
    """(src, dst, w): each ordered pair of vertices with chance p. Pairs are numbered, so none is stored."""
    pairs = spark.range(vertices * vertices).select(F.expr(f"id div {vertices}").alias("src"), (F.col("id") % vertices).alias("dst"), "id")
    return pairs.where(_uniform(seed, F.col("id")) < p).select("src", "dst", _weight(seed, F.col("id")))


def cliques(spark: SparkSession, vertices: int, largest: int, inter: float = 0.5, seed: int = 0) -> DataFrame:
    """(src, dst, w): vertices cut into cliques of 1 to `largest`, all pairs within each, and links between cliques at
    doubling distances with a chance that starts at `inter` and halves."""
    starts, at, draw = [], 0, random.Random(seed)
    while at < vertices:
        starts.append(at)
        at += draw.randint(1, largest)
    sizes = [min(b, vertices) - a for a, b in zip(starts, [*starts[1:], vertices], strict=True)]
    table = spark.createDataFrame(list(zip(range(len(starts)), starts, sizes, strict=True)), "clique long, start long, size long")
    member = table.select("clique", "start", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    inside = member.select((F.col("start") + F.col("i")).alias("src"), F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.col("start") + j)).alias("dst")).where("src <> dst")
    steps = max(1, len(starts).bit_length())
    far = table.select("clique", "start", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("s")).select("clique", "start", "s", F.pmod(F.col("clique") + F.expr("shiftleft(1, s)"), F.lit(len(starts))).alias("other"))
    far = far.where((F.col("other") != F.col("clique")) & (_uniform(seed, F.col("clique"), F.col("s")) < F.lit(inter) / F.pow(F.lit(2.0), "s")))
    between = far.join(table.select(F.col("clique").alias("other"), F.col("start").alias("dst")), "other").select(F.col("start").alias("src"), "dst")
    both = between.union(between.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return inside.union(both).distinct().select("src", "dst", _weight(seed, F.xxhash64("src", "dst")))


def random_sequence(length: int, rng: random.Random) -> str:
    return "".join(rng.choices("ACGT", k=length))


def mutated(sequence: str, rng: random.Random, substitutions: float, indels: float, band: int) -> str:
    """A copy with substitutions and indels at these rates; insertions less deletions stay within the band."""
    out, drift = [], 0
    for base in sequence:
        draw = rng.random()
        if draw < substitutions:
            out.append(rng.choice([x for x in "ACGT" if x != base]))
        elif draw < substitutions + indels:
            if rng.random() < 0.5 and drift < band:
                out += [base, rng.choice("ACGT")]
                drift += 1
            elif drift > -band:
                drift -= 1
            else:
                out.append(base)
        else:
            out.append(base)
    return "".join(out)


def simulated_reads(spark: SparkSession, genome: int, reads: int, length: int, error: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reads of a random genome with errors and random strands, and their truth (ref, read, start, stop)."""
    rng = random.Random(seed)
    reference = random_sequence(genome, rng)
    rows, truth = [], []
    for i in range(reads):
        at = rng.randrange(max(1, genome - length))
        seq = mutated(reference[at : at + length], rng, error / 2, error / 2, length)
        if rng.random() < 0.5:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((i, f"read{i}", seq, "I" * len(seq)))
        truth.append(("genome", f"read{i}", at, at + length))
    return spark.createDataFrame(rows, "read_id long, nametag string, seq string, qual string"), spark.createDataFrame(truth, "ref string, read string, start int, stop int")

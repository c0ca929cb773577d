"""Markov models of finding shared k-mers in an overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_chain(p: float, k: int) -> np.ndarray:
    """Transition matrix of runs of bases that are right on both reads; k is absorbing."""
    chain = np.zeros((k + 1, k + 1))
    chain[np.arange(k), 0] = 1 - p * p
    chain[np.arange(k), np.arange(1, k + 1)] += p * p
    chain[k, k] = 1
    return chain


def shared_kmer_probability(overlap: int, p: float, k: int) -> float:
    """Chance that an overlap holds k consecutive bases that are right on both reads."""
    return float(np.linalg.matrix_power(run_chain(p, k), overlap)[0, k])


def expected_overlap(p: float, k: int, row: int = 0) -> float:
    """Expected bases until such a run, from `row` right bases on; row 0 has a closed form."""
    q = p * p
    if row == 0:
        return (1 - q**k) / ((1 - q) * q**k) if q < 1 else float(k)
    return float(np.linalg.inv(np.eye(k) - run_chain(p, k)[:-1, :-1])[row].sum())


def several_kmers_probability(overlap: int, p: float, k: int, words: int) -> float:
    """Chance of at least `words` such runs one after another, each after the first counted from its own start."""
    one = run_chain(p, k)
    size = words * k + 1
    chain = np.zeros((size, size))
    for i in range(words):
        block = one[:-1]
        at = i * k
        chain[at : at + k, at : at + k + 1] = block
    chain[-1, -1] = 1
    return float(np.linalg.matrix_power(chain, overlap)[0, -1])


def with_probability(grid: DataFrame) -> DataFrame:
    """grid (overlap, p, k) with `probability`."""

    def run(overlap: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([shared_kmer_probability(int(o), float(x), int(n)) for o, x, n in zip(overlap, p, k, strict=True)])

    return grid.withColumn("probability", F.pandas_udf(run, "double")("overlap", "p", "k"))


def expected_overlap_column(p: Column, k: Column) -> Column:
    q = p * p
    return (1 - F.pow(q, k)) / ((1 - q) * F.pow(q, k))

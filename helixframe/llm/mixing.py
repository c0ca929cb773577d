"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

The corpus is summed to a table of cells (source, language, topic) of documents and tokens. Raking scales the cells'
token weights again and again to the target marginal of each dimension in turn, and bounds each cell by what it has,
until nothing moves. A document is then kept with the probability of its cell, weight over tokens: a hash of its id
and the seed decides, so a lost executor decides the same again. Targets are shares of tokens by value of a dimension;
where none are given, they are the corpus shares raised to `temper` and normalised. The budget is `budget` tokens, or
`budget_share` of all there are, whatever the corpus's size. A value that has fewer tokens than its share of the budget is
taken whole, and what it lacks is spread over the other values of its dimension by their shares; so a scarce value never
throttles the rest. `marginals` reports wanted and reached weights.

A target for a value that the corpus doesn't have is an error, as are targets whose shares aren't positive in sum; a value
without a target in a dimension that has targets gets none. Where the bounds of cells keep raking from settling within
the rounds, the last weights hold and a warning says how far they still move.

The cells are few (values of three columns), and raked on the driver while there are at most `DRIVER_CELLS` of them, else
by window sums over written tables. Documents are never gathered: a hot source is one row a task after partial sums.
Null values are cells of their own. Null and empty texts have no tokens; a cell without tokens keeps all its documents. Very
long texts count like others. Repeated rows are decided alike, rows with a null id by their text; ties can't arise.
Columns of any names are carried in a struct. An empty table gives an empty result."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small

DIMENSIONS = ("source", "lang", "topic")
DRIVER_CELLS = 50_000
TEMPER, ROUNDS, TOLERANCE, BUDGET_SHARE = 0.9, 200, 1e-9, 0.9
#: How far a cell may still move, as a share of its tokens, without a warning.
UNSETTLED = 1e-4
ABSENT = "\0null"
_NAMES = [f"d_{d}" for d in DIMENSIONS]


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by rules: legal, contact, table, data or prose. Give `topic` where the corpus has a better one."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("icens")) | F.contains(t, F.lit("opyright")) | F.contains(t, F.lit("ights reserved")), "legal")
        .when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("+1 (")), "contact")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(t.rlike("[0-9]"), "data")
        .otherwise("prose")
    )


def filled(have: dict, share: dict, budget: float) -> dict:
    """Wanted weights of one dimension's values: share times a common level, what a value has at most, the budget in
    sum, or all that there is."""
    out, left, open_values = {}, budget, {v for v in have if share.get(v, 0.0) > 0}
    while open_values:
        total = sum(share[v] for v in open_values)
        whole = {v for v in open_values if have[v] <= left * share[v] / total}
        if not whole:
            return out | {v: left * share[v] / total for v in open_values}
        out |= {v: have[v] for v in whole}
        left -= sum(have[v] for v in whole)
        open_values -= whole
    return out


def _wanted(sums: list, targets: dict[str, dict[str | None, float]], budget: float | None, budget_share: float, temper: float) -> dict[str, dict[str, float]]:
    """Weight that each value of each dimension shall have; the same total in every dimension. sums: rows of dimension,
    value and tokens, one for each value (a bounded number)."""
    have: dict[str, dict[str, float]] = {d: {} for d in DIMENSIONS}
    for r in sums:
        have[r["dimension"]][r["value"]] = float(r["tokens"])
    total = sum(have[DIMENSIONS[0]].values())
    level = min(total, budget_share * total if budget is None else budget)
    shares = {}
    for d in DIMENSIONS:
        if targets.get(d):
            own = {ABSENT if v is None else str(v): float(x) for v, x in targets[d].items()}
            lost = sorted(v for v, x in own.items() if x > 0 and not have[d].get(v)) if total else []
            if lost:
                raise ValueError(f"the corpus has no tokens of {d} {', '.join(lost)}")
            if min(own.values()) < 0 or sum(own.values()) <= 0:
                raise ValueError(f"the targets of {d} must be shares that aren't negative, and not all zero")
            shares[d] = own
        else:
            shares[d] = {v: t**temper for v, t in have[d].items()}
        # a dimension can't have more than the values with a share hold
        level = min(level, sum(t for v, t in have[d].items() if shares[d].get(v, 0.0) > 0))
    return {d: filled(have[d], shares[d], level) for d in DIMENSIONS}


def _on_driver(rows: list, wanted: dict[str, dict[str, float]]) -> tuple[dict[tuple, float], float]:
    """Probabilities of the cells, and how far they moved last."""
    weight = {tuple(r[n] for n in _NAMES): float(r["tokens"]) for r in rows if r["tokens"]}
    have, moved = dict(weight), 0.0
    for _ in range(ROUNDS):
        moved, before = 0.0, dict(weight)
        for k, d in enumerate(DIMENSIONS):
            sums: dict[str, float] = {}
            for cell, w in weight.items():
                sums[cell[k]] = sums.get(cell[k], 0.0) + w
            for cell, w in weight.items():
                new = w * wanted[d].get(cell[k], 0.0) / sums[cell[k]] if sums[cell[k]] else 0.0
                weight[cell] = min(new, have[cell])
        moved = max((abs(w - before[c]) / have[c] for c, w in weight.items()), default=0.0)
        if moved < TOLERANCE:
            break
    return {cell: w / have[cell] for cell, w in weight.items()}, moved


def _by_tables(work: Workspace, cells: DataFrame, wanted: dict[str, dict[str, float]], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """The same for any number of cells."""
    spark = cells.sparkSession
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        own = spark.createDataFrame(list(wanted[d].items()), f"d_{d} string, t_{d} double")
        out = out.join(own, f"d_{d}", "left").fillna(0.0, [f"t_{d}"])
    out, moved = work.written(out), 0.0
    for _ in range(rounds):
        columns = out.columns
        out = out.withColumn("old", F.col("weight"))
        for d in DIMENSIONS:
            total = F.sum("weight").over(Window.partitionBy(f"d_{d}"))
            out = out.withColumn("weight", F.coalesce(F.least(F.try_divide(F.col("weight") * F.col(f"t_{d}"), total), F.col("tokens")), F.lit(0.0)))
        out = work.written(out)
        moved = out.agg(F.max(F.abs(F.col("weight") - F.col("old")) / F.col("tokens"))).first()[0] or 0.0
        out = out.select(*columns)
        if moved < TOLERANCE:
            break
    return out.select(*_NAMES, (F.col("weight") / F.col("tokens")).alias("probability")), moved


def rake(keyed: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None, budget_share: float = BUDGET_SHARE, temper: float = TEMPER, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """keyed: columns d_source, d_lang, d_topic (no nulls) and tokens. Gives docs, tokens and probability by cell."""
    spark = keyed.sparkSession
    with Workspace(spark) as work:
        cells = work.written(keyed.groupBy(*_NAMES).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
        sums = [cells.groupBy(F.col(f"d_{d}").alias("value")).agg(F.sum("tokens").alias("tokens")).select(F.lit(d).alias("dimension"), "value", "tokens") for d in DIMENSIONS]
        wanted = _wanted(sums[0].union(sums[1]).union(sums[2]).collect(), targets or {}, budget, budget_share, temper)  # a row for each value
        if cells.count() > driver_cells:
            found, moved = _by_tables(work, cells, wanted)
        else:
            chances, moved = _on_driver(cells.collect(), wanted)  # at most driver_cells rows
            found = spark.createDataFrame([(*cell, p) for cell, p in chances.items()], ", ".join(f"{n} string" for n in _NAMES) + ", probability double")
        if moved > UNSETTLED:
            warnings.warn(f"raking didn't settle: a cell still moves by {moved:.2g} of its tokens a round", stacklevel=2)
        # cells without tokens keep their documents
        return work.kept(cells.join(found, _NAMES, "left").withColumn("probability", F.coalesce("probability", F.when(F.col("tokens") > 0, 0.0).otherwise(1.0))))


def _keyed(docs: DataFrame, topic: Column) -> list[Column]:
    absent = F.lit(ABSENT)
    return [F.coalesce(docs["source"].cast("string"), absent).alias("d_source"), F.coalesce(docs["lang"].cast("string"), absent).alias("d_lang"), F.coalesce(topic, absent).alias("d_topic")]


def cells_of(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, **parameters) -> DataFrame:
    """The raked cells of docs: d_source, d_lang, d_topic, docs, tokens and probability."""
    tokens = token_count(docs["text"]) if tokens is None else tokens
    return rake(docs.select(*_keyed(docs, topic_of(docs["text"]) if topic is None else topic), tokens.alias("tokens")), **parameters)


def decided(docs: DataFrame, seed: int = 1, topic: Column | None = None, tokens: Column | None = None, cells: DataFrame | None = None, **parameters) -> DataFrame:
    """All rows: record (struct of docs' columns), d_source, d_lang, d_topic, tokens, probability and chosen."""
    topic = topic_of(docs["text"]) if topic is None else topic
    tokens = token_count(docs["text"]) if tokens is None else tokens
    cells = cells_of(docs, topic, tokens, **parameters) if cells is None else cells
    rows = docs.select(*_keyed(docs, topic), tokens.alias("tokens"), F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    out = rows.join(small(cells.select(*_NAMES, "probability"), DRIVER_CELLS), _NAMES)
    name = F.coalesce(F.col("record.doc_id").cast("string"), F.md5(F.coalesce(F.col("record.text"), F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") / F.lit(16.0**12)
    return out.withColumn("chosen", draw < F.col("probability"))


def marginals(cells: DataFrame) -> DataFrame:
    """dimension, value, docs, tokens, weight (expected tokens of the mixture) and the shares of both, from raked cells."""
    own = [cells.groupBy(F.col(f"d_{d}").alias("value")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("weight")).withColumn("dimension", F.lit(d)) for d in DIMENSIONS]
    of = Window.partitionBy("dimension")  # a row for each value
    shares = [F.try_divide(F.col(c), F.sum(c).over(of)).alias(f"{c}_share") for c in ("tokens", "weight")]
    return own[0].union(own[1]).union(own[2]).select("dimension", "value", "docs", "tokens", "weight", *shares)


def mixing_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and chosen of every row."""
    return decided(docs, **parameters).select("record.doc_id", "record.source", "record.lang", F.col("d_topic").alias("topic"), "tokens", "probability", "chosen")


def sampled(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are chosen."""
    return decided(docs, **parameters).where("chosen").select(*[F.col("record")[c].alias(c) for c in docs.columns])

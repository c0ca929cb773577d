"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds are found by fixed patterns, leftmost and non-overlapping for each kind, and checked (address parts,
check digits, digit counts); those spans always stay. Further candidates are tokens with a digit. Labelers vote on each
(+1 private, -1 not, 0 abstains): whether a base span covers it, its shape, its digits, a gazetteer of cue words before
it, and the characters around it. Expectation-maximisation over the counts of vote patterns (at most 3**5 rows)
estimates how reliable each labeler is; the posteriors are soft labels of a logistic span classifier over span
features, trained on counts of feature patterns (bounded by the product of their small ranges). Candidates that it takes
and that no base span overlaps are added, as kind `secret`. All counts come from all documents.

Positions come from the pieces between matches, so no row leaves the JVM. Quantifiers over groups are possessive, which
gives the same matches and neither recursion nor quadratic time on very long texts. Null and empty texts have no spans.
Rows are handled each on its own, so repeated rows and hot sources need no care; null ids stay null. Spans with equal starts
are ordered by kind. Columns besides the id and the text are left out, so none can clash. An empty table, or one without
candidates, gives no added spans."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
_LOCAL = "A-Za-z0-9._%+-"
# The contract's patterns; \G and the look-behind only skip starts that must fail, and possessive ends match alike.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CANDIDATE = r"(?<![A-Za-z0-9._@/+-])(?=[A-Za-z._@/+-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9._@/+-]*(?<=[A-Za-z0-9])"
#: Words that announce personal data or a secret, and words that announce a harmless number, in lower case.
PRIVATE_CUES = "token|secret|key|password|passwd|pwd|tel|phone|mobile|fax|mail|email|card|iban|account|ssn|passport|contact|call|clave|contraseña|teléfono|tarjeta|schlüssel|kennwort|telefon|karte|konto|téléphone|carte|compte|mot de passe"
HARMLESS_CUES = "version|license|licence|page|chapter|section|article|figure|table|volume|issue|year|act|cc|no|nr|part|line|step|gpl|by-nc|by"
LABELERS = ("base", "shape", "digits", "cue", "around")
#: Sizes of the classifier's features: length, share of digits, letters, hexadecimal or check digit, cue, character before.
FEATURES = (8, 5, 3, 4, 3, 4)
PRIOR, EM_ROUNDS, TRAIN_ROUNDS, RATE, THRESHOLD = 0.5, 50, 300, 1.0, 0.9


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern and the pieces between them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where lambdas of f use it for each element."""
    return F.transform(F.array(value), f)[0]


_PLACED = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
#: Positions are summed in blocks of so many matches, so their cost stays in proportion to the number of matches.
BLOCK = 256


def _placed(text: Column, pattern: str) -> Column:
    """Matches as an array of struct(start, end, match, before, after): code points, end exclusive, and up to 40
    characters on each side, as far as the neighbouring matches."""
    matches, pieces = _found(text, pattern)
    row = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), F.slice(pieces, 2, F.size(matches)).alias("q"))
    return _once(row, _in_blocks)


def _in_blocks(row: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(row) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(row, i + 1, F.lit(BLOCK)))
    length = lambda x: F.length(x["p"]) + F.length(x["m"])
    totals = F.transform(parts, lambda part: F.struct(part.alias("part"), F.aggregate(part, F.lit(0), lambda acc, x: acc + length(x)).alias("size")))
    begun = F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["size"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    return F.flatten(F.zip_with(parts, begun, _spans_from))


def _spans_from(part: Column, at: Column) -> Column:
    start = F.struct(at.alias("at"), F.array().cast(_PLACED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match"), F.right(x["p"], F.lit(40)).alias("before"), F.left(x["q"], F.lit(40)).alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(part, start, step, lambda acc: acc["out"])


def _luhn(match: Column) -> Column:
    def check(digits: Column) -> Column:
        n = F.length(digits)

        def add(acc: Column, i: Column) -> Column:
            d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + F.pmod(i, F.lit(2)))
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return F.when(n.between(14, 19), F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10)) == 0).otherwise(False)

    return _once(F.regexp_replace(match, "[^0-9]", ""), check)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind: array of struct(start, place of the kind, kind, end)."""
    out = {}
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    for kind in KINDS:
        out[kind] = F.when(may[kind], _spans_of(text, kind)).otherwise(F.array()).cast(_SPANS)
    return out


def _spans_of(text: Column, kind: str) -> Column:
    good = F.filter(_placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _bucket(value: Column, *edges: float) -> Column:
    """How many of the edges the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _judged(x: Column, base: Column) -> Column:
    """A candidate with its votes (one of 3**5) and its features (one of their product)."""
    match, before, after = x["match"], F.lower(x["before"]), x["after"]
    n = F.length(match)
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    covered = F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    hexadecimal = match.rlike("^[0-9a-f]{16,}$")
    near = F.right(before, F.lit(24))
    private = near.rlike(rf"(?:^|[^a-z])(?:{PRIVATE_CUES})[^a-z0-9]{{1,6}}$")
    harmless = near.rlike(rf"(?:^|[^a-z])(?:{HARMLESS_CUES})[^a-z0-9]{{0,3}}$")
    long_number = match.rlike("^[0-9]{12,}$")
    mixed = match.rlike("[A-Za-z]") & (n >= 12) & (digits >= 3)
    votes = [
        F.when(covered, 1).otherwise(0),
        F.when(long_number & ~_luhn(match), -1).when((hexadecimal & ~long_number) | mixed, 1).when(match.rlike("^[0-9]{1,4}$") | match.rlike(r"^[0-9]+(?:\.[0-9]+){1,2}$"), -1).otherwise(0),
        F.when(long_number, F.when(_luhn(match), 1).otherwise(-1)).when(digits >= 9, 1).when(digits <= 4, -1).otherwise(0),
        F.when(private, 1).when(harmless, -1).otherwise(0),
        F.when(before.rlike("[=:]\\s*[\"']?$"), 1).when(F.left(after, F.lit(1)).isin("%", "°") | before.rlike("[$€£§]\\s?$"), -1).otherwise(0),
    ]
    features = [
        _bucket(n, 3, 5, 8, 12, 16, 24, 36),
        _bucket(digits / n, 0.2, 0.5, 0.8, 1.0),
        F.when(match.rlike("[a-z]"), F.when(match.rlike("[A-Z]"), 2).otherwise(1)).when(match.rlike("[A-Z]"), 2).otherwise(0),
        F.when(hexadecimal & ~long_number, 1).when(long_number, F.when(_luhn(match), 2).otherwise(3)).otherwise(0),
        F.when(private, 1).when(harmless, 2).otherwise(0),
        F.when(before.rlike("[\"']$"), 1).when(before.rlike("[=:]$"), 2).when(before.rlike("\\s$") | (before == ""), 0).otherwise(3),
    ]
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), covered.alias("covered"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]], float]:
    """Expectation-maximisation over counts of vote patterns: the posterior of each pattern, for each labeler the
    chance of each vote (given not private, given private), and the share of private candidates. Starts at the majority
    of the votes; counts are smoothed, so any table has a result."""
    post = {v: min(max(0.5 + 0.2 * sum(v), 0.05), 0.95) for v in patterns}
    chances: list[dict[int, tuple[float, float]]] = []
    share = PRIOR
    for _ in range(rounds):
        total = sum(patterns.values())
        ones = sum(n * post[v] for v, n in patterns.items())
        share = (ones + 1) / (total + 2)
        chances = []
        for k in range(len(LABELERS)):
            own = {}
            for vote in (-1, 0, 1):
                yes = sum(n * post[v] for v, n in patterns.items() if v[k] == vote)
                no = sum(n * (1 - post[v]) for v, n in patterns.items() if v[k] == vote)
                own[vote] = (no + 1) / (total - ones + 3), (yes + 1) / (ones + 3)
            chances.append(own)
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(c[x][1] / c[x][0]) for c, x in zip(chances, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, chances, share


def train(rows: list[tuple[tuple[int, ...], float, float]]) -> list[list[float]]:
    """Weights of a logistic classifier over one-hot features (a list for each feature, then [bias]) from rows of
    (features, number of candidates, sum of their posteriors), by gradient steps with decay."""
    weights = [[0.0] * n for n in FEATURES] + [[0.0]]
    total = sum(n for _, n, _ in rows)
    for _ in range(TRAIN_ROUNDS if total else 0):
        slope = [[-0.001 * w for w in own] for own in weights]
        for features, n, ones in rows:
            score = weights[-1][0] + sum(weights[k][x] for k, x in enumerate(features))
            push = (ones - n / (1 + math.exp(-score))) / total
            slope[-1][0] += push
            for k, x in enumerate(features):
                slope[k][x] += push
        for own, more in zip(weights, slope, strict=True):
            for i, x in enumerate(more):
                own[i] += RATE * x
    return weights


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, the spans of each base kind (columns by kind) and `secret`, the added ones, of every row; and text."""
    rest = ["text"] * keep_text
    text = F.coalesce(docs[text_col], F.lit(""))
    plain = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    based = plain.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    placed = F.when(F.col("text").rlike("[0-9]"), _placed(F.col("text"), CANDIDATE))
    every = based.select("doc_id", *rest, *KINDS, F.concat(*KINDS).alias("base"), placed.alias("found"))
    judged = _once(F.col("base"), lambda base: F.transform(F.coalesce("found", F.array().cast(_PLACED)), lambda x: _judged(x, base)))
    table = Workspace(docs.sparkSession).kept(every.select("doc_id", *rest, *KINDS, judged.alias("candidates")))
    counted = table.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").count()
    rows = [(tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counted.collect()]  # bounded: patterns, not candidates
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for votes, _, n in rows:
        patterns[votes] += n
    post, _, _ = reliabilities(dict(patterns))
    sums: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for votes, features, n in rows:
        sums[features][0] += n
        sums[features][1] += n * post[votes]
    weights = train([(f, n, ones) for f, (n, ones) in sums.items()])

    def taken(c: Column) -> Column:
        score = sum((F.array(*[F.lit(w) for w in own])[c["features"][k]] for k, own in enumerate(weights[:-1])), F.lit(weights[-1][0]))
        return ~c["covered"] & (score >= math.log(THRESHOLD / (1 - THRESHOLD)))

    added = F.transform(F.filter("candidates", taken), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("place"), F.lit(ADDED).alias("kind"), c["end"].alias("end")))
    return table.select("doc_id", *rest, *KINDS, added.alias(ADDED))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret and n_spans (of all kinds) of every row."""
    found = detected(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.concat(*KINDS)), 256).alias("base_sha256"), _joined(F.concat(*KINDS, ADDED)).alias("spans"), F.size(ADDED).cast("long").alias("n_secret"), (sum((F.size(k) for k in KINDS), F.size(ADDED))).cast("long").alias("n_spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, each span replaced by its kind in brackets; of overlapping spans the first is named."""
    found = detected(docs, id_col, text_col, keep_text=True)
    text, spans = F.col("text"), F.array_sort(F.concat(*KINDS, ADDED))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        shown = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), shown.alias("out"))

    return found.select("doc_id", F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))).alias("text"))

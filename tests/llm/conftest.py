import random

import pytest

LANGS = ("en", "de", "fr", None)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def messy_rows():
    """Copies, near copies, white-space variants, repeated rows, nulls, empty and long texts, ties."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        rows.append((i, words(rng, rng.randint(40, 200)), LANGS[i % 3], f"s{i % 2}", 1))
    base = rows[0][1]
    rows += [(200, base, "en", "s0", 1), (201, base, "en", "s0", 1), (201, base, "en", "s0", 1), (202, base.replace(" ", "  ", 3), "en", "s0", 1)]
    for i in range(210, 230):
        w = base.split()
        w[i - 200] = "changed"
        rows.append((i, " ".join(w), "en", "s0", 1))
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, " \n\t", "de", "s1", 3), (None, "no id here", "fr", None, 1), (None, "no id here", "fr", None, 1)]
    rows += [(303, words(rng, 30_000), "en", "s1", 1), (304, "x" * 50_000, "en", "s1", 1), (305, "one two", "en", "s1", 1), (306, "one two three four five six", "en", "s1", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("bucket", "record", "centre", "tokens", "kept", "probability", "node", "items")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

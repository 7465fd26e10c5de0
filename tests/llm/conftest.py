import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def docs(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.withColumns({c: F.lit(1) for c in ("row", "line", "token", "block", "fp", "label", "score", "range")}) if extra else df

    return docs


@pytest.fixture(scope="session")
def corpus():
    """Exact and near copies, repeats, ties, nulls, empty and long texts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 30))) for _ in range(n))
    rows = [(k, text(rng.randint(1, 6))) for k in range(60)]
    for k in range(60, 80):
        words = rows[rng.randrange(60)][1].split(" ")
        words[rng.randrange(len(words))] = "Other"
        rows.append((k, " ".join(words)))
    rows += [(k, rows[3][1]) for k in range(80, 90)] + [(90, None), (91, ""), (92, " \t\n "), (93, "one"), (94, "two words"), (None, rows[7][1])]
    rows += [(95, text(400)), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows

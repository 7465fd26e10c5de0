"""N-Triples and N-Quads files as graphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.sources.graph import Graph

_TERM = r'(<[^>\s]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>\s]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}(?:\s+{_TERM})?\s*\.\s*(?:#.*)?$"
_IDLE = r"^\s*(?:#.*)?$"


@F.pandas_udf("string")
def _unescaped(term: pd.Series) -> pd.Series:
    """Terms with escapes in their canonical form; null for one that isn't a term."""

    def one(t: str | None) -> str | None:
        try:
            if t is None or t[0] != "<":
                return t if t is None else terms.canonical(t)
            return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))", lambda m: chr(int(m[1] or m[2], 16)), t)
        except (ValueError, OverflowError):
            return None

    return term.map(one, na_action="ignore")


def _canonical(term: Column) -> Column:
    """Only terms with a backslash go through Python; the datatype of plain strings is left out."""
    plain, end = F.lit(f'"^^<{terms.STRING}>'), len(f"^^<{terms.STRING}>")
    bare = F.when(F.startswith(term, F.lit('"')) & F.endswith(term, plain), F.substring(term, F.lit(1), F.length(term) - end)).otherwise(term)
    return F.when(F.contains(bare, F.lit("\\")), _unescaped(F.when(F.contains(bare, F.lit("\\")), bare))).otherwise(bare)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that are neither facts nor blank nor comments."""
    value = F.col("value")
    return spark.read.text(path).where(~value.rlike(_LINE) & ~value.rlike(_IDLE))


def read(spark: SparkSession, path: str, strict: bool = True) -> Graph:
    """Facts of N-Triples or N-Quads lines, all positive; comments and blank lines are left out.

    Escapes are brought to their canonical form. With ``strict`` a malformed line is an error; else it is left out, and
    ``malformed`` lists it.
    """
    if strict and (bad := malformed(spark, path).take(1)):
        raise ValueError(f"not an N-Triples line: {bad[0][0]!r}")
    lines = spark.read.text(path)
    part = [F.regexp_extract("value", _LINE, k) for k in (1, 2, 3, 4)]
    rows = lines.select(*(x.alias(n) for x, n in zip(part, "spog", strict=True))).where(F.col("s") != "")
    rows = rows.select(F.lit(True).alias("positive"), *(_canonical(F.col(n)).alias(n) for n in "spo"), F.when(F.col("g") != "", _canonical(F.col("g"))).alias("g"))
    return Graph(rows.dropDuplicates())

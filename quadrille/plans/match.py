"""Hypotheses as joins: one scan for each pattern, equi-joined on shared variables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.model import Hypothesis, Pattern, Res, Rule, Signed, Var
from quadrille.sources.graph import Bound, Graph

#: About as many rows of a key, on either side, are joined at a time where both sides may have many.
SIDE = 4096


def order(patterns: list[Signed[Pattern]], bound: set[int]) -> list[Signed[Pattern]]:
    """Greedy: constants first, then whatever shares variables with what is joined already, so that cross products come last."""
    left, out, known = list(patterns), [], set(bound)
    while left:

        def rank(p: Signed[Pattern]) -> tuple:
            v = p.value.variables()
            consts = sum(isinstance(x, Res) for x in (p.value.s, p.value.o))
            return (bool(known) and not v & known and bool(v), not v, -len(v & known), -consts, -isinstance(p.value.p, Res))

        best = min(left, key=rank)
        left.remove(best)
        out.append(best)
        known |= best.value.variables()
    return out


def dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The equi-join of ``a`` and ``b``, dealt out by pairs of parts: a key's rows are cut into parts of about SIDE rows on
    either side. A few keys with many rows on both sides would else be the work of as few tasks, as the bytes of the sides,
    by which Spark splits and merges partitions, don't show how many pairs there are. The rows dealt out are about
    2/SIDE of the pairs besides those of either side, the keys that are cut at most one in SIDE rows.
    """
    spark = a.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / SIDE).cast("int").alias(name)).where(F.col(name) > 1)

    parts = F.broadcast(cut(a, "_parts_a").join(cut(b, "_parts_b"), keys, "full"))

    def side(df: DataFrame, own: str, other: str, x: str, y: str) -> DataFrame:
        one = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
        at = F.pmod(F.xxhash64(*df.columns), one[own]).cast("int")
        found = df.join(parts, keys, "left").select(*df.columns, at.alias(x), F.explode(F.sequence(F.lit(0), one[other] - 1)).alias(y))
        return found.repartition(n, *keys, "_a", "_b")

    return side(a, "_parts_a", "_parts_b", "_a", "_b").join(side(b, "_parts_b", "_parts_a", "_b", "_a"), [*keys, "_a", "_b"]).drop("_a", "_b")


def joined(a: Bound, b: Bound, many: bool = False) -> Bound:
    """All pairs that agree on the shared variables, compared by base columns where both sides make terms alike.

    ``many`` tells that both sides may have many rows of a key.
    """
    shared = [k for k in a.encoders if k in b.encoders]
    differ = [k for k in shared if a.encoders[k] != b.encoders[k]]
    a, b = a.as_terms(*differ), b.as_terms(*differ)
    keys = [c for k in shared for c in a.names(k)]
    if keys:
        return Bound(dealt(a.df, b.df, keys) if many else a.df.join(b.df, keys), b.encoders | a.encoders)
    left, right = (x.df.drop("_one") if x.encoders else x.df for x in (a, b))
    if "_one" in left.columns and "_one" in right.columns:
        right = right.withColumnRenamed("_one", "_two")
    df = left.crossJoin(right).drop("_two")
    return Bound(df.drop("_one") if a.encoders or b.encoders else df, a.encoders | b.encoders)


def _subject(p: Signed[Pattern]) -> set[int]:
    return {p.value.s.index} if isinstance(p.value.s, Var) else set()


def bindings(rule: Rule, graph: Graph, seed: Bound | None = None, exclude: int | None = None) -> Bound:
    """All matches of the rule's patterns (but number ``exclude``), in base columns. See substitutions."""
    todo = [p for k, p in enumerate(rule.hypothesis.patterns) if k != exclude]
    out = seed
    # a side whose subjects are all shared has few rows of a key: those of one subject
    own = set() if seed is None else set(seed.encoders) if exclude is None else _subject(rule.hypothesis.patterns[exclude])
    for p in order(todo, set(seed.encoders) if seed is not None else set()):
        found = graph.bindings(p)
        if out is not None:
            shared = set(out.encoders) & set(found.encoders)
            found = joined(out, found, bool(own - shared) and bool(_subject(p) - shared))
        out, own = found, own | _subject(p)
    return Bound(graph.spark.range(1).select(F.lit(1).alias("_one")), {}) if out is None else out


def same(rule: Rule, graph: Graph, a: int, b: int) -> Bound:
    """The matches in which variables ``a`` and ``b`` are the same term, as bindings gives them: those of the rule with one for the other."""
    patterns = []
    for p in rule.hypothesis.patterns:
        parts = (Var(a) if x == Var(b) else x for x in p.value.parts)
        patterns.append(Signed(p.positive, Pattern(*parts)))
    found = bindings(replace(rule, hypothesis=Hypothesis(tuple(patterns))), graph)
    more = [F.col(c).alias(f"v{b}_{i}") for i, c in enumerate(found.names(a))]
    return Bound(found.df.select("*", *more), found.encoders | {b: found.encoders[a]})


def substitutions(rule: Rule, graph: Graph, seed: DataFrame | None = None, exclude: int | None = None) -> DataFrame:
    """All matches of the rule's patterns (but number ``exclude``), a column v<index> for each bound variable.

    Bag semantics: a triple in two graphs matches twice. ``seed`` holds initial bindings, columns v<index> without
    nulls. Without patterns and seed there is one match, of no columns but the mark _one. Only bodies whose patterns
    share no variable make a cross join, as their meaning is one.
    """
    return bindings(rule, graph, None if seed is None else Bound.of_terms(seed), exclude).terms()

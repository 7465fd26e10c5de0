"""Graphs: signed quads as branches of tables, scanned by pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import Pattern, Res, Signed

SCHEMA = "positive boolean, s string, p string, o string, g string"
TRIPLE = ["positive", "s", "p", "o"]


@dataclass(frozen=True)
class Encoder:
    """How base columns make a term. Equal encoders make equal terms of equal values, and of those only.

    ``decode`` gives the values that make a term, or None if none do.
    """

    name: str
    encode: Callable[..., Column] = field(compare=False)
    decode: Callable[[str], tuple | None] = field(compare=False)


#: A column that holds terms already.
TERM = Encoder("term", lambda c: c, lambda term: (term,))


@dataclass(frozen=True)
class Slot:
    """A place of quads: base columns and the encoder that makes terms of them, or one constant term."""

    raws: tuple[Column, ...]
    encoder: Encoder = TERM
    constant: str | None = None

    @staticmethod
    def of(x: Slot | Column | str) -> Slot:
        return x if isinstance(x, Slot) else Slot((F.lit(x),), constant=x) if isinstance(x, str) else Slot((x,))

    @property
    def term(self) -> Column:
        return self.encoder.encode(*self.raws)

    def present(self) -> Column | None:
        return None if self.constant is not None else reduce(Column.__and__, (c.isNotNull() for c in self.raws))

    def equals(self, term: str) -> Column | bool:
        """Whether it is ``term``: a comparison of base columns, which a scan can push to the files."""
        if self.constant is not None:
            return self.constant == term
        values = self.encoder.decode(term)
        return values is not None and reduce(Column.__and__, (c == F.lit(v) for c, v in zip(self.raws, values, strict=True)))


@dataclass(frozen=True)
class Branch:
    """Quads made of the rows of one table. Rows with a null in a slot make none; a null graph is the default one."""

    df: DataFrame
    s: Slot
    p: Slot
    o: Slot
    positive: Column | bool = True
    g: Slot | None = None

    @staticmethod
    def of_quads(quads: DataFrame) -> Branch:
        s, p, o, g = (Slot((F.col(c),)) for c in "spog")
        return Branch(quads.select(*TRIPLE, "g"), s, p, o, F.col("positive"), g)

    def _rows(self) -> DataFrame:
        return reduce(DataFrame.where, (x for x in (self.s.present(), self.p.present(), self.o.present()) if x is not None), self.df)

    def quads(self) -> DataFrame:
        none = F.lit(None).cast("string")
        sign = F.lit(self.positive) if isinstance(self.positive, bool) else self.positive
        return self._rows().select(sign.alias("positive"), *(getattr(self, n).term.alias(n) for n in "spo"), (none if self.g is None else self.g.term).alias("g"))

    def scan(self, pattern: Signed[Pattern]) -> tuple[DataFrame, dict[int, Slot]] | None:
        """The matching rows and each variable's slot in them; None if no row can match."""
        tests: list[Column | bool] = [self.positive == pattern.positive] if isinstance(self.positive, bool) else [self.positive == F.lit(pattern.positive)]
        seen: dict[int, Slot] = {}
        for name, x in zip("spo", pattern.value.parts, strict=True):
            slot = getattr(self, name)
            if isinstance(x, Res):
                tests.append(slot.equals(x.term))
            elif x.index in seen:
                tests.append(_same(seen[x.index], slot))
            else:
                seen[x.index] = slot
        if any(t is False for t in tests):
            return None
        return reduce(DataFrame.where, (t for t in tests if t is not True), self._rows()), seen


def _same(a: Slot, b: Slot) -> Column | bool:
    if a.constant is not None and b.constant is not None:
        return a.constant == b.constant
    if a.encoder == b.encoder:
        return reduce(Column.__and__, (x == y for x, y in zip(a.raws, b.raws, strict=True)))
    return a.term == b.term


@dataclass(frozen=True)
class Bound:
    """Rows of bindings: base columns v<index>_<i> of each variable, and the encoders that make its terms of them."""

    df: DataFrame
    encoders: dict[int, Encoder]

    @staticmethod
    def of_terms(df: DataFrame) -> Bound:
        """From columns v<index> of terms; others are kept."""
        found = [int(c[1:]) for c in df.columns if c[0] == "v"]
        return Bound(df.select(*(F.col(c).alias(f"{c}_0") if c[0] == "v" else F.col(c) for c in df.columns)), dict.fromkeys(found, TERM))

    def names(self, k: int) -> list[str]:
        return [c for c in self.df.columns if c.startswith(f"v{k}_")]

    def as_terms(self, *which: int) -> Bound:
        """With terms for base columns in variables ``which``."""
        change = [k for k in which if self.encoders[k] != TERM]
        if not change:
            return self
        gone = {c for k in change for c in self.names(k)}
        made = [self.encoders[k].encode(*(F.col(c) for c in self.names(k))).alias(f"v{k}_0") for k in change]
        return Bound(self.df.select(*(c for c in self.df.columns if c not in gone), *made), self.encoders | dict.fromkeys(change, TERM))

    def terms(self, based: bool = False) -> DataFrame:
        """Columns v<index>, and the mark _one if there are no variables; with ``based``, the base columns too."""
        if not self.encoders:
            return self.df
        return self.df.select(*(c for k in self.encoders if based for c in self.names(k)), *(self.encoders[k].encode(*(F.col(c) for c in self.names(k))).alias(f"v{k}") for k in self.encoders))

    def union(self, other: Bound) -> Bound:
        differ = [k for k in self.encoders if self.encoders[k] != other.encoders[k]]
        a, b = self.as_terms(*differ), other.as_terms(*differ)
        return Bound(a.df.unionByName(b.df), a.encoders)


class Graph:
    """Signed quads (positive, s, p, o, g). Terms are canonical strings; a null g is the default graph.

    ``one_graph`` tells that no signed triple occurs in two graphs or twice, which spares numbering of duplicates.
    ``interpretation`` (resource, term) optionally gives the literals that a resource stands for.
    """

    def __init__(self, quads: DataFrame | Iterable[Branch], one_graph: bool = False, interpretation: DataFrame | None = None):
        self.branches = (Branch.of_quads(quads),) if isinstance(quads, DataFrame) else tuple(quads)
        self.one_graph = one_graph
        self.interpretation = interpretation

    @property
    def quads(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (b.quads() for b in self.branches))

    @property
    def spark(self) -> SparkSession:
        return self.branches[0].df.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, facts: Iterable[tuple], interpretation: DataFrame | None = None) -> Graph:
        """From (s, p, o), (s, p, o, g) or Signed of either; a graph is a set, so repeated quads are one."""
        rows = set()
        for f in facts:
            sign, t = (f.positive, f.value) if isinstance(f, Signed) else (True, f)
            rows.add((sign, *t, *([None] if len(t) == 3 else [])))
        return cls(spark.createDataFrame(sorted(rows, key=str), SCHEMA), len({r[:4] for r in rows}) == len(rows), interpretation)

    @classmethod
    def union_of(cls, parts: Iterable[Branch | DataFrame], one_graph: bool = False) -> Graph:
        """A virtual graph of branches, such as sources.triplify makes, or of quads; nothing is copied.

        A branch that can't match a pattern's constants is no part of its scan.
        """
        return cls([x if isinstance(x, Branch) else Branch.of_quads(x) for x in parts], one_graph)

    def bindings(self, pattern: Signed[Pattern]) -> Bound:
        """The matches of a signed pattern in any graph, duplicates kept, in base columns as far as branches agree on them."""
        out = None
        for branch in self.branches:
            found = branch.scan(pattern)
            if found is None:
                continue
            df, slots = found
            columns = [c.alias(f"v{k}_{i}") for k, slot in slots.items() for i, c in enumerate(slot.raws)]
            one = Bound(df.select(*(columns or [F.lit(1).alias("_one")])), {k: slot.encoder for k, slot in slots.items()})
            out = one if out is None else out.union(one)
        if out is None:
            names = sorted(pattern.value.variables())
            none = self.spark.createDataFrame([], ", ".join(f"v{k}_0 string" for k in names) or "_one int")
            return Bound(none, dict.fromkeys(names, TERM))
        return out

    def scan(self, pattern: Signed[Pattern], quads: DataFrame | None = None) -> DataFrame:
        """The matches of a signed pattern in any graph, one column v<index> per variable, duplicates kept."""
        return (self if quads is None else Graph(quads if "g" in quads.columns else quads.withColumn("g", F.lit(None).cast("string")))).bindings(pattern).terms()

    def triples(self) -> DataFrame:
        """Signed triples in any graph, each once."""
        df = self.quads.select(*TRIPLE)
        return df if self.one_graph else df.distinct()

    def of_predicates(self, predicates: frozenset[str]) -> Graph:
        """The part of the graph with these predicates: other branches are left out, or filtered where they have several."""
        kept = []
        for b in self.branches:
            if b.p.constant is None:
                kept.append(Branch(b.df.where(b.p.term.isin(*sorted(predicates))), b.s, b.p, b.o, b.positive, b.g))
            elif b.p.constant in predicates:
                kept.append(b)
        return Graph(kept or [Branch.of_quads(self.spark.createDataFrame([], SCHEMA))], self.one_graph, self.interpretation)

    def contains(self, triples: DataFrame, anti: bool = False, predicates: frozenset[str] | None = None) -> DataFrame:
        """Rows of ``triples`` (with TRIPLE columns) that hold here in some graph; with ``anti``, those that don't.

        ``predicates`` may name all that ``triples`` has; then only quads of these are read.
        """
        there = self if predicates is None else self.of_predicates(predicates)
        return triples.join(there.quads.select(*TRIPLE), TRIPLE, "left_anti" if anti else "left_semi")

    def has(self, fact: Signed[tuple[str, str, str]]) -> bool:
        s, p, o = fact.value
        return not self.scan(Signed(fact.positive, Pattern(Res(s), Res(p), Res(o)))).isEmpty()

    def insert(self, quads: DataFrame) -> Graph:
        """This graph with more quads; a graph is a set."""
        new = quads if "g" in quads.columns else quads.withColumn("g", F.lit(None).cast("string"))
        return Graph(self.quads.unionByName(new.select(*TRIPLE, "g")).dropDuplicates(), False, self.interpretation)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Writes Parquet; read back with ``Graph.read``."""
        self.quads.write.mode(mode).parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, one_graph: bool = False) -> Graph:
        return cls(spark.read.schema(SCHEMA).parquet(path), one_graph)

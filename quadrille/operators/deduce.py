"""Deduction: matches of a rule's body turned into the statements of its head, with provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.expressions import ERROR, Value, canonical_decimal, comparable, comparable_parts, compile_expr, fail, first_error, instantiate, no_error, parse_variables
from quadrille.model import Call, Eq, Reason, Res, Rule, Signed, Statement, Triple, True_, Validation, Var, expressions, variables_of
from quadrille.plans.match import bindings, same
from quadrille.sources.graph import TERM, TRIPLE, Bound, Graph, Slot

SCHEMA = (
    "rule_id int, deduction_id string, substitution array<string>, stmt_idx int, positive boolean, kind string, s string, p string, o string, "
    f"error {ERROR}"
)
COLUMNS = ["rule_id", "deduction_id", "substitution", "stmt_idx", "positive", "kind", "s", "p", "o", "error"]


class EvaluationError(ValueError):
    """An expression failed for some deduction: code is InvalidArgumentCount, InvalidLiteral, AmbiguousLiteral or Unexpected."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


class DatasetError(RuntimeError):
    """The graph couldn't be read while a rule was evaluated; the cause is Spark's error."""


class Deductions:
    """Statements deduced by rules, a lazy DataFrame of COLUMNS; duplicates are kept (a bag).

    ``predicates`` has those of all its triples if the rules name them, else None. ``based`` has the base columns too that
    terms are made of, see base. ``parts`` are frames, with the kind of their statements (None if any), that hold between
    them each statement that can fail.
    """

    def __init__(self, df: DataFrame, predicates: frozenset[str] | None = None, parts: tuple[tuple[str | None, Callable[[], DataFrame]], ...] | None = None):
        self.based = df
        self.df = df.select(*COLUMNS)
        self.predicates = predicates
        self.parts = ((None, lambda: df),) if parts is None else parts

    def union(self, other: Deductions) -> Deductions:
        both = None if self.predicates is None or other.predicates is None else self.predicates | other.predicates
        return Deductions(self.df.unionByName(other.df), both, self.parts + other.parts)

    @staticmethod
    def union_all(all_: Iterable[Deductions]) -> Deductions:
        return reduce(Deductions.union, all_)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def errors(self) -> DataFrame:
        return self.df.where(F.col("error").isNotNull())

    def check(self) -> Deductions:
        """Itself, if no expression failed; else raises the first error."""
        bad = self.errors().orderBy("rule_id", "stmt_idx", "substitution").select("error.code", "error.detail").take(1)
        if bad:
            raise EvaluationError(*bad[0])
        return self

    def triples(self, positive: bool | None = None) -> DataFrame:
        """The deduced signed triples (positive, s, p, o), duplicates kept."""
        df = self.df.where(F.col("kind") == "triple")
        return (df if positive is None else df.where(F.col("positive") == F.lit(positive))).select(*TRIPLE)

    def statements(self, g: str | None = None) -> DataFrame:
        """(positive, kind, s, p, o, g): all statements lifted to a graph. An equality has its terms in s and o and is of
        the graph too; a value that should be true is in s, and of no graph.
        """
        graph = F.when(F.col("kind") != "true", F.lit(g).cast("string"))
        return self.df.select("positive", "kind", "s", "p", "o", graph.alias("g"))

    def causes(self, graph: Graph) -> DataFrame:
        """(positive, s, p, o, cause: struct<kind, id>): the facts of ``graph`` as stated, the deduced triples as entailed.

        An entailed fact's id is that of its row of entailments; a fact with several causes has a row for each.
        """
        stated = graph.triples().select(*TRIPLE, F.struct(F.lit("stated").alias("kind"), F.xxhash64(*TRIPLE).alias("id")).alias("cause"))
        own = self.df.where((F.col("kind") == "triple") & F.col("error").isNull())
        entailed = own.select(*TRIPLE, F.struct(F.lit("entailed").alias("kind"), F.xxhash64("deduction_id").alias("id")).alias("cause"))
        return stated.unionByName(entailed)

    def entailments(self) -> DataFrame:
        """(id, rule_id, substitution) of each deduction."""
        return self.df.select(F.xxhash64("deduction_id").alias("id"), "rule_id", "substitution").distinct()

    def quads(self, g: str | None = None) -> DataFrame:
        """The deduced triples lifted to a graph; see statements for those of other kinds."""
        return self.triples().withColumn("g", F.lit(g).cast("string"))

    def insert_into(self, graph: Graph, g: str | None = None) -> Graph:
        """``graph`` with the positive triples."""
        return graph.insert(self.quads(g).where("positive"))

    def collect(self) -> list:
        return self.check().df.collect()

    def violations(self, graph: Graph, based: bool = False) -> DataFrame:
        """(rule_id, deduction_id, substitution, stmt_idx, positive, s, p, o, reason) of each statement that fails in ``graph``.

        Statements whose expressions failed are not among them; see errors. With ``based``, base columns are kept; see base.
        """
        kept = ["rule_id", "deduction_id", "substitution", "stmt_idx", "positive", "s", "p", "o"]

        def failing(kind: str, df: DataFrame) -> DataFrame:
            df = df.where((F.col("kind") == kind) & F.col("error").isNull())
            if kind == "triple":
                df, reason = graph.contains(df, True, self.predicates), F.lit("missing_triple")
            elif kind == "eq":
                alike = _alike(df)
                df, reason = df.where(F.when(F.col("positive"), ~alike).otherwise(alike)), F.when(F.col("positive"), "not_eq").otherwise("not_ne")
            else:
                boolean = terms.has_datatype(F.col("s"), terms.BOOLEAN)
                is_true = boolean & terms.lexical(F.col("s")).isin("true", "1")
                is_false = boolean & terms.lexical(F.col("s")).isin("false", "0")
                df, reason = df.where(~F.when(F.col("positive"), is_true).otherwise(is_false)), F.when(F.col("positive"), "not_true").otherwise("not_false")
            return df.select(*kept, reason.alias("reason"), *(c for c in df.columns if based and c not in COLUMNS))

        frames = {kind: [make() for k, make in self.parts if k in (kind, None)] for kind in ("triple", "eq", "true")}
        found = [failing(kind, _common(x)) for kind, x in frames.items() if x]
        return _common(found) if found else self.df.where(F.lit(False)).select(*kept, F.lit("").alias("reason"))

    def satisfied(self, graph: Graph) -> DataFrame:
        """Deduced triples that ``graph`` holds, with provenance."""
        return graph.contains(self.df.where((F.col("kind") == "triple") & F.col("error").isNull()), False, self.predicates)

    def validate(self, graph: Graph) -> Validation:
        """Raises if any expression failed; else the least violation by rule, statement and substitution, if any.

        Errors and violations are looked for by one job; Spark's own errors come as DatasetError.
        """
        kept = ["rule_id", "substitution", "stmt_idx", "positive", "s", "p", "o", "reason", "error"]
        failed = self.errors().withColumn("reason", F.lit("")).select(*kept)
        found = failed.unionByName(self.violations(graph).withColumn("error", no_error()).select(*kept))
        try:
            row = found.orderBy(F.col("error").isNull(), "rule_id", "stmt_idx", "substitution").take(1)
        except (PySparkException, Py4JError) as e:
            raise DatasetError(str(e)) from e
        if not row:
            return Validation()
        r = row[0]
        if r["error"]:
            raise EvaluationError(*r["error"])
        return Validation(Reason(r["reason"], r["positive"], tuple(x for x in (r["s"], r["p"], r["o"]) if x is not None), r["rule_id"]))


def _common(frames: list[DataFrame]) -> DataFrame:
    """The union of frames in the columns that all have."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, (f.select(*(F.col(f"`{c}`") for c in names)) for f in frames))


def _alike(df: DataFrame) -> Column:
    """Whether s and o are the same term, by base columns where one encoder makes both."""
    a, b = ([c[2:] for c in df.columns if c.startswith(f"{n} ")] for n in "so")
    return reduce(Column.__and__, (F.col(f"`s {c}`") == F.col(f"`o {c}`") for c in a)) if a and sorted(a) == sorted(b) else F.col("s") == F.col("o")


def base(place: str, slot: Slot, k: int = 0) -> str:
    """Where a frame has it: the column of the value in ``place`` (s, p or o) of which ``slot``'s encoder makes the term."""
    return f"{place} {slot.encoder.name} {k}"


def _readings(graph: Graph) -> DataFrame:
    """(resource, kind, value, error, lexical, any_error) of resources that stand for literals; several must agree, decimals by their value.

    They agree if the least is the greatest, which needs neither distinct terms nor a copy of the rows for each count. Only
    terms are dealt out, into as many tasks as shuffles have; sorting what is read of them before that takes much memory.
    """
    n = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    own = graph.interpretation.select("resource", "term").where(terms.is_literal(F.col("term"))).repartition(n, "resource")
    kind, value, error = comparable_parts(F.col("term"), F.col("lexical"))
    rows = own.withColumn("lexical", terms.lexical(F.col("term"))).select("resource", "lexical", kind.alias("kind"), value.alias("value"), error.alias("error"))
    rows = rows.withColumn("same", F.struct("kind", F.when(F.col("kind") == "d", canonical_decimal(F.col("value"))).otherwise(F.col("value")).alias("value")))
    many = F.when(F.min("same") != F.max("same"), fail("AmbiguousLiteral", F.col("resource")))
    several = F.when(F.min("lexical") != F.max("lexical"), fail("AmbiguousLiteral", F.col("resource")))
    return rows.groupBy("resource").agg(
        F.min("kind").alias("kind"), F.min("value").alias("value"), F.coalesce(F.min("error"), many).alias("error"), F.min("lexical").alias("lexical"), several.alias("any_error")
    )


def deduce(rule: Rule, graph: Graph, seed: DataFrame | dict[int, str] | None = None, exclude: int | None = None, rule_id: int = 0, namespace: str = "", generator: Callable[[Column], Column] | None = None) -> Deductions:
    """All deductions of ``rule`` over ``graph``, in one pass.

    ``seed`` gives initial bindings, as a dict or as a DataFrame of columns v<index>; ``exclude`` leaves out a pattern.
    Fresh resources are blanks named by a hash of namespace, rule, variable and substitution, so a retried task makes
    the same; equal substitutions are numbered where the graph can give any. ``generator`` may make other terms of what
    is hashed, a column of one text for each fresh resource; it must make different ones of different texts.
    """
    if isinstance(seed, dict):
        row = graph.spark.range(1)
        seed = row.select(*(F.lit(t).alias(f"v{k}") for k, t in seed.items())) if seed else None
    rule.check({int(c[1:]) for c in seed.columns} if seed is not None else None)
    statements = rule.conclusion.statements
    if not statements:
        return Deductions(graph.spark.createDataFrame([], SCHEMA), frozenset(), ())
    heads = [s.value.p for s in statements if isinstance(s.value, Triple)]
    predicates = frozenset(x.term for x in heads) if all(isinstance(x, Res) for x in heads) else None
    found = bindings(rule, graph, None if seed is None else Bound.of_terms(seed), exclude)
    ordered = not graph.one_graph or seed is not None

    def frame(found: Bound, which: Iterable[int]) -> DataFrame:
        return _frame(rule, graph, found, list(which), ordered, rule_id, namespace, generator)

    out = frame(found, range(len(statements)))
    # that two variables differ fails only where they are the same: such matches are joined on it, not found among all pairs
    differ = {} if seed is not None or exclude is not None else {
        k: (s.value.a.index, s.value.b.index) for k, s in enumerate(statements)
        if isinstance(s.value, Eq) and not s.positive and isinstance(s.value.a, Var) and isinstance(s.value.b, Var)
        and s.value.a != s.value.b and {s.value.a.index, s.value.b.index} <= set(found.encoders)
    }
    parts = [("eq", lambda k=k, pair=pair: frame(same(rule, graph, *pair), [k])) for k, pair in differ.items()]
    kinds = {_kind(s.value) for k, s in enumerate(statements) if k not in differ}
    parts += [(kind, lambda: out.where(~F.col("stmt_idx").isin(*differ)) if differ else out) for kind in sorted(kinds)]
    return Deductions(out, predicates, tuple(parts))


def _frame(rule: Rule, graph: Graph, found: Bound, which: list[int], ordered: bool, rule_id: int, namespace: str, generator) -> DataFrame:
    """COLUMNS of the statements ``which`` of each match, and the base columns of a single one."""
    df = found.terms(True)
    bound = sorted(found.encoders)
    vector = F.array(*(F.col(f"v{k}") if k in bound else F.lit(None).cast("string") for k in range(bound[-1] + 1))) if bound else F.array().cast("array<string>")
    mark = F.to_json(F.struct(vector.alias("v")))
    occurrence = F.lit(0)
    if rule.conclusion.fresh and ordered:
        keys = [f"v{k}" for k in bound] or ["_one"]
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
        occurrence = F.col("_n")
    identity = F.concat_ws("|", F.lit(namespace), F.lit(str(rule_id)), mark, occurrence.cast("string"))

    named = generator or (lambda x: F.concat(F.lit("_:f"), F.sha2(x, 256)))
    statements = [(k, rule.conclusion.statements[k]) for k in which]
    wanted = {v for _, s in statements for v in _in_calls(s.value)} & set(bound)
    df, parsed = parse_variables(df, wanted, None if graph.interpretation is None else _readings(graph))

    def variable(k: int) -> Value:
        if k >= rule.variables:
            return Value("resource", named(F.concat_ws("|", F.lit(str(k - rule.variables)), identity)))
        return parsed(k)

    made = [_statement(k, s, variable) for k, s in statements]
    fixed = F.lit(rule_id).alias("rule_id"), F.sha2(identity, 256).alias("deduction_id"), vector.alias("substitution")
    only = statements[0][1].value
    if len(made) > 1 or any(isinstance(e, Call) for e in expressions(only)):
        # all statements in one pass, and calls evaluated once
        return df.select(*fixed, F.inline(F.array(*(F.struct(*x) for x in made)))).select(*COLUMNS)
    places = {"triple": "spo", "eq": "so", "true": "s"}[_kind(only)]
    encoded = [(n, x.index, found.encoders[x.index]) for n, x in zip(places, expressions(only), strict=True) if isinstance(x, Var) and x.index in found.encoders]
    bases = [F.col(c).alias(f"{n} {e.name} {i}") for n, k, e in encoded if e != TERM for i, c in enumerate(found.names(k))]
    return df.select(*fixed, *made[0]).select(*COLUMNS) if not bases else df.select(*fixed, *made[0], *bases)


def _kind(statement: Statement) -> str:
    return "triple" if isinstance(statement, Triple) else "eq" if isinstance(statement, Eq) else "true"


def _in_calls(statement) -> set[int]:
    found = {v for e in expressions(statement) if isinstance(e, Call) for v in variables_of(e)}
    return found | (set(variables_of(statement.value)) if isinstance(statement, True_) else set())


def _statement(index: int, signed: Signed, variable) -> list[Column]:
    st = signed.value
    kind = _kind(st)
    parts = (st.s, st.p, st.o) if isinstance(st, Triple) else (st.a, None, st.b) if isinstance(st, Eq) else (st.value, None, None)
    values = [None if x is None else compile_expr(x, variable) for x in parts]
    error = first_error(*(v.error for v in values if v is not None))
    cols = [F.lit(None).cast("string") if v is None else instantiate(v) for v in values]
    if isinstance(st, True_) and values[0].kind == "resource":
        # an ill-formed boolean is an error; anything else that isn't one is a violation
        v = values[0]
        held, text, bad = comparable(v)
        if isinstance(held, str):
            error = first_error(error, bad if held == "b" else None)
        else:
            error = first_error(error, F.when(held == "b", bad))
            cols[0] = F.when(held == "b", F.when(text == "true", terms.literal("true", terms.BOOLEAN)).otherwise(terms.literal("false", terms.BOOLEAN))).otherwise(v.column)
    return [
        F.lit(index).alias("stmt_idx"), F.lit(signed.positive).alias("positive"), F.lit(kind).alias("kind"),
        *(c.alias(n) for c, n in zip(cols, "spo", strict=True)), (no_error() if error is None else error).alias("error"),
    ]

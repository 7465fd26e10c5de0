"""Scalar expressions as pairs of columns: a value and an error.

Errors are data, never raised inside a plan: Catalyst may reorder or drop expressions, so a raising one would fire
unpredictably. CASE keeps the order of evaluation: arguments first, all of them; then conversions, as far as and/or
and chained comparisons get. Comparisons are true or false, never null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.regex import DEPTH, GROUP, SOUND, UNSOUND, RegexError, to_python, translate
from quadrille.model import Call, Expr, Lit, Res, Var

ERROR = "struct<code:string,detail:string>"
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Value:
    """A compiled expression: kind is resource, boolean, decimal, string or regex; error is None if it can't fail."""

    kind: str
    column: Column
    error: Column | None = None
    constant: str | None = None
    #: Of a variable that was parsed before: (kind, value, error) and (lexical, error). See parse_variables.
    read: tuple[Column, Column, Column] | None = None
    any_read: tuple[Column, Column] | None = None


_registry: dict[str, Callable[[list[Value]], Value]] = {}


def register_function(name: str, builder: Callable[[list[Value]], Value]) -> None:
    """Makes (name ...) a function of rules; ``builder`` gets compiled arguments and gives a compiled result."""
    if name in ("or", "and", "matches", *COMPARISONS):
        raise ValueError(f"{name!r} is built in")
    _registry[name] = builder


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def fail(code: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def first_error(*errors: Column | None) -> Column | None:
    there = [e for e in errors if e is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def unexpected(expected: str, found: Column) -> Column:
    """Unexpected, naming an IRI or blank; a literal counts as anonymous."""
    return fail("Unexpected", F.concat(F.lit(f"{expected}, found "), F.when(terms.is_literal(found), "anonymous").otherwise(found)))


_BOOL_TRUE, _BOOL_ALL = ("true", "1"), ("true", "false", "1", "0")


def comparable_parts(term: Column, lex: Column | None = None) -> tuple[Column, Column, Column]:
    """(kind b/d/s/r/a, text, error) of a resource term; ``lex`` is its lexical form, if at hand."""
    lex = terms.lexical(term) if lex is None else lex
    boolean, decimal = terms.has_datatype(term, terms.BOOLEAN), terms.has_datatype(term, *terms.DECIMALS)
    string, regex = terms.has_datatype(term, terms.STRING), terms.has_datatype(term, terms.REGEX)
    kind = F.when(boolean, "b").when(decimal, "d").when(string, "s").when(regex, "r").otherwise("a")
    value = F.when(boolean, F.when(lex.isin(*_BOOL_TRUE), "true").otherwise("false")).when(decimal | string | regex, lex).otherwise(term)
    bad = (boolean & ~lex.isin(*_BOOL_ALL)) | (decimal & ~lex.rlike(terms.DECIMAL_LEXICAL)) | (regex & ~regex_ok(F.when(regex, lex).otherwise("")))
    return kind, value, F.when(bad, fail("InvalidLiteral", term))


def constant_parts(term: str) -> tuple[str, Column, Column | None]:
    """comparable_parts of a term that the rule names: the kind is known when the rule is compiled."""
    what, lex, datatype, lang = terms.split(term)
    if what != "literal" or lang or datatype not in (terms.BOOLEAN, terms.STRING, terms.REGEX, *terms.DECIMALS):
        return "a", F.lit(term), None
    kind = {terms.BOOLEAN: "b", terms.STRING: "s", terms.REGEX: "r"}.get(datatype, "d")
    fine = True
    if kind == "b":
        fine, lex = lex in _BOOL_ALL, "true" if lex in _BOOL_TRUE else "false"
    elif kind == "d":
        fine = re.search(terms.DECIMAL_LEXICAL.replace(r"\z", r"\Z"), lex) is not None
    elif kind == "r":
        try:
            translate(lex)
        except RegexError:
            fine = False
    return kind, F.lit(lex), None if fine else fail("InvalidLiteral", term)


def parse_variables(df: DataFrame, wanted: Iterable[int], readings: DataFrame | None = None) -> tuple[DataFrame, Callable[[int], Value]]:
    """``df`` (columns v<index>) with the parsed forms of variables in columns of their own, and the values made of them.

    Expressions mention a variable's kind and text many times over. As columns of an earlier projection they are
    computed once for each row, and what is compiled stays small. ``readings`` has what an interpretation says.
    """
    known = {}
    for k in sorted(wanted):
        n = {c: f"_{c}{k}" for c in ("kind", "value", "error", "lexical", "any_error")}
        term, lex = F.col(f"v{k}"), F.col(f"_lex{k}")
        there = None
        if readings is not None:
            own = readings.select(F.col("resource").alias(f"v{k}"), F.struct("kind", "value", "error", "lexical", "any_error").alias(f"_means{k}"))
            df = df.join(own, f"v{k}", "left")
            there = F.col(f"_means{k}")
        kind, value, error = comparable_parts(term, lex)
        made = {"kind": kind, "value": value, "error": error, "lexical": lex, "any_error": F.when(~terms.is_literal(term), unexpected("AnyLiteral", term))}
        if there is not None:
            made = {c: F.when(there.isNotNull(), there[c]).otherwise(x) for c, x in made.items()}
        df = df.withColumn(f"_lex{k}", terms.lexical(term)).withColumns({n[c]: x for c, x in made.items()})
        known[k] = n

    def value_of(k: int) -> Value:
        if k not in known:
            return Value("resource", F.col(f"v{k}"))
        c = {name: F.col(at) for name, at in known[k].items()}
        return Value("resource", F.col(f"v{k}"), read=(c["kind"], c["value"], c["error"]), any_read=(c["lexical"], c["any_error"]))

    return df, value_of


def regex_ok(pattern: Column) -> Column:
    """Whether a pattern from the data is one of the rule language: regex.sound as a column.

    The steps are folded over, which keeps them out of the code that is generated for each comparison.
    """
    steps = F.array(*(F.struct(F.lit(find).alias("find"), F.lit(put).alias("put")) for find, put in (*SOUND, *[(GROUP, "g")] * DEPTH)))
    return ~F.aggregate(steps, pattern, lambda out, x: F.regexp_replace(out, x["find"], x["put"])).rlike(UNSOUND)


def any_literal_parts(term: Column) -> tuple[Column, Column]:
    return terms.lexical(term), F.when(~terms.is_literal(term), unexpected("AnyLiteral", term))


def comparable(v: Value) -> tuple[Column | str, Column, Column | None]:
    """(kind, text, error); the kind is a string where it is known when the rule is compiled."""
    if v.kind == "resource":
        return v.read or (comparable_parts(v.column) if v.constant is None else constant_parts(v.constant))
    text = F.when(v.column, "true").otherwise("false") if v.kind == "boolean" else v.column
    return v.kind[0], text, None


def canonical_decimal(c: Column) -> Column:
    """The one spelling of a lexical decimal's value: no plus sign, no zeros at either end, no bare point, no -0."""
    whole = F.regexp_replace(F.regexp_extract(c, r"\A[+-]?([0-9]*)", 1), r"\A0+", "")
    rest = F.regexp_replace(F.regexp_extract(c, r"\.([0-9]*)\z", 1), r"0+\z", "")
    zero = (whole == "") & (rest == "")
    sign = F.when(F.startswith(c, F.lit("-")) & ~zero, "-").otherwise("")
    return F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))


def decimal_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for lexical decimals of any length, exactly."""
    short = a.rlike(r"\A[+-]?[0-9]{0,18}(\.[0-9]{0,16})?\z") & b.rlike(r"\A[+-]?[0-9]{0,18}(\.[0-9]{0,16})?\z")
    x, y = (c.try_cast("decimal(38,18)") for c in (a, b))
    fast = F.when(x < y, -1).when(x > y, 1).otherwise(0)

    def parts(c: Column) -> tuple[Column, Column]:
        whole = F.regexp_replace(F.regexp_extract(c, r"\A[+-]?([0-9]*)", 1), r"\A0+", "")
        rest = F.regexp_replace(F.regexp_extract(c, r"\.([0-9]*)\z", 1), r"0+\z", "")
        zero = (whole == "") & (rest == "")
        return F.when(zero, 0).when(F.startswith(c, F.lit("-")), -1).otherwise(1), F.struct(F.length(whole), whole, rest)

    (sa, ma), (sb, mb) = parts(a), parts(b)
    size = F.when(ma < mb, -1).when(ma > mb, 1).otherwise(0)
    exact = F.when(sa < sb, -1).when(sa > sb, 1).when(sa == 0, 0).otherwise(size * sa)
    return F.when(short, fast).otherwise(exact)


def _same_kind(op: str, kind: str, a: Column, b: Column) -> Column:
    """A comparison of two texts of one kind."""
    if kind == "r":
        return F.lit(op == "!=")
    if kind in ("a", "b"):
        return F.lit(False) if op in ("<", ">") else a != b if op == "!=" else a == b
    x, y = (a, b) if kind == "s" else (decimal_order(a, b), F.lit(0))
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def compare(op: str, a: tuple, b: tuple) -> Column:
    """One comparison of (kind, text) pairs, true or false.

    Different kinds are unequal and unordered; booleans and opaque terms have equality, but no order; regular
    expressions aren't even equal to themselves.
    """
    (ka, ta), (kb, tb) = a[:2], b[:2]
    fixed = {k for k in (ka, kb) if isinstance(k, str)}
    if "r" in fixed or len(fixed) == 2:
        return F.lit(op == "!=")
    if fixed:
        same = _same_kind(op, next(iter(fixed)), ta, tb)
    else:
        same = F.when(ka == "d", _same_kind(op, "d", ta, tb)).when(ka == "s", _same_kind(op, "s", ta, tb)).when(ka == "r", _same_kind(op, "r", ta, tb))
        same = same.otherwise(_same_kind(op, "a", ta, tb))
    if isinstance(ka, str) and isinstance(kb, str):
        out = same
    else:
        ka, kb = (F.lit(k) if isinstance(k, str) else k for k in (ka, kb))
        out = F.when(ka == kb, same).otherwise(op == "!=")
    return F.coalesce(out, F.lit(False))


def to_boolean(v: Value) -> tuple[Column, Column | None]:
    if v.kind == "boolean":
        return v.column, None
    if v.kind != "resource":
        return F.lit(False), fail("Unexpected", f"Boolean, found {v.kind}")
    kind, text, error = comparable(v)
    if isinstance(kind, str):
        return (text == "true", error) if kind == "b" else (F.lit(False), unexpected("Boolean", v.column))
    wrong = F.when(kind != "b", unexpected("Boolean", v.column)).otherwise(error)
    return (kind == "b") & (text == "true"), wrong


def to_any_literal(v: Value) -> tuple[Column, Column | None]:
    if v.kind == "resource" and v.constant is not None and v.any_read is None:
        what, lex, *_ = terms.split(v.constant)
        return (F.lit(lex), None) if what == "literal" else (F.lit(None).cast("string"), unexpected("AnyLiteral", v.column))
    if v.kind == "resource":
        return v.any_read or any_literal_parts(v.column)
    return (F.when(v.column, "true").otherwise("false") if v.kind == "boolean" else v.column), None


def compile_expr(expr: Expr, variables: Callable[[int], Value]) -> Value:
    if isinstance(expr, Var):
        return variables(expr.index)
    if isinstance(expr, Res):
        return Value("resource", F.lit(expr.term), constant=expr.term)
    if isinstance(expr, Lit):
        return Value(expr.kind, F.lit(expr.value), constant=expr.value)
    args = [compile_expr(x, variables) for x in expr.args]
    eager = first_error(*(a.error for a in args))
    if expr.function in ("or", "and"):
        out = _connective(args, expr.function == "or")
    elif expr.function in COMPARISONS:
        out = _chain(expr.function, args)
    elif expr.function == "matches":
        out = _matches(args)
    elif expr.function in _registry:
        out = _registry[expr.function](args)
    else:
        raise ValueError(f"no function {expr.function!r}")
    return Value(out.kind, out.column, first_error(eager, out.error))


def _connective(args: list[Value], stop: bool) -> Value:
    """Left to right until one is ``stop``; what comes after isn't looked at."""
    value, error = F.lit(not stop), None
    for a in reversed(args):
        v, e = to_boolean(a)
        value = F.when(v, F.lit(True) if stop else value).otherwise(value if stop else F.lit(False))
        if e is not None or error is not None:
            later = no_error() if error is None else F.when(v if stop else ~v, no_error()).otherwise(error)
            error = later if e is None else F.coalesce(e, later)
    return Value("boolean", value, error)


def _chain(op: str, args: list[Value]) -> Value:
    parts = [comparable(a) for a in args]
    if not parts:
        return Value("boolean", F.lit(True))
    value, error = F.lit(True), None
    for a, b in reversed(list(zip(parts[:-1], parts[1:], strict=True))):
        now = compare(op, a, b)
        value = F.when(now, value).otherwise(False)
        if error is not None or b[2] is not None:
            later = no_error() if error is None else F.when(now, error).otherwise(no_error())
            error = later if b[2] is None else F.coalesce(b[2], later)
    return Value("boolean", value, first_error(parts[0][2], error))


def _matches(args: list[Value]) -> Value:
    if len(args) != 2:
        return Value("boolean", F.lit(False), fail("InvalidArgumentCount", str(len(args))))
    pattern, text = args
    lex, text_error = to_any_literal(text)
    constant = pattern.constant
    if pattern.kind == "resource" and constant is not None and pattern.read is None:
        kind, value, datatype, _ = terms.split(constant)
        if kind != "literal" or datatype != terms.REGEX:
            return Value("boolean", F.lit(False), unexpected("Regex", pattern.column))
        constant = value
    elif pattern.kind not in ("regex", "resource"):
        return Value("boolean", F.lit(False), fail("Unexpected", f"Regex, found {pattern.kind}"))
    if constant is not None:
        try:
            java = translate(constant)
        except RegexError:
            return Value("boolean", F.lit(False), fail("InvalidLiteral", constant))
        return Value("boolean", F.coalesce(lex.rlike(java), F.lit(False)), text_error)
    kind, source, error = pattern.read or comparable_parts(pattern.column)
    found = _match_udf()(F.when(kind == "r", source), lex)
    wrong = F.when(kind != "r", unexpected("Regex", pattern.column)).when(error.isNotNull(), error).when(found == -1, fail("InvalidLiteral", source))
    return Value("boolean", F.coalesce(found == 1, F.lit(False)), first_error(wrong, text_error))


def _match_udf():
    """Patterns that come from the data: 1, 0, or -1 for one that can't be compiled, which Java would throw at."""
    @F.pandas_udf("int")
    def match(pattern: pd.Series, text: pd.Series) -> pd.Series:
        import re

        known: dict[str, re.Pattern | None] = {}

        def one(p: str | None, t: str | None) -> int:
            if p is None or t is None:
                return 0
            if p not in known:
                try:
                    translate(p)
                    known[p] = re.compile(to_python(p))
                except (RegexError, re.error):
                    known[p] = None
            return -1 if known[p] is None else int(known[p].search(t) is not None)

        return pd.Series([one(p, t) for p, t in zip(pattern, text, strict=True)], dtype="int32")

    return match


def instantiate(v: Value) -> Column:
    """The term of a value."""
    if v.kind == "resource":
        return v.column
    if v.kind == "boolean":
        return F.when(v.column, terms.literal("true", terms.BOOLEAN)).otherwise(terms.literal("false", terms.BOOLEAN))
    datatype = {"decimal": terms.DECIMAL, "string": terms.STRING, "regex": terms.REGEX}[v.kind]
    return F.lit(terms.literal(v.constant, datatype)) if v.constant is not None else terms.literal_column(v.column, datatype)

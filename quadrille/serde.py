"""Rules as JSON, each variant tagged by its name; decimals are strings, though numbers are read too."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

from quadrille.model import Call, Conclusion, Eq, Expr, Hypothesis, Lit, Pattern, Res, Rule, Signed, Statement, Triple, True_, Var


def _expr(x: Expr) -> dict[str, Any]:
    if isinstance(x, Var):
        return {"Var": x.index}
    if isinstance(x, Res):
        return {"Resource": x.term}
    if isinstance(x, Lit):
        return {"Literal": {x.kind.capitalize(): x.value}}
    return {"Call": [x.function, [_expr(a) for a in x.args]]}


def _read_expr(x: dict[str, Any]) -> Expr:
    (tag, v), = x.items()
    if tag == "Var":
        return Var(v)
    if tag == "Resource":
        return Res(v)
    if tag == "Literal":
        (kind, value), = v.items()
        return Lit.decimal(value if isinstance(value, str | int) else Decimal(repr(value))) if kind == "Decimal" else Lit(kind.lower(), value)
    if tag == "Call":
        return Call(v[0], tuple(_read_expr(a) for a in v[1]))
    raise ValueError(f"no expression {tag!r}")


def _statement(x: Statement) -> dict[str, Any]:
    if isinstance(x, Triple):
        return {"Triple": [_expr(x.s), _expr(x.p), _expr(x.o)]}
    return {"Eq": [_expr(x.a), _expr(x.b)]} if isinstance(x, Eq) else {"True": _expr(x.value)}


def _read_statement(x: dict[str, Any]) -> Statement:
    (tag, v), = x.items()
    if tag == "Triple":
        return Triple(*map(_read_expr, v))
    if tag == "Eq":
        return Eq(*map(_read_expr, v))
    if tag == "True":
        return True_(_read_expr(v))
    raise ValueError(f"no statement {tag!r}")


def _signed(x: Signed, inner: Any) -> dict[str, Any]:
    return {"Positive" if x.positive else "Negative": inner}


def _read_signed(x: dict[str, Any]) -> tuple[bool, Any]:
    (tag, v), = x.items()
    return {"Positive": True, "Negative": False}[tag], v


def to_json(rule: Rule) -> str:
    return json.dumps({
        "variables": rule.variables,
        "hypothesis": [_signed(p, [_expr(x) for x in p.value.parts]) for p in rule.hypothesis.patterns],
        "conclusion": {"variables": rule.conclusion.fresh, "statements": [_signed(s, _statement(s.value)) for s in rule.conclusion.statements]},
    })


def from_json(text: str) -> Rule:
    d = json.loads(text)
    body = [Signed(sign, Pattern(*map(_read_expr, v))) for sign, v in map(_read_signed, d["hypothesis"])]
    head = [Signed(sign, _read_statement(v)) for sign, v in map(_read_signed, d["conclusion"]["statements"])]
    return Rule(d["variables"], Hypothesis(tuple(body)), Conclusion(d["conclusion"]["variables"], tuple(head)))

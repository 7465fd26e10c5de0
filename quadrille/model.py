"""Rules as immutable values: patterns, expressions, statements and the rules made of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Generic, TypeVar

T = TypeVar("T")


class RuleError(ValueError):
    """A rule that can't be compiled, as it uses a variable that nothing binds."""


@dataclass(frozen=True)
class Signed(Generic[T]):
    """A value with a sign: asserted or denied."""

    positive: bool
    value: T


def positive(value: T) -> Signed[T]:
    return Signed(True, value)


def negative(value: T) -> Signed[T]:
    return Signed(False, value)


@dataclass(frozen=True)
class Var:
    index: int


@dataclass(frozen=True)
class Res:
    """A constant resource, by its canonical term."""

    term: str


@dataclass(frozen=True)
class Lit:
    """An expression literal: kind is decimal, string or regex; value its text."""

    kind: str
    value: str

    @staticmethod
    def decimal(value: int | str | Decimal) -> Lit:
        number = format(Decimal(value), "f")
        if "." in number:
            number = number.rstrip("0").rstrip(".")
        return Lit("decimal", "0" if number in ("-0", "") else number)


@dataclass(frozen=True)
class Call:
    """A function of expressions: or, and, matches, a comparison (= != < <= > >=) or a registered name."""

    function: str
    args: tuple[Expr, ...]


Expr = Var | Res | Lit | Call


@dataclass(frozen=True)
class Pattern:
    """A triple of variables and constants, matched in any graph."""

    s: Var | Res
    p: Var | Res
    o: Var | Res

    @property
    def parts(self) -> tuple[Var | Res, Var | Res, Var | Res]:
        return self.s, self.p, self.o

    def variables(self) -> set[int]:
        return {x.index for x in self.parts if isinstance(x, Var)}

    def accepts(self, fact: tuple[str, str, str]) -> bool:
        """Whether a ground triple matches, repeated variables included."""
        bound: dict[int, str] = {}
        return all(x.term == t if isinstance(x, Res) else bound.setdefault(x.index, t) == t for x, t in zip(self.parts, fact, strict=True))


@dataclass(frozen=True)
class Triple:
    s: Expr
    p: Expr
    o: Expr


@dataclass(frozen=True)
class Eq:
    """Identity of two terms."""

    a: Expr
    b: Expr


@dataclass(frozen=True)
class True_:
    """An expression whose value is true."""

    value: Expr


Statement = Triple | Eq | True_


def expressions(statement: Statement) -> tuple[Expr, ...]:
    return (statement.s, statement.p, statement.o) if isinstance(statement, Triple) else (statement.a, statement.b) if isinstance(statement, Eq) else (statement.value,)


def variables_of(expr: Expr) -> Iterator[int]:
    if isinstance(expr, Var):
        yield expr.index
    elif isinstance(expr, Call):
        for x in expr.args:
            yield from variables_of(x)


@dataclass(frozen=True)
class Hypothesis:
    patterns: tuple[Signed[Pattern], ...] = ()

    def variables(self) -> set[int]:
        return set().union(*(x.value.variables() for x in self.patterns))


@dataclass(frozen=True)
class Conclusion:
    """Statements, and how many fresh resources they name (indices follow those of the rule's variables)."""

    fresh: int
    statements: tuple[Signed[Statement], ...]

    def variables(self) -> set[int]:
        return {v for st in self.statements for e in expressions(st.value) for v in variables_of(e)}


@dataclass(frozen=True)
class Rule:
    """``hypothesis`` implies ``conclusion``, over ``variables`` variables numbered from 0."""

    variables: int
    hypothesis: Hypothesis
    conclusion: Conclusion

    def check(self, bound: set[int] | None = None) -> None:
        """Raises RuleError if the conclusion uses a variable that is neither bound nor fresh."""
        known = self.hypothesis.variables() | (bound or set())
        known |= set(range(self.variables, self.variables + self.conclusion.fresh))
        if lost := sorted(self.conclusion.variables() - known):
            raise RuleError(f"variables {lost} of the conclusion are bound nowhere")

    # the verbs; see operators
    def deduce(self, graph, **kw):
        from quadrille.operators.deduce import deduce

        return deduce(self, graph, **kw)

    def deduce_from(self, graph, seed, exclude: int | None = None, **kw):
        from quadrille.operators.deduce import deduce

        return deduce(self, graph, seed=seed, exclude=exclude, **kw)

    def violations(self, graph, based: bool = False, **kw):
        return self.deduce(graph, **kw).violations(graph, based)

    def validate(self, graph, **kw) -> Validation:
        return self.deduce(graph, **kw).validate(graph)


@dataclass(frozen=True)
class Cause:
    """Where a fact comes from: stated, or entailed by the entailment of that number."""

    kind: str
    id: int

    @staticmethod
    def stated(number: int) -> Cause:
        return Cause("stated", number)

    @staticmethod
    def entailed(number: int) -> Cause:
        return Cause("entailed", number)

    def into_entailed(self) -> int | None:
        return self.id if self.kind == "entailed" else None


@dataclass(frozen=True)
class Entailment:
    rule: int
    substitution: tuple[str | None, ...]


@dataclass(frozen=True)
class Reason:
    """Why validation failed: missing_triple, not_eq, not_ne, not_true or not_false, with the terms concerned."""

    code: str
    positive: bool
    terms: tuple[str, ...]
    rule: int = 0


@dataclass(frozen=True)
class Validation:
    reason: Reason | None = None

    @property
    def is_valid(self) -> bool:
        return self.reason is None

    @property
    def is_invalid(self) -> bool:
        return self.reason is not None

"""Tables as graphs, without copying: each column of a table is a branch of quads with a constant predicate.

What makes a term of a value is kept beside the value's column, so a constant of a pattern becomes a filter on that
column, branches are joined on values, and terms are made only of what comes out.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.sources.graph import Branch, Encoder, Slot

BASE = "https://example.org/"
_INTEGER = re.compile(r"0|-?[1-9][0-9]*")


def _number(text: str) -> tuple | None:
    """The value of an integer's only spelling."""
    return (int(text),) if _INTEGER.fullmatch(text) and abs(int(text)) < 1 << 63 else None


def _lexical(term: str, datatype: str) -> str | None:
    try:
        kind, value, own, _ = terms.split(term)
    except ValueError:
        return None
    return value if kind == "literal" and own == datatype and terms.canonical(term) == term else None


def node(kind: str, key: Column) -> Slot:
    """<BASE kind/key> for an integer key."""
    head = f"<{BASE}{kind}/"
    encode = lambda c: F.concat(F.lit(head), c.cast("string"), F.lit(">"))
    decode = lambda t: _number(t[len(head) : -1]) if t.startswith(head) and t.endswith(">") else None
    return Slot((key,), Encoder(f"node {kind}", encode, decode))


def blank(kind: str, *keys: Column) -> Slot:
    """_:kind and the keys, integers, joined by _."""
    head = f"_:{kind}"

    def decode(t: str) -> tuple | None:
        values = [_number(x) for x in t[len(head) :].split("_")] if t.startswith(head) else []
        return tuple(v[0] for v in values) if len(values) == len(keys) and None not in values else None

    encode = lambda *c: F.concat(F.lit(head), F.concat_ws("_", *(x.cast("string") for x in c)))
    return Slot(keys, Encoder(f"blank {kind} {len(keys)}", encode, decode))


def key_of(term: Column, kind: str) -> Column:
    """The number in a node made by ``node``."""
    return F.substring(term, len(f"<{BASE}{kind}/") + 1, 30).substr(F.lit(1), F.length(term) - len(f"<{BASE}{kind}/") - 1).cast("long")


def name(local: str) -> str:
    return f"<{BASE}{local}>"


def integer(value: Column, datatype: str = "int") -> Slot:
    kind = terms.XSD + datatype
    decode = lambda t: None if (x := _lexical(t, kind)) is None else _number(x)
    return Slot((value,), Encoder(f"integer {datatype}", lambda c: terms.literal_column(c.cast("string"), kind, plain=True), decode))


def whole_decimal(value: Column) -> Slot:
    """xsd:decimal of an integer column."""
    return integer(value, "decimal")


def money(value: Column) -> Slot:
    """xsd:decimal with two digits after the point."""

    def decode(t: str) -> tuple | None:
        x = _lexical(t, terms.DECIMAL)
        return (Decimal(x),) if x and re.fullmatch(r"-?(0|[1-9][0-9]{0,15})\.[0-9]{2}", x) and x != "-0.00" else None

    return Slot((value.cast("decimal(18,2)"),), Encoder("money", lambda c: terms.literal_column(c.cast("string"), terms.DECIMAL, plain=True), decode))


def boolean(value: Column) -> Slot:
    """xsd:boolean, spelled 1 or 0."""
    decode = lambda t: {"1": (True,), "0": (False,)}.get(_lexical(t, terms.BOOLEAN) or "")
    return Slot((value,), Encoder("boolean", lambda c: terms.literal_column(F.when(c, "1").otherwise("0"), terms.BOOLEAN, plain=True), decode))


def text(value: Column) -> Slot:
    decode = lambda t: None if (x := _lexical(t, terms.STRING)) is None else (x,)
    return Slot((value,), Encoder("text", terms.literal_column, decode))


def branch(df: DataFrame, s: Slot | Column | str, p: str, o: Slot | Column | str, positive: Column | bool = True, g: Slot | Column | str | None = None) -> Branch:
    """Quads of one predicate (a term). Slots, columns of terms or constant terms; rows with a null in one make none."""
    return Branch(df, Slot.of(s), Slot.of(p), Slot.of(o), positive, None if g is None else Slot.of(g))

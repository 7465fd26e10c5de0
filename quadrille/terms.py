"""Terms as canonical N-Triples strings, on the driver and as Spark columns.

``<iri>``, ``_:label``, ``"lex"`` (xsd:string), ``"lex"^^<datatype>``, ``"lex"@lang``. Two terms are the same if and only if
their strings are, so joins are plain equi-joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
STRING, BOOLEAN, DECIMAL = XSD + "string", XSD + "boolean", XSD + "decimal"
#: Datatype of regular expressions as terms.
REGEX = "https://example.org/datatype#Regex"
#: Datatypes whose values are compared as decimals.
DECIMALS = tuple(
    XSD + x
    for x in (
        "decimal", "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger",
        "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
    )
)
DECIMAL_LEXICAL = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def escape(lexical: str) -> str:
    return re.sub(r'[\\"\n\r]', lambda m: _ESCAPES[m[0]], lexical)


def unescape(escaped: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, escaped, flags=re.S)


def iri(value: str) -> str:
    return f"<{value}>"


def blank(label: str) -> str:
    return f"_:{label}"


def literal(lexical: str, datatype: str = STRING, lang: str | None = None) -> str:
    if lang:
        return f'"{escape(lexical)}"@{lang}'
    return f'"{escape(lexical)}"' + ("" if datatype == STRING else f"^^<{datatype}>")


def escape_column(lexical: Column) -> Column:
    out = F.replace(lexical, F.lit("\\"), F.lit("\\\\"))
    for raw in ('"', "\n", "\r"):
        out = F.replace(out, F.lit(raw), F.lit(_ESCAPES[raw]))
    return out


def literal_column(lexical: Column, datatype: str = STRING, plain: bool = False) -> Column:
    """A literal of ``lexical``; ``plain`` promises that nothing in it needs escaping (numbers, booleans)."""
    inner = lexical if plain else escape_column(lexical)
    return F.concat(F.lit('"'), inner, F.lit('"' if datatype == STRING else f'"^^<{datatype}>'))


def is_literal(term: Column) -> Column:
    return F.startswith(term, F.lit('"'))


def suffix(term: Column) -> Column:
    """What follows the closing quote of a literal."""
    return F.substring_index(term, '"', -1)


def lexical(term: Column) -> Column:
    """The unescaped lexical form of a literal, whose term is canonical: it has the escapes of ``escape`` and no others."""
    inner = F.substring(term, F.lit(2), F.length(term) - F.length(suffix(term)) - F.lit(2))

    def plain(part: Column) -> Column:
        for raw in ('"', "\n", "\r"):
            part = F.replace(part, F.lit(_ESCAPES[raw]), F.lit(raw))
        return part

    # what lies between escaped backslashes has no backslash but those of the other escapes
    out = F.array_join(F.transform(F.split(inner, r"\\\\", -1), plain), "\\")
    return F.when(F.contains(inner, F.lit("\\")), out).otherwise(inner)


def has_datatype(term: Column, *datatypes: str) -> Column:
    ends = suffix(term).isin(*("" if d == STRING else f"^^<{d}>" for d in datatypes))
    return is_literal(term) & ends


def split(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, value, datatype, language) of a term; kind is iri, blank or literal."""
    if term.startswith("<") and term.endswith(">"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "blank", term[2:], None, None
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?', term, re.S)
    if not m:
        raise ValueError(f"not a term: {term!r}")
    return "literal", unescape(m[1]), None if m[3] else m[2] or STRING, m[3]


def canonical(term: str) -> str:
    """The canonical form of a term's string."""
    kind, value, datatype, lang = split(term)
    return iri(value) if kind == "iri" else blank(value) if kind == "blank" else literal(value, datatype or STRING, lang)

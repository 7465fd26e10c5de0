"""Terms, the text form, JSON and regular expressions, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quadrille import Call, Cause, Eq, Lit, ParseError, Pattern, Res, RuleError, Signed, System, Triple, True_, Var, parse_expression, parse_pattern, parse_rule, parse_statement, serde, terms
from quadrille.functions.regex import RegexError, translate

RULE = """for ?x, ?y {
  ?x <https://example.org/#p> ?y . ! ?y <https://example.org/#q> "hello"^^<https://example.org/#t> .
} => for ?a, ?b {
  ?x <https://example.org/#r> ?a . ! ?a = ?b . (and (= ?x ?y) (matches /"^a\\.b$"/ "ab") (<= 1 2.50 "3"^^<http://www.w3.org/2001/XMLSchema#int>)) .
  _:c ?y "plain" .
}"""


@given(st.text())
def test_literals_round_trip(text):
    kind, value, datatype, lang = terms.split(terms.literal(text))
    assert (kind, value, datatype, lang) == ("literal", text, terms.STRING, None)


def test_canonical_terms():
    assert terms.canonical(f'"a"^^<{terms.STRING}>') == '"a"'
    assert terms.canonical('"\\u0041\\t"') == '"A\t"'
    assert terms.split('"chat"@fr') == ("literal", "chat", None, "fr")
    with pytest.raises(ValueError):
        terms.split("nothing")


def test_rule_text():
    r = parse_rule(RULE)
    assert r.variables == 2 and r.conclusion.fresh == 2
    assert [p.positive for p in r.hypothesis.patterns] == [True, False]
    assert r.hypothesis.patterns[1].value.o == Res('"hello"^^<https://example.org/#t>')
    kinds = [type(s.value) for s in r.conclusion.statements]
    assert kinds == [Triple, Eq, True_, Triple]
    assert r.conclusion.statements[0].value.o == Var(2) and not r.conclusion.statements[1].positive
    assert r.conclusion.statements[3].value == Triple(Res("_:c"), Var(1), Lit("string", "plain"))
    assert serde.from_json(serde.to_json(r)) == r


def test_parts_of_the_text():
    assert parse_pattern("?x <https://e/p> ?x .", "x") == Signed(True, Pattern(Var(0), Res("<https://e/p>"), Var(0)))
    assert parse_statement("! (>= ?x 18) .", "x") == Signed(False, True_(Call(">=", (Var(0), Lit("decimal", "18")))))
    assert parse_expression("(or)") == Call("or", ())
    for bad in ("?y <https://e/p> ?x .", "?x ?x", "?x ?x ?x"):
        with pytest.raises(ParseError):
            parse_pattern(bad, "x")
    with pytest.raises(ParseError):
        parse_rule("for ?x, ?x { } => { }")


def test_decimals_are_read_as_numbers_too():
    assert serde._read_expr({"Literal": {"Decimal": 2.5}}) == Lit("decimal", "2.5")
    assert serde._read_expr({"Literal": {"Decimal": 18}}) == Lit.decimal("18.0") == Lit("decimal", "18")


def test_unbound_head_variable():
    with pytest.raises(RuleError):
        parse_rule("for ?x, ?y { ?x <https://e/p> ?x . } => { ?x <https://e/q> ?y . }").check()


def test_equal_rules_are_one():
    a = parse_rule("for ?x { ?x <https://e/p> ?x . } => { }")
    b = parse_rule("for ?other { ?other <https://e/p> ?other . } => { }")
    s = System([a, b, a])
    assert len(s) == 1 and s.add(b) == 0 and s.get(1) is None
    assert s.paths_for(Signed(True, ("_:a", "<https://e/p>", "_:a"))) == [(0, 0)]
    assert s.paths_for(Signed(True, ("_:a", "<https://e/p>", "_:b"))) == [] == s.paths_for(Signed(False, ("_:a", "<https://e/p>", "_:a")))


def test_cause():
    assert Cause.entailed(3).into_entailed() == 3 and Cause.stated(3).into_entailed() is None


def test_regex_dialect():
    assert translate("a$") == r"(?dU)a\z"
    assert translate(r"[$]\$$") == r"(?dU)[$]\$\z"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "(", "a++"):
        with pytest.raises(RegexError):
            translate(bad)

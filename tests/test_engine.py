"""Deduction, validation and systems over small graphs, held against a naive evaluator and the tables of semantics."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quadrille import Call, Conclusion, EvaluationError, Graph, Hypothesis, Lit, Pattern, Res, Rule, RuleError, Signed, System, Triple, Var, negative, parse_rule, positive, terms
from quadrille.functions.expressions import Value, compile_expr, parse_variables, register_function

EX = "https://example.org/"
XSD = terms.XSD


def iri(x):
    return f"<{EX}{x}>"


def rule(text):
    import re

    return parse_rule(re.sub(r"\bex:(\w+)", rf"<{EX}\1>", text))


def int_(x):
    return terms.literal(x, XSD + "int")


AGE = rule("for ?x, ?age { ?x ex:age ?age . } => { (>= ?age 18) . }")
HUMAN = rule("for ?p, ?c { ?p ex:citizenOf ?c . } => { ?p ex:type ex:Human . }")


def test_age(spark):
    assert AGE.validate(Graph.of(spark, [("_:0", iri("age"), int_("21"))])).is_valid
    out = AGE.validate(Graph.of(spark, [("_:0", iri("age"), int_("12"))]))
    assert out.is_invalid and out.reason.code == "not_true"
    assert out.reason.terms == (terms.literal("false", terms.BOOLEAN),)


def test_email(spark):
    r = rule(r'for ?x, ?m { ?x ex:email ?m . } => { (matches /"^[\w\-\.]+@([\w-]+\.)+[\w-]{2,}$"/ ?m) . }')
    assert r.validate(Graph.of(spark, [("_:0", iri("email"), '"user@domain.com"')])).is_valid
    assert r.validate(Graph.of(spark, [("_:0", iri("email"), '"user"')])).is_invalid


def test_deduce_insert_validate(spark):
    g = Graph.of(spark, [("_:FrançoisDupont", iri("citizenOf"), "_:France")])
    missing = HUMAN.validate(g)
    assert missing.reason.code == "missing_triple" and missing.reason.terms == ("_:FrançoisDupont", iri("type"), iri("Human"))
    more = HUMAN.deduce(g).insert_into(g)
    assert more.quads.count() == 2 and HUMAN.validate(more).is_valid
    assert more.has(positive(("_:FrançoisDupont", iri("type"), iri("Human")))) and not more.has(negative(("_:FrançoisDupont", iri("type"), iri("Human"))))


def test_graphs_are_a_bag_of_matches(spark):
    g = Graph.of(spark, [("_:a", iri("citizenOf"), "_:b", iri("g1")), ("_:a", iri("citizenOf"), "_:b", iri("g2"))])
    assert HUMAN.deduce(g).df.count() == 2
    fresh = rule("for ?p, ?c { ?p ex:citizenOf ?c . } => for ?n { ?p ex:name ?n . ?n ex:of ?c . }").deduce(g).collect()
    names = [r["o"] for r in fresh if r["stmt_idx"] == 0]
    assert len(set(names)) == 2 and {r["s"] for r in fresh if r["stmt_idx"] == 1} == set(names)


def test_negative_patterns_match_denied_facts_only(spark):
    r = rule("for ?x, ?y { ! ?x ex:p ?y . } => { ?x ex:q ?y . }")
    assert r.deduce(Graph.of(spark, [("_:a", iri("p"), "_:b")])).is_empty()
    assert r.deduce(Graph.of(spark, [negative(("_:a", iri("p"), "_:b"))])).df.count() == 1


def test_empty_hypothesis(spark):
    g = Graph.of(spark, [("_:a", iri("p"), "_:b")])
    r = rule("{ } => { ex:a ex:p ex:b . }")
    rows = r.deduce(g).collect()
    assert len(rows) == 1 and rows[0]["substitution"] == []
    assert System([r]).deduce_from(g, positive(("_:a", iri("p"), "_:b"))).is_empty()


def test_existentials_are_shared_and_stable(spark):
    g = Graph.of(spark, [(f"_:{k}", iri("p"), "_:o") for k in range(3)])
    r = rule("for ?x, ?y { ?x ex:p ?y . } => for ?c { ?x ex:q ?c . ?c ex:r ?y . }")
    a, b = r.deduce(g).collect(), r.deduce(g).collect()
    assert len({x["o"] for x in a if x["stmt_idx"] == 0}) == 3
    assert {x["o"] for x in a if x["stmt_idx"] == 0} == {x["s"] for x in a if x["stmt_idx"] == 1}
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert r.validate(g).is_invalid


def test_head_numbers_become_decimals(spark):
    r = rule("for ?x, ?y { ?x ex:p ?y . } => { ?x ex:size 18 . }")
    assert r.deduce(Graph.of(spark, [("_:a", iri("p"), "_:b")])).collect()[0]["o"] == terms.literal("18", terms.DECIMAL)


def test_incremental(spark):
    r = rule("for ?a, ?b, ?c { ?a ex:in ?b . ?b ex:in ?c . } => { ?a ex:in ?c . }")
    g = Graph.of(spark, [("_:1", iri("in"), "_:1"), ("_:1", iri("in"), "_:2")])
    found = System([r]).deduce_from(g, positive(("_:1", iri("in"), "_:1"))).collect()
    assert sorted(x["substitution"] for x in found) == [["_:1", "_:1", "_:1"]] * 2 + [["_:1", "_:1", "_:2"]]
    # a delta that isn't in the graph doesn't meet itself
    alone = System([r]).deduce_from(g, positive(("_:9", iri("in"), "_:9")))
    assert alone.is_empty()
    ground = System([rule("{ ex:a ex:p ex:b . } => { ex:a ex:q ex:b . }")])
    assert ground.deduce_from(g, positive((iri("a"), iri("p"), iri("b")))).df.count() == 1


def test_seed_and_exclude(spark):
    g = Graph.of(spark, [("_:c1", iri("seg"), '"B"'), ("_:c2", iri("seg"), '"C"')])
    r = rule("for ?o, ?c, ?s { ?o ex:cust ?c . ?c ex:seg ?s . } => { ?o ex:seg ?s . }")
    assert [x["o"] for x in r.deduce_from(g, {0: "_:o1", 1: "_:c2"}, exclude=0).collect()] == ['"C"']
    with pytest.raises(RuleError):
        rule("for ?x, ?y { ?x ex:p ?x . } => { ?x ex:q ?y . }").deduce(g)


def test_equality_statements(spark):
    g = Graph.of(spark, [("_:a", iri("p"), "_:a"), ("_:a", iri("p"), "_:b")])
    eq, ne = rule("for ?x, ?y { ?x ex:p ?y . } => { ?x = ?y . }"), rule("for ?x, ?y { ?x ex:p ?y . } => { ! ?x = ?y . }")
    assert [(r["reason"], r["o"]) for r in eq.violations(g).collect()] == [("not_eq", "_:b")]
    assert [(r["reason"], r["o"]) for r in ne.violations(g).collect()] == [("not_ne", "_:a")]


def test_true_of_other_terms(spark):
    g = Graph.of(spark, [("_:a", iri("p"), iri("x"))])
    for head, reason in (("?y .", "not_true"), ("! ?y .", "not_false")):
        assert rule(f"for ?x, ?y {{ ?x ex:p ?y . }} => {{ {head} }}").validate(g).reason.code == reason
    bad = Graph.of(spark, [("_:a", iri("p"), terms.literal("maybe", terms.BOOLEAN))])
    with pytest.raises(EvaluationError, match="InvalidLiteral"):
        rule("for ?x, ?y { ?x ex:p ?y . } => { ?y . }").validate(bad)


def test_errors_come_before_violations(spark):
    g = Graph.of(spark, [("_:a", iri("age"), int_("12")), ("_:b", iri("age"), int_("old"))])
    with pytest.raises(EvaluationError) as e:
        AGE.validate(g)
    assert e.value.code == "InvalidLiteral"


def test_system_is_invalid_if_a_rule_is(spark):
    g = Graph.of(spark, [("_:a", iri("age"), int_("12")), ("_:a", iri("type"), iri("Human")), ("_:a", iri("citizenOf"), "_:f")])
    assert System([HUMAN]).validate(g).is_valid
    assert System([HUMAN, AGE]).validate(g).reason.rule == 1
    assert System().deduce(g).is_empty() and System().validate(g).is_valid


T, FL = Res(terms.literal("true", terms.BOOLEAN)), Res(terms.literal("false", terms.BOOLEAN))
VALUES = {
    "any": (Res(iri("a")), Res(iri("b"))), "boolean": (FL, T), "decimal": (Lit("decimal", "2"), Lit("decimal", "10")),
    "string": (Lit("string", "10"), Lit("string", "9")), "regex": (Lit("regex", "a"), Lit("regex", "b")),
}


def evaluate(spark, exprs, columns=None):
    row = spark.range(1) if columns is None else spark.createDataFrame([tuple(columns)], ", ".join(f"v{k} string" for k in range(len(columns))))
    row, variable = parse_variables(row, range(len(columns or ())))
    out = []
    for k, e in enumerate(exprs):
        v = compile_expr(e, variable)
        out += [v.column.alias(f"r{k}"), (F.lit(None).cast("string") if v.error is None else v.error["code"]).alias(f"e{k}")]
    r = row.select(*out).collect()[0]
    return [r[f"e{k}"] or r[f"r{k}"] for k in range(len(exprs))]


def expected(op, ka, a, kb, b):
    same = a == b
    if ka != kb or ka == "regex":
        return op == "!="
    if ka in ("any", "boolean"):
        return {"=": same, "!=": not same, "<": False, ">": False, "<=": same, ">=": same}[op]
    x, y = a, b
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def test_comparison_table(spark):
    cases, want = [], []
    rank = {"any": (0, 1), "boolean": (0, 1), "decimal": (2, 10), "string": ("10", "9"), "regex": ("a", "b")}
    for op, ka, kb, i, j in itertools.product(("=", "!=", "<", "<=", ">", ">="), VALUES, VALUES, (0, 1), (0, 1)):
        cases.append(Call(op, (VALUES[ka][i], VALUES[kb][j])))
        want.append(expected(op, ka, rank[ka][i], kb, rank[kb][j]))
    got = []
    for k in range(0, len(cases), 75):
        got += evaluate(spark, cases[k : k + 75])
    assert got == want


def test_comparison_from_terms(spark):
    v = [int_("18"), terms.literal("18.0", terms.DECIMAL), '"18"', terms.literal("9" * 40, XSD + "integer"), terms.literal("-" + "9" * 40 + ".5", terms.DECIMAL), int_("x"), '"chat"@fr', terms.literal("-0", XSD + "int")]
    a = [Var(k) for k in range(len(v))]
    cases = {
        Call("=", (a[0], a[1])): True, Call("=", (a[0], a[2])): False, Call("!=", (a[0], a[2])): True, Call("<", (a[0], a[3])): True, Call("<", (a[4], a[0])): True,
        Call("<", (a[4], a[3])): True, Call("=", (a[7], Lit("decimal", "0"))): True, Call("=", (a[6], a[6])): True, Call("<", (Lit("decimal", "5"), Lit("decimal", "3"), a[5])): False,
        Call("<", (Lit("decimal", "3"), Lit("decimal", "5"), a[5])): "InvalidLiteral", Call("<", (a[5],)): "InvalidLiteral", Call("<", ()): True, Call("<", (a[0],)): True,
    }
    assert evaluate(spark, list(cases), v) == list(cases.values())


def test_connectives_and_matches(spark):
    s, bad = Lit("string", "s"), Call("matches", (Lit("regex", "a"),))
    v = ['"a\\n"', '"é"', '"\\r"', iri("x"), terms.literal("^a", terms.REGEX), terms.literal("(", terms.REGEX), int_("42")]
    a = [Var(k) for k in range(len(v))]
    m = lambda p, x: Call("matches", (Lit("regex", p) if isinstance(p, str) else p, x))
    cases = {
        Call("or", (T, s)): True, Call("or", (FL, s)): "Unexpected", Call("or", ()): False, Call("and", ()): True, Call("and", (FL, s)): False, Call("and", (T, s)): "Unexpected",
        Call("or", (T, bad)): "InvalidArgumentCount", bad: "InvalidArgumentCount", m("a$", a[0]): False, m(r"^\w$", a[1]): True, m("^.$", a[2]): True,
        Call("matches", (Lit("string", "a"), a[0])): "Unexpected", m("a", a[3]): "Unexpected", m(a[4], a[0]): True, m(a[5], a[0]): "InvalidLiteral", m(a[0], a[0]): "Unexpected",
        m("^4", a[6]): True, m("(?=a)", a[0]): "InvalidLiteral",
    }
    assert evaluate(spark, list(cases), v) == list(cases.values())


def test_registered_function(spark):
    register_function("starts_with_a", lambda args: Value("boolean", F.startswith(terms.lexical(args[0].column), F.lit("a"))))
    r = rule("for ?x, ?y { ?x ex:p ?y . } => { (starts_with_a ?y) . }")
    assert r.validate(Graph.of(spark, [("_:a", iri("p"), '"ab"')])).is_valid
    assert r.validate(Graph.of(spark, [("_:a", iri("p"), '"b"')])).is_invalid


def test_interpretation(spark):
    means = spark.createDataFrame([("_:n", int_("20")), ("_:m", int_("20")), ("_:m", int_("30")), ("_:k", int_("20")), ("_:k", terms.literal("20.0", terms.DECIMAL))], "resource string, term string")
    one = Graph.of(spark, [("_:a", iri("age"), "_:n")], means)
    assert AGE.validate(one).is_valid
    with pytest.raises(EvaluationError, match="AmbiguousLiteral"):
        AGE.validate(Graph.of(spark, [("_:a", iri("age"), "_:m")], means))
    assert AGE.validate(Graph.of(spark, [("_:a", iri("age"), "_:k")], means)).is_valid  # one value, spelled in two ways


SOUND_PATTERNS = [r"^[\w\-\.]+@([\w-]+\.)+[\w-]{2,}$", "a|(b*)c?", r"\(", r"[(*]", "(?i)x", "(?:a)(?P<n>b)", r"\p{L}+\x{41}", r"\\1", "[]a]", "[[:alpha:]_]+", "((((a))))", "", "a{2}"]
UNSOUND_PATTERNS = ["(", "a)", ")(", "[a", "*a", "a|+b", "(?=a)", "(?<!a)b", r"(a)\1", "a\\", "(*)", "a*+", "(?>a)", "{2}"]


def test_patterns_of_the_data_are_held_to_the_dialect(spark):
    from quadrille.functions import regex

    assert all(map(regex.sound, SOUND_PATTERNS)) and not any(map(regex.sound, UNSOUND_PATTERNS))
    r = rule('for ?x, ?y { ?x ex:p ?y . } => { (!= ?y "z") . }')
    facts = [(f"_:{k}", iri("p"), terms.literal(p, terms.REGEX)) for k, p in enumerate(SOUND_PATTERNS + UNSOUND_PATTERNS)]
    bad = {x["substitution"][1] for x in r.deduce(Graph.of(spark, facts)).errors().collect()}
    assert bad == {terms.literal(p, terms.REGEX) for p in UNSOUND_PATTERNS}


def test_lexical_forms(spark):
    texts = ["", "a", "\\", "\\\\n", '"', 'a\\"b', "\n\r", "\x00\\", "\\\x00n", "é\\\\", "^^<x>", '"^^<y>']
    df = spark.createDataFrame([(k, terms.literal(t, d)) for k, t in enumerate(texts) for d in (terms.STRING, terms.DECIMAL)], "k int, term string")
    assert all(texts[r["k"]] == r["x"] for r in df.select("k", terms.lexical(F.col("term")).alias("x")).collect())


def test_constants_are_pushed_to_the_files(spark, tmp_path):
    from quadrille.sources import triplify as t

    spark.createDataFrame([(1, "x", 2.5, True), (2, 'a"\\', -1.0, False), (3, None, None, None)], "k int, name string, cost double, flag boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    slots = {"name": t.text(F.col("name")), "cost": t.money(F.col("cost")), "flag": t.boolean(F.col("flag")), "next": t.node("n", F.col("k") + 1)}
    g = Graph.union_of([t.branch(df, t.node("n", F.col("k")), t.name(p), o) for p, o in slots.items()])
    quads = Graph(g.quads)
    rows = g.quads.collect()
    assert len(rows) == 9
    for r in rows:  # by each constant, as among the quads themselves
        for pattern in (Pattern(Var(0), Res(r["p"]), Res(r["o"])), Pattern(Res(r["s"]), Var(0), Var(1)), Pattern(Var(0), Var(1), Res(r["o"]))):
            assert sorted(map(tuple, g.scan(positive(pattern)).collect())) == sorted(map(tuple, quads.scan(positive(pattern)).collect())) != []
    for o in ('"x"@en', terms.literal("2.5", terms.DECIMAL), terms.literal("true", terms.BOOLEAN), f"<{t.BASE}n/02>", "_:x"):
        assert g.scan(positive(Pattern(Var(0), Var(1), Res(o)))).isEmpty()
    plan = g.scan(positive(Pattern(Var(0), Res(t.name("name")), Res('"x"'))))._jdf.queryExecution().toString()
    assert "EqualTo(name,x)" in plan and "Union" not in plan.split("Physical Plan")[1]
    for text in ("for ?a, ?b, ?c { ?a ex:next ?b . ?b ex:name ?c . } => { ?a ex:p ?c . }", "for ?a, ?b { ?a ?b ?a . } => { }", "for ?a, ?p, ?b, ?q, ?c { ?a ?p ?b . ?b ?q ?c . } => { ?a ?p ?c . }"):
        r = rule(text)
        assert sorted(map(tuple, r.deduce(g).triples().collect())) == sorted(map(tuple, r.deduce(quads).triples().collect()))


def test_validation_reads_the_predicates_in_question(spark, tmp_path):
    from quadrille.sources import triplify as t

    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = lambda p, o: t.branch(df, t.node("n", F.col("id")), t.name(p), o)
    mixed = Graph.of(spark, [("_:a", iri("p"), "_:b"), ("_:a", iri("q"), "_:b")])
    g = Graph([one("p", t.node("n", F.col("id"))), one("q", t.node("n", F.col("id") % 2)), one("r", "_:x"), *mixed.branches])
    r = rule("for ?x, ?y { ?x ex:p ?y . } => { ?x ex:q ?y . }")
    assert r.deduce(g).predicates == {iri("q")} and r.validate(g).reason.terms == (f"<{t.BASE}n/2>", iri("q"), f"<{t.BASE}n/2>")
    assert sorted(x["s"] for x in r.deduce(g).satisfied(g).collect()) == [f"<{t.BASE}n/0>", f"<{t.BASE}n/1>", "_:a"]
    assert {x["p"] for x in g.of_predicates(frozenset({iri("q")})).quads.collect()} == {iri("q")}
    assert g.of_predicates(frozenset()).quads.isEmpty() and rule("for ?x, ?p, ?y { ?x ?p ?y . } => { ?y ?p ?x . }").deduce(g).predicates is None


def test_lifting_and_causes(spark):
    g = Graph.of(spark, [("_:a", iri("p"), "_:b")])
    out = rule("for ?x, ?y { ?x ex:p ?y . } => { ?x ex:q ?y . ?x = ?y . (= ?x ?y) . }").deduce(g)
    assert {(r["kind"], r["g"]) for r in out.statements("_:g").collect()} == {("triple", "_:g"), ("eq", "_:g"), ("true", None)}
    rows = out.causes(g).collect()
    assert sorted((r["p"], r["cause"]["kind"]) for r in rows) == [(iri("p"), "stated"), (iri("q"), "entailed")]
    known = {r["id"]: r["substitution"] for r in out.entailments().collect()}
    assert [known[r["cause"]["id"]] for r in rows if r["cause"]["kind"] == "entailed"] == [["_:a", "_:b"]]
    fresh = rule("for ?x, ?y { ?x ex:p ?y . } => for ?c { ?x ex:q ?c . }")
    assert fresh.deduce(g, generator=lambda x: F.concat(F.lit("_:mine"), F.md5(x))).df.first()["o"].startswith("_:mine")


def test_unreadable_graphs(spark, tmp_path):
    from quadrille.operators.deduce import DatasetError

    g = Graph.of(spark, [("_:a", iri("p"), '"1"')])
    g.write(str(tmp_path / "q"))
    lost = Graph.read(spark, str(tmp_path / "q"))
    for f in (tmp_path / "q").iterdir():
        f.unlink()
    with pytest.raises(DatasetError):
        rule("for ?x, ?y { ?x ex:p ?y . } => { ?x ex:q ?y . }").validate(lost)


def naive(rule_, quads):
    found = [{}]
    for p in rule_.hypothesis.patterns:
        more = []
        for sub in found:
            for sign, *t in quads:
                if sign != p.positive:
                    continue
                new = dict(sub)
                if all(x.term == y if isinstance(x, Res) else new.setdefault(x.index, y) == y for x, y in zip(p.value.parts, t[:3], strict=True)):
                    more.append(new)
        found = more
    out = []
    for sub in found:
        for st in rule_.conclusion.statements:
            out.append((st.positive, *(sub[x.index] if isinstance(x, Var) else x.term for x in (st.value.s, st.value.p, st.value.o))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_against_naive_evaluation(spark, seed):
    rng = random.Random(seed)
    nodes, preds = [f"_:{k}" for k in range(4)], [iri(k) for k in "pq"]
    quads = sorted({(rng.random() < 0.8, rng.choice(nodes), rng.choice(preds), rng.choice(nodes + preds), rng.choice(["_:g", "_:h"])) for _ in range(14)})
    part = lambda pool, n: Var(rng.randrange(n)) if rng.random() < 0.7 else Res(rng.choice(pool))
    patterns = tuple(Signed(rng.random() < 0.85, Pattern(part(nodes, 3), part(preds, 3) if rng.random() < 0.3 else Res(rng.choice(preds)), part(nodes, 3))) for _ in range(rng.randint(1, 3)))
    body = Hypothesis(patterns)
    known = sorted(body.variables())
    pick = lambda: Var(rng.choice(known)) if known else Res("_:z")
    r = Rule(3, body, Conclusion(0, tuple(Signed(rng.random() < 0.5, Triple(pick(), Res(preds[0]), pick())) for _ in range(2))))
    g = Graph.of(spark, [Signed(q[0], q[1:]) for q in quads])
    assert sorted(tuple(x) for x in r.deduce(g).triples().collect()) == naive(r, quads)


def test_saturate(spark):
    g = Graph.of(spark, [(f"_:{k}", iri("in"), f"_:{k + 1}") for k in range(5)] + [("_:5", iri("in"), "_:0")])
    full = System([rule("for ?a, ?b, ?c { ?a ex:in ?b . ?b ex:in ?c . } => { ?a ex:in ?c . }")]).saturate(g)
    assert full.quads.count() == 36


def test_sources_and_stream(spark, tmp_path):
    from quadrille.sources import ntriples
    from quadrille.streaming.incremental import deduce_stream

    (tmp_path / "f.nt").write_text(f'# facts\n_:a {iri("p")} "x"^^<{terms.STRING}> .\n_:a {iri("p")} "y"@en {iri("g")} .\nbroken line\n')
    with pytest.raises(ValueError, match="broken line"):
        ntriples.read(spark, str(tmp_path / "f.nt"))
    assert [r[0] for r in ntriples.malformed(spark, str(tmp_path / "f.nt")).collect()] == ["broken line"]
    (tmp_path / "e.nt").write_text(f'_:a {iri("p")} "see ^^<{terms.STRING}> \\u0041\\t\\\\" .\n_:a <https://example.org/\\u0070> "\\U0001F600" .\n')
    assert {(r["p"], r["o"]) for r in ntriples.read(spark, str(tmp_path / "e.nt")).quads.collect()} == {(iri("p"), f'"see ^^<{terms.STRING}> A\t\\\\"'), (iri("p"), '"😀"')}
    g = ntriples.read(spark, str(tmp_path / "f.nt"), strict=False)
    assert sorted(r["o"] for r in g.quads.collect()) == ['"x"', '"y"@en']
    g.write(str(tmp_path / "g"))
    assert Graph.read(spark, str(tmp_path / "g")).quads.count() == 2
    spark.createDataFrame([(True, "_:z", iri("p"), "_:q")], "positive boolean, s string, p string, o string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("positive boolean, s string, p string, o string").parquet(str(tmp_path / "in"))
    s = System([rule("for ?x, ?y { ?x ex:p ?y . } => { ?y ex:r ?x . }")])
    query = deduce_stream(s, g, stream, lambda found, _: got.extend(found.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["s"], r["o"]) for r in got] == [("_:q", "_:z")]

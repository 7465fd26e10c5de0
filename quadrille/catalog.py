"""Registered queries: each operator of the rule engine over the relational test tables seen as graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import Graph, Rule, Signed, System, parse_rule, terms
from quadrille.operators.deduce import base
from quadrille.sources import triplify as t
from quadrille.sources.graph import Branch, Slot

EX = t.BASE
_SINGULAR = {"orders": "order", "documents": "doc", "pages": "page"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _column(df: DataFrame, kind: str, key: str, column: str, value: Slot | Column) -> Branch:
    return t.branch(df, t.node(kind, F.col(key)), t.name(column), value)


def customers(spark: SparkSession, sf_dir: str) -> list[Branch]:
    df = table(spark, sf_dir, "customer")
    one = lambda c, v: _column(df, "customer", "c_custkey", c, v)
    return [one("c_nationkey", t.node("nation", F.col("c_nationkey"))), one("c_mktsegment", t.text(F.col("c_mktsegment"))), one("c_acctbal", t.money(F.col("c_acctbal")))]


def orders(spark: SparkSession, sf_dir: str) -> list[Branch]:
    df = table(spark, sf_dir, "orders")
    one = lambda c, v: _column(df, "order", "o_orderkey", c, v)
    return [one("o_custkey", t.node("customer", F.col("o_custkey"))), one("o_orderpriority", t.text(F.col("o_orderpriority")))]


def suppliers(spark: SparkSession, sf_dir: str) -> list[Branch]:
    return [_column(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_nationkey", t.node("nation", F.col("s_nationkey")))]


def places(spark: SparkSession, sf_dir: str) -> list[Branch]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return [
        _column(nation, "nation", "n_nationkey", "n_name", t.text(F.col("n_name"))),
        _column(nation, "nation", "n_nationkey", "n_regionkey", t.node("region", F.col("n_regionkey"))),
        _column(region, "region", "r_regionkey", "r_name", t.text(F.col("r_name"))),
    ]


def items(spark: SparkSession, sf_dir: str) -> list[Branch]:
    """Line items as blanks; orderkey and linenumber don't identify one, and a graph is a set."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    s = t.blank("l", *(F.col(c) for c in df.columns))
    return [t.branch(df, s, t.name("l_orderkey"), t.node("order", F.col("l_orderkey"))), t.branch(df, s, t.name("l_suppkey"), t.node("supplier", F.col("l_suppkey")))]


def sizes(spark: SparkSession, sf_dir: str) -> list[Branch]:
    df = table(spark, sf_dir, "part")
    return [_column(df, "part", "p_partkey", "p_size", t.integer(F.col("p_size"))), _column(df, "part", "p_partkey", "p_size_decimal", t.whole_decimal(F.col("p_size")))]


def labels(spark: SparkSession, sf_dir: str) -> list[Branch]:
    df = table(spark, sf_dir, "labels")
    out = [_column(df, "doc", "doc_id", c, t.boolean(F.col(c) == 1)) for c in ("quality", "toxic")]
    kind = t.branch(df, t.node("doc", F.col("doc_id")), terms.RDF_TYPE, t.name("Labelled"))
    signed = t.branch(df, t.node("doc", F.col("doc_id")), t.name("isToxic"), terms.literal("true", terms.BOOLEAN), positive=F.col("toxic") == 1)
    return [*out, kind, signed]


def documents(spark: SparkSession, sf_dir: str) -> list[Branch]:
    return [t.branch(table(spark, sf_dir, "documents").select("doc_id"), t.node("doc", F.col("doc_id")), terms.RDF_TYPE, t.name("Document"))]


def graph(*parts: list[Branch], one_graph: bool = True) -> Graph:
    return Graph.union_of([x for p in parts for x in p], one_graph)


def rule(text: str) -> Rule:
    """A rule in which ex:name stands for an example IRI and rdf:type for that of types."""
    import re

    text = text.replace("rdf:type", terms.RDF_TYPE)
    return parse_rule(re.sub(r"\bex:(\w+)", rf"<{EX}\1>", text))


def _sub(df: DataFrame, k: int) -> Column:
    return F.col("substitution")[k]


def _scan(r: Rule, g: Graph) -> DataFrame:
    from quadrille.plans.match import substitutions

    return substitutions(r, g)


def _key(column: Column | str, kind: str) -> Column:
    return t.key_of(F.col(column) if isinstance(column, str) else column, kind)


def _based(df: DataFrame, place: str, kind: str) -> Column:
    """The number in a node: the base column that the term is made of where the frame has it, else read from the term."""
    at = base(place, t.node(kind, F.lit(0)))
    return F.col(f"`{at}`").cast("long") if at in df.columns else _key(place, kind)


def _true(column: str = "o") -> Column:
    return F.col(column) == terms.literal("true", terms.BOOLEAN)


SEGMENT = "for ?c, ?g { ?c ex:c_mktsegment ?g . } => { ?c rdf:type ex:Any . }"
BUILDING = 'for ?o, ?c { ?o ex:o_custkey ?c . ?c ex:c_mktsegment "BUILDING" . } => { ?o rdf:type ex:BuildingOrder . }'


def pattern_scan_predicate(spark, d):
    return _scan(rule(SEGMENT), graph(customers(spark, d))).select(F.col("v0").alias("s"), F.col("v1").alias("o"))


def pattern_const_object(spark, d):
    return _scan(rule('for ?c { ?c ex:c_mktsegment "BUILDING" . } => { }'), graph(customers(spark, d))).select(F.col("v0").alias("s"))


def pattern_var_predicate(spark, d):
    found = _scan(rule("for ?c, ?p, ?v { ?c ?p ?v . } => { }"), graph(customers(spark, d)))
    return found.select(F.substring(F.col("v1"), len(EX) + 2, 100).alias("p")).groupBy(F.expr("rtrim('>', p)").alias("p")).agg(F.count("*").alias("n"))


def pattern_repeated_var(spark, d):
    df = table(spark, d, "orders").select((F.col("o_orderkey") % 1500).alias("a"), F.col("o_custkey").alias("b")).distinct()
    g = graph([t.branch(df, t.node("node", F.col("a")), t.name("linked"), t.node("node", F.col("b")))])
    return _scan(rule("for ?x { ?x ex:linked ?x . } => { }"), g).select(F.col("v0").alias("x"))


def negative_fact_hypothesis(spark, d):
    r = rule('for ?d { ! ?d ex:isToxic "true"^^<http://www.w3.org/2001/XMLSchema#boolean> . } => { }')
    return _scan(r, graph(labels(spark, d))).select(_key("v0", "doc").alias("doc_id"))


def any_graph_bag(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    g = Graph.union_of([t.branch(df, t.node("order", F.col("l_orderkey")), t.name("contains"), t.node("part", F.col("l_partkey")), g=t.node("flag", F.col("l_returnflag")))])
    return _scan(rule("for ?o, ?p { ?o ex:contains ?p . } => { }"), g).select(_key("v0", "order").alias("ord"), _key("v1", "part").alias("part"))


def join_subject_object(spark, d):
    out = rule(BUILDING).deduce(graph(orders(spark, d), customers(spark, d))).df
    return out.select(_key("s", "order").alias("o_orderkey"), _key(_sub(out, 1), "customer").alias("c_custkey"))


def join_chain4(spark, d):
    r = rule("for ?o, ?c, ?n, ?r, ?x { ?o ex:o_custkey ?c . ?c ex:c_nationkey ?n . ?n ex:n_regionkey ?r . ?r ex:r_name ?x . } => { ?o ex:region ?x . }")
    out = r.deduce(graph(orders(spark, d), customers(spark, d), places(spark, d))).df
    return out.select(_key("s", "order").alias("o_orderkey"), terms.lexical(F.col("o")).alias("r_name"))


def join_object_object(spark, d):
    r = rule("for ?c, ?n, ?s { ?c ex:c_nationkey ?n . ?s ex:s_nationkey ?n . } => { ?c ex:near ?s . }")
    out = r.deduce(graph(customers(spark, d), suppliers(spark, d))).based
    return out.select(_based(out, "s", "customer").alias("c_custkey"), _based(out, "o", "supplier").alias("s_suppkey"))


def join_cross(spark, d):
    out = rule("for ?r, ?a, ?n, ?b { ?r ex:r_name ?a . ?n ex:n_name ?b . } => { ?r ex:with ?n . }").deduce(graph(places(spark, d))).df
    return out.select(_key("s", "region").cast("int").alias("r_regionkey"), _key("o", "nation").cast("int").alias("n_nationkey"))


def join_cyclic(spark, d):
    r = rule("for ?l, ?o, ?c, ?n, ?s { ?l ex:l_orderkey ?o . ?o ex:o_custkey ?c . ?c ex:c_nationkey ?n . ?l ex:l_suppkey ?s . ?s ex:s_nationkey ?n . } => { }")
    found = _scan(r, graph(items(spark, d), orders(spark, d), customers(spark, d), suppliers(spark, d)))
    return found.select(_key("v1", "order").alias("o_orderkey"), _key("v2", "customer").alias("c_custkey"), _key("v4", "supplier").alias("s_suppkey")).distinct()


def seeded_incremental(spark, d):
    g = graph(orders(spark, d), customers(spark, d))
    delta = _column(table(spark, d, "orders"), "order", "o_orderkey", "o_custkey", t.node("customer", F.col("o_custkey"))).quads()
    out = System([rule("for ?o, ?c, ?g { ?o ex:o_custkey ?c . ?c ex:c_mktsegment ?g . } => { ?o ex:segment ?g . }")]).deduce_from(g, delta).df
    return out.select(_key("s", "order").alias("o_orderkey"), terms.lexical(F.col("o")).alias("c_mktsegment"))


def system_union(spark, d):
    a, b = (rule(f"for ?x, ?n {{ ?x ex:{p} ?n . }} => {{ ?x rdf:type ex:{c} . }}") for p, c in (("c_nationkey", "customer"), ("s_nationkey", "supplier")))
    out = System([a, b, a]).deduce(graph(customers(spark, d), suppliers(spark, d))).df
    kind = F.when(F.col("rule_id") == 0, "customer").otherwise("supplier")
    return out.select(kind.alias("k"), F.regexp_extract("s", r"/([0-9]+)>", 1).cast("long").alias("id"))


def deduce_computed_boolean(spark, d):
    out = rule("for ?c, ?b { ?c ex:c_acctbal ?b . } => { ?c ex:nonNegative (>= ?b 0) . }").deduce(graph(customers(spark, d))).df
    return out.select(_key("s", "customer").alias("c_custkey"), _true().alias("o"))


def materialize_union(spark, d):
    g = graph(orders(spark, d), [t.branch(table(spark, d, "customer"), t.node("customer", F.col("c_custkey")), terms.RDF_TYPE, t.name("Customer"))])
    more = rule("for ?o, ?c { ?o ex:o_custkey ?c . } => { ?c rdf:type ex:Customer . }").deduce(g).insert_into(g)
    return more.quads.where(F.col("p") == terms.RDF_TYPE).agg(F.count("*").alias("n"))


def existential_fresh(spark, d):
    out = rule("for ?s, ?n { ?s ex:s_nationkey ?n . } => for ?a { ?s ex:account ?a . }").deduce(graph(suppliers(spark, d))).df
    return out.agg(F.count("*").alias("n"), F.count_distinct("o").alias("n_distinct"))


def provenance(spark, d):
    out = rule(BUILDING).deduce(graph(orders(spark, d), customers(spark, d)), rule_id=7).df
    return out.select("rule_id", _key(_sub(out, 0), "order").alias("o_orderkey"), _key(_sub(out, 1), "customer").alias("c_custkey"))


_LABELLED = "for ?d { ?d rdf:type ex:Document . } => { ?d rdf:type ex:Labelled . }"


def validate_missing(spark, d):
    out = rule(_LABELLED).violations(graph(documents(spark, d), labels(spark, d)))
    return out.select(_key("s", "doc").alias("doc_id"))


def contains_semi(spark, d):
    g = graph(documents(spark, d), labels(spark, d))
    return rule(_LABELLED).deduce(g).satisfied(g).select(_key("s", "doc").alias("doc_id"))


def _broken(spark, d, head: str) -> DataFrame:
    out = rule(f"for ?c, ?b {{ ?c ex:c_acctbal ?b . }} => {{ {head} }}").violations(graph(customers(spark, d)))
    return out.select(_key(_sub(out, 0), "customer").alias("c_custkey"))


def validate_not_true(spark, d):
    return _broken(spark, d, "(>= ?b 0) .")


def validate_not_false(spark, d):
    return _broken(spark, d, "! (< ?b 0) .")


_SAME = "for ?a, ?n, ?b {{ ?a ex:s_nationkey ?n . ?b ex:s_nationkey ?n . }} => {{ {} }}"


def validate_not_eq(spark, d):
    out = rule(_SAME.format("?a = ?b .")).violations(graph(suppliers(spark, d)), based=True)
    return out.select(_based(out, "s", "supplier").alias("a"), _based(out, "o", "supplier").alias("b"))


def validate_not_ne(spark, d):
    return rule(_SAME.format("! ?a = ?b .")).violations(graph(suppliers(spark, d))).select(_key("s", "supplier").alias("a"))


def compare_chained(spark, d):
    out = rule("for ?p, ?z { ?p ex:p_size ?z . } => { ?p ex:mid (<= 10 ?z 20) . }").deduce(graph(sizes(spark, d))).df
    return out.select(_key("s", "part").alias("p_partkey"), _true().alias("ok"))


def compare_string(spark, d):
    out = rule('for ?o, ?x { ?o ex:o_orderpriority ?x . } => { ?o ex:urgent (< ?x "3") . }').deduce(graph(orders(spark, d))).df
    return out.select(_key("s", "order").alias("o_orderkey"), _true().alias("ok"))


def compare_value_vs_identity(spark, d):
    r = rule("for ?p, ?i, ?j { ?p ex:p_size ?i . ?p ex:p_size_decimal ?j . } => { ?p ex:same (= ?i ?j) . }")
    out = r.deduce(graph(sizes(spark, d))).df
    return out.select(_key("s", "part").alias("p_partkey"), _true().alias("value_eq"), (_sub(out, 1) == _sub(out, 2)).alias("term_eq"))


def bool_lexical(spark, d):
    out = rule("for ?d, ?q { ?d ex:quality ?q . } => { ?d ex:good (and ?q) . }").deduce(graph(labels(spark, d))).df
    return out.select(_key("s", "doc").alias("doc_id"), _true().alias("ok"))


def bool_or_and(spark, d):
    r = rule("for ?d, ?q, ?t { ?d ex:quality ?q . ?d ex:toxic ?t . } => { (or ?q ?t) ex:both (and ?q ?t) . }")
    out = r.deduce(graph(labels(spark, d))).df
    return out.select(_key(_sub(out, 0), "doc").alias("doc_id"), _true("s").alias("any_"), _true("o").alias("both_"))


def matches_regex(spark, d):
    g = graph([_column(table(spark, d, "pages").select("page_id", "url"), "page", "page_id", "url", t.text(F.col("url")))])
    out = rule('for ?p, ?u { ?p ex:url ?u . } => { ?p ex:enSecure (matches /"^https://[a-z.]+/en/[0-9]+"/ ?u) . }').deduce(g).df
    return out.select(_key("s", "page").alias("page_id"), _true().alias("ok"))


def system_validate(spark, d):
    """Violations of several rules at once, counted by rule and reason."""
    rules = [rule(x) for x in (_LABELLED, "for ?c, ?b { ?c ex:c_acctbal ?b . } => { (>= ?b 0) . }")]
    out = System(rules).violations(graph(documents(spark, d), labels(spark, d), customers(spark, d)))
    return out.groupBy("rule_id", "reason").agg(F.count("*").alias("n"))


def saturate_regions(spark, d):
    """Extension: customers' places by transitive closure."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp())
    g = _inside(spark, d)
    out = System([rule("for ?a, ?b, ?c { ?a ex:in ?b . ?b ex:in ?c . } => { ?a ex:in ?c . }")]).saturate(g).quads
    return out.where(F.startswith("s", F.lit(f"<{EX}customer/")) & F.startswith("o", F.lit(f"<{EX}region/"))).select(_key("s", "customer").alias("c_custkey"), _key("o", "region").cast("int").alias("n_regionkey"))


def join_predicate_subject(spark, d):
    """A pattern's predicate is the subject of another."""
    kinds = [t.branch(spark.range(1), t.name(c), terms.RDF_TYPE, t.name("Key")) for c in ("c_nationkey", "c_regionkey")]
    found = _scan(rule("for ?c, ?p, ?v { ?p rdf:type ex:Key . ?c ?p ?v . } => { }"), graph(customers(spark, d), kinds))
    return found.select(_key("v0", "customer").alias("c_custkey"), _key("v2", "nation").cast("int").alias("c_nationkey"))


def several_statements(spark, d):
    r = rule("for ?c, ?n { ?c ex:c_nationkey ?n . } => { ?c rdf:type ex:Customer . ?n rdf:type ex:Nation . }")
    out = r.deduce(graph(customers(spark, d))).df
    return out.select("stmt_idx", F.regexp_extract("s", r"/([0-9]+)>", 1).cast("long").alias("id"))


def empty_hypothesis(spark, d):
    """A body without patterns holds once."""
    return rule("{ } => { ex:a ex:p ex:b . }").deduce(graph(customers(spark, d))).df.agg(F.count("*").alias("n"))


def compare_ne(spark, d):
    out = rule('for ?o, ?x { ?o ex:o_orderpriority ?x . } => { ?o ex:calm (!= ?x "1-URGENT") . }').deduce(graph(orders(spark, d))).df
    return out.select(_key("s", "order").alias("o_orderkey"), _true().alias("ok"))


def compare_gt(spark, d):
    out = rule("for ?c, ?b { ?c ex:c_acctbal ?b . } => { ?c ex:rich (> ?b 5000) . }").deduce(graph(customers(spark, d))).df
    return out.select(_key("s", "customer").alias("c_custkey"), _true().alias("ok"))


def matches_any_literal(spark, d):
    """Any literal is matched by its lexical form, a number too."""
    out = rule('for ?p, ?z { ?p ex:p_size ?z . } => { ?p ex:one (matches /"^1"/ ?z) . }').deduce(graph(sizes(spark, d))).df
    return out.select(_key("s", "part").alias("p_partkey"), _true().alias("ok"))


def _patterns(spark, d, odd: str) -> list[Branch]:
    """A regular expression for each region as a term of the data."""
    even, other = terms.literal("^[A-M]", terms.REGEX), terms.literal(odd, terms.REGEX)
    return [_column(table(spark, d, "region"), "region", "r_regionkey", "pattern", F.when(F.col("r_regionkey") % 2 == 0, even).otherwise(other))]


def matches_pattern_from_data(spark, d):
    r = rule("for ?n, ?r, ?x, ?y { ?n ex:n_regionkey ?r . ?r ex:pattern ?x . ?n ex:n_name ?y . } => { ?n ex:fits (matches ?x ?y) . }")
    out = r.deduce(graph(places(spark, d), _patterns(spark, d, "^[N-Z]"))).df
    return out.select(_key("s", "nation").cast("int").alias("n_nationkey"), _true().alias("ok"))


def _errors(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("error.code").alias("code")).agg(F.count("*").alias("n"))


def invalid_regex_term(spark, d):
    """A malformed pattern is an invalid literal in any comparison, not an unequal one."""
    r = rule('for ?r, ?x { ?r ex:pattern ?x . } => { (!= ?x "z") . }')
    return _errors(r.deduce(graph(_patterns(spark, d, "(^[N-Z]"))).errors())


def evaluation_errors(spark, d):
    """Connectives convert arguments one by one until one decides."""
    r = rule("for ?c, ?b, ?g { ?c ex:c_acctbal ?b . ?c ex:c_mktsegment ?g . } => { (or (>= ?b 0) ?g) . }")
    out = r.deduce(graph(customers(spark, d))).errors()
    return out.select(_key(_sub(out, 0), "customer").alias("c_custkey"), F.col("error.code").alias("code"))


def eager_arguments(spark, d):
    """Calls within a connective are evaluated even where they don't matter."""
    r = rule('for ?c, ?b, ?g { ?c ex:c_acctbal ?b . ?c ex:c_mktsegment ?g . } => { (or (>= ?b -1000000) (matches "a" ?g)) . }')
    return _errors(r.deduce(graph(customers(spark, d))).errors())


def _outcome(spark, d, head: str) -> DataFrame:
    """How validating a rule over customers' balances and segments ends: valid, a violation's reason or an error's code."""
    from quadrille.operators.deduce import EvaluationError

    r = rule(f"for ?c, ?b, ?g {{ ?c ex:c_acctbal ?b . ?c ex:c_mktsegment ?g . }} => {{ {head} }}")
    try:
        found = r.validate(graph(customers(spark, d)))
        out = "valid" if found.is_valid else found.reason.code
    except EvaluationError as e:
        out = e.code
    return spark.createDataFrame([(out,)], "outcome string")


def errors_before_violations(spark, d):
    return _outcome(spark, d, "(>= ?b 0) . (and ?g) .")


def validate_outcomes(spark, d):
    heads = ("(>= ?b 0) .", "(>= ?b -1000000) .", "?c ex:unknown ?g .", "! (< ?b 0) .")
    return _outcome(spark, d, heads[0]).unionByName(_outcome(spark, d, heads[1])).unionByName(_outcome(spark, d, heads[2])).unionByName(_outcome(spark, d, heads[3]))


def user_function(spark, d):
    from quadrille.functions.expressions import Value, register_function, to_any_literal

    def lower(args):
        text, error = to_any_literal(args[0])
        return Value("string", F.lower(text), error)

    register_function("lower", lower)
    out = rule("for ?c, ?g { ?c ex:c_mktsegment ?g . } => { ?c ex:low (lower ?g) . }").deduce(graph(customers(spark, d))).df
    return out.select(_key("s", "customer").alias("c_custkey"), terms.lexical(F.col("o")).alias("low"))


def ambiguous_literal(spark, d):
    """Literals that a resource stands for must agree, decimals by value."""
    df = table(spark, d, "customer")
    k = F.col("c_custkey")
    made = F.array(t.integer(k).term, terms.literal_column(F.concat(k.cast("string"), F.lit(".0")), terms.DECIMAL, plain=True), t.integer(F.when(k % 10 == 0, k + 1).otherwise(k)).term)
    means = df.select(t.node("customer", k).term.alias("resource"), F.explode(made).alias("term"))
    g = Graph.union_of(customers(spark, d), True)
    out = rule("for ?c, ?n { ?c ex:c_nationkey ?n . } => { (>= ?c 0) . }").deduce(Graph(g.branches, True, means)).errors()
    return out.select(_key(_sub(out, 0), "customer").alias("c_custkey"), F.col("error.code").alias("code"))


def _inside(spark, d) -> Graph:
    into = lambda df, k, key, o: t.branch(df, t.node(k, F.col(key)), t.name("in"), o)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return graph([into(c, "customer", "c_custkey", t.node("nation", F.col("c_nationkey"))), into(n, "nation", "n_nationkey", t.node("region", F.col("n_regionkey")))])


def incremental_several_patterns(spark, d):
    """New facts that match several patterns of a rule give what they lead to once for each."""
    g = _inside(spark, d)
    out = System([rule("for ?a, ?b, ?c { ?a ex:in ?b . ?b ex:in ?c . } => { ?a ex:far ?c . }")]).deduce_from(g, g.triples()).df
    return out.select(_key("s", "customer").alias("c_custkey"), _key("o", "region").cast("int").alias("n_regionkey"))


def fresh_generator(spark, d):
    r = rule("for ?s, ?n { ?s ex:s_nationkey ?n . } => for ?a { ?s ex:account ?a . }")
    out = r.deduce(graph(suppliers(spark, d)), generator=lambda x: F.concat(F.lit("_:account"), F.md5(x))).df
    return out.agg(F.count_distinct("o").alias("n_distinct"), F.sum(F.startswith("o", F.lit("_:account")).cast("long")).alias("n_named"))


def causes(spark, d):
    g = graph(orders(spark, d), customers(spark, d))
    return rule(BUILDING).deduce(g).causes(g).groupBy(F.col("cause.kind").alias("kind")).agg(F.count("*").alias("n"))


def lift_statements(spark, d):
    out = rule("for ?s, ?n { ?s ex:s_nationkey ?n . } => { ?s rdf:type ex:Supplier . ?s = ?s . (= ?n ?n) . }").deduce(graph(suppliers(spark, d)))
    return out.statements(t.name("g")).groupBy("kind", "g").agg(F.count("*").alias("n"))


def seeded_rule(spark, d):
    """A rule whose variable is bound beforehand: the constant reaches the files."""
    one = t.node("nation", F.lit(7)).term
    seed = spark.range(1).select(one.alias("v1"))
    out = rule("for ?c, ?n { ?c ex:c_nationkey ?n . } => { ?c ex:of ?n . }").deduce(graph(customers(spark, d)), seed=seed).df
    return out.select(_key("s", "customer").alias("c_custkey"))


def serde_round_trip(spark, d):
    """A rule written as JSON and read again."""
    from quadrille import serde

    out = serde.from_json(serde.to_json(rule(BUILDING))).deduce(graph(orders(spark, d), customers(spark, d))).df
    return out.select(_key("s", "order").alias("o_orderkey"), _key(_sub(out, 1), "customer").alias("c_custkey"))


def pattern_index(spark, d):
    """The patterns of a system's rules that a fact matches."""
    system = System([rule(BUILDING), rule("for ?a, ?p { ?a ?p ?a . ! ?a ex:o_custkey ?p . } => { }"), rule(SEGMENT)])
    x, y = (f"<{EX}{k}>" for k in "xy")
    facts = [(x, t.name("o_custkey"), y), (x, t.name("o_custkey"), x), (x, t.name("c_mktsegment"), terms.literal("BUILDING"))]
    found = [(k, r, p) for k, f in enumerate(facts) for sign in (True, False) for r, p in system.paths_for(Signed(sign, f))]
    return spark.createDataFrame(found, "fact int, rule int, pattern int")


def traverse_quads(spark, d):
    """All quads, signs and graphs included, counted by predicate."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    g = graph(labels(spark, d), [t.branch(df, t.node("order", F.col("l_orderkey")), t.name("contains"), t.node("part", F.col("l_partkey")), g=t.node("flag", F.col("l_returnflag")))])
    named = F.coalesce(F.regexp_extract("p", r"[/#]([A-Za-z_]+)>", 1), F.lit(""))
    return g.quads.groupBy(named.alias("p"), "positive").agg(F.count("*").alias("n"), F.count("g").alias("n_graph"))


def unreadable_graph(spark, d):
    """A source that fails while a rule is validated is a dataset error, told from one of an expression."""
    from quadrille.operators.deduce import DatasetError

    broken = t.branch(table(spark, d, "nation"), t.node("nation", F.col("n_nationkey")), t.name("n_name"), F.raise_error(F.lit("lost")).cast("string"))
    try:
        rule("for ?n, ?x { ?n ex:n_name ?x . } => { ?n ex:named ?x . }").validate(graph([broken]))
        out = "valid"
    except DatasetError:
        out = "dataset"
    return spark.createDataFrame([(out,)], "outcome string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pattern_scan_predicate, pattern_const_object, pattern_var_predicate, pattern_repeated_var, negative_fact_hypothesis, any_graph_bag,
        join_subject_object, join_chain4, join_object_object, join_cross, join_cyclic, seeded_incremental, system_union, deduce_computed_boolean,
        materialize_union, existential_fresh, provenance, validate_missing, contains_semi, validate_not_true, validate_not_false, validate_not_eq,
        validate_not_ne, compare_chained, compare_string, compare_value_vs_identity, bool_lexical, bool_or_and, matches_regex, system_validate,
        saturate_regions, join_predicate_subject, several_statements, empty_hypothesis, compare_ne, compare_gt, matches_any_literal,
        matches_pattern_from_data, invalid_regex_term, evaluation_errors, eager_arguments, errors_before_violations, validate_outcomes,
        user_function, ambiguous_literal, incremental_several_patterns, fresh_generator, causes, lift_statements, seeded_rule, serde_round_trip,
        pattern_index, traverse_quads, unreadable_graph,
    )
}

_CUSTOMER = f"'<{EX}customer/' || c_custkey || '>'"
_BUILDING = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"

ORACLE_SQL = {
    "pattern_scan_predicate": f"SELECT {_CUSTOMER} AS s, '\"' || c_mktsegment || '\"' AS o FROM customer",
    "pattern_const_object": f"SELECT {_CUSTOMER} AS s FROM customer WHERE c_mktsegment = 'BUILDING'",
    "pattern_var_predicate": "SELECT p, count(*) AS n FROM (SELECT 'c_nationkey' AS p FROM customer UNION ALL SELECT 'c_mktsegment' FROM customer UNION ALL SELECT 'c_acctbal' FROM customer) GROUP BY p",
    "pattern_repeated_var": f"SELECT DISTINCT '<{EX}node/' || o_custkey || '>' AS x FROM orders WHERE o_orderkey % 1500 = o_custkey",
    "negative_fact_hypothesis": "SELECT doc_id FROM labels WHERE toxic = 0",
    "any_graph_bag": "SELECT l_orderkey AS ord, l_partkey AS part FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)",
    "join_subject_object": f"SELECT o_orderkey, c_custkey {_BUILDING}",
    "join_chain4": "SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_object_object": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "join_cross": "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation",
    "join_cyclic": "SELECT DISTINCT o_orderkey, c_custkey, s_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
    "seeded_incremental": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "system_union": "SELECT 'customer' AS k, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier",
    "deduce_computed_boolean": "SELECT c_custkey, c_acctbal >= 0 AS o FROM customer",
    "materialize_union": "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)",
    "existential_fresh": "SELECT count(*) AS n, count(DISTINCT s_suppkey) AS n_distinct FROM supplier",
    "provenance": f"SELECT CAST(7 AS INTEGER) AS rule_id, o_orderkey, c_custkey {_BUILDING}",
    "validate_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "contains_semi": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "validate_not_true": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0)",
    "validate_not_false": "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "validate_not_eq": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey",
    "validate_not_ne": "SELECT a.s_suppkey AS a FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey = b.s_suppkey",
    "compare_chained": "SELECT p_partkey, (10 <= p_size AND p_size <= 20) AS ok FROM part",
    "compare_string": "SELECT o_orderkey, o_orderpriority < '3' AS ok FROM orders",
    "compare_value_vs_identity": "SELECT p_partkey, TRUE AS value_eq, FALSE AS term_eq FROM part",
    "bool_lexical": "SELECT doc_id, quality = 1 AS ok FROM labels",
    "bool_or_and": "SELECT doc_id, (quality = 1 OR toxic = 1) AS any_, (quality = 1 AND toxic = 1) AS both_ FROM labels",
    "matches_regex": "SELECT page_id, regexp_matches(url, '^https://[a-z.]+/en/[0-9]+') AS ok FROM pages",
    "system_validate": "SELECT CAST(0 AS INTEGER) AS rule_id, 'missing_triple' AS reason, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT CAST(1 AS INTEGER), 'not_true', count(*) FROM customer WHERE NOT (c_acctbal >= 0)",
    "saturate_regions": "SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_predicate_subject": "SELECT c_custkey, c_nationkey FROM customer",
    "several_statements": "SELECT CAST(0 AS INTEGER) AS stmt_idx, c_custkey AS id FROM customer UNION ALL SELECT CAST(1 AS INTEGER), CAST(c_nationkey AS BIGINT) FROM customer",
    "empty_hypothesis": "SELECT CAST(1 AS BIGINT) AS n",
    "compare_ne": "SELECT o_orderkey, o_orderpriority <> '1-URGENT' AS ok FROM orders",
    "compare_gt": "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) > 5000 AS ok FROM customer",
    "matches_any_literal": "SELECT p_partkey, starts_with(CAST(p_size AS VARCHAR), '1') AS ok FROM part",
    "matches_pattern_from_data": "SELECT n_nationkey, regexp_matches(n_name, CASE WHEN n_regionkey % 2 = 0 THEN '^[A-M]' ELSE '^[N-Z]' END) AS ok FROM nation",
    "invalid_regex_term": "SELECT 'InvalidLiteral' AS code, count(*) AS n FROM region WHERE r_regionkey % 2 = 1",
    "evaluation_errors": "SELECT c_custkey, 'Unexpected' AS code FROM customer WHERE NOT (c_acctbal >= 0)",
    "eager_arguments": "SELECT 'Unexpected' AS code, count(*) AS n FROM customer",
    "errors_before_violations": "SELECT 'Unexpected' AS outcome",
    "validate_outcomes": "SELECT unnest(['not_true', 'valid', 'missing_triple', 'not_false']) AS outcome",
    "user_function": "SELECT c_custkey, lower(c_mktsegment) AS low FROM customer",
    "ambiguous_literal": "SELECT c_custkey, 'AmbiguousLiteral' AS code FROM customer WHERE c_custkey % 10 = 0",
    "incremental_several_patterns": "SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest([1, 2]))",
    "seeded_rule": "SELECT c_custkey FROM customer WHERE c_nationkey = 7",
    "serde_round_trip": f"SELECT o_orderkey, c_custkey {_BUILDING}",
    "pattern_index": "SELECT unnest([0, 0, 1, 1, 1, 2, 2]) AS fact, unnest([0, 1, 0, 1, 1, 0, 2]) AS rule, unnest([0, 1, 0, 0, 1, 1, 0]) AS pattern",
    "traverse_quads": "SELECT 'quality' AS p, TRUE AS positive, count(*) AS n, CAST(0 AS BIGINT) AS n_graph FROM labels UNION ALL SELECT 'toxic', TRUE, count(*), 0 FROM labels UNION ALL SELECT 'type', TRUE, count(*), 0 FROM labels UNION ALL SELECT 'isToxic', toxic = 1, count(*), 0 FROM labels GROUP BY 2 UNION ALL SELECT 'contains', TRUE, count(*), count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)",
    "unreadable_graph": "SELECT 'dataset' AS outcome",
    "fresh_generator": "SELECT count(*) AS n_distinct, count(*) AS n_named FROM supplier",
    "causes": f"SELECT 'stated' AS kind, (SELECT 2 * count(*) FROM orders) + (SELECT 3 * count(*) FROM customer) AS n UNION ALL SELECT 'entailed', count(*) {_BUILDING}",
    "lift_statements": f"SELECT unnest(['triple', 'eq', 'true']) AS kind, unnest(['<{EX}g>', '<{EX}g>', NULL]) AS g, (SELECT count(*) FROM supplier) AS n",
}

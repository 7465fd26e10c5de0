"""Plans whose work must not pile up in few tasks, or be done more often than needed, as tables grow."""

from pyspark.sql import functions as F

from quadrille import Graph, parse_rule, terms
from quadrille.plans import match
from quadrille.sources import triplify as t

EX = t.BASE
NEAR = "for ?c, ?n, ?s {{ ?c <{0}of> ?n . ?s <{0}at> ?n . }} => {{ ?c <{0}near> ?s . }}".format(EX)
SAME = "for ?a, ?n, ?b {{ ?a <" + EX + "of> ?n . ?b <" + EX + "of> ?n . }} => {{ {} }}"


def table(spark, n, keys, name):
    """Nodes of which most have the first of some keys."""
    df = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % keys).otherwise(0).alias("key"))
    return df, t.branch(df, t.node("n", F.col("id")), t.name(name), t.node("key", F.col("key")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(match, "SIDE", 16, raising=False)
    (a, x), (b, y) = table(spark, 300, 7, "of"), table(spark, 90, 11, "at")
    out = parse_rule(NEAR).deduce(Graph.union_of([x, y], True)).df
    want = a.alias("a").join(b.alias("b"), "key").select(*(F.concat(F.lit(f"<{EX}n/"), F.col(f"{k}.id").cast("string"), F.lit(">")).alias(c) for k, c in zip("ab", "so", strict=True)))
    assert out.select("s", "o").exceptAll(want).isEmpty() and want.exceptAll(out.select("s", "o")).isEmpty()
    assert out.groupBy(F.spark_partition_id()).count().count() == 3
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 0.7 * out.count()


def test_parts_keep_repeated_matches(spark, monkeypatch):
    monkeypatch.setattr(match, "SIDE", 2, raising=False)
    facts = [(f"_:{k}", f"<{EX}{p}>", "_:n", *g) for k in range(9) for p in ("of", "at") for g in ((), (f"<{EX}g>",))]
    assert parse_rule(NEAR).deduce(Graph.of(spark, facts)).df.count() == 18 * 18


def test_base_columns_are_at_hand(spark):
    from quadrille.operators.deduce import base

    (_, x), (_, y) = table(spark, 20, 7, "of"), table(spark, 9, 11, "at")
    found = parse_rule(NEAR).deduce(Graph.union_of([x, y], True))
    at = base("s", t.node("n", F.lit(0)))
    assert found.based.where(F.concat(F.lit(f"<{EX}n/"), F.col(f"`{at}`").cast("string"), F.lit(">")) != F.col("s")).isEmpty()
    assert at not in found.df.columns and "sha2" not in plan(found.based.select(f"`{at}`"))


def test_a_body_is_matched_once_for_the_kinds_it_has(spark, tmp_path):
    spark.range(5).select("id", (F.col("id") % 2).alias("key")).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    g = Graph.union_of([t.branch(df, t.node("n", F.col("id")), t.name("of"), t.integer(F.col("key")))], True)
    out = parse_rule(f"for ?a, ?k {{ ?a <{EX}of> ?k . }} => {{ (>= ?k 1) . }}").violations(g)
    assert out.count() == 3 and plan(out).count("Relation") == 1


def test_two_nodes_that_differ_are_told_apart_by_their_columns(spark):
    _, x = table(spark, 40, 7, "of")
    out = parse_rule(SAME.format("?a = ?b .")).violations(Graph.union_of([x], True), based=True)
    assert "concat" not in plan(out.select(*(f"`{c}`" for c in out.columns if " " in c)))
    sizes = [r["count"] for r in x.quads().groupBy("o").count().collect()]
    assert out.where(F.col("s") == F.col("o")).isEmpty() and out.count() == sum(n * n - n for n in sizes)


def test_nodes_that_must_differ_are_joined_on_being_the_same(spark):
    _, x = table(spark, 40, 7, "of")
    out = parse_rule(SAME.format("! ?a = ?b .")).violations(Graph.union_of([x], True))
    joins = [line for line in plan(out).splitlines() if "Join" in line]
    assert len(joins) == 1 and "v0_0" in joins[0] and "v1_0" in joins[0]
    assert out.count() == 40 and out.where(F.col("s") != F.col("o")).isEmpty() and {r["reason"] for r in out.collect()} == {"not_ne"}


def test_violations_of_mixed_statements_are_those_deduced(spark):
    p = f"<{EX}of>"
    g = Graph.of(spark, [("_:a", p, "_:k"), ("_:b", p, "_:k"), ("_:b", p, "_:k", f"<{EX}g>"), ("_:c", p, "_:l")])
    found = parse_rule(SAME.format(f'! ?a = ?b . ?a = ?b . ?a {p} ?n . ! ?b = ?a . ?a <{EX}no> ?b . (= 1 2) . ! ?a = ?a .')).deduce(g)
    out = found.violations(g)
    pairs = 3 * 3 + 1
    same = 1 + 2 * 2 + 1
    want = {(0, "not_ne"): same, (1, "not_eq"): pairs - same, (3, "not_ne"): same, (4, "missing_triple"): pairs, (5, "not_true"): pairs, (6, "not_ne"): pairs}
    assert {(r["stmt_idx"], r["reason"]): r["count"] for r in out.groupBy("stmt_idx", "reason").count().collect()} == want
    both = ["deduction_id", "substitution", "stmt_idx", "positive", "s", "o"]
    assert out.select(*both).exceptAll(found.df.select(*both)).isEmpty()


def test_readings_are_one_aggregation(spark):
    int_, dec = terms.XSD + "int", terms.DECIMAL
    means = [("_:a", terms.literal("7", int_)), ("_:a", terms.literal("+7.0", dec)), ("_:b", terms.literal("7", int_)), ("_:b", terms.literal("8", int_)), ("_:b", "_:x"),
             ("_:c", terms.literal("7", int_)), ("_:c", terms.literal("7", int_)), ("_:d", terms.literal("7", int_)), ("_:d", terms.literal("7"))]
    facts = [(f"_:{c}", f"<{EX}of>", "_:k") for c in "abcd"]
    g = Graph.of(spark, facts, spark.createDataFrame(means, "resource string, term string"))
    out = parse_rule(f"for ?a, ?k {{ ?a <{EX}of> ?k . }} => {{ (>= ?a 0) . }}").deduce(g)
    assert sorted((r["substitution"][0], r["error"]["code"]) for r in out.errors().collect()) == [("_:b", "AmbiguousLiteral"), ("_:d", "AmbiguousLiteral")]
    assert "Expand" not in plan(out.errors())

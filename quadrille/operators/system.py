"""Systems: ordered sets of rules, deduced, validated and fed with new facts together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.model import Rule, Signed, Validation
from quadrille.operators.deduce import SCHEMA, Deductions, deduce
from quadrille.sources.graph import TRIPLE, Graph


class System:
    """Rules in order of insertion; an equal rule is the same rule."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules: dict[Rule, int] = {}
        self.extend(rules)

    def add(self, rule: Rule) -> int:
        """The rule's number, new or known."""
        return self._rules.setdefault(rule, len(self._rules))

    def extend(self, rules: Iterable[Rule]) -> None:
        for r in rules:
            self.add(r)

    def __len__(self) -> int:
        return len(self._rules)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self._rules)

    def __getitem__(self, number: int) -> Rule:
        return list(self._rules)[number]

    def get(self, number: int) -> Rule | None:
        return self[number] if 0 <= number < len(self) else None

    def is_empty(self) -> bool:
        return not self._rules

    def paths_for(self, fact: Signed[tuple[str, str, str]]) -> list[tuple[int, int]]:
        """(rule, pattern) of all patterns that a signed triple matches."""
        return [(k, i) for r, k in self._rules.items() for i, p in enumerate(r.hypothesis.patterns) if p.positive == fact.positive and p.value.accepts(fact.value)]

    def _none(self, graph: Graph) -> Deductions:
        return Deductions(graph.spark.createDataFrame([], SCHEMA))

    def deduce(self, graph: Graph, namespace: str = "") -> Deductions:
        """One pass of every rule over ``graph``, as a bag."""
        found = [deduce(r, graph, rule_id=k, namespace=namespace) for r, k in self._rules.items()]
        return Deductions.union_all(found) if found else self._none(graph)

    def deduce_from(self, graph: Graph, delta: DataFrame | Signed, namespace: str = "") -> Deductions:
        """What new facts lead to: each matches some pattern, the rule's other patterns match ``graph``.

        ``delta`` holds signed triples (positive, s, p, o), or is one fact. They need not be in ``graph``; those that are
        and match several patterns of a match give it once for each. Rules without patterns never fire.
        """
        paths = [(r, k, i) for r, k in self._rules.items() for i in range(len(r.hypothesis.patterns))]
        if isinstance(delta, Signed):
            wanted = set(self.paths_for(delta))
            paths = [x for x in paths if x[1:] in wanted]
            delta = graph.spark.createDataFrame([(delta.positive, *delta.value)], "positive boolean, s string, p string, o string")
        found = []
        for r, k, i in paths:
            seed = graph.scan(r.hypothesis.patterns[i], delta.select(*TRIPLE))
            found.append(deduce(r, graph, seed=seed.drop("_one") if len(seed.columns) > 1 else seed, exclude=i, rule_id=k, namespace=f"{namespace}/{i}") if seed.columns != ["_one"] else _ground(r, graph, seed, i, k, namespace))
        return Deductions.union_all(found) if found else self._none(graph)

    def violations(self, graph: Graph) -> DataFrame:
        return self.deduce(graph).violations(graph)

    def validate(self, graph: Graph) -> Validation:
        """Invalid if any rule is. Raises if any expression failed."""
        return self.deduce(graph).validate(graph)

    def saturate(self, graph: Graph, rounds: int = 100) -> Graph:
        """Extension: positive triples inserted until nothing new comes, each round from the last one's new facts.

        Each round's new facts are cut to the folder in spark.checkpoint.dir, older ones are not written again. Rules with fresh resources may never end; then it stops
        with an error after ``rounds`` rounds.
        """
        spark = graph.spark
        if not spark.sparkContext.getCheckpointDir():
            raise RuntimeError("set spark.checkpoint.dir to a shared folder first")
        known = graph.triples().checkpoint()
        new = self.deduce(graph).check().triples(True).distinct().join(known, TRIPLE, "left_anti").checkpoint()
        for _ in range(rounds):
            if new.isEmpty():
                none = F.lit(None).cast("string")
                return graph.insert(known.withColumn("g", none).join(graph.quads.select(*TRIPLE), TRIPLE, "left_anti"))
            known = known.unionByName(new)
            now = Graph(known.withColumn("g", F.lit(None).cast("string")), True, graph.interpretation)
            new = self.deduce_from(now, new).check().triples(True).distinct().join(known, TRIPLE, "left_anti").checkpoint()
        raise RuntimeError(f"not saturated after {rounds} rounds")


def _ground(rule: Rule, graph: Graph, seed: DataFrame, i: int, rule_id: int, namespace: str) -> Deductions:
    """A pattern without variables: it holds once for each such fact, or not at all."""
    n = seed.count()
    one = [deduce(rule, graph, exclude=i, rule_id=rule_id, namespace=f"{namespace}/{i}/{k}") for k in range(n)]
    return Deductions.union_all(one) if one else Deductions(graph.spark.createDataFrame([], SCHEMA))

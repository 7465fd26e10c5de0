"""Extension: streams of new facts. Each micro-batch is a delta of a system over a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quadrille.operators.deduce import Deductions
from quadrille.operators.system import System
from quadrille.sources.graph import Graph


def deduce_stream(system: System, graph: Graph | Callable[[], Graph], facts: DataFrame, sink: Callable[[Deductions, int], None]) -> DataStreamWriter:
    """A writer of the stream ``facts`` (positive, s, p, o) that hands each batch's deductions to ``sink``.

    ``graph`` is what the other patterns are matched with, or a function that gives it anew for each batch. Fresh
    resources are named after the batch, so a batch that is run again makes the same ones.
    """

    def each(batch: DataFrame, number: int) -> None:
        now = graph() if callable(graph) else graph
        sink(system.deduce_from(now, batch, namespace=f"batch{number}"), number)

    return facts.writeStream.foreachBatch(each)

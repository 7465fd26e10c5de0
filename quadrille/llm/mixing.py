"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Time runs in slots of one block. Block i of a source of weight w may not start
before slot floor((i - 1) / w) and must be done by slot ceil(i / w); each slot goes to the released block with the earliest
deadline. As the weights add up to 1, every deadline is met, so at any time each source has had its share to within
less than one block.

Weights are exact fractions, never rounded, so this holds for the target weights however long the mix is. The driver
makes the schedule from the weights and the numbers of blocks alone. Blocks have BLOCK_ROWS rows, or more where there
would be over BLOCKS of them, so the schedule has a bounded size; sources are counted on the driver, one entry each. When a source is used up, a new phase begins with the weights of the rest in proportion. Every row is kept.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.shared import fresh

#: Blocks of a source whose slots are one row of the schedule's table; without effect on the result.
SLOTS = 1000
BLOCK_ROWS = 16
#: Blocks of the schedule at most, but for one more of each source: about a second of the driver's time for a million.
BLOCKS = 1 << 20
#: Rows of a part in which rows are numbered, on average.
PART_ROWS = 2_000
#: Without given weights, a source's weight goes as its number of rows to this power.
TEMPERATURE = 0.5


def schedule(weights: list[Fraction], left: list[int], slots: int | None = None) -> list[list[int]]:
    """For each source the slots of its blocks, earliest deadline first, until one has no blocks left or after ``slots``.

    ``weights`` add up to 1.
    """
    parts = [(w.numerator, w.denominator) for w in weights]
    ready = [(-(-q // p), s) for s, (p, q) in enumerate(parts)]
    heapq.heapify(ready)
    later: list[tuple[int, int]] = []
    out: list[list[int]] = [[] for _ in weights]
    t = 0
    while slots is None or t < slots:
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            p, q = parts[s]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * q // p), s))
        deadline, s = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        out[s].append(t)
        t += 1
        done = len(out[s])
        if slots is None and done == left[s]:
            break
        p, q = parts[s]
        heapq.heappush(later, (done * q // p, s))
    return out


def period(shares: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks within one period of sum(shares) slots."""
    slots = sum(shares)
    return schedule([Fraction(k, slots) for k in shares], shares, slots)


def plan(blocks: dict[str | None, int], weights: dict[str | None, float]) -> dict[str | None, list[int]]:
    """For each source the slots of its blocks in order, over all phases.

    ``weights`` are taken as the exact values of their floats, in proportion. Of equal deadlines the one of the source
    that is first by name (null before any) goes first.
    """
    if any(not weights[s] > 0 for s, n in blocks.items() if n):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    out: dict[str | None, list[int]] = {s: [] for s in exact}
    start = 0
    while exact:
        names = sorted(exact, key=lambda s: (s is not None, s))
        total = sum(exact.values())
        made = schedule([exact[s] / total for s in names], [blocks[s] - len(out[s]) for s in names])
        for s, slots in zip(names, made, strict=True):
            out[s] += [start + t for t in slots]
            if len(out[s]) == blocks[s]:
                del exact[s]
        start += sum(map(len, made))
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with mix_slot and mix_row: rows ordered by both are the mix. Every row is kept once.

    ``weights`` must be positive and name every source (null is a source of its own); by default they go as the
    number of rows to the power TEMPERATURE. ``block_rows`` follows from the number of rows if it isn't given. Within a
    source, rows are in order of the md5 of doc_id, a colon and the text, so that the text itself need not be shuffled; rows that repeat take places in a row. Columns
    with the names of the results are replaced, others may have any name. An empty table stays empty.

    The numbers within a source come from counts by (source, part), so a source of any size is numbered in parallel.
    Parts are by the hash of doc_id and text: null or repeated ids alone don't gather in one.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("mix_slot", "mix_row")]
    source, part, key, number, before_, slots_, ts, tp, there = fresh(docs, "_s", "_p", "_k", "_i", "_before", "_slots", "_ts", "_tp", "_there")
    rows_all = docs.count()
    parts_of = max(1, -(-rows_all // PART_ROWS))
    size = int(block_rows or max(BLOCK_ROWS, -(-rows_all // BLOCKS)))
    # a null source gets a name that no other has, so that one exchange serves the window and the join
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(*names, named.alias(source), F.md5(told.cast("binary")).alias(key), F.col("text").isNotNull().alias(there))
    # parts are ranges of the hash, so that the order by part and then by hash is that of the hash
    rows = rows.withColumn(part, F.floor(F.conv(F.substring(key, 1, 12), 16, 10).cast("long") / 2.0**48 * parts_of))
    counts = rows.groupBy(source, part).agg(F.count("*").alias("n"))
    totals = {None if r[0] == "n" else r[0][1:]: r[1] for r in counts.groupBy(source).agg(F.sum("n")).collect()}
    weights = weights or {s: n**TEMPERATURE for s, n in totals.items()}
    made = plan({s: -(-n // size) for s, n in totals.items()}, weights)
    pieces = [("n" if s is None else f"s{s}", k // slots, x[k : k + slots]) for s, x in made.items() for k in range(0, len(x), slots)]
    table = spark.createDataFrame(pieces, f"`{ts}` string, `{tp}` long, `{slots_}` array<long>")
    before = counts.withColumn("b", F.sum("n").over(Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(source, part, F.coalesce("b", F.lit(0)).alias(before_))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(source, part).orderBy(key, "doc_id", there)))
    rows = rows.join(before, [source, part])
    rows = rows.withColumn(number, F.col(number) + F.col(before_) - 1)
    block = F.floor(F.col(number) / size)
    # at most BLOCKS longs, and a block of each source
    rows = rows.join(F.broadcast(table), (F.col(source) == F.col(ts)) & (F.floor(block / slots) == F.col(tp)))
    return rows.select(*names, F.get(F.col(slots_), (block % slots).cast("int")).cast("long").alias("mix_slot"), (F.col(number) % size).cast("long").alias("mix_row"))

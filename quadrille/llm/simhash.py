"""SimHash fingerprints and near-duplicate components.

Links (3 or fewer differing bits) come from a segment-popcount embedding. A fingerprint is cut into 32 segments of two
bits and mapped to its vector of bit counts. The Manhattan distance of two such vectors never exceeds the number of
differing bits, so linked fingerprints lie within distance 3, and in one half of 16 segments within distance 1. Each
half is a grid of unit cells: a fingerprint stands in its own cell and, for each count above zero, in the cell one below,
so that any two within distance 1 meet in the own cell of one of them. Cells are joined by key; each meeting is verified
on the bits.

Cells hold distinct fingerprints only. A crowded cell yields a spanning forest of its links, not all of its pairs, so
what leaves a cell is linear in what entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import connected_components, cut, fresh, marks, release

#: Bits that linked fingerprints may differ in; the grid is built for this value.
MAX_BITS = 3
SHINGLE = 3
_CROWDED = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        last = len(words) - shingle + 1
        pairs = zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[k : k + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id long, fp long): the fingerprint of each row's whole text, as a signed long; ``more`` longs are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    return read.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in read.columns[2:])]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64(0x55555555)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, who = [], []
        for half in (0, 1):
            x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            counts = (x & low) + ((x >> np.uint64(1)) & low)
            tag = np.uint64(half << 32)
            keys.append(counts | tag)
            who.append(fp)
            for j in range(16):
                has = (counts >> np.uint64(2 * j)) & np.uint64(3) > 0
                keys.append((counts[has] - np.uint64(1 << 2 * j)) | tag)
                who.append(fp[has])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, who)], ["cell", "fp"])


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest over all links among ``fps``."""
    left, edges = np.unique(fps), []
    while left.size:
        frontier, left = left[:1], left[1:]
        while frontier.size and left.size:
            reached = []
            for k in range(0, len(frontier), 64):
                some = frontier[k : k + 64]
                near = np.bitwise_count(left[None, :] ^ some[:, None]) <= MAX_BITS
                hit = near.any(0)
                edges.append((some[near.argmax(0)[hit]], left[hit]))
                reached.append(left[hit])
                left = left[~hit]
            frontier = np.concatenate(reached)
    return edges


def _links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells, given rows sorted by cell."""
    edges = [(fp[:0], fp[:0])]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    count = np.diff(np.append(first, len(cell)))
    for at in np.flatnonzero(count > _CROWDED):
        edges += _forest(fp[first[at] : first[at] + count[at]])
    small = np.repeat((count > 1) & (count <= _CROWDED), count)
    cell, fp = cell[small], fp[small]
    for d in range(1, _CROWDED):
        same = np.flatnonzero(cell[d:] == cell[:-d])
        if not same.size:
            break
        a, b = fp[same], fp[same + d]
        near = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        edges.append((a[near], b[near]))
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell = fp = np.zeros(0, np.uint64)

    def out(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = _links(cell, fp)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        cell = np.concatenate((cell, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        end = int(np.searchsorted(cell == cell[-1], True)) if len(cell) else 0  # the last cell may go on
        if end:
            yield out(cell[:end], fp[:end])
            cell, fp = cell[end:], fp[end:]
    if len(cell):
        yield out(cell, fp)


def links(fps: DataFrame) -> DataFrame:
    """(u, v: long): links that connect distinct values of column fp as all links within MAX_BITS would."""
    cells = fps.select("fp").distinct().mapInArrow(_cells, "cell long, fp long")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_cells, "u long, v long")


def _labelled(fps: DataFrame) -> DataFrame:
    """(fp, low, label) for each distinct fingerprint: its least doc_id, and a label that its component shares."""
    labels = connected_components(links(fps))
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return cut(each.select("fp", "low", F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp_long), a row for each row of ``docs``.

    Null or wordless texts have fingerprint zero and link like any other. A null doc_id takes part in links but is
    never a component_id; a component of null ids only has component_id null. Repeated rows each get a row. An empty
    table gives an empty result. Other columns are ignored.
    """
    fps = cut(fingerprints(docs))
    each = _labelled(fps)
    lowest = each.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = each.join(lowest, "label").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("fp").alias("fp_long")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the least doc_id.

    Of rows with that id, and of components of null ids only, the row with the least text hash stays. Of rows that
    repeat one stays. The columns are those of ``docs``, whatever their names. An empty table stays empty.
    """
    i, h, k, w, i2, h2, k2 = fresh(docs, "_id", "_hash", "_key", "_wins", "_own_id", "_own_hash", "_own_key")
    text = F.xxhash64(F.col("text").cast("string"))
    fps = cut(fingerprints(docs, text.alias("hash")))
    labelled = _labelled(fps)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("x")
    best = fps.groupBy("fp").agg(first).join(labelled, "fp").groupBy("label").agg(F.min("x").alias("x"))
    best = best.select(F.col("x.doc_id").alias("d"), F.col("x.hash").alias("h"), F.lit(True).alias("wins"))
    rows = fps.groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    rows = rows.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left").where("wins IS NULL OR n > 1")
    # what goes, and what stays once of several: all other rows needn't be shuffled
    few = cut(rows.select(F.col("doc_id").alias(i), F.col("hash").alias(h), F.coalesce("wins", F.lit(False)).alias(w), F.xxhash64("doc_id", "hash").alias(k)))
    release(fps, labelled)
    keyed = docs.withColumns({i2: F.col("doc_id").cast("long"), h2: text}).withColumn(k2, F.xxhash64(i2, h2))
    maybe = marks(few.select(k), F.col(k2))
    some = keyed.where(maybe).join(few, F.col(i2).eqNullSafe(F.col(i)) & (F.col(h2) == F.col(h)), "left").where(F.coalesce(F.col(w), F.lit(True)))
    return keyed.where(~maybe).select(*docs.columns).unionByName(some.dropDuplicates([i2, h2]).select(*docs.columns))

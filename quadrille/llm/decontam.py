"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

An alignment of m equal words and e edits scores m - e / 2. To reach the threshold t of an item of n words, e is at most
2 (m - t n); each edit parts at most one pair of neighbours, so at least (2 t - 1) n - 1 of the item's pairs of words stand
in the passage, which is at most (3 - 2 t) n words long. The item's pairs without some of the commonest are its seeds;
passages with fewer of them than must be left can't reach the threshold, and all others are aligned with the item word by
word. The alignment's score as a share of a full match decides. So the result is that of aligning every item with every
document. Where the bound leaves no pair (low thresholds, short items), single words are counted instead, at least t n.

The benchmark is sent to the tasks in blocks of at most BLOCK_GRAMS n-grams; a larger one is worked off in several
scans of the documents, so that what is broadcast stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import fresh

THRESHOLD = 0.6
BLOCK_GRAMS = 1_000_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
_STRIP = ".,;:!?\"'()[]{}*_«»“”‘’…-"


def normal_words(text: str | None) -> list[str]:
    """Lower-case words without punctuation at either end; what is punctuation only counts as no word."""
    return [x for x in ((w.strip(_STRIP)) for w in (text or "").lower().split()) if x]


class Items:
    """A block of benchmark items: the vocabulary, word sequences and seeds.

    A passage that reaches ``threshold`` holds at least need[k] seeds of item k within span[k] words.
    """

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], np.int64) for _, t in items]
        self.span = [math.floor((3 - 2 * threshold) * len(w) + 1e-9) + 1 for w in self.words]
        pairs = [math.ceil((2 * threshold - 1) * len(w) - 1 - 1e-9) for w in self.words]
        sizes = [2 if n > 0 else 1 for n in pairs]
        must = [n if n > 0 else max(1, math.ceil(threshold * len(w) - 1e-9)) for n, w in zip(pairs, self.words, strict=True)]
        hashes = [_gram_hash(w, n) for w, n in zip(self.words, sizes, strict=True)]
        _, place, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = np.split(often[place], np.cumsum([len(h) for h in hashes])[:-1])
        # of n-grams of which m are left, any choice without c of them has m - c left
        spare = [n // 2 for n in must]
        kept = [np.argsort(c, kind="stable")[: len(c) - n] for c, n in zip(often, spare, strict=True)]
        seed = np.concatenate([h[x] for h, x in zip(hashes, kept, strict=True)])
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.seed_item = np.repeat(np.arange(len(items)), [len(x) for x in kept])[order]
        self.need = np.array(must) - np.array(spare)
        self.sizes = sorted(set(sizes))

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def _gram_hash(x: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n-gram of word numbers; n is part of it."""
    m = len(x) - n + 1
    out = np.full(max(m, 0), n, np.uint64)
    for j in range(n):
        out = (out ^ x[j : j + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _present(x: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-grams of which all words are known."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    bad = np.concatenate(([0], np.cumsum(x < 0)))
    return np.flatnonzero(bad[n:] == bad[:-n])


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman of word numbers: the best score, and the part of ``b`` it covers (start, end exclusive)."""
    before, begin = np.zeros(len(b) + 1), np.arange(len(b) + 1)
    best = (0.0, 0, 0)
    steps = np.arange(len(b) + 1) * GAP
    for x in a:
        diagonal = before[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = before[1:] + GAP
        score = np.concatenate(([0.0], np.maximum(diagonal, up)))
        start = np.concatenate(([0], np.where(diagonal >= up, begin[:-1], begin[1:])))
        fresh = score <= 0
        score[fresh] = 0.0
        start[fresh] = np.flatnonzero(fresh)
        # gaps along b: the best of score[i] + GAP * (j - i) over i <= j
        lifted = np.maximum.accumulate(score - steps)
        source = np.maximum.accumulate(np.where(score - steps >= lifted, np.arange(len(score)), 0))
        before, begin = np.maximum(lifted + steps, 0.0), start[source]
        top = int(before.argmax())
        if before[top] > best[0]:
            best = (float(before[top]), int(begin[top]), top)
    return best


def match(words: list[str], items: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """(place of the item, score, start, end in words) for each item that a document holds, best passage each."""
    x = items.encode(words)
    out = []
    for n in items.sizes:
        at = _present(x, n)
        h = _gram_hash(x, n)[at]
        low = np.searchsorted(items.seed, h, "left")
        count = np.searchsorted(items.seed, h, "right") - low
        ends = np.cumsum(count)
        if not len(at) or not ends[-1]:
            continue
        item = items.seed_item[np.arange(ends[-1]) + np.repeat(low - ends + count, count)]
        place = np.repeat(at, count)
        enough = np.bincount(item, minlength=len(items.need)) >= items.need
        place, item = place[enough[item]], item[enough[item]]
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        for p, k in zip(np.split(place, np.flatnonzero(np.diff(item)) + 1), np.unique(item).tolist(), strict=True) if len(item) else ():
            out += _best(x, items, k, p, threshold)
    return out


def _best(x: np.ndarray, items: Items, k: int, p: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """The match of item ``k`` in ``x``, if any; ``p`` are the places of its seeds in order."""
    size, span, more = len(items.words[k]), items.span[k], int(items.need[k]) - 1
    best = (0.0, 0, 0)
    begins = p[: len(p) - more][p[more:] - p[: len(p) - more] < span]
    # what a dense passage is part of lies within span of its first seed; passages that overlap are aligned as one
    for part in np.split(begins, np.flatnonzero(np.diff(begins) > 2 * span) + 1) if len(begins) else ():
        a, b = max(0, int(part[0]) - span), int(part[-1]) + span + 1
        score, s, e = align(items.words[k], x[a:b])
        if score / size > best[0]:
            best = (score / size, a + s, a + e)
    return [(k, min(1.0, best[0]), best[1], best[2])] if best[0] >= threshold else []


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): items that whole documents hold, for each row of ``docs``.

    score is the alignment's score as a share of a full match of the item (to 1). Of passages that score the same the one
    that ends first counts. Items without words and null texts on either side match nothing; an item of one or two words
    is found wherever they are, so it is for the caller to leave out what is too short to tell a copy from chance. Null
    ids are carried. Repeated rows each give their matches. Other columns are ignored. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = None
    for block in _blocks(benchmark, threshold):
        part = _scan(docs, block, threshold, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        w = normal_words(r[1])
        if not w:
            continue
        if held and size + len(w) > BLOCK_GRAMS:
            yield Items(held, threshold)
            held, size = [], 0
        held.append((r[0], w))
        size += len(w)
    if held:
        yield Items(held, threshold)


def _scan(docs: DataFrame, block: Items, threshold: float, schema: str) -> DataFrame:
    ready = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready.value
        for b in batches:
            rows = [(i, items.ids[k], s, a, e) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k, s, a, e in match(normal_words(t.as_py()), items, threshold)]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay. Each row is judged by its own text.

    Rows with a null text, null ids and repeated ids are judged like any other; rows that repeat share their fate.
    """
    out = docs
    for block in _blocks(benchmark, threshold):
        out = _without(out, block, threshold)
    return out


def _without(docs: DataFrame, block: Items, threshold: float) -> DataFrame:
    ready = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns
    (text,) = fresh(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready.value
        for b in batches:
            texts = b.column(len(names))
            kept = [not match(normal_words(t.as_py()), items, threshold) for t in texts]
            yield b.select(names).filter(pa.array(kept, pa.bool_()))

    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, docs.schema)

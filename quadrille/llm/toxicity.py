"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the distinct words of a text and their 4- and 5-letter beginnings. Features whose presence tells the labels
apart in a bounded sample are kept, and a logistic regression is fitted to them. For each labelled text that holds a
group term, a copy with each such term swapped for the next one of its list is scored as well, and the squared change
of the score's logit is penalised, so neutral mentions of one group or another don't move it.

Lists of group terms come from two places. IDENTITY names groups of people. As a corpus may name others, or none of
these, neutral terms are found in it: common words that don't tell the labels apart, those of like frequency in one
list. All of their features are in the model, so the penalty holds what weight they would get by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import cut, fresh, release

#: Labelled rows that the classifier is fitted on, at most on average: a fixed sample by hash of doc_id.
MAX_TRAIN = 8000
#: Features that tell the labels apart and that the classifier keeps, those that tell most.
MAX_FEATURES = 4096
#: Standard deviations that a feature's share of toxic labels must lie from that of all.
TELLS = 4.0
#: Neutral terms that are found, the commonest first, and how many of them make a list.
NEUTRAL, LIST = 256, 4
#: Least share of the sample's rows that hold a neutral term.
COMMON = 0.01
THRESHOLD = 0.3
#: Lists of group terms; a term is swapped for the next one of its list.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("old", "young"),
    ("immigrant", "native", "refugee", "foreigner"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """Words themselves (w:) and beginnings of longer words (4:, 5:)."""
    return {"w:" + w for w in found} | {"4:" + w[:4] for w in found if len(w) > 4} | {"5:" + w[:5] for w in found if len(w) > 5}


class Model:
    """Weights by feature; a score is the logistic of their sum over a text's features."""

    def __init__(self, weights: dict[str, float], bias: float, swaps: dict[str, str] | None = None, swapped: int = 0, moved: float = 0.0):
        self.word = {k[2:]: v for k, v in weights.items() if k[0] == "w"}
        self.four = {k[2:]: v for k, v in weights.items() if k[0] == "4"}
        self.five = {k[2:]: v for k, v in weights.items() if k[0] == "5"}
        self.bias, self.swaps = bias, swaps or {}
        #: Rows of the sample with a counterfactual copy, and the root mean square of how far the swap moves their logits.
        self.swapped, self.moved = swapped, moved

    def logit(self, text: str | None) -> float:
        found = words(text)
        z = self.bias + sum(self.word[w] for w in found if w in self.word)
        z += sum(self.four[w] for w in {w[:4] for w in found if len(w) > 4} if w in self.four)
        return z + sum(self.five[w] for w in {w[:5] for w in found if len(w) > 5} if w in self.five)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def sample(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """About ``max_rows`` of the rows at most, by a hash of doc_id; so its size is bounded."""
    n = labelled.count()
    return labelled if n <= max_rows else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / n)))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, n, pos): rows of ``rows`` (text, toxic) that hold each feature, and those of them with a toxic label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                found = list(features(words(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic.as_py()] * len(found), pa.int32())], ["feature", "toxic"])

    each = rows.mapInArrow(run, "feature string, toxic int")
    return each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))


def swap_lists(neutral: Iterable[str], identity: Iterable[tuple[str, ...]] = IDENTITY) -> dict[str, str]:
    """The term that each term is swapped for; ``neutral`` in order of frequency."""
    named = {t for group in identity for t in group}
    rest = [t for t in neutral if t not in named]
    found = [tuple(rest[k : k + LIST]) for k in range(0, len(rest), LIST)]
    return {t: group[(k + 1) % len(group)] for group in (*identity, *found) if len(group) > 1 for k, t in enumerate(group)}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, penalty: float = 1.0) -> Model:
    """A model from texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of which null labels teach nothing.

    A doc_id that ``labels`` repeats is toxic if one of its labels is; one that ``docs`` repeats gives a row for each of
    its texts. Null ids teach nothing; a null text is an empty one. Other columns are ignored. Without labels of both
    kinds, every score is the share of toxic labels (0 if none).

    Features are counted in Spark. The driver gets the features that are kept, and of each row of the sample the numbers
    of those that it holds.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = cut(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample(own, max_rows)), "doc_id").select("text", "toxic"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic / total if total else 0.0
    if not 0 < share < 1:
        release(rows)
        return Model({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    expected = F.col("n") * share
    sd = F.sqrt(expected * (1 - share) * F.greatest(1 - F.col("n") / (total + 1), F.lit(1e-3)))
    scored = _counted(rows).where("n >= 3").withColumn("z", F.abs((F.col("pos") - expected) / sd))
    scored = cut(scored.where((F.col("z") > TELLS) | (F.col("z") <= TELLS / 2) & (F.col("n") >= COMMON * total)))
    names = [r[0] for r in scored.where(F.col("z") > TELLS).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()]
    common = scored.where((F.col("z") <= TELLS / 2) & F.col("feature").startswith("w:"))
    neutral = [r[0][2:] for r in common.orderBy(F.desc("n"), "feature").limit(NEUTRAL).select("feature").collect()]
    swaps = swap_lists(neutral)
    place = {k: i for i, k in enumerate(dict.fromkeys([*names, *sorted(features(set(swaps)))]))}
    parts = _encoded(rows, place, swaps).collect()  # of each of about max_rows rows, the numbers of the features kept
    release(rows, scored)
    return _fitted(parts, place, swaps, share, penalty)


def _encoded(rows: DataFrame, place: dict[str, int], swaps: dict[str, str]) -> DataFrame:
    """(toxic, has, lost, won): the kept features of each row, those that a swap takes away, and those that it brings."""
    kept = rows.sparkSession.sparkContext.broadcast((place, swaps))  # MAX_FEATURES and the terms' own

    def numbers(found: set[str], place: dict[str, int]) -> bytes:
        return np.array(sorted(place[k] for k in found if k in place), np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, swaps = kept.value
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                found = words(text.as_py())
                has, other = features(found), features({swaps.get(w, w) for w in found})
                out.append((toxic.as_py(), numbers(has, place), numbers(has - other, place), numbers(other - has, place)))
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["toxic", "has", "lost", "won"])

    return rows.mapInArrow(run, "toxic int, has binary, lost binary, won binary")


def _fitted(parts: list, place: dict[str, int], swaps: dict[str, str], share: float, penalty: float, steps: int = 300) -> Model:
    def flat(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(x, np.int32) for x in lists]
        return np.concatenate(each).astype(np.int64), np.repeat(np.arange(len(each)), [len(x) for x in each])

    parts = sorted(map(tuple, parts))  # so that the fit doesn't depend on the order of arrival
    y = np.array([float(p[0]) for p in parts])
    index, row = flat([p[1] for p in parts])
    lost, lost_row = flat([p[2] for p in parts])
    won, won_row = flat([p[3] for p in parts])
    change, change_row = np.concatenate((lost, won)), np.concatenate((lost_row, won_row))
    sign = np.repeat((1.0, -1.0), (len(lost), len(won)))
    d, m = len(place), len(y)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    g1, g2, l2 = np.zeros(d + 1), np.zeros(d + 1), 2e-4
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[index], m), -30, 30)))
        e = (p - y) / m
        moved = np.bincount(change_row, sign * w[change], m)
        grad = np.append(np.bincount(index, e[row], d) + 2 * penalty / m * np.bincount(change, sign * moved[change_row], d) + l2 * w, e.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        move = 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    moved, rows = np.bincount(change_row, sign * w[change], m), np.unique(change_row)
    return Model({k: float(w[i]) for k, i in place.items()}, float(b), swaps, len(rows), float(np.sqrt((moved[rows] ** 2).mean())) if len(rows) else 0.0)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of each row with the score (0 to 1) of its whole text; null texts score as empty ones.

    A kept column that is called score is replaced.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights
    keep = tuple(k for k in keep if k.lower() != "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([kept.value.score(t.as_py()) for t in b.column(b.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*keep, "score"])

    (text,) = fresh(docs, "_text")
    rows = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}{', ' if keep else ''}score double")

"""Language identification with bit-sliced Bloom filters over character trigrams.

Each of CELLS cells holds a mask with one bit per language, in words of 64 bits. A trigram sets its language's bit in PROBES cells; reading
it back is the AND of those cells, which names all languages that contain it. A text's per-language counts of such bits
are corrected for the filter's rate of false positives, and the largest decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import fresh

CELLS = 1 << 18
PROBES = 3
#: Trigrams a language keeps, most frequent first: the size of the model, which a filter of CELLS cells is made for.
KEEP = 3000
#: A trigram is kept for a language if its rate there is at least this share of its highest rate over languages.
SHARE = 0.1
#: Training rows at most, on average: a fixed sample by hash of doc_id.
MAX_TRAIN = 12_000
UNKNOWN = "und"

_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """Lower-case code points, 0 for all that are not letters, and a 0 at either end."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.where(_LETTERS[x], x, 0)
    return np.concatenate(([0], x, [0])).astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    """A hash for each trigram whose middle is a letter."""
    c = codes(text or "")
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    h = h[c[1:-1] > 0]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _probes(h: np.ndarray) -> list[np.ndarray]:
    return [((h ^ (h >> np.uint64(32))) * np.uint64(2 * k + 0x94D049BB133111EB) >> np.uint64(64 - 18)).astype(np.int64) for k in range(PROBES)]


class Filter:
    """The bit-sliced filter with its languages."""

    def __init__(self, kept: dict[str, np.ndarray]):
        self.langs = sorted(kept)
        self.cells = np.zeros((-(-len(self.langs) // 64), CELLS), np.uint64)
        self.false = np.zeros(len(self.langs))
        for k, lang in enumerate(self.langs):
            own = np.zeros(CELLS, bool)
            for at in _probes(kept[lang]):
                own[at] = True
            self.cells[k // 64, own] |= np.uint64(1 << k % 64)
            self.false[k] = own.mean() ** PROBES

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages for each trigram, by words of 64 languages."""
        first, *rest = _probes(h)
        out = self.cells[:, first]
        for at in rest:
            out &= self.cells[:, at]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and the share of the text's trigrams that it contains (0 to 1)."""
        h = grams(text)
        if not len(h) or not self.langs:
            return UNKNOWN, 0.0
        mask = self.lookup(h)
        hits = np.array([np.count_nonzero(mask[k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.langs))])
        true = (hits - len(h) * self.false) / (1 - self.false).clip(1e-9)
        best = int(true.argmax())
        return self.langs[best], float(min(1.0, max(0.0, true[best] / len(h))))


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> Filter:
    """A filter of the trigrams that each language keeps; see kept_grams."""
    return Filter(kept_grams(labelled, max_rows))


def kept_grams(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """The hashes of the trigrams that each language keeps, from columns text and lang; rows with a null in either, or no letters, teach nothing.

    If there are more than ``max_rows`` rows, a sample of about that many is used, by a hash of the text. Repeated rows
    count each time; of trigrams that are as frequent, those of the least hash are kept. Other columns are ignored.
    Without rows every text is und.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    n = labelled.where(F.col("lang").isNotNull()).count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, k = np.unique(grams(text), return_counts=True)
                found.setdefault(lang, Counter()).update(dict(zip(u.view(np.int64).tolist(), k.tolist(), strict=True)))
        lines = [(lang, g, k) for lang, c in found.items() for g, k in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(_by("lang"))
    rate = counts.select("lang", "gram", "n", (F.col("n") / total).alias("rate"))
    rate = rate.withColumn("best", F.max("rate").over(_by("gram"))).where((F.col("rate") >= SHARE * F.col("best")))
    top = rate.withColumn("k", F.row_number().over(_by("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= KEEP)
    kept: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").collect():  # KEEP trigrams of each language at most
        kept.setdefault(r[0], []).append(r[1])
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in kept.items()}


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def identify(docs: DataFrame, model: Filter, *keep: str, results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of each row with ``results`` from the whole text alone; und and 0 without letters.

    A null text has none; repeated rows and null ids are judged like any other; of languages that fit as well the first
    by name is predicted. Kept columns with the names of the results are replaced.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)  # CELLS masks: a fixed size for each 64 languages
    keep = tuple(k for k in keep if k.lower() not in {r.lower() for r in results})
    names = [*keep, *results]
    (text,) = fresh(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kept.value.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}{', ' if keep else ''}`{results[0]}` string, `{results[1]}` double")

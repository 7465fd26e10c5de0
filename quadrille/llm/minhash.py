"""MinHash fingerprints: LANES multiply-add hashes over hashed word shingles, the least value of each kept.

A fingerprint is LANES lanes of 16 bits in hex. The share of equal lanes estimates the Jaccard similarity of the shingle
sets with a standard error of at most 0.5 / sqrt(LANES), 0.036 at a similarity of 0.8. Near pairs come from bands of lanes joined in Spark, and the
Jaccard similarity of the shingle sets themselves is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.shared import BLOCK_BYTES, connected_components, cut, marks, release, text_bytes

LANES = 128
SHINGLE = 5
THRESHOLD = 0.8
#: Lanes of a band: (0.8 ** ROWS) is the chance that a pair at the threshold meets in one band.
ROWS = 4
#: How far below the threshold the estimate of a similar pair may lie: seven standard errors.
LEAST = 0.25
#: Texts of a band that are compared with each other; larger bands go through _crowded, which finds the same links.
CROWD = 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, LANES, dtype=np.uint64)
_MOST = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each shingle of ``size`` words (fewer words: the whole sequence; none: one hash of nothing)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    joined = b" ".join(words)
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - size + 1
    pairs = zip(starts[:last].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b]) for a, b in pairs), np.uint64, last)


def least(hashes: np.ndarray) -> np.ndarray:
    """The least value of each lane's hash over ``hashes``."""
    out = _MOST
    for k in range(0, len(hashes), 512):
        x = hashes[k : k + 512, None] * _MUL
        x += _ADD
        out = np.minimum(out, x.min(0))
    return out


def to_lanes(low: np.ndarray) -> np.ndarray:
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def signature(text: str | None) -> np.ndarray:
    return to_lanes(least(shingle_hashes(text)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures."""
    return float((a == b).mean())


def verified(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> float | None:
    """The Jaccard similarity of two texts' shingles (hashes a, b) if their signatures (x, y) share a band, else null."""
    if not (x.reshape(-1, ROWS) == y.reshape(-1, ROWS)).all(1).any():
        return None
    return jaccard(a, b)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _bytes(lanes: np.ndarray) -> bytes:
    return lanes.astype(">u2").tobytes()


def _hex(lanes: np.ndarray) -> str:
    return _bytes(lanes).hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third (floor) replaced by the first as many code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt to ranges of doc_id, with the head of the next lower range added to each (aside = 1).

    Ranges end at ids that occur, so that the next document of a range's last one is the head of the range below; the
    lowest range gets the highest document of all. There are as many heads as ranges. A range's ends are sent to the
    tasks, a long for each BLOCK_BYTES of text; a row's range is found by bisection.
    """
    n = max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    asked = [F.max("doc_id").alias("top")] + ([F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n)).alias("q")] if n > 1 else [])
    cuts = ids.agg(*asked).first()
    split = np.array(sorted({*((cuts["q"] if n > 1 else None) or [])} - {cuts["top"]}), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(split)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range, and 1 if it is the head of it that the range above needs as well."""
        null = ids.isna().to_numpy()
        x = np.where(null, np.iinfo(np.int64).min, ids.fillna(0).to_numpy().astype(np.int64))
        at = np.searchsorted(sent.value, x, "left")
        head = (at < len(sent.value)) & ~null
        head[head] = sent.value[at[head]] == x[head]
        return pd.Series(np.where(null, 0, 2 * at + head))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", place("doc_id")).withColumn("range", F.shiftright("place", 1).cast("int"))
    own = F.struct(F.col("range"), F.lit(0).alias("aside"))
    above = F.struct((F.col("range") + 1).alias("range"), F.lit(1).alias("aside"))
    first = F.struct(F.lit(0).alias("range"), F.lit(2).alias("aside"))
    top = F.col("doc_id").eqNullSafe(F.lit(cuts["top"]).cast("long"))
    dealt = F.when(top, F.array(own, first)).when(F.col("place") % 2 == 1, F.array(own, above)).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(dealt).alias("d")).select("doc_id", "text", "d.range", "d.aside"), len(split) + 1


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_chars, edited_sha256, lanes, edited_lanes, near_edited, near_next, jaccard_edited, jaccard_next)
    for each row; see fingerprints.

    key is the hash that xxhash64 has for the text; lanes are signatures in binary.
    """
    dealt, n = _with_next(docs)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "aside", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n_chars", "edited_sha256", "lanes", "edited_lanes", "near_edited", "near_next", "jaccard_edited", "jaccard_next"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), *[pa.float64()] * 4]
        held = None  # the row that waits for its next document

        def done(row: tuple, text: str, following: np.ndarray, lanes: np.ndarray) -> tuple:
            doc_id, own, hashes, full = row
            new = edited(own, text)
            other = shingle_hashes(new)
            m = min(len(hashes), len(other))
            differ = np.flatnonzero(hashes[:m] != other[:m])
            same = int(differ[0]) if len(differ) else m
            changed = to_lanes(np.minimum(least(hashes[:same]), least(other[same:])))
            key = int(np.uint64(xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass"), 42)).view(np.int64))
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            exact = verified(hashes, other, full, changed), verified(hashes, following, full, lanes)
            return doc_id, key, len(own), digest, _bytes(full), _bytes(changed), likeness(full, changed), likeness(full, lanes), *exact

        for b in batches:
            out = []
            for doc_id, text, part, aside in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes = shingle_hashes(text)
                full = to_lanes(least(hashes))
                if held is not None and held[0] == part:
                    out.append(done(held[1], text, hashes, full))
                held = None if aside else (part, (doc_id, text, hashes, full))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    schema = "doc_id long, key long, n_chars long, edited_sha256 string, lanes binary, edited_lanes binary, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    return dealt.select("doc_id", "text", "range", "aside").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, classes: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next
    [, class_id]) for each row.

    The next document is the one before in doc_id (descending order, null ids last, equal ids by text), and after the
    last one the first. The one document of a table is its own next. A null text counts as empty. Other columns are
    ignored. One exchange of the texts; rows stream through sorted ranges, so memory holds two documents. Null ids, and
    rows of one id, are a single range. near_edited and near_next are estimates; jaccard_edited and jaccard_next are the
    similarities of the shingle sets where the signatures share a band, else null. With ``classes``, class_id is that of
    near_classes.
    """
    made = signed(docs)
    if classes:
        made = cut(made)
        made = made.join(_classes(made.select("doc_id", "key", "lanes"), docs, THRESHOLD), "key")
    hexed = (F.lower(F.hex(c)).alias(n) for c, n in (("lanes", "fingerprint"), ("edited_lanes", "edited_fingerprint")))
    return made.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", "jaccard_edited", "jaccard_next", *(["class_id"] if classes else []))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): near-duplicate classes by banded signatures with verified Jaccard similarity.

    Documents of equal text are one class from the start. Each band of ROWS lanes is a key; a band's texts are compared
    with its head, the text that shares most bands, and those of them that are in another class than the head after that,
    with the band's other texts of other classes. Where a band has more than CROWD texts, an exact join of their shingle
    sets takes the place of the second step. A pair is verified on its shingle sets unless its signatures agree in
    so few lanes (LEAST) that it can't be similar but for a chance below 1e-10. Two texts at the threshold share no band
    with a chance of (1 - 0.8 ** ROWS) ** (LANES / ROWS), 5e-8. class_id is the least doc_id of the class. Null texts
    count as empty; a class of null ids only has class_id null. Repeated rows each get a row. Other columns are
    ignored. An empty table gives none.
    """
    made = cut(signed(docs).select("doc_id", "key", "lanes"))
    return made.select("doc_id", "key").join(_classes(made, docs, threshold), "key").select("doc_id", "class_id")


def _classes(made: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(key, class_id) for each text of ``made`` (doc_id, key, lanes), which are those of ``docs``."""
    least_of = F.min("doc_id").alias("low")
    texts = cut(made.groupBy("key").agg(least_of, F.first("lanes").alias("lanes")))
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("lanes", 2 * k + 1, 2 * ROWS)) for k in range(0, LANES, ROWS)))
    by = Window.partitionBy("band")
    posts = texts.select("key", F.explode(bands).alias("band")).withColumn("many", F.count("*").over(by)).where("many > 1")
    shared = cut(posts)
    # the head is the text that shares most bands with others, as an unedited one does with its edited forms
    weighed = shared.join(shared.groupBy("key").agg(F.sum("many").alias("weight")), "key")
    heads = weighed.groupBy("band").agg(F.max(F.struct("weight", "key")).alias("h")).select("band", F.col("h.key").alias("head"))
    posts = cut(shared.join(heads, "band"))
    release(shared)
    signs = texts.select("key", "lanes").join(posts.select("key").distinct(), "key", "left_semi")
    pairs = posts.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    good = cut(_verified(pairs, signs, docs, threshold))
    label = connected_components(good.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # what is in another class than its head, with all in the band that are in another class than it
    named = posts.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = named.join(label.select(F.col("node").alias("head"), F.col("label").alias("of_head")), "head", "left")
    named = cut(named.select("band", "key", "label", "many", F.coalesce("of_head", "head").alias("of_head")))
    few = named.where(F.col("many") <= CROWD)
    x, y = few.where("label <> of_head").alias("x"), few.alias("y")
    both = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")))
    rest = both.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
    many = named.where(F.col("many") > CROWD)
    crowd = many.join(many.where("label <> of_head").select("band").distinct(), "band", "left_semi").select("key", "label").distinct()
    rest = rest.unionByName(_crowded(crowd, docs, threshold)).distinct().join(good, ["a", "b"], "left_anti")
    more = cut(good.unionByName(_verified(rest, signs, docs, threshold)))
    label = connected_components(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    sets = cut(texts.select("key", "low").join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("label", "key").alias("label")))
    release(texts, posts, good, named, more)
    return sets.join(sets.groupBy("label").agg(F.min("low").alias("class_id")), "label").select("key", "class_id")


def _texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) of the texts whose hashes are the one column of the table ``keys``."""
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("key"), "text")
    return own.where(marks(keys, F.col("key"))).join(keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def _crowded(crowd: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts of ``crowd`` (key, label) with different labels, among them all that are similar enough.

    An exact set-similarity join: all texts order their shingles alike, rarest first. Similar texts of x and y shingles
    share at least t / (1 + t) * (x + y) of them, all at or after the place of the first shared one in either text. So
    that one is among the first of both, and only pairs that meet where enough can follow remain.
    """

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t)).view(np.int64) for t in texts])

    crowd = cut(crowd)
    sets = cut(_texts(crowd.select("key"), docs).select("key", shingles("text").alias("tokens")))
    tokens = sets.select("key", F.explode("tokens").alias("token"))
    tokens = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("c")), "token")
    ranked = tokens.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ranked")).withColumn("n", F.size("ranked"))
    first = F.slice("ranked", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1).cast("int"))
    posts = ranked.select("key", "n", F.posexplode(first).alias("at", "of")).where("of.c > 1").select("key", "n", "at", F.col("of.token").alias("token"))
    posts = cut(posts.join(crowd, "key"))
    share = threshold / (1 + threshold)
    x, y = posts.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * share) - 1e-6)).alias("x"), posts.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    shorter = (n < m) | ((n == m) & (F.col("x.key") < F.col("y.key")))
    enough = (n >= m * threshold - 1e-6) & (F.least(n - F.col("x.at"), m - F.col("y.at")) >= F.ceil((n + m) * share - 1e-6))
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & shorter & enough)
    pairs = cut(both.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())
    release(crowd, sets, posts)
    return pairs


def _verified(pairs: DataFrame, signs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are similar enough."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(s, ">u2") == np.frombuffer(t, ">u2")).mean() for s, t in zip(x, y, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(shingle_hashes(s), shingle_hashes(t)) for s, t in zip(x, y, strict=True)], dtype="float64")

    left, right = (signs.select(F.col("key").alias(k), F.col("lanes").alias(f"{k}_lanes")) for k in "ab")
    likely = cut(pairs.join(left, "a").join(right, "b").where(alike("a_lanes", "b_lanes") >= threshold - LEAST).select("a", "b"))
    wanted = cut(likely.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    texts = _texts(wanted, docs)
    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")
    return likely.join(left, "a").join(right, "b").where(exact("a_text", "b_text") >= threshold).select("a", "b")

"""Substring dedup: words covered by windows that start in an earlier document are removed.

Documents are dealt once, by a hash of doc_id, into blocks of about BLOCK_BYTES. Both passes and the removal work on
that one exchange of texts.

Pass 1, count-min prefilter: each block hashes the words of its windows and sends the sorted cells of a count-min sketch
(width 16 times the windows, delta-coded) to the owners of cell ranges. An owner merges the blocks' sketches and answers
each block with one bit per cell: estimated repeated or not. Estimates never fall short, so no repeated window is lost.

Pass 2, exact: windows estimated repeated are sent, once for each block, by a 96-bit hash of their words with the least
doc_id of the block. Owners find the least doc_id over all blocks and answer with one bit per window: whether it
starts in an earlier document outside the block. Since each block sends a window once, a window that most documents
share costs one entry for each block, never one for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import BLOCK_BYTES, text_bytes

WINDOW = 13
#: Windows that one owner of a range of hashes gets on average.
SHARD_WINDOWS = 4 << 20
_CELL_BITS = 26
_NO_ID = np.int64(np.iinfo(np.int64).max)


class _Block:
    """Windows of a block of documents, in a fixed order."""

    def __init__(self, ids: pd.Series, texts: pd.Series, window: int, shards: int):
        null = ids.isna()
        rank = pd.DataFrame({"i": ids.where(~null, 0).astype("int64"), "n": null, "t": texts.fillna("")})
        order = rank.sort_values(["n", "i", "t"], kind="stable").index.to_numpy()
        self.null = rank["n"].to_numpy()[order]
        self.ids = np.where(self.null, _NO_ID, rank["i"].to_numpy()[order])
        self.words = [t.encode("utf-8", "surrogatepass").split() for t in rank["t"].to_numpy()[order]]
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.first[-1])
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.zeros(0, np.int64)
        if n >= window:
            starts = np.flatnonzero(doc_of[: n - window + 1] == doc_of[window - 1 :])
        self.starts, self.doc = starts, doc_of[starts]
        digests: dict[bytes, bytes] = {}
        digest = xxhash.xxh3_128_digest
        flat = b"".join([digests.get(w) or digests.setdefault(w, digest(w)) for w in chain.from_iterable(self.words)])
        pair = np.frombuffer(flat, "<u8").reshape(-1, 2)
        self.h1, self.h2 = (self._roll(np.ascontiguousarray(pair[:, k]), p, window)[starts] if len(starts) else np.zeros(0, np.uint64) for k, p in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)))
        self.h2 = (self.h2 >> np.uint64(32)).astype(np.uint32)
        self.shards = shards
        # the windows by hash, and where each hash is first met (documents are in order, so in its least doc_id)
        self.unique, self.where, self.inverse = np.unique(self.h1, return_index=True, return_inverse=True)
        self.bounds = np.searchsorted(self.shard_of(self.unique), np.arange(shards + 1))

    @staticmethod
    def _roll(a: np.ndarray, p: int, window: int) -> np.ndarray:
        m = len(a) - window + 1
        out = a[:m].copy()
        for j in range(1, window):
            out *= np.uint64(p)
            out += a[j : j + m]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) * np.uint64(self.shards)) >> np.uint64(24)

    def sketches(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each shard the cells of the block's distinct windows, one twice if the window is in several documents."""
        many = np.zeros(len(self.unique), bool)
        many[self.inverse[self.doc != self.doc[self.where][self.inverse]]] = True
        for k in range(self.shards):
            a, b = self.bounds[k], self.bounds[k + 1]
            if a < b:
                yield k, np.repeat(_cell(self.unique[a:b], k, self.shards), 1 + many[a:b])

    def flagged(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which of self.unique are estimated repeated."""
        out = np.zeros(len(self.unique), bool)
        for k, cells in self.sketches():
            bits = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=len(cells)).astype(bool)
            own = _cell(self.unique[self.bounds[k] : self.bounds[k + 1]], k, self.shards)
            out[self.bounds[k] : self.bounds[k + 1]] = bits[np.searchsorted(cells, own)]
        return out

    def exact(self, flags: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: the places in the block of distinct windows by both hashes, the hashes, the least doc_id."""
        take = np.flatnonzero(flags[self.inverse])
        order = take[np.lexsort((take, self.h2[take], self.h1[take]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.h1[order[1:]] != self.h1[order[:-1]]) | (self.h2[order[1:]] != self.h2[order[:-1]])
        group = np.cumsum(new) - 1
        heads = np.sort(order[new])  # by document, which makes the ids runs
        rank = np.empty(len(self.h1), np.int64)
        rank[heads] = np.arange(len(heads))
        self.taken, self.head_of = order, rank[order[new]][group] if len(order) else order
        self.heads = heads
        shard = self.shard_of(self.h1[heads])
        for k in range(self.shards):
            at = np.flatnonzero(shard == k)
            if len(at):
                yield k, at, self.h1[heads[at]], self.h2[heads[at]], self.ids[self.doc[heads[at]]]


def _cell(h: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Cells in hash order: sorted, since the cell is the place of the hash within the shard's range."""
    low = -(-(shard << 24) // shards) << 40
    wide = -(-(1 << 64) // shards)
    return ((h - np.uint64(low & (2**64 - 1))).astype(np.float64) * ((1 << _CELL_BITS) / (wide * 1.0000001))).clip(0, (1 << _CELL_BITS) - 1).astype(np.int64)


def _pack(cells: np.ndarray) -> bytes:
    """Gaps of sorted cells, by byte plane, so that high bytes compress away."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _runs(ids: np.ndarray) -> bytes:
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return np.stack((ids[new], np.diff(np.append(new, len(ids))))).astype("<i8").tobytes()


def _unruns(raw: bytes) -> np.ndarray:
    ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
    return np.repeat(ids, n)


def _estimate(rows: pd.DataFrame) -> pd.DataFrame:
    seen, twice = np.zeros(1 << _CELL_BITS, bool), np.zeros(1 << _CELL_BITS, bool)
    lists = [_unpack(x) for x in rows["cells"]]
    for cells in lists:
        twice[cells[1:][cells[1:] == cells[:-1]]] = True
        twice[cells] |= seen[cells]
        seen[cells] = True
    bits = [np.packbits(twice[cells]).tobytes() for cells in lists]
    return pd.DataFrame({"block": rows["block"], "step": 1, "shard": rows["shard"], "bits": bits})


def _earliest(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2, ids = (np.concatenate(x) for x in zip(*((np.frombuffer(r.h1, "<u8"), np.frombuffer(r.h2, "<u4"), _unruns(r.ids)) for r in rows.itertuples()), strict=True))
    order = np.lexsort((ids, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    least = np.empty(len(order), np.int64)
    least[order] = ids[order[new]][np.cumsum(new) - 1]
    later, at, bits = least < ids, 0, []
    for r in rows.itertuples():
        n = len(r.h1) // 8
        bits.append(np.packbits(later[at : at + n]).tobytes())
        at += n
    return pd.DataFrame({"block": rows["block"], "step": 2, "shard": rows["shard"], "bits": bits})


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for each row of ``docs``.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Null texts have no words; texts shorter than a window lose none. A null doc_id comes after every other. Rows that
    share a doc_id are of equal rank and never remove each other's words. Other columns are ignored.
    """
    total = text_bytes(docs)
    blocks = max(1, -(-total // BLOCK_BYTES))
    shards = max(1, -(-total // (SHARD_WINDOWS * 6)))
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.octet_length("text")) if blocks > 1 else F.lit(0)
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.pmod(key, F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    answer = "block int, step int, shard int, bits binary"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(_Block(pdf["doc_id"], pdf["text"], window, shards).sketches())
        return pd.DataFrame({"block": pdf["block"].iloc[0], "shard": [k for k, _ in found], "cells": [_pack(c) for _, c in found]})

    estimates = dealt.groupBy("block").applyInPandas(first, "block int, shard int, cells binary").repartition(shards, "shard").groupBy("shard").applyInPandas(_estimate, answer)

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "shard", "h1", "h2", "ids"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        block = _Block(left["doc_id"], left["text"], window, shards)
        flags = block.flagged(dict(zip(right["shard"], right["bits"], strict=True)))
        rows = [(left["block"].iloc[0], k, h1.tobytes(), h2.tobytes(), _runs(ids)) for k, _, h1, h2, ids in block.exact(flags)]
        return pd.DataFrame(rows, columns=names)

    repeated = dealt.groupBy("block").cogroup(estimates.groupBy("block")).applyInPandas(second, "block int, shard int, h1 binary, h2 binary, ids binary").repartition(shards, "shard").groupBy("shard").applyInPandas(_earliest, answer)

    def third(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = _Block(left["doc_id"], left["text"], window, shards)
        gone = np.zeros(int(block.first[-1]) + 1, np.int64)
        if not right.empty:
            flags = block.flagged(dict(right.loc[right["step"] == 1, ["shard", "bits"]].itertuples(index=False, name=None)))
            answers = dict(right.loc[right["step"] == 2, ["shard", "bits"]].itertuples(index=False, name=None))
            outside = []
            for k, at, *_ in block.exact(flags):
                outside.append((at, np.unpackbits(np.frombuffer(answers[k], np.uint8), count=len(at)).astype(bool)))
            if outside:
                later = np.zeros(len(block.heads), bool)
                for at, bits in outside:
                    later[at] = bits
                own = block.ids[block.doc[block.taken]] > block.ids[block.doc[block.heads]][block.head_of]
                begin = block.starts[block.taken[later[block.head_of] | own]]
                np.add.at(gone, begin, 1)
                np.subtract.at(gone, begin + window, 1)
        drop = np.cumsum(gone) > 0
        rows = []
        for k, words in enumerate(block.words):
            lost = drop[block.first[k] : block.first[k + 1]]
            kept = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if lost.any() else words)
            rows.append((None if block.null[k] else int(block.ids[k]), len(words), int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out if with_text else out.drop(columns="kept_text")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("block").cogroup(estimates.unionByName(repeated).groupBy("block")).applyInPandas(third, schema)

"""Operators that SQL can't express against plain versions that share no code with them."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import decontam, langid, minhash, mixing, pii

SF = "/root/testdata/sf0.001"


def earliest_deadline_first(blocks, weights):
    """Slot by slot: of the released blocks the one with the earliest deadline; a new phase when a source is used up."""
    left, done, out, start = dict(blocks), Counter(), {s: [] for s in blocks}, 0
    while left := {s: n for s, n in left.items() if n}:
        total = sum(Fraction(weights[s]) for s in left)
        w = {s: Fraction(weights[s]) / total for s in left}
        done, t = Counter(), 0
        while all(left.values()):
            ready = [s for s in left if math.floor(done[s] / w[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) / w[s]), s is not None, s or ""))
            out[s].append(start + t)
            done[s] += 1
            left[s] -= 1
            t += 1
        start += t
    return out


@pytest.mark.parametrize("blocks, weights", [
    ({"a": 40, "b": 25, "c": 7}, {"a": 0.7, "b": 0.2, "c": 0.1}), ({"a": 300, "b": 2}, {"a": 1.0, "b": 0.0004}), ({None: 9, "x": 50, "y": 0}, {None: 2**0.5, "x": 3**0.5, "y": 1.0}),
    ({k: 5 + ord(k) % 7 for k in "abcdefghij"}, {k: ord(k) ** 0.5 for k in "abcdefghij"}), ({"only": 12}, {"only": 3.0}),
])
def test_schedule_is_earliest_deadline_first(blocks, weights):
    assert {s: x for s, x in mixing.plan(blocks, weights).items() if x} == {s: x for s, x in earliest_deadline_first(blocks, weights).items() if x}


@pytest.mark.parametrize("rows", [{"a": 4_000_000, "b": 3_000_000, "c": 2_000_000}, {"a": 900_000, "b": 40_000, "tiny": 3000}])
def test_deviation_from_the_target_stays_below_a_block(rows):
    weights = {s: n**0.5 for s, n in rows.items()} | ({"tiny": 0.0004 * 1200} if "tiny" in rows else {})
    total = sum(weights.values())
    made = mixing.plan({s: -(-n // 16) for s, n in rows.items()}, weights)
    first = min(x[-1] for x in made.values()) + 1  # until the first source is used up
    for s, x in made.items():
        at = np.array(x[: np.searchsorted(x, first)])
        want = at * weights[s] / total
        assert np.abs(np.arange(len(at)) - want).max() < 1 + 1e-6 and np.abs(np.arange(1, len(at) + 1) - want - weights[s] / total).max() < 1 + 1e-6
    with pytest.raises(ValueError):
        mixing.plan({"a": 1, "b": 1}, {"a": 1.0, "b": 0.0})


def test_blocks_grow_beyond_the_bound(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 10)
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rows = [(k if k % 3 else None, f"text {k % 190}") for k in range(400)]
    got = mixing.mix(make(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert {(r.mix_slot, r.mix_row) for r in got} == set(itertools.product(range(10), range(40)))


def plain_words(text):
    return [x for x in (re.sub(r"""^[.,;:!?"'()\[\]{}*_«»“”‘’…-]+|[.,;:!?"'()\[\]{}*_«»“”‘’…-]+$""", "", w) for w in (text or "").lower().split()) if x]


def smith_waterman(a, b):
    best, before = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        now = [0.0]
        for j, y in enumerate(b):
            now.append(max(0.0, before[j] + (1.0 if x == y else -0.5), before[j + 1] - 0.5, now[j] - 0.5))
        best, before = max(best, *now), now
    return best


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 12, 20])
def test_no_copy_above_the_threshold_is_lost(spark, size):
    rng = random.Random(size)
    items = [(k, " ".join(f"i{rng.randrange(60)}" for _ in range(size))) for k in range(6)] + [(9, None), (10, " ... ")]
    rows = []
    for k in range(60):
        words = plain_words(items[k % 6][1])
        for _ in range(rng.randrange(size // 2 + 2)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice([[], ["other"], [f"i{rng.randrange(60)}"]])
        rows.append((k, " ".join([f"i{rng.randrange(90)}" for _ in range(rng.randrange(30))] + [w + rng.choice(["", ",", "!"]) for w in words] + ["pad"] * rng.randrange(5))))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, tests).collect()}
    want = {(i, k): s for i, t in rows for k, x in items if plain_words(x) and (s := smith_waterman(plain_words(x), plain_words(t)) / len(plain_words(x))) >= 0.6 - 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - min(1, want[k])) < 1e-9 for k in want) and want


def test_signatures_are_least_values(make):
    rng = np.random.Generator(np.random.PCG64(20240229))
    mul, add = [int(x) * 2 + 1 for x in rng.integers(1, 2**63, 128, dtype=np.uint64)], [int(x) for x in rng.integers(0, 2**63, 128, dtype=np.uint64)]
    texts = ["one two three four five six seven", "one", "", "a b c d e f g a b c d e"]
    for t in texts:
        w = t.split()
        shingles = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        hashes = [xxhash.xxh3_64_intdigest(s.encode()) for s in shingles]
        low = [min((h * m % 2**64 + a) % 2**64 for h in hashes) for m, a in zip(mul, add, strict=True)]
        assert [(x * 0x9E3779B97F4A7C15 % 2**64) >> 48 for x in low] == minhash.signature(t).tolist()


def test_ranges_of_many_blocks(make, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(40) if k % 9 else None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(30)))) for k in range(120)]
    rows = [*{(i, i): (i, t) for i, t in rows if i is not None}.values(), (None, "x y z")]
    want = sorted((tuple(r) for r in minhash.fingerprints(make(rows)).collect()), key=str)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 300)
    assert sorted((tuple(r) for r in minhash.fingerprints(make(rows)).collect()), key=str) == want
    assert {r.doc_id: r.class_id for r in minhash.fingerprints(make(rows), classes=True).collect()} == {r.doc_id: r.class_id for r in minhash.near_classes(make(rows)).collect()}


WORD = re.compile(r"[^\W\d_]{3,}")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEED = {"value": 2, "class": 3, "kind": 3}


def revealing_terms(texts):
    """Terms by the counts of the module's text: contexts of 60 characters, share of 0.5, half of the information."""
    contexts, near, of, every = defaultdict(set), Counter(), Counter(), Counter()
    total = 0
    for t in texts:
        every.update(w.lower() for w in WORD.findall(t))
        for kind, p in KINDS.items():
            for m in re.finditer(p, t):
                v, left, right = m[0].lower(), t[max(0, m.start() - 60) : m.start()], t[m.end() : m.end() + 60]
                digits = re.sub(r"\D", "", v)
                group = {"email": v.rsplit("@")[-1], "ip": ".".join(v.split(".")[:2]), "phone": digits[:4]}[kind]
                words = [w.lower() for k, w in enumerate(re.split(r"[\W\d_]+", left)) if len(w) > 2 and (k or left[:1] != w[:1])]
                parts = re.split(r"[\W\d_]+", right)
                words += [w.lower() for k, w in enumerate(parts) if len(w) > 2 and k < len(parts) - 1]
                for w in words:
                    total += 1
                    for e in (("value", kind, v), ("class", kind, group), ("kind", kind)):
                        contexts[e, w].add((left, right))
                        near[e, w] += 1
                        of[e] += 1
    out = set()
    for (e, w), where in contexts.items():
        share, own = min(1.0, near[e, w] / every[w]), math.log2(total / of[e])
        if len(where) >= NEED[e[0]] and own > 0 and share >= 0.5 and math.log2(share * total / of[e]) >= 0.5 * own:
            out.add(w)
    return out


def test_revealing_terms_and_what_becomes_of_them(make):
    rng = random.Random(8)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    fill = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, f"{fill(12)} quillon wrote {'hot@corp.org' if k % 2 else 'cold@other.org'} {'wexford' if k % 2 else 'marlow'} {fill(14)}") for k in range(12)]
    rows += [(20 + k, f"{fill(12)} dialled +49 30 555-01{10 + k} at once {fill(12)}") for k in range(6)]
    rows += [(30 + k, f"{fill(10)} server 10.{k // 3}.1.{k} rackmount {fill(12)}") for k in range(9)]
    rows += [(50 + k, f"{fill(15)} wexford {fill(3)} quillon {fill(20)} at once {fill(4)}") for k in range(9)] + [(60, None), (61, "Marlow, wexfordian; MARLOW"), (None, "rackmount")]
    terms = revealing_terms([t or "" for _, t in rows])
    assert {"marlow", "rackmount", "dialled"} <= terms and "once" not in terms
    for r in pii.find(make(rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        want = [f"term:{m.start()}:{m.end()}" for m in WORD.finditer(text) if m[0].lower() in terms]
        assert [x for x in r.spans.split(",") if x.startswith("term")] == want and r.n_terms == len(want)
    out = dict(map(tuple, pii.sanitise(make(rows)).collect()))
    assert out[61] == "<term>, wexfordian; <term>" and out[60] == ""  # three of four come with it: generalised
    assert out[None] == ""  # nine of ten do: removed
    assert all("@" not in t and not any(re.search(rf"\b{w}\b", t) for w in terms) for t in out.values())
    assert any("<email>" in t for t in out.values())


def test_kept_trigrams(make, monkeypatch):
    monkeypatch.setattr(langid, "KEEP", 40)
    rng = random.Random(2)
    alphabet = {"en": "etaoin shr", "de": "enisra tdhu", "zz": "𠀀𠀁é ñx"}
    rows = [(k, "".join(rng.choice(alphabet[lang]) for _ in range(120)), lang) for k in range(30) for lang in alphabet]
    docs = make([], extra=False).sparkSession.createDataFrame(rows + [(99, None, "en"), (98, "zzz", None)], "doc_id long, text string, lang string")
    counts = {lang: Counter() for lang in alphabet}
    for _, t, lang in rows:
        padded = "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
        counts[lang].update(padded[k : k + 3] for k in range(len(padded) - 2) if padded[k + 1] != "\0")
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    kept = langid.kept_grams(docs)
    for lang, c in counts.items():
        want = [n for n, g in sorted(((n, g) for g, n in c.items() if rate[lang][g] >= 0.1 * top[g]), reverse=True)][:40]
        codes = {int(langid.grams(g.replace("\0", " "))[int(g[0] != "\0")]): n for g, n in c.items()}
        assert sorted((codes[int(h)] for h in kept[lang]), reverse=True) == want
    model = langid.Filter(kept)
    right = [model.predict(t)[0] == lang for _, t, lang in rows]
    assert np.mean(right) > 0.95
    assert langid.Filter({"en": langid.grams("the river"), "zz": langid.grams("𠀀𠀁𠀀")}).predict("𠀀𠀁𠀀")[0] == "zz"


def test_more_languages_than_a_word_of_bits():
    letters = [chr(0x4E00 + k) for k in range(150)]
    model = langid.Filter({f"l{k:03}": langid.grams(c * 5) for k, c in enumerate(letters)})
    assert [model.predict(c * 4)[0] for c in letters] == [f"l{k:03}" for k in range(150)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_sample_is_only_what_may_be_learnt(spark):
    from quadrille.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id for r in docs.where(queries.crc_mod4(F.col("doc_id")) == 2).select("doc_id").collect()}
    assert held == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}

"""Operators on texts against brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from quadrille.llm import linededup, minhash, pii, queries, simhash, substring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def simhash_of(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(values, linked):
    """The least doc_id of each row's component; ``values`` are (doc_id, value)."""
    names = sorted({v for _, v in values})
    left, low = set(names), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            todo += near
        least = min((i for i, v in values if v in group and i is not None), default=None)
        low.update(dict.fromkeys(group, least))
    return low


def test_simhash(make, corpus):
    prints = [(i, simhash_of(t)) for i, t in corpus]
    low = smallest_reachable(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter((i, f"{f:016x}", low[f]) for i, f in prints)
    assert counted(simhash.near_duplicates(make(corpus)), "doc_id", "fingerprint", "component_id") == want
    assert any(n > 1 for n in Counter(low.values()).values())


def test_simhash_links_at_three_bits(spark):
    base = 0x0123456789ABCDEF
    flips = [0, 1, 1 << 63, 0b111, 0b1111, (1 << 40) | (1 << 2), (1 << 31) | (1 << 32) | (1 << 33), 1 << 20 | 1 << 50 | 1 << 60 | 1 << 61]
    values = [base ^ f for f in flips]
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    found = {frozenset((r.u % 2**64, r.v % 2**64)) for r in simhash.links(df).collect()}
    assert found == {frozenset((a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}


def test_simhash_crowded_cell():
    import numpy as np

    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64) ^ np.uint64(k << 30) for k in range(8)]))
    edges = simhash._forest(fps)
    pairs = [(int(a), int(b)) for x, y in edges for a, b in zip(x, y, strict=True)]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = smallest_reachable([(k, int(f)) for k, f in enumerate(fps)], lambda a, b: (a ^ b).bit_count() <= 3)
    got = smallest_reachable([(k, int(f)) for k, f in enumerate(fps)], lambda a, b: (a, b) in set(pairs) or (b, a) in set(pairs))
    assert want == got


def test_keep_one(make, corpus):
    kept = simhash.keep_one(make(corpus)).collect()
    components = {r.component_id for r in simhash.near_duplicates(make(corpus)).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(components)


def test_keep_one_tells_rows_apart(make):
    rng = random.Random(8)
    unlike = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (None, unlike[2]), (4, unlike[3]), (4, unlike[4]), (4, unlike[4]), (None, unlike[4]), (9, unlike[3])]
    rows += [(None, unlike[5]), (2, unlike[5]), (None, None), (None, "")]
    got = simhash.keep_one(make(rows)).collect()
    want = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (4, unlike[3]), (4, unlike[4]), (2, unlike[5])]
    assert Counter((r.doc_id, r.text) for r in got if r.text) == Counter(want)
    assert len(got) == len(want) + 1  # one of the texts without words


def kept_lines(rows):
    """Brute force: all pairs of lines."""
    lines = []
    for i, t in set(rows):
        for k, line in enumerate((t or "").split("\n") if t is not None else ()):
            words = re.findall(WORD, line.translate(LOWER))
            if len(words) >= 3:
                lines.append(((i is None, i or 0, k), i, t, " ".join(words), {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))}))
    lines.sort(key=lambda x: x[0])
    gone = set()
    for b, later in enumerate(lines):
        for earlier in lines[:b]:
            o = len(earlier[4] & later[4])
            if earlier[0] < later[0] and (earlier[3] == later[3] or o >= 0.8 * (len(earlier[4] | later[4])) - 1e-9):
                gone.add((later[1], later[2], later[0][2]))
                break
    return Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in rows)


def test_line_dedup(make, corpus):
    shared = "the quick brown fox jumps over the lazy dog while nobody at all is looking at the old grey barn behind the hill by the river"
    near = [(200 + k, f"own line number {k} here\n{shared} {'' if k % 2 else 'end'}\tÉTÉ {'K' if k % 3 else 'k'}") for k in range(12)]
    rows = corpus + near + [(300, f"{shared}\n{shared}"), (301, "A B C\na  b\tc\nab"), (302, "İI A B\r\nii a b")]
    docs = make(rows)
    out = linededup.dedup(docs)
    assert out.columns == docs.columns
    assert counted(out, "doc_id", "text") == kept_lines(rows)
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())


def test_substring_dedup(make, corpus):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = corpus + [(400, f"a b {passage} c"), (401, f"{passage} d"), (402, f"{passage} {passage}"), (403, "x " * 40), (404, "x " * 30), (405, passage.upper())]
    first, cut = {}, {}
    for i, t in rows:
        w = re.findall(WORD, t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    want = Counter()
    for i, t in rows:
        w = re.findall(WORD, t or "")
        drop = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (2**63 - 1 if i is None else i):
                drop.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        want[(i, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())] += 1
    for blocks in (substring.BLOCK_BYTES, 4000):
        cut[blocks], substring.BLOCK_BYTES = substring.BLOCK_BYTES, blocks
        try:
            assert counted(substring.dedup(make(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == want
        finally:
            substring.BLOCK_BYTES = cut[blocks]


def test_edited_lines_that_share_first_tokens(make):
    rng = random.Random(11)
    base = [f"b{k}" for k in range(70)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(70), k % 4):
            words[at] = f"x{k}q{at}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.text for r in linededup.dedup(make(rows)).collect()}
    sets = [{" ".join(w[k : k + 5]) for k in range(66)} for w in (t.split() for _, t in rows)]
    gone = {k for k in range(60) if any(len(sets[k] & s) >= 0.8 * len(sets[k] | s) - 1e-9 for s in sets[:k])}
    assert {i for i, t in got.items() if t == ""} == gone and 0 < len(gone) < 60


def test_lines_meet_only_where_enough_can_follow(spark):
    """Two lines of 20 tokens need 18 in common, so the first one that they share is at place 2 at most."""
    placed = spark.createDataFrame([(t, k, 20, t, 9, k) for k in (1, 2) for t in range(5)], "token long, id long, n int, at int, head long, first int")
    found = spark.createDataFrame([(k, list(range(5)), 4) for k in (1, 2)], "id long, prefix array<int>, last long")
    both = linededup._before(placed.where("id = 2"), placed, found, 0.8).collect()
    assert sorted((r.a, r.b, r.token) for r in both) == [(2, 1, 0), (2, 1, 1), (2, 1, 2)]


def test_lines_without_a_like_are_left_out(spark, make):
    """Of lines of 3 to 120 words, with few or many different ones, all that have a similar one are compared, and no lone ones."""
    rng, texts = random.Random(23), set()
    for k in range(400):
        some = rng.choice([[f"v{j}" for j in range(4000)], [f"v{j}" for j in range(4000)], ["a", "b", "c"], ["x"]])
        words = [rng.choice(some) for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 9, 12, 30, 60, 120]))]
        for _ in range(rng.randint(0, 2)):
            texts.add(" ".join(words))
            words = list(words)
            words[rng.choice([0, -1, rng.randrange(len(words))])] = rng.choice(["a", "x", "other"])
            words += rng.choice([[], words[:1]])
        texts.add(" ".join(words))
    lone = {" ".join(f"{rng.choice('abc')}{k} w{j} the" for j in rng.sample(range(500), 12)) for k in range(100)}
    texts = sorted(texts | lone)
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = [{tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    for threshold in (0.8, 0.5, 1.0):
        like = {k for k, x in enumerate(sets) if any(j != k and len(x & y) >= threshold * len(x | y) - 1e-9 for j, y in enumerate(sets))}
        for common in ([], linededup._common(lines)):
            got = {r.id for r in linededup._candidates(lines, common, threshold).collect()}
            assert like <= got, threshold
            assert not lone & {texts[k] for k in got}, threshold
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert counted(linededup.dedup(make(rows)), "doc_id", "text") == kept_lines(rows)


def test_minhash_fingerprints(make, corpus, monkeypatch):
    rows = [r for r in corpus if r[0] is not None]
    rows = sorted(set(rows), key=lambda r: -r[0])
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    got = {r.doc_id: r for r in minhash.fingerprints(make(rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following = t or "", following or ""
        third = len(t) // 3
        new = t[: len(t) - third] + following[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == minhash._hex(minhash.signature(t)) and r.edited_fingerprint == minhash._hex(minhash.signature(new))
        sets = [set(minhash.shingle_hashes(x).tolist()) for x in (t, new)]
        assert abs(r.near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.25
        assert r.near_next == minhash.likeness(minhash.signature(t), minhash.signature(following))
        for found, other in ((r.jaccard_edited, new), (r.jaccard_next, following)):
            x, y = ({" ".join(z.split()[k : k + 5]) for k in range(max(1, len(z.split()) - 4))} for z in (t, other))
            assert found is None and len(x & y) < 0.6 * len(x | y) or abs(found - len(x & y) / len(x | y)) < 1e-12


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_of(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, text) if ok(m[0])]


PRIVATE = [
    "mail a@b.c_d@e.f and x@y@z.org. also q@w..e@r.t", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 010.0.0.255, 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5",
    "4111111111111111", "call +1 (555) 010-9999 or +12 or +123456789012345678", "é 😀 me@here.org 😀 +49 30 1234567", "1" * 3000, "@" * 50 + "a." * 500, "+1+2+3 4 5 6 7 8 9", None, "",
]


def test_pii(make):
    rows = list(enumerate(PRIVATE)) + [(None, PRIVATE[0]), (0, PRIVATE[0])]
    rows += [(100 + k, f"number {k} of the Wexford account: user{k % 2}@mail.org signed by Quillon {'abc' * k}") for k in range(8)]
    got = pii.find(make(rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = dict(rows)
    for r in got:
        base = base_of(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
        assert r.spans.split(",")[: len(base)] == (base or [""])[: max(len(base), 0)]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]


def test_terms_reveal_everywhere(make):
    fill = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}z" for k in range(300)]
    rows = [(k, f"{fill[k]} Quillon wrote {fill[k + 50]} hot@mail.org") for k in range(9)]
    rows += [(20 + k, f"{fill[k + 100]} wrote {fill[k + 150]} b{k}@mail.org {fill[k + 200]}") for k in range(40)]
    long = " ".join(["wrote"] * 700)
    lone = [(940, "No address, but QUILLON."), (941, f"é😀 {long} Quillon {long} xQuillon quillon"), (None, "Quillon"), (942, "a" * 1995 + " Quillon"), (943, "." * 1999 + "Quillon " + "b" * 5000 + " Quillon")]
    for r in pii.find(make(rows + lone)).collect():
        text = dict(rows + lone)[r.doc_id]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)\bquillon\b", text)]
        assert [x for x in r.spans.split(",") if x.startswith("term")] == want and r.n_terms == len(want), text[:40]
    out = dict(map(tuple, pii.sanitise(make(rows + lone)).collect()))
    assert out[940] != lone[0][1] and "Quillon" not in out[943] and "b5@mail.org" not in out[25]


def test_hot_value_has_terms(spark):
    rows = [("hot@x.org", f"c{k}", "quillon") for k in range(6)] + [("hot@x.org", f"c{k}", "common") for k in range(6)] + [(f"v{k}", "c", "common") for k in range(9)]
    contexts = spark.createDataFrame([("value", *r) for r in rows], "level string, value string, context string, term string")
    docs = spark.createDataFrame([(t,) for _, _, t in rows], "text string")
    got = {(r.value, r.term): r.share for r in pii.revealing(docs, contexts).collect()}
    assert got == {("hot@x.org", "quillon"): 1.0}  # a third and more of all contexts


def test_sanitise(make):
    out = dict(map(tuple, pii.sanitise(make([(1, "write me@here.org now"), (2, None)])).collect()))
    assert out == {1: "write <email> now", 2: ""}


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.keep_one, linededup.dedup, substring.dedup, minhash.fingerprints, pii.find])
def test_empty_table(make, operator):
    assert operator(make([])).count() == 0


def test_near_classes(make, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    sets = {t or "": set(minhash.shingle_hashes(t).tolist()) for _, t in rows}
    low = smallest_reachable([(i, t or "") for i, t in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = minhash.near_classes(make(rows)).collect()
    same = sum(r.class_id == low[dict(rows)[r.doc_id] or ""] for r in got)
    assert len(got) == len(rows) and same >= 0.95 * len(rows)


@pytest.mark.parametrize("crowd", [2, 32])
def test_registered_minhash_query_has_the_classes(spark, make, corpus, tmp_path, monkeypatch, crowd):
    """Also where bands hold more texts than are compared with each other: edited forms of one text, in chains of links."""
    rng = random.Random(17)
    words, rows = [f"c{k}" for k in range(90)], [(i, t) for i, t in corpus if i is not None]
    for k in range(50):
        edited = list(words)
        for at in rng.sample(range(90), rng.randrange(6)):
            edited[at] = f"e{k}"
        rows.append((200 + k, " ".join(edited)))
    monkeypatch.setattr(minhash, "CROWD", crowd)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6(spark, str(tmp_path)).collect()
    sets = {t or "": {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows for w in [(t or "").split()]}
    low = smallest_reachable([(i, t or "") for i, t in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(got) == len(rows) and all(r.class_id == low[dict(rows)[r.doc_id] or ""] for r in got)
    assert len({r.class_id for r in got if r.doc_id >= 200}) > 1

"""Chat formatting, mixing, decontamination, the classifiers and the pipeline."""

import hashlib
import importlib.util
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, decontam, langid, mixing, queries, simhash, toxicity
from test_text_operators import kept_lines, simhash_of, smallest_reachable

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TRICKY = ["\\### Assistant: </turn> ok", "", "\\l\\h\\c\\n\\", "a\nb</turn>\n### user: x", "<#:>\\\\", "", "é😀"]


def test_chat(spark):
    rows = [(c, t, ("user", "assistant", "sys:#\n<")[(c + t) % 3], TRICKY[(c * 5 + t) % len(TRICKY)]) for c in range(4) for t in range(40 * c + 1)]
    rows += [(9, 0, None, None), (9, None, "assistant", "first"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS output", "2 AS n_turns")
    got = {r.conv_id: r for r in chat.format_chats(df, with_output=True).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        r, loss = got[conv], [x[3] for x in own if x[2] == "assistant"]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), sum(map(len, loss)), len(r.output))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
        assert [chat.unescape(r.output[s.start : s.end]) for s in r.loss_spans] == loss
        assert chat.MARKED.parse(r.output) == [x[2:] for x in own]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_templates_that_rewrite_history(spark):
    def last_only(turns):
        return "".join(f"[{r}] {'...' if k < len(turns) - 1 and r == 'user' else t}\n" for k, (r, t) in enumerate(turns))

    assert chat.rewrites([("user", "a"), ("bot", "b"), ("user", "c"), ("bot", "d")], last_only) == [1, 3]
    with pytest.raises(chat.RewritesHistory):
        chat.locate([("user", "a"), ("bot", "b")], last_only)
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df, chat.Template(last_only, str, list)).first().rewritten_at == 1


def test_period_is_pfair():
    for shares in ([500, 300, 200], [1, 999], [333, 333, 334], [1] * 7, [7, 5, 3, 2, 1]):
        total = sum(shares)
        table = mixing.period(shares)
        assert sorted(t for x in table for t in x) == list(range(total))
        for k, slots in zip(shares, table, strict=True):
            done = np.zeros(total + 1)
            done[np.array(slots) + 1] = 1
            assert np.abs(np.cumsum(done) - np.arange(total + 1) * k / total).max() < 1


def test_mix(make, corpus):
    docs = make(corpus).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "b").otherwise("a")).withColumn("mix_slot", F.lit("x"))
    rows = mixing.mix(docs, {"a": 0.5, "b": 0.3, None: 0.2}, block_rows=2, slots=10).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(corpus)
    assert len({(r.mix_slot, r.mix_row) for r in rows}) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.mix_slot, r.mix_row)):
        by.setdefault(r.mix_slot, []).append(r.source)
    assert sorted(by) == list(range(len(by))) and all(len(set(x)) == 1 and len(x) <= 2 for x in by.values())
    left = Counter(r.source for r in rows)
    done = Counter()
    for slot in sorted(by):
        if any(done[s] * 2 >= left[s] for s in left):
            break  # a source is used up
        done[by[slot][0]] += 1
        assert all(abs(done[s] - (slot + 1) * w) < 1 for s, w in {"a": 0.5, "b": 0.3, None: 0.2}.items())
    assert mixing.mix(make([])).count() == 0


def test_mix_follows_unrounded_weights():
    roots = {"a": 10_000_000**0.5, "b": 3_000_000**0.5, "c": 700_000**0.5, None: 20**0.5}
    for weights, slots in ((roots, 100_000), ({"a": 0.9999, "b": 0.0001}, 50_000), ({f"s{k}": 1 + k % 9 for k in range(1500)}, 30_000)):
        total = sum(weights.values())
        blocks = {s: round(slots * w / total) + 50 for s, w in weights.items()}
        done = mixing.plan(blocks, weights)
        assert sorted(t for x in done.values() for t in x) == list(range(sum(blocks.values())))
        end = min(x[-1] for x in done.values())  # until then no source is used up
        assert end > slots / 2
        for s, x in done.items():
            at = np.array([t for t in x if t <= end])
            want, have = at * weights[s] / total, np.arange(len(at))
            assert np.abs(have - want).max() < 1 + 1e-6 and np.abs(have + 1 - want - weights[s] / total).max() < 1 + 1e-6


def contaminated_by_alignment(text, items, threshold=decontam.THRESHOLD):
    words = decontam.normal_words(text)
    known = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = set()
    for i, t in items:
        own = decontam.normal_words(t)
        if own:
            if decontam.align(np.array([known.get(w, -1) for w in own], np.int64), x)[0] / len(own) >= threshold:
                found.add(i)
    return found


def test_alignment():
    a = np.array([1, 2, 3, 4, 5])
    assert decontam.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (5.0, 1, 6)
    assert decontam.align(a, np.array([1, 2, 7, 3, 4, 5]))[0] == 4.5
    assert decontam.align(a, np.array([1, 2, 4, 5]))[0] == 3.5
    assert decontam.align(a, np.array([8, 8]))[0] == 0


def test_decontaminate(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    words = item.split()
    rows = [(1, f"before it {item} after it"), (2, f"x {' '.join(words[:5] + ['other'] + words[6:])} y"), (3, " ".join(words[:5])), (4, "nothing of it"), (5, None), (6, ""), (None, item.upper() + "!")]
    rows += [(7, "pad " * 3000 + item), (1, f"before it {item} after it")]
    tests = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), tests).collect())
    assert got == Counter((i, k) for i, t in rows for k in contaminated_by_alignment(t, [(1, item), (4, item)]))
    assert set(got) == {(i, k) for i in (1, 2, 7, None) for k in (1, 4)}
    assert sorted(r.doc_id for r in decontam.clean(make(rows), tests).collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(make([]), tests).count() == 0 and decontam.contaminated(make(rows), tests.limit(0)).count() == 0


def test_clean_judges_rows_by_their_text(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, item), (None, "clean without an id"), (3, f"x {item}"), (3, "clean of the same id"), (None, None)]
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.text) for r in decontam.clean(make(rows), tests).collect())
    assert got == Counter(rows[k] for k in (1, 3, 4)) and decontam.clean(make(rows), tests).columns == make(rows).columns


def test_decontaminate_spaced_edits(spark, make):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(39)]
    pad = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    rows = []
    for step in (4, 5, 6, 7):  # every step-th word changed, one added after it, or left out; lone copies and many of one kind
        for kind in range(3):
            for first in range(step):
                at = lambda i: i % step == first  # noqa: B023, E731
                copy = [y for i, w in enumerate(words) for y in ([w] if not at(i) else [["other"], [w, "other"], []][kind])]
                rows.append((len(rows), " ".join(pad(20) + copy + pad(20))))
    for share in (0.1, 0.15, 0.2, 0.25, 0.3, 0.4):
        rows += [(len(rows) + k, " ".join(pad(9) + [w if rng.random() > share else "x" for w in words] + pad(900))) for k in range(25)]
    rows += [(len(rows), " ".join(words))] * 2
    items = [(1, " ".join(words)), (2, "a a b a a b a a b a a b"), (3, " ".join(pad(15)))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    for threshold in (0.6, 0.5, 0.8):
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), tests, threshold).collect()}
        want = {(i, k) for i, t in rows for k in contaminated_by_alignment(t, items, threshold)}
        assert got == want and len(want) > 40


def test_filter_reads_back_all_languages():
    rng = np.random.default_rng(3)
    kept = {f"l{k}": rng.integers(0, 2**63, 2000, dtype=np.uint64) for k in range(5)}
    kept["l0"] = np.concatenate([kept["l0"], kept["l1"][:100]])
    f = langid.Filter(kept)
    for bit, lang in enumerate(f.langs):
        assert (f.lookup(kept[lang]) >> np.uint64(bit) & np.uint64(1)).all()  # no false negatives
    assert f.false.max() < 0.01
    assert f.predict(None) == (langid.UNKNOWN, 0.0) == f.predict("123 ... ")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@needs_data
def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in own]) > 0.95


@needs_data
def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    got = [r for r in queries.op10(spark, sf).collect() if r.held_out and r.doc_id in labels]
    y, p = np.array([labels[r.doc_id] for r in got]), np.array([r.score for r in got])
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    hit = (p >= 0.3) & (y == 1)
    print("auc", above, "precision", hit.sum() / max(1, (p >= 0.3).sum()), "recall", hit.sum() / max(1, y.sum()))
    assert above > 0.85


def test_swapped_terms_move_scores_less(spark):
    rng = np.random.default_rng(0)
    filler = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = []
    for k in range(600):
        bad = k % 2
        group = "muslim" if rng.random() < (0.8 if bad else 0.2) else "christian"
        rows.append((k, " ".join([*rng.choice(filler, 6), "vile" if bad else "kind", group]), bad))
    rows += [(None, "vile", 1), (600, None, None), (601, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit(1)).withColumn("_text", F.lit(2))
    labels = docs.select("doc_id", "toxic", "text")
    labels = labels.unionByName(labels.where("doc_id = 1"))  # a label that is there twice counts once
    free, held = (toxicity.train(docs.drop("toxic"), labels, penalty=x) for x in (0.0, 20.0))
    move = lambda m: abs(m.logit("a muslim neighbour") - m.logit("a christian neighbour"))
    assert move(held) < 0.2 * move(free) and held.moved < 0.2 * free.moved and held.swapped == free.swapped == 600
    assert held.score("vile muslim") > 0.5 > held.score("kind muslim")
    assert len(set(filler) & set(held.swaps)) > 30  # neutral terms that were found
    got = toxicity.score(docs, held, "doc_id", "score", "_text").collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(i, round(held.score(t), 9)) for i, t, _ in rows} and got[0]["_text"] == 2
    assert toxicity.score(docs.limit(0), held, "doc_id").count() == 0
    assert toxicity.train(docs, labels.limit(0)).score("x") == pytest.approx(0, abs=1e-5) and toxicity.train(docs, labels.where("toxic = 1")).score(None) > 0.99


@needs_data
@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(queries.crc_mod4(docs["doc_id"]) != 2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if (found := model.predict(r[1]))[0] != "und" and found[1] >= cp.MIN_LANGUAGE]
    rows = list(kept_lines(rows).elements())
    prints = [(i, simhash_of(t)) for i, t in rows]
    low = smallest_reachable(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    rows = [r for r, (_, f) in zip(rows, prints, strict=True) if low[f] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(r for r in rows if not contaminated_by_alignment(r[1], items))
    out = cp.run(spark, SF)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert set(docs.columns) < set(out.columns) and len({(r.mix_slot, r.mix_row) for r in got}) == len(got)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and simhash.MAX_BITS == 3

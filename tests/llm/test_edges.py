"""Column names that operators use inside, and rows of every odd kind, through each operator that keeps its columns."""

import importlib.util
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontam, langid, linededup, minhash, mixing, pii, simhash, substring, toxicity

NAMES = (
    "_d", "_r", "_gone", "_row", "_id", "_hash", "_own_id", "_own_hash", "_s", "_p", "_k", "_i", "_before", "_slots", "_ts", "_tp", "_bs", "_bp",
    "_text", "_text_", "row", "line", "lines", "line_no", "id", "id2", "first", "times", "tokens", "prefix", "n", "near", "key", "lanes", "place",
    "range", "label", "fp", "hash", "block", "shard", "bits", "token", "n_words", "spans", "term", "terms", "base", "ents", "value", "gram", "toxic",
)
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
LONG = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(20_000))
ROWS = [
    (1, "the house of the river\nthe quick brown fox runs over the lazy dog again and again"), (2, "the quick brown fox runs over the lazy dog again and again"),
    (2, "der Fluss und das Haus der Leute\nund noch eine Zeile"), (None, None), (None, "no id at all"), (None, "no id at all"), (4, ""), (5, " \n\t\n "), (6, LONG),
    (7, LONG), (8, f"x {ITEM} y"), (1, "the house of the river\nthe quick brown fox runs over the lazy dog again and again"), (9, "mail me@here.org ퟿ é😀"),
]


def language(docs):
    model = langid.Filter({"en": langid.grams("the house of the river and the quick fox"), "de": langid.grams("der Fluss und das Haus der Leute")})
    return langid.identify(docs, model, *docs.columns)


def scored(docs):
    return toxicity.score(docs, toxicity.Model({"w:fox": 1.0, "4:hous": 0.5}, -1.0), *docs.columns)


def clean(docs):
    return decontam.clean(docs, docs.sparkSession.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string"))


KEEPING = {"dedup": linededup.dedup, "keep_one": simhash.keep_one, "mix": mixing.mix, "clean": clean, "identify": language, "score": scored}
OTHERS = {"near_duplicates": simhash.near_duplicates, "substring": substring.dedup, "fingerprints": minhash.fingerprints, "classes": minhash.near_classes, "find": pii.find, "sanitise": pii.sanitise}


def counted(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", [*KEEPING, *OTHERS])
def test_names_and_odd_rows(make, name):
    operator = (KEEPING | OTHERS)[name]
    plain = make(ROWS, extra=False)
    named = plain.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    want, got = operator(plain), operator(named)
    columns = [c for c in want.columns if c in got.columns]
    assert columns == want.columns
    assert counted(got, columns) == counted(want, columns) and want.count() > 5
    if name in KEEPING:
        assert all(r[c] == f"own {c}" for r in got.collect() for c in NAMES)
        assert got.columns[: len(named.columns)] == named.columns
    assert operator(named.limit(0)).count() == 0


def test_kept_columns_of_the_names_of_results(make):
    docs = make(ROWS, extra=False).withColumns({c: F.lit("own") for c in ("lang_pred", "score", "mix_slot", "mix_row")})
    assert {r.lang_pred for r in language(docs).collect()} == {"en", "de", "und"} and scored(docs).schema["score"].dataType.typeName() == "double"
    mixed = mixing.mix(docs)
    assert mixed.columns.count("mix_slot") == 1 and mixed.schema["mix_slot"].dataType.typeName() == "long"


def test_what_odd_rows_give(make):
    docs = make(ROWS)
    assert {(r.doc_id, r.text): r.lang_pred for r in language(docs).collect()}[(None, None)] == "und"
    assert Counter(r.doc_id for r in clean(docs).collect()) == Counter(i for i, t in ROWS if i != 8)
    assert counted(mixing.mix(docs), ["doc_id", "text"]) == Counter(ROWS)
    assert len({(r.mix_slot, r.mix_row) for r in mixing.mix(docs, block_rows=2).collect()}) == len(ROWS)
    assert {r.score for r in scored(docs).where("text IS NULL OR text = ''").collect()} == {toxicity.Model({}, -1.0).score("")}
    kept = {(r.doc_id, r.text) for r in linededup.dedup(docs).collect()}
    assert (None, None) in kept and (2, "") in kept and (6, LONG) in kept and (7, "") in kept


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir("/root/testdata/sf0.001"), reason="no pipeline or tables")
def test_stages_with_odd_rows(make):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    base = make(ROWS, extra=False).sparkSession.read.parquet(f"{sf}/documents.parquet").limit(60)
    plain = make(ROWS, extra=False).unionByName(base)
    named = plain.withColumns({c: F.lit(f"own {c}") for c in (*NAMES, "lang_pred", "score")})
    for name, stage in cp.STAGES:
        want, got = stage(plain.sparkSession, plain, sf), stage(plain.sparkSession, named, sf)
        assert counted(got, plain.columns) == counted(want, plain.columns), name
        assert got.columns[: len(named.columns)] == named.columns and {r["_hash"] for r in got.collect()} == {"own _hash"}

"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

Base entities are e-mail and IP addresses, card and phone numbers. Around each, the words of a text (CONTEXT characters
to either side) are its terms. What a term can give away is the entity's value, its class (the domain, network, issuer
or area that it belongs to) or its kind. Over the corpus, a term's occurrences next to any of these are held against all
of its occurrences: a term that mostly comes with one of them gives it away, even where the entity itself is blanked.
Such a term (SUPPORT distinct contexts, a share of REVEALS, a part TELLS of the information) is a span of its own
wherever it occurs, in all texts, beside the entity or not.

Texts are searched for entities once; what is found and its surroundings are written, and the rest works on that. The
words of all texts are counted, and looked through for terms, in a scan each; only texts that hold a term are searched
for its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import cut, release

CONTEXT = 60
#: Distinct contexts in which a term must come with what it reveals. That two texts pair a word that is rare with the
#: same value isn't chance; with a class or a kind, of which there are few, it may be.
SUPPORT = {"value": 2, "class": 3, "kind": 3}
#: Least share of a term's occurrences in the corpus that come with what it reveals.
REVEALS = 0.5
#: Least pointwise mutual information of the two, as a part of the latter's own information: it can be reached for
#: values of any frequency, as a term that occurs with the value only tells all of it.
TELLS = 0.5
#: From this share on, a term is removed rather than generalised.
REMOVES = 0.9
#: Rows of terms, or of texts that hold one, that are sent to all tasks; more are joined by a shuffle.
SEND = 50_000
#: Code points of a text that are searched for terms at a time. Terms come from contexts, so none is longer than CONTEXT.
PIECE = 2000

KINDS = ("email", "ip", "card", "phone")
# A match begins where its run of characters does, or where the last match ended (\G), and possessive runs never give back:
# the same matches as the plain patterns, without their quadratic retries.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_TERM = r"[\p{L}\p{M}]{3,}"


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(16, 19), digits).otherwise("0"))
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _matches(text: Column, pattern: str, hint: str = "") -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast("array<string>")) if hint else found


def _places(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<v, s, e>>: the matches ``found`` with their places, from the lengths of what lies between them."""
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))).alias("g"), found.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<v:string,s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["v"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(x["v"].alias("v"), a.alias("s"), b.alias("e")))).alias("out"))

    none = F.array().cast("array<struct<v:string,s:int,e:int>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(none)


def _kept(kind: str) -> Callable[[Column], Column]:
    return lambda x: _passes(kind, x["v"])


def _blanked(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), F.negative(x["e"]).alias("m"), F.lit(f"<{kind}>").alias("w"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with columns email, ip, card, phone: array<struct<v, s, e>> of what passes."""
    out = docs.select("doc_id", "text", *(_matches(F.col("text"), _PATTERN[k], _HINT[k]).alias(f"_{k}") for k in KINDS))
    return out.select("doc_id", "text", *(F.filter(_places(F.col("text"), F.col(f"_{k}"), _PATTERN[k]), _kept(k)).alias(k) for k in KINDS))


def _class(kind: Column, value: Column) -> Column:
    """What an entity belongs to: the domain, the first two parts of an address, the issuer, country and area."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    out = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2))
    return out.when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def _searched(own: DataFrame) -> DataFrame:
    """(doc_id, row, n_<kind>..., base, ents): the entities of each of ``own`` (doc_id, text), in one scan of the texts.

    base lists kind:start:end, ents has the kind, the value and the text to either side of each.
    """

    def around(kind: str) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            a = F.greatest(x["s"] - F.lit(CONTEXT), F.lit(0))
            left, right = F.substring(F.col("text"), a + 1, x["s"] - a), F.substring(F.col("text"), x["e"] + 1, F.lit(CONTEXT))
            return F.struct(F.lit(kind).alias("kind"), F.lower(x["v"]).alias("value"), left.alias("left"), right.alias("right"))

        return one

    found = base_spans(own)
    base, ents = F.concat(*(listed(k, F.col(k)) for k in KINDS)), F.concat(*(F.transform(F.col(k), around(k)) for k in KINDS))
    return found.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), ents.alias("ents"))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _contexts(searched: DataFrame) -> DataFrame:
    """(level, value, context, term): the terms around each entity, for its value, class and kind."""
    one = searched.select(F.explode_outer("ents").alias("x")).where("x IS NOT NULL").select("x.*")
    # a word that the window may have cut is left out
    cut_left, cut_right = rf"(?<![\p{{L}}\p{{M}}])(?<!\A){_TERM}", rf"(?<![\p{{L}}\p{{M}}]){_TERM}(?!\z)(?![\p{{L}}\p{{M}}])"
    terms = F.concat(*(F.regexp_extract_all(F.col(side), F.lit(p), F.lit(0)) for side, p in (("left", cut_left), ("right", cut_right))))
    one = one.select("kind", "value", F.xxhash64("left", "right").alias("context"), F.explode_outer(F.transform(terms, F.lower)).alias("term")).where("term IS NOT NULL")
    levels = {"value": F.col("value"), "class": _class(F.col("kind"), F.col("value")), "kind": F.lit("")}
    entities = F.array(*(F.struct(F.lit(k).alias("level"), F.concat_ws(":", "kind", v).alias("value")) for k, v in levels.items()))
    return one.select(F.explode(entities).alias("e"), "context", "term").select("e.level", "e.value", "context", "term")


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and term for each word that could be a term."""
    runs = docs.select(*keep, F.explode_outer(F.split("text", r"[^\p{L}\p{M}]+")).alias("w")).where("length(w) > 2")
    return runs.select(*keep, F.lower("w").alias("term"))


def _sent(terms: DataFrame) -> DataFrame:
    """``terms``, to be sent to all tasks if there are no more than SEND of them."""
    return F.broadcast(terms) if terms.limit(SEND + 1).count() <= SEND else terms


def _occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, row, s, e, share): all places of ``terms`` (term, share) in ``docs`` (doc_id, row, text).

    A text is cut into pieces that begin one code point early and end late enough for a term; a word belongs to the piece
    in which it begins.
    """
    starts = F.sequence(F.lit(0), F.length("text"), F.lit(PIECE))
    pieces = docs.select("doc_id", "row", "text", F.explode(starts).alias("at"))
    begin = F.greatest(F.col("at") - 1, F.lit(0))
    pieces = pieces.select("doc_id", "row", "at", begin.alias("begin"), F.substring(F.col("text"), begin + 1, F.lit(PIECE + CONTEXT + 2)).alias("piece"))
    words = _places(F.col("piece"), F.regexp_extract_all(F.col("piece"), F.lit(_TERM), F.lit(0)), _TERM)
    words = pieces.select("doc_id", "row", "at", "begin", F.explode(words).alias("x"))
    s = F.col("begin") + F.col("x.s")
    words = words.select("doc_id", "row", "at", F.lower("x.v").alias("term"), s.alias("s"), (F.col("begin") + F.col("x.e")).alias("e"))
    words = words.where((F.col("s") >= F.col("at")) & (F.col("s") < F.col("at") + PIECE))
    return words.join(_sent(terms), "term").select("doc_id", "row", "s", "e", "share")


def _term_spans(own: DataFrame, searched: DataFrame) -> DataFrame:
    """(doc_id, row, s, e, share): the places of all revealing terms, in all of ``own``."""
    contexts = cut(_contexts(searched))
    terms = cut(revealing(own, contexts).groupBy("term").agg(F.max("share").alias("share")))
    release(contexts)
    if terms.isEmpty():
        return own.sparkSession.createDataFrame([], "doc_id long, row long, s int, e int, share double")
    keyed = own.withColumn("row", F.xxhash64("doc_id", "text"))
    holds = cut(_words(keyed, "row").join(_sent(terms), "term", "left_semi").select("row").distinct())
    return _occurrences(keyed.join(_sent(holds), "row", "left_semi"), terms)


def revealing(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(level, value, term, share, bits): terms that give an entity away, with the share of their occurrences that do.

    ``contexts`` has (level, value, context, term); terms are counted in all of column text of ``docs``.
    """
    each = contexts.groupBy("level", "value", "term", "context").agg(F.count("*").alias("n"))
    pairs = each.groupBy("level", "value", "term").agg(F.count("*").alias("support"), F.sum("n").alias("n"))
    enough = F.when(F.col("level") == "value", SUPPORT["value"]).when(F.col("level") == "class", SUPPORT["class"]).otherwise(SUPPORT["kind"])
    pairs = cut(pairs.where(F.col("support") >= enough))
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("level", "value", "term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    counts = _words(docs).join(_sent(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("all"))
    total = contexts.where("level = 'value'").select(F.count("*").alias("total")).scalar()
    values = contexts.groupBy("level", "value").agg(F.count("*").alias("of"))
    scored = pairs.join(counts, "term").join(values, ["level", "value"])
    share = F.least(F.col("n") / F.col("all"), F.lit(1.0))
    own = F.log2(total / F.col("of"))
    scored = scored.select("level", "value", "term", share.alias("share"), F.log2(share * total / F.col("of")).alias("bits"), own.alias("own"))
    # what is all there is has no information to give away
    return scored.where((F.col("own") > 0) & (F.col("share") >= REVEALS) & (F.col("bits") >= TELLS * F.col("own"))).drop("own")


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    spans lists kind:start:end (code points, end exclusive) of email, ip, card and phone, then of revealing terms (kind
    term), each by start. A null text counts as empty. Rows of equal doc_id and text have equal spans. Null ids are
    carried. Other columns are ignored. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    searched = cut(_searched(own))
    terms = _term_spans(own, searched)
    terms = terms.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "terms")
    both = searched.drop("ents").join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    extra = F.coalesce("terms", F.array().cast("array<struct<s:int,e:int>>"))
    return both.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", listed("term", extra)), ",").alias("spans"), F.size(extra).cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities replaced by <kind>, revealing terms generalised to <term> or removed from REMOVES on.

    Of spans that overlap, the one that begins first (then the longer) is replaced. Null texts count as empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base_spans(own).withColumn("row", F.xxhash64("doc_id", "text"))
    terms = _term_spans(own, cut(_searched(own)))
    word = F.when(F.col("share") >= REMOVES, F.lit("")).otherwise(F.lit("<term>"))
    terms = terms.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", F.negative("e").alias("m"), word.alias("w"))).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "terms")
    both = found.join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    base = F.concat(*(F.transform(F.col(k), _blanked(k)) for k in KINDS))
    spans = F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast("array<struct<s:int,m:int,w:string>>"))))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["w"]).alias("t"), F.negative(x["m"]).alias("at"))
        return F.when(x["s"] >= acc["at"], more).otherwise(acc)

    done = both.select("doc_id", "text", spans.alias("spans")).select("doc_id", "text", F.aggregate("spans", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), step).alias("r"))
    return done.select("doc_id", F.concat("r.t", F.substring(F.col("text"), F.col("r.at") + 1, F.length("text"))).alias("text"))

"""Near-duplicate lines: an exact set-similarity join in DataFrame functions only.

A line's tokens are its distinct shingles of SHINGLE words. In whatever order all lines put their tokens, lines with a
Jaccard similarity of 0.8 or more share a token among their first ones (prefix filter), at places that leave enough
tokens to come (positional filter), and are of similar size (length filter). This is used twice. First tokens are ordered
by the hash of their first word, so that only those that may be first ones are made: a line that shares none of them is
like no other line, and that is most lines. The others order theirs rarest first by counts in a table of fixed size, then
by hash. What passes is verified on all tokens. The line that comes later, by doc_id and line number, is removed.

Equal lines become one line before anything else, with partial aggregation, so a line in any number of documents is one
row of all that follows. Lines are split and normalised once, into a table. Lines under a token are first compared
with the token's head, which settles most of a large group; a line that this leaves undecided is compared with the
others under the token that come before it, by their first tokens alone, and only if the token may be the first one that
they share; what these don't exclude is verified. That comparison is quadratic where many unlike lines share a token
among their first ones, and so is what it emits where such lines share nearly enough tokens.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.shared import cut, fresh, marks, release

SHINGLE = 5
THRESHOLD = 0.8
#: Lines of fewer words are too short to call a repeat; they stay.
MIN_WORDS = 3
#: Entries of the table of token counts.
COUNTS = 1 << 16
#: So many frequent words, of one in SAMPLE of the lines that repeat, come last in the order of first words. Like COUNTS,
#: this decides what is compared, not what is found.
COMMON, SAMPLE = 32, 8
#: First tokens that a line has to share with others at least to be looked at; fewer if the threshold is low.
MEETINGS = 3
MOST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDER = ("n", "doc_id", "line_no", "row")


def _lower(line: Column) -> Column:
    """``line`` with A-Z in lower case: as lower() has it, many times faster than translate(), unless other letters change."""
    other = line.rlike(r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}]]")
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).when(other, F.translate(line, _UPPER, _LOWER)).otherwise(F.lower(line))


def _spaced(line: Column) -> Column:
    """``line`` with words parted by single spaces."""
    space = reduce(Column.__or__, (F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")))
    return F.when(space, F.regexp_replace(line, r"[\t\x0b\x0c\r ]+", " ")).otherwise(line)


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line) of each line; line is null if it has fewer than MIN_WORDS words.

    Each step is a projection of its own and the generators are outer ones: else Catalyst would compute a step again for
    each use, or infer filters from them that split each text twice.
    """
    at = docs.select("doc_id", _row_key().alias("row"), F.split("text", "\n").alias("lines"))
    at = at.select("doc_id", "row", F.posexplode_outer("lines").alias("line_no", "line"))
    for step in (_lower, _spaced, F.trim):
        at = at.select("doc_id", "row", "line_no", step(F.col("line")).alias("line"))
    enough = F.substring_index("line", " ", MIN_WORDS - 1) != F.col("line")
    return at.select("doc_id", "row", "line_no", F.when(enough, F.col("line")).alias("line"))


def _ids() -> tuple[Column, Column]:
    """Two hashes of 64 bits: together they stand for the line, the first alone for itself up to chance. Null for no line."""
    line = F.col("line")
    return F.when(line.isNotNull(), F.xxhash64(line)).alias("id"), F.xxhash64(F.lit(1), line).alias("id2")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("line_no"), F.col("row"))


def _distinct(at: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, id2, times, first, line) of the different lines of ``at``, and those of them that the bitmap of ``more`` lets through.

    ``more`` has the ids that occur more than once. Only what may be such a line is shuffled; the second result is a table.
    """
    several = at.where(marks(more, F.col("id"))).groupBy("id", "id2").agg(F.min(F.struct(_order().alias("order"), "line")).alias("x"), F.count("*").alias("times"))
    several = cut(several.select("id", "id2", "times", F.col("x.order").alias("first"), F.col("x.line").alias("line")))
    single = at.where(~marks(more, F.col("id"))).select("id", "id2", F.lit(1).cast("long").alias("times"), _order().alias("first"), "line")
    return single.unionByName(several), several


def _hashed(lines: DataFrame) -> DataFrame:
    """``lines`` with column line replaced by hashes, those of its words, and count, that of its shingles with repeats.

    Words are hashed in a projection of their own: inside another lambda they would be hashed again for each shingle.
    """
    rest = [c for c in lines.columns if c != "line"]
    hashed = lines.select(*rest, F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.withColumn("count", F.greatest(F.size("hashes") - F.lit(SHINGLE - 1), F.lit(1)))


def _common(lines: DataFrame) -> list[int]:
    """Hashes of the COMMON most frequent words of a sample of ``lines``."""
    words = _hashed(lines.where(F.pmod("id", F.lit(SAMPLE)) == 0).select("line")).select(F.explode_outer("hashes").alias("h"))
    most = words.where(F.coalesce(F.col("h"), F.lit(0)) != 0).groupBy("h").count().orderBy(F.desc("count"), "h").limit(COMMON)
    return [r.h for r in most.collect()]


def _seeds(lines: DataFrame, common: list[int], threshold: float, shared: int) -> DataFrame:
    """(token, id): first tokens of each line, ``shared`` - 1 more than the prefix filter takes, and others beside them.

    Their order is that of their first word's hash, words of ``common`` last. Each of the k least different hashes begins
    a token at least, so the k first tokens begin with one of these; k as for all shingles is enough, as there are no more
    tokens. Only what they begin is put together. A line that has no k words besides frequent ones, as where a few words
    repeat, gives all its tokens, once each; ``shared`` times if it has fewer than that, as it can't share so many.

    The generator is an outer one and no condition implies that a column isn't null: else Catalyst would infer filters
    that hash each line again.
    """
    at = _hashed(lines.select("id", "line")).withColumn("starts", F.slice("hashes", 1, F.col("count")))
    others = F.array_except("starts", F.array(*map(F.lit, common)).cast("array<long>"))
    at = at.withColumn("least", F.sort_array(others)).withColumn("k", _first(F.col("count"), threshold) + F.lit(shared - 1))
    at = at.select("id", "hashes", "count", "starts", F.coalesce(F.get("least", F.col("k") - 1), F.lit(MOST)).alias("last"))
    whole = F.col("last") == MOST
    at = at.select("id", "hashes", "starts", "last", F.when(whole, _sets(F.col("count"))).alias("tokens"))
    again = F.when(F.size("tokens") < shared, F.flatten(F.array_repeat("tokens", shared))).otherwise(F.col("tokens"))
    at = at.select("id", "hashes", "last", F.when(whole, again).otherwise(F.col("starts")).alias("starts"))
    at = at.select("id", "hashes", "last", F.posexplode_outer("starts").alias("i", "h"))
    at = at.where(F.when(whole, True).when(F.col("h") > F.col("last"), False).otherwise(~F.col("h").isin(common)))
    token = F.xxhash64("h", *(F.get("hashes", F.col("i") + k) for k in range(1, SHINGLE)))
    return at.select(F.when(whole, F.col("h")).otherwise(token).alias("token"), "id")


def _candidates(lines: DataFrame, common: list[int], threshold: float) -> DataFrame:
    """(id) of all lines that may be similar to another one.

    Similar lines share at least threshold of the tokens of either. With each more first token that both take, they share
    one more among these, as long as they share so many at all: ``shared`` of them, if a line of so many tokens has to share
    all. A line of fewer tokens is let through.
    """
    shared = MEETINGS if threshold >= 1 else max(1, min(MEETINGS, ceil(1 / (1 - threshold) - 1e-6) - 1))
    # most tokens are in one line only; what is left is little
    met = _seeds(lines, common, threshold, shared).withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1")
    return met.groupBy("id").count().where(F.col("count") >= shared).select("id")


def _sets(count: Column) -> Column:
    """Hashes of the distinct ones of ``count`` shingles of hashes; of all of these if they are fewer than a shingle's."""
    zipped = F.arrays_zip(*(F.slice("hashes", 1 + k, count).alias(f"w{k}") for k in range(SHINGLE)))
    return F.array_distinct(F.transform(zipped, lambda x: F.xxhash64(x)))


def _tokens(lines: DataFrame) -> DataFrame:
    """``lines`` with column line replaced by tokens: hashes of the distinct shingles, of all words if they are fewer."""
    rest = [c for c in lines.columns if c != "line"]
    return _hashed(lines).select(*rest, _sets(F.col("count")).alias("tokens"))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(COUNTS - 1).cast("long")).cast("int")


def _needed(x: Column, y: Column, t: float) -> Column:
    """The least overlap of two sets of sizes x and y with Jaccard similarity t, with room for rounding."""
    return F.ceil((x + y) * (t / (1 + t)) - 1e-6)


def _rarity(found: DataFrame) -> Column:
    """The logarithm of the count of each bucket of tokens, to the base of 1.19: one literal, as lambdas take no subquery."""
    tokens = found.select(F.explode("tokens").alias("t"))
    counts = tokens.groupBy(_bucket(F.col("t")).alias("k")).agg(F.count("*").alias("n"))
    classes = ["0"] * COUNTS
    for k, c in counts.select("k", F.least(F.floor(4 * F.log2(1 + F.col("n"))), F.lit(127)).cast("int")).collect():  # COUNTS rows at most
        classes[k] = str(c)
    return F.split(F.lit(",".join(classes)), ",").cast("array<long>")


def _ranked(tokens: Column, rarity: Column) -> Column:
    """Tokens in the order of all lines: the least bits of a hash choose its class, the others go below it."""
    return F.sort_array(F.transform(tokens, lambda t: F.shiftrightunsigned(t, 8).bitwiseOR(F.shiftleft(F.get(rarity, _bucket(t)), 56))))


def _first(n: Column, threshold: float) -> Column:
    """How many first tokens of n are such that one is shared with any line that is similar enough."""
    return (n - F.ceil(n * threshold - 1e-6) + 1).cast("int")


def _placed(ranked: DataFrame) -> DataFrame:
    """(token, id, n, at, first, many, head, head_n, head_at): the first tokens of lines, where several lines have one.

    The head of a token is its line of the earliest place, which isn't removed because of the others.
    """
    posts = ranked.select("id", "n", "first", F.posexplode("ranked").alias("at", "token"))
    by = Window.partitionBy("token")
    posts = posts.withColumn("many", F.count("*").over(by)).withColumn("h", F.min(F.struct("first", "id", "n", "at")).over(by)).where("many > 1")
    return posts.select("token", "id", "n", "at", "first", "many", F.col("h.id").alias("head"), F.col("h.n").alias("head_n"), F.col("h.at").alias("head_at"))


def _passes(a: str, b: str, t: float) -> Column:
    """The length filter, and the positional filter for a token at these places of two lines."""
    x, y, x_at, y_at = (F.col(f"{k}{c}") for c in ("n", "at") for k in (a, b))
    most = F.least(x_at, y_at) + F.least(x - x_at, y - y_at)
    return (F.least(x, y) >= F.greatest(x, y) * t - 1e-6) & (most >= _needed(x, y, t))


def _leading(a: str, b: str, t: float) -> Column:
    """Whether a token at these places of two lines may be the first one that they share, and they similar enough.

    What two lines share then lies at or after its place in both. Similar lines pass at the first token that they share,
    which is among the first ones of both, so that nothing is lost by not meeting at a later one.
    """
    x, y, x_at, y_at = (F.col(f"{k}{c}") for c in ("n", "at") for k in (a, b))
    return (F.least(x, y) >= F.greatest(x, y) * t - 1e-6) & (F.least(x - x_at, y - y_at) >= _needed(x, y, t))


def _possible(a: str, b: str, t: float) -> Column:
    """Whether the first tokens of two lines leave room for enough overlap.

    Where those of one line end no later in the order than those of the other, the ones that aren't among the other's
    first tokens aren't in the other line at all. Tokens that are taken for equal by chance only raise the bound.
    """
    p, q, n, m, i, j = (F.col(f"{k}{c}") for c in ("prefix", "n", "last") for k in (a, b))
    rest = F.when(i <= j, n - F.size(p)).otherwise(m - F.size(q))
    return F.size(F.array_intersect(p, q)) + rest >= _needed(n, m, t)


def _sided(found: DataFrame, *columns: str) -> list[DataFrame]:
    """``found`` as either side of a pair: columns a, a_<column> ... and b, b_<column> ..."""
    return [found.select(F.col("id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns)) for k in "ab"]


def _later(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(id, id2) of the later line of each pair of lines (a, b: id) whose tokens are similar enough.

    Of all lines only those of the pairs are shuffled with their tokens, as far as the bitmap can tell.
    """
    pairs = cut(pairs)
    a, b = _sided(found.where(marks(pairs.select(F.explode(F.array("a", "b")).alias("id")), F.col("id"))), "id2", "first", "tokens")
    both = pairs.join(a, "a").join(b, "b").withColumn("o", F.size(F.array_intersect("a_tokens", "b_tokens")))
    both = both.where(F.col("o") >= threshold * (F.size("a_tokens") + F.size("b_tokens") - F.col("o")) - 1e-9)
    late = F.when(F.col("a_first") < F.col("b_first"), F.struct(F.col("b").alias("id"), F.col("b_id2").alias("id2"))).otherwise(F.struct(F.col("a").alias("id"), F.col("a_id2").alias("id2")))
    later = cut(both.select(late.alias("x")).select("x.id", "x.id2").distinct())
    release(pairs)
    return later


def _before(open_: DataFrame, placed: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a line of ``open_`` (a) and one before it (b) that is in ``placed`` under the same token, but not its head."""
    a, b = _sided(found, "prefix", "last")
    x = open_.select("token", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("first").alias("a_first"), "head").join(a, "a")
    y = placed.select("token", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("first").alias("b_first")).join(b, "b")
    return x.join(y, "token").where((F.col("b_first") < F.col("a_first")) & (F.col("b") != F.col("head")) & _leading("a_", "b_", threshold) & _possible("a_", "b_", threshold))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, gone: array<int>): line numbers to remove, by doc_id and hash of the row's text.

    ``docs`` has doc_id and text. See dedup. The result is a table that ``cut`` made.
    """
    at = cut(_lines(docs).select("doc_id", "row", "line_no", "line", *_ids()))
    here = at.where("id IS NOT NULL")
    more = cut(here.groupBy("id").count().where("count > 1").select("id"))
    lines, several = _distinct(here, more)
    repeated = cut(several.where("times > 1").select("id", "id2", "first", F.lit(False).alias("near")))
    some = cut(_candidates(lines, _common(several), threshold))
    found = lines.where(marks(some, F.col("id"))).join(some.hint("shuffle_hash"), "id", "left_semi")
    found = cut(_tokens(found.select("id", "id2", "first", "line")).withColumn("n", F.size("tokens")))
    release(more, several, some)
    ranked = found.select("id", "first", "n", _ranked(F.col("tokens"), _rarity(found)).alias("ranked"))
    ranked = ranked.withColumn("ranked", F.slice("ranked", 1, _first(F.col("n"), threshold)))
    short = F.transform("ranked", lambda t: F.shiftright(F.shiftleft(t, 32), 32).cast("int"))
    ranked = cut(ranked.select("id", "first", "n", "ranked", F.element_at("ranked", -1).alias("last"), short.alias("prefix")))

    placed = cut(_placed(ranked))
    near = placed.where((F.col("id") != F.col("head")) & _passes("", "head_", threshold))
    pairs = near.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    a, b = _sided(ranked, "n", "prefix", "last")
    pairs = pairs.join(a, "a").join(b, "b").where(_possible("a_", "b_", threshold)).select("a", "b")
    later = _later(pairs, found, threshold)
    # lines that no head settled, against the lines before them under their tokens
    beside = placed.where("id <> head AND many > 2")
    open_ = beside.join(later.select("id").distinct(), "id", "left_anti")
    rest = _before(open_, beside, ranked, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    others = _later(rest, found, threshold)

    late = later.unionByName(others).distinct().join(found.select("id", "id2", "first"), ["id", "id2"]).withColumn("near", F.lit(True))
    decided = cut(repeated.unionByName(late).groupBy("id", "id2").agg(F.min("first").alias("first"), F.max("near").alias("near")))
    release(found, ranked, repeated, placed, later, others)
    again = here.where(marks(decided.select("id"), F.col("id"))).select("doc_id", "row", "line_no", "id", "id2")
    gone = again.join(decided, ["id", "id2"]).where(F.col("near") | (_order() > F.col("first")))
    gone = cut(gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")))
    release(decided, at)
    return gone


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with later lines removed from text that repeat, or are similar to, a line of an earlier document or place.

    A line is compared with every earlier line, removed or not. Lines of fewer than MIN_WORDS words stay, as do all
    rows: a text of which nothing is left is empty, a null text stays null. Case is ignored for A-Z. Null ids come
    last. Rows of equal doc_id and text are one document: they keep and lose the same lines. The columns are those of
    ``docs``, whatever their names, in order; n_chars, if there, is brought up to date. An empty table stays empty.
    """
    from pyspark.sql.types import StringType

    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast(StringType()).alias("text"))
    d, r, g, key = fresh(docs, "_d", "_r", "_gone", "_row")
    gone = removed_lines(own, threshold).select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("gone").alias(g))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text").cast(StringType())))
    touched = marks(gone.select(r), F.col(key))
    joined = keyed.where(touched).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(r)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(g, i)), "\n")
    joined = joined.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns).unionByName(keyed.where(~touched).select(*docs.columns))

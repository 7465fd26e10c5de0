"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import chat, decontam, langid, linededup, minhash, mixing, pii, simhash, simhash_sql, substring, toxicity
from quadrille.llm.shared import crc_mod4


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


CONTROL = "\\### Assistant: </turn> ok"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.format_chats(turns.unionByName(extra)).drop("rewritten_at", "depends_at")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_row")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    kept = linededup.dedup(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_read(spark, sf_dir, "documents"), classes=True)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod4(F.col("doc_id")) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model, "doc_id")
    return out.select("doc_id", (crc_mod4(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(crc_mod4(F.col("doc_id")) != 2)
    out = toxicity.score(docs, toxicity.train(docs, labels), "doc_id")
    held = (crc_mod4(F.col("doc_id")) == 2).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1,
    "op2_simhash": op2,
    "op3_mix": op3,
    "op4_line_dedup": op4,
    "op5_substring_dedup": op5,
    "op6_minhash": op6,
    "op7_pii": op7,
    "op8_decontaminate": op8,
    "op9_language": op9,
    "op10_toxicity": op10,
    "pipeline": pipeline,
}

_ESC = "replace(replace(replace({0}, '\\', '\\\\'), '<', '\\l'), '#', '\\h')"
_OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace(replace({_ESC.format("role")}, ':', '\\c'), chr(10), '\\n') || ': ' || {_ESC.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP3 = """
WITH RECURSIVE
src AS (SELECT coalesce('s' || source, 'n') AS s, count(*) AS n FROM documents GROUP BY 1),
fix AS (SELECT list(s ORDER BY s) AS s, list(CAST((n + 15) // 16 AS BIGINT) ORDER BY s) AS blocks, list(sqrt(n) ORDER BY s) AS w FROM src),
-- slot is that of the last block, which source chosen got; done counts the blocks of a phase, t its slots
step AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS chosen, CAST(0 AS BIGINT) AS t, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS done, blocks AS rest FROM fix WHERE len(blocks) > 0
  UNION ALL
  SELECT slot + 1, c, CASE WHEN done[c] + 1 = rest[c] THEN 0 ELSE t + 1 END,
    CASE WHEN done[c] + 1 = rest[c] THEN list_transform(done, lambda x: CAST(0 AS BIGINT)) ELSE list_transform(done, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END) END,
    CASE WHEN done[c] + 1 = rest[c] THEN list_transform(rest, lambda x, i: x - done[i] - CASE WHEN i = c THEN 1 ELSE 0 END) ELSE rest END
  FROM (
    SELECT *, list_sort(list_transform(
      list_filter(range(1, len(w) + 1), lambda i: rest[i] > 0 AND floor(done[i] * total / w[i]) <= t), lambda i: struct_pack(d := ceil((done[i] + 1) * total / w[i]), i := i)
    ))[1].i AS c
    FROM (SELECT step.*, fix.w, list_sum(list_transform(fix.w, lambda x, i: CASE WHEN rest[i] > 0 THEN x ELSE 0 END)) AS total FROM step, fix WHERE list_max(rest) > 0)
  )
),
made AS (SELECT fix.s[chosen] AS s, slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS block FROM step, fix WHERE slot >= 0),
told AS (SELECT doc_id, source, text, coalesce('s' || source, 'n') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id NULLS FIRST, text NULLS FIRST) - 1 AS i FROM told)
SELECT doc_id, source, slot AS mix_slot, CAST(i % 16 AS BIGINT) AS mix_row FROM numbered JOIN made ON numbered.s = made.s AND numbered.i // 16 = made.block
"""

_OP4 = r"""
WITH src AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
raw AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM src),
lines AS (
  SELECT rid, doc_id, line_no, line,
    list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM raw
),
long_ AS (SELECT *, array_to_string(w, ' ') AS norm FROM lines WHERE len(w) >= 3),
uniq AS (SELECT norm, any_value(w) AS w, min(struct_pack(n := doc_id IS NULL, d := doc_id, l := line_no)) AS first, row_number() OVER () AS id FROM long_ GROUP BY norm),
tok AS (
  SELECT id, first, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [norm] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS t FROM uniq
),
size_ AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
pair AS (
  SELECT a.id AS a, b.id AS b, count(*) AS o FROM tok a JOIN tok b ON a.t = b.t AND a.first < b.first GROUP BY a.id, b.id
),
near AS (SELECT DISTINCT p.b AS id FROM pair p JOIN size_ x ON x.id = p.a JOIN size_ y ON y.id = p.b WHERE p.o >= 0.8 * (x.n + y.n - p.o) - 1e-9),
gone AS (
  SELECT l.rid, l.line_no FROM long_ l JOIN uniq u ON l.norm = u.norm
  WHERE u.id IN (SELECT id FROM near) OR struct_pack(n := l.doc_id IS NULL, d := l.doc_id, l := l.line_no) > u.first
),
kept AS (
  SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text FROM lines l LEFT JOIN gone g ON l.rid = g.rid AND l.line_no = g.line_no
  WHERE g.rid IS NULL GROUP BY l.rid
),
done AS (SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM src s LEFT JOIN kept k ON s.rid = k.rid)
SELECT doc_id, sha256(text) AS kept_sha256, length(text) AS kept_chars FROM done
"""

_OP5 = r"""
WITH src AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
win AS (
  SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS t
  FROM src WHERE len(w) >= 13
),
first AS (SELECT t, min(coalesce(doc_id, 9223372036854775807)) AS d FROM win GROUP BY t),
gone AS (
  SELECT DISTINCT rid, p + k AS p FROM (SELECT win.rid, win.p FROM win JOIN first USING (t) WHERE first.d < coalesce(win.doc_id, 9223372036854775807)), (SELECT unnest(range(13)) AS k)
),
word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM src),
kept AS (
  SELECT word.rid, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.rid = gone.rid AND word.p = gone.p
  WHERE gone.rid IS NULL GROUP BY word.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM src LEFT JOIN kept USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": _OP1, "op2_simhash": simhash_sql.OP2, "op3_mix": _OP3, "op4_line_dedup": _OP4, "op5_substring_dedup": _OP5}

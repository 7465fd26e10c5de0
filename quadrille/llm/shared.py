"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of rows holds on average, where an operator works on blocks.
BLOCK_BYTES = 8 << 20

#: Longs of the bitmap that tells which rows need not be shuffled.
MARKS = 1 << 16
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a plain local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quadrille-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage and is computed once.

    The table outlives lost executors. ``release`` deletes it, or else the end of the driver's process. What was shuffled
    to make it isn't needed any more, so Spark is told to delete that as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` made, once nothing that is still to run reads them."""
    for df in tables:
        _delete(df.sparkSession, df._cut_path)
        _written.remove((df.sparkSession, df._cut_path))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores added as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(rows: DataFrame, size: int) -> Column:
    """An array<long> of ``size`` entries from ``rows`` (k: int, v: long); what isn't there is 0.

    It is a subquery: worked out once for each query that uses it, and no part of what the plan says.
    """
    every = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("k")).join(rows, "k", "left")
    pairs = F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    return every.agg(F.transform(pairs, lambda x: x["v"]).alias("t")).scalar()


def marks(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` may be in the one column of ``keys``, longs: a bitmap of fixed size, without false negatives.

    ``keys`` is read once for each query that uses it, so it should be a table.
    """
    at = F.pmod(keys.columns[0], F.lit(MARKS * 64))
    bits = keys.select(at.alias("b")).distinct().groupBy(F.expr("b div 64").cast("int").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(b, 64) AS int)))").alias("v"))
    place = F.pmod(key, F.lit(MARKS * 64))
    word = F.get(table(bits, MARKS), F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int"))
    return bit.bitwiseAND(F.lit(1).cast("long")) == 1


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text over all rows, from one narrow scan."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; an id of null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long); label is the least node reachable.

    Alternates large-star and small-star rounds, each two shuffles of the edges, until the edges stop changing. The
    number of rounds grows with the logarithm of the longest chain. Each round is cut to the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    now = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u != v).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.select(mark).first()[0]
    while before[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        old, now = now, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where(u != v).distinct())
        release(old)
        after = now.select(mark).first()[0]
        if after == before:
            break
        before = after
    return now.groupBy(u.alias("node")).agg(F.min("v").alias("label")).unionByName(
        now.select(v.alias("node")).distinct().select("node", F.col("node").alias("label"))
    )

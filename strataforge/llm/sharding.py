"""op1: sharding by extendible hashing (native).

A document's key hash is a string of bits. The directory is indexed by its first
bits; a bucket that exceeds the byte limit is split on one more bit, others are
left alone, so every shard is a prefix of its own depth and fits the limit.

The directory is found from sums, not by moving rows: one pass sums the bytes of
fine cells (prefixes of ``fine`` bits, about ``CELLS_PER_SHARD`` for each shard
expected), a roll-up sums every shorter prefix, and a cell's shard is its
shortest prefix that fits. Cells that are still too large are split further,
``STEP`` bits a round, from their own rows only. Keys are hashed, so a hot
source or language spreads evenly.

Defined results: bytes are those of the UTF-8 text, none for null. A null
``doc_id`` hashes as the word ``null``. Rows that agree on their whole hash
(repeated ids, null ids) can't be parted by bits: when such a group exceeds the
limit it gets overflow pages: ``page`` numbers them, and each page fits the
limit; their numbers follow from sizes and texts alone. A single document over the
limit is a page of its own (``oversized``).
An empty table gives no rows. Other columns of the input may be carried with
``keep``; they must not be named like the result's columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Production limit of a shard, in bytes of text.
SHARD_BYTES = 16 << 20
SMALL_SHARD_BYTES = 32 << 10
CELLS_PER_SHARD = 16
STEP = 8
#: Bits of the key hash, the leading 15 hexadecimal digits of an MD5.
KEY_BITS = 60


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", h, (F.lit(KEY_BITS) - bits).cast("int"))


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key_bits, n_bytes): shards at depths low..high by cell of ``high`` bits, and cells over the limit.

    Sums of all prefixes come from a roll-up of the cells, so rows are read once.
    """
    cells = rows.groupBy(_prefix(F.col("key_bits"), high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("key_bits").alias("a"), F.max("key_bits").alias("b"))
    cells = materialize(cells, "shard-cells")
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("cell").alias("cell")).where(F.col("bytes") <= limit)
    # A prefix is a shard if it fits and no shorter one does: the shortest for each of its cells.
    cell_leaf = (
        levels.join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    )
    cell_leaf = materialize(cell_leaf, "shard-directory")
    over = cells.where(F.col("bytes") > limit)
    return cell_leaf, over


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, n_bytes, depth, shard_bits, page and oversized for each row."""
    rows = df.select(
        *dict.fromkeys((key, *keep)),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(F.col(key)).alias("key_bits"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )
    rows = materialize(rows, "shard-rows")  # later passes read a few bytes a row, not the texts
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + int(math.log2(CELLS_PER_SHARD)))
    done, rest = None, rows
    while True:
        leaf, over = _leaves(rest, low, high, limit)
        cell = _prefix(F.col("key_bits"), high)
        found = rest.withColumn("cell", cell).join(leaf, "cell").withColumns({"page": F.lit(0).cast("long"), "oversized": F.lit(False)})
        done = found.drop("cell") if done is None else done.unionByName(found.drop("cell"))
        if over.isEmpty():
            break
        # Cells of one key only can't be split by any bit.
        stuck, split = over.where("a = b").select("cell"), over.where("a <> b").select("cell")
        with_cell = rest.withColumn("cell", cell)
        paged = _pages(with_cell.join(stuck, "cell", "left_semi").drop("cell"), key, limit)
        done = done.unionByName(paged)
        if split.isEmpty():
            break
        rest = materialize(with_cell.join(split, "cell", "left_semi").drop("cell"), "shard-rest")
        low, high = high + 1, min(KEY_BITS, high + STEP)
    bits = F.substring(F.lpad(F.bin("key_bits"), KEY_BITS, "0"), F.lit(1), F.col("depth").cast("int"))
    return done.withColumn("shard_bits", bits).drop("key_bits", "text_hash")


def _pages(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Overflow pages for rows of equal hashes, from texts and sizes alone.

    A page takes documents of one size class (up to limit / 1, / 2, / 4 ...), so a
    page's count bounds its bytes. Rows of a class are numbered in the order of their text's
    hash; the numbers are sums of counts, by the hash's first digits, then by hash, then by
    the task that read the rows, so no task counts a whole group. Rows of equal
    text are told apart by the last only, so pages don't depend on how rows were dealt.
    """
    size = F.greatest(F.col("n_bytes"), F.lit(1))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))))).cast("long")
    rows = rows.withColumns({"per_page": per_page, "digits": F.substring("text_hash", 1, 4), "task": F.spark_partition_id()})
    rows = materialize(rows, "shard-same-key")
    levels = (["key_bits", "per_page", "digits"], ["key_bits", "per_page", "digits", "text_hash"], ["key_bits", "per_page", "digits", "text_hash", "task"])
    before, offsets = Window.unboundedPreceding, []
    for i, by in enumerate(levels):
        # The first level is numbered within a class, each further one within the level above.
        above = by[:2] if i == 0 else levels[i - 1]
        counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
        running = F.sum("n").over(Window.partitionBy(*above).orderBy(by[-1]).rowsBetween(before, -1))
        offsets.append((by, counts.withColumn(f"o{i}", F.coalesce(running, F.lit(0).cast("long"))).drop("n")))
    classes = rows.groupBy("key_bits", "per_page").agg(F.ceil(F.count("*") / F.first("per_page")).cast("long").alias("pages"))
    first = F.sum("pages").over(Window.partitionBy("key_bits").orderBy("per_page").rowsBetween(before, -1))
    classes = classes.withColumn("first", F.coalesce(first, F.lit(0).cast("long"))).drop("pages")
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy(*levels[-1]).orderBy("n_bytes")) - 1)
    for by, o in offsets:
        numbered = numbered.join(o, by)
    at = F.col("i") + F.col("o0") + F.col("o1") + F.col("o2")
    return numbered.join(classes, ["key_bits", "per_page"]).select(
        *[c for c in rows.columns if c not in ("per_page", "digits", "task")],
        F.lit(KEY_BITS).alias("depth"),
        (F.col("first") + F.floor(at / F.col("per_page"))).cast("long").alias("page"),
        (F.col("n_bytes") > limit).alias("oversized"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op1_sharding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit so small that buckets split, and some documents exceed it."""
    return assign_shards(table(spark, sf_dir, "documents"), limit=SMALL_SHARD_BYTES)


def _sql(limit: int) -> str:
    return f"""
    WITH RECURSIVE r AS (
      SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
    b AS (SELECT 0 AS depth, 0::BIGINT AS prefix, sum(n_bytes) AS bytes FROM r
          UNION ALL
          SELECT b.depth + 1, r.h >> (59 - b.depth), sum(r.n_bytes)
          FROM b JOIN r ON r.h >> (60 - b.depth) = b.prefix
          WHERE b.bytes > {limit} AND b.depth < 60 GROUP BY 1, 2)
    SELECT r.doc_id, r.n_bytes, b.depth::INT AS depth, 0::BIGINT AS page, r.n_bytes > {limit} AS oversized,
           substr(lpad(bin(r.h), 60, '0'), 1, b.depth) AS shard_bits
    FROM r JOIN b ON r.h >> (60 - b.depth) = b.prefix AND (b.bytes <= {limit} OR b.depth = 60)"""


SQL = {"op1_sharding": _sql(SHARD_BYTES), "op1_sharding_split": _sql(SMALL_SHARD_BYTES)}
QUERIES = {"op1_sharding": op1_sharding, "op1_sharding_split": op1_sharding_split}

"""op8: chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation several times, each time with more turns.
Every turn gets the rolling hash of all turns up to it; a conversation whose
hash over all its turns is the hash of a longer conversation's proper prefix is
a snapshot of it, and an anti-join drops it. Of equal conversations the one with
the least id stays. What is left is rendered.

The rolling hash is a running sum of hashes of (position, role, text), in two
lanes of 60 bits, so a long conversation can be cut into runs of ``RUN_TURNS``
turn numbers whose sums are added up: no task needs a whole conversation, and
none is collected except in pieces of at most ``RUN_TURNS`` turns.

Defined results: turns are ordered by (turn, role, text); those without a number come
first, by a hash of role and text; null role and text count as empty; repeated rows are turns of their own; rows with a null
``conv_id`` belong to no conversation and are left out; an empty table gives no
rows. A conversation of many turns is rendered in parts, numbered by ``part``,
whose texts join to the whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

RUN_TURNS = 1024
ROLE_OPEN, ROLE_CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def _lane(first: int) -> Column:
    """Sixty bits of a turn's hash, as a number that sums without loss."""
    return F.conv(F.substring("digest", first, 15), 16, 10).cast("decimal(20,0)")


def _spread() -> Column:
    """Deals turns without a number to 4,096 runs."""
    whole = F.md5(F.concat_ws("|", F.md5(F.coalesce("role", F.lit(""))), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(whole, 1, 3), 16, 10).cast("long")


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, run, pos (from 1) and the prefix hash (h1, h2) at every turn."""
    t = turns.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 62)) + _spread()).cast("long").alias("run"),
    )
    run = ["conv_id", "run"]
    within = Window.partitionBy(*run).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy(*run).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    t = t.withColumn("i", F.row_number().over(within)).join(offsets.select(*run, "offset"), run)
    t = t.withColumn("pos", F.col("i") + F.col("offset"))
    # Role and text are hashed apart: no text can look like the end of a role.
    t = t.withColumn("digest", F.md5(F.concat_ws("|", F.col("pos").cast("string"), F.md5("role"), F.md5("text"))))
    t = t.select(*run, "turn", "role", "text", "pos", _lane(1).alias("a"), _lane(16).alias("b"))
    t = materialize(t, "chat-turns")
    sums = t.groupBy(*run).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select(*run, F.coalesce(F.sum("sa").over(before), zero).alias("pa"), F.coalesce(F.sum("sb").over(before), zero).alias("pb"))
    order = Window.partitionBy(*run).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.join(sums, run).select(
        *run, "turn", "role", "text", "pos",
        (F.sum("a").over(order) + F.col("pa")).cast("decimal(38,0)").alias("h1"),
        (F.sum("b").over(order) + F.col("pb")).cast("decimal(38,0)").alias("h2"),
    )


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with hashes, and the conversations (conv_id, n_turns, n_copies) that prefix no longer one."""
    hashed = materialize(turn_hashes(turns), "chat-hashes")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e"))
    ends = ends.select("conv_id", "e.*")
    # Equal conversations become one before any join, so a common one makes no hot key.
    whole = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    last = ends.select("conv_id", F.col("pos").alias("n_turns"))
    proper = hashed.select("conv_id", "pos", "h1", "h2").join(last, "conv_id").where("pos < n_turns").select("pos", "h1", "h2").distinct()
    kept = whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")
    return hashed, kept


def render(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies and text of the conversations kept."""
    line = F.concat(F.lit(ROLE_OPEN), F.col("role"), F.lit(ROLE_CLOSE), F.col("text"), F.lit(END))
    part = F.floor((F.col("pos") - 1) / RUN_TURNS).cast("long")
    lines = hashed.select("conv_id", "pos", part.alias("part"), line.alias("line")).join(kept, "conv_id")
    return lines.groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines")
    ).select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(*maximal(table(spark, sf_dir, "conversations")))


SQL = {
    "op8_chat": rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                         CASE WHEN turn IS NULL THEN substr(md5(md5(coalesce(role, '')) || '|' || md5(coalesce(text, ''))), 1, 3) END, coalesce(role, ''), coalesce(text, '')) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(md5(role) || md5(text) ORDER BY pos) AS turns, len(turns) AS n FROM t GROUP BY conv_id),
    u AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n),
    p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
    kept AS (SELECT u.* FROM u ANTI JOIN p USING (turns))
    SELECT conv_id, (pos - 1) // {RUN_TURNS} AS part, any_value(n)::BIGINT AS n_turns, any_value(n_copies)::BIGINT AS n_copies,
           string_agg('{ROLE_OPEN}' || role || '{ROLE_CLOSE}' || text || '{END}', '' ORDER BY pos) AS text
    FROM t JOIN kept USING (conv_id) GROUP BY conv_id, part"""
}
QUERIES = {"op8_chat": op8_chat}

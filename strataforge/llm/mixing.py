"""op7: mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source holds the documents. The token budget
flows down from the root: siblings share their parent's budget by weight, a node
never gets more than its subtree can give (its tokens times ``max_epochs``), and
what one sibling can't use goes to the others before any of it returns to the
ancestor, where the same rule deals it out among the ancestor's siblings. Each
parent's shares are found in closed form: with siblings sorted by capacity per
weight, those that fill up are a prefix, so running sums give the water level.
All of that runs on one row per leaf.

A leaf that gets a budget takes whole epochs of its documents, then a prefix of
one more epoch in seeded random order: the documents whose running token count
stays within what is left. To find the prefix without sorting a leaf, order
keys are cut into ranges of about ``RANGE_ROWS`` rows; sums of ranges tell the one
where the prefix ends, and only that one is sorted. So a leaf's share is one row,
its epochs and the last order key of its prefix, and a leaf with a third of all
rows costs no more than others. Documents are not shuffled where the optimiser
finds the leaves' rows small enough to send.

Defined results: null domain, language or source is the node ``none``; a null or
empty text has no tokens and is taken with its leaf's prefix like any other;
repeated rows (same id, same text) are taken or left together; an empty table
gives no rows. Other columns are ignored, or carried by ``mixed``. Word counts are
words ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Production parameters: half of the corpus, at most four passes over a leaf.
BUDGET_SHARE = (1, 2)
MAX_EPOCHS = 4
SEED = 20240607
RANGE_ROWS = 4096
#: Weights by level and node name; a node that isn't named weighs ``DEFAULT_WEIGHT``.
DEFAULT_WEIGHT = 10
WEIGHTS = {
    "domain": {"web": 50, "books": 30, "code": 20},
    "lang": {"en": 40, "fr": 20, "de": 20, "es": 20},
    "source": {},
}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The tables have no domain: sources named by a number are dealt to three."""
    n = F.regexp_extract(source, r"([0-9]{1,9})\z", 1)
    n = F.pmod(F.when(n == "", F.lit("0")).otherwise(n).cast("int"), F.lit(3))
    return F.when(source.isNull(), F.lit("none")).when(n == 0, F.lit("web")).when(n == 1, F.lit("books")).otherwise(F.lit("code"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """Where the seed puts a document in its leaf; rows of one id and text share a place."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))


def _weight(level: str, weights: dict) -> Column:
    named = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*named)[F.col(level)], F.lit(DEFAULT_WEIGHT)).cast("long") if named else F.lit(DEFAULT_WEIGHT).cast("long")


def _share(a: str, w: str, total: str) -> str:
    """a * w / total, rounded down, without overflow."""
    return f"CAST((CAST({a} AS DECIMAL(20,0)) * CAST({w} AS DECIMAL(10,0))) DIV CAST({total} AS DECIMAL(20,0)) AS BIGINT)"


def allocate(leaves: DataFrame, budget: int, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with the tokens each is to give, ``alloc``."""
    out = leaves.withColumns({"cap": F.col("tokens") * max_epochs, "alloc": F.lit(int(budget)).cast("long")})
    for depth, level in enumerate(LEVELS):
        parents, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("node_cap"), F.max("alloc").alias("budget"))
        nodes = nodes.withColumn("w", _weight(level, weights))
        # Capacity per weight decides who fills up first.
        order = Window.partitionBy(*(parents or [F.lit(0)])).orderBy((F.col("node_cap") / F.col("w").cast("double")), level)
        nodes = nodes.withColumns({
            "cap_before": F.coalesce(F.sum("node_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
            "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        })
        full = F.expr("CAST(node_cap AS DECIMAL(20,0)) * CAST(w_left AS DECIMAL(14,0)) <= CAST(greatest(budget - cap_before, 0L) AS DECIMAL(20,0)) * CAST(w AS DECIMAL(14,0))")
        nodes = nodes.withColumn("full", full)
        # The level is set at the first sibling that doesn't fill up.
        rest = Window.partitionBy(*(parents or [F.lit(0)]), "full")
        nodes = nodes.withColumns({"spent": F.min("cap_before").over(rest), "w_rest": F.max("w_left").over(rest)})
        nodes = nodes.withColumn("node_alloc", F.when(F.col("full"), F.col("node_cap")).otherwise(F.expr(_share("greatest(budget - spent, 0L)", "w", "w_rest"))))
        out = out.drop("alloc").join(nodes.select(*path, F.col("node_alloc").alias("alloc")), path)
    return out.drop("cap")


def leaf_of() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.coalesce("lang", F.lit("none")), "source": F.coalesce("source", F.lit("none"))}


def prefix_ends(df: DataFrame, budget: int | None, weights: dict, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, leaf, n_tokens, order_key), and of each leaf that gives tokens its epochs and the last order key of its prefix."""
    leaf = [c.alias(k) for k, c in leaf_of().items()]
    rows = df.select("doc_id", *leaf, n_words(F.col("text")).alias("n_tokens"), order_key(seed).alias("order_key"))
    rows = materialize(rows, "mix-rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "mix-leaves")
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = total * BUDGET_SHARE[0] // BUDGET_SHARE[1]
    shares = allocate(leaves, budget, weights, max_epochs).where("alloc > 0").select(
        *LEVELS,
        F.expr("alloc DIV tokens").alias("epochs"),
        F.expr("alloc % tokens").alias("remaining"),
        # Hexadecimal digits of the order key that name a range.
        F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_rows") / RANGE_ROWS))).cast("int").alias("digits"),
    )
    shares = materialize(shares, "mix-shares")
    ranged = rows.join(shares, list(LEVELS)).withColumn("range", F.substring(F.col("order_key"), F.lit(1), F.col("digits")))
    ranges = ranged.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"), F.max("remaining").alias("remaining"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    ranges = ranges.withColumn("upto", F.sum("t").over(upto)).where(F.col("upto") > F.col("remaining"))
    # What is left is less than the leaf has, so some range goes beyond it; the first one has the end.
    edges = ranges.groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(*LEVELS, "e.*")
    edges = materialize(edges, "mix-edges")
    # One row for each order key: repeated rows count together.
    edge = ranged.join(edges, [*LEVELS, "range"]).groupBy(*LEVELS, "order_key").agg(F.sum("n_tokens").alias("t"), F.max("before").alias("before"), F.max("remaining").alias("remaining"))
    running = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("order_key")) + F.col("before")
    last = edge.withColumn("upto", running).where("upto <= remaining").groupBy(*LEVELS).agg(F.max("order_key").alias("last"))
    # Without a key in that range the prefix ends before it.
    out = shares.join(edges, list(LEVELS)).join(last, list(LEVELS), "left").select(*LEVELS, "epochs", F.coalesce("last", "range").alias("last"))
    return rows, materialize(out, "mix-ends")


def _copies() -> Column:
    return F.col("epochs") + (F.col("order_key") <= F.col("last")).cast("long")


def mix(df: DataFrame, budget: int | None = None, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Documents taken, with ``n_copies``: whole epochs, and one more for those in the prefix.

    ``df`` has doc_id, text, lang and source; ``budget`` in words, or a share of all.
    Texts are read once, for their length and key, and not carried along.
    """
    rows, ends = prefix_ends(df, budget, weights, max_epochs, seed)
    return rows.join(ends, list(LEVELS)).withColumn("n_copies", _copies()).where("n_copies > 0").select("doc_id", *LEVELS, "n_tokens", "n_copies", "order_key")


def mixed(df: DataFrame, budget: int | None = None, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` that are taken, each as often as it is, with all their columns."""
    rows, ends = prefix_ends(df, budget, weights, max_epochs, seed)
    discard(rows)
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "epochs", "last")
    own = df.select(F.struct(*df.columns).alias("__row"), *[c.alias(f"__{k}") for k, c in leaf_of().items()], order_key(seed).alias("order_key"))
    taken = own.join(ends, [f"__{c}" for c in LEVELS]).withColumn("n_copies", _copies()).where("n_copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("__row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("order_key")


def _sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
        return f"CASE {level} {cases} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)

    steps, source, budget = [], "leaves", f"(SELECT sum(tokens)::HUGEINT * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]} FROM leaves)"
    for depth, level in enumerate(LEVELS):
        path, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "0"
        up = f"l{depth - 1}" if depth else None
        join = f"JOIN {up} USING ({', '.join(LEVELS[:depth])})" if up else ""
        steps.append(f"""
    n{depth} AS (SELECT {path}, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS cap, {f'any_value({up}.alloc)' if up else budget} AS budget, {weight(level)} AS w
                 FROM {source} {join} GROUP BY {path}),
    o{depth} AS (SELECT *, coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cap_before,
                        (sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS w_left
                 FROM n{depth} WINDOW x AS (PARTITION BY {parents} ORDER BY cap / w::DOUBLE, {level})),
    f{depth} AS (SELECT *, cap * w_left <= greatest(budget - cap_before, 0) * w AS filled FROM o{depth}),
    l{depth} AS (SELECT {path}, CASE WHEN filled THEN cap ELSE greatest(budget - (min(cap_before) OVER y), 0) * w // (max(w_left) OVER y) END AS alloc
                 FROM f{depth} WINDOW y AS (PARTITION BY {parents}, filled))""")
    return rf"""
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'none' WHEN m = 0 THEN 'web' WHEN m = 1 THEN 'books' ELSE 'code' END AS domain,
                      coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
                      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
                      md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS order_key
               FROM (SELECT *, coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), ''), '0')::BIGINT % 3 AS m FROM documents)),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),{','.join(steps)},
    r AS (SELECT d.*, l2.alloc // leaves.tokens AS epochs, l2.alloc % leaves.tokens AS remaining,
                 sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_key) AS running
          FROM d JOIN l2 USING (domain, lang, source) JOIN leaves USING (domain, lang, source) WHERE l2.alloc > 0)
    SELECT doc_id, domain, lang, source, n_tokens, (epochs + (running <= remaining)::INT)::BIGINT AS n_copies
    FROM r WHERE epochs + (running <= remaining)::INT > 0"""


SQL = {"op7_mixing": _sql()}
QUERIES = {"op7_mixing": op7_mixing}

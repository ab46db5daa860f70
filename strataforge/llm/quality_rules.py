"""op4: quality rules, a threshold table compiled into one projection (native).

``RULES`` is data: each row names a ratio of two measured counts and the closed
interval it must fall in. ``apply_rules`` compiles the table and the counts into
one Spark projection without user functions, so a document is scored where it
is read; there is no shuffle.

Defined results: a null or empty text has no words and fails the base rule
(``base_failed``); repeated rows are each scored; a null ``doc_id`` is carried
through; very long texts are scored whole; input columns besides ``doc_id`` and
``text`` are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_clash_free

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of the window that counts as repeated.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# fixed values: frequent function words of the four languages
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he her his in is it not of on or she that the their they this to was were which with you".split(),
    "fr": "au aux avec ce dans de des du elle en et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se son sur un une vous".split(),
    "de": "als am auch auf aus bei das dass dem den der des die ein eine einer er es für hat ich im in ist mit nicht noch oder sich sie sind und von war wie zu zum zur".split(),
    "es": "al como con de del el en es esta este la las lo los más no o para pero por que se sin son su sus un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("repeated_line_chars", "dup_line_chars", "line_chars", None, 0.3),
    Rule("upper_words", "n_upper_words", "n_words", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _repeat_words() -> Column:
    """Words in windows found twice or more, from hashes of the windows.

    Sorted (hash, position) pairs put equal windows side by side, so the work is
    n log n in the document's own array; documents whose windows all differ,
    nearly all of them, stop after one hash set.
    """
    w = WINDOW
    return F.expr(f"""
      CASE WHEN size(words) < {w} THEN 0L ELSE
      element_at(transform(array(transform(words, w -> xxhash64(w))), wh ->
       element_at(transform(array(transform(sequence(1, size(wh) - {w - 1}), i -> xxhash64(slice(wh, i, {w})))), h ->
        CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
        element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
         aggregate(sort_array(transform(filter(s, (e, i) -> e.h = get(s, i - 1).h OR e.h = get(s, i + 1).h), e -> e.i)),
                   struct(0L AS n, {-w} AS last),
                   (a, p) -> struct(a.n + least({w}, p - a.last) AS n, p AS last), a -> a.n)), 1) END), 1)), 1) END""")


def measures(df: DataFrame) -> DataFrame:
    """doc_id and the counts that rules may name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({x for words in STOP_WORDS.values() for x in words})
    has_word = rf"[^\x20\x09-\x0D]"
    base = with_clash_free(df, "doc_id", "text").select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, WS, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda s: s.rlike(has_word)).alias("lines"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("lines", F.lit(0), lambda n, s: n + F.length(s)).cast("long").alias("line_chars"),
        F.aggregate(F.array_distinct("lines"), F.lit(0), lambda n, s: n + F.length(s)).cast("long").alias("distinct_line_chars"),
        F.size(F.filter("lines", lambda s: s.rlike(r"(\.\.\.|…)\s*\z"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,!?:;"))).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
        _repeat_words().alias("n_repeat_words"),
    ).withColumn("dup_line_chars", F.col("line_chars") - F.col("distinct_line_chars"))


def _failed(rule: Rule) -> Column:
    """True where the rule is broken; compared by products, so no division is rounded."""
    bottom = F.col(rule.denominator) if rule.denominator else F.lit(1)
    top, fails = F.col(rule.numerator), F.lit(False)
    if rule.low is not None:
        fails = fails | (top < bottom * F.lit(rule.low))
    if rule.high is not None:
        fails = fails | (top > bottom * F.lit(rule.high))
    return fails & (bottom > 0)


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    m = measures(df)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(_failed(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return m.withColumns({"base_failed": base_failed, "failed_rules": F.array_join(failed, ",")}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def _sql() -> str:
    stop = ", ".join("'" + x + "'" for x in sorted({x for words in STOP_WORDS.values() for x in words}))
    failed = []
    for r in RULES:
        bottom = r.denominator or "1"
        tests = [f"{r.numerator} < {bottom} * {r.low}::DOUBLE"] * (r.low is not None) + [f"{r.numerator} > {bottom} * {r.high}::DOUBLE"] * (r.high is not None)
        failed.append(f"CASE WHEN ({' OR '.join(tests)}) AND {bottom} > 0 THEN '{r.name}' END")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    p AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
          FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
    dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM p) WHERE n > 1),
    hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range({WINDOW}) t(k) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS line_chars,
                 line_chars - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0)::BIGINT AS dup_line_chars,
                 len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*\z')))::BIGINT AS n_ellipsis_lines,
                 len(list_filter(words, lambda x: lower(rtrim(x, '.,!?:;')) IN ({stop})))::BIGINT AS n_stop_words,
                 len(list_filter(words, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words,
                 coalesce(hit.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN hit USING (rid)),
    v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
                 concat_ws(',', {', '.join(failed)}) AS failed_rules FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""


SQL = {"op4_quality_rules": _sql()}
QUERIES = {"op4_quality_rules": op4_quality_rules}

"""op2: secret scan with a random forest for false-positive removal (native).

Candidates are runs of sixteen or more key characters that hold a digit, mix
cases or follow a word such as ``token``. Each gets features of its length,
character transitions (between classes of characters, and pairs of letters usual in
words), dictionary coverage, path and neighbouring words. A
random forest trained on labelled findings decides; its trees are compiled to
CASE expressions, so scoring is one projection where the text is read, without
user functions or a shuffle.

There is no table of labelled findings, so ``labelled_findings`` writes one by
rule, from digests and word lists: the bound on what is learned from is its
``LABELLED`` rows. ``train`` takes any table of that shape instead.

Runs of fewer than ``MIN_CHARS`` characters, and longer ones without any of these
signs, are no candidates; they are words for all that can be told.

Defined results: null and empty texts have no candidates; a null ``doc_id`` is
carried; a null source is an empty path; repeated rows each give their findings;
every candidate of a very long text is scored; a table without candidates gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
MIN_CHARS = 16
LABELLED = 6_000
TREES, DEPTH, SEED = 20, 6, 11
THRESHOLD = 0.5

# fixed values: words that speak for or against a secret nearby
KEY_WORDS = "token|secret|passw|pwd|apikey|api_key|api-key|access|auth|bearer|credential|private|key"
HASH_WORDS = "sha1|sha256|sha-256|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|build"
DUMMY_WORDS = "example|dummy|fake|sample|your|changeme|placeholder|xxxx|redacted|test"
TEST_PATHS = "test|spec|mock|fixture|example|sample|doc"
DICTIONARY = (
    "access account action address admin after agent alert alpha among apple array async author auto back base batch before beta block board body book "
    "build button cache call cancel card case center chain change chat check child city class clean client close cloud code color column command common "
    "config connect content context control copy core count create current custom data date debug default delete demo deploy design detail device digest "
    "direct display document domain door down draft drive edit email empty enable engine entry error event example export factory fast field file filter "
    "final find first flag folder form format frame from front full function game gate get global graph green group handler hash head health hello help "
    "here hidden home host house image import index info input insert instance internal item job join json key label language large last layer layout "
    "legacy level library light limit line link list load local lock log login long loop machine mail main manager map market master match media member "
    "memory menu message meta method model module money month mouse move name native network next node note number object office offset open option order "
    "output owner page panel parent park parse part path pattern phone place plan plugin point policy pool port post power prefix present price print "
    "private process product profile project proxy public query queue quick random range rate read ready record remote remove render report request "
    "reset resource response result return right river road role room root route rule sample save scale scan schema score search second secret section "
    "select send server service session set share shared short show simple size small snapshot source space stack start state static status step stop "
    "storage store stream string style submit success summer support switch system table target task team template test text theme thread ticket time "
    "timer title token tool total trace track train tree trigger type under unit update upload user util value vector version video view wait water web "
    "week width window winter word work world write year your zone"
).split()

#: Where two letters follow each other, and where they do so in some dictionary word.
PAIR = "(?i)(?=[a-z]{2})"
_AFTER = {a: "".join(sorted({w[i + 1] for w in DICTIONARY for i in range(len(w) - 1) if w[i] == a})) for a in "abcdefghijklmnopqrstuvwxyz"}
USUAL_PAIR = f"(?i)(?={'|'.join(f'{a}[{b}]' for a, b in _AFTER.items() if b)})"


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def features() -> dict[str, Column]:
    """By name; of columns candidate, word (it stands in), before1, before2, after1 and path."""
    c, none = F.col("candidate"), F.lit("")
    near = F.lower(F.concat_ws(" ", F.coalesce("before2", none), F.coalesce("before1", none), F.expr("substring_index(word, candidate, 1)")))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    pieces = F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+", -1), lambda p: F.length(p) >= 3)
    known = F.aggregate(F.filter(pieces, lambda p: p.isin(DICTIONARY)), F.lit(0), lambda n, p: n + F.length(p))
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x"))
    usual = F.regexp_count(c, F.lit(USUAL_PAIR)) / F.greatest(F.regexp_count(c, F.lit(PAIR)), F.lit(1))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "length": F.length(c).cast("double"),
        "transitions": (runs / F.length(c)).cast("double"),
        "distinct": (F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(36))).cast("double"),
        "digits": _share("[0-9]").cast("double"),
        "uppers": _share("[A-Z]").cast("double"),
        "usual_pairs": usual.cast("double"),
        "vowel_turns": _share("(?i)[aeiou][bcdfghjklmnpqrstvwxyz]").cast("double"),
        "hex": flag(c.rlike(r"\A[0-9a-fA-F]+\z")),
        "separators": _share(r"[/_\-]").cast("double"),
        "dictionary": (known / F.length(c)).cast("double"),
        "key_near": flag(near.rlike(KEY_WORDS)),
        "assigned": flag(near.rlike(r"[=:]\s*[\"'`]?\s*\z")),
        "hash_near": flag(F.concat_ws(" ", near, F.lower(F.coalesce("after1", none))).rlike(HASH_WORDS)),
        "dummy": flag(F.lower(F.concat_ws(" ", c, F.coalesce("after1", none))).rlike(DUMMY_WORDS)),
        "test_path": flag(F.lower(F.coalesce("path", none)).rlike(TEST_PATHS)),
    }


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, word_at, candidate and what stands around it."""
    words = df.select(
        F.col(key).alias("id"),
        F.col(path).cast("string").alias("path") if path in df.columns else F.lit(None).cast("string").alias("path"),
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"),
    ).where(F.size("words") > 0)
    long_words = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (F.length(x["w"]) >= MIN_CHARS) & x["w"].rlike(CANDIDATE))
    # Text and word arrays end here: what follows are the few words found and those beside them.
    around = words.select("id", "path", F.explode(F.transform(long_words, lambda x: F.struct(
        x["i"].alias("word_at"), x["w"].alias("word"), F.get("words", x["i"] - 2).alias("before2"), F.get("words", x["i"] - 1).alias("before1"), F.get("words", x["i"] + 1).alias("after1")
    ))).alias("x")).select("id", "path", "x.*")
    each = around.withColumn("candidate", F.explode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))))
    near = F.lower(F.concat_ws(" ", F.coalesce("before2", F.lit("")), F.coalesce("before1", F.lit("")), F.expr("substring_index(word, candidate, 1)")))
    worth = F.col("candidate").rlike("[0-9]") | F.col("candidate").rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]") | near.rlike(KEY_WORDS)
    return each.where(worth)


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """candidate, word, before2, before1, after1, path and label, by rule from row numbers."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    hexed = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), F.col("id").cast("string")), 512))), "[+/=]", "x")
    size = (F.lit(20) + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(21))).cast("int")
    two = F.concat(pick(DICTIONARY, 1), F.lit("_"), pick(DICTIONARY, 2), F.lit("_"), pick(DICTIONARY, 3), F.lit("_"), pick(DICTIONARY, 4))
    camel = F.concat(pick(DICTIONARY, 1), F.initcap(pick(DICTIONARY, 2)), F.initcap(pick(DICTIONARY, 3)), F.initcap(pick(DICTIONARY, 4)))
    uuid = F.concat_ws("-", *[F.substring(hexed, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    keyed = pick(["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key"], 6)
    plain = pick(["the", "see", "and", "with", "of", "then", "after", "for"], 7)
    hashed = pick(["commit", "sha1", "md5", "sha256", "checksum", "digest", "revision", "etag"], 8)
    real, fake = F.lit("src/app/settings"), pick(["tests/unit/data", "docs/example", "spec/fixtures", "src/sample"], 9)
    eq, none = pick(["=", ":"], 10), F.lit("")
    kinds = [  # candidate, before2, before1, after1, path, label
        (F.substring(hexed, 1, 40), keyed, eq, plain, real, 1),
        (hexed, keyed, eq, none, F.lit("src3"), 1),
        (F.substring(hexed, 1, 32), keyed, eq, plain, F.lit("src11"), 1),
        (F.substring(mixed, F.lit(1), size), keyed, eq, none, real, 1),
        (F.substring(mixed, F.lit(1), size), plain, F.concat(keyed, eq), plain, real, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), plain, plain, none, real, 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, plain, plain, F.lit("src7"), 1),
        (F.substring(mixed, F.lit(1), size), F.lit("authorization:"), F.lit("bearer"), none, real, 1),
        (F.substring(hexed, 1, 40), plain, hashed, plain, real, 0),
        (hexed, hashed, eq, none, real, 0),
        (uuid, pick(["id", "uuid", "request", "row"], 11), eq, plain, real, 0),
        (two, keyed, eq, plain, real, 0),
        (two, plain, plain, plain, F.lit("src5"), 0),
        (camel, plain, plain, plain, real, 0),
        (camel, keyed, eq, none, real, 0),
        (F.regexp_replace(F.substring(F.conv(F.substring(hexed, 1, 15), 16, 10), 1, 16), r"\A(.{0,15})\z", "$1411111111111111"), plain, plain, plain, F.lit("src2"), 0),
        (F.concat(pick(["your", "example", "dummy", "xxxx"], 12), F.lit("_"), two), keyed, eq, none, real, 0),
        (F.repeat(pick(["x", "0", "ab", "1234"], 13), 10), keyed, eq, none, real, 0),
        (F.substring(hexed, 1, 40), keyed, eq, none, fake, 0),
        (F.substring(mixed, F.lit(1), size), keyed, eq, plain, fake, 0),
        (F.concat(F.lit("2024-01-02-report-"), pick(DICTIONARY, 1), F.lit("-"), F.substring(F.conv(F.substring(hexed, 1, 8), 16, 10), 1, 4)), plain, plain, plain, real, 0),
        (F.concat_ws("/", pick(DICTIONARY, 1), pick(DICTIONARY, 2), pick(DICTIONARY, 3), F.substring(hexed, 1, 4)), plain, plain, plain, real, 0),
    ]
    names = ("candidate", "before2", "before1", "after1", "path", "label")
    as_struct = [F.struct(*[(F.lit(x) if isinstance(x, int) else x).alias(k) for k, x in zip(names, row, strict=True)]) for row in kinds]
    # Four partitions, always: the forest's bins and samples depend on them.
    rows = spark.range(0, n, 1, 4)
    return rows.select(F.element_at(F.array(*as_struct), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int")).alias("x")).select("x.*").withColumn("word", F.concat(F.lit('"'), "candidate", F.lit('"'))).where(F.length("candidate") >= MIN_CHARS)


def fit(findings: DataFrame):
    """A random forest fitted on labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features()
    rows = VectorAssembler(inputCols=list(made), outputCol="x").transform(findings.select(F.col("label").cast("double").alias("label"), *[f.alias(k) for k, f in made.items()]))
    return RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="sqrt").fit(rows.select("x", "label"))


def train(findings: DataFrame) -> list[Column]:
    """The trees of a forest fitted on labelled findings, as expressions of the features' names."""
    names = list(features())
    return [_compile(t.toDebugString, names) for t in fit(findings).trees]


def _compile(described: str, names: list[str]) -> Column:
    """A tree's description, line by line in depth-first order, as one CASE expression: 1.0 for a secret."""
    lines = [x.strip() for x in described.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.fullmatch(r"Predict: (\S+)", line):
            return f"{float(m[1])}D"
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        at += 1  # the line of the other branch
        return f"CASE WHEN `{names[int(m[1])]}` <= {float(m[2])!r}D THEN {yes} ELSE {node()} END"

    return F.expr(node())


def scan(df: DataFrame, trees: list[Column], key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """key, word_at, candidate, p_secret (the share of trees) and is_secret, for each candidate."""
    found = candidates(df, key, text, path).select("id", "word_at", "candidate", *[f.alias(k) for k, f in features().items()])
    votes = reduce(lambda a, b: a + b, trees) / F.lit(float(len(trees)))
    return found.select(F.col("id").alias(key), F.col("word_at").cast("long").alias("word_at"), "candidate", votes.alias("p_secret")).withColumn("is_secret", F.col("p_secret") > threshold)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))


SQL: dict[str, str] = {}
QUERIES = {"op2_secrets": op2_secrets}

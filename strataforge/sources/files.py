"""Sources of files and the predicates that route them."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: languages by extension, directories never read, test files by language
EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyi": "python", ".go": "go", ".java": "java", ".rs": "rust", ".cs": "csharp",
}
SKIP_DIRS = (
    ".git", "dist", "build", "out", ".cache", ".turbo", "node_modules", ".next", "coverage", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache",
    "vendor", "target", ".gradle", ".idea", ".mvn", "bin", "obj", ".vs", "packages",
)
TEST_FILES = {
    "javascript": r"\.(test|spec)\.[jt]sx?\z|__tests__/",
    "typescript": r"\.(test|spec)\.[jt]sx?\z|__tests__/",
    "python": r"test_[^/]*\.py\z|_test\.py\z|conftest\.py\z",
    "go": r"_test\.go\z",
    "java": r"(Tests?|IT)\.java\z|src/test/",
    "rust": r"tests/|_test\.rs\z",
    "csharp": r"Tests?\.cs\z|\.Tests/",
}
ENV_EXAMPLES = (
    ".env.example", ".env.sample", ".env.template", "env.example", "env.sample", ".env.local.example", ".env.development.example", ".env.production.example",
)


def read_files(spark: SparkSession, root: str, pattern: str | None = None, hidden: bool = True) -> DataFrame:
    """Files under ``root`` as (file_path, content, seq, sha256, language).

    ``pattern`` is a file name glob. Directories named .git and node_modules are left out.
    ``hidden`` adds the files that Spark's readers skip, which lists the whole tree on the driver.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    raw = reader.text(root, wholetext=True, recursiveFileLookup=True)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"\A[a-z0-9]+:(//[^/]*)?(?=/)", "")
    local = F.expr(f"substring(p, locate('{base.lstrip('/')}', p) + {len(base.lstrip('/'))})")
    files = raw.select(path.alias("p"), F.col("value").alias("content")).select(local.alias("file_path"), "content")
    if hidden and pattern is None:
        files = files.unionByName(hidden_files(spark, root))
    return with_file_columns(files.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(F.lit(".git"), F.lit("node_modules")))))


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's readers leave out, those whose name or folder starts with ``.`` or ``_``.

    Their few bytes (``__init__.py``, ``.env.example``) come through the file system's client on the
    driver, in blocks of partitions; only names that F04, S07 or S08 accept are read.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.getFileStatus(base).getPath().toUri().getPath().rstrip("/") + "/"
    rows, found = [], fs.listFiles(base, True)
    while found.hasNext():
        path = found.next().getPath()
        local = path.toUri().getPath()[len(top) :]
        parts = local.split("/")
        name = parts[-1]
        if not any(p.startswith((".", "_")) for p in parts) or {".git", "node_modules"} & set(parts):
            continue
        if name.lower() in ENV_EXAMPLES or name.endswith((*EXTENSIONS, ".prisma")):
            stream = fs.open(path)
            rows.append((local, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(rows, "file_path string, content string")


def with_file_columns(files: DataFrame) -> DataFrame:
    """Add seq, sha256 and language. ``seq`` orders files by path without gathering them."""
    return files.select("file_path", "content", F.xxhash64("file_path").alias("seq"), F.sha2("content", 256).alias("sha256"), language_of(F.col("file_path")).alias("language"))


def language_of(path: Column) -> Column:
    """the language of the last suffix, which must match in case."""
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.regexp_extract(path, r"(\.[^./]*)\z", 1)]


def is_test_file(path: Column, language: Column) -> Column:
    """F05."""
    out = F.lit(False)
    for name, pattern in TEST_FILES.items():
        out = F.when(language == name, path.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def glob_to_regex(glob: str) -> str:
    """``**`` is anything, ``*`` anything within a segment; ``?`` stays a quantifier."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        out.append("[^/]*" if c == "*" else c if c == "?" else re.escape(c) if not (c.isalnum() or c in "/_-") else c)
        i += 1
    return r"\A" + "".join(out) + r"\z"


def passes_globs(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """exclusion wins; no include globs means all."""
    wanted, barred = F.lit(not include), F.lit(False)
    for g in include:
        wanted = wanted | path.rlike(glob_to_regex(g))
    for g in exclude:
        barred = barred | path.rlike(glob_to_regex(g))
    return wanted & ~barred


def should_process(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), skip_tests: bool = False) -> Column:
    """F01 with F03, F05 and F06: a known language, not a declaration file, no barred directory."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    language = language_of(path)
    ok = language.isNotNull() & ~path.endswith(".d.ts")
    ok = ok & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS)))
    ok = ok & ~F.exists(folders, lambda p: p.startswith(".") & (p != ".github"))
    if skip_tests:
        ok = ok & ~is_test_file(path, language)
    return ok & passes_globs(path, include, exclude)


def is_env_example(path: Column) -> Column:
    """S07."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).isin(*ENV_EXAMPLES)


def is_schema_file(path: Column) -> Column:
    """S08."""
    return path.endswith(".prisma")


def parse_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Name-status lines to (file_path, change_type, old_path); other lines are skipped."""
    line = diffs.select(F.posexplode(F.split(F.col(text), "\n", -1)).alias("seq", "line"))
    part = line.select("seq", F.split(F.rtrim("line"), "\t", -1).alias("p")).withColumn("s", F.get("p", F.lit(0)))
    plain, moved = F.col("s").isin("A", "M", "D"), F.col("s").rlike(r"\A[RC][0-9]*\z")
    kind = (
        F.when(F.col("s") == "A", "added").when(F.col("s") == "M", "modified").when(F.col("s") == "D", "deleted")
        .when(F.col("s").startswith("R"), "renamed").otherwise("added")
    )
    enough = (plain & (F.size("p") >= 2)) | (moved & (F.size("p") >= 3))
    renamed = F.col("s").startswith("R")
    rows = part.where(enough).select(
        "seq", F.when(moved, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("file_path"), kind.alias("change_type"),
        F.when(renamed, F.get("p", F.lit(1))).alias("old_path"),
    )
    return rows.where("file_path <> ''")


def git_changes(spark: SparkSession, repository: str, since: str = "HEAD~1", until: str = "HEAD") -> DataFrame:
    """What a repository's revisions changed."""
    out = subprocess.run(["git", "-C", repository, "diff", "--name-status", since, until], capture_output=True, text=True, check=True).stdout
    return parse_diff(spark.createDataFrame([(out,)], "diff string"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two ``files`` tables, by content hash."""
    b, a = before.select("file_path", F.col("sha256").alias("b")), after.select("file_path", F.col("sha256").alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "file_path", "full").select("file_path", kind.alias("change_type"), F.lit(None).cast("string").alias("old_path")).where("change_type IS NOT NULL")


def last_by(df: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Upsert: of rows that share ``keys`` the last by ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

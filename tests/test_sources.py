import pytest
from pyspark.sql import functions as F

from strataforge.sources import settings
from strataforge.sources.files import glob_to_regex, parse_diff, passes_globs, read_files, should_process, snapshot_changes


def test_read_files_takes_hidden_ones_and_skips_tools(spark, tmp_path):
    for name, text in {"src/a.ts": "x", ".env.example": "A=1", "pkg/__init__.py": "y", ".git/c.ts": "n", "node_modules/m.js": "n", "é x.ts": "z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["file_path"]: (r["content"], r["language"]) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": ("x", "typescript"), ".env.example": ("A=1", None), "pkg/__init__.py": ("y", "python"), "é x.ts": ("z", "typescript")}


@pytest.mark.parametrize(("path", "ok"), [
    ("src/a.ts", True), ("a.py", True), ("src/a.d.ts", False), ("src/.x/a.ts", False), (".github/a.ts", True), ("node_modules/a.js", False), ("src/a.TS", False), ("src/a", False), ("src/a.test.ts", False),
    ("x/test_a.py", False), ("a_test.go", False), ("ATests.cs", False), ("src/test/A.java", False), ("tests/a.rs", False),
])
def test_should_process(spark, path, ok):
    assert spark.range(1).select(should_process(F.lit(path), skip_tests=True)).first()[0] is ok


def test_globs(spark):
    rows = spark.createDataFrame([("index.ts",), ("src/index.ts",), ("dist/a.ts",), ("distx/a.ts",)], "p string")
    assert glob_to_regex("**/*") == r"\A.*/[^/]*\z"
    kept = [r[0] for r in rows.where(passes_globs(F.col("p"), ("**/*",), ("dist/**",))).collect()]
    assert kept == ["src/index.ts", "distx/a.ts"]


def test_diff(spark):
    text = "A\ta\nM\tb\nD\tc\nR90\to\tn\nC50\tx\ty\nZ\tq\nM\n\n"
    got = [tuple(r)[1:] for r in parse_diff(spark.createDataFrame([(text,)], "diff string")).orderBy("seq").collect()]
    assert got == [("a", "added", None), ("b", "modified", None), ("c", "deleted", None), ("n", "renamed", "o"), ("y", "added", None)]


def test_snapshot(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, sha256 string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, sha256 string")
    assert {(r[0], r[1]) for r in snapshot_changes(a, b).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    assert settings.load(p) == settings.Settings()
    settings.save(settings.Settings(project_name="x", max_tokens=5), p)
    assert settings.load(p).max_tokens == 5
    settings.save(settings.Settings(max_tokens=0), p)
    with pytest.raises(ValueError, match="max_tokens"):
        settings.load(p)

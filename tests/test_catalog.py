import duckdb
import pytest
from pyspark.sql import functions as F

from strataforge import driver, driver_cases
from strataforge.catalog import Catalog, analyse
from strataforge.operators import ranking, resolve
from strataforge.plans import reports, tools
from strataforge.sources.files import with_file_columns
from strataforge.sources.settings import Settings
from strataforge.streaming import incremental

FILES = {
    "src/api/users.ts": "import { save } from '../db/store';\nexport async function createUser(id: string) {\n  if (!id) return null;\n  await save(id);\n  bus.emit('made', id);\n}\nrouter.get('/users', createUser);\n",
    "src/db/store.ts": "export const save = async (x: any) => {\n  db.query(\"INSERT INTO t (a) VALUES (1)\");\n};\n",
    "src/util/log.ts": "import { save } from '../db/store';\nexport function log(x: string) { throw new Error(x); }\n",
    ".env.example": "# url\nDATABASE_URL=x\n",
    "db/schema.prisma": "model User {\n  id Int @id\n}\n",
}


@pytest.fixture(scope="module")
def catalog(spark):
    return analyse(with_file_columns(spark.createDataFrame(list(FILES.items()), "file_path string, content string")))


def test_whole_analysis(catalog):
    row = tools.stats(catalog).first()
    assert (row["code_units"], row["files"], row["dependencies"], row["env_variables"], row["languages"]) == (3, 3, 2, 1, "typescript=3")
    calls = {(r["callee_name"], r["callee_file_path"]) for r in catalog["function_calls"].where("callee_unit_id IS NOT NULL").collect()}
    assert ("save", "src/db/store.ts") in calls
    assert [r["pattern_value"] for r in catalog["module_patterns"].collect()] == ["GET /users"]
    assert catalog["schema_model_fields"].count() == 1


def test_tools(catalog):
    r = tools.call(catalog, "plan_change_impact", file_path="src/db/store.ts", resolve=True)
    assert {x["file_path"] for x in r.rows.collect()} == {"src/api/users.ts", "src/util/log.ts"}
    assert r.parts["risk"].first()["summary"] == "LOW RISK 2 direct dependents, 2 total affected files."
    assert [x["name"] for x in tools.call(catalog, "trace_call_chain", function_name="createUser").rows.collect()] == ["save"]
    assert [x["caller_name"] for x in tools.call(catalog, "get_function_context", function_name="save").parts["incoming"].collect()] == ["createUser"]
    assert '"has_more": false' in tools.call(catalog, "search_codebase", query="LOG").response()
    with pytest.raises(tools.ToolError, match="Unknown tool: x"):
        tools.call(catalog, "x")
    with pytest.raises(tools.ToolError, match="not found"):
        tools.call(catalog, "trace_call_chain", function_name="zzz")


def test_reports(catalog):
    out = reports.generate(catalog)
    assert out["MODULES"].startswith("# Modules\n## src/")
    assert "- `createUser` - async function(id: string)" in out["MODULES"]
    assert "- DATABASE_URL - url" in out["PATTERNS"]
    assert "imported by 2 files" in out["DEPENDENCIES"]
    assert "- id: Int (PK, required)" in out["SCHEMA"]
    assert "1. `" in out["HOTSPOTS"]
    for name, tokens in reports.budgets().items():
        assert len(out[name]) // 4 <= tokens + 20


def test_packing_goes_on_past_misfits(spark):
    rows = [("abcd" * 4, 4.0, 1), ("abcd" * 9, 3.0, 2), ("abcd" * 3, 2.0, 3), ("abcd" * 2, 1.0, 4)]
    kept, used, omitted = reports.fit(spark.createDataFrame(rows, "content string, score double, seq long"), 10)
    assert (sorted(r["seq"] for r in kept.collect()), used, omitted) == ([1, 3, 4], 9, 1)


def test_incremental_equals_a_full_run(spark, catalog, tmp_path):
    changed = dict(FILES)
    changed["src/util/log.ts"] = "export function log2(x: string) { return save(x); }\n"
    changed["src/new.ts"] = "import { log2 } from './util/log';\nexport function n() { log2('a'); }\n"
    del changed["src/api/users.ts"]
    full = analyse(with_file_columns(spark.createDataFrame(list(changed.items()), "file_path string, content string")))
    changes = spark.createDataFrame([("src/util/log.ts", "modified", None), ("src/new.ts", "added", None), ("src/api/users.ts", "deleted", None)], "file_path string, change_type string, old_path string")
    got = incremental.apply_changes(catalog, changes, full["files"])
    for name in ("code_units", "function_calls", "file_dependencies", "code_unit_patterns", "guard_clauses", "file_clusters", "module_patterns"):
        key = lambda df: sorted(map(str, df.collect()))
        assert key(got[name]) == key(full[name]), name
    back = got.write(str(tmp_path / "c"))
    assert back["code_units"].count() == full["code_units"].count()


def test_sources_come_along(catalog):
    first = tools.call(catalog, "search_codebase", query="CREATE", include_source=True).rows.first()
    assert first["source"] == "\n".join(FILES["src/api/users.ts"].split("\n")[1:6]) and first["language"] == "typescript" and first["signature"] == "(id: string)"
    assert '"reason": "no_matches"' in tools.call(catalog, "search_codebase", query="zzz").response()
    chain = tools.call(catalog, "trace_call_chain", function_name="createUser", include_source=True).rows.first()
    assert chain["source"].startswith("export const save")
    context = tools.call(catalog, "get_function_context", function_name="save", include_source=True)
    assert context.rows.first()["source"].startswith("export const save") and context.parts["incoming"].first()["source"].startswith("export async function createUser")
    impact = tools.call(catalog, "plan_change_impact", function_name="save", resolve=True, include_source=True)
    assert impact.parts["target"].first()["source"].startswith("export const save")
    assert "source" in tools.call(catalog, "get_implementation_context", unit_name="log").rows.columns
    assert "source" not in tools.call(catalog, "get_implementation_context", unit_name="log", include_source=False).rows.columns
    files = Catalog(catalog.spark, {"code_units": catalog["code_units"]})
    assert [r["source"] for r in tools.code_units(files, name="log", include_source=True).rows.collect()] == [None]


def test_a_file_is_validated_from_its_text(spark, catalog):
    text = "export function load() {\n  fetch('/x');\n  q('SELECT a FROM t');\n}\n"
    t = spark.createDataFrame([("t", "Reads", "d", ["DATABASE_READ"], "u", "src/r.ts", 3, ["Reads first", "Then maps"])], "id string, name string, description string, pattern_types array<string>, template_unit_id string, template_file_path string, follower_count long, conventions array<string>")
    c = Catalog(spark, {**catalog.tables, "files": with_file_columns(spark.createDataFrame([("src/new.ts", text)], "file_path string, content string")), "pattern_templates": t})
    parts = tools.validate_file(c, "src/new.ts").parts
    assert [r[0] for r in parts["follows"].collect()] == ["Reads first", "Then maps"]
    assert [r[0] for r in parts["deviations"].collect()] == ["Pattern type 'API_CALL' has no matching template in the codebase"]
    assert [r[0] for r in parts["suggestions"].collect()] == ["Consider creating pattern templates for the unmatched pattern types", "Review the canonical examples: src/r.ts"]
    with pytest.raises(tools.ToolError, match="Failed to read file"):
        tools.validate_file(c, "gone.ts")


def test_catalog_folders(spark, catalog, tmp_path):
    root = str(tmp_path / "c")
    c = Catalog(spark, root=root).migrate().migrate()
    assert all(c[name].count() == 0 for name in ("files", "code_units", "analysis_results"))
    kept = catalog.drop_files(spark.createDataFrame([("src/util/log.ts",)], "file_path string"))
    assert kept["code_units"].count() == 2 and kept["guard_clauses"].count() < catalog["guard_clauses"].count()
    assert tools.project_stats(catalog, Settings(project_name="p")).first()["project_name"] == "p"


def test_sections_without_tokens_always_fit(spark):
    rows = [("ab", 9.0, 1), ("abcd" * 10, 5.0, 2), ("abcd" * 3, 4.0, 3), ("", 1.0, 4), ("abcd" * 11, 0.5, 5)]
    kept, used, omitted = reports.fit(spark.createDataFrame(rows, "content string, score double, seq long"), 10)
    assert (sorted(r["seq"] for r in kept.collect()), used, omitted) == ([1, 2, 4], 10, 2)


def test_a_section_beyond_the_budget_is_left_out(spark):
    rows = spark.createDataFrame([(f"N{i:05d}", None, True, i) for i in range(3000)], "name string, description string, has_default boolean, line_number int")
    c = Catalog(spark, {"env_variables": rows})
    assert reports.patterns(c, 50) == "# Patterns\n\n\n_1 more files available via MCP tools_"
    assert "N02999" in reports.patterns(c, 20_000)


def test_a_stream_keeps_a_catalog(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "catalog")
    schema = "file_path string, version long, content string, deleted boolean"
    batches = (
        [("a.ts", 1, "export function a() { b(); }\n", False), ("b.ts", 1, "export function b() { }\n", False)],
        [("a.ts", 3, "export function a3() { b(); }\n", False), ("a.ts", 2, "export function a2() { }\n", False), ("b.ts", 2, None, True), ("c.ts", 1, "export function c() { }\n", False)],
    )
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.stream_catalog(spark.readStream.schema(schema).format("parquet"), src, root, str(tmp_path / "state")).awaitTermination()
    c = incremental.read_catalog(spark, root)
    assert sorted(r["name"] for r in c["code_units"].collect()) == ["a3", "c"]
    assert len(incremental._versions(spark, root)) == 2


def test_only_touched_parts_are_written(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([(i, 1) for i in range(200)], [(5, 9)], [(5, 10)], [(5, 11)]):
        spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(src)
        incremental.stream_latest(spark.readStream.schema("k long, v long").format("parquet"), src, out, str(tmp_path / "state"), "k", ["v"], parts=8).awaitTermination()
    parts = incremental._parts(spark, out)
    assert len(parts) == 8 and sorted(map(len, parts.values())) == [1] * 7 + [2]
    assert sorted(map(tuple, incremental.read_latest(spark, out).collect())) == sorted((i, 11 if i == 5 else 1) for i in range(200))


def test_stream_keeps_the_latest(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    reader = lambda: spark.readStream.schema("k long, v long").format("parquet")
    for rows in ([(1, 1), (2, 1)], [(1, 5), (3, 2), (1, 4)]):
        spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(src)
        incremental.stream_latest(reader(), src, out, str(tmp_path / "state"), "k", ["v"]).awaitTermination()
    assert sorted(map(tuple, incremental.read_latest(spark, out).collect())) == [(1, 5), (2, 1), (3, 2)]


def test_resolution_precedence(spark):
    units = spark.createDataFrame([("u1", "f", "A", False), ("u2", "f", "B", True), ("u3", "f", "B", False), ("ca", "x", "A", False), ("cb", "y", "B", False), ("cc", "z", "C", False)], "id string, name string, file_path string, is_exported boolean")
    calls = spark.createDataFrame([("1", "ca", "this.q.f", None), ("2", "cb", "f", None), ("3", "cc", "new f", None), ("4", "cc", "none", None), ("5", "cc", "f", "kept")], "id string, caller_unit_id string, callee_name string, callee_unit_id string")
    got = {r["id"]: (r["callee_unit_id"], r["outcome"]) for r in resolve.resolve_calls(calls, units).collect()}
    assert got == {"1": ("u1", "same_file"), "2": ("u2", "exported"), "3": ("u2", "exported"), "4": (None, "no_match"), "5": ("kept", "kept")}


def test_similar_counts_rows(spark):
    units = spark.createDataFrame([("t", "FUNCTION", "a"), ("u", "FUNCTION", "b"), ("v", "CLASS", "c")], "id string, unit_type string, file_path string")
    pats = spark.createDataFrame([("t", "DATABASE_WRITE"), ("t", "EXTERNAL_SERVICE"), ("u", "DATABASE_WRITE"), ("u", "DATABASE_WRITE")], "code_unit_id string, pattern_type string")
    assert [tuple(r) for r in ranking.similar_units(units, pats, units.where("id = 't'")).collect()] == [("u", 4)]


def test_upsert_and_cascade(spark):
    rows = lambda x: spark.createDataFrame(x, "id string, source_file string, target_file string, import_type string, imported_names array<string>, seq long")
    c = Catalog(spark, {"file_dependencies": rows([("1", "a", "b", "NAMED", [], 1)])})
    assert [r["import_type"] for r in c.upsert("file_dependencies", rows([("2", "a", "b", "DEFAULT", [], 2)])).collect()] == ["DEFAULT"]
    empty = Catalog(spark)
    assert empty.drop_units(spark.createDataFrame([("x",)], "id string"))["code_units"].count() == 0
    assert tools.stats(empty).first()["code_units"] == 0


def test_run_history(spark):
    c = Catalog(spark)
    one = spark.createDataFrame([(None, True)], "id long, success boolean")
    full = one.select(*[(F.col(f.name) if f.name in one.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in c["analysis_results"].schema])
    c.tables["analysis_results"] = c.record_run(full)
    c.tables["analysis_results"] = c.record_run(full)
    assert c.latest_run().first()["id"] == 2


def test_search_query_finds_what_its_sql_lists_among_many_hits(spark, tmp_path):
    keys = [5, 199, *range(1990, 2000), *range(19900, 20000)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = driver_cases.q03_search_source(spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        want = con.execute(driver.SQL["q03_search_source"]).fetchall()
    assert len(want) == 11 and sorted(map(tuple, got)) == sorted(want)


def test_dependency_lines_are_taken_by_number(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{i:02}", f"b{j:02}") for i in range(12) for j in range(15)], "source_file string, target_file string")
    monkeypatch.setattr(driver_cases, "catalog", lambda spark, sf_dir: Catalog(spark, {"file_dependencies": driver.empty(spark, "file_dependencies", edges)}))
    text_lines = driver_cases.text_lines
    # Executors send their lines in any order.
    monkeypatch.setattr(driver_cases, "text_lines", lambda spark, text: text_lines(spark, text).orderBy(F.desc("line_number")))
    got = sorted(map(tuple, driver_cases.r07_dependencies(spark, "").collect()))
    assert [n for n, _ in got] == list(range(20))
    assert got[0][1] == "# Dependencies" and got[2][1] == "- b00 (imported by 12 files)"

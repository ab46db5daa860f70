"""Queries over the driver's tables, each with its SQL.

The tables hold no source code, so three recipes make the operators' inputs: a corpus
generated from ``part`` (its expected rows are plain arithmetic, no regular expressions),
relational tables read as catalog tables, and real text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import graph, imports, lines, patterns, ranking, resolve, units
from .plans import reports, tools
from .schemas import TABLES
from .sources import files as sources
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- recipe C: a generated corpus

N = "(SELECT count(*) FROM part)"
C = f"(SELECT p_partkey AS k, (p_partkey * 7 + 3) % {N} AS t FROM part)"
PATH = "concat('src/m', k % 10, '/part', k, '.ts')"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files: one TypeScript file for each part; its import points at part (7 k + 3) mod n."""
    part = t(spark, sf_dir, "part")
    n = part.count()
    p = part.select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 7 + 3) % n).alias("t"))
    text = F.expr(
        r"""array_join(array(
          concat('import { f', t, ' } from ''../m', t % 10, '/part', t, ''';'),
          if(k % 3 = 0, concat('import log', k, ' from ''./log', k, ''';'), ''),
          concat('export ', if(k % 2 = 0, 'async ', ''), 'function f', k, '(a: string, b: number) {'),
          CASE k % 4 WHEN 0 THEN '  if (!a) return null;' WHEN 1 THEN '  if (a > b) return 0;' WHEN 2 THEN concat('  throw new Error', k, '(''x'');') ELSE '  assert(a);' END,
          concat('  ', if(k % 2 = 0, 'await ', ''), 'f', t, '(a);'),
          if(k % 3 = 0, concat('  bus.emit(''evt', k % 5, ''', a);'), concat('  socket.on(''evt', k % 5, ''', a);')),
          concat('  db.query("SELECT a, x.b AS c FROM t', k % 7, '");'),
          concat('  return process.env.KEY_', k % 6, ';'),
          '}',
          concat('router.get(''/p/', k, ''', f', k, ');'),
          concat('export interface I', k, ' {'),
          '  readonly id: string;',
          concat('  tag', k % 3, '?: number;'),
          '}'), '\n')"""
    )
    path = F.expr("concat('src/m', k % 10, '/part', k, '.ts')")
    return sources.with_file_columns(p.select(path.alias("file_path"), text.alias("content")))


def corpus_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = corpus(spark, sf_dir)
    found = units.code_units(files)
    return files, found


def corpus_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = corpus(spark, sf_dir)
    # What nothing asks for isn't computed.
    whole = graph.settle(units.units_with_bodies(files).drop("complexity", "complexity_score"), "units")
    return files, whole.drop("body"), units.bodies_of(whole)


def named(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return rows.join(found.select(F.col("id").alias(key), F.col("name").alias("unit")), key)


@query(f"""SELECT {PATH} AS file_path FROM (SELECT p_partkey AS k FROM part) WHERE k % 6 IN (0, 3)""".replace(PATH, "CASE k % 6 WHEN 0 THEN concat('src/a', k, '.ts') ELSE concat('.github/x/w', k, '.py') END"))
def s_scan_filter(spark, sf_dir):
    path = F.expr("""CASE k % 6 WHEN 0 THEN concat('src/a', k, '.ts') WHEN 1 THEN concat('src/a', k, '.d.ts') WHEN 2 THEN concat('src/.hid/a', k, '.ts')
      WHEN 3 THEN concat('.github/x/w', k, '.py') WHEN 4 THEN concat('src/node_modules/a', k, '.js') ELSE concat('src/a', k, '.test.ts') END""")
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(path.alias("file_path"))
    return p.where(sources.should_process(F.col("file_path"), skip_tests=True))


@query("""SELECT concat('d', k % 5, '/f', k, CASE WHEN k % 2 = 0 THEN '.ts' ELSE '.js' END) AS file_path FROM (SELECT p_partkey AS k FROM part) WHERE k % 5 IN (1, 2) AND k % 2 = 0""")
def s_globs(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(F.expr("concat('d', k % 5, '/f', k, if(k % 2 = 0, '.ts', '.js'))").alias("file_path"))
    return p.where(sources.passes_globs(F.col("file_path"), ("d1/*", "d2/*", "d3/*"), ("**/*.js", "d3/**")))


@query("""SELECT CASE k % 5 WHEN 3 THEN concat('new', k) WHEN 4 THEN concat('copy', k) ELSE concat('f', k) END AS file_path,
  CASE k % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'added' END AS change_type,
  CASE WHEN k % 5 = 3 THEN concat('f', k) END AS old_path FROM (SELECT p_partkey AS k FROM part)""")
def s_diff(spark, sf_dir):
    line = F.expr(r"""CASE k % 5 WHEN 0 THEN concat('A\tf', k) WHEN 1 THEN concat('M\tf', k) WHEN 2 THEN concat('D\tf', k)
      WHEN 3 THEN concat('R100\tf', k, '\tnew', k) ELSE concat('C75\tf', k, '\tcopy', k) END""")
    d = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(F.concat(line, F.lit("\nX\tbad\nM\n")).alias("diff"))
    return sources.parse_diff(d).drop("seq")


@query(f"""SELECT {PATH} AS source_file, concat('src/m', t % 10, '/part', t) AS target_file, 'NAMED' AS import_type, concat('f', t) AS names FROM {C}
  UNION ALL SELECT {PATH}, concat('src/m', k % 10, '/log', k), 'DEFAULT', concat('log', k) FROM {C} WHERE k % 3 = 0""")
def e_imports(spark, sf_dir):
    d = lines.js_imports(corpus(spark, sf_dir))
    return d.select("source_file", "target_file", "import_type", F.array_join("imported_names", ",").alias("names"))


@query("""SELECT concat('p', k) AS source_file, CASE k % 2 WHEN 0 THEN concat('lib/m', k) ELSE concat('pkg.m', k) END AS target_file, 'NAMED' AS import_type
  FROM (SELECT p_partkey AS k FROM part)""")
def e_imports_python(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    text = F.expr(r"if(k % 2 = 0, concat('from .m', k, ' import x\n'), concat('x = 1\nimport pkg.m', k, '\n'))")
    rows = p.select(F.expr("concat('lib/p', k)").alias("file_path"), text.alias("content"), F.lit("python").alias("language"))
    return imports.other_imports(rows).select(F.regexp_replace("source_file", "lib/", "").alias("source_file"), "target_file", "import_type")


@query(f"""SELECT {PATH} AS file_path, concat('f', k) AS name, 'FUNCTION' AS unit_type, 3 AS line_start, 9 AS line_end, '(a: string, b: number)' AS signature, k % 2 = 0 AS is_async, true AS is_exported FROM {C}
  UNION ALL SELECT {PATH}, concat('I', k), 'INTERFACE', 11, 14, NULL, false, true FROM {C}""")
def e_units(spark, sf_dir):
    _, found = corpus_units(spark, sf_dir)
    return found.select("file_path", "name", "unit_type", "line_start", "line_end", "signature", "is_async", "is_exported")


@query(f"""SELECT concat('f', k) AS unit, CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS conditionals, 0 AS loops, 1 AS max_nesting_depth, 0 AS try_catch_blocks, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS async_patterns,
    0 AS callback_depth, 2 AS parameter_count, 7 AS line_count,
    (3 + CASE WHEN k % 4 < 2 THEN 2 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END)::DOUBLE AS score, 'simple' AS level FROM {C}""")
def e_complexity(spark, sf_dir):
    _, found = corpus_units(spark, sf_dir)
    return found.where("unit_type = 'FUNCTION'").select(F.col("name").alias("unit"), "complexity.*", F.col("complexity_score").alias("score"), lines.complexity_level(F.col("complexity_score")).alias("level"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\.[ \\n]'))::INT AS stops, (len(text) - len(replace(text, chr(10), '')) + 1)::INT AS n_lines FROM documents""")
def e_line_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\.[ \n]")).alias("stops"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


@query(f"""SELECT concat('f', k) AS unit, 'DATABASE_READ' AS pattern_type, concat('SELECT FROM t', k % 7) AS pattern_value, 7 AS line_number, 'a,b' AS read FROM {C}
  UNION ALL SELECT concat('f', k), 'ENV_VARIABLE', concat('KEY_', k % 6), 8, NULL FROM {C}""")
def e_patterns(spark, sf_dir):
    _, found, bodies = corpus_bodies(spark, sf_dir)
    rows = named(patterns.unit_patterns(bodies, found), found, "code_unit_id")
    return rows.select("unit", "pattern_type", "pattern_value", "line_number", F.array_join("column_access.read", ",").alias("read"))


@query(f"""SELECT {PATH} AS file_path, 'API_ENDPOINT' AS pattern_type, concat('GET /p/', k) AS pattern_value, 10 AS line_number FROM {C}""")
def e_module_patterns(spark, sf_dir):
    files, found = corpus_units(spark, sf_dir)
    return patterns.module_patterns(files, found).select("file_path", "pattern_type", "pattern_value", "line_number")


@query("""SELECT k AS id, CASE k % 4 WHEN 0 THEN concat('a,b', k) WHEN 1 THEN NULL WHEN 2 THEN 'k' ELSE 'z,w' END AS read, CASE k % 4 WHEN 1 THEN concat('x,y', k) WHEN 2 THEN concat('v', k) END AS written
  FROM (SELECT p_partkey AS k FROM part)""")
def e_columns_sql(spark, sf_dir):
    sql = F.expr("""CASE k % 4 WHEN 0 THEN concat('select q.a, b', k, ' as c from t') WHEN 1 THEN concat('INSERT INTO t (x, `y', k, '`) VALUES (1, 2)')
      WHEN 2 THEN concat('UPDATE t SET v', k, ' = 1 WHERE k = 2') ELSE 'DELETE FROM t WHERE z = 1 AND w > 3' END""")
    access = lines.sql_columns(sql)
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(F.col("k").alias("id"), F.array_join(access["read"], ",").alias("read"), F.array_join(access["write"], ",").alias("written"))


@query(f"""SELECT concat('f', k) AS unit, concat('f', k) AS callee, 1 AS line_number, false AS is_async FROM {C}
  UNION ALL SELECT concat('f', k), CASE k % 4 WHEN 2 THEN concat('new Error', k) ELSE 'assert' END, 2, false FROM {C} WHERE k % 4 >= 2
  UNION ALL SELECT concat('f', k), concat('f', t), 3, k % 2 = 0 FROM {C}
  UNION ALL SELECT concat('f', k), CASE WHEN k % 3 = 0 THEN 'bus.emit' ELSE 'socket.on' END, 4, false FROM {C}
  UNION ALL SELECT concat('f', k), 'db.query', 5, false FROM {C}""")
def e_calls(spark, sf_dir):
    _, found, bodies = corpus_bodies(spark, sf_dir)
    rows = named(lines.deep_rows(bodies)["function_calls"], found, "caller_unit_id")
    return rows.select("unit", F.col("callee_name").alias("callee"), "line_number", "is_async")


@query("""SELECT page_id, count(*) AS calls FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) WHERE line LIKE '%track(%' GROUP BY page_id""")
def e_calls_pages(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("unit_id"), F.col("html").alias("body"))
    found = lines.function_calls(p).where("callee_name = 'track'")
    return found.groupBy(F.col("caller_unit_id").alias("page_id")).agg(F.count("*").alias("calls"))


@query(f"""SELECT concat('I', k) AS unit, 'id' AS name, 'string' AS field_type, false AS is_optional, true AS is_readonly, 2 AS line_number FROM {C}
  UNION ALL SELECT concat('I', k), concat('tag', k % 3), 'number', true, false, 3 FROM {C}""")
def e_fields(spark, sf_dir):
    _, found, bodies = corpus_bodies(spark, sf_dir)
    return named(lines.deep_rows(bodies)["type_fields"], found, "parent_unit_id").select("unit", "name", "field_type", "is_optional", "is_readonly", "line_number")


@query(f"""SELECT concat('f', k) AS unit, concat('evt', k % 5) AS event_name, CASE WHEN k % 3 = 0 THEN 'emit' ELSE 'subscribe' END AS direction, CASE WHEN k % 3 = 0 THEN 'node-events' ELSE 'socket.io' END AS framework, 4 AS line_number FROM {C}""")
def e_events(spark, sf_dir):
    _, found, bodies = corpus_bodies(spark, sf_dir)
    return named(lines.deep_rows(bodies)["event_flows"], found, "code_unit_id").select("unit", "event_name", "direction", "framework", "line_number")


@query(f"""SELECT concat('f', k) AS unit, CASE k % 4 WHEN 0 THEN 'type-guard' WHEN 1 THEN 'early-return' WHEN 2 THEN 'throw' ELSE 'assertion' END AS guard_type,
    CASE k % 4 WHEN 0 THEN '!a' WHEN 1 THEN 'a > b' WHEN 2 THEN concat('Error', k) ELSE 'assertion' END AS condition, 2 AS line_number FROM {C}""")
def e_guards(spark, sf_dir):
    _, found, bodies = corpus_bodies(spark, sf_dir)
    return named(lines.deep_rows(bodies)["guard_clauses"], found, "code_unit_id").select("unit", "guard_type", "condition", "line_number")


@query("""SELECT concat('KEY_', k) AS name, CASE WHEN k % 2 = 0 THEN concat('one ', k, ' two') END AS description, true AS has_default, 3 AS line_number FROM (SELECT p_partkey AS k FROM part)
  UNION ALL SELECT concat('EMPTY_', k), NULL, false, 6 FROM (SELECT p_partkey AS k FROM part)""")
def e_env(spark, sf_dir):
    text = F.expr(r"""concat(if(k % 2 = 0, concat('# one ', k), ''), '\n', if(k % 2 = 0, '#  two', 'x'), '\nKEY_', k, '="v"\n# lost\n\nEMPTY_', k, '=""\nlower=1')""")
    f = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(F.expr("concat('e', k, '/.env.example')").alias("file_path"), text.alias("content"))
    return lines.env_variables(f).select("name", "description", "has_default", "line_number")


@query("""SELECT concat('N', n_nationkey) AS model, concat('nation_', lower(n_name)) AS table_name, f.name, f.field_type, f.name = 'id' AS is_primary_key, f.name <> 'note' AS is_required, f.name = 'code' AS is_unique, f.name = 'id' AS has_default,
    CASE WHEN f.name = 'region' THEN concat('R', n_regionkey) END AS relation_target
  FROM nation, LATERAL (SELECT unnest([{'name': 'id', 'field_type': 'Int'}, {'name': 'code', 'field_type': 'String'}, {'name': 'note', 'field_type': 'String'}, {'name': 'region', 'field_type': concat('R', n_regionkey)}]) AS f)""")
def e_schema_models(spark, sf_dir):
    text = F.expr(r"""concat('model N', n_nationkey, ' {\n  id Int @id @default(autoincrement())\n  code String @unique\n  // note\n  note String?\n  region R', n_regionkey,
      ' @relation(fields: [code])\n  @@map("nation_', lower(n_name), '")\n}\n')""")
    f = t(spark, sf_dir, "nation").select(F.expr("concat('db/', n_nationkey, '.prisma')").alias("file_path"), text.alias("content"))
    models, fields = units.schema_models(f)
    m = models.select(F.col("id").alias("model_id"), F.col("name").alias("model"), "table_name")
    return fields.join(m, "model_id").select("model", "table_name", "name", "field_type", "is_primary_key", "is_required", "is_unique", "has_default", "relation_target")


# ---------------------------------------------------------------- recipe G: tables read as a catalog

U_SQL = "(SELECT p_partkey::VARCHAR AS id, p_brand AS file_path, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'METHOD' ELSE 'CLASS' END AS unit_type, p_size AS line_start, p_size + 10 AS line_end, CASE WHEN p_size % 4 <> 0 THEN concat('(', p_type, ')') END AS signature, p_size % 2 = 0 AS is_exported, CASE WHEN p_size % 5 = 0 THEN 'python' ELSE 'typescript' END AS language, p_size::DOUBLE AS complexity_score, p_partkey AS seq FROM part)"
P_TYPE = "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'API_ENDPOINT' WHEN 'RF' THEN 'DATABASE_READ' WHEN 'NF' THEN 'DATABASE_WRITE' WHEN 'NO' THEN 'EXTERNAL_SERVICE' WHEN 'AO' THEN 'API_CALL' ELSE 'ENV_VARIABLE' END"
P_SQL = f"(SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_partkey::VARCHAR AS code_unit_id, {P_TYPE} AS pattern_type, concat(CASE l_linenumber % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END, ' /', l_suppkey) AS pattern_value, l_linenumber AS line_number, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"
D_SQL = "(SELECT DISTINCT a.p_brand AS source_file, b.p_brand AS target_file FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2)"
E_SQL = "(SELECT event_id::VARCHAR AS id, (user_id % 400)::VARCHAR AS code_unit_id, event_type AS event_name, CASE WHEN event_id % 2 = 0 THEN 'emit' ELSE 'subscribe' END AS direction, CASE WHEN event_id % 3 = 0 THEN 'rxjs' ELSE 'node-events' END AS framework, (event_id % 50)::INT AS line_number FROM events)"
CALL_SQL = f"(SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_partkey::VARCHAR AS caller_unit_id, CASE l_linenumber % 3 WHEN 2 THEN p_name WHEN 1 THEN concat('this.x.', p_name) ELSE concat('new ', p_name) END AS callee_name, l_linenumber AS line_number, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON p_partkey = l_suppkey % {N})"


def empty(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the missing columns of a catalog table as nulls."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(TABLES[name])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    part, item, event = (t(spark, sf_dir, x) for x in ("part", "lineitem", "events"))
    own = part.selectExpr(
        "cast(p_partkey AS string) AS id", "p_brand AS file_path", "p_name AS name", "CASE p_size % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'METHOD' ELSE 'CLASS' END AS unit_type", "p_size AS line_start",
        "p_size + 10 AS line_end", "CASE WHEN p_size % 4 <> 0 THEN concat('(', p_type, ')') END AS signature", "false AS is_async", "p_size % 2 = 0 AS is_exported",
        "CASE WHEN p_size % 5 = 0 THEN 'python' ELSE 'typescript' END AS language", "cast(p_size AS double) AS complexity_score", "p_partkey AS seq",
    )
    pats = item.selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS id", "cast(l_partkey AS string) AS code_unit_id", f"{P_TYPE} AS pattern_type",
        "concat(CASE l_linenumber % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END, ' /', l_suppkey) AS pattern_value", "l_linenumber AS line_number", "l_orderkey * 10 + l_linenumber AS seq",
    )
    half = part.select(F.expr("p_partkey DIV 2").alias("h"), F.col("p_brand").alias("source_file"))
    deps = half.join(part.select(F.col("p_partkey").alias("h"), F.col("p_brand").alias("target_file")), "h").select("source_file", "target_file").distinct()
    n = part.agg(F.count("*").alias("n"))
    calls = item.crossJoin(F.broadcast(n)).withColumn("p_partkey", F.col("l_suppkey") % F.col("n")).join(part.select("p_partkey", "p_name"), "p_partkey").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS id", "cast(l_partkey AS string) AS caller_unit_id",
        "CASE l_linenumber % 3 WHEN 2 THEN p_name WHEN 1 THEN concat('this.x.', p_name) ELSE concat('new ', p_name) END AS callee_name", "l_linenumber AS line_number", "l_orderkey * 10 + l_linenumber AS seq",
    )
    flows = event.selectExpr(
        "cast(event_id AS string) AS id", "cast(user_id % 400 AS string) AS code_unit_id", "event_type AS event_name", "CASE WHEN event_id % 2 = 0 THEN 'emit' ELSE 'subscribe' END AS direction",
        "CASE WHEN event_id % 3 = 0 THEN 'rxjs' ELSE 'node-events' END AS framework", "cast(event_id % 50 AS int) AS line_number",
    )
    guards = part.selectExpr("concat('g', p_partkey) AS id", "cast(p_partkey + 5 AS string) AS code_unit_id", "CASE WHEN p_size % 2 = 0 THEN 'throw' ELSE 'early-return' END AS guard_type", "p_type AS condition", "p_size AS line_number")
    env = t(spark, sf_dir, "nation").selectExpr("n_name AS name", "CASE WHEN n_regionkey > 1 THEN concat('d', n_regionkey) END AS description", "n_nationkey % 2 = 0 AS has_default", "n_nationkey AS line_number", "n_name AS id")
    region, nation = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    models = region.selectExpr("concat('r', r_regionkey) AS id", "r_name AS name", "concat('db/', r_regionkey) AS file_path", "CASE WHEN r_regionkey < 3 THEN 'prisma' ELSE 'drizzle' END AS framework", "CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) END AS table_name")
    fields = nation.selectExpr("concat('f', n_nationkey) AS id", "concat('r', n_regionkey) AS model_id", "n_name AS name", "'String' AS field_type", "n_nationkey % 5 = 0 AS is_primary_key", "true AS is_required", "false AS is_unique", "n_nationkey % 2 = 1 AS has_default", "CASE WHEN n_nationkey % 7 = 0 THEN 'X' END AS relation_target")
    clusters = region.selectExpr("concat('c', r_regionkey) AS id", "r_name AS name", "0.5D AS cohesion", "10L AS internal_edges", "10L AS external_edges")
    members = part.select("p_brand").distinct().selectExpr("concat('c', crc32(p_brand) % 5) AS cluster_id", "p_brand AS file_path", "p_brand LIKE '%1' AS is_entry_point")
    tables = {"code_units": own, "code_unit_patterns": pats, "file_dependencies": deps, "function_calls": calls, "event_flows": flows, "guard_clauses": guards, "env_variables": env,
              "schema_models": models, "schema_model_fields": fields, "file_clusters": clusters, "file_cluster_members": members}
    return Catalog(spark, {k: empty(spark, k, v) for k, v in tables.items()})


RES = f"""u AS {U_SQL}, c AS {CALL_SQL}, b AS (SELECT c.*, regexp_replace(regexp_replace(callee_name, '^new ', ''), '^this\\.x\\.', '') AS name FROM c),
  n AS (SELECT name, count(*) AS n, min(id) AS only, count(*) FILTER (is_exported) AS ne, min(id) FILTER (is_exported) AS ex FROM u GROUP BY name),
  f AS (SELECT name, file_path, count(*) AS n, min(id) AS only FROM u GROUP BY name, file_path),
  r AS (SELECT b.id, CASE WHEN n.n IS NULL THEN 'no_match' WHEN n.n = 1 THEN 'unique' WHEN f.n = 1 THEN 'same_file' WHEN n.ne = 1 THEN 'exported' ELSE 'ambiguous' END AS outcome,
        CASE WHEN n.n = 1 THEN n.only WHEN f.n = 1 THEN f.only WHEN n.ne = 1 THEN n.ex END AS callee_unit_id
        FROM b LEFT JOIN u ON u.id = b.caller_unit_id LEFT JOIN n ON n.name = b.name LEFT JOIN f ON f.name = b.name AND f.file_path = u.file_path)"""


@query(f"WITH {RES} SELECT id, outcome, callee_unit_id FROM r")
def d_resolve(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return resolve.resolve_calls(c["function_calls"], c["code_units"]).select("id", "outcome", "callee_unit_id")


@query(f"WITH {RES} SELECT count(*) AS total, count(*) FILTER (outcome IN ('unique', 'same_file', 'exported')) AS resolved, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'no_match') AS no_match FROM r")
def d_resolve_stats(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return resolve.resolution_stats(resolve.resolve_calls(c["function_calls"], c["code_units"]))




def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part depends on (7 k + 3) mod n and on k div 2."""
    part = t(spark, sf_dir, "part")
    p = part.select(F.col("p_partkey").alias("k")).crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))
    return p.select(F.col("k").alias("src"), F.explode(F.array((F.col("k") * 7 + 3) % F.col("n"), F.expr("k DIV 2"))).alias("dst")).distinct()


EDGES = f"e AS (SELECT DISTINCT k AS src, unnest([(k * 7 + 3) % {N}, k // 2]) AS dst FROM (SELECT p_partkey AS k FROM part))"
CLOSURE = """r AS (SELECT s AS start, s AS node, 0 AS depth FROM (SELECT unnest([5, 17]::BIGINT[]) AS s) UNION SELECT r.start, {b}, r.depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE r.depth < {d})
  SELECT start, node, min(depth)::INT AS depth FROM r WHERE node <> start GROUP BY start, node"""


@query(f"WITH RECURSIVE {EDGES}, " + CLOSURE.format(a="src", b="e.dst", d=5))
def d_closure_deps(spark, sf_dir):
    return graph.closure(part_edges(spark, sf_dir), spark.createDataFrame([(5,), (17,)], "start long"), 5)


@query(f"WITH RECURSIVE {EDGES}, " + CLOSURE.format(a="dst", b="e.src", d=4))
def d_closure_dependents(spark, sf_dir):
    back = part_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(back, spark.createDataFrame([(5,), (17,)], "start long"), 4)


@query("""WITH RECURSIVE e AS (SELECT concat('c', c_custkey) AS a, concat('n', c_nationkey) AS b FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
  r AS (SELECT a AS node, a AS x FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.x)
  SELECT node, min(x) AS component FROM r GROUP BY node""")
def d_components(spark, sf_dir):
    c = t(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst")
    n = t(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst")
    return graph.components(c.unionByName(n))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional graph with cycles, and parts hanging on it."""
    s = t(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("lo"))
    own = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), (((F.col("s_suppkey") - F.col("lo")) * 7 + 3) % F.col("n") + F.col("lo")).alias("dst"))
    p = t(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select((F.col("p_partkey") + 1_000_000).alias("src"), (F.col("p_partkey") % F.col("n") + F.col("lo")).alias("dst"))
    return own.unionByName(p)


SUPP = "m AS (SELECT count(*) AS n, min(s_suppkey) AS lo FROM supplier), e AS (SELECT s_suppkey AS src, ((s_suppkey - lo) * 7 + 3) % n + lo AS dst FROM supplier, m), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"


@query(f"WITH RECURSIVE {SUPP} SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def d_scc(spark, sf_dir):
    return graph.strong_components(supplier_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {SUPP}, s AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
  w AS (SELECT component, component AS "at", component::VARCHAR AS path, 1 AS n FROM (SELECT DISTINCT component FROM s)
    UNION ALL SELECT w.component, e.dst, w.path || '>' || e.dst, w.n + 1 FROM w JOIN e ON e.src = w."at" WHERE w.n = 1 OR w."at" <> w.component)
  SELECT component, (n - 1)::BIGINT AS length, path FROM w WHERE n > 1 AND w."at" = component""")
def d_cycles(spark, sf_dir):
    return graph.cycles(supplier_edges(spark, sf_dir)).select("component", "length", F.array_join("path", ">").alias("path"))


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers import their nation's index and a neighbour: one large component a nation, split by segment."""
    c = t(spark, sf_dir, "customer")
    path = F.expr("concat('src/n', c_nationkey, '/', lower(c_mktsegment), '/c', c_custkey)")
    return c.select(path.alias("source_file"), F.expr("concat('src/n', c_nationkey, '/index')").alias("target_file"), "c_custkey", "c_nationkey")


CL = """f AS (SELECT concat('src/n', c_nationkey, '/', lower(c_mktsegment), '/c', c_custkey) AS file, c_nationkey AS n, lower(c_mktsegment) AS seg FROM customer),
  k AS (SELECT n, count(*) + 1 AS size, count(DISTINCT seg) AS segs, any_value(seg) AS one FROM f GROUP BY n),
  m AS (SELECT file, n, CASE WHEN size > 20 THEN seg ELSE '' END AS part FROM f JOIN k USING (n) UNION ALL SELECT concat('src/n', n, '/index'), n, CASE WHEN size > 20 THEN concat('src/n', n) ELSE '' END FROM k)"""


@query(f"""WITH {CL}, e AS (SELECT a.n, a.part AS pa, b.part AS pb FROM m a JOIN m b ON a.n = b.n AND b.file = concat('src/n', b.n, '/index') AND a.file <> b.file),
  g AS (SELECT n, part, count(*) AS files, CASE WHEN part = '' OR part LIKE 'src/%' THEN concat('n', n) ELSE concat('n', n, '/', part) END AS name FROM m GROUP BY n, part)
  SELECT g.name, g.files, (SELECT count(*) FROM e WHERE e.n = g.n AND e.pa = g.part AND e.pb = g.part) AS internal_edges,
    (SELECT count(*) FROM e WHERE e.n = g.n AND e.pa <> e.pb AND (e.pa = g.part OR e.pb = g.part)) AS external_edges FROM g""")
def d_clusters(spark, sf_dir):
    found, members = graph.clusters(customer_files(spark, sf_dir))
    n = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("files"))
    return found.join(n, "id").select("name", "files", "internal_edges", "external_edges")


@query(f"WITH {CL} SELECT concat('src/n', n, '/index') AS file_path FROM k WHERE size > 20")
def d_entry_points(spark, sf_dir):
    _, members = graph.clusters(customer_files(spark, sf_dir))
    return members.where("is_entry_point").select("file_path")


@query("""SELECT concat('n', a.c_nationkey) AS source_cluster, concat('n', b.c_nationkey) AS target_cluster, count(*) AS weight FROM orders o JOIN customer a ON a.c_custkey = o.o_custkey JOIN customer b ON b.c_custkey = o.o_orderkey % 150
  WHERE a.c_nationkey <> b.c_nationkey GROUP BY ALL""")
def d_cluster_edges(spark, sf_dir):
    members = t(spark, sf_dir, "customer").selectExpr("concat('n', c_nationkey) AS cluster_id", "cast(c_custkey AS string) AS file_path")
    deps = t(spark, sf_dir, "orders").selectExpr("cast(o_custkey AS string) AS source_file", "cast(o_orderkey % 150 AS string) AS target_file")
    return graph.cluster_edges(deps, members)


COMBO = f"u AS {U_SQL}, p AS {P_SQL}, g AS (SELECT code_unit_id, string_agg(DISTINCT pattern_type, '|' ORDER BY pattern_type) AS combo, count(*) AS n_patterns FROM p GROUP BY code_unit_id)"
RANKED = f"""{COMBO}, k AS (SELECT u.*, combo, n_patterns, count(*) OVER (PARTITION BY combo) AS n_units, row_number() OVER (PARTITION BY combo ORDER BY complexity_score, CASE WHEN signature IS NULL THEN 1 ELSE 0 END, n_patterns DESC, is_exported DESC, file_path, id) AS rank
  FROM u JOIN g ON g.code_unit_id = u.id), r AS (SELECT * FROM k WHERE n_units >= 3)"""


@query(f"WITH {COMBO} SELECT * FROM g")
def d_combos(spark, sf_dir):
    return ranking.pattern_combos(catalog(spark, sf_dir)["code_unit_patterns"])


def _title_sql(x: str) -> str:
    return f"list_transform(string_split({x}, '|'), lambda a: array_to_string(list_transform(string_split(a, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), ' '))"


@query(f"""WITH {RANKED}, x AS (SELECT *, {_title_sql('combo')} AS tt FROM r WHERE rank = 1)
  SELECT combo, id AS template_unit_id, n_units - 1 AS follower_count, CASE WHEN len(tt) = 1 THEN tt[1] ELSE array_to_string(tt[1:len(tt) - 1], ', ') || ' with ' || tt[len(tt)] END AS name,
    'Functions that combine ' || CASE WHEN len(tt) = 1 THEN tt[1] ELSE array_to_string(tt[1:len(tt) - 1], ', ') || ', and ' || tt[len(tt)] END || '. Found in ' || n_units || ' locations.' AS description FROM x""")
def d_templates(spark, sf_dir):
    c = catalog(spark, sf_dir)
    found, _ = ranking.templates(c["code_units"], c["code_unit_patterns"])
    return found.select(F.array_join("pattern_types", "|").alias("combo"), "template_unit_id", "follower_count", "name", "description")


@query(f"WITH {RANKED} SELECT combo, file_path, name AS unit_name, rank::INT AS rank FROM r WHERE rank > 1")
def d_template_followers(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return ranking.template_ranks(c["code_units"], c["code_unit_patterns"]).where("rank > 1").select("combo", "file_path", F.col("name").alias("unit_name"), "rank")


@query(f"""WITH u AS {U_SQL}, p AS {P_SQL}, o AS (SELECT code_unit_id AS id, count(*) AS n FROM p WHERE pattern_type IN (SELECT pattern_type FROM p WHERE code_unit_id = '7') GROUP BY 1)
  SELECT u.id, (CASE WHEN u.unit_type = (SELECT unit_type FROM u WHERE id = '7') THEN 2 ELSE 0 END + coalesce(o.n, 0))::BIGINT AS score FROM u LEFT JOIN o USING (id) WHERE u.id <> '7' AND score > 0 ORDER BY score DESC, u.id LIMIT 5""")
def d_similar(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return ranking.similar_units(c["code_units"], c["code_unit_patterns"], c.find("code_units", id="7"))


@query("""SELECT k, unnest(CASE WHEN k % 2 = 0 THEN ['tests/a/b' || k || '.test.ts', 'tests/a/b' || k || '.spec.ts', 'src/a/__tests__/b' || k || '.test.ts', 'src/a/b' || k || '.test.ts'] ELSE ['lib/b' || k || '.test.py', 'lib/b' || k || '.spec.py'] END) AS test_file FROM (SELECT p_partkey AS k FROM part)""")
def d_test_candidates(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    path = F.expr("if(k % 2 = 0, concat('src/a/b', k, '.ts'), concat('lib/b', k, '.py'))")
    return p.select("k", F.explode(ranking.test_candidates(path)).alias("test_file"))


@query(f"""WITH d AS {D_SQL}, a AS (SELECT DISTINCT p_brand AS f FROM part WHERE p_brand LIKE 'Brand#1%')
  SELECT source_file, target_file, CASE WHEN source_file IN (FROM a) AND target_file IN (FROM a) THEN 'internal' WHEN target_file IN (FROM a) THEN 'external-inbound' ELSE 'external-outbound' END AS direction
  FROM d WHERE source_file IN (FROM a) OR target_file IN (FROM a)""")
def d_classify(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return ranking.classify_dependencies(c["file_dependencies"], c["code_units"].where("file_path LIKE 'Brand#1%'").select("file_path"))


@query("""SELECT concat('f', k, CASE k % 4 WHEN 0 THEN '.js' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.jsx' END) AS path, concat('f', k, CASE WHEN k % 4 = 3 THEN '.tsx' ELSE '.ts' END) AS file_path FROM (SELECT p_partkey AS k FROM part)""")
def d_resolve_paths(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    paths = p.select(F.expr("concat('f', k, CASE k % 4 WHEN 0 THEN '.js' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.jsx' END)").alias("path"))
    files = p.select(F.explode(F.expr("CASE WHEN k % 4 = 3 THEN array(concat('f', k, '.tsx')) WHEN k % 4 = 1 THEN array(concat('f', k, '.ts'), concat('f', k, '.js')) ELSE array(concat('f', k, '.ts')) END")).alias("file_path"))
    return graph.resolve_paths(paths, files)


@query(f"SELECT pattern_type, count(*) AS count FROM {P_SQL} GROUP BY pattern_type")
def d_histogram(spark, sf_dir):
    return ranking.pattern_histogram(catalog(spark, sf_dir)["code_unit_patterns"])


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 OR p_size % 10 >= 6 THEN 'HIGH' WHEN p_size % 10 >= 3 OR p_size % 3 > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM part""")
def d_risk(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    risk = ranking.risk_level(F.col("p_size") % 10, F.when(F.col("p_size") % 7 == 0, 1).otherwise(0), F.col("p_size") % 3)
    return p.select(F.col("p_partkey").alias("k"), risk.alias("risk"))


# ---------------------------------------------------------------- query tools


@query(f"""WITH u AS {U_SQL}, p AS {P_SQL}, d AS {D_SQL} SELECT (SELECT count(*) FROM u) AS code_units, (SELECT count(DISTINCT file_path) FROM u) AS files, (SELECT count(*) FROM p WHERE code_unit_id IN (SELECT id FROM u)) AS patterns,
  (SELECT count(*) FROM d) AS dependencies, (SELECT count(*) FROM nation) AS env_variables, (SELECT count(*) FROM region) AS clusters,
  (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM u GROUP BY language)) AS languages""")
def q01_stats(spark, sf_dir):
    return tools.stats(catalog(spark, sf_dir))


@query(f"WITH u AS {U_SQL} SELECT file_path, count(*) AS unit_count, string_agg(unit_type || ':' || name, ',' ORDER BY seq) AS units FROM u GROUP BY file_path ORDER BY min(seq) LIMIT 10 OFFSET 5")
def q02_overview(spark, sf_dir):
    return tools.module_overview(catalog(spark, sf_dir), limit=10, offset=5).rows.select("file_path", "unit_count", F.array_join("units", ",").alias("units"))


@query(f"WITH u AS {U_SQL} SELECT id, name FROM u WHERE lower(name) LIKE '%an%' ORDER BY seq LIMIT 20")
def q03_search(spark, sf_dir):
    return tools.search(catalog(spark, sf_dir), "AN").rows.select("id", "name")


@query(f"WITH u AS {U_SQL}, p AS {P_SQL} SELECT id, name FROM u WHERE id IN (SELECT code_unit_id FROM p WHERE lower(pattern_value) LIKE '%post /1%') ORDER BY seq LIMIT 50")
def q03_search_patterns(spark, sf_dir):
    return tools.search(catalog(spark, sf_dir), "post /1", "pattern", 50).rows.select("id", "name")


@query(f"WITH u AS {U_SQL} SELECT id, file_path, name, complexity_score FROM u WHERE unit_type = 'METHOD' AND is_exported AND complexity_score >= 20 AND language = 'typescript' ORDER BY seq LIMIT 25 OFFSET 5")
def q04_units(spark, sf_dir):
    return tools.code_units(catalog(spark, sf_dir), unit_type="METHOD", is_exported=True, min_complexity=20, language="typescript", limit=25, offset=5).rows.select("id", "file_path", "name", "complexity_score")


@query(f"WITH d AS {D_SQL} SELECT * FROM d WHERE source_file = 'Brand#11'")
def q05_dependencies(spark, sf_dir):
    return tools.dependencies(catalog(spark, sf_dir), source_file="Brand#11", target_file="ignored").rows.select("source_file", "target_file")


@query(f"WITH d AS {D_SQL} SELECT * FROM d WHERE source_file = 'Brand#11' AND target_file = (SELECT min(target_file) FROM d WHERE source_file = 'Brand#11')")
def h05_dependencies(spark, sf_dir):
    c = catalog(spark, sf_dir)
    target = c.find("file_dependencies", source_file="Brand#11").agg(F.min("target_file")).first()[0]
    return tools.dependencies(c, source_file="Brand#11", target_file=target, both=True).rows.select("source_file", "target_file")


@query(f"WITH u AS {U_SQL}, p AS {P_SQL} SELECT p.pattern_value, u.file_path, u.name FROM p JOIN u ON u.id = p.code_unit_id WHERE pattern_type = 'API_ENDPOINT' AND upper(pattern_value) LIKE 'POST%' AND pattern_value LIKE '%/1%' ORDER BY u.seq, p.seq LIMIT 100")
def q06_endpoints(spark, sf_dir):
    return tools.api_endpoints(catalog(spark, sf_dir), method="post", path_pattern="/1").rows.select("pattern_value", "file_path", "name")


@query(f"""SELECT concat('src/m', k % 10, '/part', k, '.ts') AS file_path, concat('  return process.env.KEY_', k % 6, ';', chr(10), '}}') AS content, 14::BIGINT AS line_count FROM {C} WHERE k = 12""")
def q07_content(spark, sf_dir):
    return tools.file_content(Catalog(spark, {"files": corpus(spark, sf_dir)}), "src/m2/part12.ts", 8, 9)


@query("SELECT n_name AS name, CASE WHEN n_regionkey > 1 THEN concat('d', n_regionkey) END AS description, n_nationkey % 2 = 0 AS has_default, n_nationkey AS line_number FROM nation")
def q08_env(spark, sf_dir):
    return tools.env_variables(catalog(spark, sf_dir)).rows


@query(f"WITH u AS {U_SQL}, p AS {P_SQL} SELECT p.pattern_value, p.line_number, u.name FROM p JOIN u ON u.id = p.code_unit_id WHERE pattern_type = 'DATABASE_WRITE' AND u.file_path = 'Brand#21' ORDER BY u.seq, p.seq LIMIT 100")
def q09_patterns(spark, sf_dir):
    return tools.patterns_by_type(catalog(spark, sf_dir), "DATABASE_WRITE", "Brand#21").rows.select("pattern_value", "line_number", "name")


@query(f"""WITH RECURSIVE d AS {D_SQL}, r AS (SELECT 'Brand#11' AS node, 0 AS depth UNION SELECT d.source_file, r.depth + 1 FROM r JOIN d ON d.target_file = r.node WHERE r.depth < 2)
  SELECT node AS file_path, min(depth)::INT AS depth FROM r WHERE node <> 'Brand#11' GROUP BY node""")
def q10_impact(spark, sf_dir):
    return tools.change_impact(catalog(spark, sf_dir), file_path="Brand#11", depth=2).rows


def tree(spark: SparkSession, sf_dir: str) -> Catalog:
    """Calls as a binary tree: part k is called by k div 2."""
    c = catalog(spark, sf_dir)
    calls = t(spark, sf_dir, "part").where("p_partkey > 0").selectExpr("concat('c', p_partkey) AS id", "cast(p_partkey DIV 2 AS string) AS caller_unit_id", "p_name AS callee_name", "cast(p_partkey AS string) AS callee_unit_id", "1 AS line_number", "p_partkey AS seq")
    return Catalog(spark, {"code_units": c["code_units"], "function_calls": empty(spark, "function_calls", calls.where("caller_unit_id <> callee_unit_id"))})


@query("""WITH RECURSIVE r AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = r.k AND p_partkey > 0 WHERE depth < 4 AND p_partkey <> r.k)
  SELECT k::VARCHAR AS id, depth::INT AS depth FROM r WHERE depth > 0""")
def q11_chain(spark, sf_dir):
    return tools.call_chain(tree(spark, sf_dir), unit_id="1", depth=4).rows.select("id", "depth")


@query(f"WITH e AS {E_SQL}, u AS {U_SQL} SELECT e.id, e.event_name, e.line_number, u.name AS unit_name FROM e LEFT JOIN u ON u.id = e.code_unit_id WHERE direction = 'emit' AND framework = 'rxjs'")
def q12_events(spark, sf_dir):
    return tools.event_flow(catalog(spark, sf_dir), direction="emit", framework="rxjs").rows.select("id", "event_name", "line_number", "unit_name")


@query("""SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) END AS table_name, string_agg(n_name, ',' ORDER BY n_name) AS fields FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY ALL""")
def q13_models(spark, sf_dir):
    found = tools.data_models(catalog(spark, sf_dir), framework="prisma").rows
    return found.select("name", "table_name", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"))


@query(f"""WITH u AS {U_SQL} SELECT concat('g', p_partkey) AS id, p_type AS condition, u.name AS unit_name FROM part JOIN u ON u.id = (p_partkey + 5)::VARCHAR WHERE p_size % 2 = 0 ORDER BY u.seq, p_size LIMIT 100""")
def q14_guards(spark, sf_dir):
    return tools.function_guards(catalog(spark, sf_dir), guard_type="throw").rows.select("id", "condition", "unit_name")


def area_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = catalog(spark, sf_dir)
    m = c["code_units"].where("file_path LIKE 'Brand#1%'").select("file_path").distinct().selectExpr("'c1' AS cluster_id", "file_path", "file_path = 'Brand#11' AS is_entry_point")
    c.tables["file_cluster_members"] = m
    return c


@query("SELECT p_partkey::VARCHAR AS id, p_brand AS file_path FROM part WHERE p_brand LIKE 'Brand#1%'")
def q15_area(spark, sf_dir):
    return tools.feature_area(area_catalog(spark, sf_dir), cluster_id="c1").rows.select("id", "file_path")


@query(f"""WITH u AS {U_SQL}, p AS {P_SQL}, h AS (SELECT pattern_type, count(*) AS n FROM p JOIN u ON u.id = p.code_unit_id WHERE file_path LIKE 'Brand#1%' GROUP BY 1)
  SELECT n_files, n_units, 'Feature area ''' || (SELECT r_name FROM region WHERE r_regionkey = 1) || ''' contains ' || n_files || ' files with ' || n_units || ' code units. Cohesion: 0.5. Top patterns: ' ||
  (SELECT string_agg(pattern_type || ' (' || n || ')', ', ' ORDER BY n DESC, pattern_type) FROM (SELECT * FROM h ORDER BY n DESC, pattern_type LIMIT 3)) || '. Entry points: Brand#11.' AS summary
  FROM (SELECT count(DISTINCT file_path) AS n_files, count(*) AS n_units FROM u WHERE file_path LIKE 'Brand#1%')""")
def q15_summary(spark, sf_dir):
    return tools.feature_area(area_catalog(spark, sf_dir), cluster_id="c1").parts["summary"]


def template_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = catalog(spark, sf_dir)
    c.tables["pattern_templates"], c.tables["pattern_template_followers"] = ranking.templates(c["code_units"], c["code_unit_patterns"])
    return c


@query(f"""WITH {RANKED}, x AS (SELECT combo, {_title_sql('combo')} AS tt, n_units FROM r WHERE rank = 1), s AS (SELECT combo,
    CASE WHEN lower(CASE WHEN len(tt) = 1 THEN tt[1] ELSE array_to_string(tt[1:len(tt) - 1], ', ') || ' with ' || tt[len(tt)] END) LIKE '%api%' THEN 3 ELSE 0 END
    + CASE WHEN lower(array_to_string(tt, ',')) LIKE '%api%' THEN 2 ELSE 0 END + 2 * len(list_filter(string_split(combo, '|'), lambda a: lower(a) LIKE '%api%')) AS s0,
    list_concat(CASE combo WHEN 'API_ENDPOINT|DATABASE_WRITE' THEN ['Writes to database from API endpoint handler'] WHEN 'API_ENDPOINT|DATABASE_READ' THEN ['Reads from database in API endpoint handler']
      WHEN 'API_ENDPOINT|EXTERNAL_SERVICE' THEN ['Calls external service from API endpoint handler'] WHEN 'DATABASE_READ|DATABASE_WRITE' THEN ['Reads and writes to database in single operation']
      WHEN 'API_ENDPOINT|DATABASE_READ|DATABASE_WRITE' THEN ['API endpoint performing both database reads and writes'] ELSE [] END,
      list_transform(string_split(combo, '|'), lambda a: CASE a WHEN 'API_CALL' THEN 'Makes outbound API calls' ELSE '-' END))[1:3] AS conv FROM x)
  SELECT combo, (s0 + len(list_filter(conv, lambda a: lower(a) LIKE '%api%')))::BIGINT AS score FROM s WHERE score > 0""")
def q16_matches(spark, sf_dir):
    c = template_catalog(spark, sf_dir)
    m = tools.find_pattern(c, "api").parts["matches"]
    return m.join(c["pattern_templates"].select("id", F.array_join("pattern_types", "|").alias("combo")), "id").select("combo", "score")


def fresh_file(spark: SparkSession, sf_dir: str) -> Catalog:
    """Tables with templates, and a file that only its text tells of."""
    c = template_catalog(spark, sf_dir)
    text = "export async function load(id: string) {\n  const all = await axios.get('/all');\n  return process.env.KEY;\n}\nexport const late = () => fetch(base);\n"
    c.tables["files"] = sources.with_file_columns(spark.createDataFrame([("src/new.ts", text)], "file_path string, content string"))
    return c


@query(f"""WITH {COMBO} SELECT u.file_path, arg_min(u.name, u.seq) AS unit_name FROM u WHERE u.id IN (SELECT code_unit_id FROM p WHERE pattern_type IN ('API_CALL', 'ENV_VARIABLE')) GROUP BY u.file_path ORDER BY min(u.seq) LIMIT 5""")
def q17_similar_files(spark, sf_dir):
    return tools.validate_file(fresh_file(spark, sf_dir), "src/new.ts").parts["similar_files"]


@query("""SELECT * FROM (VALUES ('load', 'API_CALL', 'GET /all'), ('load', 'ENV_VARIABLE', 'KEY'), ('late', 'API_CALL', 'base')) t(unit, pattern_type, pattern_value)""")
def q17_patterns(spark, sf_dir):
    found = tools.validate_file(fresh_file(spark, sf_dir), "src/new.ts")
    units_ = found.rows.select(F.col("id").alias("code_unit_id"), F.col("name").alias("unit"))
    return found.parts["patterns"].join(units_, "code_unit_id").select("unit", "pattern_type", "pattern_value")


@query(f"""WITH c AS {CALL_SQL}, u AS {U_SQL}, x AS (SELECT name FROM u WHERE id = '3') SELECT DISTINCT c.id, c.callee_name FROM c WHERE c.callee_name = (FROM x)""")
def q18_callers(spark, sf_dir):
    return tools.function_context(catalog(spark, sf_dir), unit_id="3").parts["incoming"].select("id", "callee_name")


@query(f"WITH d AS {D_SQL} SELECT source_file FROM d WHERE target_file = 'Brand#22'")
def q19_imported_by(spark, sf_dir):
    return tools.implementation_context(template_catalog(spark, sf_dir), file_path="Brand#22").parts["imported_by"].select("source_file")


@query("SELECT concat('tests/m', k % 10, '/part', k, '.test.ts') AS file_path, (k % 3)::BIGINT AS test_count FROM (SELECT p_partkey AS k FROM part)")
def q20_test_structure(spark, sf_dir):
    text = F.expr(r"concat('import { x } from ''y'';\ndescribe(''d'', () => {\n  beforeEach(() => {});\n', repeat('  it(''w'', () => {});\n', cast(k % 3 AS int)), '});')")
    files = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(F.expr("concat('tests/m', k % 10, '/part', k, '.test.ts')").alias("file_path"), text.alias("content"))
    return units.test_structure(files).select("file_path", "test_count")


@query("SELECT r_name AS name, 0::BIGINT AS file_count FROM region WHERE r_regionkey <> 1 UNION ALL SELECT r_name, (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand LIKE 'Brand#1%') FROM region WHERE r_regionkey = 1")
def h06_clusters(spark, sf_dir):
    return tools.cluster_list(area_catalog(spark, sf_dir)).rows.select("name", "file_count")


@query(f"WITH c AS {CALL_SQL} SELECT id, callee_name FROM c WHERE caller_unit_id = '11'")
def h09_calls(spark, sf_dir):
    return tools.function_calls(catalog(spark, sf_dir), caller_id="11").rows.select("id", "callee_name")


# ---------------------------------------------------------------- reports


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def r01_tokens(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", lines.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_number FROM documents)
  SELECT doc_id AS key, line_number, line FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) AS used FROM l) WHERE used <= 400 * 4 + 1""")
def r03_truncate(spark, sf_dir):
    return reports.truncate(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), 400)


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS seq, p_size * 4 // 4 AS tokens, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
  f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS seq UNION ALL SELECT s.i, CASE WHEN f.used + s.tokens <= 400 THEN f.used + s.tokens ELSE f.used END, CASE WHEN f.used + s.tokens <= 400 THEN s.seq END FROM f JOIN s ON s.i = f.i + 1)
  SELECT seq FROM f WHERE seq IS NOT NULL""")
def r04_fit(spark, sf_dir):
    sections = t(spark, sf_dir, "part").select(F.expr("repeat('abcd', p_size)").alias("content"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("seq"))
    return reports.fit(sections, 400)[0].select("seq")


@query(f"""WITH u AS {U_SQL}, p AS {P_SQL}, d AS {D_SQL} SELECT file_path, (3 * count(*) FILTER (is_exported) + count(*) FILTER (complexity_score >= 15)
    + 2 * (SELECT count(*) FROM p JOIN u x ON x.id = p.code_unit_id WHERE x.file_path = u.file_path AND pattern_type IN ('API_ENDPOINT', 'DATABASE_READ', 'DATABASE_WRITE', 'EXTERNAL_SERVICE'))
    + (SELECT count(*) FROM d WHERE target_file = u.file_path))::BIGINT AS score FROM u GROUP BY file_path""")
def r05_module_scores(spark, sf_dir):
    return reports.module_scores(catalog(spark, sf_dir))


@query(f"WITH d AS {D_SQL} SELECT target_file AS file_path, count(*) AS importers FROM d GROUP BY 1 HAVING count(*) >= 2")
def r07_hubs(spark, sf_dir):
    return reports.hubs(catalog(spark, sf_dir))


@query(f"WITH u AS {U_SQL} SELECT id, name, CASE WHEN complexity_score >= 30 THEN 'complex' WHEN complexity_score >= 15 THEN 'moderate' ELSE 'simple' END AS level FROM u WHERE unit_type IN ('FUNCTION', 'METHOD') ORDER BY complexity_score DESC, id LIMIT 10")
def r08_hotspots(spark, sf_dir):
    return reports.hotspots(catalog(spark, sf_dir))["complex"].select("id", "name", "level")


@query(f"WITH {COMBO} SELECT u.id, replace(combo, '|', ', ') AS types FROM u JOIN g ON g.code_unit_id = u.id WHERE unit_type IN ('FUNCTION', 'METHOD') AND len(string_split(combo, '|')) >= 3")
def r08_critical(spark, sf_dir):
    return reports.hotspots(catalog(spark, sf_dir))["critical"].select("id", "types")


@query(f"WITH c AS {CALL_SQL}, u AS {U_SQL} SELECT u.id, count(*) AS calls FROM c JOIN u ON u.id = c.caller_unit_id GROUP BY u.id ORDER BY calls DESC, u.id LIMIT 10")
def r08_fan_out(spark, sf_dir):
    return reports.hotspots(catalog(spark, sf_dir))["fan_out"].select("id", "calls")


@query("""SELECT '## ' || r_name || ' (' || CASE WHEN r_regionkey < 3 THEN 'prisma' ELSE 'drizzle' END || ')' || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN 'Table: ' || lower(r_name) || chr(10) ELSE '' END ||
    string_agg('- ' || n_name || ': String (' || CASE WHEN n_nationkey % 5 = 0 THEN 'PK, ' ELSE '' END || 'required' || CASE WHEN n_nationkey % 2 = 1 THEN ', default' ELSE '' END || CASE WHEN n_nationkey % 7 = 0 THEN ', → X' ELSE '' END || ')', chr(10) ORDER BY n_name) || chr(10) AS content,
    count(*)::DOUBLE AS score FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def r09_schema(spark, sf_dir):
    return reports.schema_sections(catalog(spark, sf_dir)).select("content", "score")


# ---------------------------------------------------------------- incremental


@query("""SELECT l_partkey::VARCHAR AS source_file, l_suppkey::VARCHAR AS target_file, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS import_type FROM lineitem GROUP BY 1, 2""")
def i_upsert(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey AS string) AS source_file", "cast(l_suppkey AS string) AS target_file", "l_returnflag AS import_type", "l_orderkey * 10 + l_linenumber AS seq")
    return sources.last_by(rows, ("source_file", "target_file")).select("source_file", "target_file", "import_type")


@query("""SELECT concat('f', k) AS file_path, CASE k % 10 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' ELSE 'added' END AS change_type FROM (SELECT p_partkey AS k FROM part) WHERE k % 10 IN (0, 1, 2)""")
def i_cdc(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    before = p.where("k % 10 <> 2").selectExpr("concat('f', k) AS file_path", "sha2(cast(k AS string), 256) AS sha256")
    after = p.where("k % 10 <> 1").selectExpr("concat('f', k) AS file_path", "sha2(cast(if(k % 10 = 0, -k - 1, k) AS string), 256) AS sha256")
    return sources.snapshot_changes(before, after).select("file_path", "change_type")


@query(f"WITH p AS {P_SQL}, c AS {CALL_SQL} SELECT 'code_unit_patterns' AS table_name, count(*) AS n FROM p WHERE code_unit_id::BIGINT % 10 <> 1 UNION ALL SELECT 'function_calls', count(*) FROM c WHERE caller_unit_id::BIGINT % 10 <> 1 UNION ALL SELECT 'code_units', count(*) FROM part WHERE p_partkey % 10 <> 1")
def i_cascade(spark, sf_dir):
    c = catalog(spark, sf_dir)
    kept = c.drop_units(c["code_units"].where("seq % 10 = 1"))
    out = None
    for name in ("code_unit_patterns", "function_calls", "code_units"):
        one = kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def i_stream_latest(spark, sf_dir):
    base = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = t(spark, sf_dir, "events").schema
    # A file stream watches the folder that the table is in.
    reader = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet")
    run = incremental.stream_latest(reader, sf_dir, f"{base}-latest", f"{base}-state", "user_id", ["event_id"])
    run.awaitTermination()
    return incremental.read_latest(spark, f"{base}-latest").select("user_id", "event_id", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges extracted from the generated corpus, and all that depends on one file, with depths."""
    edges = graph.resolve_extensions(graph.edges_of(lines.js_imports(corpus(spark, sf_dir))), corpus(spark, sf_dir))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(back, spark.createDataFrame([("src/m3/part3.ts",)], "start string"), 6)



import pytest
from pyspark.sql import functions as F

from strataforge.operators import lines, patterns, units


def body(spark, text, language="typescript"):
    return spark.createDataFrame([("u", text, language, "x.ts")], "unit_id string, body string, language string, file_path string")


def test_calls(spark):
    text = "/* a( */ new Foo(\nawait x.y(1); this.z()\n// no(\nif (ok(1)) { q.r() }\n/* start\n b(\n*/ c()"
    got = {(r[1], r[2], r[3]) for r in lines.function_calls(body(spark, text)).collect()}
    assert got == {("new Foo", 1, False), ("x.y", 2, True), ("this.z", 2, False), ("ok", 4, False), ("q.r", 4, False), ("c", 7, False)}


@pytest.mark.parametrize(("line", "kind", "condition"), [
    ("if (!x) return", "type-guard", "!x"), ("if (a > b) return 0", "early-return", "a > b"), ("throw new E('x')", "throw", "E"), ("throw e", "throw", "throw"),
    ("assert(x)", "assertion", "assertion"), ("expect(assert(x))", None, None), ("// throw new E()", None, None), ("if (typeof x === 'a') return", "type-guard", "typeof x === 'a'"),
])
def test_guards(spark, line, kind, condition):
    got = [(r["guard_type"], r["condition"]) for r in lines.guard_clauses(body(spark, line)).collect()]
    assert got == ([(kind, condition)] if kind else [])


def test_fields(spark):
    text = "class A {\n  private readonly a?: Map<string, number>;\n  b: string,\n  get(x: number): void;\n  // c: d\n}"
    got = [(r["name"], r["field_type"], r["is_optional"], r["is_readonly"]) for r in lines.type_fields(body(spark, text)).orderBy("line_number").collect()]
    assert got == [("a", "Map<string, number>", True, True), ("b", "string", False, False)]


def test_events(spark):
    text = "socket.on('a', f); bus.emit(\"b\")\nel.dispatchEvent(new CustomEvent('c'))\nstore.dispatch(x)\n// bus.emit('n')"
    got = [(r["event_name"], r["direction"], r["framework"]) for r in lines.event_flows(body(spark, text)).orderBy("line_number", "ord").collect()]
    assert got == [("b", "emit", "node-events"), ("a", "subscribe", "socket.io"), ("c", "emit", "dom-events")]
    assert lines.event_flows(body(spark, text), named_only=False).count() == 4


def test_env(spark):
    f = spark.createDataFrame([("e", "# one\n#two\nA=1\n\n# lost\n\nB=\"\"\nc=3\nD=x")], "file_path string, content string")
    got = [(r["name"], r["description"], r["has_default"], r["line_number"]) for r in lines.env_variables(f).orderBy("line_number").collect()]
    assert got == [("A", "one two", True, 3), ("B", None, False, 7), ("D", None, True, 9)]


def test_imports(spark):
    text = "import { a as b, type T } from './x';\nimport d from '../y';\nimport * as n from '/abs/z';\nconst { q } = require('./x');\nawait import('./dyn');\nexport * from './re';\nimport ext from 'lib';"
    f = spark.createDataFrame([("src/m/f.ts", text)], "file_path string, content string")
    got = {(r["target_file"], r["import_type"], tuple(r["imported_names"])) for r in lines.js_imports(f).collect()}
    assert got == {("src/m/x", "NAMED", ("a", "T")), ("src/y", "DEFAULT", ("d",)), ("src/m//abs/z", "NAMESPACE", ("n",)), ("src/m/dyn", "DYNAMIC", ()), ("src/m/re", "NAMED", ())}


@pytest.mark.parametrize(("signature", "n"), [("(a, b)", 2), ("(a: Map<K,V>, b)", 2), ("()", 0), ("(): void", 1), (None, 0)])
def test_parameter_count(spark, signature, n):
    assert spark.createDataFrame([(signature,)], "s string").select(lines.parameter_count(F.col("s"))).first()[0] == n


def test_score(spark):
    c = "named_struct('conditionals', 2, 'loops', 1, 'max_nesting_depth', 2, 'try_catch_blocks', 1, 'async_patterns', 2, 'callback_depth', 0, 'parameter_count', 5, 'line_count', 61)"
    row = spark.range(1).select(F.expr(c).alias("c")).select(lines.complexity_score(F.col("c")).alias("s")).select("s", lines.complexity_level(F.col("s")).alias("l")).first()
    assert tuple(row) == (26.0, "moderate")


def test_callbacks_and_nesting(spark):
    b = body(spark, "a.then(x)\n // c\n.catch(y)\nz\nq.then(1)\n{ '{' { // {\n } }")
    assert b.select(lines.callback_depth(F.col("body"))).first()[0] == 2
    assert b.select(lines.nesting_depth(F.col("body"))).first()[0] == 2


def test_tokens_count_utf16(spark):
    assert spark.createDataFrame([("😀😀a",)], "s string").select(lines.token_estimate(F.col("s"))).first()[0] == 1


def test_patterns(spark):
    text = "async function GET() {\n axios.post('/u', x)\n prisma.user.update({ where: { id: 1 }, data: { name: 2 } })\n q(`SELECT a FROM t`)\n q(`SELECT b FROM t`)\n process.env.KEY\n}"
    rows = {r["pattern_value"]: r for r in patterns.detect(body(spark, text)).collect()}
    assert set(rows) == {"POST /u", "prisma.user.update", "SELECT FROM t", "KEY"}
    assert rows["SELECT FROM t"]["line_number"] == 4
    assert rows["prisma.user.update"]["column_access"].asDict() == {"read": ["id"], "write": ["name"]}


DATABASE_RULES = tuple(r for r in patterns.RULES if r.kind.startswith("DATABASE") and "typescript" in r.languages)


def test_columns_are_read_around_the_match(spark):
    keys = [f"k{i}" for i in range(20)]
    block = "prisma.user.create({\n data: {\n" + "".join(f"  {k}: {k[1:]},\n" for k in keys) + " }\n})"
    late = "x" * 700 + "; q('SELECT a FROM t'); q('SELECT b, c FROM u'); q('UPDATE v SET d = 1 WHERE e=1;UPDATE w SET f = 2 WHERE g = 1')"
    lines_apart = "q('INSERT INTO\n\n p (h) VALUES (1)'); q('INSERT INTO r (i) VALUES (1)')"
    rows = {r["pattern_value"]: r for r in patterns.detect(body(spark, "\n".join([block, late, "x" * 600, lines_apart])), rules=DATABASE_RULES).collect()}
    got = {k: (r["column_access"]["read"], r["column_access"]["write"]) for k, r in rows.items()}
    assert got == {
        "prisma.user.create": (None, keys), "SELECT FROM t": (["a"], None), "SELECT FROM u": (["b", "c"], None), "UPDATE v": (["e"], ["d"]), "UPDATE w": (["g"], ["f"]),
        "INSERT INTO p": (None, ["h"]), "INSERT INTO r": (None, ["i"]),
    }
    assert [rows[k]["line_number"] for k in ("prisma.user.create", "SELECT FROM u", "INSERT INTO p", "INSERT INTO r")] == [1, 25, 27, 29]


@pytest.mark.parametrize(("call", "read", "write"), [
    ("create({ data: { name: x, profile: { create: { bio: y } } } })", None, ["name", "profile"]),
    ("update({ where: { email: e, OR: [{ a: 1 }] }, data: { ...rest, n: `}${f({ q })}`, s: ')', t } })", ["email", "OR"], ["n", "s", "t"]),
    ("createMany({ data: [{ a: 1, b: 2 }, { c: 3 }] })", None, ["a", "b"]),
    ("upsert({ where: { id }, create: { a, b }, update: { b, c: true } })", ["id"], ["a", "b", "c"]),
    ("findMany({ where: { a: 1 } })", ["*"], None),
    ("findFirst({ select: { a: true, b: { select: { c: true } } }, where: { d: 1 } })", ["a", "b", "d"], None),
    ("deleteMany({ where: { id: 1 } })", ["id"], None),
    ("deleteMany()", None, ["*"]),
    ("create(input)", None, ["*"]),
    ("count()", ["*"], None),
    ("create({ data: { a: '" + "x" * 500 + "' } })", None, ["*"]),
])
def test_prisma_columns_by_method(call, read, write):
    assert patterns.prisma_access(f"db.{'user.'}{call}"[:502], 0) == {"read": read, "write": write}


def test_prisma_columns_of_the_matched_call(spark):
    text = "prisma.user.create({ data: { name: x, profile: { create: { bio: y } } } }); prisma.post.delete({ where: { id: 1 } }); prisma.tag.delete({})"
    rows = {r["pattern_value"]: r["column_access"] for r in patterns.detect(body(spark, text), rules=DATABASE_RULES).collect()}
    assert rows == {"prisma.user.create": (None, ["name", "profile"]), "prisma.post.delete": (["id"], None), "prisma.tag.delete": None}


@pytest.mark.parametrize(("path", "route"), [("app/api/users/route.ts", "/api/users"), ("src/app/api/x/[...all]/route.js", "/api/x/*"), ("lib/route.ts", None)])
def test_routes(spark, path, route):
    assert spark.range(1).select(patterns.next_route(F.lit(path))).first()[0] == route


@pytest.mark.parametrize(("language", "text", "want"), [
    ("typescript", "export async function a(x: number): Promise<T> {\n}\nconst b = (y) => y;\nclass C {\n  m(z) { }\n}", [("a", "FUNCTION", 1, 2), ("b", "ARROW_FUNCTION", 3, 6), ("C", "CLASS", 4, 6), ("m", "METHOD", 5, 5)]),
    ("python", "class K:\n    def m(self):\n        pass\n\ndef _f(a):\n    return 1\n", [("K", "CLASS", 1, 3), ("m", "METHOD", 2, 3), ("_f", "FUNCTION", 5, 6)]),
    ("python", "def one(): return 1\ndef two(): return 2\n", [("one", "FUNCTION", 1, 2), ("two", "FUNCTION", 2, 3)]),
    ("go", "func (s *S) Get(id string) error {\n}\ntype S struct {\n}\nfunc any(x interface{}) {\n}\nfunc open() {\n", [("Get", "METHOD", 1, 2), ("S", "STRUCT", 3, 4), ("any", "FUNCTION", 5, 5), ("open", "FUNCTION", 7, 18)]),
    ("java", "public class A {\n  public int f(String s) throws E {\n    g(s);\n  }\n}\n", [("A", "CLASS", 1, 5), ("f", "METHOD", 2, 4)]),
    ("rust", "pub struct S { }\nimpl S {\n  pub fn go(&self) { }\n}\nfn main() { }\n", [("S", "STRUCT", 1, 1), ("impl S", "IMPL_BLOCK", 2, 4), ("go", "METHOD", 3, 3), ("main", "FUNCTION", 5, 5)]),
    ("csharp", "public class A {\n  public int X { get; set; }\n  public async Task<int> F(int a) { return a; }\n}\n", [("A", "CLASS", 1, 4), ("F", "METHOD", 3, 3)]),
])
def test_units(language, text, want):
    assert [(u[0], u[1], u[2], u[3]) for u in units.units_in(text, language)] == want


def test_models():
    assert list(units.typeorm_models("@Entity()\nexport class User {\n  @Column()\n  a: string;\n}\n", "u.ts")) == []
    orm = "@Entity('users')\nclass User {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @ManyToOne(() => Team)\n  team: Team;\n  @Column()\n  late?: string;\n}\n"
    assert list(units.typeorm_models(orm, "u.ts")) == [("User", "typeorm", "users", [("id", "number", True, True, False, True, None), ("team", "Team", False, True, False, False, "Team")])]
    drizzle = "export const users = pgTable('users', {\n  id: serial('id').primaryKey(),\n  t: text('t').notNull().unique().references(() => teams.id),\n  last: text('x')\n});\n"
    assert list(units.drizzle_models(drizzle, "s.ts")) == [("users", "drizzle", "users", [("id", "serial", True, False, False, False, None), ("t", "text", False, True, True, False, "teams")])]
    mongo = "const userSchema = new Schema({ name: { type: String, required: true }, owner: { type: ObjectId, ref: 'Org' }, n: Number, tags: [String] })"
    assert list(units.mongoose_models(mongo, "m.js")) == [("user", "mongoose", None, [("name", "String", False, True, False, False, None), ("owner", "ObjectId", False, False, False, False, "Org"), ("n", "Number", False, False, False, False, None)])]


def test_sql_is_recorded_twice_in_four_languages(spark):
    rows = [(x, "q(\"SELECT a FROM t\")", x, "f") for x in ("go", "java", "rust", "csharp", "python", "typescript")]
    found = patterns.detect(spark.createDataFrame(rows, "unit_id string, body string, language string, file_path string")).where("pattern_type = 'DATABASE_READ'")
    got = {k: sorted(r["pattern_value"] for r in found.where(F.col("unit_id") == k).collect()) for k in ("go", "csharp", "python", "typescript")}
    assert got == {"go": ["SELECT FROM t", "SELECT a FROM t"], "csharp": ["SELECT FROM t", "SELECT a FROM t"], "python": ["SELECT FROM t"], "typescript": ["SELECT FROM t"]}

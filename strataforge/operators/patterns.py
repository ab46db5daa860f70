"""Framework patterns in code: rule tables and their matching.

Rules are rows. ``detect`` runs those of a text's language over it in one Arrow pass: a hundred
expressions in one plan would cost more to compile than most corpora to read. The first
line wins where a unit has the same type and value again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACCESS, stable_id
from .lines import B, sql_columns


class Rule(NamedTuple):
    """``value`` is a template: {1} a group, {1:u} in upper case, {0} the whole match."""

    languages: tuple[str, ...]
    kind: str
    pattern: str
    value: str


JS = ("javascript", "typescript")
EVERY = ("javascript", "typescript", "python", "go", "java", "rust", "csharp")
Q = r"['\"`]([^'\"`]+)['\"`]"
P = r"['\"]([^'\"]+)['\"]"
D = r"\"([^\"]+)\""
W = r"[A-Za-z0-9_]+"
NAME = r"[A-Z_][A-Z0-9_]*"
VERBS = "get|post|put|patch|delete"
UPPER = "GET|POST|PUT|PATCH|DELETE"
TITLE = "Get|Post|Put|Patch|Delete"

#: Characters before and after the start of a database match that its columns are read from.
LEAD, WINDOW = 10, 500

# fixed values: what is recognised, by language, and the text recorded for it
RULES = (
    Rule(JS, "API_ENDPOINT", rf"{B}(?:app|router|server|fastify|hono)\.({VERBS})\s*\(\s*{Q}", "{1:u} {2}"),
    Rule(JS, "API_ENDPOINT", rf"export\s+(?:async\s+)?function\s+({UPPER})\s*\(", "{1}"),
    Rule(JS, "API_ENDPOINT", rf"@({TITLE})\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)", "{1:u} {2|/}"),
    Rule(JS, "API_CALL", rf"{B}fetch\s*\(\s*['\"`]?([^\s'\"`,)]+)", "{1}"),
    Rule(JS, "API_CALL", rf"axios\.({VERBS}|request)\s*\(\s*['\"`]?([^\s'\"`,)]+)", "{1:u} {2}"),
    Rule(JS, "API_CALL", rf"{B}http\.({VERBS})\s*\(\s*{Q}", "{1:u} {2}"),
    Rule(JS, "DATABASE_READ", rf"{B}{W}\.({W})\.find(?:First|Many|Unique)", "prisma.{1}.find*"),
    Rule(JS, "DATABASE_READ", rf"{B}{W}\.({W})\.count\s*\(", "prisma.{1}.count"),
    Rule(JS, "DATABASE_READ", rf"{B}{W}\.({W})\.aggregate\s*\(", "prisma.{1}.aggregate"),
    Rule(JS, "DATABASE_READ", r"Repository.*\.find(?:ById|Many|One)?\s*\(", "TypeORM find"),
    Rule(JS, "DATABASE_READ", r"\.find(?:ById|One)?\s*\(\s*\{", "Mongoose find"),
    Rule(JS, "DATABASE_WRITE", rf"{B}{W}\.({W})\.((?:create|update|delete)(?:Many)?|upsert)", "prisma.{1}.{2}"),
    Rule(JS, "DATABASE_WRITE", r"Repository.*\.save\s*\(", "TypeORM save"),
    Rule(JS, "DATABASE_WRITE", r"\.save\s*\(\s*\)", "Mongoose save"),
    Rule(JS, "EXTERNAL_SERVICE", rf"new\s+(?:AWS\.)?({W}Client)\s*\(", "AWS {1}"),
    Rule(JS, "EXTERNAL_SERVICE", r"sgMail\.(send)", "sendgrid.{1}"),
    Rule(JS, "EXTERNAL_SERVICE", r"(?i)resend\.(domains|emails)", "resend.{1}"),
    Rule(JS, "ENV_VARIABLE", rf"process\.env\.({NAME})", "{1}"),
    Rule(JS, "ENV_VARIABLE", rf"process\.env\[['\"]({NAME})['\"]\]", "{1}"),
    Rule(JS, "ENV_VARIABLE", rf"import\.meta\.env\.({NAME})", "{1}"),
    Rule(JS, "ENV_VARIABLE", rf"Deno\.env\.get\s*\(\s*['\"]({NAME})['\"]\s*\)", "{1}"),
    Rule(("python",), "API_ENDPOINT", rf"@(?:app|blueprint)\.route\s*\(\s*{P}(?:.*methods\s*=\s*\[([^\]]+)\])?\)", "{2:list|GET} {1}"),
    Rule(("python",), "API_ENDPOINT", rf"@(?:app|router)\.({VERBS})\s*\(\s*{P}", "{1:u} {2}"),
    Rule(("python",), "API_ENDPOINT", r"@api_view\s*\(\s*\[([^\]]+)\]\s*\)", "{1:list}"),
    Rule(("python",), "API_ENDPOINT", rf"(?:re_)?path\s*\(\s*r?{P}", "ROUTE {1}"),
    Rule(("python",), "API_ENDPOINT", rf"class\s+({W}View(?:Set)?)\s*\(", "VIEWSET {1}"),
    Rule(("python",), "API_CALL", rf"requests\.({VERBS}|head|options)\s*\(\s*{P}", "{1:u} {2}"),
    Rule(("python",), "API_CALL", rf"httpx\.({VERBS})\s*\(\s*{P}", "{1:u} {2}"),
    Rule(("python",), "API_CALL", rf"urllib\.request\.urlopen\s*\(\s*{P}", "{1}"),
    Rule(("python",), "DATABASE_READ", rf"({W})\.objects\.(aggregate|all|count|exclude|exists|filter|first|get|last|values(?:_list)?)\s*\(", "{1}.objects.{2}"),
    Rule(("python",), "DATABASE_READ", rf"session\.query\s*\(\s*({W})\s*\)", "session.query({1})"),
    Rule(("python",), "DATABASE_READ", r"session\.execute\s*\(\s*select\s*\(", "session.execute(select(...))"),
    Rule(("python",), "DATABASE_WRITE", rf"({W})\.objects\.((?:bulk_)?(?:create|update)|delete|(?:get|update)_or_create)\s*\(", "{1}.objects.{2}"),
    Rule(("python",), "DATABASE_WRITE", r"\.save\s*\(\s*\)", "model.save()"),
    Rule(("python",), "DATABASE_WRITE", r"session\.(add|bulk_insert_mappings|bulk_save_objects|commit|delete|flush|merge)\s*\(", "session.{1}"),
    Rule(("python",), "EXTERNAL_SERVICE", rf"boto3\.client\s*\(\s*['\"]({W})['\"]", "AWS {1}"),
    Rule(("python",), "ENV_VARIABLE", rf"os\.environ\[['\"]({NAME})['\"]\]", "{1}"),
    Rule(("python",), "ENV_VARIABLE", rf"os\.environ\.get\s*\(\s*['\"]({NAME})['\"]", "{1}"),
    Rule(("python",), "ENV_VARIABLE", rf"os\.getenv\s*\(\s*['\"]({NAME})['\"]", "{1}"),
    Rule(("go",), "API_ENDPOINT", rf"(?:r|router|group|api|v1)\.({UPPER}|HEAD|OPTIONS)\s*\(\s*{D}", "{1} {2}"),
    Rule(("go",), "API_ENDPOINT", rf"(?:e|echo|g|group)\.({UPPER})\s*\(\s*{D}", "{1} {2}"),
    Rule(("go",), "API_ENDPOINT", rf"{B}(?:app|fiber|r|router|mux)\.({TITLE})\s*\(\s*{D}", "{1:u} {2}"),
    Rule(("go",), "API_ENDPOINT", rf"http\.HandleFunc\s*\(\s*{D}", "HANDLE {1}"),
    Rule(("go",), "API_ENDPOINT", rf"\.HandleFunc\s*\(\s*\"({UPPER})\s+([^\"]+)\"", "{1} {2}"),
    Rule(("go",), "API_CALL", rf"http\.(Get|Post|Head)\s*\(\s*{D}", "{1:u} {2}"),
    Rule(("go",), "API_CALL", rf"http\.NewRequest\s*\(\s*\"({W})\"\s*,\s*{D}", "{1} {2}"),
    Rule(("go",), "DATABASE_READ", rf"{B}db\.Query(?:Row)?(?:Context)?\s*\(", "sql.Query"),
    Rule(("go",), "DATABASE_READ", rf"{B}db\.(?:Count|Find|First|Last|Pluck|Scan|Take)\s*\(", "GORM query"),
    Rule(("go",), "DATABASE_READ", rf"{B}db\.Where\s*\(", "GORM Where"),
    Rule(("go",), "DATABASE_WRITE", rf"{B}db\.Exec(?:Context)?\s*\(", "sql.Exec"),
    Rule(("go",), "DATABASE_WRITE", rf"{B}db\.(?:Create|Delete|Save|Unscoped|Updates?)\s*\(", "GORM write"),
    Rule(("go",), "ENV_VARIABLE", rf"os\.Getenv\s*\(\s*\"({NAME})\"\s*\)", "{1}"),
    Rule(("go",), "ENV_VARIABLE", rf"os\.LookupEnv\s*\(\s*\"({NAME})\"\s*\)", "{1}"),
    Rule(("java",), "API_ENDPOINT", rf"@({TITLE})Mapping\s*\(\s*(?:value\s*=\s*)?{P}", "{1:u} {2}"),
    Rule(("java",), "API_ENDPOINT", rf"(?m)@({TITLE})Mapping\s*$", "{1:u} /"),
    Rule(("java",), "API_ENDPOINT", rf"@RequestMapping\s*\(.*?(?:value|path)\s*=\s*{P}.*?(?:method\s*=\s*RequestMethod\.({W}))?\)", "{2|GET} {1}"),
    Rule(("java",), "API_CALL", r"restTemplate\.((?:get|post)For(?:Entity|Object)|exchange)\s*\(", "RestTemplate.{1}"),
    Rule(("java",), "API_CALL", rf"webClient\.({VERBS})\s*\(\)", "WebClient.{1}"),
    Rule(("java",), "DATABASE_READ", r"entityManager\.(find|create(?:Named|Native)?Query)\s*\(", "EntityManager.{1}"),
    Rule(("java",), "DATABASE_READ", rf"repository\.(findBy{W}|findAll|getById|getOne|count|exists)\s*\(", "Repository.{1}"),
    Rule(("java",), "DATABASE_READ", r"(?i)@Query\s*\(\s*[\"']SELECT\s", "@Query SELECT"),
    Rule(("java",), "DATABASE_WRITE", r"entityManager\.(flush|merge|persist|remove)\s*\(", "EntityManager.{1}"),
    Rule(("java",), "DATABASE_WRITE", r"repository\.(save(?:All|AndFlush)?|delete(?:All|ById)?)\s*\(", "Repository.{1}"),
    Rule(("java",), "DATABASE_WRITE", r"(?i)@Query\s*\(\s*[\"'](?:INSERT|UPDATE|DELETE)\s", "@Query modification"),
    Rule(("java",), "ENV_VARIABLE", r"@Value\s*\(\s*[\"']\$\{([^}]+)\}[\"']\s*\)", "{1}"),
    Rule(("java",), "ENV_VARIABLE", rf"System\.getenv\s*\(\s*['\"]({NAME})['\"]\s*\)", "{1}"),
    Rule(("java",), "ENV_VARIABLE", rf"System\.getProperty\s*\(\s*{P}\s*\)", "{1}"),
    Rule(("rust",), "API_ENDPOINT", rf"#\[({VERBS})\s*\(\s*{D}\s*\)\]", "{1:u} {2}"),
    Rule(("rust",), "API_ENDPOINT", rf"\.route\s*\(\s*{D}\s*,\s*({VERBS})\s*\(", "{2:u} {1}"),
    Rule(("rust",), "API_ENDPOINT", rf"web::(resource|scope)\s*\(\s*{D}", "{1:u} {2}"),
    Rule(("rust",), "API_CALL", rf"reqwest::({VERBS})\s*\(\s*{D}", "{1:u} {2}"),
    Rule(("rust",), "DATABASE_READ", r"\.(?:filter|first|get_results?|load|select)\s*[(:]", "diesel.query"),
    Rule(("rust",), "DATABASE_READ", r"sqlx::query(?:_as|_scalar)?[!\s]*[(\[]", "sqlx.query"),
    Rule(("rust",), "DATABASE_READ", r"client\.query\s*\(", "postgres.query"),
    Rule(("rust",), "DATABASE_WRITE", r"diesel::(?:delete|insert_into|update)\s*\(", "diesel.write"),
    Rule(("rust",), "DATABASE_WRITE", r"(?i)sqlx::query.*(?:INSERT|UPDATE|DELETE)", "sqlx.write"),
    Rule(("rust",), "DATABASE_WRITE", r"client\.execute\s*\(", "postgres.execute"),
    Rule(("rust",), "ENV_VARIABLE", rf"env::var\s*\(\s*\"({NAME})\"\s*\)", "{1}"),
    Rule(("rust",), "ENV_VARIABLE", rf"dotenv::var\s*\(\s*\"({NAME})\"\s*\)", "{1}"),
    Rule(("csharp",), "API_ENDPOINT", rf"\[Http({TITLE})\s*(?:\(\s*\"([^\"]*)\"\s*\))?\s*\]", "{1:u} {2}"),
    Rule(("csharp",), "API_ENDPOINT", rf"\[Route\s*\(\s*{D}\s*\)\]", "ROUTE {1}"),
    Rule(("csharp",), "API_ENDPOINT", rf"app\.Map({TITLE})\s*\(\s*{D}", "{1:u} {2}"),
    Rule(("csharp",), "DATABASE_READ", rf"context\.(?:Set<{W}>\s*\(\s*\)|{W})\.(?:Any|Count|Find|(?:First|Single)(?:OrDefault)?|ToArray|ToList)\s*\(", "EF Read"),
    Rule(("csharp",), "DATABASE_READ", r"\.Where\s*\(", "LINQ Where"),
    Rule(("csharp",), "DATABASE_READ", r"\.FromSqlRaw\s*\(", "EF FromSqlRaw"),
    Rule(("csharp",), "DATABASE_WRITE", r"context\.((?:Add|Remove|Update)(?:Range)?)\s*\(", "EF {1}"),
    Rule(("csharp",), "DATABASE_WRITE", r"\.SaveChanges(?:Async)?\s*\(", "EF SaveChanges"),
    Rule(("csharp",), "DATABASE_WRITE", r"\.ExecuteSqlRaw(?:Async)?\s*\(", "EF ExecuteSqlRaw"),
    Rule(("csharp",), "ENV_VARIABLE", rf"Environment\.GetEnvironmentVariable\s*\(\s*\"({NAME})\"\s*\)", "{1}"),
    Rule(("csharp",), "ENV_VARIABLE", rf"Configuration\s*\[\s*{D}\s*\]", "{1}"),
    Rule(("csharp",), "ENV_VARIABLE", rf"\.GetValue<[^>]+>\s*\(\s*{D}\s*\)", "{1}"),
    Rule(("csharp",), "ENV_VARIABLE", rf"\.GetSection\s*\(\s*{D}\s*\)", "{1}"),
)
# fixed values: what every language has; the label stands before what is captured
SHARED = (
    ("DATABASE_READ", rf"(?i){B}SELECT\s+.+?\s+FROM\s+({W})", "SELECT FROM"),
    ("DATABASE_WRITE", rf"(?i){B}INSERT\s+INTO\s+({W})", "INSERT INTO"),
    ("DATABASE_WRITE", rf"(?i){B}UPDATE\s+({W})\s+SET", "UPDATE"),
    ("DATABASE_WRITE", rf"(?i){B}DELETE\s+FROM\s+({W})", "DELETE FROM"),
    ("EXTERNAL_SERVICE", r"(?i)stripe\.(checkout|customers|invoices|paymentIntents|paymentMethods|subscriptions)", "stripe"),
    ("EXTERNAL_SERVICE", r"(?i)openai\.(audio|chat|completions|embeddings|images)", "openai"),
    ("EXTERNAL_SERVICE", r"(?i)twilio\.(calls|messages|verify)", "twilio"),
    ("EXTERNAL_SERVICE", rf"firebase\.({W})\s*\(", "firebase"),
)
# Four languages record the text of such a match as well.
RULES += tuple(Rule(("go", "java", "rust", "csharp"), kind, pattern, "{0}") for kind, pattern, _ in SHARED)
RULES += tuple(Rule(EVERY, kind, pattern, f"{label} {{1}}") for kind, pattern, label in SHARED)


def next_route(path: Column) -> Column:
    """The route of app/api/**/route.ts: catch-all segments become ``*``; null for other files."""
    inner = F.regexp_extract(path, r"(?:\A|/)app(/api(?:/.*)?)/route\.[jt]sx?\z", 1)
    return F.when(inner != "", F.regexp_replace(inner, r"\[\[?\.\.\.[^\]]+\]\]?", "*"))


@cache
def _template(value: str) -> tuple[tuple[str, int, str, str], ...]:
    """A rule's template as (literal, group or -1, form, default)."""
    parts = re.findall(r"([^{}]*)(?:\{(\d)(?::(u|list))?(?:\|([^}]*))?\})?", value)
    return tuple((literal, int(group or -1), form, default) for literal, group, form, default in parts if literal or group)


def _value(m: re.Match, rule: Rule) -> str:
    out = ""
    for literal, group, form, default in _template(rule.value):
        out += literal
        if group >= 0:
            x = m[group] or ""
            if form == "u":
                x = x.upper()
            if form == "list":
                x = re.sub(r"['\"\s]", "", x).replace(",", "|")
            out += x or default
    return out.strip(" ")


def found_in(text: str, language: str | None, route: str | None, rules: tuple[Rule, ...]) -> Iterator[tuple]:
    """(type, value, line, order, Prisma columns, statement) of the first match of each type and value, rule by rule.

    ``route`` is what E13 adds to bare verbs. A database match has the columns of its Prisma call, or the
    code from its start on, which its columns are read from later.
    """
    seen: set[tuple[str, str]] = set()
    for number, rule in enumerate(rules):
        if language not in rule.languages:
            continue
        line, counted = 1, 0
        for i, m in enumerate(re.finditer(rule.pattern, text, re.A)):
            line, counted = line + text.count("\n", counted, m.start()), m.start()
            value = _value(m, rule)
            if route and rule.kind == "API_ENDPOINT" and value in UPPER.split("|"):
                value = f"{value} {route}"
            if (rule.kind, value) in seen:
                continue
            seen.add((rule.kind, value))
            access = statement = None
            if rule.kind.startswith("DATABASE_"):
                lead = min(m.start(), LEAD)
                if value.startswith("prisma."):
                    access = prisma_access(text[m.start() - lead : m.start() + WINDOW], lead)
                else:
                    # A statement starts at its match; the lead would show the end of the one before.
                    statement = text[m.start() : m.start() + WINDOW]
            yield rule.kind, value, line, number * 100_000 + i, access, statement


FOUND = f"pattern_type string, pattern_value string, line_number int, ord long, prisma {ACCESS}, statement string"


def _detect(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.struct([("read", lists), ("write", lists)]), pa.string()]
    for batch in batches:
        at, rows = [], []
        for i, (text, language, route) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
            found = list(found_in(text or "", language, route, rules))
            at += [i] * len(found)
            rows += found
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["key", *[c.split()[0] for c in FOUND.replace(ACCESS, "x").split(", ")]])


def detect(bodies: DataFrame, key: str = "unit_id", text: str = "body", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, pattern_type, pattern_value, line_number, ord, column_access), one for each type and value.

    ``bodies`` has key, text, language and file_path, a row for each key; lines count from the text's
    first. Texts are read once and leave no shuffle behind.
    """
    kind = bodies.schema[key].dataType.simpleString()
    own = bodies.select(F.col(key).alias("key"), text, "language", next_route(F.col("file_path")).alias("route"))
    found = own.mapInArrow(lambda b: _detect(b, rules), f"key {kind}, {FOUND}")
    access = F.when(F.col("statement").isNotNull(), sql_columns(F.col("statement"))).otherwise(F.col("prisma"))
    return found.select(F.col("key").alias(key), "pattern_type", "pattern_value", "line_number", "ord", access.alias("column_access"))


_PRISMA = re.compile(r"\w+\.(\w+)\.(find(?:Many|(?:First|Unique)(?:OrThrow)?)|count|aggregate|create(?:Many)?|update(?:Many)?|delete(?:Many)?|upsert)\s*\(", re.A)
_KEY = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_$]*")
_AFTER_KEY = re.compile(r"\s*(:|\s*[,}\n]|\Z)")
_OPEN, _CLOSE, _QUOTES = "{([", "})]", "\"'`"


def _past_string(code: str, i: int) -> int:
    """The place after the string that starts at i; ${} in a template counts as part of it."""
    quote, i = code[i], i + 1
    while i < len(code):
        if code[i] == "\\":
            i += 2
        elif code[i] == quote:
            return i + 1
        elif quote == "`" and code.startswith("${", i):
            i, depth = i + 2, 1
            while i < len(code) and depth:
                depth += (code[i] == "{") - (code[i] == "}")
                i += 1
        else:
            i += 1
    return i


def _inside(code: str, start: int, pair: str) -> str | None:
    """What stands between the first bracket from start on, within 200 characters, and its partner."""
    begin = code.find(pair[0], start, start + 200)
    if begin < 0:
        return None
    i, depth = begin + 1, 1
    while i < len(code):
        if code[i] in _QUOTES:
            i = _past_string(code, i)
            continue
        depth += (code[i] == pair[0]) - (code[i] == pair[1])
        if not depth:
            return code[begin + 1 : i]
        i += 1
    return None


def _past_value(code: str, i: int) -> int:
    """The place of the comma that ends the value at i, or the end."""
    depth = 0
    while i < len(code) and not (code[i] == "," and depth == 0):
        if code[i] in _QUOTES:
            i = _past_string(code, i)
            continue
        depth += (code[i] in _OPEN) - (code[i] in _CLOSE)
        i += 1
    return i


def _top_keys(body: str) -> list[str]:
    """The keys of an object literal's body, without those of objects in it and without spreads."""
    keys, i = [], 0
    while i < len(body):
        if body[i] in _QUOTES:
            i = _past_string(body, i)
        elif body[i] in _OPEN or body.startswith("...", i):
            i = _past_value(body, i)
        elif key := _KEY.match(body, i):
            i = key.end()
            if after := _AFTER_KEY.match(body, i):
                keys.append(key.group())
                i = _past_value(body, after.end()) if after.group(1) == ":" else i
            else:
                i += 1
        else:
            i += 1
    return [k for k in keys if k not in ("true", "false", "null", "undefined")]


def _keys_of(literal: str, name: str) -> list[str]:
    """Top-level keys of the object, or of the first in a list, that stands at the property ``name``."""
    found = re.search(rf"(?:^|[,{{\s]){name}\s*:", literal)
    value = _inside(literal, found.end(), "{}") if found else None
    return [] if value is None else _top_keys(value)


def prisma_access(code: str, lead: int) -> dict[str, list[str] | None] | None:
    """E14 of the Prisma call that starts at ``lead``, by the rules of its method; None where they give nothing."""
    call = _PRISMA.match(code, lead)
    if call is None:
        return None
    method, star = call.group(2), ["*"]
    reads = method.startswith(("find", "count", "aggregate"))
    argument = (_inside(code, call.end() - 1, "()") or "").strip()
    if not argument.startswith("{"):
        return {"read": star, "write": None} if reads else {"read": None, "write": star}
    keys = lambda name: _keys_of(argument, name)
    if reads:
        select = keys("select")
        return {"read": list(dict.fromkeys(select + keys("where"))) if select else star, "write": None}
    where = None if method.startswith("create") else keys("where") or None
    if method.startswith("delete"):
        return where and {"read": where, "write": None}
    write = keys("create") + keys("update") if method == "upsert" else keys("data")
    return {"read": where, "write": list(dict.fromkeys(write)) or star}


def unit_patterns(bodies: DataFrame, units: DataFrame) -> DataFrame:
    """code_unit_patterns of bodies (unit_id, language, body)."""
    found = detect(bodies.where("body IS NOT NULL").join(units.select(F.col("id").alias("unit_id"), "file_path", "line_start"), "unit_id"))
    return found.join(units.select(F.col("id").alias("unit_id"), "line_start"), "unit_id").select(
        stable_id("unit_id", "pattern_type", "pattern_value").alias("id"), F.col("unit_id").alias("code_unit_id"), "pattern_type", "pattern_value",
        (F.col("line_number") + F.col("line_start") - 1).alias("line_number"), "column_access", F.col("ord").alias("seq"),
    )


def outside_units(patterns: DataFrame, units: DataFrame) -> DataFrame:
    """patterns (file_path, line_number) on lines that no unit of the file covers."""
    spans = units.select(F.col("file_path").alias("__f"), "line_start", "line_end")
    inside = (patterns["file_path"] == spans["__f"]) & patterns["line_number"].between(spans["line_start"], spans["line_end"])
    return patterns.join(spans, inside, "left_anti")


def module_patterns(files: DataFrame, units: DataFrame) -> DataFrame:
    """E10 and F12 over whole files: the patterns at module level."""
    found = detect(files.select(F.col("file_path").alias("unit_id"), "file_path", "language", F.col("content").alias("body")))
    rows = found.select(F.col("unit_id").alias("file_path"), "pattern_type", "pattern_value", "line_number", F.col("ord").alias("seq"))
    return outside_units(rows, units).withColumn("id", stable_id("file_path", "pattern_type", "pattern_value"))

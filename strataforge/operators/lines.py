"""Extractors that look at one line at a time, as DataFrame expressions.

Word boundaries are spelt with look-around on ASCII word characters: Java's ``\\b`` takes
accented letters for word characters, which the languages here don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CALLABLE_TYPES, FIELD_TYPES, stable_id

B = r"(?<![A-Za-z0-9_])"  # a word begins
E = r"(?![A-Za-z0-9_])"  # a word ends
NAME = r"[A-Za-z_$][A-Za-z0-9_]*"
# Where a word begins or, before a dollar sign, ends.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# fixed values: words before a parenthesis that are no calls
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "throw", "typeof", "instanceof", "import", "require", "else", "do", "delete", "void", "in", "of", "case", "yield", "function", "class", "super")
SQL_WORDS = ("AND", "OR", "NOT", "NULL", "TRUE", "FALSE")

# fixed values: what counts towards complexity, by language; overlapping patterns count twice
JS_COUNTS = {
    "conditionals": (rf"{B}if\s*\(", rf"{B}else\s+if\s*\(", rf"{B}switch\s*\(", rf"{B}case\s+", r"\?[^?:]+:"),
    "loops": (rf"{B}for\s*\(", rf"{B}while\s*\(", rf"{B}do\s*\{{", *(rf"\.{m}\s*\(" for m in ("forEach", "map", "filter", "reduce", "find", "some", "every")), rf"{B}for\s*\([^)]*\s+of\s+", rf"{B}for\s*\([^)]*\s+in\s+"),
    "try_catch_blocks": (rf"{B}try\s*\{{", rf"{B}catch\s*\(", rf"{B}finally\s*\{{"),
    "async_patterns": (rf"{B}async\s+", rf"{B}await\s+", r"new\s+Promise\s*\(", r"\.then\s*\(", r"\.catch\s*\(", r"Promise\.(?:all|race|allSettled|any)\s*\("),
}
COUNTS = {
    "javascript": JS_COUNTS,
    "typescript": JS_COUNTS,
    "python": {
        "conditionals": (rf"{B}if\s", rf"{B}elif\s", rf"{B}if\s+.*{B}else{E}"),
        "loops": (rf"{B}for\s+[A-Za-z0-9_]+\s+in\s", rf"{B}while\s"),
        "try_catch_blocks": (rf"{B}try\s*:", rf"{B}except\s", rf"{B}finally\s*:"),
        "async_patterns": (rf"{B}async\s+def", rf"{B}await\s", rf"{B}asyncio\."),
    },
    "go": {
        "conditionals": (rf"{B}if\s", rf"{B}else\s", rf"{B}switch\s", rf"{B}case\s"),
        "loops": (rf"{B}for\s", rf"{B}range\s"),
        "try_catch_blocks": (rf"{B}if\s+err\s*!=\s*nil", rf"{B}defer\s"),
        "async_patterns": (rf"{B}go\s+func", rf"{B}go\s+[A-Za-z0-9_]"),
    },
    "java": {
        "conditionals": (rf"{B}if\s*\(", rf"{B}else\s+if\s*\(", rf"{B}switch\s*\(", rf"{B}case\s+", r"\?[^?:]+:"),
        "loops": (rf"{B}for\s*\(", rf"{B}while\s*\(", rf"{B}do\s*\{{", r"\.forEach\s*\(", r"\.stream\s*\("),
        "try_catch_blocks": (rf"{B}try\s*[({{]", rf"{B}catch\s*\(", rf"{B}finally\s*\{{"),
        "async_patterns": (r"CompletableFuture", r"\.thenApply\s*\(", r"\.thenAccept\s*\(", r"\.thenCompose\s*\("),
    },
    "rust": {
        "conditionals": (rf"{B}if\s", rf"{B}else\s+if\s", rf"{B}else\s*\{{", rf"{B}match\s*\{{", rf"{B}if\s+let\s"),
        "loops": (rf"{B}for\s+[A-Za-z0-9_]+\s+in\s", rf"{B}while\s", rf"{B}while\s+let\s", rf"{B}loop\s*\{{"),
        "try_catch_blocks": (r"\?;", r"\.unwrap\(\)", r"\.expect\s*\("),
        "async_patterns": (rf"{B}async\s+fn", rf"\.await{E}", r"tokio::spawn"),
    },
    "csharp": {
        "conditionals": (rf"{B}if\s*\(", rf"{B}else\s+if\s*\(", rf"{B}switch\s*[({{]", rf"{B}case\s+", r"\?[^?:]+:"),
        "loops": (rf"{B}for\s*\(", rf"{B}foreach\s*\(", rf"{B}while\s*\(", rf"{B}do\s*\{{"),
        "try_catch_blocks": (rf"{B}try\s*\{{", rf"{B}catch\s*[({{]", rf"{B}finally\s*\{{"),
        "async_patterns": (rf"{B}async\s+", rf"{B}await\s+", r"Task\.", r"Task<[A-Za-z0-9_]+>"),
    },
}


def all_groups(text: Column | str, pattern: str, *groups: int) -> Column:
    """Matches of a pattern as an array of structs (g0, g1 ...), from one group each."""
    cols = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    return F.arrays_zip(*cols)


def lines_of(df: DataFrame, body: str = "body") -> DataFrame:
    """One row for each line, numbered from 1."""
    other = [c for c in df.columns if c != body]
    return df.select(*other, F.posexplode(F.split(F.col(body), "\n", -1)).alias("i", "line")).withColumn("line_number", F.col("i") + 1).drop("i")


def without_block_comments(body: Column) -> Column:
    """Block comments become one space and their own line breaks, so lines keep their numbers."""
    pieces = F.split(body, r"/\*", -1)

    tail = F.expr(
        r"""transform(slice(split(body, '/\\*', -1), 2, 1000000), p -> concat(' ', regexp_replace(substring_index(p, '*/', 1), '[^\\n]+', ''),
            CASE WHEN instr(p, '*/') > 0 THEN substring(p, instr(p, '*/') + 2) ELSE '' END))"""
    )
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))


def function_calls(bodies: DataFrame) -> DataFrame:
    """(caller_unit_id, callee_name, line_number, is_async) of bodies (unit_id, body), one for each name and line."""
    line = lines_of(bodies.select("unit_id", without_block_comments(F.col("body")).alias("body"))).where(~F.ltrim("line").startswith("//"))
    text = F.col("line")
    call = lambda names, is_async: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(is_async).alias("is_async")))
    named = lambda a: F.filter(a, lambda n: ~n.isin(*NO_CALL))
    skip = lambda a: F.filter(named(a), lambda n: ~F.substring_index(n, ".", 1).isin(*NO_CALL))
    made = F.transform(F.regexp_extract_all(text, F.lit(rf"{B}new\s+([A-Z_$][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda n: F.concat(F.lit("new "), n))
    awaited = F.regexp_extract_all(text, F.lit(rf"{B}await\s+({NAME}(?:\.{NAME})*)\s*\("), F.lit(1))
    own = F.regexp_extract_all(text, F.lit(rf"{B}(this\.{NAME})\s*\("), F.lit(1))
    method = F.filter(F.regexp_extract_all(text, F.lit(rf"{EDGE}({NAME}\.{NAME})\s*\("), F.lit(1)), lambda n: ~n.startswith("this."))
    plain = F.regexp_extract_all(text, F.lit(rf"{EDGE}(?<!\.)(?<!\.\s)(?<!new\s)(?<!new\s\s)(?<!await\s)({NAME})\s*\("), F.lit(1))
    found = line.select("unit_id", "line_number", F.explode(F.concat(call(made, False), call(named(awaited), True), call(own, False), call(skip(method), False), call(named(plain), False))).alias("c"))
    return found.groupBy(F.col("unit_id").alias("caller_unit_id"), F.col("c.name").alias("callee_name"), "line_number").agg(F.bool_or("c.is_async").alias("is_async"))


def type_fields(bodies: DataFrame) -> DataFrame:
    """(parent_unit_id, name, field_type, is_optional, is_readonly, line_number)."""
    line = lines_of(bodies.select("unit_id", "body"))
    blank = F.col("line").rlike(r"\A\s*([{}]\s*)?\z") | F.ltrim("line").rlike(r"\A(//|/\*|\*)")
    method = F.col("line").rlike(r"\A\s*((public|private|protected|static|async|readonly|override|abstract)\s+)*[A-Za-z0-9_]+\s*(<[^>]*>)?\s*\(")
    shape = r"\A\s*(?:(?:public|private|protected)\s+)?(readonly\s+)?([A-Za-z0-9_]+)(\?)?\s*:\s*(.+?)\s*[;,]?\s*\z"
    part = lambda g: F.regexp_extract("line", shape, g)
    return line.where(~blank & ~method & F.col("line").rlike(shape)).select(
        F.col("unit_id").alias("parent_unit_id"), part(2).alias("name"), F.trim(part(4)).alias("field_type"),
        (part(3) == "?").alias("is_optional"), (part(1) != "").alias("is_readonly"), "line_number",
    )


# fixed values: method, framework, direction, and whether its first argument names the event
EVENT_METHODS = (
    ("dispatch", "redux", "emit", False), ("emit", "node-events", "emit", True), ("addEventListener", "dom-events", "subscribe", True),
    ("addListener", "node-events", "subscribe", True), ("once", "node-events", "subscribe", True), ("on", "node-events", "subscribe", True),
    ("subscribe", "rxjs", "subscribe", False), ("next", "rxjs", "emit", False), ("publish", "pub-sub", "emit", True),
)


def _events(number: int, pattern: str, framework: str, direction: str) -> Column:
    """A rule's matches in a line; receivers named socket speak socket.io."""
    socket = any(f".{m}\\(" in pattern for m in ("emit", "once", "on"))
    kind = lambda receiver: F.when((receiver == "socket") & F.lit(socket), "socket.io").otherwise(framework)
    return F.transform(all_groups("line", pattern, 1, 2, 3), lambda x, n: F.struct(
        F.concat(x["g1"], x["g2"]).alias("event_name"), F.lit(direction).alias("direction"), kind(x["g0"]).alias("framework"), (F.lit(number * 1000) + n).alias("ord")
    ))


def event_flows(bodies: DataFrame, named_only: bool = True) -> DataFrame:
    """(code_unit_id, event_name, direction, framework, line_number, ord); ``ord`` keeps the rules' order in a line."""
    # A name on a later line than its call moves up to it; the breaks between follow.
    joined = F.regexp_replace("body", r"\((\s*\n\s*)new\s+CustomEvent\(", r"(new CustomEvent($1")
    joined = F.regexp_replace(joined, r"\((\s*\n\s*)('[^'\"]*'|\"[^'\"]*\")", "($2$1")
    line = lines_of(bodies.select("unit_id", joined.alias("body"))).where(~F.ltrim("line").rlike(r"\A(//|/\*|\*)"))
    rules = [(r"([A-Za-z0-9_]+)\.dispatchEvent\(\s*new\s+CustomEvent\(\s*(?:'([^'\"]*)'|\"([^'\"]*)\")", "dom-events", "emit", True)]
    rules += [(rf"([A-Za-z0-9_]+)\.{m}\(" + (r"\s*(?:'([^'\"]*)'|\"([^'\"]*)\")" if named else "()()"), f, d, named) for m, f, d, named in EVENT_METHODS]
    found = [_events(i, *rule[:3]) for i, rule in enumerate(rules)]
    rows = line.select(F.col("unit_id").alias("code_unit_id"), "line_number", F.explode(F.concat(*found)).alias("e")).select("code_unit_id", "e.event_name", "e.direction", "e.framework", "line_number", "e.ord")
    return rows.where("event_name <> ''") if named_only else rows


def guard_clauses(bodies: DataFrame) -> DataFrame:
    """(code_unit_id, guard_type, condition, line_number), the first kind that a line matches."""
    word = r"[A-Za-z0-9_]+"
    dotted = rf"{word}(\.{word})*"
    guard = rf"typeof\s+{word}\s*[!=]==?\s*('[^']+'|\"[^\"]+\")|{dotted}\s+instanceof\s+{word}|{dotted}\s*[!=]==?\s*(null|undefined)|!{dotted}"
    line = lines_of(bodies.select("unit_id", "body"))
    text, start = F.col("line"), F.ltrim("line")
    comment = start.startswith("//") | (start.startswith("/*") & start.contains("*/"))
    asserted = text.rlike(rf"{B}assert\s*\(") & ~text.rlike(rf"{B}expect\s*\(")
    test = F.trim(F.regexp_extract(text, rf"{B}if\s*\((.+?)\)\s*return{E}", 1))
    returns, throws = test != "", text.rlike(rf"{B}throw\s+")
    error = F.nullif(F.regexp_extract(text, rf"{B}throw\s+new\s+({word})\s*\(", 1), F.lit(""))
    kind = F.when(asserted, "assertion").when(returns & test.rlike(guard), "type-guard").when(returns, "early-return").when(throws, "throw")
    said = F.when(kind.isin("type-guard", "early-return"), test).when(kind == "throw", F.coalesce(error, F.lit("throw"))).otherwise(kind)
    return line.where(~comment & kind.isNotNull()).select(F.col("unit_id").alias("code_unit_id"), kind.alias("guard_type"), said.alias("condition"), "line_number")


def env_variables(files: DataFrame) -> DataFrame:
    """(file_path, name, description, has_default, line_number); comments right above describe a variable.

    Lines fall into islands: a variable or any other line that is no comment ends one, and
    the comments of an island belong to the variable that ends it.
    """
    line = lines_of(files.select("file_path", F.col("content").alias("body")))
    shape = r"\A([A-Z][A-Z0-9_]*)=(.*)\z"
    comment = F.ltrim("line").startswith("#")
    order = Window.partitionBy("file_path").orderBy("line_number")
    ends = F.sum(F.when(comment, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = line.select("file_path", "line", "line_number", comment.alias("comment"), F.coalesce(ends, F.lit(0)).alias("island"))
    said = F.nullif(F.trim(F.expr("substring(ltrim(line), 2)")), F.lit(""))
    grouped = marked.groupBy("file_path", "island").agg(
        F.array_sort(F.collect_list(F.when(F.col("comment") & said.isNotNull(), F.struct("line_number", said.alias("s"))))).alias("c"),
        F.max_by("line", "line_number").alias("line"), F.max("line_number").alias("line_number"),
    )
    value = F.trim(F.regexp_replace(F.regexp_extract("line", shape, 2), r"\A[\"']|[\"']\z", ""))
    description = F.nullif(F.array_join(F.transform("c", lambda x: x["s"]), " "), F.lit(""))
    return grouped.where(F.col("line").rlike(shape)).select("file_path", F.regexp_extract("line", shape, 1).alias("name"), description.alias("description"), (value != "").alias("has_default"), "line_number")


def join_path(base: Column, target: Column) -> Column:
    """A relative import against the importing file's directory; slashes at its ends and twice in a row stay."""
    folder = F.filter(F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1), lambda p: p != "")
    parts = F.filter(F.split(target, "/"), lambda p: p != ".")
    walked = F.aggregate(parts, folder, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(walked, "/")


def _names(text: Column) -> Column:
    cleaned = F.transform(F.split(F.regexp_replace(text, "[{}]", ""), ","), lambda n: F.regexp_replace(F.trim(F.element_at(F.split(F.trim(n), r"\s+as\s+"), 1)), r"\Atype\s+", ""))
    return F.filter(cleaned, lambda n: (n != "") & (n != "type"))


def js_imports(files: DataFrame) -> DataFrame:
    """(source_file, target_file, import_type, imported_names, seq) of local imports, one for each target and type."""
    quoted, name, t = r"['\"]([^'\"]+)['\"]", r"([A-Za-z_$][A-Za-z0-9_$]*)", F.col("content")
    none = F.array().cast("array<string>")

    def form(order: int, kind: str, pattern: str, path: int, names) -> Column:
        groups = (1, path) if path > 1 else (1, 1)
        return F.transform(all_groups(t, pattern, *groups), lambda x, i: F.struct(x["g1"].alias("path"), F.lit(kind).alias("type"), names(x["g0"]).alias("names"), (F.lit(order * 1_000_000) + i).alias("seq")))

    one = lambda n: F.array(n)
    empty = lambda n: none
    declared = r"(?:const|let|var)\s+"
    forms = [
        form(0, "NAMED", rf"import\s*\{{([^}}]+)\}}\s*from\s*{quoted}", 2, _names),
        form(1, "DEFAULT", rf"import\s+(?!type\s|typeof\s){name}\s+from\s*{quoted}", 2, one),
        form(2, "NAMESPACE", rf"import\s*\*\s*as\s+{name}\s+from\s*{quoted}", 2, one),
        form(3, "NAMED", rf"{declared}(\{{[^}}]+\}})\s*=\s*require\s*\(\s*{quoted}\s*\)", 2, _names),
        form(4, "DEFAULT", rf"{declared}{name}\s*=\s*require\s*\(\s*{quoted}\s*\)", 2, one),
        form(5, "DYNAMIC", rf"import\s*\(\s*{quoted}\s*\)", 1, empty),
        form(6, "NAMED", rf"export\s*(?:\{{[^}}]*\}}|\*)\s*from\s*{quoted}", 1, empty),
    ]
    each = files.select(F.col("file_path").alias("source_file"), F.explode(F.concat(*forms)).alias("x")).select("source_file", "x.*")
    local = each.where(F.col("path").startswith(".") | F.col("path").startswith("/"))
    local = local.withColumn("target_file", join_path(F.col("source_file"), F.col("path"))).where("target_file <> '' AND NOT contains(target_file, 'node_modules')")
    first = local.groupBy("source_file", "target_file", F.col("type").alias("import_type")).agg(F.min_by("names", "seq").alias("imported_names"), F.min("seq").alias("seq"))
    return first


def sql_columns(sql: Column) -> Column:
    """E14 for SQL text: struct(read, write) of column names; ``*`` where they can't be told; null for other text."""
    last = lambda c: F.trim(F.element_at(F.split(F.trim(c), r"\."), -1))
    source = lambda c: F.coalesce(F.nullif(F.regexp_extract(F.trim(c), r"(?i)\A(.+?)\s+(?:AS\s+)?[A-Za-z0-9_]+\z", 1), F.lit("")), F.trim(c))
    star = lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("*")))
    listed = F.regexp_extract(sql, r"(?is)SELECT\s+(.+?)\s+FROM\s", 1)
    selected = F.filter(F.transform(F.split(listed, ","), lambda c: last(source(c))), lambda c: (c != "") & (c != "*"))
    inside = F.regexp_extract(sql, r"(?s)\(([^()]*)\)", 1)
    inserted = F.filter(F.transform(F.split(inside, ","), lambda c: F.trim(F.regexp_replace(c, r"[\"`\[\]]", ""))), lambda c: c != "")
    assigned = F.regexp_extract(sql, r"(?is)SET\s+(.+?)(?:\s+WHERE\s|\z)", 1)
    written = F.filter(F.transform(F.split(assigned, ","), lambda c: F.regexp_extract(F.trim(c), r"\A[\"`]?([A-Za-z0-9_]+)[\"`]?\s*=", 1)), lambda c: c != "")
    where = F.regexp_extract(sql, r"(?is)WHERE\s+(.+?)(?:;|\s*\z|\s+ORDER|\s+LIMIT)", 1)
    tested = F.regexp_extract_all(where, F.lit(r"(?i)[\"`]?([A-Za-z0-9_]+)[\"`]?\s*(?:=|!=|<>|>=|<=|>|<|LIKE|IN|IS|BETWEEN)"), F.lit(1))
    tested = F.array_distinct(F.filter(tested, lambda c: ~F.upper(c).isin(*SQL_WORDS)))
    some = lambda a: F.when(F.size(a) > 0, a)
    no = F.lit(None).cast("array<string>")
    out = lambda r, w: F.struct(r.alias("read"), w.alias("write"))
    return (
        F.when(sql.rlike(rf"(?i){B}SELECT\s+"), out(star(selected), no))
        .when(sql.rlike(rf"(?i){B}INSERT\s+INTO\s+"), out(no, star(inserted)))
        .when(sql.rlike(rf"(?i){B}UPDATE\s+[A-Za-z0-9_]+\s+SET{E}"), out(some(tested), star(written)))
        .when(sql.rlike(rf"(?i){B}DELETE\s+FROM\s+") & (F.size(tested) > 0), out(tested, no))
    )


def counts(body: Column, language: Column) -> dict[str, Column]:
    """Pattern counts of a body by its language."""
    out = {}
    for metric in JS_COUNTS:
        value = F.lit(0)
        for name, rules in COUNTS.items():
            total = sum((F.regexp_count(body, F.lit(p)) for p in rules[metric]), F.lit(0))
            value = F.when(language == name, total).otherwise(value)
        out[metric] = value
    return out


def callback_depth(body: Column) -> Column:
    """The longest run of then and catch calls over lines that aren't broken by other code."""
    per_line = F.transform(F.split(body, "\n", -1), lambda s: F.struct(F.regexp_count(s, F.lit(r"\.(then|catch)\s*\(")).alias("n"), ((F.trim(s) != "") & ~s.contains("//")).alias("code")))
    return F.aggregate(per_line, F.struct(F.lit(0).alias("run"), F.lit(0).alias("top")), lambda a, x: F.struct(
        F.when(x["n"] > 0, a["run"] + x["n"]).when(x["code"], 0).otherwise(a["run"]).alias("run"),
        F.greatest(a["top"], F.when(x["n"] > 0, a["run"] + x["n"]).otherwise(0)).alias("top"),
    ), lambda a: a["top"])


def nesting_depth(body: Column) -> Column:
    """The deepest brace nesting outside strings and comments."""
    # A string ends at its quote unless a backslash stands before it; lines don't end it.
    strings = "|".join(rf"{q}[^{q}]*(?:(?<=\\){q}[^{q}]*)*(?:{q}|\z)" for q in ('"', "'", "`"))
    bare = F.regexp_replace(body, rf"(?s)/\*.*?(?:\*/|\z)|//[^\n]*|{strings}", "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    return F.aggregate(braces, F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")), lambda a, c: F.struct(
        F.greatest(F.lit(0), a["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("at"), F.greatest(a["top"], a["at"] + F.when(c == "{", 1).otherwise(0)).alias("top")
    ), lambda a: a["top"])


def parameter_count(signature: Column) -> Column:
    """E15d: commas outside brackets, plus one if there is anything; a return type after the list counts too."""
    inner = F.trim(F.regexp_replace(F.coalesce(signature, F.lit("")), r"\A\(|\)\z", ""))
    chars = F.split(inner, "")
    commas = F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(0).alias("n")), lambda a, c: F.struct(
        (a["d"] + F.when(c.isin("{", "[", "<", "("), 1).when(c.isin("}", "]", ">", ")"), -1).otherwise(0)).alias("d"),
        (a["n"] + F.when((c == ",") & (a["d"] == 0), 1).otherwise(0)).alias("n"),
    ), lambda a: a["n"])
    return F.when(inner == "", 0).otherwise(commas + F.when(inner.rlike(r"[^ :,})\]>]"), 1).otherwise(0))


def complexity(body: Column, language: Column, signature: Column) -> Column:
    """The eight metrics as a struct."""
    n = counts(body, language)
    return F.struct(
        n["conditionals"].cast("int").alias("conditionals"), n["loops"].cast("int").alias("loops"), nesting_depth(body).cast("int").alias("max_nesting_depth"),
        n["try_catch_blocks"].cast("int").alias("try_catch_blocks"), n["async_patterns"].cast("int").alias("async_patterns"), callback_depth(body).cast("int").alias("callback_depth"),
        parameter_count(signature).cast("int").alias("parameter_count"), F.size(F.split(body, "\n", -1)).cast("int").alias("line_count"),
    )


def complexity_score(c: Column) -> Column:
    """E16."""
    f = lambda name: c[name].cast("double")
    raw = (
        f("conditionals") * 2 + f("loops") * 3 + F.pow(f("max_nesting_depth"), F.lit(1.5)) * 3 + f("try_catch_blocks") * 2 + f("async_patterns") * 1.5
        + f("callback_depth") * 3 + F.greatest(f("parameter_count") - 3, F.lit(0.0)) * 2 + F.floor(f("line_count") / 30)
    )
    return F.floor(raw + 0.5).cast("double")


def complexity_level(score: Column) -> Column:
    return F.when(score <= 15, "simple").when(score <= 35, "moderate").otherwise("complex")


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    """E17."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")


def deep_rows(bodies: DataFrame) -> dict[str, DataFrame]:
    """Calls, events and guards of callables, and fields of types, as catalog tables."""
    run = bodies.where(F.col("body").isNotNull() & F.col("unit_type").isin(*CALLABLE_TYPES))
    held = bodies.where(F.col("body").isNotNull() & F.col("unit_type").isin(*FIELD_TYPES))
    calls = function_calls(run)
    return {
        "function_calls": calls.select(stable_id("caller_unit_id", "callee_name", "line_number").alias("id"), "caller_unit_id", "callee_name", F.lit(None).cast("string").alias("callee_file_path"), F.lit(None).cast("string").alias("callee_unit_id"), "line_number", "is_async", F.col("line_number").cast("long").alias("seq")),
        "event_flows": event_flows(run).select(stable_id("code_unit_id", "line_number", "ord").alias("id"), "code_unit_id", "event_name", "direction", "framework", "line_number"),
        "guard_clauses": guard_clauses(run).select(stable_id("code_unit_id", "line_number").alias("id"), "code_unit_id", "guard_type", "condition", "line_number"),
        "type_fields": type_fields(held).select(stable_id("parent_unit_id", "name", "line_number").alias("id"), "parent_unit_id", "name", "field_type", "is_optional", "is_readonly", "line_number"),
    }


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded down."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2 / 4).cast("long")

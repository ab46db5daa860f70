"""Token-budgeted reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import graph
from ..operators.lines import token_estimate
from ..schemas import CALLABLE_TYPES

TOTAL_TOKENS = 10_000
#: Parts of the budget in percent.
SHARES = {"MODULES": 25, "PATTERNS": 25, "DEPENDENCIES": 15, "SCHEMA": 15, "HOTSPOTS": 20}
SCORED_PATTERNS = ("API_ENDPOINT", "DATABASE_READ", "DATABASE_WRITE", "EXTERNAL_SERVICE")
MANY_PATTERNS = 3
TOP = 10
# fixed values: the word for a unit type
TYPE_WORDS = {
    "FUNCTION": "function", "ARROW_FUNCTION": "function", "CLASS": "class", "METHOD": "method", "STRUCT": "struct", "TRAIT": "trait", "INTERFACE": "interface",
    "ENUM": "enum", "IMPL_BLOCK": "impl", "TYPE_ALIAS": "type", "MODULE": "module",
}


def budgets(total: int = TOTAL_TOKENS) -> dict[str, int]:
    return {k: total * v // 100 for k, v in SHARES.items()}


def truncate(text: DataFrame, max_tokens: int) -> DataFrame:
    """(key, line_number, line) of each text's (key, content) longest run of whole lines within the budget."""
    line = text.select("key", F.posexplode(F.split("content", "\n", -1)).alias("line_number", "line"))
    used = F.sum(F.length("line") + 1).over(Window.partitionBy("key").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("used", used).where(F.col("used") <= max_tokens * 4 + 1).drop("used")


def fit(sections: DataFrame, max_tokens: int, used: int = 0) -> tuple[DataFrame, int, int]:
    """Sections (content, score, seq) that fit, best first, going on past those that don't.

    What is packed depends on all before, so sizes stream in order to the driver, two
    numbers a section, until not even the smallest fits; sections without a token always
    do and are not sent. At most ``max_tokens`` are listed. Returns sections, tokens used, omitted.
    """
    sized = sections.select("seq", "score", token_estimate(F.col("content")).alias("tokens"))
    facts = sized.agg(F.count_if(F.col("tokens") > 0).alias("n"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).first()
    taken = []
    for r in sized.where("tokens > 0").orderBy(F.desc("score"), "seq").toLocalIterator():
        if used + facts["least"] > max_tokens:
            break
        if used + r["tokens"] <= max_tokens:
            taken.append((r["seq"],))
            used += r["tokens"]
    listed = sections.sparkSession.createDataFrame(taken, "seq long").withColumn("__taken", F.lit(True))
    kept = sections.join(F.broadcast(listed), "seq", "left").where((token_estimate(F.col("content")) == 0) | F.col("__taken")).select(sections.columns)
    return kept, used, facts["n"] - len(taken)


def render(header: str, sections: DataFrame, max_tokens: int) -> str:
    """Header, what fits, and a line on what doesn't."""
    size = len(header.encode("utf-16-le")) // 2 // 4
    if size > max_tokens:
        return header[: max_tokens * 4]
    kept, _, omitted = fit(sections, max_tokens, size)
    body = "".join(r["content"] for r in kept.orderBy(F.desc("score"), "seq").collect())  # at most the budget
    return header + body + (f"\n_{omitted} more files available via MCP tools_" if omitted else "")


def _tokens(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2 // 4


def _append(out: str, header: str, sections: DataFrame, max_tokens: int) -> str:
    left = max_tokens - _tokens(out)
    if left <= 0 or sections.isEmpty():
        return out
    more = render(header, sections, left)
    return out if more == header else out + more


def _joined(order: str | Column, line: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order if isinstance(order, Column) else F.col(order), line.alias("line")))), lambda x: x["line"]), sep)


def _section(title: str, lines: DataFrame, order: str | Column, max_tokens: int, score: float | None, seq: int, end: str = "\n", counted: Column | None = None) -> DataFrame:
    """One section of all lines (line), scored by their number or those ``counted``; none if there are none.

    A section beyond the budget is left out whatever it says, so its lines are not joined: blanks
    of that length stand for them, and what one task joins is bounded by the budget.
    """
    facts = lines.agg((F.count("*") if counted is None else F.count_if(counted)).alias("n"), F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).alias("size")).where("n > 0")
    fits = F.col("size") <= 8 * max_tokens
    text = lines.crossJoin(F.broadcast(facts.where(fits).select("n"))).agg(_joined(order, F.col("line")).alias("t"), F.count("*").alias("k"))
    whole = facts.crossJoin(F.broadcast(text)).withColumn("text", F.when(fits, F.col("t")).otherwise(F.lit(" " * (8 * max_tokens + 8))))
    number = F.col("n").cast("double") if score is None else F.lit(score)
    return whole.select(F.concat(F.lit(f"## {title}\n"), "text", F.lit(end)).alias("content"), number.alias("score"), F.lit(seq).cast("long").alias("seq"))


def module_scores(c: Catalog) -> DataFrame:
    """(file_path, score): 3 an exported unit, 2 a scored pattern, 1 a complex unit, 1 an importer."""
    top = c.units_top
    own = top.groupBy("file_path").agg((3 * F.count_if("is_exported") + F.count_if(F.col("complexity_score") >= 15)).alias("u"))
    pats = c["code_unit_patterns"].where(F.col("pattern_type").isin(*SCORED_PATTERNS)).join(top.select(F.col("id").alias("code_unit_id"), "file_path"), "code_unit_id")
    p = pats.groupBy("file_path").agg((2 * F.count("*")).alias("p"))
    d = c["file_dependencies"].groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("d"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return own.join(p, "file_path", "left").join(d, "file_path", "left").select("file_path", (F.col("u") + zero(F.col("p")) + zero(F.col("d"))).alias("score"))


def unit_line(prefix: str = "- ") -> Column:
    words = F.create_map(*[x for k, v in TYPE_WORDS.items() for x in (F.lit(k), F.lit(v))])
    signature = F.when(F.col("is_exported"), F.coalesce("signature", F.lit(""))).otherwise("")
    spaced = F.when((signature != "") & ~signature.startswith("("), F.concat(F.lit(" "), signature)).otherwise(signature)
    number = F.regexp_replace(F.col("complexity_score").cast("string"), r"\.0\z", "")
    return F.concat(
        F.lit(prefix + "`"), F.col("name"), F.lit("` - "), F.when(F.col("is_async"), "async ").otherwise(""), F.coalesce(words[F.col("unit_type")], F.lit("unknown")), spaced,
        F.when(F.col("complexity_score") > 0, F.concat(F.lit(", complexity: "), number)).otherwise(""),
    )


def modules(c: Catalog, max_tokens: int) -> str:
    """R05."""
    top = c.units_top
    children = c.units_flat.where("parent_unit_id IS NOT NULL").groupBy(F.col("parent_unit_id").alias("id")).agg(_joined("seq", unit_line("  - ")).alias("below"))
    field = F.concat(F.lit("  - "), F.when(F.col("is_readonly"), "readonly ").otherwise(""), "name", F.when(F.col("is_optional"), "?").otherwise(""), F.lit(": "), "field_type", F.when(F.col("is_optional"), " (optional)").otherwise(""))
    fields = c["type_fields"].groupBy(F.col("parent_unit_id").alias("id")).agg(_joined("line_number", field).alias("held"))
    rows = top.join(children, "id", "left").join(fields, "id", "left").withColumn("text", F.concat_ws("\n", unit_line(), "held", "below"))
    types = c["code_unit_patterns"].join(top.select(F.col("id").alias("code_unit_id"), "file_path"), "code_unit_id").groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("pattern_type")), ", ").alias("types"))
    text = rows.groupBy("file_path").agg(_joined("seq", F.col("text")).alias("text"), F.min("seq").alias("seq")).join(types, "file_path", "left").join(module_scores(c), "file_path")
    content = F.concat(F.lit("## "), "file_path", F.lit("\n"), "text", F.coalesce(F.concat(F.lit("\n- Patterns: "), "types"), F.lit("")), F.lit("\n"))
    out = render("# Modules\n", text.select(content.alias("content"), F.col("score").cast("double").alias("score"), "seq"), max_tokens)
    members = c["file_cluster_members"]
    counts = members.join(top.select("id", "file_path"), "file_path").join(c["code_unit_patterns"].select(F.col("code_unit_id").alias("id"), "pattern_type"), "id").groupBy("cluster_id", "pattern_type").agg(F.count("*").alias("n"))
    best = counts.withColumn("i", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "pattern_type"))).where("i <= 5")
    shown = best.groupBy("cluster_id").agg(_joined("i", F.concat(F.col("pattern_type"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")), ", ").alias("top"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_entry_point"), F.col("file_path")))), ", ").alias("entries"))
    area = c["file_clusters"].withColumnRenamed("id", "cluster_id").join(sizes, "cluster_id").join(shown, "cluster_id", "left")
    content = F.concat(
        F.lit("### "), "name", F.lit(" (cohesion: "), F.format_string("%.2f", "cohesion"), F.lit(", "), F.col("n").cast("string"), F.lit(" files)\n"),
        F.when(F.col("entries") != "", F.concat(F.lit("Entry points: "), "entries", F.lit("\n"))).otherwise(""), F.coalesce(F.concat(F.lit("Top patterns: "), "top", F.lit("\n")), F.lit("")),
    )
    return _append(out, "\n## Feature Areas (Import Graph Clusters)\n\n", area.select(content.alias("content"), F.col("n").cast("double").alias("score"), F.xxhash64("cluster_id").alias("seq")), max_tokens)


def patterns(c: Catalog, max_tokens: int) -> str:
    """R06."""
    top = c.units_top.select(F.col("id").alias("code_unit_id"), "file_path", "name", F.col("seq").alias("useq"))
    rows = c["code_unit_patterns"].join(top, "code_unit_id").withColumn("line", F.concat(F.lit("- "), "pattern_value", F.lit(" - "), "file_path", F.lit(":"), "name"))

    def group(title: str, kinds: tuple[str, ...], seq: int) -> DataFrame:
        found = rows.where(F.col("pattern_type").isin(*kinds)).select("pattern_type", "useq", "seq", "line")
        if len(kinds) > 1:
            # Reads come before writes; each part begins with its title.
            heads = found.select("pattern_type").distinct().select("pattern_type", F.lit(None).cast("long").alias("useq"), F.lit(None).cast("long").alias("seq"), F.when(F.col("pattern_type") == "DATABASE_READ", "### Reads").otherwise("### Writes").alias("line"))
            found = found.unionByName(heads)
        return _section(title, found, F.struct("pattern_type", "useq", "seq"), max_tokens, None, seq, counted=F.col("useq").isNotNull())

    parts = group("API Endpoints", ("API_ENDPOINT",), 0)
    for i, (title, kinds) in enumerate((("Database Operations", ("DATABASE_READ", "DATABASE_WRITE")), ("External Services", ("EXTERNAL_SERVICE",)), ("API Calls", ("API_CALL",))), 1):
        parts = parts.unionByName(group(title, kinds, i))
    env = c["env_variables"].withColumn("line", F.concat(F.lit("- "), "name", F.coalesce(F.concat(F.lit(" - "), "description"), F.lit(""))))
    parts = parts.unionByName(_section("Environment Variables", env, "name", max_tokens, None, 4))
    line = F.concat(F.lit("- "), "event_name", F.lit(" ("), "direction", F.lit(", "), "framework", F.lit(") - "), "file_path", F.lit(":"), "name")
    flows = c["event_flows"].join(top, "code_unit_id").withColumn("line", line)
    parts = parts.unionByName(_section("Event Flows", flows, F.struct("useq", "line_number", "event_name"), max_tokens, None, 5))
    out = render("# Patterns\n\n", parts, max_tokens)
    t = c["pattern_templates"]
    content = F.concat(F.lit("### "), "name", F.lit("\n"), "description", F.lit("\nExample: "), "template_file_path", F.lit("\n"), F.array_join(F.transform("conventions", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))
    return _append(out, "\n## Conventions (Recurring Pattern Combinations)\n\n", t.select(content.alias("content"), F.col("follower_count").cast("double").alias("score"), F.xxhash64("id").alias("seq")), max_tokens)


def hubs(c: Catalog) -> DataFrame:
    """Files that two or more import."""
    return c["file_dependencies"].groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("importers")).where("importers >= 2")


def dependencies(c: Catalog, max_tokens: int) -> str:
    """R07."""
    d = c["file_dependencies"]
    hub = hubs(c).withColumn("line", F.concat(F.lit("- "), "file_path", F.lit(" (imported by "), F.col("importers").cast("string"), F.lit(" files)")))
    top = _section("Hub Files (most imported)", hub, F.struct((-F.col("importers")).alias("k"), "file_path"), max_tokens, 100.0, -(1 << 62), "\n\n")
    per = d.groupBy("source_file").agg(_joined("target_file", F.concat(F.lit("  → "), "target_file")).alias("t"), F.count("*").alias("n"))
    own = per.select(F.concat("source_file", F.lit("\n"), "t", F.lit("\n\n")).alias("content"), F.col("n").cast("double").alias("score"), F.xxhash64("source_file").alias("seq"))
    out = render("# Dependencies\n", top.unionByName(own), max_tokens)
    loops = graph.cycles(graph.edges_of(d)).withColumn("i", F.row_number().over(Window.orderBy("length", F.col("component").cast("string"))))
    content = F.concat(F.lit("### Cycle "), F.col("i").cast("string"), F.lit(" ("), F.col("length").cast("string"), F.lit(" files)\n"), F.array_join("path", " → "), F.lit("\n\n"))
    return _append(out, "\n## Circular Dependencies\n\n", loops.select(content.alias("content"), (101 - F.col("i")).cast("double").alias("score"), F.col("i").cast("long").alias("seq")), max_tokens)


def hotspots(c: Catalog) -> dict[str, DataFrame]:
    """The four lists."""
    top = c.units_top
    run = top.where(F.col("unit_type").isin(*CALLABLE_TYPES))
    level = F.when(F.col("complexity_score") >= 30, "complex").when(F.col("complexity_score") >= 15, "moderate").otherwise("simple")
    kinds = c["code_unit_patterns"].groupBy(F.col("code_unit_id").alias("id")).agg(F.array_sort(F.collect_set("pattern_type")).alias("types")).where(F.size("types") >= MANY_PATTERNS)
    fan = c["function_calls"].groupBy(F.col("caller_unit_id").alias("id")).agg(F.count("*").alias("calls"))
    return {
        "complex": run.where("complexity_score > 0").select("id", "name", "file_path", "complexity_score", level.alias("level")).orderBy(F.desc("complexity_score"), "id").limit(TOP),
        "critical": run.join(kinds, "id").select("id", "name", F.array_join("types", ", ").alias("types"), "seq").orderBy("seq", "id"),
        "files": top.groupBy("file_path").agg(F.count("*").alias("units")).orderBy(F.desc("units"), "file_path").limit(TOP),
        "fan_out": fan.join(c.units_flat.select("id", "name", "file_path"), "id").orderBy(F.desc("calls"), "id").limit(TOP),
    }


def hotspot_report(c: Catalog, max_tokens: int) -> str:
    """R08."""
    h = hotspots(c)
    number = F.regexp_replace(F.col("complexity_score").cast("string"), r"\.0\z", "")
    order = Window.orderBy(F.desc("complexity_score"), "id")
    first = h["complex"].withColumn("i", F.row_number().over(order)).withColumn("line", F.concat(F.col("i").cast("string"), F.lit(". `"), "name", F.lit("` ("), "file_path", F.lit(") - score: "), number, F.lit(" ("), "level", F.lit(")")))
    lists = (
        ("Most Complex Functions", first, F.struct("i")),
        ("Critical Paths (functions with many patterns)", h["critical"].withColumn("line", F.concat(F.lit("- `"), "name", F.lit("` - "), "types")), F.struct("seq", "id")),
        ("Files with Most Code Units", h["files"].withColumn("line", F.concat(F.lit("- "), "file_path", F.lit(" ("), F.col("units").cast("string"), F.lit(" units)"))), F.struct((-F.col("units")).alias("k"), "file_path")),
        ("High Fan-Out Functions", h["fan_out"].withColumn("line", F.concat(F.lit("- `"), "name", F.lit("` ("), "file_path", F.lit(") - "), F.col("calls").cast("string"), F.lit(" calls"))), F.struct((-F.col("calls")).alias("k"), "id")),
    )
    parts = None
    for i, (title, rows, key) in enumerate(lists):
        one = _section(title, rows, key, max_tokens, float(max(1, 3 - i)), i)
        parts = one if parts is None else parts.unionByName(one)
    return render("# Hotspots\n\n", parts, max_tokens)


def schema_sections(c: Catalog) -> DataFrame:
    """(content, score, seq), a section for each model."""
    flags = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_primary_key"), "PK"), F.when(F.col("is_required"), "required"), F.when(F.col("is_unique"), "unique"), F.when(F.col("has_default"), "default"),
        F.concat(F.lit("→ "), "relation_target"),
    )), ", ")
    line = F.concat(F.lit("- "), "name", F.lit(": "), "field_type", F.when(flags != "", F.concat(F.lit(" ("), flags, F.lit(")"))).otherwise(""))
    fields = c["schema_model_fields"].groupBy(F.col("model_id").alias("id")).agg(_joined("name", line).alias("t"), F.count("*").alias("n"))
    text = F.concat(F.lit("## "), "name", F.lit(" ("), "framework", F.lit(")\n"), F.coalesce(F.concat(F.lit("Table: "), "table_name", F.lit("\n")), F.lit("")), F.coalesce(F.concat("t", F.lit("\n")), F.lit("")))
    return c["schema_models"].join(fields, "id", "left").select(text.alias("content"), F.coalesce("n", F.lit(0)).cast("double").alias("score"), F.xxhash64("id").alias("seq"))


def generate(c: Catalog, total: int = TOTAL_TOKENS) -> dict[str, str]:
    """The five reports by name."""
    b = budgets(total)
    return {
        "MODULES": modules(c, b["MODULES"]), "PATTERNS": patterns(c, b["PATTERNS"]), "DEPENDENCIES": dependencies(c, b["DEPENDENCIES"]),
        "SCHEMA": render("# Schema\n\n", schema_sections(c), b["SCHEMA"]), "HOTSPOTS": hotspot_report(c, b["HOTSPOTS"]),
    }


def write(c: Catalog, folder: str, total: int = TOTAL_TOKENS) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, text in generate(c, total).items():
        (Path(folder) / f"{name}.md").write_text(text, encoding="utf-8")



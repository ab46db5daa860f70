"""The twenty query tools and their HTTP twins as functions of a catalog.

Each takes a catalog and arguments and returns DataFrames; nothing is collected except
the handful of values an argument must be resolved to. Order is total: every sort ends
with a unique key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import graph, patterns, ranking
from ..operators.lines import slice_lines
from ..operators.units import bodies_of, test_structure, units_with_bodies
from ..sources.files import with_file_columns
from ..sources.settings import Settings


class ToolError(ValueError):
    """A missing argument or something that isn't there, in words for the caller."""


@dataclass
class Result:
    """A page of rows and what is known about the whole."""

    rows: DataFrame
    total: DataFrame | None = None
    context: dict[str, str] | None = None
    parts: dict[str, DataFrame] | None = None

    def response(self) -> str:
        """The envelope as JSON: data and meta; nulls are left out."""
        data = [json.loads(x) for x in self.rows.toJSON().collect()]
        meta: dict[str, Any] = {"result_count": len(data)}
        if self.total is not None:
            meta["total_count"] = self.total.first()[0]
            meta["has_more"] = meta["total_count"] > len(data)
        if self.context and not data:
            meta["context"] = self.context
        out: dict[str, Any] = {"data": data, "meta": meta}
        for name, df in (self.parts or {}).items():
            out[name] = [json.loads(x) for x in df.toJSON().collect()]
        return json.dumps(out)


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> Result:
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return Result(ordered.limit(limit) if limit is not None else ordered, df.agg(F.count("*").alias("total")))


def with_source(c: Catalog, rows: DataFrame, wanted: bool = True, name: str = "source") -> DataFrame:
    """Rows (file_path, line_start, line_end) with the lines they stand for; null where the file isn't there."""
    if not wanted:
        return rows
    texts = c["files"].select(F.col("file_path").alias("__path"), F.col("content").alias("__content"))
    cut = slice_lines(F.col("__content"), F.col("line_start"), F.col("line_end"))
    return rows.join(texts, F.col("file_path") == F.col("__path"), "left").withColumn(name, cut).drop("__path", "__content")


def sources_of(c: Catalog, key: str) -> DataFrame:
    """(key, source) of all units, to be joined where a row points at one."""
    return with_source(c, c.units_flat.select(F.col("id").alias(key), "file_path", "line_start", "line_end")).select(key, "source")


def stats(c: Catalog) -> DataFrame:
    """Q01: counts over top-level units, with languages as a sorted list of language=count."""
    top = c.units_top
    one = top.agg(F.count("*").alias("code_units"), F.count_distinct("file_path").alias("files"))
    pats = c["code_unit_patterns"].join(top.select(F.col("id").alias("code_unit_id")), "code_unit_id", "left_semi").agg(F.count("*").alias("patterns"))
    deps = c["file_dependencies"].agg(F.count("*").alias("dependencies"))
    env = c["env_variables"].agg(F.count("*").alias("env_variables"))
    parts = c["file_clusters"].agg(F.count("*").alias("clusters"))
    langs = top.groupBy("language").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", F.col("n").cast("string")))), ",").alias("languages"))
    out = one
    for x in (pats, deps, env, parts, langs):  # one row each
        out = out.crossJoin(F.broadcast(x))
    return out


def project_stats(c: Catalog, settings: Settings) -> DataFrame:
    """The counts with the project's name."""
    return stats(c).withColumn("project_name", F.lit(settings.project_name))


def module_overview(c: Catalog, language: str | None = None, limit: int = 50, offset: int = 0) -> Result:
    """Q02: files with their units in order."""
    top = c.units_top if language is None else c.units_top.where(F.col("language") == language)
    grouped = top.groupBy("file_path").agg(
        F.count("*").alias("unit_count"), F.min("seq").alias("seq"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "unit_type"))), lambda x: F.concat(x["unit_type"], F.lit(":"), x["name"])).alias("units"),
    )
    return page(grouped, ["seq", "file_path"], limit, offset)


def search(c: Catalog, query: str, kind: str = "code_unit", limit: int | None = 20, include_source: bool = False) -> Result:
    """Case-insensitive substring over unit names, pattern values or paths."""
    if not query:
        raise ToolError("query is required")
    has = lambda x: F.lower(x).contains(query.lower())
    top = c.units_top
    if kind == "code_unit":
        hits = top.where(has(F.col("name")))
    elif kind == "pattern":
        hits = top.join(c["code_unit_patterns"].where(has(F.col("pattern_value"))).select(F.col("code_unit_id").alias("id")), "id", "left_semi")
    elif kind == "file":
        hits = top.where(has(F.col("file_path")))
    else:
        raise ToolError(f"unknown search type: {kind}")
    found = page(hits.select("id", "name", "unit_type", "file_path", "line_start", "line_end", "language", "signature", "seq"), ["seq", "id"], limit)
    found.rows = with_source(c, found.rows, include_source).orderBy("seq", "id")
    found.context = {"reason": "no_matches", "detail": "No results found. Try a broader query."}
    return found


def code_units(
    c: Catalog, file_path=None, name=None, unit_type=None, language=None, min_complexity=None, is_exported=None, limit: int = 100, offset: int = 0, full: bool = False, include_source: bool = False
) -> Result:
    """Conjunctive filters, compact or full rows."""
    df = c.units_top
    for column, value in (("file_path", file_path), ("unit_type", unit_type), ("language", language), ("is_exported", is_exported)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if name is not None:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if min_complexity is not None:
        df = df.where(F.col("complexity_score") >= min_complexity)
    compact = ["id", "file_path", "name", "unit_type", "line_start", "line_end", "complexity_score", "is_exported", "seq"]
    found = page(df if full else df.select(compact), ["seq", "id"], limit, offset)
    found.rows = with_source(c, found.rows, include_source).orderBy("seq", "id")
    return found


def dependencies(c: Catalog, source_file=None, target_file=None, limit: int = 100, both: bool = False) -> Result:
    """Q05: by source, else by target; H05 (``both``): by both."""
    df = c["file_dependencies"]
    if source_file is not None:
        df = df.where(F.col("source_file") == source_file)
    if target_file is not None and (both or source_file is None):
        df = df.where(F.col("target_file") == target_file)
    return page(df, ["seq", "source_file", "target_file"], limit)


def api_endpoints(c: Catalog, method=None, path_pattern=None, limit: int = 100) -> Result:
    """Q06."""
    p = c["code_unit_patterns"].where("pattern_type = 'API_ENDPOINT'")
    if method:
        p = p.where(F.startswith(F.upper("pattern_value"), F.lit(method.upper())))
    if path_pattern:
        p = p.where(F.contains("pattern_value", F.lit(path_pattern)))
    u = c.units_top.select(F.col("id").alias("code_unit_id"), "file_path", "name", "line_start", F.col("seq").alias("unit_seq"))
    return page(p.join(u, "code_unit_id").select("pattern_value", "file_path", "name", "line_start", "unit_seq", "seq"), ["unit_seq", "seq", "pattern_value"], limit)


def file_content(c: Catalog, file_path: str, line_start: int | None = None, line_end: int | None = None) -> DataFrame:
    """Q07."""
    f = c["files"].where(F.col("file_path") == file_path)
    n = F.size(F.split("content", "\n", -1))
    text = slice_lines(F.col("content"), F.lit(line_start or 1), F.lit(line_end) if line_end else n)
    return f.select("file_path", text.alias("content"), n.cast("long").alias("line_count"))


def env_variables(c: Catalog) -> Result:
    """Q08."""
    return page(c["env_variables"].select("name", "description", "has_default", "line_number"), ["name"])


def patterns_by_type(c: Catalog, pattern_type: str, file_path=None, limit: int = 100) -> Result:
    """Q09."""
    if not pattern_type:
        raise ToolError("pattern_type is required")
    u = c.units_top if file_path is None else c.units_top.where(F.col("file_path") == file_path)
    p = c["code_unit_patterns"].where(F.col("pattern_type") == pattern_type)
    joined = p.join(u.select(F.col("id").alias("code_unit_id"), "file_path", "name", F.col("seq").alias("unit_seq")), "code_unit_id")
    return page(joined.select("pattern_value", "line_number", "column_access", "file_path", "name", "unit_seq", "seq"), ["unit_seq", "seq", "pattern_value"], limit)


def _unit(c: Catalog, unit_id=None, name=None, file_path=None, what: str = "unit_id or function_name") -> Any:
    """The one unit that the arguments mean: by id, else the first of the name."""
    if unit_id is None and name is None:
        raise ToolError(f"{what} is required")
    df = c.units_flat.where(F.col("id") == unit_id) if unit_id is not None else c.units_flat.where(F.col("name") == name)
    if unit_id is None and file_path is not None:
        df = df.where(F.col("file_path") == file_path)
    row = df.orderBy("seq", "id").first()
    if row is None:
        raise ToolError(f"not found: {unit_id or name}")
    return row


def change_impact(c: Catalog, file_path=None, unit_id=None, function_name=None, depth: int = 5, resolve: bool = False, include_source: bool = False) -> Result:
    """Q10: what depends on a file, directly and further, with cycles, endpoints, patterns and a risk label."""
    target = c.units_top.where(F.col("file_path") == file_path).orderBy("seq", "id").limit(1)
    if unit_id is not None or function_name is not None:
        unit = _unit(c, unit_id, function_name)
        file_path, target = unit["file_path"], c.units_flat.where(F.col("id") == unit["id"])
    if file_path is None:
        raise ToolError("file_path, unit_id or function_name is required")
    edges = graph.edges_of(c["file_dependencies"])
    if resolve:
        edges = graph.resolve_extensions(edges, c["files"])
    edges = graph.settle(edges, "impact-edges")
    start = c.spark.createDataFrame([(file_path,)], "start string")
    hit = graph.settle(graph.closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth), "impact")
    files = hit.select(F.col("node").alias("file_path"), "depth")
    touched = c.units_top.join(files, "file_path")
    pats = c["code_unit_patterns"].join(touched.select(F.col("id").alias("code_unit_id"), "file_path", "line_start", "line_end"), "code_unit_id")
    endpoints = pats.where("pattern_type = 'API_ENDPOINT'")
    counts = hit.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"))
    counts = counts.crossJoin(F.broadcast(endpoints.agg(F.count("*").alias("endpoints")))).crossJoin(F.broadcast(graph.on_cycle(edges, file_path)))
    d, t, e, n = (F.col(x) for x in ("direct", "total", "endpoints", "cycles"))
    risk = counts.select("direct", "total", "endpoints", "cycles", ranking.risk_level(d, n, e).alias("risk"), ranking.risk_sentence(d, t, e, n).alias("summary"))
    own = ["source"] if include_source else []
    return Result(files.orderBy("depth", "file_path"), parts={
        "target": with_source(c, target.select("id", "file_path", "name", "unit_type", "signature", "line_start", "line_end"), include_source),
        "risk": risk, "affected_units": touched.select("id", "file_path", "name", "depth").orderBy("depth", "file_path", "id"),
        "endpoints": with_source(c, endpoints, include_source).select("pattern_value", "file_path", *own).orderBy("file_path", "pattern_value"), "patterns": ranking.pattern_histogram(pats),
        "clusters": c.clusters_of(file_path),
    })


def call_chain(c: Catalog, unit_id=None, function_name=None, direction: str = "callees", depth: int = 3, include_source: bool = False) -> Result:
    """Q11: the units reached; the leaves whose call is not resolved are the part ``unresolved``, in one numbering."""
    start = _unit(c, unit_id, function_name)
    walked = graph.trace_calls(c["function_calls"], start["id"], depth, direction == "callers", c.units_flat.select("id", "name"))
    order = c.spark.createDataFrame([(x.unit_id, x.name, x.file_path, x.depth, i) for i, x in enumerate(walked)], "id string, callee_name string, callee_file_path string, depth int, position int")
    leaves = order.where("id IS NULL").select("depth", "position", F.col("callee_name").alias("name"), F.col("callee_file_path").alias("file_path"))
    reached = order.where("id IS NOT NULL").select("id", "depth", "position")
    rows = reached.join(c.units_flat.select("id", "name", "file_path", "line_start", *(["line_end"] if include_source else [])), "id", "left")
    return Result(with_source(c, rows, include_source).orderBy("position"), parts={"unresolved": leaves.orderBy("position")})


def event_flow(c: Catalog, unit_id=None, event_name=None, direction=None, framework=None) -> Result:
    """All conditions hold; the unit is joined where there is one."""
    e = c.find("event_flows", code_unit_id=unit_id, event_name=event_name, direction=direction, framework=framework)
    u = c.units_top.select(F.col("id").alias("code_unit_id"), F.col("name").alias("unit_name"), "file_path")
    return page(e.join(u, "code_unit_id", "left"), ["id"])


def data_models(c: Catalog, name=None, framework=None, file_path=None) -> Result:
    """Q13."""
    m = c.find("schema_models", name=name, framework=framework, file_path=file_path)
    f = c["schema_model_fields"].groupBy(F.col("model_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "field_type", "is_primary_key", "is_required", "is_unique", "has_default", "relation_target"))).alias("fields"))
    return page(m.join(f, "id", "left"), ["name", "id"])


def function_guards(c: Catalog, unit_id=None, guard_type=None, file_path=None, limit: int = 100) -> Result:
    """Q14: one condition, by precedence; guards without a unit are left out."""
    g, u = c["guard_clauses"], c.units_flat
    if unit_id is not None:
        g = g.where(F.col("code_unit_id") == unit_id)
    elif guard_type is not None:
        g = g.where(F.col("guard_type") == guard_type)
    elif file_path is not None:
        u = c.units_top.where(F.col("file_path") == file_path)
    joined = g.join(u.select(F.col("id").alias("code_unit_id"), F.col("name").alias("unit_name"), "file_path", "seq"), "code_unit_id")
    return page(joined, ["seq", "line_number", "id"], limit)


def feature_area(c: Catalog, cluster_id=None, file_path=None, cluster_name=None, resolve: bool = False) -> Result:
    """A cluster's files, units, dependencies, patterns and a sentence."""
    if cluster_id is not None:
        found = c.find("file_clusters", id=cluster_id)
    elif file_path is not None:
        found = c.clusters_of(file_path)
    elif cluster_name is not None:
        found = c.find("file_clusters", name=cluster_name)
    else:
        raise ToolError("cluster_id, file_path or cluster_name is required")
    one = found.orderBy("name", "id").first()
    if one is None:
        raise ToolError("no such cluster")
    members = c.find("file_cluster_members", cluster_id=one["id"]).select("file_path", "is_entry_point")
    paths = members.select("file_path")
    if resolve:
        spelt = graph.resolve_paths(paths.select(F.col("file_path").alias("path")), c.units_top)
        paths = members.join(spelt.withColumnsRenamed({"path": "file_path", "file_path": "real"}), "file_path", "left").select(F.coalesce("real", "file_path").alias("file_path"))
    own = c.units_top.join(paths, "file_path", "left_semi")
    pats = c["code_unit_patterns"].join(own.select(F.col("id").alias("code_unit_id")), "code_unit_id", "left_semi")
    histogram = ranking.pattern_histogram(pats)
    facts = members.agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(F.when(F.col("is_entry_point"), F.element_at(F.split("file_path", "/"), -1)))).alias("entries"))
    facts = facts.crossJoin(F.broadcast(own.agg(F.count("*").alias("n_units"))))
    facts = facts.crossJoin(F.broadcast(histogram.limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "pattern_type", "count"))), lambda x: F.concat(x["pattern_type"], F.lit(" ("), x["count"].cast("string"), F.lit(")"))), ", ").alias("top"))))
    text = F.concat(
        F.lit(f"Feature area '{one['name']}' contains "), F.col("n_files").cast("string"), F.lit(" files with "), F.col("n_units").cast("string"), F.lit(f" code units. Cohesion: {one['cohesion']:g}."),
        F.when(F.col("top") != "", F.concat(F.lit(" Top patterns: "), F.col("top"), F.lit("."))).otherwise(""),
        F.when(F.size("entries") > 0, F.concat(F.lit(" Entry points: "), F.array_join("entries", ", "), F.lit("."))).otherwise(""),
    )
    return Result(own.select("id", "file_path", "name", "unit_type").orderBy("file_path", "id"), parts={
        "members": members.orderBy("file_path"), "dependencies": ranking.classify_dependencies(c["file_dependencies"], paths).orderBy("direction", "source_file", "target_file"),
        "patterns": histogram, "summary": facts.select("n_files", "n_units", text.alias("summary")),
    })


def find_pattern(c: Catalog, query: str, pattern_type: str | None = None) -> Result:
    """Q16: the template that fits best, its exemplar and followers, with instructions."""
    if not query:
        raise ToolError("query is required")
    t = c["pattern_templates"]
    if pattern_type:
        t = t.where(F.array_contains("pattern_types", pattern_type))
    scored = t.withColumn("score", ranking.match_score(query).cast("long")).where("score > 0")
    best = scored.orderBy(F.desc("score"), "name", "id").limit(1)
    u = c.units_flat.select(F.col("id").alias("template_unit_id"), F.col("name").alias("unit_name"), "line_start", "line_end")
    shown = best.join(u, "template_unit_id", "left")
    where = F.concat(F.lit("1. Follow the example in "), F.col("template_file_path"), F.coalesce(F.concat(F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")")), F.lit("")))
    told = F.concat_ws(
        "\n", F.lit("To implement this pattern:"), where, F.concat(F.lit("2. Include these pattern elements: "), F.array_join("pattern_types", ", ")),
        F.concat(F.lit("3. Conventions:\n"), F.array_join(F.transform("conventions", lambda x: F.concat(F.lit("- "), x)), "\n")),
        F.concat(F.lit("\nSee "), F.col("follower_count").cast("string"), F.lit(" existing implementations for reference.")),
    )
    followers = c["pattern_template_followers"].join(best.select(F.col("id").alias("template_id")), "template_id", "left_semi")
    return Result(shown.withColumn("instructions", told), parts={"followers": followers.orderBy("file_path", "unit_name"), "matches": scored.select("id", "name", "score").orderBy(F.desc("score"), "name", "id")})


def validate_file(c: Catalog, file_path: str) -> Result:
    """Q17: a file's patterns, as extracted from its text now, against the templates: what it follows, deviates from, and files like it.

    The part ``units`` has its patterns; without units all parts are empty.
    """
    if not file_path:
        raise ToolError("file_path is required")
    file = c["files"].where(F.col("file_path") == file_path).select("file_path", "content")
    if file.isEmpty():
        raise ToolError(f"Failed to read file: {file_path}")
    fresh = graph.settle(units_with_bodies(with_file_columns(file)), "fresh")
    own = fresh.where("parent_unit_id IS NULL")
    pats = graph.settle(patterns.unit_patterns(bodies_of(fresh), fresh.drop("body")), "fresh-patterns").join(own.select(F.col("id").alias("code_unit_id")), "code_unit_id", "left_semi")
    types = pats.select("pattern_type").distinct()
    held = types.agg(F.collect_set("pattern_type").alias("held"))
    matched = c["pattern_templates"].crossJoin(F.broadcast(held)).where(F.arrays_overlap("pattern_types", "held"))
    covered = matched.select(F.explode(F.array_intersect("pattern_types", "held")).alias("pattern_type")).distinct()
    missing = types.join(covered, "pattern_type", "left_anti")
    deviations = missing.select(F.concat(F.lit("Pattern type '"), F.col("pattern_type"), F.lit("' has no matching template in the codebase")).alias("deviation"))
    unmatched = missing.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(1).alias("position"), F.lit("Consider creating pattern templates for the unmatched pattern types").alias("suggestion"))
    named = matched.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "id", "template_file_path"))), lambda x: x["template_file_path"]).alias("p")).where(F.size("p") > 0)
    review = named.select(F.lit(2).alias("position"), F.concat(F.lit("Review the canonical examples: "), F.array_join("p", ", ")).alias("suggestion"))
    follows = matched.select("name", "id", F.posexplode("conventions").alias("position", "convention"))
    near = c["code_unit_patterns"].join(types, "pattern_type", "left_semi").select(F.col("code_unit_id").alias("id")).distinct()
    similar = c.units_top.where(F.col("file_path") != file_path).join(near, "id", "left_semi").groupBy("file_path").agg(F.min_by("name", "seq").alias("unit_name"), F.min("seq").alias("seq")).orderBy("seq", "file_path").limit(5)
    return Result(own.select("id", "name", "unit_type", "line_start", "line_end").orderBy("line_start", "id"), parts={
        "patterns": pats.select("code_unit_id", "pattern_type", "pattern_value").orderBy("code_unit_id", "pattern_type", "pattern_value"),
        "matched": matched.select("name", "template_file_path", "conventions", "id").orderBy("name", "id").drop("id"), "follows": follows.orderBy("name", "id", "position").select("convention"),
        "deviations": deviations.orderBy("deviation"), "suggestions": unmatched.unionByName(review).orderBy("position").select("suggestion"), "similar_files": similar.select("file_path", "unit_name"),
    })


def function_context(c: Catalog, unit_id=None, function_name=None, file_path=None, by_id_only: bool = False, include_source: bool = False) -> Result:
    """Calls out, calls in (by id or by name, each call once), events and fields of one unit."""
    unit = _unit(c, unit_id, function_name, file_path)
    calls = c["function_calls"]
    hits = F.col("callee_unit_id") == unit["id"]
    if not by_id_only:
        hits = hits | (F.col("callee_name") == unit["name"])
    names = c.units_flat.select(F.col("id").alias("caller_unit_id"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    default = F.lit("unknown") if by_id_only else F.col("caller_unit_id")
    incoming = calls.where(hits).dropDuplicates(["id"]).join(names, "caller_unit_id", "left").withColumn("caller_name", F.coalesce("caller_name", default))
    outgoing = calls.where(F.col("caller_unit_id") == unit["id"])
    if include_source:
        outgoing = outgoing.join(sources_of(c, "callee_unit_id"), "callee_unit_id", "left")
        incoming = incoming.join(sources_of(c, "caller_unit_id"), "caller_unit_id", "left")
    return Result(with_source(c, c.units_flat.where(F.col("id") == unit["id"]), include_source), parts={
        "outgoing": outgoing.orderBy("seq", "id"), "incoming": incoming.orderBy("caller_name", "seq", "id"),
        "events": c.find("event_flows", code_unit_id=unit["id"]).orderBy("line_number", "id"), "fields": c.find("type_fields", parent_unit_id=unit["id"]).orderBy("line_number", "id"),
    })


def implementation_context(c: Catalog, file_path=None, unit_name=None, query=None, include_source: bool = True) -> Result:
    """Q19: units, imports both ways, related templates, likely tests and the cluster."""
    top = c.units_top
    if file_path is not None:
        own = top.where(F.col("file_path") == file_path)
    elif unit_name is not None:
        own = top.where(F.col("name") == unit_name)
    elif query is not None:
        own = top.where(F.contains(F.lower("name"), F.lit(query.lower())))
    else:
        raise ToolError("file_path, unit_name or query is required")
    paths = own.select("file_path").distinct()
    d = c["file_dependencies"]
    held = c["code_unit_patterns"].join(own.select(F.col("id").alias("code_unit_id")), "code_unit_id", "left_semi").agg(F.collect_set("pattern_type").alias("held"))
    related = c["pattern_templates"].crossJoin(F.broadcast(held)).where(F.arrays_overlap("pattern_types", "held")).drop("held")
    tried = paths.select(F.posexplode(ranking.test_candidates(F.col("file_path"))).alias("rank", "test_file"), "file_path")
    there = c["files"].select(F.col("file_path").alias("test_file"), F.lit(True).alias("e"))
    tests = tried.join(there, "test_file", "left").select("file_path", "rank", "test_file", F.coalesce("e", F.lit(False)).alias("exists"))
    area = c["file_clusters"].join(c["file_cluster_members"].join(paths, "file_path", "left_semi"), F.col("id") == F.col("cluster_id"), "left_semi")
    return Result(with_source(c, own, include_source).orderBy("seq", "id"), parts={
        "imports": d.join(paths.withColumnRenamed("file_path", "source_file"), "source_file", "left_semi").orderBy("source_file", "seq", "target_file"),
        "imported_by": d.join(paths.withColumnRenamed("file_path", "target_file"), "target_file", "left_semi").orderBy("target_file", "seq", "source_file"),
        "templates": related.orderBy("name", "id"), "tests": tests.orderBy("file_path", "rank"), "cluster": area.orderBy("name", "id").limit(1),
    })


def test_patterns(c: Catalog, file_path=None, unit_name=None) -> Result:
    """Q20: tests of the units most like the target: three files, their structure and conventions."""
    if file_path is None and unit_name is None:
        raise ToolError("file_path or unit_name is required")
    top = c.units_top
    target = (top.where(F.col("file_path") == file_path) if file_path is not None else top.where(F.col("name") == unit_name)).orderBy("seq", "id").limit(1)
    like = ranking.similar_units(top, c["code_unit_patterns"], target, c["file_cluster_members"])
    paths = like.join(top.select("id", "file_path"), "id").groupBy("file_path").agg(F.max("score").alias("score"))
    tried = paths.select("score", F.posexplode(ranking.test_candidates(F.col("file_path"))).alias("rank", "test_file"))
    found = tried.join(c["files"].select(F.col("file_path").alias("test_file"), "content"), "test_file").orderBy(F.desc("score"), "rank", "test_file").limit(3)
    named = found.select(F.col("test_file").alias("file_path"), "content", F.xxhash64("test_file").alias("seq"))
    return Result(test_structure(named).orderBy("file_path"), parts={"conventions": ranking.test_conventions(named)})


def cluster_list(c: Catalog) -> Result:
    """H06."""
    n = c["file_cluster_members"].groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("file_count"))
    return page(c["file_clusters"].join(n, "id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0))), ["name", "id"])


def cluster_relationships(c: Catalog) -> DataFrame:
    """H07."""
    return graph.cluster_edges(c["file_dependencies"], c["file_cluster_members"]).orderBy("source_cluster", "target_cluster")


def function_calls(c: Catalog, caller_id=None, callee_id=None) -> Result:
    """H09."""
    return page(c.find("function_calls", caller_unit_id=caller_id, callee_unit_id=callee_id), ["seq", "id"])


TOOLS = {
    "get_analysis_stats": stats, "get_module_overview": module_overview, "search_codebase": search, "get_code_units": code_units, "get_dependencies": dependencies,
    "get_api_endpoints": api_endpoints, "get_file_content": file_content, "get_env_variables": env_variables, "get_patterns_by_type": patterns_by_type,
    "plan_change_impact": change_impact, "trace_call_chain": call_chain, "get_event_flow": event_flow, "get_data_models": data_models, "get_function_guards": function_guards,
    "get_feature_area": feature_area, "find_implementation_pattern": find_pattern, "validate_against_patterns": validate_file, "get_function_context": function_context,
    "get_implementation_context": implementation_context, "get_test_patterns": test_patterns,
}


def call(c: Catalog, tool: str, **arguments) -> Result | DataFrame:
    if tool not in TOOLS:
        raise ToolError(f"Unknown tool: {tool}")
    return TOOLS[tool](c, **arguments)

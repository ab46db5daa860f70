"""Templates, similarity, test discovery, histograms and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import stable_id

MIN_GROUP = 3
TOP_SIMILAR = 5

# fixed values: what a set of pattern types, or one type, says about a template
COMBO_CONVENTIONS = {
    "API_ENDPOINT|DATABASE_WRITE": "Writes to database from API endpoint handler",
    "API_ENDPOINT|DATABASE_READ": "Reads from database in API endpoint handler",
    "API_ENDPOINT|EXTERNAL_SERVICE": "Calls external service from API endpoint handler",
    "DATABASE_READ|DATABASE_WRITE": "Reads and writes to database in single operation",
    "API_ENDPOINT|DATABASE_READ|DATABASE_WRITE": "API endpoint performing both database reads and writes",
}
TYPE_CONVENTIONS = {
    "API_ENDPOINT": "Exposes an HTTP endpoint",
    "API_CALL": "Makes outbound API calls",
    "DATABASE_READ": "Reads from database",
    "DATABASE_WRITE": "Writes to database",
    "EXTERNAL_SERVICE": "Integrates with external service",
    "ENV_VARIABLE": "Uses environment configuration",
    "IMPORT": "Imports external dependency",
    "EXPORT": "Exports public interface",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def pattern_combos(patterns: DataFrame) -> DataFrame:
    """(code_unit_id, combo, n_patterns): a unit's distinct pattern types, sorted and joined."""
    return patterns.groupBy("code_unit_id").agg(
        F.array_join(F.array_sort(F.collect_set("pattern_type")), "|").alias("combo"), F.count("*").alias("n_patterns")
    )


def template_ranks(units: DataFrame, patterns: DataFrame) -> DataFrame:
    """Units with patterns, their combo, its size, and their rank in it; groups under three are left out."""
    rows = units.join(pattern_combos(patterns), units["id"] == F.col("code_unit_id")).drop("code_unit_id")
    group = Window.partitionBy("combo")
    signed = F.when(F.coalesce(F.col("signature"), F.lit("")) == "", 0).otherwise(1)
    order = group.orderBy("complexity_score", F.desc(signed), F.desc("n_patterns"), F.desc(F.col("is_exported").cast("int")), "file_path", "id")
    # The size comes from an aggregate, the rank from one sort of the group.
    sizes = rows.groupBy("combo").agg(F.count("*").alias("n_units")).where(F.col("n_units") >= MIN_GROUP)
    return rows.join(sizes, "combo").withColumn("rank", F.row_number().over(order))


def _title(kind: Column) -> Column:
    return F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def template_text(types: Column, count: Column) -> tuple[Column, Column, Column]:
    """Name, description and at most three conventions of a sorted array of pattern types."""
    titles = F.transform(types, _title)
    n = F.size(types)
    head = F.array_join(F.slice(titles, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(titles, -1)
    name = F.when(n == 1, last).otherwise(F.concat(head, F.lit(" with "), last))
    joined = F.when(n == 1, last).otherwise(F.concat(head, F.lit(", and "), last))
    text = F.concat(F.lit("Functions that combine "), joined, F.lit(". Found in "), count.cast("string"), F.lit(" locations."))
    said = F.array_compact(F.concat(F.array(_map(COMBO_CONVENTIONS)[F.array_join(types, "|")]), F.transform(types, lambda t: _map(TYPE_CONVENTIONS)[t])))
    plain = F.array(F.concat(F.lit("Uses "), F.array_join(titles, " and ")))
    return name, text, F.when(F.size(said) > 0, F.slice(said, 1, 3)).otherwise(plain)


def templates(units: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pattern_templates, most followers first, and pattern_template_followers."""
    ranked = template_ranks(units, patterns)
    types = F.split("combo", r"\|")
    name, text, said = template_text(F.col("pattern_types"), F.col("n_units"))
    first = ranked.where("rank = 1").withColumn("pattern_types", types).select(
        stable_id("combo").alias("id"), name.alias("name"), text.alias("description"), "pattern_types", F.col("id").alias("template_unit_id"),
        F.col("file_path").alias("template_file_path"), (F.col("n_units") - 1).alias("follower_count"), said.alias("conventions"),
    )
    followers = ranked.where("rank > 1").select(stable_id("combo").alias("template_id"), "file_path", F.col("name").alias("unit_name"))
    return first.orderBy(F.desc("follower_count"), "id"), followers


def similar_units(units: DataFrame, patterns: DataFrame, target: DataFrame, members: DataFrame | None = None, top: int = TOP_SIMILAR) -> DataFrame:
    """The units most like the one in ``target`` (a single row of units): (id, score), best first.

    Target facts are one row, a type set of at most eight values and one cluster, so they go
    to the units as tiny joins; the units are read once.
    """
    one = target.select(F.col("id").alias("t_id"), F.col("unit_type").alias("t_type"), F.col("file_path").alias("t_path")).limit(1)
    types = patterns.join(one, patterns["code_unit_id"] == one["t_id"], "left_semi").select("pattern_type").distinct()
    overlap = patterns.join(types, "pattern_type", "left_semi").groupBy(F.col("code_unit_id").alias("id")).agg(F.count("*").alias("overlap"))
    scored = units.select("id", "unit_type", "file_path").crossJoin(F.broadcast(one)).where("id <> t_id").join(overlap, "id", "left")
    score = F.when(F.col("unit_type") == F.col("t_type"), 2).otherwise(0) + F.coalesce("overlap", F.lit(0))
    if members is not None:
        own = members.join(one, members["file_path"] == one["t_path"], "left_semi").select("cluster_id").limit(1)
        same = members.join(own, "cluster_id", "left_semi").select("file_path", F.lit(1).alias("near")).distinct()
        scored = scored.join(same, "file_path", "left")
        score = score + F.coalesce("near", F.lit(0))
    return scored.select("id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def test_candidates(path: Column) -> Column:
    """Where tests of a file may be, in order: mirrored under tests/, in __tests__/, beside it."""
    ext = F.coalesce(F.nullif(F.regexp_extract(path, r"\.(\w+)\z", 1), F.lit("")), F.lit("ts"))
    bare = F.regexp_replace(path, r"\.\w+\z", "")
    mirror = F.regexp_replace(bare, r"\Asrc/", "")
    folder, name = F.array_join(F.slice(F.split(bare, "/"), F.lit(1), F.size(F.split(bare, "/")) - 1), "/"), F.element_at(F.split(bare, "/"), -1)
    test, spec = F.concat(F.lit(".test."), ext), F.concat(F.lit(".spec."), ext)
    in_src = F.array(
        F.concat(F.lit("tests/"), mirror, test), F.concat(F.lit("tests/"), mirror, spec), F.concat(folder, F.lit("/__tests__/"), name, test), F.concat(bare, test)
    )
    return F.when(path.startswith("src/"), in_src).otherwise(F.array(F.concat(bare, test), F.concat(bare, spec)))


def test_conventions(paths: DataFrame) -> DataFrame:
    """The commonest location and naming of test files (file_path, seq); the first seen wins a tie."""
    p = F.col("file_path")
    place = F.when(p.contains("__tests__/"), "__tests__").when(p.rlike(r"\Atests?/"), "tests").otherwise("co-located")
    naming = F.when(p.contains(".spec."), ".spec").when(p.contains(".test."), ".test").otherwise("other")

    def mode(what: Column, name: str) -> DataFrame:
        return paths.groupBy(what.alias("v")).agg(F.count("*").alias("n"), F.min("seq").alias("s")).agg(F.max_by("v", F.struct("n", -F.col("s"))).alias(name))

    return mode(place, "location").crossJoin(mode(naming, "naming"))


def classify_dependencies(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges touching ``files`` (file_path), as internal, external-inbound or external-outbound."""
    area = files.select("file_path").distinct()
    a = area.select(F.col("file_path").alias("source_file"), F.lit(True).alias("a"))
    b = area.select(F.col("file_path").alias("target_file"), F.lit(True).alias("b"))
    both = dependencies.select("source_file", "target_file").distinct().join(a, "source_file", "left").join(b, "target_file", "left")
    kind = F.when(F.col("a") & F.col("b"), "internal").when(F.col("b"), "external-inbound").when(F.col("a"), "external-outbound")
    return both.select("source_file", "target_file", kind.alias("direction")).where("direction IS NOT NULL")


def pattern_histogram(patterns: DataFrame) -> DataFrame:
    """D23."""
    return patterns.groupBy("pattern_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "pattern_type")


def risk_level(direct: Column, cycles: Column, endpoints: Column) -> Column:
    """D24."""
    return F.when((cycles > 0) | (direct >= 6), "HIGH").when((direct >= 3) | (endpoints > 0), "MEDIUM").otherwise("LOW")


def risk_sentence(direct: Column, total: Column, endpoints: Column, cycles: Column) -> Column:
    """The label in a sentence."""
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    first = F.concat(risk_level(direct, cycles, endpoints), F.lit(" RISK "), plural(direct, "direct dependent"), F.lit(", "), plural(total, "total affected file"), F.lit("."))
    more = F.when(endpoints > 0, F.concat(F.lit(" Affects "), plural(endpoints, "API endpoint"), F.lit(".")))
    loop = F.when(cycles > 0, F.concat(F.lit(" Part of "), plural(cycles, "circular dependency chain"), F.lit(".")))
    return F.concat(first, F.coalesce(more, F.lit("")), F.coalesce(loop, F.lit("")))


def match_score(query: str) -> Column:
    """Of a template's name (3), description (2), types (2 each) and conventions (1 each)."""
    q = query.lower()
    has = lambda c: F.lower(c).contains(q)
    readable = lambda t: has(t) | has(F.replace(t, F.lit("_"), F.lit(" ")))
    return (
        F.when(has(F.col("name")), 3).otherwise(0) + F.when(has(F.col("description")), 2).otherwise(0)
        + 2 * F.size(F.filter("pattern_types", readable)) + F.size(F.filter("conventions", has))
    )

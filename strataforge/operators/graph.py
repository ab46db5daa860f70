"""Graphs as edge tables: adjacency, closures, components, cycles, clusters."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A component of more files is split by directory.
MAX_COMPONENT = 20
MAX_ENTRY_POINTS = 3
LEADING_DIRS = ("src", "lib", "app", "packages")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # One process on one machine: the warehouse is as durable as anything there.
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/.strataforge"


def settle(df: DataFrame, name: str = "graph") -> DataFrame:
    """Write an intermediate of an iteration to the shared checkpoint folder and read it back.

    Lineage ends there, so plans stay short and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, so that rounds don't fill the folder."""
    for df in tables:
        if path := getattr(df, "settled_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def edges_of(dependencies: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst); ``reverse`` turns dependencies into dependents."""
    a, b = ("target_file", "source_file") if reverse else ("source_file", "target_file")
    return dependencies.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, with_path: bool = False) -> DataFrame:
    """(start, node, depth) of all nodes reachable from ``starts`` (start), without the start.

    One level a round: the frontier joins the edges, nodes already seen drop out by
    anti-join. Many starts run together. ``with_path`` adds one shortest path, the least.
    """
    edges = settle(edges, "closure-edges")
    cols = ["start", "node"] + (["path"] if with_path else [])
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    if with_path:
        frontier = frontier.withColumn("path", F.array(F.col("node")))
    seen = frontier.withColumn("depth", F.lit(0))
    frontier, depth = settle(frontier, "closure"), 0
    seen = settle(seen, "closure")
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node"), *([F.concat("path", F.array("dst")).alias("path")] if with_path else []))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path")) if with_path else step.distinct()
        frontier = settle(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select(*cols), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 16 == 0:
            seen = settle(seen, "closure")
    return seen.where("depth > 0")


def least_reaching(edges: DataFrame, nodes: DataFrame, label: str = "label", mark: Column | None = None) -> DataFrame:
    """(node, label): the least mark of a node from which a node (node) is reached along the edges (src, dst), or its own.

    A node's mark is itself, or an expression of it. Each round takes the least label of a node
    and those before it, then jumps to that label's own label: what reaches the label reaches
    the node. So a label comes from about twice as far each round, if the order of marks has
    nothing to do with the way.
    """
    own = F.col("node") if mark is None else mark
    labels = settle(nodes.select("node", own.alias("label")), "labels")
    while True:
        behind = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("l")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("l").alias("l"))
        stepped = labels.join(behind, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = labels.select(own.alias("label"), F.col("label").alias("up"))
        seen = Observation()
        new = stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = settle(new.observe(seen, F.count_if(F.col("old") != F.col("label")).alias("moved")).drop("old"), "labels")
        forget(labels)
        labels = new
        if not seen.get["moved"]:
            return labels.withColumnRenamed("label", label)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph; the component is its least node."""
    both = edges.where("src <> dst").select("src", "dst")
    both = settle(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "components-edges")
    out = least_reaching(both, nodes_of(edges), "component")
    forget(both)
    return out


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without in- or out-edges are dropped, as long as that drops a tenth of them."""
    core = settle(edges, "core")
    n = dropped = core.count()
    while n and 10 * dropped >= n:
        ends = core.select(F.col("dst").alias("src")).distinct()
        begins = core.select(F.col("src").alias("dst")).distinct()
        new = settle(core.join(ends, "src", "left_semi").join(begins, "dst", "left_semi").select("src", "dst"), "core")
        forget(core)
        core, before, n = new, n, new.count()
        dropped = before - n
    return core


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles; the component is its least node.

    A node's colour is the least node that reaches it, its goal the least ahead of it within
    its colour. Where both are the same node, it reaches the node and is reached, so they are in
    one component. Others of a component agree on colour and goal: edges whose ends don't are
    cut, and what is left goes round again. Least is by a hash, so that long ways in the
    nodes' own order take few rounds.
    """
    mark = F.struct(F.xxhash64("node").alias("h"), "node")
    left, parts = cyclic_core(edges.where("src <> dst").select("src", "dst").distinct()), []
    while not left.isEmpty():
        colour = least_reaching(left, nodes_of(left), "colour", mark)
        inside = left.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2")
        back = settle(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-edges")
        goal = least_reaching(back, colour.select("node"), "goal", mark)
        known = colour.join(goal, "node")
        parts.append(settle(known.where("colour = goal").select("node", "colour"), "scc-part"))
        open_nodes = known.where("colour <> goal").select("node", "goal")
        kept = back.join(open_nodes.withColumnRenamed("node", "src"), "src").join(open_nodes.select(F.col("node").alias("dst"), F.col("goal").alias("g2")), "dst").where("goal = g2")
        new = cyclic_core(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        forget(left, colour, back, goal)
        left = new
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    alone = loops.withColumn("component", F.col("node"))
    if not parts:
        return alone
    found = reduce(DataFrame.unionByName, parts)
    several = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = found.join(several, "colour").select("node", "component")
    return settle(found.unionByName(alone.join(found.select("node"), "node", "left_anti")), "scc-found")


def on_cycle(edges: DataFrame, node) -> DataFrame:
    """One row (cycles): 1 if the node lies on a cycle. Only what it reaches is looked at."""
    start = edges.sparkSession.createDataFrame([(node,)], f"start {edges.schema['src'].dataType.simpleString()}")
    ahead = closure(edges, start).select("node").union(start)
    back = edges.where(F.col("dst") == F.lit(node)).join(ahead, F.col("src") == F.col("node"), "left_semi")
    return back.agg(F.least(F.count("*"), F.lit(1)).alias("cycles"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """From the least node always on to the least unvisited neighbour, until there is none."""
    after: dict = {}
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        after.setdefault(a, []).append(b)
    nodes = set(after) | set(rows["dst"])
    at = min(nodes)
    path, visited = [at], {at}
    while step := sorted(x for x in after.get(at, ()) if x not in visited):
        at = step[0]
        path.append(at)
        visited.add(at)
    return pd.DataFrame({"component": [rows["component"].iloc[0]], "path": [[*map(str, path), str(path[0])]], "length": [len(nodes)]})


def cycles(edges: DataFrame) -> DataFrame:
    """One representative path for each cyclic component, shortest first.

    A path's order decides its next step, so a component is walked by one task, which
    holds the edges inside it and nothing else.
    """
    parts = strong_components(edges)
    inner = edges.join(parts.withColumnRenamed("node", "src"), "src").join(parts.withColumnsRenamed({"node": "dst", "component": "c2"}), "dst").where("component = c2")
    kind = dict(parts.dtypes)["component"]
    out = inner.select("component", "src", "dst").groupBy("component").applyInPandas(_walk, f"component {kind}, path array<string>, length long")
    return out.orderBy("length", "component")


def directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def common_depth(first: Column, last: Column) -> Column:
    """Length of the common prefix of two arrays; of the least and greatest of many it is all's."""
    pairs = F.zip_with(first, last, lambda a, b: a == b)
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct(
        (s["n"] + F.when(s["go"] & F.coalesce(x, F.lit(False)), 1).otherwise(0)).alias("n"), (s["go"] & F.coalesce(x, F.lit(False))).alias("go")
    ), lambda s: s["n"])


def split_components(parts: DataFrame, max_size: int = MAX_COMPONENT) -> DataFrame:
    """(file_path, component, part): components over ``max_size`` by first directory below their common one."""
    rows = parts.select(F.col("node").alias("file_path"), "component", directory(F.col("node")).alias("dirs"))
    span = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("dirs").alias("lo"), F.max("dirs").alias("hi"))
    span = span.select("component", "n", common_depth(F.col("lo"), F.col("hi")).alias("depth"))
    below = F.get("dirs", F.col("depth"))
    part = F.when(F.col("n") <= max_size, F.lit("")).otherwise(F.coalesce(below, F.array_join("dirs", "/")))
    return rows.join(span, "component").select("file_path", "component", part.alias("part"))


def cluster_name(dirs_lo: Column, dirs_hi: Column) -> Column:
    """The common directory without leading src, lib, app or packages; ``root`` if there is none."""
    common = F.slice(dirs_lo, F.lit(1), common_depth(dirs_lo, dirs_hi))
    lead = F.aggregate(common, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct(
        (s["n"] + F.when(s["go"] & x.isin(*LEADING_DIRS), 1).otherwise(0)).alias("n"), (s["go"] & x.isin(*LEADING_DIRS)).alias("go")
    ), lambda s: s["n"])
    stripped = F.slice(common, lead + 1, F.size(common))
    return F.when(F.size(common) == 0, "root").when(F.size(stripped) == 0, F.array_join(common, "/")).otherwise(F.array_join(stripped, "/"))


def clusters(dependencies: DataFrame, max_size: int = MAX_COMPONENT) -> tuple[DataFrame, DataFrame]:
    """file_clusters and file_cluster_members."""
    edges = settle(edges_of(dependencies), "cluster-edges")
    member = split_components(components(edges), max_size)
    member = settle(member.select("file_path", F.sha2(F.concat_ws("|", "component", "part"), 256).alias("cluster_id")), "cluster-members")
    a = member.select(F.col("file_path").alias("src"), F.col("cluster_id").alias("ca"))
    b = member.select(F.col("file_path").alias("dst"), F.col("cluster_id").alias("cb"))
    ends = settle(edges.join(a, "src").join(b, "dst"), "cluster-ends")
    touched = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("cluster_id"), (F.col("ca") == F.col("cb")).alias("inner"))
    counts = touched.groupBy("cluster_id").agg(F.count_if("inner").alias("internal_edges"), F.count_if(~F.col("inner")).alias("external_edges"))
    span = member.select("cluster_id", directory(F.col("file_path")).alias("d")).groupBy("cluster_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    named = span.join(counts, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"), cluster_name(F.col("lo"), F.col("hi")).alias("name"),
        F.coalesce(F.col("internal_edges") / F.nullif(F.col("internal_edges") + F.col("external_edges"), F.lit(0)), F.lit(1.0)).alias("cohesion"),
        F.coalesce("internal_edges", F.lit(0)).cast("long").alias("internal_edges"), F.coalesce("external_edges", F.lit(0)).cast("long").alias("external_edges"),
    )
    inbound = ends.where("ca <> cb").groupBy(F.col("cb").alias("cluster_id"), F.col("dst").alias("file_path")).agg(F.count("*").alias("n"))
    top = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "file_path")
    entry = inbound.withColumn("i", F.row_number().over(top)).where(F.col("i") <= MAX_ENTRY_POINTS).select("cluster_id", "file_path", F.lit(True).alias("e"))
    members = member.join(entry, ["cluster_id", "file_path"], "left").select("cluster_id", "file_path", F.coalesce("e", F.lit(False)).alias("is_entry_point"))
    return named, members


def cluster_edges(dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """(source_cluster, target_cluster, weight) between different clusters."""
    a = members.select(F.col("file_path").alias("source_file"), F.col("cluster_id").alias("source_cluster"))
    b = members.select(F.col("file_path").alias("target_file"), F.col("cluster_id").alias("target_cluster"))
    both = dependencies.select("source_file", "target_file").join(a, "source_file").join(b, "target_file").where("source_cluster <> target_cluster")
    return both.groupBy("source_cluster", "target_cluster").agg(F.count("*").alias("weight"))


def resolve_extensions(edges: DataFrame, files: DataFrame) -> DataFrame:
    """D22 applied to edges: a target that is no file becomes the file its spelling stands for."""
    hits = resolve_paths(edges.select(F.col("dst").alias("path")).distinct(), files)
    return edges.join(hits, edges["dst"] == hits["path"], "left").select("src", F.coalesce("file_path", "dst").alias("dst"))


def resolve_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file_path): the path itself, else its other spelling, else with a suffix; the first that exists."""
    p = F.col("path")
    swap = (
        F.when(p.endswith(".js"), F.concat(F.expr("left(path, length(path) - 3)"), F.lit(".ts")))
        .when(p.endswith(".ts"), F.concat(F.expr("left(path, length(path) - 3)"), F.lit(".js")))
        .when(p.endswith(".jsx"), F.concat(F.expr("left(path, length(path) - 4)"), F.lit(".tsx")))
        .when(p.endswith(".tsx"), F.concat(F.expr("left(path, length(path) - 4)"), F.lit(".jsx")))
    )
    bare = ~F.element_at(F.split(p, "/"), -1).contains(".")
    suffixed = [F.when(bare, F.concat(p, F.lit(x))) for x in (".ts", ".tsx", ".js", ".jsx")]
    tried = paths.select("path", F.posexplode(F.array_compact(F.array(p, swap, *suffixed))).alias("rank", "file_path"))
    there = tried.join(files.select("file_path").distinct(), "file_path")
    return there.groupBy("path").agg(F.min_by("file_path", "rank").alias("file_path"))


class ChainCall(NamedTuple):
    """A call in a chain: the unit reached, or for an unresolved callee only its name and file."""

    unit_id: str | None
    name: str | None
    file_path: str | None
    depth: int


def trace_calls(calls: DataFrame, start: str, depth: int = 3, callers: bool = False, units: DataFrame | None = None) -> list[ChainCall]:
    """What is reached from ``start`` in depth-first order, each once, at most ``depth`` (1 to 10) calls away.

    Unresolved callees are leaves that go by their names. Callers are found by unit id and, with
    ``units`` (id, name), by name, those by id first. The neighbourhood is bounded by a distributed
    closure first; the walk itself, whose order decides which branch a shared unit belongs to,
    runs on those few edges.
    """
    depth = max(1, min(10, depth))
    spark: SparkSession = calls.sparkSession
    for column in ("callee_name", "callee_file_path"):
        if column not in calls.columns:
            calls = calls.withColumn(column, F.lit(None).cast("string"))
    # Units, and keys of what is called: a name stands for all its calls, so units and calls of one name aren't multiplied.
    by_id, by_name = (lambda c: F.concat(F.lit("i"), c)), (lambda c: F.concat(F.lit("n"), c))
    unit = lambda c: F.concat(F.lit("u"), c)
    resolved = calls.where("callee_unit_id IS NOT NULL")
    none = F.lit(None).cast("string")
    if callers:
        steps = resolved.select(by_id(F.col("callee_unit_id")).alias("src"), unit(F.col("caller_unit_id")).alias("dst"), none.alias("name"), none.alias("file"), "seq")
        keys = resolved.select(unit(F.col("callee_unit_id")).alias("src"), by_id(F.col("callee_unit_id")).alias("dst"))
        if units is not None:
            named = units.where("name IS NOT NULL").select(unit(F.col("id")).alias("src"), by_name(F.col("name")).alias("dst"))
            called = calls.where("callee_name IS NOT NULL").select(by_name(F.col("callee_name")).alias("src"), unit(F.col("caller_unit_id")).alias("dst"), none.alias("name"), none.alias("file"), "seq")
            steps, keys = steps.unionByName(called), keys.unionByName(named)
        keys = keys.distinct()
    else:
        callee = F.coalesce(unit(F.col("callee_unit_id")), by_name(F.col("callee_name")))
        steps = calls.select(unit(F.col("caller_unit_id")).alias("src"), callee.alias("dst"), F.col("callee_name").alias("name"), F.col("callee_file_path").alias("file"), "seq")
        keys = None
    steps = steps.where("dst IS NOT NULL")
    edges = steps.select("src", "dst") if keys is None else steps.select("src", "dst").unionByName(keys)
    first = spark.createDataFrame([("u" + start,)], "start string")
    near = closure(edges.distinct(), first, depth if keys is None else 2 * depth)
    inside = settle(near.select(F.col("node").alias("src")).union(first.select(F.col("start").alias("src"))).distinct(), "chain")
    after: dict[str, list[tuple]] = {}
    for r in steps.join(inside, "src", "left_semi").orderBy("seq", "dst").toLocalIterator():
        after.setdefault(r["src"], []).append((r["dst"], r["name"], r["file"]))
    keys_of: dict[str, list[str]] = {}
    for r in keys.join(inside, "src", "left_semi").orderBy("dst").toLocalIterator() if keys is not None else ():
        keys_of.setdefault(r["src"], []).append(r["dst"])
    # As in the system answered here, an unresolved name and a unit id share the record of what was visited.
    out, visited = [], {start}

    def visit(node: str, at: int) -> None:
        sources = [node] if keys is None else keys_of.get(node, ())
        for x, name, file in [step for s in sources for step in after.get(s, ())] if at < depth else ():
            if x[1:] not in visited:
                visited.add(x[1:])
                out.append(ChainCall(x[1:] if x[0] == "u" else None, name, file, at + 1))
                visit(x, at + 1)

    visit("u" + start, 0)
    return out


def call_chain(calls: DataFrame, start: str, depth: int = 3, callers: bool = False, units: DataFrame | None = None) -> list[tuple[str, int]]:
    """D26 as (unit id, or the name of an unresolved callee, and depth)."""
    return [(x.name if x.unit_id is None else x.unit_id, x.depth) for x in trace_calls(calls, start, depth, callers, units)]

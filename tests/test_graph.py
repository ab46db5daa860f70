import random

import pytest
from pyspark.sql import functions as F

from strataforge.catalog import Catalog
from strataforge.operators import graph
from strataforge.plans import tools


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closure_depths_and_path(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("a", "b")])
    got = {(r["node"], r["depth"], tuple(r["path"])) for r in graph.closure(e.distinct(), spark.createDataFrame([("a",)], "start string"), with_path=True).collect()}
    assert got == {("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "b", "d"))}


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("x", "x"), ("c", "q"), ("p", "a")])
    got = [(r["path"], r["length"]) for r in graph.cycles(e).collect()]
    assert got == [(["x", "x"], 1), (["a", "b", "c", "a"], 3)]
    assert graph.cycles(edges(spark, [("a", "b")])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_scc_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(45)]
    reach = {a: {a} for p in pairs for a in p}
    under = {a: {a} for p in pairs for a in p}
    for _ in range(41):
        for a, b in pairs:
            reach[a] |= reach[b]
            both = under[a] | under[b]
            for x in both:
                under[x] = under[x] | both
    comp = {r["node"]: r["component"] for r in graph.components(edges(spark, pairs).repartition(7)).collect()}
    assert comp == {a: min(x) for a, x in under.items()}
    loops = {a for a, b in pairs if a == b}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if any(b != a and a in reach[b] for b in reach[a]) or a in loops}
    assert {r["node"]: r["component"] for r in graph.strong_components(edges(spark, pairs)).collect()} == want


def test_clusters(spark):
    d = spark.createDataFrame([("src/api/a", "src/api/b"), ("src/db/m", "src/db/n")], "source_file string, target_file string")
    found, members = graph.clusters(d)
    assert {(r["name"], r["cohesion"], r["internal_edges"]) for r in found.collect()} == {("api", 1.0, 1), ("db", 1.0, 1)}
    assert members.where("is_entry_point").count() == 0


def test_large_component_splits_by_directory(spark):
    pairs = [(f"src/{'x' if i % 2 else 'y'}/f{i}", "src/x/hub") for i in range(30)]
    found, members = graph.clusters(spark.createDataFrame(pairs, "source_file string, target_file string"))
    assert {(r["name"], r["internal_edges"], r["external_edges"]) for r in found.collect()} == {("x", 15, 15), ("y", 0, 15)}
    assert [r["file_path"] for r in members.where("is_entry_point").collect()] == ["src/x/hub"]


def test_resolve_paths(spark):
    files = spark.createDataFrame([("a.ts",), ("b.jsx",), ("c.tsx",)], "file_path string")
    paths = spark.createDataFrame([("a.js",), ("a",), ("b.tsx",), ("c",), ("z",)], "path string")
    assert {(r[0], r[1]) for r in graph.resolve_paths(paths, files).collect()} == {("a.js", "a.ts"), ("a", "a.ts"), ("b.tsx", "b.jsx"), ("c", "c.tsx")}


def test_call_chain_visits_depth_first_once(spark):
    c = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 3), ("c", "d", 4)], "caller_unit_id string, callee_unit_id string, seq long")
    assert graph.call_chain(c, "a", 2) == [("b", 1), ("c", 2)]
    assert graph.call_chain(c, "a", 3) == [("b", 1), ("c", 2), ("d", 3)]
    assert graph.call_chain(c, "d", 9, callers=True) == [("c", 1), ("b", 2), ("a", 3)]


def test_call_chain_has_unresolved_calls(spark):
    rows = [("a", "b", "fb", 1), ("a", None, "log", 2), ("b", None, "log", 3), ("b", None, "ext", 4), ("d", None, "fa", 5), ("e", "d", "fd", 6), ("f", None, "fd", 7)]
    c = spark.createDataFrame(rows, "caller_unit_id string, callee_unit_id string, callee_name string, seq long")
    units = spark.createDataFrame([(x, "f" + x) for x in "abdef"], "id string, name string")
    assert graph.call_chain(c, "a", 3, units=units) == [("b", 1), ("log", 2), ("ext", 2)]
    assert graph.call_chain(c, "a", 1, units=units) == [("b", 1), ("log", 1)]
    assert graph.call_chain(c, "a", 3, callers=True, units=units) == [("d", 1), ("e", 2), ("f", 2)]
    assert graph.call_chain(c, "a", 1, callers=True, units=units) == [("d", 1)]
    assert [tuple(x) for x in graph.trace_calls(c, "b", 1, units=units)] == [(None, "log", None, 1), (None, "ext", None, 1)]
    catalog = Catalog(spark, {"code_units": units.selectExpr("id", "name", "'x.ts' AS file_path", "1 AS line_start", "1L AS seq"), "function_calls": c})
    found = tools.call(catalog, "trace_call_chain", unit_id="a")
    assert [(r["name"], r["position"]) for r in found.rows.collect()] == [("fb", 0)]
    assert [(r["name"], r["depth"], r["position"]) for r in found.parts["unresolved"].collect()] == [("log", 2, 1), ("ext", 2, 2)]
    found = tools.call(catalog, "trace_call_chain", function_name="fa", direction="callers")
    assert [(r["name"], r["depth"]) for r in found.rows.collect()] == [("fd", 1), ("fe", 2), ("ff", 2)]


def test_order_of_rows_does_not_matter(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "d")]
    one = graph.components(edges(spark, pairs).coalesce(1)).orderBy("node").collect()
    two = graph.components(edges(spark, pairs[::-1]).repartition(5, F.col("src"))).orderBy("node").collect()
    assert one == two


def test_rounds_grow_with_the_logarithm_of_a_cycle(spark, monkeypatch):
    n, rounds = 300, []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="graph": (rounds.append(name), settle(df, name))[1])
    rows = [(i, (i + 1) % n) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(3)] + [(7, 7), (5, 1000)]
    found = graph.strong_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(n)]
    assert rounds.count("labels") < 200


def test_a_node_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert [graph.on_cycle(e, x).first()[0] for x in "abcdez"] == [1, 1, 1, 0, 1, 0]

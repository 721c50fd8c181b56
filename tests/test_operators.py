"""Small literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import file_of, is_entry_point, listed_package_of, package_of, tokens_of
from graphloom.operators import delta, graph, history, policy, resolve, search
from graphloom.sources import files as source
from graphloom.sources.extract import extract, parse_source
from graphloom.streaming import changes


def edges(spark, *pairs, kind="Import"):
    return spark.createDataFrame([(a, b, kind, None, None, True) for a, b in pairs], "src string, dst string, kind string, source_path string, line int, resolved boolean")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def values(df, column):
    return sorted(r[column] for r in df.select(column).collect())


def test_walks_on_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    found = graph.walk(graph.adjacency(e), nodes(spark, "a"))
    assert values(found.nodes.filter("depth > 0"), "node") == ["b", "c"] and not found.truncated
    cut = graph.walk(graph.adjacency(e), nodes(spark, "a"), graph.Limits(nodes=1))
    assert cut.truncated and cut.reason == "nodes" and cut.visited_nodes == 1
    assert graph.walk(graph.adjacency(e), nodes(spark, "a"), graph.Limits(edges=1)).reason == "edges"
    assert graph.walk(graph.adjacency(e), nodes(spark, "a"), graph.Limits(name_bytes=0)).reason == "bytes"
    assert graph.walk(graph.adjacency(e), nodes(spark, "zz")).visited_nodes == 1


def test_components_and_orders(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"))
    found = {r["node"]: r["component"] for r in graph.strong_components(graph.adjacency(e)).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert graph.topological_layers(graph.adjacency(e)) is None
    line = graph.topological_layers(graph.adjacency(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))))
    assert {r["node"]: r["layer"] for r in line.collect()} == {"a": 0, "b": 1, "c": 2}


def test_file_cycles_of_symbols(spark):
    a, b, c = (f"symbol://src/{x}.ts#value:{x}" for x in "abc")
    e = edges(spark, (a, b), (b, a), (c, a))
    assert values(graph.strong_components(graph.file_graph(e)), "node") == ["src/a.ts", "src/b.ts"]


def test_impact_and_sites(spark):
    e = edges(spark, ("a", "b"), ("c", "b"))
    assert [(r["symbol"], r["risk"]) for r in graph.impact(e, nodes(spark, "b")).orderBy("symbol").collect()] == [("a", "high"), ("c", "high")]
    both = edges(spark, ("consumer.ts", "target")).unionByName(edges(spark, ("caller", "target"), kind="Calls"))
    first = graph.sites(both, "target").filter("position = 1").first()
    assert first["kind"] == "Calls" and first["total"] == 2


def test_columns(spark):
    row = lambda column, value: spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]
    assert row(package_of, "apps/api/src/main.ts") == "api" and row(package_of, "react") == "react"
    assert row(listed_package_of, "react/x.ts") == "workspace"
    assert row(file_of, "symbol://a/b.ts#value:X") == "a/b.ts"
    assert set(row(tokens_of, "HTTP2Server_getByUser")) == {"2", "by", "get", "http", "server", "user"}
    entries = spark.createDataFrame([("main", "apps/x/src/main.ts"), ("bootstrap", "x/bootstrap.ts"), ("UsersService", "x/users.service.ts")], "n string, p string")
    assert [r[0] for r in entries.select(is_entry_point(F.col("n"), F.col("p"))).collect()] == [True, True, False]


def symbols(spark, *names):
    return spark.createDataFrame([(f"symbol://{p}#value:{n}", n, n, k, p) for n, k, p in names], "id string, name string, qualified string, kind string, path string")


def test_search(spark):
    s = symbols(spark, ("UserService", "class_declaration", "a.ts"), ("cat", "function_declaration", "a.ts"), ("cart", "function_declaration", "a.ts"), ("cast", "function_declaration", "b.ts"), ("Foo", "method", "b.ts"), ("foo", "method", "c.ts"))
    assert values(search.fuzzy(s, "UserServce"), "value") == ["UserService"]
    assert [r["value"] for r in search.fuzzy(s, "cat").collect()][:1] == ["cat"]
    assert [(r["value"], r["reason"]) for r in search.exact(s, "foo").collect()] == [("foo", "exact-case"), ("Foo", "exact-case-insensitive")]
    assert search.exact(s, "").count() == 0
    assert search.query_tokens("HTTP2Server getByUser") == ["http", "server", "get", "by", "user"]
    with pytest.raises(ValueError):
        search.regex(s, "(?=x)")


def test_resolution(spark):
    i = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "missing"), ("src/a.ts", "@core/x")], "path string, specifier string")
    f = spark.createDataFrame([("src/b.ts",), ("src/b.js",), ("src/core/x.ts",)], "path string")
    alias = spark.createDataFrame([("@core/*", "src/core/*"), ("@*", "src/none/*")], "pattern string, target string")
    got = {r["specifier"]: (r["dst"], r["resolved"]) for r in resolve.resolve_imports(i, f, alias).collect()}
    assert got == {"./b": ("src/b.ts", True), "missing": ("missing", False), "@core/x": ("src/core/x.ts", True)}


def test_policy(spark):
    e = edges(spark, ("a.ts", "missing.ts"))
    found = policy.dangling(e, nodes(spark, "a.ts"))
    assert found.count() == 1
    assert policy.without_suppressed(found, spark.createDataFrame([("dangling_edge:a.ts:missing.ts",)], "key string")).count() == 0
    rules = policy.Boundaries([policy.Layer("s", ["service-*"], forbid=["c"]), policy.Layer("c", ["controller-*"])])
    assert [r["code"] for r in policy.layer_findings(edges(spark, ("service-a", "controller-b")), rules).collect()] == ["layer_bypass"]


def test_delta_equals_full(spark):
    v = lambda *rows: spark.createDataFrame(rows, "path string, hash string")
    old, new = v(("a", "1"), ("b", "2"), ("c", "3")), v(("a", "1"), ("b", "9"), ("d", "4"))
    changed = delta.detect_changes(old, new)
    assert {r["path"]: r["change"] for r in changed.collect()} == {"b": "modified", "c": "removed", "d": "added"}
    patched = delta.apply_overlay(old, new.join(changed, "path", "left_semi"), changed, "path")
    assert sorted(map(tuple, patched.collect())) == sorted(map(tuple, new.collect()))


def test_generations(spark, tmp_path):
    g = delta.Generations(spark, f"file://{tmp_path}/g")
    for i in range(4):
        g.publish(f"gen{i}", {"files": spark.range(i + 1)})
    assert g.current() == "gen3" and g.read("files").count() == 4
    assert len(g.collect_garbage(2)) == 2 and "gen3" in g.names()


def test_history_and_files(spark):
    h = spark.createDataFrame([("c1", "a.ts", 1), ("c1", "b.ts", 1)], "commit string, file string, recency int")
    assert [tuple(r) for r in history.cochanged(h, "a.ts", 10, 1).collect()] == [("b.ts", 1)]
    f = spark.createDataFrame([("x.ts",), ("x.js",), ("y.js",)], "path string")
    assert values(history.without_sibling_emit(f), "path") == ["x.ts", "y.js"]
    rules = [("", "*.log"), ("sub", "!keep.log")]
    p = spark.createDataFrame([("a.log",), ("sub/keep.log",), ("sub/b.log",)], "path string")
    assert {r["path"]: r["ignored"] for r in source.ignored(p, rules).collect()} == {"a.log": True, "sub/keep.log": False, "sub/b.log": True}
    assert source.parse_jsonc('{"a": [1, 2,], /* x */ "b": "//no" }') == {"a": [1, 2], "b": "//no"}


def test_extraction(spark):
    found = parse_source("src/a.ts", "import { B as C } from './b';\nexport class S extends T { run(x) { if (x) { if (x > 1) { return C(); } } } leaf() { return 1; } }")
    assert found["imports"][0] | {} == {"specifier": "./b", "type_only": False, "line": 0, "imported": "B", "local": "C", "kind": "named"}
    by = {s["qualified"]: s for s in found["symbols"]}
    assert by["S"]["exported"] and by["S.run"]["cyclomatic"] >= 3 and by["S.leaf"]["cyclomatic"] == 1
    assert ("Extends", "T") in {(r["kind"], r["to"]) for r in found["refs"]} and ("Calls", "C") in {(r["kind"], r["to"]) for r in found["refs"]}
    files = spark.createDataFrame([("a.ts", "function f() { g(); }"), ("b.ts", None)], "path string, content string")
    assert extract(files).count() == 2


def test_change_batches(spark, tmp_path):
    rows = list(changes.cut_batches(((i * 0.002, f"f{i}") for i in range(64)), gap=0.15, most_seconds=1, most_paths=8))
    assert len(rows) == 8 and all(len(x) <= 8 for x in rows)
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "create", "a"), (1, "2024-01-01 00:00:01", "other", None), (2, "2024-01-01 00:00:00", "create", "a"), (2, "2024-01-01 00:00:01", "modify", "a"), (2, "2024-01-01 00:00:02", "open", "b")], "workspace long, ts string, kind string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["workspace"]: (r["reconcile"], r["paths"]) for r in changes.batches(changes.relevant(events), "10 seconds").collect()}
    assert got == {1: (True, []), 2: (False, ["a"])}
    events.write.parquet(f"{tmp_path}/in")
    synced = []
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(3, "2024-01-02 00:00:00", "create", "z")], "workspace long, ts string, kind string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    changes.watch(stream.filter("workspace <> 1"), synced.append, lambda: synced.append(["*"]), "10 seconds", f"{tmp_path}/c", once=True).awaitTermination()
    assert ["a"] in synced

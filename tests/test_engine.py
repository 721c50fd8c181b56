"""Scans, resolution, maintenance and extraction on small literal cases and against plain recomputation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import unquoted
from graphloom.operators import delta, graph, link, resolve, search
from graphloom.sources import files as source
from graphloom.sources.extract import parse_source
from graphloom.streaming import changes


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_walk_limits(spark):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(110)}
    adj = table(spark, sorted(pairs), "src string, dst string")
    depth, level = {"n00": 0}, ["n00"]
    while level:
        level = sorted({b for a, b in pairs if a in level} - set(depth))
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    start = table(spark, [("n00",)], "node string")
    got = {r["node"]: r["depth"] for r in graph.walk(adj, start).nodes.collect()}
    assert got == depth
    for most in (1, 3, len(depth) - 1, len(depth)):
        cut = graph.walk(adj, start, graph.Limits(nodes=most))
        want = sorted(depth, key=lambda n: (depth[n], n))[:most]
        assert sorted(r["node"] for r in cut.nodes.collect()) == sorted(want)
        assert cut.truncated == (most < len(depth)) and cut.visited_nodes == most
    shallow = graph.walk(adj, start, graph.Limits(depth=2))
    assert shallow.reason == "depth" and {r["node"] for r in shallow.nodes.collect()} == {n for n, d in depth.items() if d <= 2}
    assert graph.impact_within(adj, start, graph.Limits(depth=1))[1].truncated


def test_diff_impact_of_many_origins(spark):
    for seed in range(2):
        rng = random.Random(seed)
        pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(100 + i, seed) for i in range(12)}
        origins = sorted(rng.sample(range(40), 5))
        into = {b: len({a for a, x in pairs if x == b}) for _, b in pairs}
        want = {}
        for s in origins:
            depth, level = {s: 0}, [s]
            while level:
                level = sorted({a for a, b in pairs if b in level} - set(depth))
                depth |= dict.fromkeys(level, max(depth.values()) + 1)
            for v, d in depth.items():
                i = into.get(v, 0)
                rank = 0 if d <= 1 or i > 10 else 1 if d <= 3 or i >= 2 else 2
                if d and any(s in p for p in pairs) and (v not in want or rank < want[v][0]):
                    want[v] = (rank, d)
        df = table(spark, [(f"n{a:03}", f"n{b:03}") for a, b in pairs], "src string, dst string")
        got = graph.diff_impact(df, table(spark, [(f"n{s:03}",) for s in origins], "node string")).collect()
        assert {r["symbol"]: (["high", "medium", "low"].index(r["risk"]), r["depth"]) for r in got} == {f"n{v:03}": x for v, x in want.items()}


def test_imports_try_candidates_in_order(spark):
    found = ["a/x.ts", "a/x.js", "a/x/index.ts", "a/y.tsx", "a/z/index.js", "a/data.json", "a/w.js.ts", "index.ts", "a/q.mts", "a/q.cts"]
    asked = ["./x", "./x.js", "./x.jsx", "./y.js", "./z", "./data.json", "./w.js", "../", "./q", "./none", "x"]
    got = {r["specifier"]: r["dst"] for r in resolve.resolve_imports(table(spark, [("a/m.ts", s) for s in asked], "path string, specifier string"), table(spark, [(f,) for f in found], "path string")).collect()}
    order = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
    for s in asked:
        base = {"../": "", "x": None}.get(s, f"a/{s[2:]}")
        bare = base and (base.rsplit(".", 1)[0] if base.rsplit(".", 1)[-1] in order else base)
        tries = [] if base is None else [base, *(f"{base}.{e}" for e in order), *(f"{bare}.{e}" for e in order), *(f"{base}/index.{e}".lstrip("/") for e in order)]
        assert got[s] == next((t for t in tries if t in found), s), s


def code(spark):
    symbol = lambda path, qualified, kind="method", exported=False, declared=None, low=None, scope=(None, None): (f"{path}#{qualified}@{scope[0]}", path, qualified.split(".")[-1], qualified, kind, exported, declared, 1, low, *scope)
    schema = "id string, path string, name string, qualified string, kind string, exported boolean, declared string, span_size long, low long, scope_low long, scope_high long"
    symbols = [
        symbol("a.ts", "A", "class_declaration", True), symbol("a.ts", "A.run"), symbol("a.ts", "A.tool", "property", declared="Tool"), symbol("a.ts", "A.odd", "property", declared="Nothing"),
        symbol("t.ts", "Tool", "class_declaration", True), symbol("t.ts", "Tool.go"), symbol("t.ts", "helper", "function_declaration", True), symbol("t.ts", "Shape", "interface_declaration", True),
        symbol("a.ts", "f", "function_declaration"), symbol("a.ts", "f", "constant", low=50, scope=(40, 90)), symbol("a.ts", "late", "constant", low=80, scope=(40, 90)),
        symbol("u.ts", "twice", "function_declaration", True), symbol("v.ts", "twice", "function_declaration", True),
    ]
    bindings = [("a.ts", "Tool", "Tool", "index.ts", "named"), ("a.ts", "h", "helper", "index.ts", "named"), ("a.ts", "ns", "*", "index.ts", "namespace"), ("a.ts", "t", "tools", "index.ts", "named"), ("a.ts", "Shape", "Shape", "t.ts", "named"), ("a.ts", "twice", "twice", "index.ts", "named")]
    exports = [("index.ts", "*", "*", "t.ts"), ("index.ts", "tools", "*", "t.ts"), ("index.ts", "*", "*", "u.ts"), ("index.ts", "*", "*", "v.ts")]
    return table(spark, symbols, schema), table(spark, bindings, "path string, local string, imported string, source string, kind string"), table(spark, exports, "file string, exported string, local string, source string")


@pytest.mark.parametrize("part", [0])
def test_references_in_full(spark, part):
    symbols, bindings, exports = code(spark)
    cases = [
        ("this.run", "Calls", None, "a.ts#A.run@None", "this"), ("this.tool.go", "Calls", None, "t.ts#Tool.go@None", "field"), ("this.odd.go", "Calls", None, None, None), ("this.none", "Calls", None, None, None),
        ("Tool", "Instantiates", None, "t.ts#Tool@None", "import"), ("Tool.go", "Calls", None, "t.ts#Tool.go@None", "import"), ("h", "Calls", None, "t.ts#helper@None", "import"), ("ns.helper", "Calls", None, "t.ts#helper@None", "namespace"),
        ("ns.Tool.go", "Calls", None, "t.ts#Tool.go@None", "namespace"), ("t.helper", "Calls", None, "t.ts#helper@None", "namespace"), ("twice", "Calls", None, None, None), ("Shape", "TypeOf", None, "t.ts#Shape@None", "import"),
        ("Shape", "Calls", None, None, None), ("f", "Calls", 60, "a.ts#f@40", "local"), ("f", "Calls", 10, "a.ts#f@None", "local"), ("late", "Calls", 60, None, None), ("late", "Calls", 85, "a.ts#late@40", "local"),
        ("A.run", "Calls", None, "a.ts#A.run@None", "local"), ("zzz.run", "Calls", None, None, None),
    ]
    refs = table(spark, [(i, "a.ts", "A", name, kind, at) for i, (name, kind, at, *_) in enumerate(cases)], "ref int, path string, owner string, name string, kind string, at long")
    got = {r["ref"]: (r["dst"], r["how"]) for r in link.resolve_members(refs, symbols, bindings, exports).collect()}
    for i, (name, _, _, dst, how) in enumerate(cases):
        assert got.get(i, (None, None)) == (dst, how), name


def test_symbol_imports(spark):
    symbols, bindings, exports = code(spark)
    resolved = table(spark, [("a.ts", "./index", "index.ts", True), ("a.ts", "lib", "lib", False)], "path string, specifier string, dst string, resolved boolean")
    got = {(r["src"], r["dst"], r["kind"], r["score"], r["reason"], r["type_only"]) for r in link.import_edges(resolved, bindings, exports, symbols).collect()}
    unique = {("a.ts", f"t.ts#{x}@None", "Import", 1.0, "unique_symbol", t) for x, t in (("Tool", False), ("helper", False), ("Shape", True))}
    again = {("index.ts", f"{x}.ts", "ReExport", 1.0, "file", False) for x in "tuv"}
    assert got == {("a.ts", "index.ts", "Import", 1.0, "file", False), ("a.ts", "lib", "Import", 0.0, "unresolved", False)} | unique | again


def test_synced_imports_equal_a_rebuild(spark):
    rng = random.Random(4)
    for _ in range(4):
        files = [[f"d/m{i}{rng.choice(['.ts', '/index.js', '.tsx'])}" for i in range(30) if rng.random() < 0.7] for _ in range(2)]
        files[1] = [f for f in files[0] if rng.random() < 0.8] + files[1][:4]
        imports = [[(f"d/m{a}.ts", f"./m{rng.randrange(34)}{rng.choice(['', '.js'])}") for a in range(30) for _ in range(2)] for _ in range(2)]
        imports[1] = [i for i in imports[0] if rng.random() < 0.9] + imports[1][:5]
        f = tuple(table(spark, [(x,) for x in sorted(set(y))], "path string") for y in files)
        i = tuple(table(spark, sorted(set(y)), "path string, specifier string") for y in imports)
        synced, affected = resolve.sync_imports(resolve.resolve_imports(i[0], f[0]), i, f)
        assert sorted(synced.collect()) == sorted(resolve.resolve_imports(i[1], f[1]).collect())
        assert affected.count() <= 30
    assert [resolve.sync_tier(0, 0, 0, 0, 9), resolve.sync_tier(1, 0, 0, 1, 9), resolve.sync_tier(1, 1, 0, 4, 9), resolve.sync_tier(1, 0, 1, 5, 9)] == ["none", "content", "delta", "full"]


def test_scopes_of_points(spark):
    rng = random.Random(6)
    scopes = [(rng.randrange(3), f"s{i}", low, low + rng.choice([0, 1, 5, 63, 64, 900])) for i, low in enumerate(rng.randrange(1000) for _ in range(80))]
    points = sorted({(rng.randrange(4), rng.randrange(1100)) for _ in range(200)})
    got = {(r["key"], r["at"]): r["scope"] for r in resolve.enclosing_scopes(table(spark, points, "key int, at long"), table(spark, scopes, "key int, scope string, low long, high long")).collect()}
    for key, at in points:
        inside = [(high - low, s) for k, s, low, high in scopes if k == key and low <= at <= high]
        assert got.get((key, at)) == (min(inside)[1] if inside else None)


def test_workspace_with_ignore_files(spark, tmp_path):
    texts = {
        ".gitignore": "*.gen.ts\n!keep.gen.ts\nbuild[0-9]/\n# note\n\n/only.ts\n", "a.ts": "1", "x.gen.ts": "2", "keep.gen.ts": "3", "build1/b.ts": "4", "buildx/b.ts": "5", "only.ts": "6",
        "sub/only.ts": "7", "sub/.ignore": "d[!x].ts\n", "sub/dx.ts": "8", "sub/dy.ts": "9", ".hidden/h.ts": "10", "_under/u.ts": "11", "node_modules/n.ts": "12", "readme.md": "13", ".git/g.ts": "14",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["content"] for r in source.workspace(spark, str(tmp_path)).collect()}
    assert got == {n: texts[n] for n in ("a.ts", "keep.gen.ts", "buildx/b.ts", "sub/only.ts", "sub/dx.ts", ".hidden/h.ts", "_under/u.ts")}
    lost = source.read_files(spark, str(tmp_path), table(spark, [("a.ts",)], "path string"))
    (tmp_path / "a.ts").unlink()
    assert [r["content"] for r in source.size_gate(lost).join(lost, "path").collect()] == [None]
    assert source.effective_extensions([".TS", "a/b", "x" * 17, "vue"]) == ["ts", "vue"]


def test_project_files(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/base.json").write_text('{"compilerOptions": {"baseUrl": "../src", "paths": {"@/*": ["app/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('{ // own\n "extends": "./conf/base", "compilerOptions": {"strict": true,}, }')
    assert source.load_tsconfig(spark, str(tmp_path)) == ([("@/*", "src/app/*")], "src", [])
    (tmp_path / "conf/base.json").write_text('{"extends": "../tsconfig.json", "compilerOptions": {"paths": {"x": ["y/x"]}}}')
    assert source.load_tsconfig(spark, str(tmp_path)) == ([("x", "conf/y/x")], None, ["circle: tsconfig.json"])
    assert source.load_tsconfig(spark, str(tmp_path), "none.json")[2] == ["absent: none.json"]
    settings, problems = source.load_settings('commits = 7\nmost_bytes = "x"\nodd = 1', {"GRAPHLOOM_COMMITS": "9", "GRAPHLOOM_NOISE": "a, b", "HOME": "/"})
    assert (settings["commits"], settings["noise"], settings["most_bytes"]) == (9, ["a", "b"], source.MOST_BYTES) and len(problems) == 2
    manifest = json.dumps({"main": "./m.js", "exports": {".": {"import": "./e.mjs", "require": "./e.cjs"}, "./sub": "./s.js"}})
    assert {r["entry"] for r in source.manifest_entries(table(spark, [("package.json", manifest)], "path string, content string")).collect()} == {"m.js", "e.mjs", "e.cjs", "s.js"}


def test_generations_and_queue(spark, tmp_path):
    store = delta.Generations(spark, f"{tmp_path}/g")
    one = table(spark, [(1, None), (2, "x")], "a long, b string")
    store.publish("first", {"t": one})
    store.publish("second", {"t": one.union(one)})
    assert store.current() == "second" and store.read("t").count() == 4 and store.validate() == store.validate("first") == []
    one.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/g/first/t")
    assert store.validate("first") == ["t"] and store.names() == ["first", "second"]
    queue = delta.SyncQueue(spark, f"{tmp_path}/q", most=3)
    queue.enqueue(["b", "a", "a"])
    queue.enqueue(["c"])
    queue._write("000000000009-bad.ticket", '{"paths": 5}')
    assert queue.drain() == (["a", "b", "c"], False) and queue.clean() == 1 and queue.drain() == ([], False)
    for _ in range(4):
        queue.enqueue(["z"])
    assert queue.drain() == (["z"], True)
    assert queue.lead() and not queue.lead()
    queue.resign()
    assert queue.lead()


def test_overlay_chains(spark):
    assert [delta.newest_to_merge(w) for w in ([], [5], [9, 4], [9, 4, 4], [4, 9], [3, 2, 1, 6])] == [0, 0, 0, 2, 2, 4]
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(9)}", seq, rng.randrange(99), rng.random() < 0.2) for seq, n in enumerate((40, 9, 4, 6)) for _ in range(n)]
    rows = list({(k, seq): (k, seq, v, d) for k, seq, v, d in rows}.values())
    chain = table(spark, rows, "path string, seq int, v long, deleted boolean")
    merged = delta.compact_overlays(chain, "path")
    assert merged.select("seq").distinct().count() < chain.select("seq").distinct().count()
    assert sorted(delta.compose_overlays(merged, "path").collect()) == sorted(delta.compose_overlays(chain, "path").collect())
    assert delta.amplified(400, 100) and not delta.amplified(399, 100)


def test_search_by_mode_and_index(spark, tmp_path):
    s = table(spark, [(f"i{i}", n, f"q.{n}", "method", f"src/{n}.ts") for i, n in enumerate(["getUser", "GetUser", "userStore", "ΑβγΔέλτα", "other"])], "id string, name string, qualified string, kind string, path string")
    assert search.query_tokens("ΑβγΔέλτα") == ["αβγ", "δέλτα"] and [r["definition_id"] for r in search.find(s, "ΑβγΔέλτα", "terms").collect()] == ["i3"]
    assert {r["value"] for r in search.find(s, "getUser").collect()} == {"getUser", "GetUser"}
    assert [r["value"] for r in search.find(s, "oher").collect()] == ["other"]
    search.write_term_index(s, f"{tmp_path}/i")
    assert search.terms(s, "user store", index=f"{tmp_path}/i").collect() == search.terms(s, "user store").collect()
    assert search.terms(s, "").count() == 0
    with pytest.raises(ValueError, match="no such mode"):
        search.find(s, "x", "odd")
    nodes = table(spark, [("src/raw.ts",), ("i0",)], "node string")
    named = search.resolve_names(s, table(spark, [("src/raw.ts",), ("i0",)], "query string"), nodes=nodes).collect()
    assert {r["query"]: (r["outcome"], r["id"]) for r in named} == {"src/raw.ts": ("resolved", "src/raw.ts"), "i0": ("resolved", "i0")}
    edges = table(spark, [("i1", "i0", "Calls", "a.ts", 1), ("i0", "i2", "Calls", "b.ts", 2), ("i4", "i1", "Calls", "c.ts", 3)], "src string, dst string, kind string, source_path string, line int")
    parts = {(r["part"], r["node"]) for r in search.explore(s, edges, "getUser").collect()}
    assert {("primary", "i0"), ("caller", "i1"), ("callee", "i2"), ("impact", "i1"), ("impact", "i4")} <= parts


def test_pages_modes_and_batches(spark):
    assert [graph.rollup_depth(m) for m in ("dir", "directory", "dir:1", "dir:10")] == [3, 3, 1, 10]
    for mode in ("dir:0", "dir:11", "dir:x", "file", "dir:"):
        with pytest.raises(ValueError, match="no such rollup"):
            graph.rollup_depth(mode)
    events = table(spark, [(1, f"2024-01-01 00:00:{i:02}", "modify", f"p{i % 7}") for i in range(20)], "workspace int, ts string, kind string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = changes.batches(events, "5 seconds", most_paths=3).collect()
    assert sorted(len(r["paths"]) for r in parts) == [1, 3, 3] and {p for r in parts for p in r["paths"]} == {f"p{i}" for i in range(7)}
    assert sorted(r["events"] for r in changes.batches(events, "5 seconds", most_span="8 seconds").collect()) == [4, 8, 8]
    kept = changes.indexable(table(spark, [("modify", "a.ts"), ("modify", "a.md"), ("modify", "x/package.json"), ("modify", "node_modules/a.ts"), ("open", "a.ts"), ("other", None)], "kind string, path string"))
    assert sorted(str(r["path"]) for r in kept.collect()) == ["None", "a.ts", "x/package.json"]
    made = []
    fresh = changes.Fresh(lambda: made.append(1) or len(made), 60)
    assert fresh.get() == fresh.get() == 1
    text = table(spark, [("'a'",), ('"b',), ("`c`",), ("'",)], "t string").select(unquoted(F.col("t")).alias("u"))
    assert [r["u"] for r in text.collect()] == ["a", '"b', "c", "'"]


def test_excerpts_in_bytes(spark):
    f = table(spark, [("a", "é" * 10), ("b", "l1\nl2\nl3")], "path string, content string")
    got = {r["path"]: (r["excerpt"], r["truncated"]) for r in source.excerpt_bytes(f, F.lit(0), F.octet_length("content"), 7, 2).collect()}
    assert got == {"a": ("1: ééé", True), "b": ("1: l1\n2: l2", True)}


def test_scopes_templates_and_type_only_names():
    found = parse_source("a.ts", "import { A, type B as C } from './a';\nfunction f(p) {\n  const x = 1; const g = () => x.run();\n  try { g(); } catch (err) { err(); }\n  return `${outer(`in`)} ${`${deep()}`}`;\n}\nfunction h() { const g = () => 1; }")
    assert [(i["local"], i["type_only"]) for i in found["imports"]] == [("A", False), ("C", True)]
    ids = [s["id"] for s in found["symbols"]]
    assert len(ids) == len(set(ids)) and sum("@scope:" in i for i in ids) == 3
    assert [r["to"] for r in found["refs"]][:1] == ["g"] and "outer" in {r["to"] for r in found["refs"]} and "err" not in {r["to"] for r in found["refs"]}

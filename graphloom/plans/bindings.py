"""The test tables as the engine's data model: graphs, symbols, files, imports, history and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges with sites: (src, dst, kind, source_path, line, type_only)."""
    links = [
        ("orders", ("orders", "o_orderkey"), ("customer", "o_custkey"), "References", None),
        ("lineitem", ("orders", "l_orderkey"), ("part", "l_partkey"), "Calls", "l_linenumber"),
        ("lineitem", ("orders", "l_orderkey"), ("supplier", "l_suppkey"), "Instantiates", "l_linenumber"),
        ("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "TypeOf", None),
        ("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "TypeOf", None),
        ("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "Extends", None),
    ]
    out = None
    for name, src, dst, kind, line in links:
        own = table(spark, sf_dir, name).select(node(*src).alias("src"), node(*dst).alias("dst"), F.lit(kind).alias("kind"), node(*src).alias("source_path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.lit(kind == "TypeOf").alias("type_only"))
        out = own if out is None else out.unionByName(own)
    return out


FK_SQL = """fk as (
select concat('orders/',o_orderkey) src, concat('customer/',o_custkey) dst, 'References' kind, concat('orders/',o_orderkey) source_path, null::int line from orders
union all select concat('orders/',l_orderkey), concat('part/',l_partkey), 'Calls', concat('orders/',l_orderkey), l_linenumber from lineitem
union all select concat('orders/',l_orderkey), concat('supplier/',l_suppkey), 'Instantiates', concat('orders/',l_orderkey), l_linenumber from lineitem
union all select concat('customer/',c_custkey), concat('nation/',c_nationkey), 'TypeOf', concat('customer/',c_custkey), null from customer
union all select concat('supplier/',s_suppkey), concat('nation/',s_nationkey), 'TypeOf', concat('supplier/',s_suppkey), null from supplier
union all select concat('nation/',n_nationkey), concat('region/',n_regionkey), 'Extends', concat('nation/',n_nationkey), null from nation)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: supplier's nation to customer's nation, where they trade 1.5 times the mean or more."""
    t = lambda n: table(spark, sf_dir, n)
    pairs = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = pairs.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).filter(F.col("n") >= 1.5 * F.col("total") / 625).select(F.concat(F.lit("apps/n"), "s_nationkey", F.lit("/src/a.ts")).alias("src"), F.concat(F.lit("apps/n"), "c_nationkey", F.lit("/src/a.ts")).alias("dst"), F.lit("Import").alias("kind"))


TRADE_SQL = """tc as (select s_nationkey s, c_nationkey c, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
trade as (select concat('apps/n', s, '/src/a.ts') src, concat('apps/n', c, '/src/a.ts') dst from tc where n >= 1.5 * (select sum(n) from tc) / 625)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, qualified, kind, path) from customers, parts (with homonyms) and suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select(F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("."), "c_name").alias("qualified"), F.lit("class_declaration").alias("kind"), F.concat(F.lit("apps/"), F.lower("c_mktsegment"), F.lit("/src/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".ts")).alias("path"))
    p = t("part").select(F.col("p_name"), F.concat("p_brand", F.lit("."), "p_name"), F.lit("method"), F.concat(F.lit("libs/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/src/"), F.lower("p_type"), F.lit("/p"), "p_partkey", F.lit(".ts")))
    s = t("supplier").select(F.col("s_name"), F.concat(F.lit("n"), "s_nationkey", F.lit("."), "s_name"), F.lit("interface_declaration"), F.concat(F.lit("packages/n"), "s_nationkey", F.lit("/src/s"), "s_suppkey", F.lit(".ts")))
    both = c.union(p).union(s)
    return both.select(F.concat(F.lit("symbol://"), "path", F.lit("#value:"), "name").alias("id"), "name", "qualified", "kind", "path")


SYMBOLS_SQL = """sy as (select concat('symbol://', path, '#value:', name) id, * from (
select c_name as name, concat(c_mktsegment,'.',c_name) qualified, 'class_declaration' kind, concat('apps/',lower(c_mktsegment),'/src/n',c_nationkey,'/c',c_custkey,'.ts') path from customer
union all select p_name, concat(p_brand,'.',p_name), 'method', concat('libs/',lower(replace(p_brand,'#','')),'/src/',lower(p_type),'/p',p_partkey,'.ts') from part
union all select s_name, concat('n',s_nationkey,'.',s_name), 'interface_declaration', concat('packages/n',s_nationkey,'/src/s',s_suppkey,'.ts') from supplier))"""


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the parts and parts to the suppliers of their order lines, as symbol ids with sites."""
    t = lambda n: table(spark, sf_dir, n)
    cid = F.concat(F.lit("symbol://apps/"), F.lower("c_mktsegment"), F.lit("/src/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".ts#value:"), "c_name")
    pid = F.concat(F.lit("symbol://libs/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/src/"), F.lower("p_type"), F.lit("/p"), "p_partkey", F.lit(".ts#value:"), "p_name")
    sid = F.concat(F.lit("symbol://packages/n"), "s_nationkey", F.lit("/src/s"), "s_suppkey", F.lit(".ts#value:"), "s_name")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = t("part").select(F.col("p_partkey").alias("_p"), pid.alias("pid"))
    customers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", cid.alias("cid")), F.col("o_custkey") == F.col("c_custkey"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("_s"), sid.alias("sid"))
    own = lines.join(parts, F.col("l_partkey") == F.col("_p"))
    a = own.join(customers, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("cid").alias("src"), F.col("pid").alias("dst"), F.lit("Calls").alias("kind"), F.col("l_linenumber").cast("int").alias("line"))
    b = own.join(suppliers, F.col("l_suppkey") == F.col("_s")).select(F.col("pid").alias("src"), F.col("sid").alias("dst"), F.lit("TypeOf").alias("kind"), F.col("l_linenumber").cast("int").alias("line"))
    return a.union(b).withColumn("source_path", F.regexp_extract("src", r"^symbol://([^#]*)#", 1))


SYMBOL_EDGES_SQL = """cs as (select c_custkey, concat('symbol://apps/',lower(c_mktsegment),'/src/n',c_nationkey,'/c',c_custkey,'.ts#value:',c_name) cid from customer),
ps as (select p_partkey, concat('symbol://libs/',lower(replace(p_brand,'#','')),'/src/',lower(p_type),'/p',p_partkey,'.ts#value:',p_name) pid from part),
ss as (select s_suppkey, concat('symbol://packages/n',s_nationkey,'/src/s',s_suppkey,'.ts#value:',s_name) sid from supplier),
se as (select cid src, pid dst, 'Calls' kind, l_linenumber::int line, regexp_extract(cid, '^symbol://([^#]*)#', 1) source_path from lineitem join ps on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join cs on o_custkey = c_custkey
union all select pid, sid, 'TypeOf', l_linenumber::int, regexp_extract(pid, '^symbol://([^#]*)#', 1) from lineitem join ps on l_partkey = p_partkey join ss on l_suppkey = s_suppkey)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, bytes, doc_id, source, lang, n_chars) from documents."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ["ts", "js", "tsx", "py", "vue"])), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 11 == 0, "node_modules/x").otherwise("src")
    return d.select(F.concat(F.lit("apps/"), "source", F.lit("/"), folder, F.lit("/"), "lang", F.lit("/d"), F.col("doc_id") - F.col("doc_id") % 5, F.lit("."), ext).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("bytes"), "doc_id", "source", "lang", "n_chars")


FILES_SQL = """fi as (select concat('apps/', source, '/', case when doc_id % 11 = 0 then 'node_modules/x' else 'src' end, '/', lang, '/d', doc_id - doc_id % 5, '.',
case doc_id % 5 when 0 then 'ts' when 1 then 'js' when 2 then 'tsx' when 3 then 'py' else 'vue' end) path, text as content, strlen(text)::bigint bytes, doc_id, source, lang, n_chars from documents)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of (path, hash, name): of ten files one goes, one changes, and one new one comes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    row = lambda i, text: [F.concat(F.lit("d"), i, F.lit(".ts")).alias("path"), F.sha2(text, 256).alias("hash"), "lang"]
    first = d.select(*row(F.col("doc_id"), F.col("text")))
    kept = d.filter("doc_id % 10 <> 0").select(*row(F.col("doc_id"), F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    fresh = d.filter("doc_id % 10 = 2").select(*row(F.col("doc_id") + 10_000_000_000, F.col("text")))
    return first, kept.union(fresh)


VERSIONS_SQL = """v1 as (select concat('d', doc_id, '.ts') path, sha256(text) hash, lang from documents),
v2 as (select concat('d', doc_id, '.ts') path, sha256(case when doc_id % 10 = 1 then text || 'x' else text end) hash, lang from documents where doc_id % 10 <> 0
union all select concat('d', doc_id + 10000000000, '.ts'), sha256(text), lang from documents where doc_id % 10 = 2)"""


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part files that import others by relative, aliased and unknown specifiers, and the files there are."""
    lines = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    specifier = F.when(k % 4 == 0, F.concat(F.lit("./p"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("../m/./p"), k.cast("string"), F.lit(".js"))).when(k % 4 == 2, F.concat(F.lit("@app/p"), k.cast("string"))).otherwise(F.concat(F.lit("lib"), k.cast("string")))
    i = lines.select(F.concat(F.lit("src/m/p"), "l_partkey", F.lit(".ts")).alias("path"), specifier.alias("specifier")).distinct()
    f = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("src/m/p"), "p_partkey", F.lit(".ts"))).otherwise(F.concat(F.lit("src/m/p"), "p_partkey", F.lit("/index.js"))).alias("path"))
    return i, f


IMPORTS_SQL = """im as (select distinct concat('src/m/p', l_partkey, '.ts') path, case l_suppkey % 4 when 0 then concat('./p', l_suppkey) when 1 then concat('../m/./p', l_suppkey, '.js') when 2 then concat('@app/p', l_suppkey) else concat('lib', l_suppkey) end specifier, l_suppkey k from lineitem),
ri as (select path, specifier, case when k % 4 = 3 or k % 3 = 0 or p_partkey is null then specifier when k % 3 = 1 then concat('src/m/p', k, '.ts') when k % 4 = 1 then specifier else concat('src/m/p', k, '/index.js') end dst,
not (k % 4 = 3 or k % 3 = 0 or p_partkey is null or (k % 3 = 2 and k % 4 = 1)) resolved from im left join part on p_partkey = k)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace, ts, kind, path): users as workspaces, event types as paths; errors name no path, views only read."""
    kind = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "view", "read").otherwise("modify")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace"), "ts", kind.alias("kind"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("path"))


EVENTS_SQL = """ev as (select user_id workspace, ts, case event_type when 'error' then 'other' when 'view' then 'read' else 'modify' end kind, case when event_type <> 'error' then event_type end path from events)"""


def code(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source code as tables (symbols, bindings, exports, refs): a class per supplier with a method per quantity it sold, a
    class per customer with a field of a supplier's type, and a reference per order, of a form by its priority.

    Customers of nation 0 import nothing by name, those of nation 1 through a barrel file that re-exports all."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    k, n, c = F.col("l_suppkey"), F.col("l_quantity").cast("int"), F.col("c_custkey")
    supplier = text("S", F.col("s_suppkey"))
    none, no = F.lit(None).cast("string"), F.lit(False)

    def symbol(df, path, name, qualified, kind, exported, declared=none):
        named = df.select(path.alias("path"), name.alias("name"), qualified.alias("qualified"), F.lit(kind).alias("kind"), exported.alias("exported"), declared.alias("declared"), F.lit(1).cast("long").alias("span_size"))
        return named.withColumn("id", text("symbol://", F.col("path"), "#value:", F.col("qualified")))

    methods = t("lineitem").select(k.alias("k"), n.alias("n")).distinct()
    wanted = text("S", c % 100 + 1)
    symbols = symbol(t("supplier"), text("src/s", F.col("s_suppkey"), ".ts"), supplier, supplier, "class_declaration", F.lit(True))
    symbols = symbols.unionByName(symbol(methods, text("src/s", F.col("k"), ".ts"), text("m", F.col("n")), text("S", F.col("k"), ".m", F.col("n")), "method", no))
    symbols = symbols.unionByName(symbol(t("customer"), text("src/c", c, ".ts"), text("C", c), text("C", c), "class_declaration", F.lit(True)))
    symbols = symbols.unionByName(symbol(t("customer"), text("src/c", c, ".ts"), F.lit("f"), text("C", c, ".f"), "public_field_definition", no, wanted))
    source = text("src/s", c % 100 + 1, ".ts")
    path = text("src/c", c, ".ts").alias("path")
    named = t("customer").filter("c_nationkey <> 0").select(path, wanted.alias("local"), wanted.alias("imported"), F.when(F.col("c_nationkey") == 1, "src/index.ts").otherwise(source).alias("source"), F.lit("named").alias("kind"))
    spaces = t("customer").select(path, F.lit("ns").alias("local"), F.lit("*").alias("imported"), source.alias("source"), F.lit("namespace").alias("kind"))
    exports = t("supplier").select(F.lit("src/index.ts").alias("file"), F.lit("*").alias("exported"), none.alias("local"), text("src/s", F.col("s_suppkey"), ".ts").alias("source"))
    j, q, owner = F.col("o_custkey") % 100 + 1, F.col("o_orderkey") % 60, text("C", F.col("o_custkey"))
    form = F.substring("o_orderpriority", 1, 1)
    name = F.when(form == "1", text("this.f.m", q)).when(form == "2", F.lit("this.f")).when(form == "3", text("S", j, ".m", q)).when(form == "4", text("ns.S", j)).otherwise(text("S", j))
    refs = t("orders").select(F.col("o_orderkey").alias("ref"), text("src/c", F.col("o_custkey"), ".ts").alias("path"), owner.alias("owner"), name.alias("name"), F.lit("Calls").alias("kind"))
    return {"symbols": symbols, "bindings": named.unionByName(spaces), "exports": exports, "refs": refs}


CODE_SQL = """mt as (select distinct l_suppkey k, l_quantity::int n from lineitem),
cu as (select c_custkey c, c_nationkey nation, c_custkey % 100 + 1 j, s_suppkey from customer left join supplier on s_suppkey = c_custkey % 100 + 1),
rf as (select o_orderkey ref, o_custkey c, left(o_orderpriority, 1) form, o_orderkey % 60 q, nation, j, s_suppkey, mt.n from orders join cu on c = o_custkey left join mt on mt.k = j and mt.n = o_orderkey % 60)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file of TypeScript per supplier."""
    k, j = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + F.col("s_nationkey")).cast("string")
    text = F.lit(
        "import { Sj as Base, type Tj } from './sj';\nimport * as tools from '../tools';\nexport { Sj as Againk } from './sj';\n"
        "export interface Tk { size: Tj }\nexport class Sk extends Base implements Tk {\n  private tool: Tj;\n"
        "  run(a) { const local = 1; local.go(); return this.stop(`x${tools.help(a)}y`); }\n  stop() { try { this.tool.go(); } catch (e) { e(); } }\n}\n"
        "export function makek() { const inner = () => new Sk(); return inner(); }\n"
    )
    content = F.regexp_replace(F.regexp_replace(text, r"(\bS|\bT|/s)j\b", F.concat(F.lit("$1"), j)), r"(\bS|\bT|Again|make)k\b", F.concat(F.lit("$1"), k))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".ts")).alias("path"), content.alias("content"))

"""References to definitions, in full: members of this, of fields' types, of imported names and namespaces; symbol imports.

Tables: symbols (id, path, name, qualified, kind, exported, declared, span_size) with the declared type of fields;
bindings (path, local, imported, source, kind) with kind named, default or namespace and source the imported file; exports
(file, exported, local, source) as in ``resolve``, where local ``*`` under a name is a namespace re-export; refs (ref,
path, owner, name, kind) with owner the qualified name of the class around. Optional: ``at`` of refs, and ``low``,
``scope_low``, ``scope_high`` of symbols, for names that hold in a part of their file only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TYPE_KINDS
from ..plans.store import stored
from .resolve import resolve_exports

#: Kinds that a type may name.
TYPE_LIKE = [*TYPE_KINDS, "class_declaration", "abstract_class_declaration", "enum_declaration"]
#: Kinds that hold before their declaration.
HOISTED = ["function_declaration", "generator_function_declaration", "method", *TYPE_KINDS]
_SYMBOL = ["id", "path", "name", "qualified", "kind", "exported", "declared", "span_size", "low", "scope_low", "scope_high"]


def required_space(kind: Column) -> Column:
    """What a reference of this kind must name: a type or a value."""
    return F.when(kind.isin("TypeOf", "Implements"), "type").otherwise("value")


def _fits(kind: Column, space: Column) -> Column:
    return F.when(space == "type", kind.isin(*TYPE_LIKE)).otherwise(~kind.isin(*TYPE_KINDS))


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    """df with null columns where it has none of the names."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def one_logical(hits: DataFrame, key: list[str]) -> DataFrame:
    """Of hits (key, id, path, qualified, kind, span_size) the one definition of each key, if there is just one: rows of one
    path, qualified name and space are one (overloads), and the largest span stands for them."""
    space = F.when(F.col("kind").isin(*TYPE_KINDS), "type").otherwise("value")
    best = F.max_by(F.struct("id", "path", "qualified"), F.struct(F.coalesce("span_size", F.lit(0)), "id"))
    return hits.groupBy(*key).agg(F.count_distinct("path", "qualified", space).alias("_n"), best.alias("_d")).filter("_n = 1").select(*key, "_d.*")


def namespaces_and_names(bindings: DataFrame, exports: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What bindings stand for: namespaces (path, local, file), and names (path, local, type_only, id), all definitions."""
    bindings = _with(bindings, type_only="boolean")
    plain = bindings.filter("kind <> 'namespace'").withColumn("name", F.when(F.col("kind") == "default", "default").otherwise(F.col("imported")))
    # A namespace re-export under the name, from just one file, makes the binding a namespace too.
    spaces = exports.filter("local = '*' and exported <> '*' and source is not null").groupBy("file", "exported").agg(F.count_distinct("source").alias("_n"), F.min("source").alias("_to")).filter("_n = 1")
    through = plain.join(spaces, (F.col("source") == F.col("file")) & (F.col("name") == F.col("exported")), "left")
    spaced = bindings.filter("kind = 'namespace'").select("path", "local", F.col("source").alias("file")).union(through.filter("_to is not null").select("path", "local", "_to"))
    rest = through.filter("_to is null").select("path", "local", "type_only", "source", "name")
    found = resolve_exports(exports.filter("local is null or local <> '*' or exported = '*'"), symbols, rest.select(F.col("source").alias("file"), "name"))
    named = rest.join(found, (F.col("source") == F.col("file")) & (rest.name == found.name)).select("path", "local", "type_only", "id")
    return stored(spaced.distinct()), stored(named.distinct())


def import_edges(resolved: DataFrame, bindings: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, score, reason, type_only) of imports: one edge per specifier of resolved (path, specifier, dst,
    resolved) to its file, with score 1, or to the specifier itself with score 0; one more per binding to the type and the
    value that its name stands for; and one per re-export of a file."""
    whole = resolved.select(F.col("path").alias("src"), "dst", F.lit("Import").alias("kind"), F.when(F.col("resolved"), 1.0).otherwise(0.0).alias("score"), F.when(F.col("resolved"), "file").otherwise("unresolved").alias("reason"), F.lit(False).alias("type_only"))
    _, names = namespaces_and_names(bindings, exports, symbols)
    hits = names.join(_with(symbols, span_size="long").select("id", F.col("path").alias("to"), "qualified", "kind", "span_size"), "id")
    asked = hits.withColumn("space", F.explode(F.array(F.lit("type"), F.lit("value")))).filter(_fits(F.col("kind"), F.col("space")) & ((F.col("space") == "type") | ~F.coalesce("type_only", F.lit(False))))
    one = one_logical(asked.select(F.col("path").alias("src"), "local", "type_only", "space", "id", F.col("to").alias("path"), "qualified", "kind", "span_size"), ["src", "local", "type_only", "space"])
    kinds = symbols.select("id", F.col("kind").isin(*TYPE_KINDS).alias("_type")).distinct()
    symbol = one.join(kinds, "id").select("src", F.col("id").alias("dst"), F.lit("Import").alias("kind"), F.lit(1.0).alias("score"), F.lit("unique_symbol").alias("reason"), (F.coalesce("type_only", F.lit(False)) | F.col("_type")).alias("type_only"))
    again = exports.filter("source is not null").select(F.col("file").alias("src"), F.col("source").alias("dst"), F.lit("ReExport").alias("kind"), F.lit(1.0).alias("score"), F.lit("file").alias("reason"), F.lit(False).alias("type_only"))
    return whole.unionByName(symbol.distinct()).unionByName(again.distinct())


def resolve_members(refs: DataFrame, symbols: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(ref, dst, how) of the references that name one definition.

    ``this.x`` is a member of the class around; else ``this.field.x`` one of the field's declared type. Of another dotted
    name the head decides: a definition that holds here, then a namespace, then an imported name; where it is none of them
    the whole is taken as a qualified name of the file. A bare name is a definition that holds here, else an imported one."""
    s = _with(symbols, declared="string", span_size="long", low="long", scope_low="long", scope_high="long").select(_SYMBOL)
    s = stored(s)  # joined in a dozen places
    r = _with(refs, owner="string", at="long").select("ref", "path", "owner", "at", F.col("name").alias("raw"), required_space(F.col("kind")).alias("space"))
    r = stored(r.withColumn("head", F.split("raw", r"\.", 2)[0]).withColumn("tail", F.get(F.split("raw", r"\.", 2), F.lit(1))))
    spaces, names = namespaces_and_names(bindings, exports, symbols)

    def here(asked: DataFrame) -> DataFrame:
        """asked (ref, path, at, name, space): the definition that holds at the place, that of the smallest scope."""
        hits = asked.join(s.withColumnRenamed("id", "_id"), ["path", "name"]).filter(_fits(F.col("kind"), F.col("space")))
        inside = F.col("scope_low").isNull() | F.col("at").between(F.col("scope_low"), F.col("scope_high"))
        known = F.col("at").isNull() | F.col("low").isNull() | (F.col("low") <= F.col("at")) | F.col("kind").isin(*HOISTED)
        size = F.coalesce(F.col("scope_high") - F.col("scope_low"), F.lit((1 << 62)))
        seen = hits.filter(inside & known).withColumn("_size", size)
        least = F.min("_size").over(Window.partitionBy("ref"))
        return one_logical(seen.withColumn("_least", least).filter("_size = _least").withColumnRenamed("_id", "id"), ["ref"])

    def imported(asked: DataFrame) -> DataFrame:
        hits = asked.select("ref", F.col("path").alias("_p"), "name", "space").join(names.select(F.col("path").alias("_p"), F.col("local").alias("name"), "id"), ["_p", "name"])
        return one_logical(hits.drop("name").join(s, "id").filter(_fits(F.col("kind"), F.col("space"))), ["ref"])

    def bare(asked: DataFrame) -> DataFrame:
        """(ref, id, path, qualified, how)"""
        local = here(asked).withColumn("how", F.lit("local"))
        return local.unionByName(imported(asked.join(local.select("ref"), "ref", "left_anti")).withColumn("how", F.lit("import")))

    def qualified(asked: DataFrame) -> DataFrame:
        """asked (ref, path, wanted, space, how): (ref, id, how) of the definition with this qualified name in the file."""
        named = s.select("id", "path", F.col("qualified").alias("wanted"), "kind", "span_size")
        hits = asked.join(named, ["path", "wanted"]).filter(_fits(F.col("kind"), F.col("space"))).withColumnRenamed("wanted", "qualified")
        return one_logical(hits, ["ref", "how"]).select("ref", "id", "how")

    dotted = F.col("tail").isNotNull()
    value, at_type = F.lit("value").alias("space"), F.lit("type").alias("space")
    # Members of this, then of fields' types.
    own = r.filter((F.col("head") == "this") & dotted)
    direct = qualified(own.select("ref", "path", F.concat_ws(".", "owner", "tail").alias("wanted"), "space", F.lit("this").alias("how")))
    hop = own.join(direct.select("ref"), "ref", "left_anti").withColumn("field", F.split("tail", r"\.", 2)[0]).withColumn("rest", F.get(F.split("tail", r"\.", 2), F.lit(1))).filter("rest is not null")
    fields = s.filter("declared is not null").select("path", F.col("qualified").alias("_field"), "declared")
    typed = hop.withColumn("_field", F.concat_ws(".", "owner", "field")).join(fields, ["path", "_field"])
    types = bare(typed.select("ref", "path", "at", F.col("declared").alias("name"), at_type))
    through = qualified(types.join(hop.select("ref", "rest"), "ref").select("ref", "path", F.concat_ws(".", "qualified", "rest").alias("wanted"), value, F.lit("field").alias("how")))
    # Other dotted names, by what their head is.
    others = r.filter((F.col("head") != "this") & dotted)
    heads = others.select("ref", "path", "at", F.col("head").alias("name"), "space")
    local = here(heads.drop("space").withColumn("space", F.lit("value")))
    rest = heads.join(local.select("ref"), "ref", "left_anti")
    spaced = rest.join(spaces.select("path", F.col("local").alias("name"), "file"), ["path", "name"]).select("ref", "file", "space")
    bound = imported(rest.join(spaced.select("ref"), "ref", "left_anti"))
    tails = others.select("ref", "tail", F.col("space").alias("_space"))
    member = lambda found, how: found.join(tails, "ref").select("ref", "path", F.concat_ws(".", "qualified", "tail").alias("wanted"), F.col("_space").alias("space"), F.lit(how).alias("how"))
    plain = rest.join(spaced.select("ref").union(bound.select("ref")), "ref", "left_anti").select("ref")
    raw = others.join(plain, "ref").select("ref", "path", F.col("raw").alias("wanted"), "space", F.lit("qualified").alias("how"))
    members = qualified(member(local, "local").unionByName(member(bound, "import")).unionByName(raw))
    # Names of namespaces, and members of what they name.
    asked = stored(spaced.join(tails, "ref").select("ref", "file", F.split("tail", r"\.", 2)[0].alias("name"), F.get(F.split("tail", r"\.", 2), F.lit(1)).alias("rest"), "space"))
    found = resolve_exports(exports.filter("local is null or local <> '*' or exported = '*'"), symbols, asked.select("file", "name"))
    named = one_logical(asked.join(found, ["file", "name"]).select("ref", "rest", "space", "id").join(s, "id").filter(_fits(F.col("kind"), F.col("space"))), ["ref", "rest", "space"])
    inside = named.filter("rest is null").select("ref", "id", F.lit("namespace").alias("how"))
    deeper = qualified(named.filter("rest is not null").select("ref", "path", F.concat_ws(".", "qualified", "rest").alias("wanted"), "space", F.lit("namespace").alias("how")))
    single = bare(r.filter(~dotted).select("ref", "path", "at", F.col("raw").alias("name"), "space")).select("ref", "id", "how")
    every = direct
    for part in (through, members, inside, deeper, single):
        every = every.unionByName(part)
    return every.select("ref", F.col("id").alias("dst"), "how")

"""Name resolution as joins: import specifiers to files, re-exports, references to definitions, and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EXTENSIONS, TYPE_KINDS, normalize_path
from ..plans.store import measured, stored


_KNOWN_EXTENSION = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$"


def probe_table(files: DataFrame) -> DataFrame:
    """For each module path that some file answers: (key, exact, with_extension, index), the files that are tried for it.

    Of files that differ only in a known extension the first in the order of extensions counts."""
    extension = F.regexp_extract("path", _KNOWN_EXTENSION, 1)
    stem = F.regexp_replace("path", _KNOWN_EXTENSION, "")
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), extension)
    none = F.lit(None).cast("string")
    entry = lambda key, exact, file, index: F.struct(key.alias("key"), exact.alias("exact"), F.when(file.isNotNull(), F.struct(rank.alias("r"), file.alias("f"))).alias("file"), F.when(index.isNotNull(), F.struct(rank.alias("r"), index.alias("f"))).alias("index"))
    path = F.col("path")
    keys = F.array(entry(path, path, none, none), F.when(extension != "", entry(stem, none, path, none)), F.when((extension != "") & stem.rlike("(^|/)index$"), entry(F.regexp_replace(stem, "/?index$", ""), none, none, path)))
    each = files.select("path").distinct().select(F.explode(F.array_compact(keys)).alias("e")).select("e.*")
    return each.groupBy("key").agg(F.max("exact").alias("exact"), F.min("file")["f"].alias("with_extension"), F.min("index")["f"].alias("index"))


def alias_targets(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports (path, specifier) with module: the specifier under the most specific alias (pattern, target) that fits.

    An exact pattern goes before ``*``; of those the longest prefix wins, then the longest suffix. Aliases are
    configuration: a table of the project file's size."""
    a = aliases.select("target", F.split("pattern", r"\*")[0].alias("_pre"), F.coalesce(F.get(F.split("pattern", r"\*"), F.lit(1)), F.lit("")).alias("_suf"), F.col("pattern").contains("*").alias("_star"))
    s = F.col("specifier")
    fits = F.when(F.col("_star"), s.startswith(F.col("_pre")) & s.endswith(F.col("_suf")) & (F.length(s) >= F.length("_pre") + F.length("_suf"))).otherwise(s == F.col("_pre"))
    star = F.substring(s, F.length("_pre") + 1, F.length(s) - F.length("_pre") - F.length("_suf"))
    named = imports.join(F.broadcast(a), fits, "left").withColumn("_to", F.when(F.col("_star"), F.replace(F.col("target"), F.lit("*"), star)).otherwise(F.col("target")))
    return named.groupBy("path", "specifier").agg(F.max_by("_to", F.when(F.col("_to").isNotNull(), F.struct(~F.col("_star"), F.length("_pre"), F.length("_suf"), F.col("_to")))).alias("module"))


def import_bases(imports: DataFrame, aliases: DataFrame | None = None, base_url: str | None = None) -> DataFrame:
    """(path, specifier, base, bare): the module path that each import names, and the same without a known extension.

    Relative specifiers start at the importer's folder; others at the best alias, else at base_url (else both are null)."""
    i = imports.select("path", "specifier").distinct()
    i = alias_targets(i, aliases) if aliases is not None else i.withColumn("module", F.lit(None).cast("string"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rooted = F.concat(F.lit(f"{base_url}/"), "specifier") if base_url is not None else F.lit(None).cast("string")
    base = normalize_path(F.when(F.col("specifier").startswith("."), F.concat(folder, "specifier")).otherwise(F.coalesce("module", rooted)))
    return i.select("path", "specifier", base.alias("base")).withColumn("bare", F.regexp_replace("base", _KNOWN_EXTENSION, ""))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, base_url: str | None = None) -> DataFrame:
    """(path, specifier, dst, resolved): the first candidate file that exists, else the specifier itself.

    Candidates: the module path itself, with each known extension, without its extension and with each, as a folder's index.
    Files are keyed by what they answer to, so an import is joined twice, not once per candidate."""
    known = probe_table(files)
    asked = import_bases(imports, aliases, base_url)
    found = asked.join(known.withColumnRenamed("key", "_key"), F.col("base") == F.col("_key"), "left")
    # A specifier with the extension of the emitted file stands for the source beside it.
    swapped = known.select(F.col("key").alias("_key2"), F.col("with_extension").alias("_swapped"))
    found = found.join(swapped, (F.col("bare") == F.col("_key2")) & (F.col("bare") != F.col("base")), "left")
    to = F.coalesce("exact", "with_extension", "_swapped", "index")
    return found.select("path", "specifier", F.coalesce(to, "specifier").alias("dst"), to.isNotNull().alias("resolved"))


def resolve_exports(exports: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, name, id): the definitions behind names that files export, through chains of re-exports.

    exports: (file, exported, local, source) with exported ``*`` for a star and source null for local exports. wanted:
    (file, name). A pair already seen is not followed again, so circles end."""
    asked = wanted.select("file", "name").distinct().select(F.col("file").alias("ask_file"), F.col("name").alias("ask_name"), "file", "name")
    count = F.count(F.lit(1)).alias("n")
    level, size = measured(asked, count)
    levels: list[DataFrame] = []
    out = None
    while size["n"]:
        levels.append(level)
        seen = reduce(DataFrame.unionByName, levels)
        here = level.join(symbols.filter("exported").select(F.col("path").alias("file"), "name", "id"), ["file", "name"]).select("ask_file", "ask_name", "id")
        links = level.join(exports, "file").filter("exported = name or exported = '*'")
        local = links.filter("source is null and exported = name").join(symbols.select(F.col("path").alias("file"), F.col("name").alias("local"), "id"), ["file", "local"]).select("ask_file", "ask_name", "id")
        found = here.unionByName(local)
        out = found if out is None else out.unionByName(found)
        step = links.filter("source is not null").select("ask_file", "ask_name", F.col("source").alias("file"), F.when(F.col("exported") == "*", F.col("name")).otherwise(F.col("local")).alias("name")).distinct()
        level, size = measured(step.join(seen, ["ask_file", "ask_name", "file", "name"], "left_anti"), count)
    return (out if out is not None else asked.select("ask_file", "ask_name", F.lit("").alias("id")).limit(0)).distinct().select(F.col("ask_file").alias("file"), F.col("ask_name").alias("name"), "id")


def unique_definitions(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref, name, space) with the one definition of the name in the space, if there is just one logical one.

    Definitions that share path, qualified name and space are one (overloads); the largest span stands for them."""
    space = F.when(F.col("kind").isin(*TYPE_KINDS), "type").otherwise("value")
    d = symbols.select("name", "id", "qualified", "path", space.alias("space"), "span_size")
    found = refs.join(d, ["name", "space"])
    return found.groupBy("ref").agg(F.count_distinct("path", "qualified").alias("_n"), F.max_by("id", F.struct("span_size", "id")).alias("id")).filter("_n = 1").select("ref", "id")


def enclosing_scopes(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points (key, at) with the smallest of scopes (key, scope, low, high) that holds each.

    A scope of at most 2**n places lies in one or two cells of that width, so a point meets the scopes of its own cells, one
    for each width there is (64 at most), and not all of its key's."""
    sized = scopes.filter("low <= high").withColumn("_n", F.ceil(F.log2((F.col("high") - F.col("low") + 1).cast("double"))).cast("int"))
    widths = sorted(r[0] for r in sized.select("_n").distinct().collect())  # 64 at most
    cell = lambda c: F.expr(f"floor({c} / pow(2, _n))")
    placed = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("low"), cell("high"))))).select("key", "scope", "low", "high", "_n", "_cell")
    tried = points.select("key", "at", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>")).alias("_n")).withColumn("_cell", cell("at"))
    inside = tried.join(placed, ["key", "_n", "_cell"]).filter("at >= low and at <= high")
    return inside.groupBy("key", "at").agg(F.min_by("scope", F.struct(F.col("high") - F.col("low"), F.col("scope"))).alias("scope"))


def longest_owner(names: DataFrame, owners: DataFrame) -> DataFrame:
    """names (name) with the longest of owners (owner) that is a proper dotted prefix: prefixes are exploded, so it is an equi-join."""
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = names.select("name", F.explode_outer(F.when(F.size(parts) > 1, prefixes)).alias("owner"))
    hit = each.join(owners.select("owner", F.lit(True).alias("_own")).distinct(), "owner", "left")
    return hit.groupBy("name").agg(F.max_by(F.when(F.col("_own"), F.col("owner")), F.when(F.col("_own"), F.length("owner"))).alias("owner"))


def resolve_references(refs: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """refs (ref, path, name, kind) to (ref, src_path, dst, kind, how): a definition in the same file, else an import binding
    (path, local, dst), else a name defined once anywhere; the first that fits, and only if it is unique."""
    local = refs.join(symbols.select("path", "name", F.col("id").alias("dst")), ["path", "name"]).withColumns({"order": F.lit(0), "how": F.lit("local")})
    bound = refs.join(bindings.select("path", F.col("local").alias("name"), "dst"), ["path", "name"]).withColumns({"order": F.lit(1), "how": F.lit("import")})
    once = symbols.groupBy("name").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("dst")).filter("_n = 1").drop("_n")
    anywhere = refs.join(once, "name").withColumns({"order": F.lit(2), "how": F.lit("unique")})
    columns = ["ref", "path", "kind", "dst", "order", "how"]
    every = local.select(columns).unionByName(bound.select(columns)).unionByName(anywhere.select(columns))
    best = every.withColumn("_first", F.min("order").over(Window.partitionBy("ref"))).filter("order = _first")
    return best.groupBy("ref", "path", "kind", "how").agg(F.count_distinct("dst").alias("_n"), F.min("dst").alias("dst")).filter("_n = 1").select("ref", F.col("path").alias("src_path"), "dst", "kind", "how")


def build_edges(import_edges: DataFrame, reference_edges: DataFrame) -> DataFrame:
    """Import edges as they are, reference edges once each and without self-edges: (src, dst, kind, resolved)."""
    refs = reference_edges.select("src", "dst", "kind", F.lit(True).alias("resolved")).filter("src <> dst").distinct()
    return import_edges.select("src", "dst", "kind", "resolved").unionByName(refs)


def reverse_index(edges: DataFrame) -> DataFrame:
    """(dst, sources): who refers to each node, sorted."""
    return edges.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), "|").alias("sources"))


def affected_files(changed_paths: DataFrame, changed_names: DataFrame, probes: DataFrame, definers: DataFrame, referrers: DataFrame) -> DataFrame:
    """Changed files, files that tried to import one of them (also in vain), and files that define or refer to a changed name."""
    importers = probes.join(changed_paths.withColumnRenamed("path", "probed"), "probed", "left_semi").select("path")
    named = definers.unionByName(referrers).join(changed_names, "name", "left_semi").select("path")
    return changed_paths.select("path").union(importers).union(named).distinct()


def sync_imports(edges: DataFrame, imports: tuple[DataFrame, DataFrame], files: tuple[DataFrame, DataFrame], aliases: DataFrame | None = None, base_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (path, specifier, dst, resolved) of the state before, brought to the state after, and the importers redone.

    imports and files are those before and after. Only importers whose imports changed, or that try a file that came or
    went (in vain or not), are resolved anew; the result equals a full rebuild."""
    old, new = (i.select("path", "specifier").distinct() for i in imports)
    changed = old.exceptAll(new).unionAll(new.exceptAll(old)).select("path")
    before, after = (f.select("path").distinct() for f in files)
    moved = before.exceptAll(after).unionAll(after.exceptAll(before))
    keys = probe_table(moved).select("key")
    tries = import_bases(new, aliases, base_url).select("path", F.explode(F.array_distinct(F.array("base", "bare"))).alias("key"))
    affected = stored(changed.union(tries.join(keys, "key", "left_semi").select("path")).distinct())
    fresh = resolve_imports(new.join(affected, "path", "left_semi"), files[1], aliases, base_url)
    return edges.join(affected, "path", "left_anti").select(fresh.columns).unionByName(fresh), affected


def sync_tier(changed_files: int, changed_names: int, moved_files: int, affected: int, total: int, share: float = 0.5) -> str:
    """How a sync goes on: ``none`` without any change, ``content`` where no name and no file came or went, ``delta`` where the
    affected files are at most a share of all, else ``full``."""
    if not changed_files:
        return "none"
    if not changed_names and not moved_files:
        return "content"
    return "delta" if affected <= share * total else "full"

"""Findings over edges and packages: dangling and unresolved edges, layer rules, coupling ceilings, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EXTENSIONS, glob_matches

FINDING = ["code", "src", "dst"]


@dataclass
class Layer:
    name: str
    packages: list[str]
    allow: list[str] = field(default_factory=list)
    forbid: list[str] = field(default_factory=list)


@dataclass
class Boundaries:
    layers: list[Layer] = field(default_factory=list)
    most_dependencies: int | None = None
    most_incoming: int | None = None
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)


def load_boundaries(path: str) -> Boundaries:
    """A TOML policy; an absent file is an empty policy, a broken one an error."""
    import os
    import tomllib

    if not os.path.exists(path):
        return Boundaries()
    with open(path, "rb") as f:
        data = tomllib.load(f)
    coupling, cross = data.get("coupling", {}), data.get("cross_package", {})
    layers = [Layer(x["name"], x.get("packages", []), x.get("allow_deps", []), x.get("forbidden_deps", [])) for x in data.get("layers", [])]
    return Boundaries(layers, coupling.get("max_dependencies_per_module"), coupling.get("max_incoming_edges"), cross.get("allow", []), cross.get("deny", []))


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Resolved edges to nodes that are neither files nor symbols (known: node)."""
    return edges.filter("resolved").join(known.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select(F.lit("dangling_edge").alias("code"), "src", "dst")


def unresolved_imports(edges: DataFrame) -> DataFrame:
    """Imports of relative or absolute paths that found no file, assets apart."""
    extension = F.regexp_extract("dst", r"[^/.]\.([^./]+)$", 1)
    asset = (extension != "") & ~extension.isin(*EXTENSIONS)
    return edges.filter((F.col("kind") == "Import") & ~F.col("resolved") & F.col("dst").rlike(r"^[./]") & ~asset).select(F.lit("unresolved_import").alias("code"), "src", "dst")


def without_suppressed(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Findings whose ``code:src:dst`` is not in suppressed (key)."""
    key = F.concat_ws(":", "code", "src", "dst")
    return findings.withColumn("key", key).join(suppressed.select("key"), "key", "left_anti").drop("key")


def layer_of(package, layers: list[Layer]):
    """The first layer that has a pattern for the package."""
    out = F.lit(None).cast("string")
    for layer in reversed(layers):
        fits = F.lit(False)
        for pattern in layer.packages:
            fits = fits | glob_matches(package, pattern)
        out = F.when(fits, layer.name).otherwise(out)
    return out


def layer_findings(packages: DataFrame, policy: Boundaries) -> DataFrame:
    """Package edges (src, dst) that layers forbid or don't allow, and denied cross-package edges."""
    e = packages.filter("src <> dst").withColumns({"a": layer_of(F.col("src"), policy.layers), "b": layer_of(F.col("dst"), policy.layers)})
    forbidden = closed = F.lit(False)
    for layer in policy.layers:
        own = F.col("a") == layer.name
        if layer.forbid:
            forbidden = forbidden | own & F.col("b").isin(*layer.forbid)
        if layer.allow:
            closed = closed | own & (F.col("b") != layer.name) & ~F.col("b").isin(*layer.allow)
    any_of = lambda c, patterns: F.coalesce(F.greatest(*[glob_matches(F.col(c), p) for p in patterns], F.lit(False)), F.lit(False)) if patterns else F.lit(False)
    denied = any_of("dst", policy.deny) & ~any_of("src", policy.allow) & ~any_of("dst", policy.allow)
    codes = F.array_compact(F.array(F.when(F.coalesce(forbidden, F.lit(False)), "layer_bypass"), F.when(F.coalesce(closed, F.lit(False)), "layer_bypass"), F.when(denied, "cross_package_deny")))
    return e.select(F.explode(codes).alias("code"), "src", "dst")


def coupling_findings(packages: DataFrame, policy: Boundaries) -> DataFrame:
    """Packages with more dependencies or dependants than allowed (self-loops count): (code, package, direction, n)."""
    sides = []
    for column, direction, most in (("src", "dependencies", policy.most_dependencies), ("dst", "incoming", policy.most_incoming)):
        if most is not None:
            sides.append(packages.distinct().groupBy(F.col(column).alias("package")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit("coupling_ceiling").alias("code"), "package", F.lit(direction).alias("direction"), "n"))
    if not sides:
        return packages.limit(0).select(F.lit("").alias("code"), F.col("src").alias("package"), F.lit("").alias("direction"), F.lit(0).cast("long").alias("n"))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def report(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings in order, each with the total and the number of its code.

    Only the first ones are ordered; codes are few, so their counts are a small table."""
    codes = findings.groupBy("code").agg(F.count("*").alias("of_code"))
    total = codes.agg(F.coalesce(F.sum("of_code"), F.lit(0)).alias("total"))
    first = findings.orderBy(*FINDING).limit(limit).join(codes, "code").crossJoin(total)
    return first.select(*findings.columns, "total", "of_code", (F.col("total") > limit).alias("truncated"))


def ci_report(components: DataFrame, findings: DataFrame, orphans: DataFrame, threshold: int = 2, strict: bool = False) -> DataFrame:
    """One row: the largest cycle, counts, and whether the check passes (cycles below the threshold; with strict no findings)."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    row = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest_cycle"), F.count("*").alias("cycles"))
    out = row.crossJoin(findings.agg(F.count("*").alias("findings"))).crossJoin(orphans.agg(F.count("*").alias("orphans")))
    passed = (F.col("largest_cycle") < threshold) & ((F.col("findings") == 0) if strict else F.lit(True))
    return out.withColumn("passed", passed)

"""Column functions of the data model: paths, packages, symbol ids, tokens, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: names, orders and file lists that results depend on.
EDGE_KINDS = ["Import", "ReExport", "Calls", "Extends", "Implements", "Instantiates", "References", "TypeOf", "Decorates"]
DISPLAY_PRIORITY = {"Calls": 0, "Instantiates": 1, "Decorates": 2, "References": 3, "TypeOf": 4, "Extends": 5, "Implements": 5, "Import": 6, "ReExport": 7}
EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
NOISE_DIRS = ["node_modules", "dist", "build", "out", "coverage", ".git", ".next", ".nuxt", ".turbo", ".cache", "tmp", "temp", "vendor", "allure-reports", "allure-results", ".graphloom", "target", "__pycache__", ".venv", "venv"]
ENTRY_FILES = ["main.ts", "main.js", "main.mjs", "main.cjs", "index.ts", "index.js", "bootstrap.ts", "bootstrap.js", "server.ts", "server.js"]
KNOWN_SOURCES = ["vue", "svelte", "astro", "rs", "py", "go", "java", "kt", "rb", "php", "cs", "swift", "c", "cc", "cpp", "h", "hpp", "scala", "ex", "exs", "dart", "lua", "zig"]
TYPE_KINDS = ["interface_declaration", "type_alias_declaration"]
RISKS = ["high", "medium", "low"]

#: What separates the tokens of an identifier, and the edges between them; Java and ``regex`` read both alike.
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"
TOKEN_EDGE = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=[^0-9 ])|(?<=[^0-9 ])(?=[0-9])"

_MARKED = r"(^|/)(apps|libs|packages)/([^/]+)"


def file_of(node: Column) -> Column:
    """The path inside a symbol id, else the node itself."""
    return F.when(node.startswith("symbol://"), F.regexp_extract(node, r"^symbol://([^#]*)", 1)).otherwise(node)


def symbol_path(node: Column) -> Column:
    """The path inside a symbol id, else null."""
    return F.nullif(F.regexp_extract(node, r"^symbol://([^#]*)#", 1), F.lit(""))


def package_of(node: Column) -> Column:
    """The segment after the first apps, libs or packages that has one; else the first segment."""
    path = file_of(node)
    return F.coalesce(F.nullif(F.regexp_extract(path, _MARKED, 3), F.lit("")), F.split(path, "/")[0])


def listed_package_of(path: Column) -> Column:
    """As ``package_of``, but paths without a marker belong to ``workspace``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, _MARKED, 3), F.lit("")), F.lit("workspace"))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    return F.when(extension_of(path).isin("js", "jsx", "mjs", "cjs"), "javascript").otherwise("typescript")


def has_noise_dir(path: Column, more: list[str] | None = None) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in NOISE_DIRS + (more or [])]))


def directory_prefix(path: Column, depth: int = 3) -> Column:
    """The first depth directories; files at the root give ``(repo root)``."""
    parts = F.split(F.regexp_replace(path, r"^(\./)+", ""), "/")
    kept = F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))
    return F.when(F.size(parts) < 2, F.lit("(repo root)")).otherwise(F.array_join(kept, "/"))


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes; ``.``, ``..`` and empty segments resolved; relative to the root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def symbol_id(path: Column, kind: Column, qualified: Column, scope_start: Column | None = None, scope_end: Column | None = None) -> Column:
    space = F.when(kind.isin(*TYPE_KINDS), "type").otherwise("value")
    base = F.concat(F.lit("symbol://"), path, F.lit("#"), space, F.lit(":"), qualified)
    return base if scope_start is None else F.concat(base, F.coalesce(F.concat(F.lit("@scope:"), scope_start, F.lit(":"), scope_end), F.lit("")))


def display_priority(kind: Column) -> Column:
    out = F.lit(8)
    for name, rank in DISPLAY_PRIORITY.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def risk(depth: Column, in_degree: Column) -> Column:
    return F.when((depth <= 1) | (in_degree > 10), "high").when((depth <= 3) | (in_degree >= 2), "medium").otherwise("low")


def risk_score(depth: Column, in_degree: Column) -> Column:
    return (in_degree * 10 + F.when(depth <= 1, 50).when(depth <= 3, 20).otherwise(5)).cast("long")


def tokens_of(text: Column) -> Column:
    """Distinct lower-case parts of an identifier: split at non-alphanumerics, case changes, acronyms and digits."""
    parted = F.regexp_replace(F.regexp_replace(text, BETWEEN_TOKENS, " "), TOKEN_EDGE, " ")
    return F.array_distinct(F.filter(F.split(F.lower(parted), " +"), lambda x: x != ""))


def is_entry_point(name: Column, path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return base.isin(*ENTRY_FILES) | F.lower(name).isin("main", "bootstrap") | low.contains("/main.ts") | low.contains("/main.js")


def glob_matches(value: Column, pattern: str) -> Column:
    """``*`` stands for any run of characters; all else must be equal."""
    import re

    return value.rlike("^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$")


def unquoted(text: Column) -> Column:
    """A string literal without the quotes, single, double or back, that stand at both of its ends."""
    return F.regexp_replace(text, r"(?s)^(['\"`])(.*)\1$", "$2")


def shard_of(path: Column, shards: int) -> Column:
    """The shard that holds a path, the same on every machine."""
    return F.pmod(F.xxhash64(path), F.lit(shards)).cast("int")

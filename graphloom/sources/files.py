"""Source files as a table: scans, eligibility, ignore rules, coverage, size gate, excerpts; git history."""

from __future__ import annotations

import re
import subprocess

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EXTENSIONS, KNOWN_SOURCES, extension_of, has_noise_dir

MOST_BYTES = 1024 * 1024


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, bytes) of all files below root, in whatever store Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    return raw.select(F.regexp_replace("path", rf"^.*?{base}/", "").alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("bytes"))


def effective_extensions(extensions: list[str] | None = None) -> list[str]:
    """An explicit list in lower case without dots, at most 16 characters each and no separators of paths; else the defaults."""
    named = {e.strip().lower().lstrip(".") for e in extensions or []}
    return sorted(e for e in named if 0 < len(e) <= 16 and not set(e) & set("/\\")) or EXTENSIONS


def eligible(files: DataFrame, extensions: list[str] | None = None, noise: list[str] | None = None) -> DataFrame:
    """Files with a parsed extension outside noise folders."""
    return files.filter(extension_of(F.col("path")).isin(*effective_extensions(extensions)) & ~has_noise_dir(F.col("path"), noise))


def glob_to_regex(pattern: str) -> str:
    """A gitignore pattern (without its ``!`` and trailing slash) as a regular expression over relative paths."""
    anchored = "/" in pattern.strip("/") or pattern.startswith("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] in "*?":
            out, i = out + ("[^/]*" if body[i] == "*" else "[^/]"), i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inside = body[i + 1 : end]
            negative = inside[0] in "!^"
            inside = inside[negative:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&").replace("^", "\\^")
            out, i = out + ("(?!/)[^" if negative else "[") + inside + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + "\\" + body[i + 1], i + 2
        else:
            out, i = out + ("\\" if body[i] in ".^$+(){}|[]\\" else "") + body[i], i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "(?:/.*)?$"


def ignore_rules(folder: str, text: str) -> list[tuple[str, str]]:
    """The rules (folder, pattern) of an ignore file's text: no blank lines and comments; trailing blanks go unless escaped."""
    lines = [re.sub(r"(?<!\\)[ \t]+$", "", line) for line in text.splitlines()]
    return [(folder, line) for line in lines if line and not line.startswith("#")]


def ignored(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """files with ``ignored``: rules are (folder, pattern) in file order; the deepest folder's last match decides, and
    ``!`` takes a file back in. A pattern that ends with a slash is one of folders. Rules are configuration and become one
    expression."""
    decided = F.lit(None).cast("boolean")
    for folder, pattern in sorted(rules, key=lambda r: 0 if not r[0] else r[0].count("/") + 1):
        negative = pattern.startswith("!")
        body = pattern[negative:].removeprefix("\\") if pattern[negative:][:2] in ("\\!", "\\#") else pattern[negative:]
        prefix = f"{folder.rstrip('/')}/" if folder else ""
        below = F.col("path").startswith(prefix) if prefix else F.lit(True)
        rest = F.expr(f"substring(path, {len(prefix) + 1})")
        expression = glob_to_regex(body)
        match = rest.rlike(expression.removesuffix("(?:/.*)?$") + "/.*$" if body.endswith("/") else expression)
        decided = F.when(below & match, F.lit(not negative)).otherwise(decided)
    return files.withColumn("ignored", F.coalesce(decided, F.lit(False)))


#: Files whose rules hold for their folder and below.
IGNORE_FILES = [".gitignore", ".ignore"]


def workspace(spark: SparkSession, root: str, extensions: list[str] | None = None, noise: list[str] | None = None) -> DataFrame:
    """(path, content, bytes) of the files below root to be parsed: hidden ones too, by the ignore files there are.

    The paths come from a listing of the store, one task a folder of the first level; the driver gets the ignore files'
    rules, which are configuration."""
    listing = list_files(spark, root)
    kept = eligible(listing.filter(~F.col("path").rlike(r"(^|/)\.git/")), extensions, noise)
    found = listing.filter(F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES)).filter(~has_noise_dir(F.col("path"), noise))
    rules: list[tuple[str, str]] = []
    for r in read_files(spark, root, found).orderBy("path").collect():
        rules += ignore_rules(r["path"].rpartition("/")[0], r["content"] or "")
    return read_files(spark, root, ignored(kept, rules).filter("not ignored").drop("ignored"))


def _store(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files below root, hidden ones too, by the store's own listing."""
    store, path = _store(spark, root)
    base = store.makeQualified(path).toString().rstrip("/") + "/"
    rows, listing = [], store.listFiles(path, True)
    while listing.hasNext():
        status = listing.next()
        rows.append((status.getPath().toString().removeprefix(base), status.getLen()))
    return spark.createDataFrame(rows, "path string, bytes long")


def _read_one(spark: SparkSession, name: str) -> tuple[str | None, int | None]:
    """A file's text, of one up to MOST_BYTES, and its size; null what can't be read."""
    store, path = _store(spark, name)
    try:
        size = store.getFileStatus(path).getLen()
        if size > MOST_BYTES:
            return "", size
        stream = store.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace"), size
        finally:
            stream.close()
    except Py4JJavaError:
        return None, None


def read_files(spark: SparkSession, root: str, files: DataFrame, at_once: int = 10_000) -> DataFrame:
    """files (path) with content and bytes; content is null where a file can't be read, which is no error."""
    store, path = _store(spark, root)
    base = store.makeQualified(path).toString().rstrip("/")
    every = [r[0] for r in files.select("path").collect()]  # the listing came from the driver
    # Spark's readers pass over files whose own name starts with a dot or an underscore; few are sources or rules.
    hidden = [n for n in every if n.rpartition("/")[2][:1] in (".", "_")]
    names = sorted(set(every) - set(hidden))
    own = [(n, text, size) for n in hidden for text, size in [_read_one(spark, f"{base}/{n}")]]
    out = spark.createDataFrame(own, "path string, content string, bytes long")
    for a in range(0, len(names), at_once):
        raw = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load([f"{base}/{n}" for n in names[a : a + at_once]])
        own = raw.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("bytes"))
        out = out.unionByName(own)
    return files.select("path").join(out, "path", "left")


def coverage(files: DataFrame, budget: int | None = None) -> DataFrame:
    """Of the first budget files (None: all): per known but unparsed extension its files, and the parsed ones as ``(parsed)``."""
    ext = extension_of(F.col("path"))
    name = F.when(ext.isin(*EXTENSIONS), "(parsed)").when(ext.isin(*KNOWN_SOURCES), ext)
    walked = files if budget is None else files.orderBy("path").limit(budget)
    return walked.select(name.alias("extension")).filter("extension is not null").groupBy("extension").agg(F.count("*").alias("files"))


def size_gate(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files (path, content, bytes) with hash and diagnostic; too large ones keep a row, without hash."""
    big = F.col("bytes") > most
    return files.select("path", "bytes", F.when(big, "").otherwise(F.sha2("content", 256)).alias("hash"), F.when(big, "file_too_large").when(F.col("content").isNull(), "read_failed").alias("diagnostic"))


def scan_stats(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("diagnostic").isNotNull()).alias("with_diagnostics"))


def footprint(files: DataFrame, manifests: str = "%/manifest%") -> DataFrame:
    """One row: the bytes of all files of an index, and how many are manifests, by a pattern of their paths."""
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("path").like(manifests)).alias("manifests"))


def file_diagnostics(artifacts: DataFrame, limit: int = 20) -> DataFrame:
    return artifacts.filter("diagnostic is not null").orderBy("path").limit(limit).select("path", F.col("diagnostic").alias("code"))


def excerpt_bytes(files: DataFrame, start: Column, length: Column, most_bytes: int = 12_288, most_lines: int = 200) -> DataFrame:
    """``excerpt`` of spans in bytes; a character cut in two at an end goes."""
    part = F.substring(F.col("content").cast("binary"), start + 1, F.least(length, F.lit(most_bytes)).cast("int")).cast("string")
    whole = F.coalesce(F.try_validate_utf8(part), F.regexp_replace(F.make_valid_utf8(part), "^\ufffd+|\ufffd+$", ""))
    lines = F.split(whole, "\n")
    numbered = F.transform(F.slice(lines, 1, most_lines), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return files.select("path", F.array_join(numbered, "\n").alias("excerpt"), ((F.size(lines) > most_lines) | (length > most_bytes)).alias("truncated"))


def excerpt(files: DataFrame, start, length, most_chars: int = 12_288, most_lines: int = 200) -> DataFrame:
    """(path, excerpt, truncated): numbered lines of a span of each file."""
    part = F.substring(F.col("content"), start + 1, F.least(length, F.lit(most_chars)))
    lines = F.split(part, "\n")
    numbered = F.transform(F.slice(lines, 1, most_lines), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return files.select("path", F.array_join(numbered, "\n").alias("excerpt"), ((F.size(lines) > most_lines) | (length > most_chars)).alias("truncated"))


def hash_lookup(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest hash of each wanted path over (path, hash, seq, deleted); null for unknown or deleted ones."""
    last = versions.groupBy("path").agg(F.max_by(F.struct("hash", "deleted"), "seq").alias("v"))
    return wanted.join(last, "path", "left").select("path", F.when(~F.col("v.deleted"), F.col("v.hash")).alias("hash"))


def _git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout


def git_status(spark: SparkSession, root: str, untracked: bool = False) -> DataFrame:
    """(path) of changed files of a work tree on the driver's machine; tracked ones unless asked."""
    items = [x for x in _git(root, "status", "--porcelain", "-z", f"--untracked-files={'all' if untracked else 'no'}", "--no-renames").split("\0") if x]
    paths = sorted({x[3:] for x in items if x[:2] != "??" or untracked and not x.endswith((".map", ".d.ts"))})
    return spark.createDataFrame([(p,) for p in paths], "path string")


def git_diff(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    paths = [x for x in _git(root, "diff", "--name-only", "-z", "--diff-filter=ACMRTUXB", f"{base}...{head}").split("\0") if x]
    return spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")


def git_log(spark: SparkSession, root: str, commits: int = 5000) -> DataFrame:
    """(commit, file, recency), newest first with the highest recency."""
    rows, commit, n = [], None, 0
    for line in _git(root, "log", f"--max-count={commits}", "--name-only", "--format=%x00%H").split("\n"):
        if line.startswith("\0"):
            commit, n = line[1:], n + 1
        elif line:
            rows.append((commit, line, commits - n))
    return spark.createDataFrame(rows, "commit string, file string, recency long")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(path, entry): entry files that package.json texts (path, content) name in main, module, browser, types, typings, bin and,
    at any depth, exports."""
    fields = F.array(*[F.get_json_object("content", f"$.{k}") for k in ("main", "module", "browser", "types", "typings", "bin")])
    bins = F.map_values(F.from_json(F.get_json_object("content", "$.bin"), "map<string,string>"))
    exported = F.coalesce(F.regexp_extract_all(F.get_json_object("content", "$.exports"), F.lit(r'"?(\./[^"*]+)"?(?!"?\s*:)(?:[,}\]\s]|$)'), 1), F.array().cast("array<string>"))
    named = F.concat(exported, F.filter(fields, lambda x: x.isNotNull() & ~x.startswith("{")), F.coalesce(bins, F.array().cast("array<string>")))
    return manifests.select("path", F.explode(F.array_distinct(F.transform(named, lambda x: F.regexp_replace(x, r"^\./", "")))).alias("entry"))


def parse_jsonc(text: str):
    """JSON with comments and trailing commas."""
    import json

    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare, flags=re.S))


def load_tsconfig(spark: SparkSession, root: str, path: str = "tsconfig.json") -> tuple[list[tuple[str, str]], str | None, list[str]]:
    """Aliases (pattern, target), the base folder and problems of a project file below root, ``extends`` followed.

    A key of a file goes before the same key of the files it extends, of which later ones go before earlier ones. Targets
    and the base folder are relative to root. A circle, an absent or a broken file is a problem, not an error."""
    problems: list[str] = []

    def join(folder: str, target: str) -> str:
        parts: list[str] = []
        for part in [*folder.split("/"), *target.split("/")]:
            if part == "..":
                parts = parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        return "/".join(parts)

    def load(name: str, above: tuple[str, ...]) -> dict:
        if name in above:
            problems.append(f"circle: {name}")
            return {}
        rows = read_files(spark, root, spark.createDataFrame([(name,)], "path string")).collect() if _store(spark, f"{root}/{name}")[0].exists(_store(spark, f"{root}/{name}")[1]) else []
        if not rows or rows[0]["content"] is None:
            problems.append(f"absent: {name}")
            return {}
        try:
            data = parse_jsonc(rows[0]["content"])
        except ValueError:
            problems.append(f"broken: {name}")
            return {}
        folder, out = name.rpartition("/")[0], {}
        parents = data.get("extends") or []
        for parent in [parents] if isinstance(parents, str) else parents:
            file = join(folder, parent) if parent.startswith(".") else f"node_modules/{parent}"
            out |= load(file if file.endswith(".json") else f"{file}.json", (*above, name))
        options = data.get("compilerOptions") or {}
        if "baseUrl" in options:
            out["base"] = join(folder, options["baseUrl"])
        if "paths" in options:
            out["paths"], out["from"] = options["paths"], join(folder, options["baseUrl"]) if "baseUrl" in options else None
            out["folder"] = folder
        return out

    found = load(path, ())
    origin = found.get("from") if found.get("from") is not None else found.get("base", found.get("folder", ""))
    aliases = [(pattern, join(origin or "", target)) for pattern, targets in (found.get("paths") or {}).items() for target in targets[:1]]
    return aliases, found.get("base"), problems


#: Settings, their defaults and the environment variables that override a file's.
SETTINGS = {"extensions": EXTENSIONS, "noise": [], "most_bytes": MOST_BYTES, "commits": 5000}


def load_settings(text: str | None = None, environment: dict[str, str] | None = None, prefix: str = "GRAPHLOOM_") -> tuple[dict, list[str]]:
    """Settings and problems from defaults, a TOML text and environment variables, the later ones before the earlier ones.

    A value of a wrong kind is a problem and leaves the one before; lists come from the environment separated by commas."""
    import tomllib

    out, problems = dict(SETTINGS), []
    try:
        named = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError as error:
        named, problems = {}, [f"broken file: {error}"]
    for source, values in (("file", named), ("environment", {k[len(prefix) :].lower(): v for k, v in (environment or {}).items() if k.startswith(prefix)})):
        for key, value in values.items():
            if key not in SETTINGS:
                problems.append(f"{source}: unknown {key}")
                continue
            kind = type(SETTINGS[key])
            if source == "environment":
                value = [x.strip() for x in value.split(",") if x.strip()] if kind is list else int(value) if value.strip().isdigit() else value
            if isinstance(value, kind) and not isinstance(value, bool):
                out[key] = value
            else:
                problems.append(f"{source}: {key} must be a {kind.__name__}")
    out["extensions"] = effective_extensions(out["extensions"])
    return out, problems


def emit_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, sorted by all columns, so that equal tables give equal texts."""
    df.orderBy(*df.columns).write.mode("errorifexists").json(path)

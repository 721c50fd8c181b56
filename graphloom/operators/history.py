"""Commit history and file conventions: co-change, related tests, emitted siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which emitted extension hides behind which source extensions, and the patterns of test files.
SIBLING_EMIT = {"js": ["ts", "tsx", "mts", "cts"], "mjs": ["ts", "mts", "js"], "cjs": ["ts", "cts", "js"]}
TEST_PATTERNS = [".spec.ts", ".test.ts", ".spec.js", ".test.js"]


def cochanged(history: DataFrame, file, commits: int = 100, least: int = 2) -> DataFrame:
    """Files that changed with one file in its latest commits: (file, n), most often first.

    history: (commit, file, recency). Only the named file's commits join back, so hot files of others don't matter."""
    own = history.filter(F.col("file") == file).select("commit", "recency").distinct()
    latest = own.orderBy(F.col("recency").desc(), F.col("commit").desc()).limit(min(max(commits, 1), 5000)).select("commit")
    others = history.filter(F.col("file") != file).join(F.broadcast(latest), "commit", "left_semi")
    return others.groupBy("file").agg(F.count_distinct("commit").alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "file")


def related_tests(files: DataFrame) -> DataFrame:
    """(path, test): files that look like the tests of each file and exist.

    Beside it, in __tests__ beside it, or under test or tests in place of src."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    folder, base = F.regexp_replace("path", r"[^/]*$", ""), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^./]+$", "")
    options = []
    for pattern in TEST_PATTERNS:
        options += [F.concat(stem, F.lit(pattern)), F.concat(folder, F.lit("__tests__/"), base, F.lit(pattern))]
        options += [F.when(F.col("path").rlike("(^|/)src/"), F.concat(F.regexp_replace(stem, "^(.*?)(^|/)src/(.*)$", f"$1$2{d}/$3"), F.lit(pattern))) for d in ("test", "tests")]
    tries = files.select("path", F.explode(F.array_distinct(F.array_compact(F.array(*options)))).alias("test"))
    return tries.join(files.select(F.col("path").alias("test")).distinct(), "test", "left_semi").select("path", "test")


def without_sibling_emit(files: DataFrame) -> DataFrame:
    """files (path) without those emitted from a source file beside them (x.js beside x.ts)."""
    stem, ext = F.regexp_replace("path", r"\.[^./]+$", ""), F.regexp_extract("path", r"\.([^./]+)$", 1)
    emitted = F.lit(None).cast("array<string>")
    for target, sources in SIBLING_EMIT.items():
        emitted = F.when(ext == target, F.array(*map(F.lit, sources))).otherwise(emitted)
    tries = files.select("path", F.explode(emitted).alias("_e")).select("path", F.concat(stem, F.lit("."), F.col("_e")).alias("_source"))
    hidden = tries.join(files.select(F.col("path").alias("_source")), "_source", "left_semi").select("path").distinct()
    return files.join(hidden, "path", "left_anti")


"""Incremental maintenance: change detection, overlays, snapshot differences, generations and retention."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def detect_changes(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change): added, removed or modified rows between two versions."""
    j = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select(key, change.alias("change")).filter("change is not null")


def apply_overlay(base: DataFrame, upserts: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """base without the touched keys, plus upserts."""
    return base.join(touched.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(upserts.select(base.columns))


def compose_overlays(changes: DataFrame, key: str, order: str = "seq", tombstone: str = "deleted") -> DataFrame:
    """The latest version of each key over a chain of overlays; keys whose latest is a tombstone go."""
    rest = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")
    return last.filter(~F.col(tombstone)).drop(tombstone)


def replace_owned(edges: DataFrame, fresh: DataFrame, owners: DataFrame, owner: str = "owner") -> DataFrame:
    """Edges of the owners replaced by fresh ones."""
    return apply_overlay(edges, fresh, owners, owner)


def multiset_delta(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, delta) of rows whose number differs."""
    both = before.select(*columns, F.lit(-1).alias("_d")).unionAll(after.select(*columns, F.lit(1).alias("_d")))
    return both.groupBy(*columns).agg(F.sum("_d").alias("delta")).filter("delta <> 0")


def adjacency_refcounts(edges: DataFrame) -> DataFrame:
    """How many sites carry each (src, dst)."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("refs"))


def content_state(files: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """An order-independent digest of all (key, value): the exclusive or of 60-bit hashes of their length-prefixed text."""
    text = F.concat(F.length(key).cast("string"), F.lit(":"), F.col(key), F.col(value))
    return files.agg(F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).alias("state"), F.count("*").alias("files"))


def retained(generations: DataFrame, keep: int = 3) -> DataFrame:
    """(name, kept): the current generation first, then the newest, ties by name from the end."""
    order = Window.orderBy(F.col("current").desc(), F.col("modified").desc(), F.col("name").desc())
    return generations.select("name", (F.row_number().over(order) <= keep).alias("kept"))


def newest_to_merge(weights: list[int]) -> int:
    """How many of the newest overlays (weights oldest first) to merge into one: while the one before weighs no more than what
    is merged so far. Weights at least double from one to the next older, so a chain stays logarithmic. 0: nothing to do."""
    n, held = 1, weights[-1] if weights else 0
    while n < len(weights) and weights[-n - 1] <= held:
        held += weights[-n - 1]
        n += 1
    return n if n > 1 else 0


def compact_overlays(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """A chain of overlays (key, order, ...) with its newest ones merged by ``newest_to_merge``: of each key in them the latest
    version, tombstones too, as they still hide older ones. The merged overlay takes the highest number.

    The driver gets a count per overlay; a chain has few."""
    sizes = [(r[0], r[1]) for r in changes.groupBy(order).count().orderBy(order).collect()]
    n = newest_to_merge([c for _, c in sizes])
    if not n:
        return changes
    first, last = sizes[-n][0], sizes[-1][0]
    rest = [c for c in changes.columns if c not in (key, order)]
    newest = changes.filter(F.col(order) >= first).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    merged = newest.select(key, F.lit(last).cast(changes.schema[order].dataType).alias(order), "_v.*").select(changes.columns)
    return changes.filter(F.col(order) < first).unionByName(merged)


def amplified(physical: int, live: int, ratio: float = 4.0) -> bool:
    """Whether a table's files hold so much more than its live rows that it should be rewritten."""
    return physical > 0 and physical >= ratio * max(live, 1)


def digest(df: DataFrame) -> DataFrame:
    """(rows, state): the number of rows and an order-independent digest of all columns."""
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(c) for c in sorted(df.columns)])), 256)
    halves = [F.bit_xor(F.conv(F.substring(row, at, 15), 16, 10).cast("long")) for at in (1, 17, 33, 49)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws(":", *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]).alias("state"))


class Generations:
    """Immutable snapshots of tables in folders, and pointers to them.

    A snapshot is written under a name of its own; then a pointer with the next number is renamed into place, whole or not
    at all. The highest pointer names the current snapshot, so a reader always finds one, and a crash loses none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def publish(self, name: str, tables: dict[str, DataFrame]) -> None:
        sums = []
        for table, df in tables.items():
            df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/{name}/{table}")
            sums.append((table, *digest(self.read(table, name)).first()))
        self.spark.createDataFrame(sums, "table string, rows long, state string").coalesce(1).write.parquet(f"{self.root}/{name}/_sums")
        pointers = self._pointers()
        number = pointers[-1] + 1 if pointers else 1
        temporary = f"_next-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.text(f"{self.root}/{temporary}")
        # A rename onto a folder that is there fails or nests, so a pointer that another writer took is tried again.
        while self.fs.exists(self._path(f"_current-{number:012}")) or not self.fs.rename(self._path(temporary), self._path(f"_current-{number:012}")):
            number += 1
        for old in pointers[:-1]:
            self.fs.delete(self._path(f"_current-{old:012}"), True)

    def _pointers(self) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(""))]
        return sorted(int(x[9:]) for x in names if x.startswith("_current-"))

    def current(self) -> str | None:
        pointers = self._pointers()
        return self.spark.read.text(f"{self.root}/_current-{pointers[-1]:012}").first()[0] if pointers else None

    def read(self, table: str, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name or self.current()}/{table}")

    def validate(self, name: str | None = None) -> list[str]:
        """The tables of a snapshot that are gone, unreadable, or not what was published."""
        name, bad = name or self.current(), []
        for table, rows, state in self.spark.read.parquet(f"{self.root}/{name}/_sums").collect():  # a row per table
            try:
                if tuple(digest(self.read(table, name)).first()) != (rows, state):
                    bad.append(table)
            except (AnalysisException, Py4JJavaError, PySparkException):
                bad.append(table)
        return sorted(bad)

    def names(self) -> list[str]:
        return sorted(x for f in self.fs.listStatus(self._path("")) if not (x := f.getPath().getName()).startswith("_"))

    def collect_garbage(self, keep: int = 3) -> list[str]:
        """Delete all but the current and the newest generations; the deleted names."""
        rows = [(n, self.fs.getFileStatus(self._path(n)).getModificationTime(), n == self.current()) for n in self.names()]
        if not rows:
            return []
        plan = retained(self.spark.createDataFrame(rows, "name string, modified long, current boolean"), keep)
        gone = [r[0] for r in plan.filter("not kept").collect()]  # a name per snapshot
        for name in gone:
            self.fs.delete(self._path(name), True)
        return gone


class SyncQueue:
    """Requests to sync paths, as files in a shared folder: any process may put one in, one leader takes them out.

    A ticket is written under a name of its own and renamed, so it is whole. At most ``most`` wait; beyond them a request
    becomes one for everything. A ticket that can't be read is set aside as ``.invalid``."""

    def __init__(self, spark: SparkSession, root: str, most: int = 1000):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.root))

    def _names(self, suffix: str) -> list[str]:
        return sorted(x for f in self.fs.listStatus(self.path(self.root)) if (x := f.getPath().getName()).endswith(suffix))

    def _write(self, name: str, text: str) -> None:
        temporary = self.path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(temporary, self.path(f"{self.root}/{name}"))

    def enqueue(self, paths: list[str] | None) -> str:
        """Ask for a sync of paths, or of everything (None); the ticket's name."""
        waiting = self._names(".ticket")
        number = int(waiting[-1].split("-")[0]) + 1 if waiting else 0
        asked = None if paths is None or len(waiting) >= self.most else sorted(set(paths))
        name = f"{number:012}-{uuid.uuid4().hex}.ticket"
        self._write(name, json.dumps({"paths": asked}))
        return name

    def drain(self) -> tuple[list[str], bool]:
        """The paths that all tickets ask for, and whether one asks for everything; the tickets go."""
        paths: set[str] = set()
        whole = False
        for name in self._names(".ticket"):
            at = self.path(f"{self.root}/{name}")
            stream = self.fs.open(at)
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            stream.close()
            try:
                asked = json.loads(text)["paths"]
                if asked is not None and not (isinstance(asked, list) and all(isinstance(p, str) for p in asked)):
                    raise ValueError(name)
            except (ValueError, KeyError, TypeError):
                self.fs.rename(at, self.path(f"{self.root}/{name}.invalid"))
                continue
            whole |= asked is None
            paths |= set(asked or [])
            self.fs.delete(at, False)
        return sorted(paths), whole

    def clean(self) -> int:
        """Delete what is set aside or half written; their number."""
        gone = [*self._names(".invalid"), *self._names(".tmp")]
        for name in gone:
            self.fs.delete(self.path(f"{self.root}/{name}"), False)
        return len(gone)

    def lead(self) -> bool:
        """Become the one that drains; False while another is. ``resign`` ends it."""
        try:
            self.fs.create(self.path(f"{self.root}/leader.lock"), False).close()
        except Py4JJavaError:
            return False
        return True

    def resign(self) -> None:
        self.fs.delete(self.path(f"{self.root}/leader.lock"), False)

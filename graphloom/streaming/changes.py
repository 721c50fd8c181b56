"""Change events to batches: filter, debounce by session windows, and a streaming query that syncs each batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import extension_of, has_noise_dir
from ..sources.files import effective_extensions

READ_KINDS = ["access", "open", "close_read", "read"]


#: Files that aren't parsed but change how others are resolved or scanned.
METADATA_FILES = ["package.json", "tsconfig.json", "jsconfig.json", ".gitignore", ".ignore"]


def relevant(events: DataFrame) -> DataFrame:
    """Events (workspace, ts, kind, path) that may change the index: reads go, pathless ``other`` events stay."""
    return events.filter(~F.col("kind").isin(*READ_KINDS) & (F.col("path").isNotNull() | (F.col("kind") == "other")))


def indexable(events: DataFrame, extensions: list[str] | None = None, noise: list[str] | None = None) -> DataFrame:
    """Relevant events whose path a full scan would take, or that is a file of metadata; pathless ones stay."""
    name = F.element_at(F.split("path", "/"), -1)
    taken = extension_of(F.col("path")).isin(*effective_extensions(extensions)) | name.isin(*METADATA_FILES)
    return relevant(events).filter(F.col("path").isNull() | taken & ~has_noise_dir(F.col("path"), noise))


class Fresh:
    """A value that is worked out anew only when it is older than some seconds."""

    def __init__(self, make: Callable, seconds: float = 0.05):
        self.make, self.seconds, self.at, self.value = make, seconds, -float("inf"), None

    def get(self):
        if time.monotonic() - self.at > self.seconds:
            self.value, self.at = self.make(), time.monotonic()
        return self.value


def batches(events: DataFrame, gap: str, most_paths: int | None = None, watermark: str | None = None, most_span: str | None = None) -> DataFrame:
    """One row per workspace and batch: a burst of events with no pause of ``gap``; distinct paths, or a reconcile request.

    Works on tables and, with a watermark, on streams. A burst with an ``other`` event asks for a reconcile and names no
    paths. With most_span a burst is cut into spans of that length from the epoch on; with most_paths its distinct paths
    are dealt over as many rows (``part``) as hold at most so many each, by hash."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    keys = ["workspace", F.session_window("ts", gap).alias("w")]
    if most_span:
        events = events.withColumn("_span", F.window("ts", most_span)["start"])
        keys.append(F.col("_span"))
    paths = F.array_sort(F.collect_set("path"))
    grouped = events.groupBy(*keys).agg(F.count("*").alias("events"), paths.alias("_p"), F.max((F.col("kind") == "other").cast("int")).alias("_other"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    reconcile = F.col("_other") == 1
    whole = grouped.select("workspace", "first", "last", "events", reconcile.alias("reconcile"), F.when(reconcile, F.array().cast("array<string>")).otherwise(F.col("_p")).alias("paths"))
    if most_paths is None:
        return whole
    starts = F.when(F.size("paths") > 0, F.sequence(F.lit(0), F.size("paths") - 1, F.lit(most_paths))).otherwise(F.array(F.lit(0)))
    return whole.withColumn("_at", F.explode(starts)).withColumn("part", (F.col("_at") / most_paths).cast("int")).withColumn("paths", F.slice("paths", F.col("_at") + 1, F.lit(most_paths))).drop("_at")


def cut_batches(rows: Iterator[tuple[float, str]], gap: float, most_seconds: float, most_paths: int) -> Iterator[set[str]]:
    """The same with both caps, over (time, path) in order: a batch ends after a pause, a time or a number of paths."""
    held: set[str] = set()
    start = last = 0.0
    for at, path in rows:
        if held and (at - last >= gap or at - start >= most_seconds or len(held) >= most_paths):
            yield held
            held = set()
        if not held:
            start = at
        held.add(path)
        last = at
    if held:
        yield held


def watch(stream: DataFrame, sync: Callable, reconcile: Callable[[], None], gap: str, checkpoint: str, watermark: str = "0 seconds", once: bool = False, as_table: bool = False):
    """Start a query that calls sync(paths) or reconcile() for the finished batches of each trigger.

    paths is a sorted list, or with as_table a table (path), which stays distributed however many there are."""

    def apply(frame: DataFrame, _: int) -> None:
        asked = frame.agg(F.max("reconcile"), F.sum(F.size("paths"))).first()
        if asked[0]:
            reconcile()
        elif asked[1]:
            paths = frame.select(F.explode("paths").alias("path")).distinct()
            sync(paths if as_table else sorted(r[0] for r in paths.collect()))

    writer = batches(relevant(stream), gap, watermark=watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()

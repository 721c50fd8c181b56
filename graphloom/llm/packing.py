"""Best-fit packing by bin completion over the histogram of piece lengths.

Documents become token ids plus an end id; only longer ones than a sequence are cut. Packing needs lengths alone, and
there are at most 4096 of them, so the driver solves it on the histogram (a proven bound): best-fit decreasing gives
the incumbent, and where that misses the lower bound, bin completion branches on the undominated fillings around the
largest remaining piece, each used as often as the counts allow, and prunes by the waste that a better packing may
have. The answer is a list of patterns (lengths and how many bins use them). Pieces are then numbered within their
length, in parallel, and look up their place in the patterns.

Null text: empty, one end id. Null id: kept as null. Repeated rows: packed each. Ties: pieces of one length are alike
and take their places in the order of tasks. A very long text: cut into as many pieces as it needs. Empty table: empty
result. Extra columns: not read. A text with the string of a special token: the ids that the library gives it. The search stops after ``most_nodes`` nodes (fillings used or found dominated); the incumbent is
then the answer.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, slices, small_batches, stored
from .tokens import Encoder

CAPACITY = 4096
END_ID = 1
MOST_NODES = 20_000
#: How often the rest is packed by best fit for a new incumbent.
LOOK = 25
#: The end of the fillings of a node.
END = object()

#: Lengths of a bin, descending, and the number of bins filled so.
Pattern = tuple[tuple[int, ...], int]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins. For each k, pieces over capacity - k stand alone, those over
    half a bin apart from each other, and what pieces of at least k don't find room beside them needs more bins."""
    count = np.zeros(capacity + 2, np.int64)
    for n, c in hist.items():
        count[n] = c
    size = count * np.arange(capacity + 2)
    counts, sizes = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1  # the first length over half a bin
    alone = counts[capacity + 1] - counts[capacity - k + 1]
    apart = counts[np.maximum(capacity - k + 1, half)] - counts[half]
    room = apart * capacity - (sizes[np.maximum(capacity - k + 1, half)] - sizes[half])
    small = sizes[half] - sizes[k]
    return int((alone + apart + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; bins filled alike are handled together."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([pattern, count])

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, capacity - each * length, left // each)
                if left % each:
                    put((length,) * (left % each), capacity - left % each * length, 1)
                break
            room = rooms[at]
            pattern, count = bins[room][-1]
            used = min(count, left)
            if used == count:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                bins[room][-1][1] -= used
            put((*pattern, length), room - length, used)
            left -= used
    out: Counter = Counter()
    for groups in bins.values():
        for pattern, count in groups:
            out[pattern] += count
    return sorted(out.items(), reverse=True)


class Sums:
    """For ascending lengths and counts, bit sets of the sums that the lengths up to each reach. A later histogram only has
    those worked out anew that lie above the first changed one, and none above the first that reach every sum."""

    def __init__(self, capacity: int):
        self.full = (1 << capacity + 1) - 1
        self.capacity = capacity
        self.known: list[tuple[int, int]] = []
        self.reach: list[int] = []

    def of(self, items: list[tuple[int, int]]) -> list[int]:
        """reach[i]: the sums of the first i + 1 of items; the list ends with the first that has every sum."""
        same = 0
        while same < len(self.reach) and same < len(items) and self._as_good(self.known[same], items[same]):
            same += 1
        reach = self.reach[:same]
        bits = reach[-1] if reach else 1
        for n, c in items[same:]:
            if bits == self.full:
                break
            # Steps of doubled numbers of pieces: 1, 2, 4 and the rest.
            left, step = min(c, self.capacity // n), 1
            while left:
                now = min(step, left)
                bits |= bits << now * n & self.full
                left, step = left - now, step * 2
            reach.append(bits)
        self.known, self.reach = items[: len(reach)], reach
        return reach

    def _as_good(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        most = self.capacity // x[0]
        return x[0] == y[0] and min(x[1], most) == min(y[1], most)


class Pieces:
    """The pieces that may still go into a bin: lengths up to ``room`` in ascending order, their counts and the sums that the
    first ones reach. One such table serves all nodes of a search, as it is loaded anew for a node that is gone back to;
    so what a node keeps doesn't grow with the number of lengths."""

    def __init__(self, capacity: int):
        self.sums = Sums(capacity)

    def load(self, hist: dict[int, int], room: int) -> Pieces:
        self.room = room
        self.counts = hist
        self.items = sorted((n, c) for n, c in hist.items() if n <= room)
        self.lengths = [n for n, _ in self.items]
        self.reach = self.sums.of(self.items)
        self.held = sum(1 << n for n in self.lengths)
        return self

    def fillings(self, least: int) -> Iterator[tuple[int, ...] | None]:
        """As ``fillings``; at each step the table must hold what it held at the first."""
        for total in range(self.room, max(0, least) - 1, -1):
            if self._reaches(len(self.items) - 1, total):
                for chosen in self._extend(len(self.items) - 1, total, ()):
                    yield None if self._dominated(chosen, self.room - total) else tuple(n for n, k in chosen for _ in range(k))

    def _reaches(self, i: int, total: int) -> bool:
        """Whether the first i + 1 lengths have a set with this sum."""
        return total == 0 or i >= 0 and bool(self.reach[min(i, len(self.reach) - 1)] >> total & 1)

    def _extend(self, top: int, total: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[int, int], ...]]:
        """Sets with exactly this sum of lengths up to place top, after chosen."""
        if not total:
            yield chosen
            return
        for i in range(min(top, bisect.bisect_right(self.lengths, total) - 1), -1, -1):
            if not self._reaches(i, total):
                return
            n, c = self.items[i]
            for k in range(min(c, total // n), 0, -1):
                if self._reaches(i - 1, total - k * n):
                    yield from self._extend(i - 1, total - k * n, (*chosen, (n, k)))

    def _dominated(self, chosen: tuple[tuple[int, int], ...], gap: int) -> bool:
        """Whether an unused piece fits too, or could stand in for one or two chosen ones and fill the bin more (or as
        much, as one in place of two)."""
        unused = self.held
        for n, k in chosen:
            if k == self.counts[n]:
                unused &= ~(1 << n)
        span = (1 << gap) - 1  # sums more by 1 to gap
        if unused >> 1 & span or any(unused >> n + 1 & span for n, _ in chosen):
            return True
        for i, (n, k) in enumerate(chosen):
            if k > 1 and unused >> 2 * n & (span << 1 | 1) or any(unused >> n + m & (span << 1 | 1) for m, _ in chosen[i + 1 :]):
                return True
        return False


def fillings(hist: dict[int, int], room: int, least: int) -> Iterator[tuple[int, ...] | None]:
    """Sets of pieces with a sum from least to room that no other one dominates, the fullest first, then large pieces
    first. Only pieces that lead to a sum are tried. None stands for a dominated set that was passed over."""
    return Pieces(room).load(hist, room).fillings(least)


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY, most_nodes: int = MOST_NODES) -> list[Pattern]:
    """Patterns that hold every piece, in as few bins as the search finds."""
    hist = {n: c for n, c in hist.items() if c}
    if not hist:
        return []
    if min(hist) < 1 or max(hist) > capacity:
        raise ValueError("lengths must lie from 1 to the capacity")
    best = best_fit(hist, capacity)
    bins = sum(c for _, c in best)
    bound = lower_bound(hist, capacity)
    total = sum(n * c for n, c in hist.items())
    pieces, nodes = Pieces(capacity), 0
    # The branch searched: bins and waste so far, and what is still to try there. A stack, as it may be deep; the pieces
    # left are those of its last node, and are put back with its pattern when that is given up.
    stack: list[tuple[int, int, Iterator[tuple[int, ...] | None]]] = []
    done: list[Pattern] = []
    left = dict(hist)
    loaded = 0  # the depth of the node whose pieces the table holds

    def enter(used: int, waste: int) -> None:
        """Take the best-fit packing of the rest if it is better; else branch on the fillings around the largest piece."""
        nonlocal best, bins
        if nodes % LOOK == 0 or len(left) < 2 * LOOK:
            rest = best_fit(left, capacity) if left else []
            if used + (found := sum(c for _, c in rest)) < bins:
                best, bins = [*done, *rest], used + found
        spare = (bins - 1) * capacity - total - waste
        choices: Iterator[tuple[int, ...] | None] = iter(())
        if left and spare >= 0:
            choices = pieces.fillings(capacity - max(left) - spare)
        stack.append((used, waste, choices))

    enter(0, 0)
    while stack and bins > bound and nodes < most_nodes:
        used, waste, choices = stack[-1]
        largest = max(left, default=0)
        if loaded != len(stack):
            others = {n: c - (n == largest) for n, c in left.items() if c > (n == largest)}
            pieces.load(others, capacity - largest)
            loaded = len(stack)
        filling = next(choices, END)
        if filling is None:
            nodes += 1
            continue
        spare = (bins - 1) * capacity - total - waste
        # The fillings come fullest first, so that none after one with too much waste is better.
        if filling is END or capacity - largest - sum(filling) > spare:
            stack.pop()
            if stack:
                pattern, times = done.pop()
                for n in pattern:
                    left[n] = left.get(n, 0) + times
            continue
        nodes += 1
        pattern = (largest, *filling)
        gap = capacity - sum(pattern)
        need = Counter(pattern)
        times = min(left[n] // k for n, k in need.items())
        if gap:
            times = min(times, spare // gap)
        done.append((pattern, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        loaded = 0
        enter(used + times, waste + gap * times)
    return best


class Places:
    """For the r-th piece of a length, its bin and the place in it."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, count in patterns:
            at = 0
            for length, uses in sorted(Counter(pattern).items(), reverse=True):
                slots.setdefault(length, []).append((first, uses, at))
                slots[length][-1] += (uses * count,)
                at += length * uses
            first += count
        self.bins = first
        self.tables = {n: (np.concatenate([[0], np.cumsum([r[3] for r in rows])]), np.array([r[:3] for r in rows], np.int64)) for n, rows in slots.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, rows = self.tables[length]
        k = np.searchsorted(ends, ranks, side="right") - 1
        first, uses, at = rows[k].T
        local = ranks - ends[k]
        return first + local // uses, at + local % uses * length


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = Encoder(path), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        for part in slices(batches, "text"):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(["" if t is None else t for t in part.column("text").to_pylist()]), strict=True):
                ids = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    x = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(x), zlib.crc32(x), task, seen[len(x)]))
                    seen[len(x)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task; stored, so that ranks stay."""
    small_batches(docs.sparkSession)
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_cut(tokenizer_path, end_id, capacity)), _PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_nodes: int = MOST_NODES) -> DataFrame:
    """pieces (from ``pieces_of``) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("length", "_task").count(), "piece-counts")
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(Places(pack_histogram(hist, capacity, most_nodes), capacity))
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            bins, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts):
                bins[own], offsets[own] = table.find(int(lengths[own[0]]), ranks[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # The counts grow with the number of tasks, so they are never broadcast.
    ranked = pieces.join(before.hint("merge"), ["length", "_task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))

"""What the operators share: the shared folder, row batches and byte-level hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Arrow hands to Python at once; texts are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000
M64 = (1 << 64) - 1
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single
    machine, and an error on a cluster, whose executors don't see each other's disks."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def sheltered(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """df's columns under names that clash with none of the operators', and those columns under their names again."""
    return [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(df.columns)], [F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def unstore(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small (only lowers the session's setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


_held: dict[str, object] = {}


def held(name: str, make):
    """What ``make`` returns, made once in a worker and held while its tasks are ``lean`` ones that keep the name."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def forget(keeps: str) -> None:
    """Drop what the worker holds unless it is this."""
    if keeps not in _held:
        _held.clear()


def lean(function, keeps: str = ""):
    """function over batches, after which the worker gives freed memory back (it stays alive for later tasks). What tasks of
    other operators have left in the worker goes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from function(batches)
        trim()

    return run


def lean_group(function):
    """As ``lean``, for a function of one group's table."""

    def run(table):
        forget("")
        out = function(table)
        trim()
        return out

    return run


def trim() -> None:
    import ctypes
    import gc

    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's bytes stay near most_bytes; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null as empty) and the n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = seeds(256, 7)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if size > 1 << 22:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the weighted codes of data[i:j], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run without ASCII white space, within one row), and the first word of each row."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside[1:], False) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of data[s:e] for ordered, disjoint spans, in bounded memory."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    part = starts // step
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low = starts[a]
        prefix = prefix_hash(data[low : ends[b - 1]])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (prefix[e] - prefix[s]) * powers(int(e[-1]) + 1)[1][s]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words of each row (fewer words: one run of them all) and the row's first shingle."""
    n_words = np.diff(firsts)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(ends[-1]) - ends[row] + firsts[row]
    factors = seeds(width, 11) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        if len(words) and len(at):
            there = at + j < firsts[row + 1]
            out += np.where(there, words[np.minimum(at + j, len(words) - 1)] * factors[j], np.uint64(j + 1))
    return mix(out), ends


#: Most parts that ``row_order`` makes; the driver holds one splitter for each.
MOST_PARTS = 16_384


def row_order(df: DataFrame, id_column: str, per_part: int) -> DataFrame:
    """df with ``_part``: consecutive ranges of id_column, ascending (null in the first), of about per_part rows.

    The driver receives only the splitters, at most MOST_PARTS."""
    parts = min(MOST_PARTS, max(1, -(-df.count() // per_part)))
    cuts = df.select(id_column).dropna().stat.approxQuantile(id_column, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return df.withColumn("_part", part_of(F.col(id_column), sorted({int(x) for x in cuts})))


def part_of(column, cuts: list[int]):
    """The number of cuts that are at most the value (0 for null), found in two levels."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda values: f"array({','.join(f'{v}L' for v in values)})" if values else "array(0L)"
    groups = [cuts[i + 1 : i + step] for i in range(0, len(cuts), step)]
    top = F.size(F.filter(F.expr(longs(cuts[::step])), lambda x: x <= column))
    inner = [[*g, *[(1 << 63) - 1] * (step - 1 - len(g))] for g in groups]
    below = F.expr(f"array(array(0L),{','.join(longs(g) for g in inner)})")
    within = F.when(top == 0, 0).otherwise((top - 1) * step + 1 + F.size(F.filter(F.get(below, top), lambda x: x <= column)) - F.lit(int(step == 1)))
    return F.coalesce(F.when(column.isNotNull(), within), F.lit(0)).cast("int")


#: Bits of a filter over rows: fixed, whatever the number of rows.
FILTER_BITS = 1 << 24


def key_hash(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1


def row_filter(rows: DataFrame, h: Column) -> DataFrame:
    """A filter of FILTER_BITS bits over the rows' hashes, as a table of at most FILTER_BITS / 32768 bitmaps."""
    at = rows.select(h.alias("h"))
    return at.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))


def marked(df: DataFrame, h: Column, filter_: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether the filter has the row's hash."""
    joined = df.withColumn("_h", h).withColumn("_b", F.bitmap_bucket_number("_h")).join(F.broadcast(filter_), F.col("_b") == F.col("_bucket"), "left")
    place = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(bitmap_bit_position(_h) % 8 as int)) & 1")
    return joined.withColumn("_byte", byte).withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_h", "_b", "_bucket", "_bits", "_byte")

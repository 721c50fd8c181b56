"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to whole numbers. Rows are dealt into blocks; a block keeps, for each attribute, one bitmap of
rows per bit of its offset value (value minus the block's least). The score of a query is a sum of query component
times attribute. It is built as slices too: for each bit of the components' absolute values the slices of the
attributes that have it (complemented for negative components) are added with carry-save adders on bitmaps, from the
top bit downward with doubling. Then the top rows are found from the most significant slice downward: rows with the
bit set go above the others as long as they don't exceed k; the rest narrow the boundary. Rows that stay tied at
the boundary are resolved exactly by their ids. A last merge takes the best k of all blocks.

All scores are exact whole numbers, however wide the components: vectors with a component of 2**24 or more after
scaling are dealt into blocks of their own, whose slices are as many as they need. A score beyond a long is returned as
the nearest long; ranks go by the exact number.

Null vectors and vectors with a null or non-finite component take no part, and neither do null ids. Vectors of
different lengths, the empty one too, are compared as if padded with zeros. Repeated rows are separate candidates; a
query leaves out its own row only. Ties go to the smaller id; rows that share id and score are in no fixed order, which
no column shows. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored

SCALE = 64
TOP = 20
QUERY_STEP = 20
BLOCK_ROWS = 16_384
#: As many queries as make copies of row blocks and copies of query blocks cost about the same, within a task's memory.
BLOCK_QUERIES = 4096
#: From here on a component is wide.
WIDE = 1 << 24
LONGEST = (1 << 63) - 1


class BitSlices:
    """Slices of a block of whole-number vectors: slices[d] is a (bits, bytes) array of row bitmaps."""

    def __init__(self, values: np.ndarray):
        self.n, dims = values.shape
        self.words = -(-self.n // 64)
        self.least = values.min(axis=0) if self.n else np.zeros(dims, np.int64)
        offset = values - self.least
        self.top = offset.max(axis=0) if self.n else np.zeros(dims, np.int64)
        self.slices = []
        for d in range(dims):
            bits = int(self.top[d]).bit_length()
            rows = np.zeros((bits, self.words * 64), np.uint8)
            for b in range(bits):
                rows[b, : self.n] = offset[:, d] >> b & 1
            self.slices.append(np.packbits(rows, axis=1, bitorder="little").view("<u8") if bits else np.zeros((0, self.words), "<u8"))
        self.all_rows = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view("<u8")

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score (least significant first) and the number to add to it.

        q * x = q * least + |q| * y where y = x - least, or its complement within its bits for q < 0."""
        constant, columns = 0, {}
        for d in np.flatnonzero(query).tolist():
            q, own = int(query[d]), self.slices[d]
            constant += q * int(self.least[d])
            if q < 0:
                constant += q * ((1 << len(own)) - 1)
                own = ~own
            a = abs(q)
            for j in range(a.bit_length()):
                if a >> j & 1:
                    for b, bitmap in enumerate(own):
                        columns.setdefault(b + j, []).append(bitmap)
        out, place = [], 0
        while columns:
            stack = columns.pop(place, [])
            carry = columns.setdefault(place + 1, [])
            while len(stack) > 2:  # three of one weight become a sum and a carry, all triples at once
                k = len(stack) // 3
                a, b, c = (np.stack(stack[i * k : (i + 1) * k]) for i in range(3))
                half = a ^ b
                carry.extend((a & b) | (half & c))
                stack = [*(half ^ c), *stack[3 * k :]]
            if len(stack) == 2:
                carry.append(stack[0] & stack[1])
                stack = [stack[0] ^ stack[1]]
            out.append(stack[0] if stack else np.zeros(self.words, "<u8"))
            if not carry:
                del columns[place + 1]
            place += 1
        return out, constant

    def top_rows(self, slices: list[np.ndarray], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers that surely are among the k highest, and those tied at the boundary."""
        above, tied = np.zeros(self.words, "<u8"), self.all_rows.copy()
        if without >= 0:
            tied[without // 64] &= ~np.uint64(1 << (without % 64))
        n_above = 0
        for bitmap in reversed(slices):
            high = tied & bitmap
            n = n_above + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                above |= high
                n_above = n
                tied = tied & ~bitmap
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        return rows(above), rows(tied)


def search_block(index: BitSlices, ids: np.ndarray, query: np.ndarray, k: int, own_row: int = -1) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of the block, ties to smaller ids."""
    slices, constant = index.score(query)
    above, tied = index.top_rows(slices, k, own_row)
    tied = tied[np.argsort(ids[tied], kind="stable")][: max(0, k - len(above))]
    rows = np.concatenate([above, tied])
    wide = len(slices) > 61 or abs(constant) >> 61
    scores = np.full(len(rows), constant, object if wide else np.int64)
    for place, bitmap in enumerate(slices):
        scores += (bitmap[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(scores.dtype) << place
    return list(zip(scores.tolist(), ids[rows].tolist(), strict=True))


_BLOCK = "_b long, ids binary, uids binary, dims int, kind string, values binary"


def to_whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: as int64 where that holds every value, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 1 << 53:
        return scaled.astype(np.int64)
    flat = [int(s) if math.isfinite(s) else math.floor(Fraction(v) * scale) for s, v in zip(scaled.reshape(-1).tolist(), x.reshape(-1).tolist(), strict=True)]
    return np.array(flat, object).reshape(x.shape)


def _pack(scale: int):
    def run(table: pa.Table) -> pa.Table:
        column = table.column("v").combine_chunks()
        sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
        dims = int(sizes.max())
        x = np.zeros((len(sizes), dims))
        x[np.arange(dims)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        values = to_whole(x, scale)
        kind = "json" if values.dtype == object else "<i4" if not values.size or np.abs(values).max() < 1 << 31 else "<i8"
        data = json.dumps(values.tolist()).encode() if kind == "json" else values.astype(kind).tobytes()
        row = [table.column("_b")[0].as_py(), table.column("vec_id").to_numpy().astype("<i8").tobytes(), table.column("uid").to_numpy().astype("<i8").tobytes(), dims, kind, data]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _values(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, uids and whole-number vectors of a block."""
    ids, uids = (np.frombuffer(block[c], "<i8") for c in ("ids", "uids"))
    if block["kind"] == "json":
        return ids, uids, np.array(json.loads(block["values"]), object).reshape(len(ids), block["dims"])
    return ids, uids, np.frombuffer(block["values"], block["kind"]).astype(np.int64).reshape(len(ids), block["dims"])


def order_key(score: int) -> bytes | None:
    """For scores at or beyond a long's ends, bytes that sort as the scores do; null for all others."""
    if abs(score) < LONGEST:
        return None
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8)
    key = len(size).to_bytes(4) + size
    return key if score > 0 else bytes(255 - b for b in key)


_FOUND = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and queries.num_rows:
            ids, uids, vectors = _values(rows.to_pylist()[0])
            index, place = BitSlices(vectors), {u: i for i, u in enumerate(uids.tolist())}
            for q, u, v in zip(*_values(queries.to_pylist()[0]), strict=True):
                for s, i in search_block(index, ids, v[: vectors.shape[1]], k, place.get(int(u), -1)):
                    found.append((int(u), int(q), i, max(-LONGEST - 1, min(LONGEST, s)), order_key(s)))
        return pa.Table.from_arrays([pa.array([r[j] for r in found], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, v, wide) of the rows that take part, stored so that uid stays."""
    x = F.col(column)
    size = lambda e: F.abs(e.cast("double"))
    good = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda e: e.isNotNull() & (size(e) < float("inf")))
    wide = F.exists(x, lambda e: size(e) * scale >= WIDE)
    own = x if vectors.select(column).schema[0].dataType.simpleString() == "array<float>" else x.cast("array<double>")
    return stored(vectors.filter(good).select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("vec_id"), own.alias("v"), wide.alias("wide")), "vectors")


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best candidates of each query row of ``usable`` vectors: (query_id, rank, vec_id, score).

    Every block of queries meets every block of rows, each pair in a task of its own."""

    def deal(df: DataFrame, most: int) -> tuple[DataFrame, int]:
        n, wide = df.agg(F.count("*"), F.coalesce(F.max("wide"), F.lit(False))).first()
        blocks = max(1, -(-n // most))
        number = F.pmod(F.xxhash64("uid"), F.lit(blocks)) + F.when(F.col("wide"), F.lit(blocks)).otherwise(F.lit(0))
        return stored(df.withColumn("_b", number.cast("long")).groupBy("_b").applyInArrow(_pack(scale), _BLOCK), "vector-blocks"), blocks * (1 + wide)

    rows, n_rows = deal(vectors, block_rows)
    queries, n_queries = deal(vectors.filter(is_query), block_queries)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = rows.withColumnRenamed("_b", "_row").withColumn("_query", numbers(n_queries))
    queries = queries.withColumnRenamed("_b", "_query").withColumn("_row", numbers(n_rows))
    found = rows.groupBy("_row", "_query").cogroup(queries.groupBy("_row", "_query")).applyInArrow(_search(k), "uid long, query_id long, vec_id long, score long, key binary")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("key").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SCHEMA = pa.schema([("_b", pa.int64()), ("ids", pa.binary()), ("uids", pa.binary()), ("dims", pa.int32()), ("kind", pa.string()), ("values", pa.binary())])


def op10_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every row whose vec_id is divisible by 20."""
    return top_k(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % QUERY_STEP == 0)


OP10_SQL = """
with v as (select rowid_ uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from (select *, row_number() over () rowid_ from embeddings)
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.uid, q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score from v q join v c on q.uid <> c.uid where q.vec_id % 20 = 0)
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by uid order by score desc, vec_id) rank from p) where rank <= 20
"""

"""Token-id files with Elias-Fano encoded document boundaries.

A file holds segments in ascending document order. A segment is a Parquet row (Spark's committed output, readable from
any store): the concatenated ids of its documents as a little-endian uint16 or uint32 array, the document ids, and the
boundaries of the documents in the array as an Elias-Fano sequence. Its bytes: magic, count n, universe u, low width l;
the l low bits of every boundary; the high bits in unary; and the place of every 64th set bit, so that ``select``
returns any boundary in constant time without a table of 64-bit offsets.

Null text: empty, one end id. Null id: before all others. Equal ids: by text. Repeated rows: one document each.
Empty table: no segments and no rows. A very long text: a segment of its own. Extra columns: not read. A text with the
string of a special token: the ids that the library gives it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, row_order, slices, small_batches, stored
from .tokens import encoder

SEGMENT_TOKENS = 1 << 20
PART_ROWS = 2000
END_ID = 0
SAMPLE = 64
_HEAD = struct.Struct("<4sQQB")


class EliasFano:
    """A non-decreasing sequence of n numbers in 0..u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, u: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.u, self.low_bits, self.low, self.high, self.samples = n, u, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, u, low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        parts = (self.low, self.high, self.samples)
        return _HEAD.pack(b"EF01", self.n, self.u, self.low_bits) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, u, low_bits = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano sequence")
        sizes = struct.unpack_from("<3Q", data, _HEAD.size)
        at = _HEAD.size + 24
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, u, low_bits, *parts)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sampled place onward."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        left = i % SAMPLE
        byte, mask = place // 8, 0xFF << (place % 8) & 0xFF
        while left >= (ones := (self.high[byte] & mask).bit_count()):
            left -= ones
            byte, mask = byte + 1, 0xFF
        bits = self.high[byte] & mask
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return (place - i) << self.low_bits | low


_IDS = "doc_id long, _part int, width int, n_tokens long, ids binary"
_SEGMENT = "part int, first_token long, width int, n_docs int, n_tokens long, doc_ids binary, nulls binary, boundaries binary, ids binary"
_ROWS = "doc_id long, part int, first long, n_tokens long, ids_crc32 long"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(path), zstandard.ZstdCompressor(1)
        end = np.array([end_id], enc.dtype).tobytes()
        for part in slices(batches, "text", 1 << 22):
            ids = [x + end for x in enc.encode(["" if t is None else t for t in part.column("text").to_pylist()])]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_part"), pa.array([enc.dtype.itemsize] * n, pa.int32()), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(map(press.compress, ids), pa.binary())], ["doc_id", "_part", "width", "n_tokens", "ids"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order, segments of about SEGMENT_TOKENS ids; first_token counts within the part."""
    schema = pa.schema([("part", pa.int32()), ("first_token", pa.int64()), ("width", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("boundaries", pa.binary()), ("ids", pa.binary())])
    part, first, width, held, docs, size = None, 0, 2, [], [], 0

    def segment() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) // width for x in held])])
        row = [part, first, width, len(held), size, np.array([d or 0 for d in docs], "<i8").tobytes(), np.packbits([d is None for d in docs]).tobytes(), EliasFano.of(ends).to_bytes(), b"".join(held)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc, p, w, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (p != part or size + n > SEGMENT_TOKENS):
                yield segment()
                first, held, docs, size = first + size, [], [], 0
            if p != part:
                part, first = p, 0
            width = w
            held.append(unpress.decompress(ids))
            docs.append(doc)
            size += n
    if held:
        yield segment()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], f"<u{r['width']}")
            boundaries = EliasFano.from_bytes(r["boundaries"])
            ends = np.array([boundaries.select(i) for i in range(r["n_docs"] + 1)], np.int64)
            nulls = np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[: r["n_docs"]].astype(bool)
            crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=nulls), pa.array([r["part"]] * r["n_docs"], pa.int32()), pa.array(r["first_token"] + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs (doc_id, text) and write the file; returns its segments as read back from the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = row_order(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", PART_ROWS).mapInArrow(lean(_encode(tokenizer_path, end_id), tokenizer_path), _IDS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash of a part number spreads parts; within a partition they are in order, and so are their documents.
    ordered = ids.repartition(parts, "_part").sortWithinPartitions("_part", "doc_id", "ids")
    return stored(ordered.mapInArrow(_segments, _SEGMENT), "token-file")


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file, whose place the
    boundaries' ``select`` gives."""
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # MOST_PARTS rows at most
    starts = sums.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rows = segments.mapInArrow(_read, _ROWS).join(F.broadcast(starts), F.col("part") == F.col("_p"))
    return rows.select("doc_id", (F.col("_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op3_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token file of all documents and read every document's place and checksum back from it."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))

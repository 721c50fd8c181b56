"""Homomorphic multiset hash of a text's paragraphs.

A paragraph (a line, the empty ones too) is hashed to a wide vector: 8 lanes of 64 bits, the BLAKE2b digest of its
bytes, and 256 lanes of 32 bits, a count sketch of its runs of three words. A text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2**64 and 2**32. So it doesn't depend on the order of paragraphs, and a
paragraph is inserted or deleted by adding or subtracting its vector (``combine``). Equal multisets of paragraphs have
equal fingerprints; the first lanes tell different ones apart. The sketch lanes estimate the cosine of two texts' run
counts, which ``likeness`` returns, from 0 to 1 (standard error about 1/16).

Null text: empty. The empty text has one empty paragraph and no words; its likeness is 1 to a text without words, else
0. Null id: before all others. Ties (equal ids): by text. Repeated rows: one row each. One document: it is its own next.
Very long texts: hashed whole, one paragraph after the other. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, row_order, shingle_hashes, slices, small_batches, span_hashes, utf8, word_spans

LANES = 8
SKETCH = 256
RUN_WORDS = 3
PART_ROWS = 1000


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the texts' paragraph vectors: uint64 lanes and int32 sketch lanes."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    n = len(texts)
    breaks = np.flatnonzero(data == 10)
    # Each text ends a paragraph, and so does each newline in it.
    row = np.searchsorted(offsets, breaks, side="right") - 1
    ends = np.concatenate([breaks, offsets[1:]])
    rows = np.concatenate([row, np.arange(n)])
    order = np.lexsort((ends, rows))
    ends, rows = ends[order], rows[order]
    starts = np.empty(len(ends), np.int64)
    first = np.ones(len(ends), bool)
    first[1:] = rows[1:] != rows[:-1]
    starts[1:] = ends[:-1] + 1
    starts[first] = offsets[:-1]
    raw = data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8 * LANES).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    lanes = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, LANES), np.flatnonzero(first), axis=0)
    # Runs of words stay within a paragraph, so the sketch is a sum over paragraphs too.
    s, e, _ = word_spans(data, offsets)
    words = span_hashes(data, s, e)
    firsts = np.searchsorted(s, np.append(starts, len(data) + 1))
    runs, at = shingle_hashes(words, firsts, RUN_WORDS)
    owner = np.repeat(rows, np.diff(at))
    sign = 1 - 2 * (runs >> np.uint64(40) & np.uint64(1)).astype(np.int64)
    counts = np.bincount(owner * SKETCH + (runs & np.uint64(SKETCH - 1)).astype(np.int64), weights=sign, minlength=n * SKETCH)
    return lanes, counts.astype(np.int64).astype(np.int32).reshape(n, SKETCH)


def to_string(lanes: np.ndarray, sketch: np.ndarray) -> str:
    return base64.b64encode(lanes.astype("<u8").tobytes() + sketch.astype("<i4").tobytes()).decode()


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data, "<u8", LANES), np.frombuffer(data, "<i4", offset=8 * LANES)


def combine(fingerprint: str, added: str | None = None, deleted: str | None = None) -> str:
    """The fingerprint after paragraphs with these sums join or leave."""
    lanes, sketch = (x.copy() for x in from_string(fingerprint))
    for other, sign in ((added, 1), (deleted, -1)):
        if other is not None:
            a, b = from_string(other)
            lanes = lanes + a if sign > 0 else lanes - a
            sketch = sketch + b if sign > 0 else sketch - b
    return to_string(lanes, sketch)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of sketches, row by row, at least 0; 1 where both are empty."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot, norm = (a * b).sum(axis=1), np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    out = np.clip(np.divide(dot, norm, out=np.zeros(len(a)), where=norm > 0), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, out)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, look-ahead last. The row that stands before another is done when that one is known."""
    names = [x.split(" ")[0] for x in _OUT.split(", ")]
    held, closed = None, -1

    def rows() -> Iterator[list[tuple]]:
        for part in slices(batches, "text"):
            yield list(zip(*(part.column(c).to_pylist() for c in ("_part", "_ahead", "doc_id", "text")), strict=True))

    for chunk in rows():
        pairs: list[tuple[tuple, tuple]] = []
        for r in chunk:
            if held is not None and held[0] == r[0]:
                pairs.append((held, r))
                held = None
            elif r[0] == closed:
                continue  # equal ids: a second look-ahead row
            if r[1]:
                closed = r[0]
            else:
                held = r
        if not pairs:
            continue
        own, after = [a[3] or "" for a, _ in pairs], [b[3] or "" for _, b in pairs]
        changed = [edited(a, b) for a, b in zip(own, after, strict=True)]
        # Each text is mostly the next one of the pair before it, so the last one alone is new.
        chained = all(b is a for (_, b), (a, _) in zip(pairs, pairs[1:], strict=False))
        lanes, sketch = vectors([*own, after[-1]] if chained else own + after)
        later = sketch[1:] if chained else sketch[len(own) :]
        edited_lanes, edited_sketch = vectors(changed)
        sketch = sketch[: len(own)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array(map(len, own), pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array([to_string(a, b) for a, b in zip(lanes, sketch, strict=False)]),
                pa.array([to_string(a, b) for a, b in zip(edited_lanes, edited_sketch, strict=True)]),
                pa.array(likeness(sketch, edited_sketch)),
                pa.array(likeness(sketch, later)),
            ],
            names,
        )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of docs (doc_id, text) and of their edited texts, in one pass over ranges of doc_id.

    Each range also gets the first document of the next range that has any (after the last, of the first)."""
    spark = docs.sparkSession
    small_batches(spark)
    parted = row_order(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", PART_ROWS).withColumn("_ahead", F.lit(False))
    # MOST_PARTS rows at most: the least id of each range. Null comes before all others.
    least = parted.groupBy("_part").agg(F.min("doc_id").alias("_least"), F.max(F.col("doc_id").isNull()).alias("_null"))
    firsts = least.select("_part", F.when(F.col("_null"), F.lit(None)).otherwise(F.col("_least")).alias("_first"), F.col("_null").alias("_is_null"))
    order = Window.orderBy("_part")
    firsts = firsts.withColumn("_to", F.coalesce(F.lag("_part").over(order), F.max("_part").over(Window.partitionBy())))
    ahead = parted.join(F.broadcast(firsts.select(F.col("_part").alias("_p"), "_first", "_to")), (F.col("_part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    ahead = ahead.select("doc_id", "text", F.col("_to").alias("_part"), F.lit(True).alias("_ahead"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = parted.unionByName(ahead).repartition(parts, "_part").sortWithinPartitions("_part", "_ahead", "doc_id", "text")
    return rows.select("_part", "_ahead", "doc_id", "text").mapInArrow(lean(_compare), _OUT)


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

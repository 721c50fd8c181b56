"""Near-duplicate detection by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Features: the runs of five words (lower case; words end at ASCII white space) of a document, or all its words as one run
if it has fewer. Weight: count in the document times an inverse document frequency between IDF_FLOOR and 1, from a
count-min sketch of all documents (a fixed size, so a count stands for the share of documents; runs in fewer than one in
RARE are all rare alike). A near copy keeps its likeness even where a passage is common.

1. Documents with equal words (by a BLAKE2b digest of 128 bits) are one node, represented by one row.
2. Each node has SAMPLES consistent samples; BANDS of ROWS samples make bucket keys. Two texts with weighted Jaccard
   similarity s share a sample with probability s.
3. In a bucket of at most SMALL nodes every pair is a candidate. In a larger one each node is paired with two centres
   (the first and last by hash), the same in every band where it can be. Pairs whose samples agree too rarely for 0.8
   are dropped; the rest are verified by their exact weighted Jaccard similarity, from whole texts.
4. Components of the verified links are classes. A larger bucket whose nodes are still in different classes is cut into
   tiles, ordered by class, and every tile meets every other and itself: the exact similarity of all their pairs comes
   from matrix products. Only two tiles of one and the same class are left out. So no cap on a bucket hides a class;
   the work there grows with the square of the nodes outside its largest class.

Null text: no features, a class of its own. Empty texts and texts without words: equal, so one class. Repeated rows and
exact copies: one class. Ties: the least id names a class. Null id: allowed, never names a class unless alone. Very long
texts: all their shingles count. Empty table: empty result. Extra columns: not read. Sampling misses a pair at 0.8 with
probability 0.03%.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, lean_group, mix, seeds, shingle_hashes, slices, small_batches, span_hashes, unstore, utf8, word_spans
from ._common import stored as _stored
from .components import components, joined


def stored(df: DataFrame, name: str) -> DataFrame:
    """Hashes and packed texts hardly compress; this codec needs no memory outside the executor's heap."""
    return _stored(df, name, "lz4_raw")


WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
SMALL = 8
#: Nodes, and bytes of compressed texts, of a tile of a larger bucket.
TILE_NODES, TILE_BYTES = 1024, 1 << 20
#: Similarities from float32 sums that are this near the threshold are worked out anew.
MARGIN = 1e-3
SKETCH_BITS = 18
SKETCH_ROWS = 2
RARE = 100.0
IDF_FLOOR = 0.75
#: Documents without shared shingles that are added to the count, so that in a small table nothing is common by chance.
PRIOR = 10_000
#: Samples that must agree before a pair is verified: fewer than 0.8 * 36 by over 4 standard deviations.
LEAST_AGREE = 18
FILTER_BITS = 1 << 24
_SLICE = 1 << 16


def word_keys(texts: pa.Array) -> np.ndarray:
    """Two 64-bit halves of a digest of each text's words."""
    data, offsets = utf8(pc.utf8_lower(texts))
    raw, ends = data.tobytes(), offsets.tolist()
    # Bytes are split at ASCII white space, as the words of shingles are.
    digests = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)]
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (ascending), their counts, and each text's first shingle."""
    data, offsets = utf8(pc.utf8_lower(texts))
    starts, ends, firsts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    runs, at = shingle_hashes(words, firsts, WIDTH)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((runs, row))
    runs = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    kept = np.flatnonzero(new)
    counts = np.diff(np.append(kept, len(runs)))
    return runs[kept], counts, np.searchsorted(row[kept], np.arange(n + 1))


def _places(runs: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return [(runs >> np.uint64(20 * r + 4) & mask).astype(np.int64) for r in range(SKETCH_ROWS)]


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts and a count-min sketch of how many of them hold a shingle (SKETCH_ROWS * 2**SKETCH_BITS).

    Tasks send compressed slices of the sketch, which are summed apart; its size doesn't depend on the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64), 0
        for part in slices(batches, "text"):
            runs, _, _ = _features(part.column("text"))
            n += part.num_rows
            for r, at in enumerate(_places(runs)):
                sketch[r] += np.bincount(at, minlength=1 << SKETCH_BITS)
        parts = sketch.reshape(-1, _SLICE)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([zlib.compress(np.array([n], "<i8").tobytes(), 1), *(zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts)], pa.binary())], ["slice", "counts"])

    def add(table):
        total = 0
        for x in table.column("counts").to_pylist():
            total = total + np.frombuffer(zlib.decompress(x), "<i8")
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    texts = docs.filter(F.col("text").isNotNull()).select("text")
    kind = "slice int, counts binary"
    summed = texts.mapInArrow(lean(count), kind).groupBy("slice").applyInArrow(add, kind)
    found = {r[0]: np.frombuffer(zlib.decompress(r[1]), "<i8") for r in summed.collect()}  # a fixed number of slices
    if not found:
        return 0, np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
    return int(found.pop(-1)[0]), np.concatenate([found[i] for i in sorted(found)]).reshape(SKETCH_ROWS, -1)


def idf_table(n: int, sketch: np.ndarray, prior: int = PRIOR) -> np.ndarray:
    """The weight of each sketch cell: 1 for shares under 1 / RARE, down to IDF_FLOOR for shingles of all documents."""
    share = np.maximum(sketch, 1) / max(n + prior, 1)
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.clip(-np.log(share) / np.log(RARE), 0, 1)).astype(np.float32)


def weights(runs: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    # The larger of a shingle's cells is the one with the smaller count.
    best = idf[0][_places(runs)[0]]
    for r, at in enumerate(_places(runs)[1:], 1):
        best = np.maximum(best, idf[r][at])
    return counts.astype(np.float32) * best


_TABLE = 1 << 16


class Sampler:
    """ICWS with its random variates from tables: for a shingle, sample k has r and c from Gamma(2, 1) and b from
    U(0, 1), fixed by two 16-bit parts of a hash. The sample is the shingle with the least ln a, where
    ln a = ln c - r * (t - b + 1) and t = floor(ln(weight) / r + b); it is told apart by shingle and t."""

    def __init__(self, samples: int = SAMPLES, seed: int = 2024):
        g = np.random.default_rng(seed)
        self.factors = seeds(samples, seed) | np.uint64(1)
        self.r, self.b, self.ln_c = (np.empty((samples, _TABLE), np.float32) for _ in range(3))
        # Row by row: the same numbers as at once, without tables of doubles beside.
        for row in self.r:
            row[:] = g.gamma(2.0, 1.0, _TABLE)
        for row in self.b:
            row[:] = g.random(_TABLE)
        for row in self.ln_c:
            row[:] = np.log(g.gamma(2.0, 1.0, _TABLE))

    def sample(self, runs: np.ndarray, w: np.ndarray, at: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """A (texts, samples) array of 32-bit sample names; 0 for texts without shingles."""
        n = len(at) - 1
        out = np.zeros((n, len(self.factors)), np.uint32)
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return out
        ln_w = np.log(w)
        starts = at[:-1][full]
        # Blocks of texts that fit the cache; a longer text is a block of its own.
        cuts = [0, *(np.flatnonzero(np.diff(starts // step)) + 1).tolist(), len(full)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            low, high = starts[a], at[full[z - 1] + 1]
            own, lw, first = runs[low:high], ln_w[low:high], starts[a:z] - low
            name = (own & np.uint64(0xFFFFFF)) << np.uint64(8)
            for k, factor in enumerate(self.factors):
                h = own * factor
                i = (h >> np.uint64(48)).astype(np.int64)
                j = (h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
                r, b = self.r[k][i], self.b[k][i]
                t = np.floor(lw * (np.float32(1) / r) + b)
                ln_a = self.ln_c[k][j] - r * (t - b + np.float32(1))
                # As bits, positive floats sort as whole numbers do.
                key = np.maximum(ln_a + np.float32(256), np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)
                key |= name
                key |= t.astype(np.int64).astype(np.uint64) & np.uint64(0xFF)
                out[full[a:z], k] = np.minimum.reduceat(key, first) & np.uint64(0xFFFFFFFF)
        return out


def jaccard(runs_a: np.ndarray, w_a: np.ndarray, runs_b: np.ndarray, w_b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists: sum of least over sum of greatest weights."""
    _, i, j = np.intersect1d(runs_a, runs_b, assume_unique=True, return_indices=True)
    least = float(np.minimum(w_a[i], w_b[j]).sum())
    most = float(w_a.sum()) + float(w_b.sum()) - least
    return least / most if most else 1.0


_SIGNED = "doc_id long, row long, key_a long, key_b long, bands array<long>, samples array<int>"


def _sign(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, draw = idf.value, Sampler()
        for part in slices(batches, "text"):
            runs, counts, at = _features(part.column("text"))
            keys = word_keys(part.column("text"))
            names = draw.sample(runs, weights(runs, counts, table), at)
            factors = seeds(ROWS, 31) | np.uint64(1)
            bands = mix((mix(names.astype(np.uint64).reshape(-1, BANDS, ROWS) + np.uint64(1)) * factors).sum(axis=2, dtype=np.uint64))
            empty = np.diff(at) == 0
            listed = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.reshape(-1)))
            lists = listed(bands.view(np.int64), BANDS)
            lists = pc.if_else(pa.array(empty), pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *(pa.array(keys[:, j].view(np.int64)) for j in (0, 1)), lists, listed(names.view(np.int32), SAMPLES)], ["doc_id", "row", "key_a", "key_b", "bands", "samples"])

    return run


def _agree(a: Column, b: Column) -> Column:
    """How many samples two rows share."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _verify(idf, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unpress = idf.value, zstandard.ZstdDecompressor()
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                batch = big.slice(lo, 64)
                sides = []
                for c in ("text_a", "text_b"):
                    distinct = batch.column(c).dictionary_encode()
                    whole = pa.array([unpress.decompress(x).decode() for x in distinct.dictionary.to_pylist()], pa.string())
                    runs, counts, at = _features(whole)
                    sides.append((distinct.indices.to_pylist(), runs, weights(runs, counts, table), at))
                (ia, ra, wa, pa_), (ib, rb, wb, pb) = sides
                near = [jaccard(ra[pa_[i] : pa_[i + 1]], wa[pa_[i] : pa_[i + 1]], rb[pb[j] : pb[j + 1]], wb[pb[j] : pb[j + 1]]) for i, j in zip(ia, ib, strict=True)]
                keep = pa.array([x >= threshold for x in near])
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(near).filter(keep)], ["a", "b", "similarity"])

    return run


def overlaps(row_a: np.ndarray, key_a: np.ndarray, row_b: np.ndarray, key_b: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """For rows i of a and j of b, the summed weight of the keys they share; weight belongs to the entries of a."""
    out = np.zeros(shape, np.float32)
    keys, at_a = np.unique(key_a, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, key_b), max(len(keys) - 1, 0))
    known = keys[place] == key_b if len(keys) else np.zeros(len(key_b), bool)
    row_b, at_b = row_b[known], place[known]
    n_a, n_b = np.bincount(at_a, minlength=len(keys)), np.bincount(at_b, minlength=len(keys))
    each = np.zeros(len(keys), np.float32)
    each[at_a] = weight
    common = n_a * n_b * 200 > shape[0] * shape[1]  # a dense column is cheaper than a list of its pairs
    number = np.cumsum(common) - 1
    dense_a, dense_b = np.flatnonzero(common[at_a]), np.flatnonzero(common[at_b])
    for low in range(0, int(common.sum()), 2048):
        sides = []
        for rows, at, own, n in ((row_a, at_a, dense_a, shape[0]), (row_b, at_b, dense_b, shape[1])):
            column = number[at[own]] - low
            here = (column >= 0) & (column < 2048)
            block = np.zeros((n, 2048), np.float32)
            block[rows[own[here]], column[here]] = np.sqrt(each[at[own[here]]])
            sides.append(block)
        out += sides[0] @ sides[1].T
    # The rest: all pairs of each key, in parts.
    order = np.argsort(at_b, kind="stable")
    first = np.cumsum(n_b) - n_b
    rare = np.flatnonzero(~common[at_a] & (n_b[at_a] > 0))
    ends = np.cumsum(n_b[at_a[rare]])
    cuts = [0, *(np.flatnonzero(np.diff(ends >> 18)) + 1).tolist(), len(rare)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = rare[low:high]
        times = n_b[at_a[own]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = row_b[order[np.repeat(first[at_a[own]], times) + step]]
        np.add.at(out.reshape(-1), np.repeat(row_a[own], times) * shape[1] + other, np.repeat(each[at_a[own]], times))
    return out


class _Tile:
    """Nodes of a bucket with their classes and the features of their texts."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, texts: list[bytes], idf: np.ndarray):
        self.nodes, self.labels = nodes, labels
        unpress = zstandard.ZstdDecompressor()
        column = pa.array([unpress.decompress(x).decode() for x in texts], pa.string())
        found = [_features(part.column("text")) for part in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
        self.runs, self.counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        self.w = weights(self.runs, self.counts, idf)
        sizes = np.concatenate([np.diff(f[2]) for f in found])
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(nodes)), sizes)
        self.total = np.bincount(self.row, self.w, len(nodes))

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-th occurrence of each shingle as a key of its own, so that the weight of common keys is the sum of least
        weights: row, key and weight of each."""
        nth = np.arange(self.counts.sum()) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        key = mix(np.repeat(self.runs, self.counts) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.repeat(self.row, self.counts), key, np.repeat(self.w / self.counts, self.counts).astype(np.float32)

    def features(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.runs[self.at[i] : self.at[i + 1]], self.w[self.at[i] : self.at[i + 1]]


def _similar(x: _Tile, y: _Tile, threshold: float) -> np.ndarray:
    """Which pairs of x and y, of different classes, reach the threshold."""
    row_x, key_x, each = x.repeats()
    row_y, key_y, _ = y.repeats()
    least = overlaps(row_x, key_x, row_y, key_y, each, (len(x.nodes), len(y.nodes)))
    most = x.total[:, None].astype(np.float32) + y.total[None, :].astype(np.float32) - least
    near = least / np.maximum(most, np.float32(1e-9))
    apart = x.labels[:, None] != y.labels[None, :]
    found = apart & (near >= threshold + MARGIN)
    for i, j in np.argwhere(apart & ~found & (near >= threshold - MARGIN)).tolist():
        found[i, j] = jaccard(*x.features(i), *y.features(j)) >= threshold
    return found


def _forest(found: np.ndarray, x: _Tile, y: _Tile) -> list[tuple[int, int]]:
    """Fewest pairs that join what all found pairs join."""
    _, label = np.unique(np.concatenate([x.labels, y.labels]), return_inverse=True)
    links = []
    for i in np.flatnonzero(found.any(axis=1)).tolist():
        other = np.flatnonzero(found[i])
        names, first = np.unique(label[len(x.nodes) + other], return_index=True)
        for name, j in zip(names.tolist(), other[first].tolist(), strict=True):
            if name != label[i]:
                links.append((int(x.nodes[i]), int(y.nodes[j])))
                label[label == name] = label[i]
    return links


_TILE = "bucket long, tile long, lo long, hi long, nodes array<long>, labels array<long>, texts array<binary>"


def _pack_tile(table: pa.Table) -> pa.Table:
    labels = table.column("label")
    ends = pc.min_max(labels)
    whole = [[table.column(c).to_pylist()] for c in ("node", "label", "text")]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    head = [pa.array([v.as_py()], pa.int64()) for v in (table.column("bucket")[0], table.column("tile")[0], ends["min"], ends["max"])]
    return pa.table([*head, *(pa.array(v, t) for v, t in zip(whole, kinds, strict=True))], ["bucket", "tile", "lo", "hi", "nodes", "labels", "texts"])


def _meet(idf, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sides = {}
        for r in table.to_pylist():
            sides[r["tile"]] = _Tile(np.array(r["nodes"], np.int64), np.array(r["labels"], np.int64), r["texts"], idf.value)
        x, y = sides[min(sides)], sides[max(sides)]
        links = _forest(_similar(x, y, threshold), x, y)
        return pa.table([pa.array([v[i] for v in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _crossing(large: DataFrame, labels: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) that join all classes with a pair that shares a bucket of large and reaches the threshold."""
    classed = large.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"_h{i}") for i in (0, 1)]
    mixed = classed.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("_n"), *sums).filter("_lo <> _hi")
    mixed = mixed.groupBy("_n", "_h0", "_h1").agg(F.min("bucket").alias("bucket"))  # of buckets with the same nodes, one
    rows = classed.join(mixed.select("bucket"), "bucket")
    sizes = texts.select(F.col("node").alias("_n"), F.length("text").alias("bytes"))
    share = F.greatest(F.lit(1 / TILE_NODES), F.col("bytes") / TILE_BYTES)
    before = F.sum(share).over(Window.partitionBy("bucket").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, 0)) - share
    placed = rows.join(sizes, F.col("node") == F.col("_n")).withColumn("tile", F.floor(before + 1e-9)).select("bucket", "tile", "node", "label")
    with_text = placed.join(texts.select(F.col("node").alias("_n"), "text"), F.col("node") == F.col("_n")).select("bucket", "tile", "node", "label", "text")
    tiles = stored(with_text.groupBy("bucket", "tile").applyInArrow(_pack_tile, _TILE), "tiles")
    head = lambda t: tiles.select("bucket", F.col("tile").alias(t), F.col("lo").alias(f"lo_{t}"), F.col("hi").alias(f"hi_{t}"))
    met = head("x").join(head("y"), "bucket").filter("x <= y and not (lo_x = hi_x and lo_y = hi_y and lo_x = lo_y)").select("bucket", "x", "y")
    met = stored(met, "tile-pairs")
    sides = met.withColumn("tile", F.explode(F.array_distinct(F.array("x", "y"))))
    return stored(sides.join(tiles.drop("lo", "hi"), ["bucket", "tile"]).groupBy("bucket", "x", "y").applyInArrow(lean_group(_meet(idf, threshold)), "a long, b long"), "links")


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the keys set: a fixed size for the driver."""
    at = keys.select((F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1).alias("h"))
    found = at.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in found:
        # Spark's bitmaps count numbers, and their buckets of 32,768, from 1.
        start = (bucket - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def row_key(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, by_row: bool = False, prior: int = PRIOR) -> DataFrame:
    """(doc_id, class_id) of every row of docs (doc_id, text): class_id is the least doc_id of its class.

    With by_row, (doc_id, row, label) of every row with a text, where ids may repeat: row is ``row_key`` of the text, and
    label differs between classes."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, sketch = document_frequency(docs)
    idf = spark.sparkContext.broadcast(idf_table(n, sketch, prior))
    own_row = row_key(F.col("text")) if by_row else F.lit(None).cast("long")
    signed = docs.filter(F.col("text").isNotNull()).withColumn("row", own_row).mapInArrow(lean(_sign(idf)), _SIGNED)
    signed = stored(signed.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    # One row stands for all texts with the same words.
    nodes = stored(signed.groupBy("key_a", "key_b").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "nodes")
    own = signed.join(nodes.select("node"), F.col("uid") == F.col("node")).filter("bands is not null").select("node", "key_a", "key_b", "bands", "samples")
    own = stored(own, "own")
    keyed = own.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(keyed.join(buckets, "bucket"), "members")

    small = members.filter(F.col("size") <= SMALL)
    within = small.alias("x").join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = members.filter(F.col("size") > SMALL)

    def starred(rows: DataFrame, seed: int) -> DataFrame:
        """Each row's node paired with the bucket's first and last node by a hash."""
        ranked = rows.withColumn("h", F.xxhash64("node", F.lit(seed)))
        centres = ranked.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        ends = ranked.join(centres, "bucket").filter((F.col("h") == F.col("low")) | (F.col("h") == F.col("high"))).select(F.col("bucket").alias("_b"), F.col("node").alias("centre")).distinct()
        pairs = rows.join(ends, F.col("bucket") == F.col("_b")).filter("node <> centre")
        return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))

    keys = own.join(members.select("node").distinct(), "node", "left_semi").select("node", "key_a", "key_b", "samples")
    texts = stored(_texts(docs, keys.select("key_a", "key_b")).join(keys, ["key_a", "key_b"]).select("node", "samples", "text"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda c: texts.select(F.col("node").alias(c), F.col("samples").alias(f"s_{c}"))
        whole = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(_agree(F.col("s_a"), F.col("s_b")) >= LEAST_AGREE).select("a", "b"), f"{name}-likely")
        both = likely.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "text_a", "text_b")
        out = stored(both.mapInArrow(lean(_verify(idf, threshold)), "a long, b long, similarity double"), name)
        unstore(likely)
        return out

    candidates = stored(within.unionByName(starred(large, 0)).distinct(), "candidates")
    links = verified(candidates, "links")
    labels = components(links)
    labels = joined(labels, _crossing(large, labels, texts, idf, threshold))
    classed = nodes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key_a", "key_b", "least", F.coalesce("label", "node").alias("label"))
    classed = stored(classed, "classes")
    for done in (nodes, own, members, texts, candidates, links):
        unstore(done)
    if by_row:
        return signed.select("doc_id", "row", "key_a", "key_b").join(classed.select("key_a", "key_b", "label"), ["key_a", "key_b"]).select("doc_id", "row", "label")
    least = classed.groupBy("label").agg(F.min("least").alias("class_id"))
    names = classed.join(least, "label").select("key_a", "key_b", "class_id")
    rows = signed.select("doc_id", "key_a", "key_b").join(names, ["key_a", "key_b"]).select("doc_id", "class_id")
    return rows.unionByName(docs.filter(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key_a, key_b, text): one text of each key, compressed. Only texts that a filter of fixed size lets pass are moved."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, "key_a"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, press = bits.value, zstandard.ZstdCompressor(3)
        for part in slices(batches, "text"):
            own = word_keys(part.column("text"))
            at = (own[:, 0] & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            rows = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(rows):
                texts = part.column("text").take(pa.array(rows)).to_pylist()
                yield pa.RecordBatch.from_arrays([*(pa.array(own[rows, j].view(np.int64)) for j in (0, 1)), pa.array([press.compress(t.encode()) for t in texts], pa.binary())], ["key_a", "key_b", "text"])

    close = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(lean(pick), "key_a long, key_b long, text binary")
    return close.join(keys, ["key_a", "key_b"], "left_semi").groupBy("key_a", "key_b").agg(F.first("text").alias("text"))


def op5_icws_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language identification by prediction by partial matching.

For each language a context tree of bytes, up to ``ORDER`` bytes deep, is counted on a bounded sample of labelled
documents. A byte is coded in the deepest known context; one not seen there costs an escape (method C: d distinct of n
counts gives d / (n + d)) and is coded in the next shorter context without the bytes already excluded, at last evenly
over all byte values. With frozen counts the length of a code depends on the last ORDER bytes alone, so every tree is
flattened to tables of states and a table of bits per state and byte; scoring a text is a few look-ups a byte. The
language with the shortest exact code of the whole text wins (ties: the least name); its score is
its share when each code length L weighs 2**-L.

Null text or one without a letter: ``und``, score 0. Labels: rows with null lang or text don't train. No training rows:
everything is ``und``. Repeated rows: scored each. Ties of the training sample: by text. Very long texts: scored whole,
slice by slice of rows. Empty table: empty result. Extra columns: kept; ``predict`` replaces columns named ``lang_pred`` and
``score``. The model's size is bounded by the sample: SAMPLE_ROWS texts of at most SAMPLE_BYTES for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, slices, small_batches, utf8

ORDER = 3
#: Documents that train each language: those with the smallest hash, whole, among texts of at most SAMPLE_BYTES; where
#: they are too few, the starts of longer ones.
SAMPLE_ROWS = 200
SAMPLE_BYTES = 16_384
BYTES = 256
FOLDS = 5
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 0


class ContextTree:
    """Counts of the symbols after every context of 0..order symbols; symbols are 0..size-1, and 0 pads starts.

    Symbols stand for the byte values seen in training; the last one for any other, each of which costs the same."""

    def __init__(self, size: int, order: int, texts: list[np.ndarray]):
        self.size, self.order = size, order
        padded = [np.concatenate([np.zeros(order, np.int64), t]) for t in texts]
        self.counts: list[dict[int, dict[int, int]]] = []
        for k in range(order + 1):
            codes = [np.zeros(0, np.int64)]
            for t in padded:
                code = np.zeros(len(t) - order, np.int64)
                for j in range(k, -1, -1):
                    code = code * size + t[order - j : len(t) - j]
                codes.append(code)
            level: dict[int, dict[int, int]] = {}
            for code, n in zip(*(x.tolist() for x in np.unique(np.concatenate(codes), return_counts=True)), strict=True):
                level.setdefault(code // size, {})[code % size] = n
            self.counts.append(level)

    def bits(self, context: list[int]) -> np.ndarray:
        """The code length of every symbol after the context (its last symbols count)."""
        out, cost, seen = np.full(self.size, np.inf), 0.0, np.zeros(self.size, bool)
        for k in range(min(self.order, len(context)), -1, -1):
            code = 0
            for c in context[len(context) - k :]:
                code = code * self.size + c
            new = {s: n for s, n in self.counts[k].get(code, {}).items() if not seen[s]}
            if new:
                symbols, n = np.fromiter(new, np.int64), np.fromiter(new.values(), np.float64)
                total = n.sum() + len(new)
                out[symbols] = cost - np.log2(n / total)
                cost -= np.log2(len(new) / total)
                seen[symbols] = True
        rest = ~seen
        rest[0] = False
        out[rest] = cost + np.log2(max(1, BYTES - int(seen.sum())))
        return out

    def flatten(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the last two symbols, the number of their context (0: unknown) and the state without a longer one; for
        this number and the symbol before, the state of all three (0: unknown); and the bits of (state, symbol)."""
        size = self.size
        rows = [self.bits([])]
        near = np.zeros((size, size), np.int32)
        for c in sorted(self.counts[1]) if self.order else ():
            near[:, c] = len(rows)
            rows.append(self.bits([c]))
        number = np.zeros((size, size), np.int32)
        known = sorted(self.counts[2]) if self.order > 1 else []
        for i, code in enumerate(known, 1):
            number[divmod(code, size)] = i
            near[divmod(code, size)] = len(rows)
            rows.append(self.bits([*divmod(code, size)]))
        far = np.zeros((len(known) + 1, size), np.int32)
        for code in sorted(self.counts[3]) if self.order > 2 else ():
            before, pair = divmod(code, size * size)
            far[number[divmod(pair, size)], before] = len(rows)
            rows.append(self.bits([before, *divmod(pair, size)]))
        return number.reshape(-1), near.reshape(-1), far.reshape(-1), np.stack(rows).astype(np.float32).reshape(-1)


class Model:
    """Flattened trees of all languages over one alphabet: the byte values that any of them has."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        if order > 3:
            raise ValueError("contexts of at most three bytes")
        data = {lang: [utf8(pc.utf8_lower(pa.array([t], pa.large_string())))[0] for t in texts] for lang, texts in samples.items()}
        kept = np.flatnonzero(sum((np.bincount(t, minlength=BYTES) for texts in data.values() for t in texts), np.zeros(BYTES, np.int64)))
        self.symbol = np.full(BYTES, len(kept) + 1, np.int32)
        self.symbol[kept] = np.arange(1, len(kept) + 1)
        self.size, self.order = len(kept) + 2, order
        self.langs = sorted(data)
        self.trees = {lang: ContextTree(self.size, order, [self.symbol[t].astype(np.int64) for t in data[lang]]) for lang in self.langs}
        self.tables = [self.trees[lang].flatten() for lang in self.langs]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trees"}

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        n, k = len(offsets) - 1, 3
        at = np.arange(len(data)) + k * np.repeat(np.arange(1, n + 1), np.diff(offsets))
        codes = np.zeros(len(data) + k * n + 1, np.int32)
        codes[at] = self.symbol[data]
        pair = codes[at - 2] * np.int32(self.size) + codes[at - 1]
        before, own = codes[at - 3], codes[at]
        out = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        for i, (number, near, far, bits) in enumerate(self.tables):
            if len(full):
                state = far[number[pair] * np.int32(self.size) + before]
                state = np.where(state == 0, near[pair], state)
                out[full, i] = np.add.reduceat(bits[state.astype(np.int64) * self.size + own], offsets[full], dtype=np.float64)
        return out


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """At most rows texts of each language: a bounded sample for the driver. Texts of at most most_bytes come first, whole;
    where a language has too few of them, longer ones give their first most_bytes / 4 characters."""
    long = F.octet_length("text") > most_bytes
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.when(long, F.left("text", F.lit(most_bytes // 4))).otherwise(F.col("text")).alias("text"), long.alias("_long"), F.xxhash64(F.col("doc_id"), F.lit("ppm")).alias("_h"))
    chosen = usable.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_long", "_h", "text"))).filter(F.col("_n") <= rows)
    out: dict[str, list[str]] = {}
    for r in chosen.select("lang", "text").orderBy("lang", "_n").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def train(docs: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Model | None:
    """A model from docs (doc_id, text, lang) outside the held-out fold; None without any labelled row."""
    samples = sample(docs.filter(~held_out(F.col("doc_id"), folds)).select("doc_id", "text", "lang"), rows, most_bytes)
    return Model(samples, order) if samples else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; only the column text decides."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, text):
            texts = part.column(text)
            n = part.num_rows
            known = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
            langs, scores = np.full(n, "und", object), np.zeros(n)
            if model is not None and known.any():
                bits = model.lengths(*utf8(pc.utf8_lower(texts)))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                langs[known] = np.array(model.langs, object)[best[known]]
                scores[known] = share[known]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(lean(run), schema)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter, as ``predict`` asks: false for null."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: t is not None and bool(_LETTER.search(t))).astype(bool), "boolean")(text)


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language with trees trained on the other folds' labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

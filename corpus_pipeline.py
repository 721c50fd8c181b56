"""From raw documents to packed training sequences: five stages, each an operator of ``graphloom.llm``.

Each stage reads all that the one before has written; all but the last return the columns of documents (doc_id, text,
lang, source and any others, whatever their names: they are carried under names of our own). In every stage repeated rows
are documents each, an empty table gives an empty one, and very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import key_hash, marked, row_filter, sheltered, stored, unstore
from graphloom.llm.language_id import has_letter, predict, train
from graphloom.llm.mixing import mix
from graphloom.llm.near_dedup import near_duplicates, row_key
from graphloom.llm.packing import pack, pieces_of
from graphloom.llm.suffix_dedup import dedup

#: SQL can't express the tree model, the sampling of shingles and the search of the packing; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; no others where no label trains.

    Null and empty texts and those without a letter go. Null labels don't train; null ids and sources don't matter, and
    neither do ties: each row is judged by its text alone."""
    model = train(docs)
    if model is None:
        return docs.filter(has_letter(F.col("text")))
    renamed, back = sheltered(docs)
    text = f"_own{docs.columns.index('text')}"
    return predict(docs.select(renamed), model, text).filter(F.col("lang_pred") != "und").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id, then (ties) the least hash of a text.

    Ids may repeat. Null ids and null texts stay. Empty texts are equal, so one of them stays. Of repeated rows one stays."""
    rows = near_duplicates(docs, by_row=True).filter("doc_id is not null").groupBy("label", "doc_id", "row").agg(F.count("*").alias("_rows"))
    rows = stored(rows, "rows")
    first = rows.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct("doc_id", "row")).alias("_first"))
    placed = rows.join(first, F.col("label") == F.col("_label")).withColumn("_keep", F.struct("doc_id", "row") == F.col("_first"))
    # Only rows that may have to go are moved: those of a class with an earlier row, and those there are several times.
    suspects = stored(placed.filter("not _keep or _rows > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_keep"), "suspects")
    renamed, back = sheltered(docs)
    own = docs.select(*renamed, F.col("doc_id").cast("long").alias("_doc"), row_key(F.col("text")).alias("_key"), F.col("text").isNull().alias("_null"))
    known = marked(own, key_hash("_doc", "_key"), row_filter(suspects, key_hash("_id", "_row")), "_maybe")
    same = (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_row")) & ~F.col("_null")
    moved = known.filter("_maybe").join(suspects, same, "left").filter("_id is null or _keep")
    # Rows that the filter let pass by chance have no suspect; each of them is a group of its own.
    alone = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    once = moved.withColumn("_alone", alone).withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_row", "_alone").orderBy("_key"))).filter("_n = 1")
    return known.filter(~F.col("_maybe")).select(back).unionByName(once.select(back))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have too; a character cut in two goes as a whole.

    A null text becomes an empty one, and empty ones stay. Null ids come after all others; of rows that share an id (ties,
    repeated rows) none is earlier. n_chars, where there is one, is that of the text left."""
    renamed, _ = sheltered(docs)
    carried = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = dedup(docs.select("doc_id", "text", *[c for c, name in zip(renamed, docs.columns, strict=True) if name in carried]), carry=tuple(carried.values()), with_kept="text")
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in carried:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select([(new[c] if c in new else F.col(carried[c])).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words and aren't taken. A null source is a source of its own. A null id is ranked by its
    text. Ties and repeated rows are ranked alike and taken each."""
    renamed, back = sheltered(docs)
    chosen = mix(docs.select("doc_id", "text", "source", *renamed), carry=tuple(f"_own{i}" for i in range(len(renamed))))
    return chosen.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in as few sequences as can be.

    Null and empty texts are an end id. Null ids stay null. Ties and repeated rows are packed each. Extra columns end here."""
    import public_tokenizers

    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            unstore(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

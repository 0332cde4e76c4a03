"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run`` writes each stage's rows
as Parquet into the shared folder and reads them back as the next one's documents.  All stages but the last return the
columns of ``documents``, and whatever columns there are besides, under any names; the last returns the pieces of the packed
sequences.  Empty tables go through every stage and give no rows.  Very long texts are handled whole, each in one task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dup, packing, quality, suffix_dedup
from tidemark.llm.pieces import read_tokenizer
from tidemark.llm.runtime import stored, table


def _row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with all its columns once more as one, and that one's name."""
    (name,) = suffix_dedup.free_names(docs, "__row")
    return docs.withColumn(name, F.struct(*docs.columns)), name


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep.

    A null or empty text has no words and goes; a null id does not matter; rows that repeat are judged alike.
    """
    rows, row = _row(docs)
    return quality.quality(rows, carry=[row]).where("kept").select(f"{row}.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five words, similarity 0.8).

    Rows that share an id are one document and stay or go together.  Rows without an id, and texts without words, are in no
    group and stay.
    """
    kept = near_dup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier document has; those that it empties go.

    Rows without an id come after all others; rows that share an id, or have none, take nothing from each other.  Null texts
    stay as they are; ``n_chars`` is counted anew.
    """
    cut = suffix_dedup.remove_repeats(docs, rewrite=True)
    cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where("text is null or text rlike '[^ \\\\t\\\\n\\\\x0b\\\\f\\\\r]'").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; rows that repeat are judged alike; an item without words has no window.
    """
    rows, row = _row(docs)
    judged = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), carry=[row])
    return judged.where("NOT contaminated").select(f"{row}.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids.  A null text has its end id alone; a null id goes through; rows that repeat are documents
    of their own."""
    return packing.pack(docs, read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), end_id=2)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("suffix_dedup", without_repeats), ("decontamination", without_benchmark), ("packing", packed)]

#: Compression ratios, connected components and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversation_trie, decontaminate, language_id, mixing, near_dup, packing, quality, sharding, suffix_dedup, token_counts, token_store, warc
from .oracle import SQL
from .pieces import read_tokenizer
from .runtime import Workspace, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(language_id.sample(docs.where(~held_out), "doc_id", "text", "lang"))
    return language_id.identify(docs, model, carry=["doc_id", held_out.alias("held_out")])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_store.write_store(docs, read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), end_id=1)
    return token_store.read_store(manifest, docs.select("doc_id")).drop("ids")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), end_id=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_pages(table(spark, sf_dir, "pages")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "rate", (F.col("size") * F.col("copies")).alias("taken"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    turns = space.stored(conversation_trie.compact(table(spark, sf_dir, "conversations"), space), "turns")
    turns, convs = conversation_trie.crossed(turns, space.stored(conversation_trie.lengths(turns), "lengths"))
    return conversation_trie.trie(turns, convs, space)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return alignment.align(table(spark, sf_dir, "documents"), read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), model)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_near_duplicates, op4_token_ids, op5_suffix_dedup, op6_decontamination, op7_packing, op8_quality, op9_token_counts, op10_warc, op11_mixing, op12_conversation_trie, op13_alignment)}

__all__ = ["QUERIES", "SQL"]

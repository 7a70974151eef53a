"""The corpus pipeline: quality rules, language ID, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language_id, packing, quality_rules, similar, substrings
from strandline.llm.common import discard, has, read, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the histograms' divergence let pass."""
    return quality_rules.kept_rows(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the language column is the declaration, and the source the host."""
    model = language_id.fit(docs)
    every = F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)
    # Whole documents travel as one column, so that no name of theirs clashes.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(every[0].alias("a"), every[1].alias("b")).alias("key"), "text")
    declared = F.lower(F.col("doc.lang")) if has(docs, "lang") else None
    host = F.col("doc.source") if has(docs, "source") else None
    found = language_id.identify(keyed, model, "key", "text", declared, host=host)
    rejected = store(found.where(~F.col("accepted")).select(F.col("id").alias("key")).distinct(), "pipeline-language")
    return keyed.join(rejected, "key", "left_anti").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 similar."""
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of a smaller id holds; documents that lose nothing keep their text as it is."""
    return substrings.without_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of near-equal sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("language ID", language), ("near duplicates", near_duplicates), ("repeated passages", passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = store(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the language models nor the packing.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

"""The corpus pipeline: quality, near-duplicates, repeated passages, packing.

Every stage takes any table with doc_id and text (the first one lang as well); other columns pass through under their own
names until packing, n_chars follows the text where it is there, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, similar, substring
from tidemark.llm.common import session, settled, spare, tidy


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts stay (there is nothing to judge); a null language is judged by the pooled model; repeated rows are
    judged alike; texts are scored whole.
    """
    labels = session(spark).read.parquet(f"{sf_dir}/labels.parquet")
    columns = list(docs.columns)
    marked = quality.judge(docs.select("doc_id", "text", "lang", F.struct(*columns).alias(spare(docs, "_row"))), labels)
    return marked.where("kept").select(F.col(spare(docs, "_row") + ".*")).select(columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays.

    Candidates are what the SimHash index groups, and what MinHash bands find beyond its 4 bits; both are verified.

    Repeated rows, null ids and ties: as in ``similar.one_per_group``.  Texts without words are one group.
    """
    session(spark)
    return similar.one_per_group(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document of which nothing is left goes.

    Null and empty texts stay as they are, so do rows with a null id; rows that share an id never cut each other.
    """
    session(spark)
    row, key = spare(docs, "_row"), spare(docs, "_key")
    found = substring.remove_repeats(docs).where("n_removed > 0").dropDuplicates(["doc_id", "text_key"])
    cut = found.select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("hash")).alias(key), F.col("n_removed").alias("_gone"), F.col("n_words").alias("_all"), F.col("kept").cast("string").alias("_kept"))
    rows = docs.select(F.struct(*docs.columns).alias(row), F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash")).alias(key + "2"))
    out = rows.join(cut, F.col(key + "2") == F.col(key), "left").where("_gone is null or _gone < _all")
    text = F.coalesce("_kept", F.col(row)["text"])
    new = {"text": text, "n_chars": F.when(F.col("_gone").isNotNull(), F.length("_kept")).otherwise(F.col(row)["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*(new.get(c, F.col(row)[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids; null and empty texts give the end id alone."""
    session(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("substring", substring_stage), ("packing", packing_stage)]

#: The tokenizer's ids and the language model cannot be written in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

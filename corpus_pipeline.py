"""From raw documents to shards: the corpus operators one after the other.

Every stage works on all rows that the stage before has kept and returns the columns of `documents`,
the last one with the shard and slot of each row besides. Null texts are empty documents; rows without
doc_id are handled like others; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emporia.llm import decontamination, mixing, sharding, simhash, toxicity
from emporia.llm.common import documents, table
from emporia.llm.queries import held_out
from emporia.sources.store import work_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the rows in `docs`."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    model = toxicity.train(docs, labels)
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near duplicates stays: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeat or go as the mix of their source takes them."""
    return mixing.repeat_taken(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

# Learned scores, fingerprints and seeded draws have no SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

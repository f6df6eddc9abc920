"""The corpus pipeline: documents to shards, each stage written and read again.

Every stage keeps the columns, whatever further ones there are and whatever they
are called; an empty table gives none of its rows.  What the stages do with
nulls, empty and very long texts, ties and repeated rows is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, mix, neardup, shards, toxicity
from brindle.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, fitted on the labels, scores 0.5 or more.

    Null and empty texts have the score of the intercept, very long ones are
    scored whole, equal texts alike.  Without labels of both kinds all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are similar by 0.8 or more.

    The least doc_id stays.  Texts that are null or without words, and rows with
    a null doc_id, are linked with nothing and stay.  Equal rows leave one; rows
    that share a doc_id but not the text are judged one by one.
    """
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of any benchmark item.

    Null and empty texts hold none, very long ones are searched whole, repeated
    rows one by one.  Items without text or item_id have no windows.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in sources whose words come as near to their targets as documents allow.

    Texts without words take no words and stay once or as often as their source.
    Null sources are one source.  Ties of the order are broken by a number of
    the row, so rows that repeat a document are taken one by one.
    """
    return mix.take_mix(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, unchanged, as the compacted store holds them, with shard, shard_bytes and version (under unused names where a column is called so)."""
    return shards.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("shards", write_shards),
]

#: SQL has no fitted classifier, no connected components and no subset sums; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

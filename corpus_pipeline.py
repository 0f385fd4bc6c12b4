"""A training-data pipeline over the documents: five filtering and encoding stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet to the shared folder and reads it back as the
next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import _store, bpe, decontaminate, jaccard, langid, toxicity
from textloom.shipping import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal severity model calls toxic go; it is fitted on the labelled documents.

    Null and empty texts stay; repeated rows are judged alike; a score on the
    cut counts as toxic.  Without toxic or clean labels all rows stay.  All
    columns stay, whatever their names; an empty table stays empty.
    """
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, by calibrated rejection, go.

    Null texts and texts without letters or digits are in none and go; of
    languages as likely the first in the alphabet counts; repeated rows are
    judged alike.  Without any labelled language everything goes.  All columns
    stay, whatever their names; an empty table stays empty.
    """
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    The one of the least doc_id (null last); of rows that repeat it with an
    equal gram set one.  Null, empty and wordless texts are like nothing and
    stay.  All columns stay, whatever their names; an empty table stays empty.
    """
    ship(spark)
    return jaccard.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents mostly made of them go.

    Half of the words or more is mostly.  Null, empty and short texts, and
    those of the benchmark, match nothing; repeated rows are treated alike.
    All columns stay, whatever their names; an empty table or benchmark leaves
    the documents as they are.
    """
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids; each text is decoded again to check it.

    A null text has null ids, an empty one none; repeated rows repeat.  Only
    doc_id is carried on; an empty table gives an empty table.
    """
    ship(spark)
    return bpe.encode_documents(docs, bpe.Vocabulary.load(), check=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: Fitted models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

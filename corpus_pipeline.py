"""A corpus from `documents`: language, near duplicates, repeated passages, mix, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, further ones included, whatever their names. run() writes each stage's rows
into the session's shared folder and reads them again, so a lost executor costs one stage at most.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ids that several
rows share and an empty table (which gives an empty one); what it makes of them stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkreel.llm import blocks, jaccard, language, mixing, packing, substring_dedup

#: Sources are repeated at most so often in the mix; every document is read at least once.
REPETITIONS = 1.25


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without letters, or unlike any language, go.

    A null or empty text has no letters and goes. Repeated rows are judged alike; ties between
    languages go to the first by name and decide nothing here. Null ids and languages are no obstacle.
    """
    return language.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows that share an id are judged each by its own text, after documents with an id of their own;
    of repeated rows one stays. Documents with null or empty text are no one's duplicates, and rows
    with a null id stay.
    """
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that occurred before, by doc_id, text checksum and position.

    The first place of a passage keeps it, and texts keep their line breaks. No row goes: a text that
    was all repeats becomes empty. Null and empty texts stay as they are; repeated rows keep one copy
    of their passages between them.
    """
    return substring_dedup.rewritten(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources reads them, once at least.

    A null source is a source of its own. Null and empty texts count no tokens and are read with
    their block. Repeated rows are read each for itself; ties in the order go by id and text.
    """
    return mixing.mix(docs, repetitions=REPETITIONS).select(*[f"`{c}`" for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    A null or empty text is the one id that ends a document; repeated rows are documents of their own.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", sequences),
]

#: No stage but the mix can be written in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{blocks.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

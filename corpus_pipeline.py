"""A training-data pipeline over ``documents``: five stages, each one operator of ``meshtide.llm``.

Every stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row for each packed piece. A stage
first deletes what earlier stages wrote on their way, unless its input reads it.

Defined results: null text counts as empty everywhere; documents with a null id
pass every stage but exact dedup like others (of equal texts one row stays);
repeated rows are copies of each other; empty tables give an empty result, and
without labels of both kinds no document is taken for toxic unless all labelled ones are;
extra columns go along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshtide.llm import exact_dedup, mixing, packing, simhash, toxicity
from meshtide.session import sweep, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below its threshold; trained on the labels outside the held-out third."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id."""
    sweep(docs)
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id."""
    sweep(docs)
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    sweep(docs)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of 2048."""
    sweep(docs)
    return packing.histogram_packs(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_equal), ("simhash", drop_near), ("mixing", mix), ("packing", pack)]

#: A network's scores and fingerprints are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Defined results, for every stage: null and empty texts, null ids and repeated
rows are rows like others; a null or empty text is neither toxic, nor a near
duplicate, nor contaminated, has 0 tokens, and ends as a record of 0 ids. Texts
of any length are taken whole. Ties go to the row stored first (near
duplicates) or are taken together (mixing). An empty table gives empty stages.
All columns of ``documents``, whatever their names, pass through every stage but
the last; only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import decontaminate, minhash, mixing, token_binary, toxicity
from codestrata.llm.common import discard_but, give_back_heaps, save, saved_paths, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    """The stage, begun on executors that gave back what the stages before it left in their heaps."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the sources' token budgets; one drawn more than once is repeated."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compressed token ids, one record for each document."""
    return token_binary.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", rested(drop_near_duplicates)),
    ("decontamination", rested(drop_contaminated)),
    ("mixing", rested(mix_sources)),
    ("token binary", rested(encode)),
]
#: Models, fuzzy groups and compressed frames are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's records; what comes before it is saved in the shared folder, one stage's table at a time."""
    docs, before = table(spark, sf_dir, "documents"), saved_paths()
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard_but(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

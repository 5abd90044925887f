"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthgrid.llm.decontamination import drop_contaminated
from hearthgrid.llm.frames import corpus_session, documents, labels, materialize
from hearthgrid.llm.neardedup import drop_near_copies
from hearthgrid.llm.packing import pack
from hearthgrid.llm.quality import keep_good, train
from hearthgrid.llm.secrets import redact

#: Classifiers, fingerprints and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts are scored like any other; repeated rows share their fate. No rows give no rows, all columns stay.
    """
    corpus_session(spark)
    return keep_good(docs, train(docs, labels(spark, sf_dir)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Rows without a doc_id all stay; see ``drop_near_copies`` for null texts, repeated rows and ties.
    """
    corpus_session(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go.

    Null and empty texts contain none and stay, as repeated rows do; without items or rows nothing changes.
    """
    return drop_contaminated(docs, corpus_session(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out.

    No row goes: null and empty texts stay as they are, repeated rows are treated alike. No rows give no rows.
    """
    corpus_session(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; one row per piece, with its ids.

    Null and empty texts are their end mark alone; repeated rows are packed each. No rows give no pieces.
    """
    corpus_session(spark)
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written to the shared folder and read by the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

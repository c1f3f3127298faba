"""Corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltlog.llm import decontaminate, mixing, neardup, quality, sharding
from siltlog.llm.registry import query, table
from siltlog.session import materialize, working_path

SHARDS = 40


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality posterior does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicated(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by its shards and shuffled inside them."""
    return mixing.mixed_rows(docs)


def _stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a place in a file; else a written copy."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return materialize(docs, "unsharded")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot.

    The old shards are runs of the files the mix wrote, which hold its output shards
    in order: the tree's layout stays wherever sizes allow. Copies of a document
    count as different rows by their place in the files, so they do not stand next
    to each other.
    """
    docs = _stored(docs)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int")
    files = docs.select(part.alias("part")).agg(F.max("part")).head()[0]
    old = F.floor(part * SHARDS / F.lit((files or 0) + 1)).cast("int")
    key = ("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    return sharding.reshard(docs, SHARDS, old, key=key)


STAGES = [
    ("quality classifier", good),
    ("near duplicates", unlike),
    ("benchmark decontamination", unseen),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = working_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline")(run)

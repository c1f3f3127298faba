"""Escalation chains: the lead-in rows before a failure when they hold a warning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltlog.operators.order import (
    BLOCK_ROWS,
    any_range,
    dense_index,
    halo_frame,
    own_block,
    with_halo,
)
from siltlog.schema import CHAIN_LENGTH, MAX_CHAINS, is_failure, is_lead_in


def escalations(logs: DataFrame, key: str = "fingerprint", rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per failure whose last five lead-in rows since the previous failure hold a warning.

    Lead-in rows and failures are numbered densely, so the chain of a failure
    lies in the five numbers before it and is cut at the failure before. Only
    narrow columns move and no stretch between failures is gathered, however
    long it is. ``preceding`` holds the positions, oldest first.
    """
    level = F.col("level")
    relevant = logs.select("pos", "level", F.col(key).alias("chain_key")).where(
        is_lead_in(level) | is_failure(level)
    )
    ranked = dense_index(relevant, "rank", rows=rows)
    entry = F.struct("pos", F.when(is_failure(level), "failure").otherwise(level).alias("kind"))
    tail = F.collect_list(entry).over(halo_frame(CHAIN_LENGTH, -1, "rank"))
    cut = F.array_max(
        F.transform(F.filter("tail", lambda e: e["kind"] == "failure"), lambda e: e["pos"])
    )
    return (
        with_halo(ranked, CHAIN_LENGTH, 0, on="rank", rows=rows)
        .withColumn("tail", tail)
        .where(own_block("rank", rows) & is_failure(level))
        .withColumn("_cut", F.coalesce(cut, F.lit(-1)))
        .withColumn("lead", F.filter("tail", lambda e: e["pos"] > F.col("_cut")))
        .where(F.exists("lead", lambda e: e["kind"] == "warn"))
        .select("pos", "chain_key", F.transform("lead", lambda e: e["pos"]).alias("preceding"))
    )


def distinct_chains(chains: DataFrame) -> DataFrame:
    """First chain and number of chains per failure pattern."""
    return chains.groupBy("chain_key").agg(
        F.count("*").alias("chain_count"),
        F.min("pos").alias("pos"),
        F.min_by("preceding", "pos").alias("preceding"),
    )


def first_chains(chains: DataFrame, limit: int = MAX_CHAINS) -> DataFrame:
    return distinct_chains(chains).orderBy("pos").limit(limit)


def chain_rows(logs: DataFrame, limit: int = MAX_CHAINS) -> DataFrame:
    """The first chains as rows: ``chain_no``, ``step`` and the log row; the failure is last.

    At most ``limit`` chains of six positions reach the driver; the rows are
    then read by position.
    """
    found = first_chains(escalations(logs), limit).collect()
    steps = [
        (no, chain["chain_count"], chain["chain_key"], step, pos)
        for no, chain in enumerate(found)
        for step, pos in enumerate([*chain["preceding"], chain["pos"]])
    ]
    local = logs.sparkSession.createDataFrame(
        steps, "chain_no int, chain_count long, chain_key string, step int, pos long"
    )
    rows = logs.select("pos", "id", "ts", "level", "message", "fingerprint")
    wanted = rows.where(any_range("pos", [(s[-1], s[-1]) for s in steps]))
    return wanted.join(F.broadcast(local), "pos").withColumn("is_error", is_failure(F.col("level")))

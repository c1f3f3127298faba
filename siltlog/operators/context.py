"""Rows around other rows: windows, error context, narratives and context groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.operators.order import (
    BLOCK_ROWS,
    any_range,
    dense_index,
    halo_frame,
    halo_range,
    own_block,
    with_halo,
)
from siltlog.operators.sampling import systematic_sample
from siltlog.operators.select import by_ids, failures, is_error_flag
from siltlog.functions.text import contains_all
from siltlog.schema import (
    CONTEXT_ROWS,
    NARRATIVE_AFTER,
    NARRATIVE_BEFORE,
    NARRATIVE_WINDOWS,
    is_problem,
)
from siltlog.session import broadcast_if_small

FEW_POSITIONS = 1_000_000


def window_positions(centres: DataFrame, before: int, after: int, centre: str = "pos") -> DataFrame:
    """Each centre's positions as ``at``; positions past the end match no row later."""
    start = F.greatest(F.col(centre) - before, F.lit(0))
    return centres.withColumn("at", F.explode(F.sequence(start, F.col(centre) + after)))


def neighbours(logs: DataFrame, centres: DataFrame, k: int = CONTEXT_ROWS) -> DataFrame:
    """Rows within ``k`` of each centre: ``centre``, ``offset`` and the row. An equi-join."""
    wanted = window_positions(centres.select(F.col("pos").alias("centre")), k, k, "centre")
    wanted = broadcast_if_small(wanted, FEW_POSITIONS)
    return wanted.join(logs, wanted.at == logs.pos).select(
        "centre", (F.col("pos") - F.col("centre")).alias("offset"), *logs.columns
    )


def windows_at(logs: DataFrame, centres: Sequence[int], before: int, after: int) -> DataFrame:
    """Windows around a handful of known positions; the scan reads only their row groups."""
    spans = [(max(c - before, 0), c + after) for c in centres]
    local = logs.sparkSession.createDataFrame([(c,) for c in centres], "centre long")
    wanted = window_positions(local, before, after, "centre")
    return logs.where(any_range("pos", spans)).join(F.broadcast(wanted), F.col("pos") == F.col("at")).drop("at")


def rows_near(
    logs: DataFrame,
    flag: Column,
    k: int = CONTEXT_ROWS,
    few: int = FEW_POSITIONS,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows within ``k`` positions of a flagged row, each once.

    At most ``few`` positions (flagged rows counted first, times the width of a
    window): they are broadcast and the table is only scanned. Otherwise one
    shuffle by position block with a halo.
    """
    centres = logs.where(flag).select("pos")
    most = few // (2 * k + 1)
    if centres.limit(most + 1).count() <= most:
        wanted = window_positions(centres, k, k).select(F.col("at").alias("pos")).distinct()
        return logs.join(F.broadcast(wanted), "pos", "left_semi")
    near = F.max(flag).over(halo_frame(k, k))
    return (
        with_halo(logs, k, k, rows=rows)
        .withColumn("_near", near)
        .where(own_block(rows=rows) & F.col("_near"))
        .drop("_halo", "_near")
    )


def error_context(logs: DataFrame, k: int = CONTEXT_ROWS, few: int = FEW_POSITIONS) -> DataFrame:
    """Problem rows with ``k`` rows on each side and an ``is_error`` flag."""
    near = rows_near(logs, is_problem(F.col("level")), k, few)
    return near.withColumn("is_error", is_error_flag())


def search_context(logs: DataFrame, query: str, k: int = CONTEXT_ROWS) -> DataFrame:
    """Rows around search hits; around all problem rows when nothing matches."""
    hit = contains_all(F.col("raw"), query)
    if logs.where(hit).isEmpty():
        hit = is_problem(F.col("level"))
    return rows_near(logs, hit, k)


def context_windows(logs: DataFrame, k: int = CONTEXT_ROWS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Merged error windows as ``window_start``, ``window_end`` positions.

    Two problem rows share a window when they are at most 2k+1 apart. Starts and
    ends are found locally and paired by their index.
    """
    reach = 2 * k + 1
    marked = (
        with_halo(logs.where(is_problem(F.col("level"))).select("pos"), reach, reach, rows=rows)
        .withColumn("_behind", F.count("*").over(halo_range(reach, -1)))
        .withColumn("_ahead", F.count("*").over(halo_range(-1, reach)))
        .where(own_block(rows=rows))
    )
    last_pos = logs.agg(F.max("pos")).scalar()
    starts = dense_index(marked.where("_behind = 0").select("pos"), "window_id", rows=rows)
    ends = dense_index(marked.where("_ahead = 0").select("pos"), "window_id", rows=rows)
    return starts.select(
        "window_id", F.greatest(F.col("pos") - k, F.lit(0)).alias("window_start")
    ).join(
        ends.select("window_id", F.least(F.col("pos") + k, last_pos).alias("window_end")), "window_id"
    )


def frame_counts(logs: DataFrame, k: int = CONTEXT_ROWS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows and problem rows in the frame of ``k`` rows on each side of every row."""
    frame = halo_frame(k, k)
    return (
        with_halo(logs.select("pos", "level"), k, k, rows=rows)
        .withColumn("frame_rows", F.count("*").over(frame))
        .withColumn("frame_problems", F.count_if(is_problem(F.col("level"))).over(frame))
        .where(own_block(rows=rows))
        .drop("_halo")
    )


def pattern_context(logs: DataFrame, patterns: DataFrame, k: int = CONTEXT_ROWS) -> DataFrame:
    """Rows around each pattern's first row, each once per ``batch_id``."""
    wanted = (
        window_positions(patterns.select("batch_id", "pos"), k, k)
        .select("batch_id", "at")
        .distinct()
    )
    wanted = broadcast_if_small(wanted, FEW_POSITIONS)
    return wanted.join(logs, wanted.at == logs.pos).drop("at")


def requested_context(logs: DataFrame, ids: Sequence[str], k: int = CONTEXT_ROWS) -> DataFrame:
    """Rows around requested ids, first request first (``context_ord``), each once."""
    centres = by_ids(logs.select("id", "pos"), ids)
    # A row reached from several requests belongs to the earliest of them.
    wanted = window_positions(centres, k, k).groupBy("at").agg(F.min("request_ord").alias("request_ord"))
    rows = wanted.join(logs, wanted.at == logs.pos).drop("at")
    order = Window.orderBy("request_ord", "pos")  # bounded by the caller's own list
    return rows.withColumn("context_ord", F.row_number().over(order) - 1)


def narrative(logs: DataFrame) -> DataFrame:
    """Up to six evenly spaced failures with three rows before and two after."""
    picked = systematic_sample(failures(logs.select("pos", "level", "ts")), NARRATIVE_WINDOWS)
    centres = sorted(row["pos"] for row in picked.select("pos").collect())  # at most six
    rows = windows_at(
        logs.select("pos", "ts", "level", "message"), centres, NARRATIVE_BEFORE, NARRATIVE_AFTER
    )
    numbered = logs.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(centres)], "centre long, window_id long"
    )
    return rows.join(F.broadcast(numbered), "centre").select(
        "window_id",
        "centre",
        (F.col("pos") - F.col("centre")).alias("offset"),
        "pos",
        "ts",
        "level",
        "message",
        (F.col("pos") == F.col("centre")).alias("is_error"),
    )


def context_groups(context: DataFrame, by: Sequence[str] = (), keep_ids: int = 5) -> DataFrame:
    """Context rows per fingerprint: count, first row, first and last time, first ids.

    The first few rows of a group are a rank filter, which keeps no more than
    that per group and task before anything is shuffled; all else is aggregates.
    """
    key = [*by, "fingerprint"]
    totals = context.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.min_by("ts", "pos").alias("first_ts"),
        F.max_by("ts", "pos").alias("last_ts"),
    )
    member = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    heads = (
        context.select(*key, "pos", "id", "level", "message")
        .withColumn("member", member)
        .where(F.col("member") <= keep_ids)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("member", "pos", "id", "level", "message"))).alias("_head"))
    )
    first = F.col("_head")[0]
    return heads.select(
        *key,
        first["pos"].alias("pos"),
        first["level"].alias("level"),
        first["message"].alias("message"),
        F.transform("_head", lambda x: x["id"]).alias("ids"),
    ).join(totals, key)

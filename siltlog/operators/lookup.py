"""Lookups and statistics of a store from the tables kept next to it.

The results are those of the operators that read the log table; what is read is a
few row groups of a narrow table and then the row groups of the positions found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siltlog.functions.text import keywords
from siltlog.functions.times import hour_start
from siltlog.operators import context, select
from siltlog.operators.order import any_range
from siltlog.schema import CONTEXT_ROWS
from siltlog.session import materialize
from siltlog.sources.kept import BLOCK
from siltlog.sources.store import LogStore

# As many values as may stand in a filter; longer lists are joined with the log table.
MOST_LISTED = 5_000
_ID = re.compile(r"log_(\d{5}|[1-9]\d{5,17})")


def line_of(log_id: str) -> int | None:
    """The line number an id stands for; None if no line can have it."""
    found = _ID.fullmatch(log_id)
    return int(found[1]) if found else None


def positions(store: LogStore, ids: Sequence[str]) -> dict[str, int]:
    """Where the rows of at most ``MOST_LISTED`` ids are; unknown ids are left out."""
    lines = {line: x for x in ids if (line := line_of(x)) is not None}
    if not lines:
        return {}
    found = store.kept("lines").where(F.col("line_number").isin(sorted(lines))).select("line_number", "pos").collect()
    return {lines[r["line_number"]]: r["pos"] for r in found}


def by_ids(store: LogStore, ids: Sequence[str]) -> DataFrame:
    """:func:`siltlog.operators.select.by_ids` through the line index."""
    if len(set(ids)) > MOST_LISTED:
        return select.by_ids(store.logs, ids)
    at = positions(store, ids)
    rows = store.logs.where(any_range("pos", [(p, p) for p in at.values()]))
    return rows.join(F.broadcast(select.requested(rows, ids)), "id")  # the caller's own list


def requested_context(store: LogStore, ids: Sequence[str], k: int = CONTEXT_ROWS) -> DataFrame:
    """:func:`siltlog.operators.context.requested_context` through the line index."""
    if len(set(ids)) > MOST_LISTED:
        return context.requested_context(store.logs, ids, k)
    at = positions(store, ids)
    near = store.logs.where(any_range("pos", [(max(p - k, 0), p + k) for p in at.values()]))
    return context.requested_context(near, ids, k)


def by_fingerprints(store: LogStore, fingerprints: Sequence[str]) -> DataFrame:
    """All rows of a few patterns; only blocks that hold one of them are read.

    If the blocks make more than ``MOST_LISTED`` runs, the pattern is nearly everywhere
    and the table is scanned.
    """
    wanted = sorted(set(fingerprints))
    match = F.col("fingerprint").isin(wanted)
    if len(wanted) > MOST_LISTED:
        return select.by_fingerprints(store.logs, store.patterns.join(store.spark.createDataFrame([(f,) for f in wanted], "fingerprint string"), "fingerprint"))
    held = store.kept("blocks").where(match).select(F.explode_outer("blocks").alias("block")).distinct()
    return _in_blocks(store, held).where(match)


def _in_blocks(store: LogStore, held: DataFrame) -> DataFrame:
    """The log rows of some blocks, by literal positions; all rows if the blocks make more
    than ``MOST_LISTED`` runs."""
    # A run starts at a block without the one before it; only its ends reach the driver.
    before, after = held.select((F.col("block") + 1).alias("block")), held.select((F.col("block") - 1).alias("block"))
    starts = held.join(before, "block", "left_anti")
    if starts.limit(MOST_LISTED + 1).count() > MOST_LISTED:
        return store.logs
    ends = held.join(after, "block", "left_anti")
    low, high = (sorted(r["block"] for r in edge.collect()) for edge in (starts, ends))
    spans = [(a * BLOCK, b * BLOCK + BLOCK - 1) for a, b in zip(low, high, strict=True)]
    return store.logs.where(any_range("pos", spans))


def blocks_with(store: LogStore, query: str) -> DataFrame | None:
    """``block``: those that hold every three characters of the query's words; None if no
    word is that long. The lists of all are intersected by counting them."""
    wanted = sorted({w[i : i + 3] for w in keywords(query) for i in range(len(w) - 2)})
    if not wanted:
        return None
    listed = store.kept("trigrams").where(F.col("trigram").isin(wanted)).select("trigram", F.explode_outer("blocks").alias("block"))
    # A block over midnight has lists of two days.
    return listed.distinct().groupBy("block").count().where(F.col("count") == len(wanted)).select("block")


def search(store: LogStore, query: str) -> DataFrame:
    """:func:`siltlog.operators.select.search` over the blocks that may hold every word.

    Words of one or two characters are looked for in those blocks only; if there is
    no longer one, the table is scanned.
    """
    blocks = blocks_with(store, query)
    rows = store.logs if blocks is None else _in_blocks(store, materialize(blocks, "search-blocks"))
    return select.search(rows, query)


def count_by_level(store: LogStore) -> DataFrame:
    return store.kept("cube").groupBy("level").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def time_range(store: LogStore) -> DataFrame:
    return store.kept("cube").agg(F.min("first_ts").alias("range_start"), F.max("last_ts").alias("range_end"))


def time_buckets(store: LogStore) -> DataFrame:
    """Rows per quarter of an hour; undated rows are left out."""
    return store.kept("cube").where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))


def hourly_buckets(store: LogStore) -> DataFrame:
    dated = store.kept("cube").where("bucket IS NOT NULL")
    return dated.groupBy(hour_start(F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n"))


def about_unique_patterns(store: LogStore, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct fingerprints of whole days ``start`` to ``end`` (all by default), from merged
    sketches; the standard error is 1.6 %."""
    cube = store.kept("cube")
    cube = cube if start is None else cube.where(F.col("log_date") >= start)
    cube = cube if end is None else cube.where(F.col("log_date") <= end)
    return cube.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("unique_patterns"))


def store_stats(store: LogStore) -> DataFrame:
    """:func:`siltlog.operators.stats.store_stats` from the cube."""
    totals = store.kept("cube").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"),
        F.min("first_ts").alias("range_start"),
        F.max("last_ts").alias("range_end"),
        F.count_distinct("level").alias("levels"),
        F.count_distinct("bucket").alias("time_windows"),
        F.count_distinct(hour_start(F.col("bucket"))).alias("hourly_buckets"),
        F.lit(0).cast("long").alias("parse_errors"),
    )
    return totals.withColumn("unique_patterns", store.patterns.agg(F.count("*")).scalar())

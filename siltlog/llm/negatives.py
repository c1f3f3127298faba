"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best-scored rows of the same label. Each positive
opens a window of scores, from a share of its own score up to it, and wants the best
rows of other labels inside. The windows of one anchor overlap, so they aren't
searched one by one: the positives' upper limits cut the scores into disjoint slots,
every candidate falls into one slot, and each task keeps the few best of a slot. Once
the slots of all tasks are combined, merging them from the lowest slot upwards gives
for each limit the best rows below it; a window takes its share of that list.

Anchors and rows meet in cells: a block of anchors with a shard of rows, both of
bounded size, brought together by a shuffle. Positives are looked for in shards of
the anchor's own label only; a label is cut into as many shards as its rows need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.llm.words import bounded_batches
from siltlog.session import broadcast_if_small, materialize

LEAST_ROWS, MOST_ROWS = 4096, 65536  # of a shard
ANCHORS_TOGETHER = 4096
SCORES_AT_ONCE = 4 << 20
BROADCAST_ROWS = 100_000

_SCORED = "anchor_key long, slot int, vec_id long, key long, score long"


def shard_rows(rows: int) -> int:
    """Rows of a shard: enough shards to share out a small table, large ones to move less of a large one."""
    return min(MOST_ROWS, max(LEAST_ROWS, rows // 64))


def slots(scores: np.ndarray, limits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and slot of each score that some window could want.

    ``limits`` holds each row's upper limits, highest first, filled up with -inf. A
    score belongs to the lowest limit that it doesn't exceed; below that limit's own
    share it is below every higher limit's share as well.
    """
    row, column = np.nonzero(scores <= limits[:, :1])
    score = scores[row, column]
    fine = score > -np.inf
    row, column, score = row[fine], column[fine], score[fine]
    slot = (limits[row] >= score[:, None]).sum(axis=1) - 1
    wanted = 100 * score >= percent * limits[row, slot]
    return row[wanted], column[wanted], slot[wanted]


def best_of_slots(row, slot, score, ids, keys, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row's slot: highest score, then smallest id."""
    order = np.lexsort((keys, ids, -score, slot, row))
    group = np.stack([row[order], slot[order]])
    new = np.ones(len(order), dtype=bool)
    new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _cell(k: int, percent: int | None):
    """Scores of one cell: of rows of the anchor's label in one slot, or with
    ``percent`` of other rows in the slots of the anchor's limits."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            dim = anchors.column("dim")[0].as_py()
            a, points = _matrix(anchors, "v", dim), _matrix(rows, "v", dim)
            a_key, a_label = _numbers(anchors, "anchor_key"), _numbers(anchors, "label")
            ids, keys, labels = _numbers(rows, "vec_id"), _numbers(rows, "key"), _numbers(rows, "label")
            limits = np.full((len(a), 1), np.inf) if percent is None else _matrix(anchors, "limits", k)
            step = max(1, SCORES_AT_ONCE // len(points))
            for first in range(0, len(a), step):
                part = slice(first, first + step)
                scores = a[part] @ points.T
                same = a_label[part, None] == labels[None, :]
                if percent is None:
                    scores[~same | (a_key[part, None] == keys[None, :])] = -np.inf
                    row, column = np.nonzero(scores > -np.inf)
                    slot = np.zeros(len(row), dtype=np.int64)
                    if len(points) > k:  # nothing below the k-th score of a row is wanted
                        kth = np.partition(scores, len(points) - k, axis=1)[:, len(points) - k]
                        near = scores[row, column] >= kth[row]
                        row, column, slot = row[near], column[near], slot[near]
                else:
                    scores[same] = -np.inf
                    row, column, slot = slots(scores, limits[part], percent)
                score = scores[row, column]
                best = best_of_slots(row, slot, score, ids[column], keys[column], k)
                row, column, slot, score = row[best], column[best], slot[best], score[best]
                found.append((a_key[part][row], slot.astype(np.int32), ids[column], keys[column], score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, t) for t in ("i8", "i4", "i8", "i8", "i8")]
        return pa.table(dict(zip(("anchor_key", "slot", "vec_id", "key", "score"), map(pa.array, columns))))

    return run


def usable(vectors: DataFrame, scale: int, id_col: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, v, dim, key``: components as floor(scale * x), repeated rows once."""
    x = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), x.alias("x"))
    kept = kept.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    whole = F.transform("x", lambda e: F.floor(scale * e).cast("double"))
    named = kept.select("vec_id", "label", whole.alias("v"), F.size("x").alias("dim"))
    return named.withColumn("key", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["vec_id", "key"])


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every anchor and slot; tasks drop the others before the shuffle."""
    order = Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), "vec_id", "key")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _positives(rows: DataFrame, anchors: DataFrame, most: int, k: int) -> DataFrame:
    """``anchor_key, positives``: array of ``score, vec_id`` of at most ``k`` rows of the label, best first.

    Labels are pooled by a hash; a pool is cut into parts of about ``most`` rows.
    """
    held = rows.groupBy("dim", "pool").agg(F.count("*").alias("held"))
    parts = F.ceil(F.col("held") / most).cast("int")
    pools = broadcast_if_small(materialize(held.select("dim", "pool", parts.alias("parts")), "pools"), BROADCAST_ROWS)
    cell = ["dim", "pool", "part", "block"]
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    n_blocks = anchors.groupBy("dim", "pool").agg(F.ceil(F.count("*") / ANCHORS_TOGETHER).cast("int").alias("blocks"))
    pools = pools.join(broadcast_if_small(materialize(n_blocks, "anchor-pools"), BROADCAST_ROWS), ["dim", "pool"])
    left = anchors.join(pools, ["dim", "pool"]).select(
        "dim", "pool", block.cast("int").alias("block"), F.col("key").alias("anchor_key"), "label", "v",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    right = rows.join(pools, ["dim", "pool"]).select(
        "dim", "pool", F.pmod("key", "parts").cast("int").alias("part"), "vec_id", "key", "label", "v",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k, None), _SCORED)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "key")))
    listed = _best(scored, k).groupBy("anchor_key").agg(listed.alias("listed"))
    return listed.select(
        "anchor_key", F.transform("listed", lambda p: F.struct((-p["minus"]).alias("score"), p["vec_id"].alias("vec_id"))).alias("positives")
    )


def _candidates(rows: DataFrame, anchors: DataFrame, sizes: dict[int, int], k: int, percent: int) -> DataFrame:
    """``anchor_key, slot, vec_id, key, score``: the ``k`` best rows of other labels in each slot."""
    spark = rows.sparkSession
    asked = {r["dim"]: r["n"] for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    counts = [(d, -(-n // shard_rows(n)), -(-asked[d] // ANCHORS_TOGETHER)) for d, n in sizes.items() if d in asked]
    counts = F.broadcast(spark.createDataFrame(counts, "dim int, shards int, blocks int"))  # one row per vector length
    cell = ["dim", "shard", "block"]
    left = anchors.join(counts, "dim").select(
        "dim", F.pmod(F.xxhash64("anchor_key"), "blocks").cast("int").alias("block"), "anchor_key", "label", "v", "limits",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    right = rows.join(counts, "dim").select(
        "dim", F.pmod("key", "shards").cast("int").alias("shard"), "vec_id", "key", "label", "v",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    return _best(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k, percent), _SCORED), k)


def suffix_merges(in_slots: Column, k: int, n: int) -> Column:
    """For each limit from the highest to the lowest the ``k`` best candidates that don't exceed it.

    ``in_slots`` lists ``slot, minus, vec_id, key`` in ascending order. Slots are disjoint,
    so a slot's candidates followed by the best below it are in order already. The
    last list is empty: nothing lies below the lowest slot.
    """
    none = F.array(F.filter(in_slots, lambda c: F.lit(False)))

    def merge(lists: Column, slot: Column) -> Column:
        own = F.filter(in_slots, lambda c: c["slot"] == slot)
        return F.concat(F.array(F.slice(F.concat(own, F.element_at(lists, 1)), 1, k)), lists)

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), none, merge)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    k: int = 5,
    percent: int = 80,
    scale: int = 256,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row with ``is_anchor`` its ``k`` best other rows of its label are the
    positives (all, if fewer); each gets the ``k`` best rows of other labels whose
    score lies between ``percent`` of the positive's and the positive's. Scores are inner
    products of floor(scale * x), exact up to 2**53; ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part; labels are integers. Vectors meet those of their own length. A repeated row
    counts once; rows that repeat an id with another vector or label are rows of their
    own. Other columns are ignored. A positive without negatives gives no row.
    """
    bounded_batches(vectors.sparkSession)
    rows = materialize(usable(vectors, scale, id_col, vector, label), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = shard_rows(sum(sizes.values()))
    n_pools = max(1, sum(sizes.values()) // most)
    rows = rows.withColumn("pool", F.pmod(F.xxhash64("label"), F.lit(n_pools)).cast("int"))
    anchors = rows.withColumnRenamed("vec_id", id_col).where(is_anchor).withColumnRenamed(id_col, "vec_id")
    anchors = materialize(anchors, "anchors")
    positives = materialize(_positives(rows, anchors, most, k), "positives")
    score_of = F.transform("positives", lambda p: p["score"].cast("double"))
    limits = F.concat(score_of, F.array_repeat(F.lit(float("-inf")), F.lit(k) - F.size("positives")))
    limited = anchors.withColumnRenamed("key", "anchor_key").join(positives.select("anchor_key", limits.alias("limits")), "anchor_key")
    found = _candidates(rows, limited, sizes, k, percent)
    in_slots = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "vec_id", "key")))
    merged = found.groupBy("anchor_key").agg(in_slots.alias("in_slots")).withColumn("merged", suffix_merges(F.col("in_slots"), k, k))
    named = anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"))
    windows = merged.join(positives, "anchor_key").join(named, "anchor_key").select(
        "anchor_id", "merged", F.posexplode("positives").alias("at", "positive")
    )
    inside = F.filter(F.element_at("merged", F.col("at") + 1), lambda c: -100 * c["minus"] >= percent * F.col("positive.score"))
    return windows.select("anchor_id", "positive", F.posexplode(inside).alias("place", "negative")).select(
        "anchor_id",
        F.col("positive.vec_id").alias("positive_id"),
        (F.col("place") + 1).alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        (-F.col("negative.minus")).alias("negative_score"),
    )

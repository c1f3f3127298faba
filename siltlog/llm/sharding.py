"""Resharding by minimum-cost flow.

Rows sit in old shards of uneven size and are to fill new shards of given
capacities. Old shards are cut into blocks by a hash of the row; a flow from old
sizes to new capacities, where a byte that stays costs nothing and a byte that
moves costs one, says how many bytes go where; whole blocks carry it out. Only
files of shards that gain or lose a block are written again.

The driver sees one row per old shard and at most ``shards * blocks_per_shard``
plus one block per old shard, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siltlog.llm.rows import pack, unpack
from siltlog.session import materialize

BLOCKS_PER_SHARD = 256
ROW_OVERHEAD = 16
NO_SHARD = -1
FILE_BYTES = 128 << 20


def min_cost_flow(sizes: Sequence[int], capacities: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes to send from each old to each new shard at the least total cost.

    ``cost[i, j]`` is the price of a byte from ``i`` to ``j``; without it, bytes
    that stay under their number are free and all others cost one. Successive
    shortest paths, so that each augmentation keeps the flow optimal. The
    capacities must hold all bytes.
    """
    m, n = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities are smaller than the data")
    if cost is None:
        cost = 1 - np.eye(m, n, dtype=np.int64)
    nodes, source, sink = m + n + 2, m + n, m + n + 1
    room = np.zeros((nodes, nodes), dtype=np.int64)
    price = np.zeros((nodes, nodes), dtype=np.int64)
    room[source, :m], room[m : m + n, sink] = sizes, capacities
    room[:m, m : m + n] = sum(sizes)
    price[:m, m : m + n], price[m : m + n, :m] = cost, -cost.T
    far = np.iinfo(np.int64).max // 4
    while room[source].any():
        dist = np.full(nodes, far)
        dist[source] = 0
        before = np.full(nodes, -1)
        while True:
            reach = np.where((room > 0) & (dist < far)[:, None], dist[:, None] + price, far)
            best = reach.argmin(axis=0)
            value = reach[best, np.arange(nodes)]
            closer = value < dist
            if not closer.any():
                break
            dist[closer], before[closer] = value[closer], best[closer]
        path = [sink]
        while path[-1] != source:
            path.append(int(before[path[-1]]))
        steps = list(zip(path[1:], path[:-1], strict=True))
        amount = min(int(room[u, v]) for u, v in steps)
        for u, v in steps:
            room[u, v] -= amount
            room[v, u] += amount
    return room[m : m + n, :m].T.copy()


def place_blocks(blocks: Sequence[tuple[int, int, int]], flow: dict[tuple[int, int], int], capacities: Sequence[int]):
    """Carry a flow out with whole blocks ``(old shard, block, bytes)``.

    Largest blocks first, each to the new shard its old shard still owes most.
    Rounding then leaves some shards over and some under by less than a few
    blocks; blocks go from the fullest to the emptiest while that makes the
    larger of both errors smaller. Returns the new shard of each block.
    """
    owed: dict[int, dict[int, int]] = {}
    for (i, j), amount in flow.items():
        owed.setdefault(i, {})[j] = amount
    over = [-c for c in capacities]
    placed: dict[tuple[int, int], int] = {}
    inside: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    for i, b, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        to = max(owed.get(i) or {i: 0}, key=lambda j: (owed.get(i, {}).get(j, 0), j == i, -j))
        to = to if 0 <= to < len(capacities) else 0
        owed.setdefault(i, {})[to] = owed.get(i, {}).get(to, 0) - size
        placed[i, b] = to
        over[to] += size
        inside[to].append((size, i, b))
    for _ in range(len(blocks)):
        full, empty = int(np.argmax(over)), int(np.argmin(over))
        worst = max(over[full], -over[empty])
        fits = [x for x in inside[full] if max(abs(over[full] - x[0]), abs(over[empty] + x[0])) < worst and x[0]]
        if not fits:
            break
        half = (over[full] - over[empty]) / 2
        x = min(fits, key=lambda x: (abs(x[0] - half), x))
        inside[full].remove(x)
        inside[empty].append(x)
        over[full] -= x[0]
        over[empty] += x[0]
        placed[x[1], x[2]] = empty
    return placed


@dataclass(frozen=True)
class Plan:
    """Where each block goes: ``blocks`` has ``old_shard, block, shard, slot_base``
    and one row per block; ``cuts`` the number of blocks of each old shard."""

    blocks: DataFrame
    cuts: DataFrame
    capacities: tuple[int, ...]
    moved_bytes: int
    least_moved_bytes: int
    affected: tuple[int, ...]


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text and a fixed overhead per row; null has no bytes."""
    return F.octet_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).cast("long") + ROW_OVERHEAD


def _keyed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add the block of each row. ``cuts`` has one row per old shard."""
    return rows.join(F.broadcast(cuts), "old_shard").withColumn("block", F.pmod("key", "n_blocks").cast("int"))


def plan_moves(
    rows: DataFrame, n_shards: int, capacities: Sequence[int] | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD
) -> Plan:
    """Solve the moves for ``rows`` of ``old_shard int, key long, size long``.

    Without ``capacities`` all new shards are to hold the same bytes. Blocks are
    of the same expected size in every old shard, so a hot old shard is cut into
    as many more of them. An empty table gives an empty plan.
    """
    spark = rows.sparkSession
    old = {r[0]: int(r[1]) for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    total = sum(old.values())
    if capacities is None:
        capacities = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    target = max(1, total // (n_shards * blocks_per_shard))
    cuts = spark.createDataFrame([(i, -(-s // target) or 1) for i, s in sorted(old.items())], "old_shard int, n_blocks int")
    sums = _keyed(rows, cuts).groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    blocks = sorted(tuple(r) for r in sums.collect())
    ids = sorted(old)
    cost = np.array([[0 if i == j else 1 for j in range(n_shards)] for i in ids], dtype=np.int64).reshape(len(ids), n_shards)
    solved = min_cost_flow([old[i] for i in ids], capacities, cost)
    flow = {(i, j): int(solved[k, j]) for k, i in enumerate(ids) for j in range(n_shards) if solved[k, j]}
    placed = place_blocks([b[:3] for b in blocks], flow, capacities)
    base, out, moved, touched = [0] * n_shards, [], 0, set()
    for i, b, size, n in blocks:
        to = placed[i, b]
        out.append((i, b, to, base[to]))
        base[to] += n
        if to != i:
            moved += size
            touched |= {i, to}
    return Plan(
        spark.createDataFrame(out, "old_shard int, block int, shard int, slot_base long"),
        cuts,
        tuple(capacities),
        moved,
        int((solved * cost).sum()),
        tuple(sorted(touched - {NO_SHARD})),
    )


def apply_plan(rows: DataFrame, plan: Plan, order: Sequence[str] = ("key",)) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have ``old_shard`` and ``key``.

    The plan is bounded by its number of blocks, so it is broadcast. Slots are a
    block's base plus the row's place in its block, so no window sees more than
    one block.
    """
    in_block = Window.partitionBy("old_shard", "block").orderBy(*order)
    return (
        _keyed(rows, plan.cuts)
        .join(F.broadcast(plan.blocks), ["old_shard", "block"])
        .withColumn("slot", F.col("slot_base") + F.row_number().over(in_block) - 1)
        .drop("n_blocks", "slot_base")
    )


def reshard(
    docs: DataFrame,
    n_shards: int,
    old_shard: Column,
    key: Sequence[str | Column] = ("doc_id", "text"),
    text: str = "text",
    capacities: Sequence[int] | None = None,
    blocks_per_shard: int = BLOCKS_PER_SHARD,
) -> DataFrame:
    """``docs`` with ``shard int``, ``slot long`` and ``old_shard int``.

    Law ``bytes``: shards are nearly equal in bytes, the fewest bytes move that
    whole blocks allow, and slots run from 0 without gaps. Null texts count as
    empty, a null old shard as data that is nowhere yet; equal rows go to the
    same block, in any order between them. Input columns named like an added one
    come back as ``input_<name>``. No rows give no rows.
    """
    rows = pack(
        docs,
        old_shard=F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD)),
        key=F.xxhash64(*key),
        size=text_bytes(text),
    )
    sizes = materialize(rows.drop("row"), "shard-sizes")
    plan = plan_moves(sizes, n_shards, capacities, blocks_per_shard)
    return unpack(apply_plan(rows, plan), ["shard", "slot", "old_shard"])


# ---- files ------------------------------------------------------------------


def _write_folders(placed: DataFrame, path: str, text: str, file_bytes: int) -> None:
    """Write each shard's rows by slot into files of about ``file_bytes`` of text; a task
    writes one file of one shard, whatever the number of shards."""
    held = placed.groupBy("shard").agg(F.sum(text_bytes(text)).alias("held"), F.count("*").alias("n"))
    per_file = F.greatest(F.ceil(F.col("n") / F.ceil(F.col("held") / file_bytes)), F.lit(1))
    files = held.select(F.col("shard").alias("to_shard"), per_file.alias("per_file"))  # one row per shard
    placed = placed.join(F.broadcast(files), F.col("shard") == F.col("to_shard"))
    placed = placed.withColumn("to_file", F.floor(F.col("slot") / F.col("per_file"))).drop("per_file")
    by_file = placed.repartition("to_shard", "to_file").sortWithinPartitions("to_shard", "slot").drop("to_file")
    by_file.withColumnRenamed("to_shard", "_folder").write.partitionBy("_folder").parquet(path)


def write_shards(sharded: DataFrame, path: str, text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows with a ``shard`` column as one folder per shard; returns the
    manifest ``shard int, folder string``, also kept as ``<path>-manifest``."""
    _write_folders(sharded, path, text, file_bytes)
    return _manifest(sharded, path)


def _manifest(sharded: DataFrame, path: str, kept: DataFrame | None = None) -> DataFrame:
    new = sharded.select("shard").distinct().withColumn("folder", F.concat(F.lit(f"{path}/_folder="), "shard"))
    (new if kept is None else new.unionByName(kept)).write.parquet(f"{path}-manifest")
    return sharded.sparkSession.read.schema("shard int, folder string").parquet(f"{path}-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The rows of all shards a manifest lists; it has one row per shard."""
    folders = [r["folder"] for r in manifest.orderBy("shard").collect()]
    return spark.read.parquet(*folders)


def rewrite_shards(
    spark: SparkSession,
    manifest: DataFrame,
    path: str,
    n_shards: int,
    key: Sequence[str] = ("doc_id", "text"),
    text: str = "text",
    blocks_per_shard: int = BLOCKS_PER_SHARD,
) -> tuple[DataFrame, Plan]:
    """Reshard a written layout into ``n_shards``: shards that gain or lose a block
    are written below ``path``, the others stay where they are and keep their
    slots. Old files are left alone, so a failed run can simply be repeated.
    Returns the new manifest and the plan."""
    old = read_shards(spark, manifest)
    rows = pack(old.drop("slot"), old_shard=F.col("shard"), key=F.xxhash64(*key), size=text_bytes(text))
    plan = plan_moves(materialize(rows.drop("row"), "shard-sizes"), n_shards, None, blocks_per_shard)
    changed = [s for s in plan.affected]
    todo = rows.where(F.col("old_shard").isin(changed))
    placed = unpack(apply_plan(todo, plan), ["shard", "slot"]).drop("input_shard")
    _write_folders(placed, path, text, FILE_BYTES)
    kept = manifest.where(~F.col("shard").isin(changed))
    return _manifest(spark.read.schema(placed.schema).parquet(path), path, kept), plan

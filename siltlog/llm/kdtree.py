"""Exact top-k by inner product with one KD-tree per shard.

Vectors are hashed into shards of a bounded number of rows and each shard becomes
one balanced KD-tree: median splits on the widest side, a tight bounding box for
every node. Queries travel in blocks. A block first searches one shard, which
gives each query a k-th score to beat; with that score it then searches every
shard, best leaf first by the bound its box allows, and leaves a tree as soon as
no box can reach the k-th score. Blocks meet shards in an equi-join on the
shard, so neither side is ever held whole by a task or the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.llm.words import bounded_batches
from siltlog.session import materialize

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
BLOCKS_TOGETHER = 64
LEAF_ROWS = 128

_TREE = "dim int, shard int, ids array<long>, keys array<long>, ends array<int>, points binary, low binary, high binary"
_BLOCK = "dim int, block int, ids array<long>, keys array<long>, points binary"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, dim)


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS):
    """Order of the rows, end of each leaf in it, and boxes of all nodes in heap order."""
    rows, dim = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf_rows)))) if dim else 0
    runs = [np.arange(rows)]
    low, high = [], []
    for level in range(depth + 1):
        for run in runs:
            inside = points[run]
            low.append(inside.min(axis=0) if len(run) else np.zeros(dim))
            high.append(inside.max(axis=0) if len(run) else np.zeros(dim))
        if level == depth:
            break
        halves = []
        for run in runs:
            inside = points[run]
            wide = int(np.argmax(inside.max(axis=0) - inside.min(axis=0))) if len(run) else 0
            middle = len(run) // 2
            order = np.argpartition(inside[:, wide], middle) if len(run) else run
            halves += [run[order[:middle]], run[order[middle:]]]
        runs = halves
    return np.concatenate(runs), np.cumsum([len(r) for r in runs]), np.array(low), np.array(high)


def _trees(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    points = _matrix(table.column("v"), dim)
    order, ends, low, high = build_tree(points)
    take = pa.array(order)
    row = {
        "dim": dim,
        "shard": table.column("shard")[0].as_py(),
        "ids": table.column("vec_id").take(take).to_pylist(),
        "keys": table.column("key").take(take).to_pylist(),
        "ends": ends.tolist(),
        "points": points[order].tobytes(),
        "low": low.tobytes(),
        "high": high.tobytes(),
    }
    return pa.Table.from_pylist([row], schema=_arrow(_TREE))


def _query_blocks(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    row = {
        "dim": dim,
        "block": table.column("block")[0].as_py(),
        "ids": table.column("vec_id").to_pylist(),
        "keys": table.column("key").to_pylist(),
        "points": _matrix(table.column("v"), dim).tobytes(),
    }
    return pa.Table.from_pylist([row], schema=_arrow(_BLOCK))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_KINDS |= {f"array<{k}>": pa.list_(v) for k, v in list(_KINDS.items())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in schema.split(", "))])


class _Best:
    """The k best of each query so far: highest score, then smallest id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor  # a k-th score that is known from elsewhere

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        useful = score.max(axis=1) >= np.maximum(self.score[rows, -1], self.floor[rows])
        rows, score = rows[useful], score[useful]
        if not len(rows):
            return
        score = np.concatenate([self.score[rows], score], axis=1)
        names = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((names, -score), axis=-1)[:, :k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.id[rows] = np.take_along_axis(names, order, axis=1)


def search_tree(queries, query_keys, floor, points, ids, keys, ends, low, high, k: int) -> _Best:
    """Best-first search of one tree for a block of queries."""
    best = _Best(len(queries), k, floor)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ high.T + down @ low.T
    leaves = len(ends)
    # From the root down: a node counts only below one that can still reach the k-th score.
    alive = np.ones((len(queries), 1), dtype=bool)
    width, first = 1, 0
    while True:
        alive &= bound[:, first : first + width] >= floor[:, None]
        if width == leaves:
            break
        alive = np.repeat(alive, 2, axis=1)
        first, width = first + width, 2 * width
    reach = np.where(alive, bound[:, -leaves:], -np.inf)
    order = np.argsort(-reach, axis=1, kind="stable")
    starts = np.concatenate([[0], ends[:-1]])
    for step in range(leaves):
        leaf = order[:, step]
        now = reach[np.arange(len(queries)), leaf]
        active = np.flatnonzero((now >= best.kth()) & (now > -np.inf))
        if not len(active):
            break
        for one in np.unique(leaf[active]):
            rows = active[leaf[active] == one]
            part = slice(starts[one], ends[one])
            if part.start == part.stop:
                continue
            score = queries[rows] @ points[part].T
            score[query_keys[rows][:, None] == keys[part][None, :]] = -np.inf
            best.add(rows, score, ids[part])
    return best


def _search(k: int):
    """Search one tree with a group of blocks: the tree is decoded once for all of them."""

    def run(blocks: pa.Table, trees: pa.Table) -> pa.Table:
        found = []
        for tree in trees.to_pylist() if blocks.num_rows else []:
            dim = tree["dim"]
            load = lambda data: np.frombuffer(data, dtype=np.float64).reshape(-1, dim)  # noqa: B023, E731
            ids, keys, ends = (np.array(tree[c], dtype=np.int64) for c in ("ids", "keys", "ends"))
            points, low, high = (
                (load(tree["points"]), load(tree["low"]), load(tree["high"]))
                if dim
                else (np.zeros((len(ids), 0)), np.zeros((1, 0)), np.zeros((1, 0)))
            )
            for i in range(blocks.num_rows):
                block = blocks.slice(i, 1).to_pylist()[0]
                qid, qkey = np.array(block["q_ids"], dtype=np.int64), np.array(block["q_keys"], dtype=np.int64)
                queries = load(block["q_points"]) if dim else np.zeros((len(qid), 0))
                floor = np.array(block["floor"] or [-np.inf] * len(qid), dtype=np.float64)
                best = search_tree(queries, qkey, floor, points, ids, keys, ends, low, high, k)
                row, place = np.nonzero(best.score >= np.maximum(floor[:, None], np.finfo(float).min))
                found.append((qid[row], qkey[row], best.id[row, place], best.score[row, place].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "query_key", "vec_id", "score"), map(pa.array, columns))))

    return run


_FOUND = "query_id long, query_key long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v, dim, key``: components as floor(64 * x), repeated rows once."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))
    )
    whole = F.transform("x", lambda e: F.floor(64 * e).cast("double"))
    return kept.select("vec_id", whole.alias("v"), F.size("x").alias("dim")).select(
        "*", F.xxhash64("vec_id", "v").alias("key")
    ).dropDuplicates(["vec_id", "key"])


def _searched(blocks: DataFrame, trees: DataFrame, shards: Column, k: int) -> DataFrame:
    """Each block searched in the trees of its dimension that ``shards`` lists.

    A tree is copied once per group of blocks, so a shard's work is split between
    tasks, and crosses into Python once per group.
    """
    asked = blocks.select(
        "dim",
        F.floor(F.col("block") / BLOCKS_TOGETHER).cast("int").alias("together"),
        F.col("ids").alias("q_ids"),
        F.col("keys").alias("q_keys"),
        F.col("points").alias("q_points"),
        "floor",
        F.explode(shards).alias("shard"),
    )
    groups = blocks.select("dim", F.floor(F.col("block") / BLOCKS_TOGETHER).cast("int").alias("together")).distinct()
    cell = ["dim", "together", "shard"]
    copied = trees.join(groups.withColumnRenamed("dim", "of_dim"), F.col("dim") == F.col("of_dim")).drop("of_dim")
    return asked.groupBy(*cell).cogroup(copied.groupBy(*cell)).applyInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products
    with every other row, ties to the smaller id; fewer if there are fewer rows.

    Components count as floor(64 * x). Vectors that are null or hold a null or a
    non-finite component take no part, neither do null ids; vectors meet those of
    their own length. A row repeated with the same vector is one row; rows that
    repeat an id with another vector are rows of their own. Other columns are
    ignored. Scores are exact up to 2**53.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialize(usable(vectors, id_col, vector), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = spark.createDataFrame([(d, -(-n // SHARD_ROWS)) for d, n in sizes.items()], "dim int, n_shards int")
    counts = F.broadcast(shards)  # one row per vector length
    asked = rows.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sharded = rows.join(counts, "dim").withColumn("shard", F.pmod("key", "n_shards").cast("int")).drop("n_shards")
    trees = materialize(sharded.groupBy("dim", "shard").applyInArrow(_trees, _TREE), "kd-trees")
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    blocks = materialize(blocked.groupBy("dim", "block").applyInArrow(_query_blocks, _BLOCK), "query-blocks")
    blocks = blocks.join(counts, "dim")
    first = blocks.withColumn("floor", F.lit(None).cast("array<double>"))
    seeds = materialize(_searched(first, trees, F.array(F.pmod("block", "n_shards").cast("int")), k), "seed-scores")
    kth = seeds.groupBy("query_key").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = (
        blocks.select("dim", "block", F.posexplode("keys").alias("at", "query_key"))
        .join(kth, "query_key", "left")
        .withColumn("least", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))))
        .groupBy("dim", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("known"))
        .select("dim", "block", F.col("known.least").alias("floor"))
    )
    second = blocks.join(floors, ["dim", "block"])
    every = F.sequence(F.lit(0), F.col("n_shards") - 1)
    found = materialize(_searched(second, trees, every, k), "shard-scores")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

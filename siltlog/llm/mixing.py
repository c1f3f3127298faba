"""Mixing sources to target weights with exact block quotas.

The rows of each source are hashed into blocks of about the same number of
words. A source's target fixes how many of its blocks the mix takes: whole
passes over all of them, then blocks in a permuted order up to the target. A
splitting tree deals the quotas out: at each node the blocks of all sources are
divided between the two halves of the output shards by a multivariate
hypergeometric draw, so that a shard gets what a uniform permutation of the
whole pool would have given it. Shards then take disjoint runs of each source's
permuted blocks and shuffle their rows locally.

The driver holds one row per source and at most ``shards * blocks_per_shard``
plus one block per source; no text and no row passes through it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.llm.rows import pack, unpack
from siltlog.session import broadcast_if_small, materialize

SHARDS = 40
BLOCKS_PER_SHARD = 256
MOST_PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = 20
BROADCAST_ROWS = 200_000


def word_count(text: str) -> Column:
    """Number of runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size.

    What a capped source leaves is shared again by weight among the others
    until none is above its cap.
    """
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """``[shard, source]`` block counts: columns sum to ``quotas``, rows differ by
    at most one, and the counts are those of a uniformly permuted pool."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    here = total * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, here, method="marginals") if total else quotas
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


@dataclass(frozen=True)
class Mix:
    """``sources``: ``source, source_id, source_size, target, n_blocks``;
    ``blocks``: ``source_id, block, copies array<struct<pass, shard>>, cut``.
    A block with a ``cut`` gives its last copy only for rows up to so many words."""

    sources: DataFrame
    blocks: DataFrame
    quotas: np.ndarray


def _drawn_blocks(sizes: dict[int, int], target: float, rng: np.random.Generator):
    """How often each block of one source is taken, in order: ``(block, pass)``
    and the block that is taken only up to a number of words, with that number."""
    total = sum(sizes.values())
    if not total or target <= 0:
        return [], None
    passes = int(target // total)
    takes, cut = [], None
    for p in range(passes):
        order = rng.permutation(len(sizes))
        ids = sorted(sizes)
        takes += [(ids[k], p) for k in order]
    left = target - passes * total
    ids = sorted(sizes)
    skipped = []
    for k in rng.permutation(len(ids)):
        block = ids[k]
        if sizes[block] <= left:
            takes.append((block, passes))
            left -= sizes[block]
        elif sizes[block]:
            skipped.append(block)
    if skipped and left >= 1:
        block = min(skipped, key=lambda b: (sizes[b], b))
        takes.append((block, passes))
        cut = (block, left)
    return takes, cut


def plan_mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    shards: int = SHARDS,
    blocks_per_shard: int = BLOCKS_PER_SHARD,
    most: float = MOST_PASSES,
    seed: int = SEED,
) -> Mix:
    """Plan the draw for ``rows`` of ``source, key long, size long``.

    Sources are numbered by code point, null last, and weigh ``weights`` in
    turn. The result depends on the rows, the arguments and the seed only.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    names, sizes = [r["source"] for r in found], [int(r["size"]) for r in found]
    weigh = [weights[k % len(weights)] for k in range(len(found))]
    targets = capped_targets(sizes, weigh, most)
    words = max(1, sum(sizes) // (shards * blocks_per_shard))
    n_blocks = [max(1, min(int(r["n"]), -(-s // words))) for r, s in zip(found, sizes, strict=True)]
    sources = spark.createDataFrame(
        list(zip(names, range(len(names)), sizes, targets, n_blocks, strict=True)),
        "source string, source_id int, source_size long, target double, n_blocks int",
    )
    sums = with_blocks(rows, sources).groupBy("source_id", "block").agg(F.sum("size").alias("words")).collect()
    held: dict[int, dict[int, int]] = {}
    for r in sums:
        held.setdefault(r["source_id"], {})[r["block"]] = int(r["words"])
    draws = [_drawn_blocks(held.get(i, {}), t, np.random.default_rng([seed, i])) for i, t in enumerate(targets)]
    quotas = split_quotas(
        np.array([len(takes) for takes, _ in draws], dtype=np.int64), shards, np.random.default_rng([seed, len(draws), shards])
    )
    out = []
    for i, (takes, cut) in enumerate(draws):
        to = np.repeat(np.arange(shards), quotas[:, i])
        copies: dict[int, list] = {}
        for (block, p), shard in zip(takes, to.tolist(), strict=True):
            copies.setdefault(block, []).append((p, shard))
        out += [(i, b, c, float(cut[1]) if cut and cut[0] == b else None) for b, c in sorted(copies.items())]
    blocks = spark.createDataFrame(out, "source_id int, block int, copies array<struct<pass:int,shard:int>>, cut double")
    return Mix(sources, blocks, quotas)


def with_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_id``, ``source_size``, ``target`` and ``block`` to rows."""
    few = broadcast_if_small(sources.withColumnRenamed("source", "_source"), BROADCAST_ROWS)
    return (
        rows.join(few, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("block", F.pmod("key", "n_blocks").cast("int"))
        .drop("_source", "n_blocks")
    )


def draw(rows: DataFrame, mix: Mix) -> DataFrame:
    """Every row with ``copies``: the passes and output shards that take it.

    Only the rows of the one cut block of a source are put in order, the
    largest first; they are taken while half of the row lies below the cut.
    """
    few = broadcast_if_small(mix.blocks, BROADCAST_ROWS)
    joined = with_blocks(rows, mix.sources).join(few, ["source_id", "block"], "left")
    copies = F.coalesce("copies", F.array().cast("array<struct<pass:int,shard:int>>"))
    whole = joined.where(F.col("cut").isNull()).withColumn("copies", copies).drop("cut")
    order = Window.partitionBy("source_id", "block").orderBy(F.col("size").desc(), "key")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    part = (
        joined.where(F.col("cut").isNotNull())
        .withColumn("_in", upto <= F.col("cut"))
        .withColumn("copies", F.when(F.col("_in"), copies).otherwise(F.slice(copies, F.lit(1), F.size(copies) - 1)))
        .drop("_in", "cut")
    )
    return whole.unionByName(part)


def digest(docs: DataFrame, key: Sequence[str] = ("doc_id", "text"), text: str = "text", source: str = "source") -> DataFrame:
    """``row, source, key, size``: the row as it came and what the mix needs of it."""
    return pack(docs, source=F.col(source).cast("string"), key=F.xxhash64(*key), size=word_count(text))


def mix(docs: DataFrame, shuffled: bool = True, **options) -> DataFrame:
    """The mix: each row as often as it is taken, with ``mix_shard``, ``mix_pass``
    and ``mix_order`` (the place to sort by inside a shard).

    ``shuffled`` also puts the rows in that order, by ranges, so that a shard may
    be larger than a task. Null and empty texts have no words and are taken or
    left with their block; a null source is a source. Equal rows share their
    block. No rows give no rows. Input columns named like an added one come back
    as ``input_<name>``.
    """
    return unpack(_taken(docs, shuffled, **options), ["mix_shard", "mix_pass", "mix_order"])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of :func:`mix` in their order, with their own columns only."""
    return unpack(_taken(docs, True, **options))


def _taken(docs: DataFrame, shuffled: bool, **options) -> DataFrame:
    rows = digest(docs)
    plan = plan_mix(materialize(rows.drop("row"), "mix-sizes"), **options)
    taken = draw(rows, plan).select("row", "key", F.explode("copies").alias("copy"))
    out = taken.select(
        "row",
        F.col("copy.shard").alias("mix_shard"),
        F.col("copy.pass").alias("mix_pass"),
        F.xxhash64("key", "copy.pass", F.lit(SEED)).alias("mix_order"),
    )
    if shuffled:
        order = ["mix_shard", "mix_order"]
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out

"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks of the
corpus are sorted and numbered, so every document becomes a list of integers; then
the distinct pairs of neighbouring integers are sorted and numbered, which halves the
lists, until each document is down to one integer. Two documents end with the same
integer after the same number of rounds exactly if all their blocks are equal: names
stand for sorted contents and not for hashes, so they cannot collide.

Contents cross the network once, when the distinct blocks are gathered; tasks drop
their own repeats first. Documents find the names of their blocks by a 64-bit value,
and by the blocks themselves wherever two of them share a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siltlog.llm import words as W
from siltlog.llm.rows import pack, unpack
from siltlog.session import materialize

BLOCK_BYTES = 2048
MOST_HOT = 1000
NO_NAME = -1  # stands for the missing neighbour of the last name of an odd list
ADDED = ("keep_id", "group_size", "kept", "text_sha256")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_blocks(text: pa.Array, block_bytes: int) -> tuple[list[str], pa.ListArray]:
    """Digest of each lower-cased text and its blocks; an empty text is one empty block."""
    data, bounds = W.text_buffer(text)
    data = np.take(_LOWER, data)
    whole = memoryview(data)
    digests = [sha256(whole[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    count = np.maximum(1, -(-np.diff(bounds) // block_bytes))
    upto = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
    starts = np.repeat(bounds[:-1], count) + inside * block_bytes
    ends = np.append(starts, bounds[-1]).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), int(upto[-1]), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return digests, pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), blocks)


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blocks = cut_blocks(batch.column("text"), block_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(digests, pa.string()), blocks],
                names=["row", "id", "text_sha256", "blocks"],
            )

    return run


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """The distinct rows of ``values``, sorted in each partition, with a number of their own
    and how often each is ``held``."""
    distinct = values.groupBy(*values.columns).agg(F.count("*").alias("held"))
    return materialize(distinct.sortWithinPartitions(*values.columns).withColumn("name", F.monotonically_increasing_id()), name)


def _met(rows: DataFrame, few: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows joined to the one row of ``few`` with their keys, which says how many of ``total`` have ``held`` them.

    What more than a thousandth of all rows hold is a thousand rows at most; they are
    broadcast, and no shuffle sees the rows that hold them.
    """
    often = F.col("held") > total / MOST_HOT
    hot = F.broadcast(few.where(often).drop("held"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(few.where(~often).drop("held"), keys)
    return rows.join(hot, keys).unionByName(rest)


def _named_blocks(listed: DataFrame, valued: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """``rid, n, at, name`` for ``rid, n, at, value`` (and ``block``, if values are shared).

    Where two blocks have one value the blocks themselves decide, for those values only.
    """
    columns = ["rid", "n", "at", "name"]
    if "block" not in listed.columns:
        return _met(listed, valued.select("value", "name", "held"), ["value"], total).select(*columns)
    single = valued.join(shared, "value", "left_anti").select("value", "name")
    several = valued.drop("held").join(shared, "value").withColumnsRenamed({"value": "shared_value", "block": "shared_block"})
    same = (F.col("value") == F.col("shared_value")) & (F.col("block") == F.col("shared_block"))
    told = listed.join(shared, "value", "left_semi").join(several, same)
    return listed.join(single, "value").select(*columns).unionByName(told.select(*columns))


def _paired(nodes: DataFrame, total: int) -> DataFrame:
    """The next round's ``rid, n, at, name``: neighbours of each list under one name."""
    side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
    pairs = nodes.groupBy(
        "rid", F.shiftright(F.col("n") + 1, 1).alias("n"), F.shiftright("at", 1).alias("at")
    ).agg(side(0).alias("one"), F.coalesce(side(1), F.lit(NO_NAME)).alias("two"))
    pairs = materialize(pairs, "pairs")
    names = _numbered(pairs.select("one", "two"), "pair-names")
    return _met(pairs, names, ["one", "two"], total).select("rid", "n", "at", "name")


def identities(nodes: DataFrame, most: int, total: int) -> DataFrame:
    """``rid, rounds, name``: one identity for each list of names, the same for equal lists only.

    The longest list has ``most`` names; there are ``total`` in all.
    """
    done, rounds = None, 0
    while True:
        nodes = materialize(nodes, "named")
        ready = nodes.where("n = 1").select("rid", F.lit(rounds).alias("rounds"), "name")
        done = ready if done is None else done.unionByName(ready)
        if most <= 1:
            return done
        nodes, most, rounds = _paired(nodes.where("n > 1"), total), (most + 1) // 2, rounds + 1


def exact_groups(
    docs: DataFrame,
    keep: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    value: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """All rows of ``docs`` (with the columns ``keep``, all by default) and ``keep_id``, the
    id of the row that stays of its group, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are after A-Z became a-z; null counts as empty, and
    all empty texts are equal. The row with the largest id stays, exactly one if
    several have it; a null id stays only if its group has no other. Texts of any
    length are read whole. A caller's column with the name of an added one comes
    back as ``input_<name>``; an empty table gives no rows.

    A group may hold any share of the rows: sizes and largest ids are aggregated
    before they are shuffled, and names that a thousandth of the rows share are
    broadcast to them.
    """
    W.bounded_batches(docs.sparkSession)
    packed = pack(docs, keep, id=F.col(f"`{id_col}`"), text=F.col(f"`{text}`").cast("string"))
    schema = T.StructType([packed.schema["row"], packed.schema["id"]]).add("text_sha256", "string").add("blocks", T.ArrayType(T.BinaryType()))
    cut = packed.mapInArrow(_cut(block_bytes), schema)
    names = _numbered(cut.select(F.explode("blocks").alias("block")), "block-names")
    valued = names.select(value(F.col("block")).alias("value"), "block", "name", "held")
    shared = valued.groupBy("value").agg(F.count("*").alias("blocks")).where("blocks > 1").select("value")
    shared = materialize(shared, "shared-values")
    # Rows keep their blocks only if some value doesn't tell its block.
    parts = [F.transform("blocks", lambda b: value(b)).alias("value"), *([] if shared.isEmpty() else [F.col("blocks").alias("block")])]
    rows = cut.select("row", "id", "text_sha256", F.arrays_zip(*parts).alias("parts"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "block-lists")
    listed = rows.select("rid", F.size("parts").cast("long").alias("n"), F.posexplode("parts").alias("place", "part"))
    listed = listed.select("rid", "n", F.col("place").cast("long").alias("at"), "part.*")
    most, total, count = (n or 0 for n in rows.agg(F.max(F.size("parts")), F.sum(F.size("parts")), F.count("*")).head())
    named = rows.drop("parts").join(identities(_named_blocks(listed, valued, shared, total), most, total), "rid")
    named = materialize(named, "identities")
    last = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "rid")).alias("last")
    groups = named.groupBy("rounds", "name").agg(last, F.count("*").alias("held"))
    groups = materialize(groups.withColumn("group_size", F.col("held")), "groups")
    out = _met(named, groups, ["rounds", "name"], count).select(
        "row",
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("last.rid")).alias("kept"),
        "text_sha256",
    )
    return unpack(out, ADDED)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    found = exact_groups(docs, None, id_col, text)
    own = [F.col(f"`input_{c}`").alias(c) if c.lower() in ADDED else F.col(f"`{c}`") for c in docs.columns]
    return found.where("kept").select(*own)

"""Near-duplicate documents by one-permutation MinHash.

One hash of every shingle is all a document costs: its top bits choose a bin, the
smallest value of a bin is the bin's entry, and empty bins copy a full one that
a hash of the bin's number finds (optimal densification). Runs of entries are
band keys. In each bucket of a band only the edges of a star are tried: every
document against one centre, the one that shares the most buckets with others.

A star alone would lose links between two documents of a bucket when one of them
is unlike the centre ``c``. Such documents ``x`` and ``y`` have at most
``min(|x & c|, |y & c|)`` shingles in common inside the centre, and outside it at
most as many as either of them shares with documents of other components.
Pairs of one star that this bound and their sizes leave possible are tested too,
so no link of two documents that meet in a bucket is lost. All links are
confirmed on full shingle sets.

Documents with the same set are one node from the start, so copies never meet in
a bucket. Links, components and sets stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltlog.llm import words as W
from siltlog.llm.graph import components
from siltlog.llm.rows import pack, unpack
from siltlog.session import broadcast_if_small, materialize

SHINGLE = 5
PERCENT = 75
BANDS = 32
BAND_ROWS = 4
BINS = BANDS * BAND_ROWS
BROADCAST_ROWS = 500_000
STAR_PART = 512

_ODD = W.mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(text: pa.Array, first: int, last: int, data: np.ndarray, bounds: np.ndarray):
    """Sorted distinct shingle values of rows ``first`` to ``last``: one array of values
    and each row's bounds in it."""
    low, high = bounds[first], bounds[last]
    values, at = W.hash_words(data[low:high], bounds[first : last + 1] - low, W.SPACED)
    sets = []
    for k in range(last - first):
        own = values[at[k] : at[k + 1]]
        if not len(own):
            sets.append(own)
            continue
        width = min(SHINGLE, len(own))
        rolled = np.zeros(len(own) - width + 1, dtype=np.uint64)
        for j in range(width):
            rolled += own[j : j + len(rolled)] * _ODD[j]
        # The width is part of the value: a short text equals no part of a long one.
        sets.append(np.unique(W.mix(rolled + np.uint64(width))))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _probes() -> np.ndarray:
    """The bins an empty bin looks at, in order; every bin comes up in the end."""
    rng = np.random.default_rng(BINS)
    tries = rng.integers(0, BINS, size=(BINS, 16 * BINS))
    rest = (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS
    return np.concatenate([tries, rest], axis=1)


_PROBES = _probes()
_BIN_BITS = int(np.log2(BINS))


def band_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys of each row of :func:`shingle_sets`; rows with an empty set are undefined."""
    rows = len(at) - 1
    doc = np.repeat(np.arange(rows), np.diff(at))
    cell = doc * BINS + (values >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    entry = np.zeros(rows * BINS, dtype=np.uint64)
    full = np.zeros(rows * BINS, dtype=bool)
    # Values of a row are sorted, so the first of a cell is its minimum.
    entry[cell[head]], full[cell[head]] = values[head], True
    entry, full = entry.reshape(rows, BINS), full.reshape(rows, BINS)
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(_PROBES.shape[1]):
        if not len(row):
            break
        probe = _PROBES[bin_, t]
        found = full[row, probe]
        entry[row[found], bin_[found]] = entry[row[found], probe[found]]
        row, bin_ = row[~found], bin_[~found]
    entry = entry.reshape(rows, BANDS, BAND_ROWS)
    key = np.broadcast_to(W.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(7)), (rows, BANDS)).copy()
    for j in range(BAND_ROWS):
        key = W.mix(key + entry[:, :, j])
    return key


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        data, bounds = W.text_buffer(text)
        for first, last in W.row_groups(bounds):
            values, at = shingle_sets(text, first, last, data, bounds)
            sizes = np.diff(at)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values))])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(_MIRROR)))])
            none = sizes == 0
            keys = band_keys(values, at)
            full = np.flatnonzero(~none)
            upto = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)
            node = pa.array(W.mix(total[at[1:]] - total[at[:-1]]).view(np.int64), mask=none)
            check = pa.array(W.mix(other[at[1:]] - other[at[:-1]]).view(np.int64), mask=none)
            bands = pa.ListArray.from_arrays(pa.array(upto), _signed(np.ascontiguousarray(keys[full]).ravel()))
            own = batch.drop_columns(["text"]).slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(sizes), node, check, bands],
                names=[*own.schema.names, "n_shingles", "node", "node_check", "bands"],
            )


_MIRROR = 0xA5A5A5A55A5A5A5A


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        data, bounds = W.text_buffer(text)
        for first, last in W.row_groups(bounds):
            values, at = shingle_sets(text, first, last, data, bounds)
            own = batch.drop_columns(["text"]).slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(values))],
                names=[*own.schema.names, "shingles"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``n_shingles``, ``node`` (a number for the set;
    null for an empty one), ``node_check`` and 32 ``bands`` keys."""
    W.bounded_batches(docs.sparkSession, W.TEXT_BATCH)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema.fields)
    return docs.mapInArrow(_signatures, f"{keys}, n_shingles long, node long, node_check long, bands array<long>")


def _told_apart(sigs: DataFrame) -> DataFrame:
    """``sigs`` with another ``node`` for sets that share the number of a different set."""
    shared = sigs.where("node IS NOT NULL").groupBy("node").agg(F.min("node_check").alias("lo"), F.max("node_check").alias("hi"))
    shared = materialize(shared.where("lo <> hi").select("node", F.lit(True).alias("shared")), "shared-nodes")
    if shared.isEmpty():
        return sigs
    told = F.when(F.col("shared"), F.xxhash64("node", "node_check")).otherwise(F.col("node"))
    return materialize(sigs.join(shared, "node", "left").withColumn("node", told).select(*sigs.columns), "signatures")


def _common(pairs: DataFrame, sets: DataFrame, extra: bool = False) -> DataFrame:
    """Add to pairs ``c, m`` the sizes ``nc, nm``, the shingles in ``both``, whether they
    are ``linked``, and with ``extra`` the shingles of ``m`` outside ``c``."""
    one = sets.select(F.col("node").alias("c"), F.col("shingles").alias("sc"))
    two = sets.select(F.col("node").alias("m"), F.col("shingles").alias("sm"))
    joined = pairs.join(two, "m").join(one, "c")
    outside = F.array_except("sm", "sc")
    found = joined.select("c", "m", F.size("sc").alias("nc"), F.size("sm").alias("nm"), outside.alias("extra"))
    both = (F.col("nm") - F.size("extra")).cast("long")
    found = found.withColumn("both", both).withColumn(
        "linked", 100 * F.col("both") >= PERCENT * (F.col("nc") + F.col("nm") - F.col("both"))
    )
    return found if extra else found.drop("extra")


def _sets_of(docs: DataFrame, sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` for the given nodes, from one document each."""
    holder = sigs.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    holder = materialize(holder, "set-holders")
    few = broadcast_if_small(holder.withColumnRenamed("row_key", "_key"), BROADCAST_ROWS)
    texts = docs.join(few, F.col("row_key") == F.col("_key")).select("node", "text").dropDuplicates(["node"])
    return materialize(texts.mapInArrow(_sets, "node long, shingles array<long>"), "shingle-sets")


def _star_edges(members: DataFrame) -> DataFrame:
    """``c, m``: each member of a bucket with the bucket's centre.

    ``members`` is ``bucket, node, held`` with the size of the bucket. The centre has
    the largest buckets in sum: what a group of near copies has in common is
    what most of its members share, so the least edited one meets the most.
    """
    weight = members.groupBy("node").agg(F.sum("held").alias("weight"))
    weighed = members.join(weight, "node")
    centre = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"))
    chosen = weighed.join(centre.select("bucket", F.col("top.node").alias("c")), "bucket")
    return chosen.where("node <> c").select("c", F.col("node").alias("m")).distinct()


def _could_link(common: Column, one: Column, other: Column) -> Column:
    """Whether sets of two sizes could be alike enough with so many shingles in common."""
    return (100 + PERCENT) * common >= PERCENT * (one + other)


def _open_members(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of stars that still hold several components, one of them unlike the centre."""
    placed = stars.join(roots.withColumnRenamed("node", "m"), "m", "left").withColumn("root", F.coalesce("root", "m"))
    open_ = placed.groupBy("c").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("nm").alias("least"), F.min("linked").alias("all")
    )
    open_ = open_.where("lo <> hi AND NOT all").select("c", "least")
    return placed.join(open_, "c")


def _possible_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``c, m`` of members of one star and different components that could be linked.

    A member's outside shingles count when several components hold them. Members
    that could be linked with no other, however their shingles fall, go first; of
    the rest those outside the star's largest component meet the others. Both sides
    of a star are dealt into parts of about ``STAR_PART`` members that meet one by one,
    so a star may be of any size.
    """
    tokens = members.select("c", "m", "root", F.explode("extra").alias("token"))
    shared = tokens.groupBy("c", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    more = tokens.join(shared.select("c", "token"), ["c", "token"]).groupBy("c", "m").agg(F.count("*").alias("more"))
    able = members.drop("extra").join(more, ["c", "m"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    able = materialize(able.where(_could_link(F.col("both") + F.col("more"), F.col("nm"), F.col("least"))), "able")
    held = able.groupBy("c", "root").agg(F.count("*").alias("n"))
    stars = held.groupBy("c").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.ceil(F.sum("n") / STAR_PART).cast("int").alias("parts"))
    able = able.join(materialize(stars, "star-parts"), "c")
    own, every = F.pmod(F.xxhash64("m"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def side(rows: DataFrame, end: str, row: Column, column: Column) -> DataFrame:
        named = [F.col(name).alias(name + end) for name in ("m", "nm", "both", "more", "root")]
        return rows.select("c", *named, row.alias("row"), column.alias("column"))

    one, two = side(able.where("root <> main"), "1", own, every), side(able, "2", every, own)
    common = F.least("both1", "both2") + F.least("more1", "more2")
    fits = _could_link(common, F.col("nm1"), F.col("nm2")) & (F.col("root1") != F.col("root2"))
    cell = [F.col(f"one.{name}") == F.col(f"two.{name}") for name in ("c", "row", "column")]
    pairs = one.alias("one").join(two.alias("two"), cell[0] & cell[1] & cell[2] & fits)
    return pairs.select(F.least("m1", "m2").alias("c"), F.greatest("m1", "m2").alias("m")).distinct()


def _joined(links: DataFrame | None, tested: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the links among tested pairs, and the components if there are any."""
    fresh = materialize(tested.where("linked").select(F.col("c").alias("u"), F.col("m").alias("v")), "links")
    if fresh.isEmpty():
        return links, roots
    links = fresh if links is None else links.unionByName(fresh)
    return links, materialize(components(links), "roots")


def _row_key(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``.

    Documents are linked when their sets of distinct five-word shingles are at
    least 75 % alike; components are closed under links and named by their
    smallest doc_id. A text of fewer words is one shingle; null or empty texts
    have none, are linked with nothing and are kept. Other columns are ignored.
    Rows that repeat a doc_id are documents of their own with the same name; if
    several rows of a component have its name, one is kept, with its exact
    repeats. A null doc_id names a component only when it has no other.
    """
    return _judged(docs).drop("row_key")


def _judged(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with the ``row_key`` of each row."""
    docs = docs.select("doc_id", "text", _row_key(docs).alias("row_key"))
    sigs = _told_apart(materialize(signatures(docs), "signatures"))
    nodes = sigs.where("node IS NOT NULL")
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("held"))
    shared = shared.where("lo <> hi").select("bucket", "held")
    members = materialize(slots.join(shared, "bucket").distinct(), "buckets")
    sets = _sets_of(docs, nodes, members.select("node").distinct())
    stars = materialize(_common(_star_edges(members), sets, extra=True), "stars")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    links, roots = _joined(None, stars, roots)
    pairs = materialize(_possible_pairs(materialize(_open_members(stars, roots), "open-stars")), "pairs")
    links, roots = _joined(links, _common(pairs, sets), roots)
    placed = sigs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("doc_id", "row_key", "n_shingles", "root"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("least")
    names = placed.where("root IS NOT NULL").groupBy("root").agg(first)
    named = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row_key") == F.col("least.row_key"))
    return placed.join(names, "root", "left").select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (F.col("root").isNull() | named).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns of ``docs``, whatever their names.

    Rows are dropped by id and text, so no other row of a dropped row's id goes with
    it. The dropped rows are broadcast only when they are counted to be few. Of rows
    that repeat a kept row's id and text one stays.
    """
    found = materialize(_judged(docs), "near-duplicates")
    keys = ["doc_id", "row_key"]
    drop = materialize(found.where("NOT kept").select(*keys).distinct(), "dropped")
    rows = pack(docs, own_id=docs["doc_id"], own_key=_row_key(docs))
    listed = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("row_key"))
    out = rows.join(broadcast_if_small(drop, BROADCAST_ROWS), listed, "left_anti")
    repeated = found.where("kept").groupBy(*keys).count().where("count > 1").select(*keys)
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return unpack(out)
    again = broadcast_if_small(repeated, BROADCAST_ROWS)
    once = out.join(again, listed, "left_semi").dropDuplicates(["own_id", "own_key"])
    return unpack(out.join(again, listed, "left_anti").unionByName(once))

"""Global order without a single-task window.

``pos`` is the 0-based chronological index of a row. Everything that needs a
neighbour, a rank or a frame works in blocks of consecutive positions, so a
task never holds more than one block however the data is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siltlog.session import materialize

BLOCK_ROWS = 65536
BLOCKS_PER_GROUP = 4096
UNDATED = "unknown"

RANGE_ROWS = 1 << 20
FEW_ROWS = 10_000
SAMPLES_PER_RANGE = 64
# Runs whose bounds the driver may hold, runs at all, and sampled keys it may collect.
COARSE_RANGES = 1024
MOST_RANGES = 1 << 20
MOST_SAMPLED = 8 * COARSE_RANGES * SAMPLES_PER_RANGE


def with_log_date(logs: DataFrame) -> DataFrame:
    """Partition column; ``unknown`` sorts behind every date, as undated rows must."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return logs.withColumn("log_date", F.coalesce(day, F.lit(UNDATED)))


def lower_bound(values: Column, at: Column) -> Column:
    """How many items of a sorted array lie below ``at``; a binary search.

    Every row of an ingest is placed twice by it, and Spark interprets the steps one by
    one, so a step looks at one item and keeps one number: the count grows by the
    step if the last item that this would count lies below. Past the end there is none.
    """
    largest = F.ceil(F.log2(F.size(values) + F.lit(2.0))).cast("int") - 1

    def advance(n: Column, power: Column) -> Column:
        more = n + F.call_function("shiftleft", F.lit(1), power)
        return F.when(F.get(values, more - 1) < at, more).otherwise(n)

    return F.aggregate(F.sequence(largest, F.lit(0), F.lit(-1)), F.lit(0), advance)


def _thinned(keyed: DataFrame, names: Sequence[str], total: int, wanted: int) -> DataFrame:
    """About ``wanted`` keys, chosen by a hash so that they are the same on every reading."""
    thin = max(1, total // wanted)
    return keyed.where(F.pmod(F.xxhash64(*names), F.lit(thin)) == 0)


def _coarse_bounds(sample: Sequence[tuple], ranges: int) -> Column | None:
    """At most ``ranges - 1`` bounds as a literal array; none if there is nothing to split."""
    picked = sorted(sample)
    bounds = sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []
    if not bounds:
        return None
    listed = ", ".join(
        "named_struct(" + ", ".join(f"'k{i}', {v}L" for i, v in enumerate(bound)) + ")" for bound in bounds
    )
    return F.expr(f"array({listed})")


def _fine_bounds(sample: DataFrame, names: Sequence[str], parts: int) -> DataFrame:
    """``_coarse, _fine``: sorted bounds that cut each coarse range into ``parts``, found by
    the task that holds the range's sample."""
    held = sample.groupBy("_coarse").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("keys"))
    place = lambda i: F.floor(F.size("keys") * i / parts).cast("int") + 1
    picked = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.element_at("keys", place(i)))
    return held.select("_coarse", F.array_distinct(picked).alias("_fine"))


def _in_ranges(df: DataFrame, keys: Sequence[Column], ranges: int | None) -> tuple[DataFrame, int]:
    """Add ``_range``, the number of a run of rows in key order, and count the runs.

    Bounds are taken from hash samples of the keys, about 64 per run, so they are
    the same whenever the rows are read and no key value, however frequent, fills
    a run: the keys together are unique. There are two levels. The bounds of at
    most 1,024 coarse ranges pass through the driver and are literals of the plan; if
    there are more runs, each coarse range is cut further by bounds that a task
    of its own finds. Those are at most ``MOST_RANGES`` keys in all and are broadcast.
    """
    total = df.count()
    if ranges is None:
        parallel = df.sparkSession.sparkContext.defaultParallelism
        ranges = max(1, -(-total // RANGE_ROWS), min(parallel, -(-total // FEW_ROWS)))
    ranges = min(ranges, MOST_RANGES)
    names = [f"k{i}" for i in range(len(keys))]
    named = [k.cast("long").alias(name) for k, name in zip(keys, names)]
    coarse = min(ranges, COARSE_RANGES)
    sample = _thinned(df.select(*named), names, total, coarse * SAMPLES_PER_RANGE).limit(MOST_SAMPLED)
    bounds = _coarse_bounds([tuple(r) for r in sample.collect()], coarse)
    if bounds is None:
        return df.withColumn("_range", F.lit(0)), 1
    if ranges == coarse:
        return df.withColumn("_range", lower_bound(bounds, F.struct(*named))), coarse
    parts = -(-ranges // coarse)
    fine = _thinned(df.select(*named), names, total, ranges * SAMPLES_PER_RANGE)
    fine = _fine_bounds(fine.withColumn("_coarse", lower_bound(bounds, F.struct(*names))), names, parts)
    fine = F.broadcast(materialize(fine, "range-bounds"))
    placed = df.withColumn("_coarse", lower_bound(bounds, F.struct(*named))).join(fine, "_coarse", "left")
    inside = F.coalesce(lower_bound(F.col("_fine"), F.struct(*named)), F.lit(0))
    return placed.withColumn("_range", F.col("_coarse") * parts + inside).drop("_coarse", "_fine"), coarse * parts


def _before_ranges(ranged: DataFrame, total: Column, count: int) -> DataFrame:
    """``_range, _start``: what the runs before each one add up to; one row per run.

    A few runs are added up by the driver. Beyond that sums are taken in groups of
    1,024 runs and over the groups; the result has at most ``MOST_RANGES`` rows.
    """
    sums = ranged.groupBy("_range").agg(total.alias("_sum"))
    if count <= COARSE_RANGES:
        known = {r["_range"]: r["_sum"] for r in sums.collect()}
        starts, at = [], 0
        for i in range(count):
            starts.append((i, at))
            at += known.get(i) or 0
        return F.broadcast(ranged.sparkSession.createDataFrame(starts, "_range int, _start long"))
    sums = materialize(sums.withColumn("_of", F.floor(F.col("_range") / COARSE_RANGES)), "range-sums")
    before = (Window.unboundedPreceding, -1)
    inside = F.sum("_sum").over(Window.partitionBy("_of").orderBy("_range").rowsBetween(*before))
    groups = sums.groupBy("_of").agg(F.sum("_sum").alias("_held"))
    over = F.sum("_held").over(Window.orderBy("_of").rowsBetween(*before))  # at most 1,024 rows
    groups = groups.select("_of", F.coalesce(over, F.lit(0)).alias("_base"))
    starts = sums.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(groups, "_of")
    return F.broadcast(materialize(starts.select("_range", (F.col("_base") + F.col("_inside")).alias("_start")), "range-starts"))


def global_index(df: DataFrame, keys: Sequence[Column], name: str, ranges: int | None = None) -> DataFrame:
    """Add the 0-based index of each row in the order of ``keys``.

    ``df`` must be a stored table, as it is read three times: for a sample of the
    keys, for the number of rows in each run, and for the rows themselves, which
    are shuffled once. ``keys`` are whole numbers, not null and unique together.
    """
    ranged, count = _in_ranges(df, keys, ranges)
    in_range = Window.partitionBy("_range").orderBy(*keys)
    return (
        ranged.join(_before_ranges(ranged, F.count("*"), count), "_range")
        .withColumn(name, F.col("_start") + F.row_number().over(in_range) - 1)
        .drop("_range", "_start")
    )


def running_sum(df: DataFrame, keys: Sequence[Column], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with each one, as :func:`global_index`."""
    ranged, count = _in_ranges(df, keys, ranges)
    upto = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(_before_ranges(ranged, F.sum(value), count), "_range")
        .withColumn(name, F.col("_start") + F.sum(value).over(upto))
        .drop("_range", "_start")
    )


def with_positions(logs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``log_date`` and ``pos`` to a stored table; see :func:`global_index`."""
    undated = F.lit((1 << 63) - 1)
    keys = [F.coalesce(F.unix_micros("ts"), undated), F.col("line_number")]
    return global_index(with_log_date(logs), keys, "pos", partitions)


def block_of(pos: Column | str, rows: int = BLOCK_ROWS) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(rows)).cast("long")


def block_starts(df: DataFrame, by: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows per position block and the number of rows before it (per ``by`` key).

    Two-level prefix sum: the outer level has one row per 4096 blocks.
    """
    by = list(by)
    counts = (
        df.groupBy(*by, block_of("pos", rows).alias("_block"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_group", block_of("_block", BLOCKS_PER_GROUP))
    )
    before = (Window.unboundedPreceding, -1)
    in_group = Window.partitionBy(*by, "_group").orderBy("_block").rowsBetween(*before)
    groups = counts.groupBy(*by, "_group").agg(F.sum("_n").alias("_group_n"))
    over_groups = Window.partitionBy(*by).orderBy("_group").rowsBetween(*before)
    group_start = groups.select(
        *by, "_group", F.coalesce(F.sum("_group_n").over(over_groups), F.lit(0)).alias("_group_start")
    )
    return (
        counts.withColumn("_in_group", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
        .join(group_start, [*by, "_group"])
        .select(*by, "_block", "_n", (F.col("_group_start") + F.col("_in_group")).alias("_start"))
    )


def dense_index(df: DataFrame, name: str, by: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based index of each row in ``pos`` order, over all rows or within ``by`` keys."""
    by = list(by)
    blocked = df.withColumn("_block", block_of("pos", rows))
    in_block = Window.partitionBy(*by, "_block").orderBy("pos")
    return (
        blocked.withColumn("_rn", F.row_number().over(in_block))
        .join(block_starts(df, by, rows).drop("_n"), [*by, "_block"])
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .drop("_block", "_rn", "_start")
    )


def any_range(col: str, ranges: Sequence[tuple[int, int]]) -> Column:
    """``col`` lies in one of the inclusive ranges; literal bounds reach the Parquet scan."""
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    match = F.lit(False)
    for low, high in merged:
        match = match | F.col(col).between(low, high)
    return match



def rows_at_ranks(
    df: DataFrame,
    ranges: Sequence[tuple],
    by: str | None = None,
    name: str = "rank",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows whose dense index falls in a few inclusive ranges.

    ``ranges`` holds ``(low, high)``, or ``(key, low, high)`` for ranks within
    ``by``. Block counts locate the blocks first, so only those blocks are read
    and ranked; the wanted ranks are then joined. Ranks and the blocks that hold
    them are bounded by the caller's list.
    """
    keys = [by] if by else []
    wanted: dict = {}
    for *key, low, high in ranges:
        wanted.setdefault(key[0] if by else None, set()).update(range(low, high + 1))
    if not wanted:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    spark = df.sparkSession
    starts = block_starts(df, keys, rows)
    if by:
        lists = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(sorted(v)).cast("array<long>"))])
        sought = F.try_element_at(lists, F.col(by))
    else:
        sought = F.lit(sorted(wanted[None])).cast("array<long>")
    holds = lower_bound(sought, F.col("_start") + F.col("_n")) > lower_bound(sought, F.col("_start"))
    found = starts.where(F.when(sought.isNotNull(), holds)).drop("_n")
    blocks = found.collect()
    spans = [(b["_block"] * rows, b["_block"] * rows + rows - 1) for b in blocks]
    local = spark.createDataFrame(blocks, found.schema)
    ranks = [(k, r) if by else (r,) for k, v in wanted.items() for r in sorted(v)]
    schema = [f for f in df.schema.fields if f.name == by]
    ranked = spark.createDataFrame(ranks, T.StructType([*schema, T.StructField(name, T.LongType())]))
    in_block = Window.partitionBy(*keys, "_block").orderBy("pos")
    return (
        df.where(any_range("pos", spans))
        .withColumn("_block", block_of("pos", rows))
        .withColumn("_rn", F.row_number().over(in_block))
        .join(F.broadcast(local), [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .join(F.broadcast(ranked), [*keys, name])
        .select(*df.columns, name)
    )


def with_halo(df: DataFrame, before: int, after: int, on: str = "pos", rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy each row into every block whose frames may reach it, as ``_halo``.

    A frame of ``before`` rows back and ``after`` rows ahead, partitioned by
    ``_halo``, then sees all it needs. Keep results with :func:`own_block`.
    """
    first = block_of(F.greatest(F.col(on) - after, F.lit(0)), rows)
    last = block_of(F.col(on) + before, rows)
    return df.withColumn("_halo", F.explode(F.sequence(first, last)))


def own_block(on: str = "pos", rows: int = BLOCK_ROWS) -> Column:
    return F.col("_halo") == block_of(on, rows)


def halo_frame(before: int, after: int, on: str = "pos"):
    """Row frame inside a halo block."""
    return Window.partitionBy("_halo").orderBy(on).rowsBetween(-before, after)


def halo_range(before: int, after: int, on: str = "pos"):
    """Value frame inside a halo block, for frames with gaps between positions."""
    return Window.partitionBy("_halo").orderBy(on).rangeBetween(-before, after)

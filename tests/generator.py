"""Synthetic error logs, one line per given row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siltlog.operators.order import BLOCK_ROWS, BLOCKS_PER_GROUP, block_of

# Start time, gap range in seconds and event weights.
START = "2005-12-04 04:47:44"
MAX_GAP = 30
WEIGHTS = (("worker_init", 0.35), ("child_found", 0.35), ("worker_error", 0.25), ("forbidden", 0.05))
DEFAULT_LINES = 3000
LINE_TIME = "EEE MMM dd HH:mm:ss yyyy"


def _draw(what: str, seed: int, low: int, high: int) -> Column:
    """A repeatable integer in [low, high] per row: a hash of the row number."""
    mixed = F.xxhash64(F.col("pos"), F.lit(what), F.lit(seed))
    return (F.pmod(mixed, F.lit(high - low + 1)) + low).cast("long")


def generate_lines(rows: DataFrame, seed: int = 0, blocks: int = BLOCK_ROWS) -> DataFrame:
    """``(line_number, value)`` for rows with a unique ``pos``; gaps accumulate in ``pos`` order.

    The running time is a prefix sum: seconds per block first, then within it.
    """
    gaps = rows.select("pos").withColumn("gap", _draw("gap", seed, 1, MAX_GAP))
    per_block = gaps.groupBy(block_of("pos", blocks).alias("pos")).agg(F.sum("gap").alias("_sum"))
    # Block sums become positions of a running total again; one row per block.
    group = block_of("pos", BLOCKS_PER_GROUP)
    sums = per_block.withColumn("_group", group)
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_group").orderBy("pos").rowsBetween(*before)
    outer = Window.orderBy("_group").rowsBetween(*before)
    groups = sums.groupBy("_group").agg(F.sum("_sum").alias("_g")).select(
        "_group", F.coalesce(F.sum("_g").over(outer), F.lit(0)).alias("_group_start")
    )
    starts = (
        sums.withColumn("_inner", F.coalesce(F.sum("_sum").over(inner), F.lit(0)))
        .join(groups, "_group")
        .select(F.col("pos").alias("_block"), (F.col("_inner") + F.col("_group_start")).alias("_start"))
    )
    in_block = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        gaps.withColumn("_block", block_of("pos", blocks))
        .withColumn("_run", F.sum("gap").over(in_block))
        .join(starts, "_block")
        .withColumn(
            "ts", F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("_start") + F.col("_run"))
        )
    )
    pick = _draw("event", seed, 0, 99)
    octets = [_draw(f"octet{i}", seed, 1, 255).cast("string") for i in range(4)]
    text = (
        F.when(pick < 35, F.lit("[notice] workerEnv.init() ok /etc/httpd/conf/workers2.properties"))
        .when(
            pick < 70,
            F.format_string(
                "[notice] jk2_init() Found child %d in scoreboard slot %d",
                _draw("child", seed, 1000, 33000),
                _draw("slot", seed, 6, 12),
            ),
        )
        .when(
            pick < 95,
            F.format_string("[error] mod_jk child workerEnv in error state %d", _draw("state", seed, 6, 10)),
        )
        .otherwise(
            F.concat(
                F.lit("[error] [client "),
                F.concat_ws(".", *octets),
                F.lit("] Directory index forbidden by rule: /var/www/html/"),
            )
        )
    )
    stamp = F.concat(F.lit("["), F.date_format("ts", LINE_TIME), F.lit("] "))
    return timed.select((F.col("pos") + 1).alias("line_number"), F.concat(stamp, text).alias("value"))


def generate(spark: SparkSession, lines: int = DEFAULT_LINES, seed: int = 0) -> DataFrame:
    return generate_lines(spark.range(lines).withColumnRenamed("id", "pos"), seed)

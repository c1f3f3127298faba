"""Small tables kept next to the log table of a store: built once, by the first who asks.

Each is stored by run and day like the log table, so a new version builds them for the
days it wrote and goes on using those of all others.

* ``lines``: where each line number is, sorted by it, with a Bloom filter.
* ``cube``: counts, times and a mergeable sketch of fingerprints per level and quarter
  of an hour.
* ``blocks``: the blocks of 4,096 positions that hold a fingerprint, sorted by it.
* ``trigrams``: the blocks in which three characters stand next to each other in some
  lower-cased line, sorted by them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.functions.times import bucket_start
from siltlog.operators.order import block_of

BLOCK = 4096
SKETCH_BITS = 12  # the standard error of a count of distinct fingerprints is 1.04 / sqrt(2**12), 1.6 %


@dataclass(frozen=True)
class Kept:
    """``build`` makes the table from logs; rows are sorted by ``order`` in their files."""

    schema: str
    build: Callable[[DataFrame], DataFrame]
    order: str
    options: tuple[tuple[str, str], ...] = ()


def _lines(logs: DataFrame) -> DataFrame:
    return logs.select("line_number", "pos", "log_date").repartitionByRange("log_date", "line_number")


def _cube(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_date", "level", bucket_start(F.col("ts")).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.min("pos").alias("first_pos"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.hll_sketch_agg("fingerprint", F.lit(SKETCH_BITS)).alias("sketch"),
    )


def _blocks(logs: DataFrame) -> DataFrame:
    held = logs.groupBy("log_date", "fingerprint", block_of("pos", BLOCK).alias("block")).agg(F.count("*").alias("n"))
    # At most as many blocks as the day has.
    listed = held.groupBy("log_date", "fingerprint").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("block")).alias("blocks"))
    return listed.repartitionByRange("log_date", "fingerprint")


def trigrams(text: Column) -> Column:
    """The runs of three characters of a text, repeats included; none if it is shorter.

    One compiled pass over the text: lambdas over its single characters took a
    millisecond a line, and a substring at each place reads a long line once a place.
    """
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))."), F.lit(1))


def _trigrams(logs: DataFrame) -> DataFrame:
    # Rows of a block are next to each other, so a task ships each of its trigrams once.
    rows = logs.select("log_date", block_of("pos", BLOCK).alias("block"), F.explode(trigrams(F.lower("raw"))).alias("trigram"))
    held = rows.distinct()
    listed = held.groupBy("log_date", "trigram").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return listed.repartitionByRange("log_date", "trigram")


TABLES = {
    "lines": Kept(
        "line_number long, pos long, log_date string",
        _lines,
        "line_number",
        (("parquet.bloom.filter.enabled#line_number", "true"),),
    ),
    "cube": Kept(
        "level string, bucket timestamp, n long, first_pos long, first_ts timestamp, last_ts timestamp, sketch binary, log_date string",
        _cube,
        "bucket",
    ),
    "trigrams": Kept("trigram string, blocks array<long>, log_date string", _trigrams, "trigram"),
    "blocks": Kept("fingerprint string, n long, blocks array<long>, log_date string", _blocks, "fingerprint"),
}

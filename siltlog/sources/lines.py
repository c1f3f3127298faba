"""Line sources: text files, folders and in-memory lists, numbered over non-blank lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltlog.functions.text import is_blank
from siltlog.session import broadcast_if_small, materialize
from siltlog.sources.formats import (
    DETECTION_LINES,
    FORMATS,
    LogFormat,
    by_elected_format,
    detect_format,
    elected_formats,
    parse,
    parse_any,
)

# Accepted file names.
ACCEPTED_FILES = "*.{log,txt}"
FEW_BLOCKS = 200_000
FILES_TOGETHER = 64


def _text(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).where(~is_blank(F.col("value")))


def with_block(lines: DataFrame) -> DataFrame:
    """Keep where each line came from: its file and its block's offset in the file."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def landed(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Write lines (or what was parsed from them) with their place in the input, once.

    ``_file`` and ``_block`` say where a line comes from and ``_seq`` orders the
    lines of a block. Counts and rows must come from one reading of the files: a
    second one may cut them into other blocks, or find them longer.
    """
    marked = lines.withColumn("_seq", F.monotonically_increasing_id())
    if path is None:
        return materialize(marked, "landed-lines")
    marked.write.mode("overwrite").parquet(path)
    return marked.sparkSession.read.schema(marked.schema).parquet(path)


def first_lines(rows: DataFrame, n: int = DETECTION_LINES) -> DataFrame:
    """``_file, value``: the first ``n`` lines of each file of landed rows.

    Line counts of the blocks say which blocks hold them; only those lines travel.
    """
    block = ["_file", "_block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).where(F.col("_before") < n)
    needed = broadcast_if_small(materialize(needed.drop("_n"), "first-blocks"), FEW_BLOCKS)
    value = F.coalesce("_value", "raw") if "_value" in rows.columns else F.col("value")
    heads = rows.select(*block, "_seq", value.alias("value")).join(needed, block)
    return heads.where(F.col("_before") + F.col("_seq") - F.col("_first") < n).select("_file", "value")


def in_own_format(rows: DataFrame, undetected: str = "raise") -> DataFrame:
    """Landed rows of :func:`parse_any`, each by the format of its file.

    A file's format is the first one that matches half of its first five lines. If a
    file has none, ``undetected="raise"`` names up to five of them and ``"keep"``
    takes their lines as ``unknown``.
    """
    if undetected not in ("raise", "keep"):
        raise ValueError("undetected is 'raise' or 'keep'")
    found = materialize(elected_formats(first_lines(rows)), "file-formats")
    if undetected == "raise":
        lost = [r["_file"] for r in found.where("format IS NULL").orderBy("_file").limit(5).collect()]
        if lost or found.isEmpty():
            told = f" of {', '.join(lost)}" if lost else ""
            raise ValueError(f"Unable to detect log format{told}. Supported formats: " + ", ".join(FORMATS))
    elected = broadcast_if_small(found.select("_file", F.col("format").alias("_elected")), FEW_BLOCKS)
    return by_elected_format(rows.join(elected, "_file"))


def landed_records(lines: DataFrame, path: str, fmt: LogFormat | str | None = None) -> DataFrame:
    """Parse lines in one reading and land them: all in ``fmt``, or each file in its own format."""
    if fmt is not None:
        return landed(parse(lines, fmt, extras=True), path)
    return in_own_format(landed(parse_any(lines), path))


def number_landed(rows: DataFrame, first: int = 1) -> DataFrame:
    """Replace the place of each landed row by its ``line_number``, from ``first``.

    A line's number is the count of lines in earlier file blocks plus its place
    in its own block. Only the per-block counts, a column-pruned read, are
    ordered globally. Block counts are one row per split and are broadcast while
    they are few; beyond that each join group is one file block.
    """
    block = ["_file", "_block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(*before)
    # One row per file: the only globally ordered step, on file metadata.
    over_files = Window.orderBy("_file").rowsBetween(*before)
    file_start = (
        counts.groupBy("_file")
        .agg(F.sum("_n").alias("_n"))
        .select("_file", F.coalesce(F.sum("_n").over(over_files), F.lit(0)).alias("_file_start"))
    )
    starts = counts.withColumn("_in_file", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).join(file_start, "_file")
    starts = materialize(
        starts.select(*block, "_n", (F.col("_file_start") + F.col("_in_file") - F.col("_first")).alias("_shift")),
        "block-starts",
    )
    total, held = rows.count(), starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).head()[0]
    if total != held:
        raise RuntimeError(f"{total} landed lines, but {held} counted")
    few = broadcast_if_small(starts.drop("_n"), FEW_BLOCKS)
    rest = [c for c in rows.columns if c not in (*block, "_seq")]
    return rows.join(few, block).select((F.col("_seq") + F.col("_shift") + first).alias("line_number"), *rest)


def number_lines(lines: DataFrame) -> DataFrame:
    """``line_number`` and ``value`` in (file, offset) order over the lines of :func:`with_block`."""
    return number_landed(landed(lines))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Splittable text scan of one or more paths, numbered over non-blank lines."""
    return number_lines(placed_lines(spark, path))


def placed_lines(spark: SparkSession, path) -> DataFrame:
    """Non-blank lines with the file and block they come from."""
    return with_block(_text(spark, path))


def read_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.log`` and ``.txt`` files below a folder; other files are ignored."""
    # A pattern in the path keeps `_metadata` available and prunes the listing.
    return read_lines(spark, f"{folder.rstrip('/')}/{ACCEPTED_FILES}")


def detect_file_format(spark: SparkSession, path) -> LogFormat:
    """Detect from the head of the first files; stops after five non-blank lines.

    Files are looked at in groups that grow, so many empty ones cost few jobs; of
    each file at most five lines are read.
    """
    head: list[str] = []
    names = sorted(spark.read.text(path).inputFiles())
    at, size = 0, 1
    while at < len(names) and len(head) < DETECTION_LINES:
        heads = [
            _text(spark, name).limit(DETECTION_LINES).select(F.lit(i).alias("file"), "value")
            for i, name in enumerate(names[at : at + size])
        ]
        rows = reduce(DataFrame.unionByName, heads).collect()
        head += [r["value"] for r in sorted(rows, key=lambda r: r["file"])]
        at, size = at + size, min(8 * size, FILES_TOGETHER)
    return detect_format(lines_from_list(spark, head[:DETECTION_LINES]))


def lines_from_list(spark: SparkSession, values) -> DataFrame:
    """Lines already held by the caller; line breaks inside an item split it."""
    if isinstance(values, str):
        values = [values]
    rows = [line for value in values for line in value.replace("\r\n", "\n").split("\n")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "item long, value string")
    kept = df.where(~is_blank(F.col("value")))
    order = Window.orderBy("item")  # bounded by the caller's own list
    return kept.select(F.row_number().over(order).cast("long").alias("line_number"), "value")

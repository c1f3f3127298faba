"""Streaming ingest. Parsing is stateless; positions are assigned in batch over the sink."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from siltlog.functions.text import is_blank
from siltlog.functions.times import bucket_start
from siltlog.schema import LOG_SCHEMA
from siltlog.session import remove
from siltlog.sources.formats import LogFormat, numbered, parse
from siltlog.sources.lines import landed_records, number_landed, with_block
from siltlog.sources import versions
from siltlog.sources.store import LogStore


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Text lines as they arrive, with the file and block they came from."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_block(reader.text(folder).where(~is_blank(F.col("value"))))


def parse_stream(lines: DataFrame, fmt: LogFormat | str) -> DataFrame:
    """Stateless parse for streaming aggregates, where line numbers do not matter."""
    return parse(lines.select(F.lit(0).cast("long").alias("line_number"), "value"), fmt)


def _last_line(spark: SparkSession, sink: str, epoch: int) -> int:
    """Last line number before an epoch; reads the epoch before it, rarely more."""
    if epoch == 0:
        return 0
    stored = spark.read.schema(T.StructType([*LOG_SCHEMA.fields, T.StructField("epoch", T.LongType())])).parquet(sink)
    for earlier in (F.col("epoch") == epoch - 1, F.col("epoch") < epoch):
        last = stored.where(earlier).agg(F.max("line_number")).head()[0]
        if last is not None:
            return last
    return 0


def start_ingest(lines: DataFrame, sink: str, checkpoint: str, fmt: LogFormat | str | None = None) -> StreamingQuery:
    """Number, parse and append each micro-batch; line numbers continue over batches.

    Without ``fmt`` each file is read in the format its first lines show; a file
    arrives in one batch.

    Each batch owns one ``epoch`` folder and overwrites it, so a batch replayed
    after a failure leaves the same rows.
    """

    def land(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stage = f"{sink}-staging/epoch={epoch}"
        rows = number_landed(landed_records(batch, stage, fmt), _last_line(spark, sink, epoch) + 1)
        numbered(rows).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        remove(spark, stage)

    return (
        lines.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finalize(spark: SparkSession, sink: str, path: str | None = None) -> LogStore:
    """Order what the stream has written into a store.

    A store that holds earlier epochs already takes the new ones only: days before
    their first row are left as they are.
    """
    epochs = [int(e) for e in versions.subfolders(spark, sink, "epoch")]
    held = versions.read(spark, path) if path else None
    rows = spark.read.parquet(sink)
    if held is None or not held.epochs:
        return LogStore.ingest(rows, path, sink, landed=True, epochs=epochs)
    store = LogStore.open(spark, path)
    new = sorted(set(epochs) - set(held.epochs))
    return store.append(rows.where(F.col("epoch").isin(new)).drop("epoch"), new) if new else store


def window_counts(parsed: DataFrame, minutes: int = 15) -> DataFrame:
    """Rows per level and N-minute window; undated rows are in none."""
    return (
        parsed.where(F.col("ts").isNotNull())
        .groupBy(bucket_start(F.col("ts"), minutes).alias("bucket"), "level")
        .agg(F.count("*").alias("n"))
    )


def start_counts(
    parsed: DataFrame, path: str, checkpoint: str, minutes: int = 15, compact_every: int = 100
) -> StreamingQuery:
    """Write the counts of each micro-batch; :func:`read_counts` adds them up.

    Each batch owns one ``epoch`` folder and overwrites it, so replays are safe. No
    window is ever closed, so late lines and the end of the data count as well.
    Every ``compact_every`` batches the epochs are added up into one generation, so
    the number of folders stays below twice that.
    """

    def land(batch: DataFrame, epoch: int) -> None:
        window_counts(batch, minutes).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if epoch and epoch % compact_every == 0:
            compact_counts(batch.sparkSession, path)

    return (
        parsed.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


COUNT_SCHEMA = "bucket timestamp, level string, n long"


def _count_parts(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The epoch the latest generation goes up to (-1: none), and the epochs behind it."""
    through = max([int(g) for g in versions.subfolders(spark, f"{path}-generations", "through")], default=-1)
    return through, sorted(e for e in map(int, versions.subfolders(spark, path, "epoch")) if e > through)


def _added_up(spark: SparkSession, path: str, through: int, epochs: list[int]) -> DataFrame:
    folders = [f"{path}-generations/through={through}"] * (through >= 0) + [f"{path}/epoch={e}" for e in epochs]
    if not folders:
        return spark.createDataFrame([], COUNT_SCHEMA)
    return reduce(DataFrame.unionByName, [spark.read.schema(COUNT_SCHEMA).parquet(f) for f in folders]).groupBy(
        "bucket", "level"
    ).agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, level, n`` over everything the stream has counted so far."""
    return _added_up(spark, path, *_count_parts(spark, path))


def compact_counts(spark: SparkSession, path: str) -> int:
    """Add all epochs but the last one, which may be replayed, up into one generation.

    The generation counts from when its folder has its name; only then do the epochs it
    holds go. Returns the epoch it goes up to.
    """
    through, epochs = _count_parts(spark, path)
    if len(epochs) < 2:
        return through
    draft = f"{path}-generations/_draft-{uuid4().hex}"
    _added_up(spark, path, through, epochs[:-1]).coalesce(1).write.parquet(draft)
    versions.rename(spark, draft, f"{path}-generations/through={epochs[-2]}")
    for epoch in epochs[:-1]:
        remove(spark, f"{path}/epoch={epoch}")
    if through >= 0:
        remove(spark, f"{path}-generations/through={through}")
    return epochs[-2]

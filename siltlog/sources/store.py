"""The parsed-log store: an ordered log table and its pattern table, as Parquet.

``logs`` is sorted by ``pos`` and partitioned by day, so time and position
filters skip row groups. ``patterns`` is small next to it and is what most
reports read; it is put together from counts of each day. An ingest writes folders
of its own and then commits them as the next version, so readers see one
version or the other and a failed ingest changes nothing.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siltlog.operators.order import with_log_date, with_positions
from siltlog.operators.patterns import merged_patterns, patterns_of
from siltlog.schema import EXTRA_SCHEMA, LOG_COLUMNS, PATTERN_SCHEMA, STORED_LOG_SCHEMA
from siltlog.session import release_later, remove, utc_session, working_path
from siltlog.sources import versions
from siltlog.sources.formats import LogFormat, numbered
from siltlog.sources.kept import TABLES
from siltlog.sources.lines import landed_records, number_landed, placed_lines

# Fixed value: file name of the sample log.
DEFAULT_LOG = "Apache_2k.log"


# A stage is read three times, by at most one task a row group: small ones keep all cores busy
# however few tasks have written it.
STAGE_OPTIONS = {"parquet.block.size": str(4 << 20)}

# Patterns of one day, and where they are kept.
PARTS = "patterns/parts"
PART_SCHEMA = StructType([*PATTERN_SCHEMA.fields]).add("log_date", "string")


def _with_extras(parsed: DataFrame) -> DataFrame:
    """The columns of the log table; fields the format lacks are null."""
    extras = [
        F.col(f.name) if f.name in parsed.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in EXTRA_SCHEMA.fields
    ]
    return parsed.select(*LOG_COLUMNS, *extras)


@dataclass(frozen=True)
class LogStore:
    """One version of a store; :meth:`open` takes the latest."""

    spark: SparkSession
    path: str
    source: str = "unknown"
    version: versions.Version = field(default_factory=versions.Version, compare=False)

    @property
    def logs(self) -> DataFrame:
        """All rows with ``pos`` and ``log_date``."""
        return self._days("logs", STORED_LOG_SCHEMA)

    @property
    def patterns(self) -> DataFrame:
        """One row per fingerprint; ``pos`` is that of its first row."""
        if self.version.patterns is None:
            return self.spark.createDataFrame([], PATTERN_SCHEMA)
        return self.spark.read.schema(PATTERN_SCHEMA).parquet(f"{self.path}/patterns/run={self.version.patterns}")

    def kept(self, name: str) -> DataFrame:
        """A table of :mod:`siltlog.sources.kept` for this version; runs that lack it get it now.

        A run's table counts once it is written to the end, so an early end or two
        builders at once do no harm.
        """
        table = TABLES[name]
        for run in sorted(set(self.version.days.values())):
            folder = f"{self.path}/{name}/run={run}"
            if not versions.exists(self.spark, f"{folder}/_SUCCESS"):
                logs = self.spark.read.schema(STORED_LOG_SCHEMA).parquet(f"{self.path}/logs/run={run}")
                rows = table.build(logs).sortWithinPartitions("log_date", table.order)
                rows.write.options(**dict(table.options)).mode("overwrite").partitionBy("log_date").parquet(folder)
        return self._days(name, StructType.fromDDL(table.schema))

    def _days(self, table: str, schema: StructType, days: Collection[str] | None = None) -> DataFrame:
        """The rows of some days, all by default, of a table that is stored by run and day."""
        folders = self.version.folders(table, days)
        runs = set(self.version.days.values())
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{table}"
        if days is None and len(runs) == 1:
            return self.spark.read.schema(schema).parquet(f"{base}/run={runs.pop()}")
        with_run = StructType([*schema.fields]).add("run", "string")
        rows = self.spark.read.schema(with_run).option("basePath", base).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.select(*schema.fieldNames())

    @classmethod
    def open(cls, spark: SparkSession, path: str, source: str | None = None) -> LogStore:
        version = versions.read(utc_session(spark), path)
        if version is None:
            raise FileNotFoundError(f"no store at {path}")
        return cls(spark, path, source or version.source, version)

    @classmethod
    def ingest(
        cls,
        parsed: DataFrame,
        path: str | None = None,
        source: str = "unknown",
        partitions: int | None = None,
        landed: bool = False,
        epochs: Collection[int] = (),
    ) -> LogStore:
        """Order parsed rows, write a new version of the store and return it.

        Positions need the rows three times, for a sample, for counts and for the
        one shuffle, so parsed rows are staged below ``path`` first and the stage is
        removed once the version is written. ``landed`` says that ``parsed`` is
        a plain table scan already. What an earlier version held is replaced as a
        whole; it stays readable until then, and is deleted by ``release``.
        """
        spark = utc_session(parsed.sparkSession)
        store = cls(spark, path or working_path(spark, "log-store"), source)
        rows = _with_extras(parsed)
        stage = store._staging()
        if not landed:
            rows.write.options(**STAGE_OPTIONS).mode("overwrite").parquet(f"{stage}/parsed")
            rows = spark.read.schema(rows.schema).parquet(f"{stage}/parsed")
        done = store._replace(rows, (), partitions, epochs)
        remove(spark, stage)
        return done

    def append(self, parsed: DataFrame, epochs: Collection[int] = ()) -> LogStore:
        """A new version with more rows, a plain table scan of parsed ones.

        Rows are put in order from the first day they belong to: the folders of
        earlier days are neither read nor written, and their positions stay.
        """
        rows = _with_extras(parsed)
        days = [r["log_date"] for r in with_log_date(rows).select("log_date").distinct().collect()]  # one row per day
        kept = [day for day in self.version.days if day < min(days, default="")] if days else list(self.version.days)
        redone = [day for day in self.version.days if day not in kept]
        again = self._days("logs", STORED_LOG_SCHEMA, redone) if redone else None
        merged = rows if again is None else again.select(*rows.columns).unionByName(rows)
        return self._replace(merged, kept, None, [*self.version.epochs, *epochs])

    def _staging(self) -> str:
        return f"{self.path}/_staging-{uuid4().hex}"

    def _replace(self, rows: DataFrame, kept: Collection[str], partitions: int | None, epochs: Collection[int]) -> LogStore:
        """Write ``rows`` behind the days that are kept, and commit both as a new version.

        Nothing of an earlier version is written over; days and patterns of a run
        that doesn't get as far as its commit belong to no version.
        """
        before = versions.read(self.spark, self.path)
        run = uuid4().hex
        base = sum(self.version.rows[day] for day in kept)
        placed = with_positions(rows, partitions).withColumn("pos", F.col("pos") + F.lit(base))
        ordered = placed.sortWithinPartitions("log_date", "pos")
        ordered.write.partitionBy("log_date").parquet(f"{self.path}/logs/run={run}")
        written = self.spark.read.schema(STORED_LOG_SCHEMA).parquet(f"{self.path}/logs/run={run}")
        parts = patterns_of(written, by=("log_date", "fingerprint"))
        parts.write.partitionBy("log_date").parquet(f"{self.path}/{PARTS}/run={run}")
        counted = self.spark.read.schema(PART_SCHEMA).parquet(f"{self.path}/{PARTS}/run={run}")
        counts = counted.groupBy("log_date").agg(F.sum("occurrence_count").alias("n")).collect()  # one row per day
        number = (before.number if before else 0) + 1
        days = {day: self.version.days[day] for day in kept} | {r["log_date"]: run for r in counts}
        held = {day: self.version.rows[day] for day in kept} | {r["log_date"]: r["n"] for r in counts}
        version = versions.Version(number, self.source, days, held, run, sorted(set(epochs)))
        new = LogStore(self.spark, self.path, self.source, version)
        merged = merged_patterns(new._days(PARTS, PART_SCHEMA))
        merged.write.parquet(f"{self.path}/patterns/run={run}")
        versions.commit(self.spark, self.path, version)
        new._outdate(before)
        return new

    def _outdate(self, before: versions.Version | None) -> None:
        """Folders that only the version before needs go when the session's tables are released."""
        if before is None:
            return
        for table in ("logs", PARTS, *TABLES):
            live = set(self.version.folders(table))
            release_later(self.spark, *[f"{self.path}/{f}" for f in before.folders(table) if f not in live])
        release_later(self.spark, f"{self.path}/patterns/run={before.patterns}")

    @classmethod
    def ingest_file(
        cls, spark: SparkSession, source, path: str | None = None, fmt: LogFormat | str | None = None
    ) -> LogStore:
        """Read text files, detect the format of each unless it is named, parse and store.

        The text is read once: parsed lines are staged with their place in the
        files, numbered from that stage and shuffled once into the store.
        """
        store = cls(utc_session(spark), path or working_path(spark, "log-store"), str(source))
        stage = store._staging()
        rows = numbered(number_landed(landed_records(placed_lines(spark, source), f"{stage}/parsed", fmt)))
        done = store._replace(_with_extras(rows), (), None, ())
        remove(spark, stage)
        return done

    @classmethod
    def load_default(cls, spark: SparkSession, folder: str, path: str | None = None) -> LogStore:
        """Ingest the sample log kept in ``folder``."""
        return cls.ingest_file(spark, f"{folder.rstrip('/')}/{DEFAULT_LOG}", path)

    def summary(self) -> DataFrame:
        """One row describing the ingest."""
        lost = (F.col("level") == "unknown") & F.col("ts").isNull()
        return self.logs.agg(
            F.lit(self.source).alias("source"),
            F.count("*").alias("total_lines"),
            F.count("*").alias("parsed_lines"),
            F.count_if(lost).alias("unmatched_lines"),
            F.lit(0).cast("long").alias("parse_errors"),
        ).withColumn("unique_patterns", self.patterns.agg(F.count("*")).scalar())

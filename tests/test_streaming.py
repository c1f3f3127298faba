"""Streaming ingest and counts give the batch results."""

from pyspark.sql import functions as F

from siltlog.sources.formats import parse
from siltlog.sources.lines import read_lines
from siltlog.sources.store import LogStore
from siltlog.streaming.ingest import (
    finalize,
    parse_stream,
    read_counts,
    start_counts,
    start_ingest,
    stream_lines,
)

STAMP = "[Sun Dec 04 {:02d}:{:02d}:00 2005] [{}] message {}"


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n\n".join(lines) + "\n")


def lines(start, n):
    return [STAMP.format(i // 60, i % 60, "warn" if i % 3 else "info", i) for i in range(start, start + n)]


def test_ingest_over_restarts_equals_batch(spark, tmp_path):
    folder, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")
    write(folder, "a.log", lines(0, 50))
    start_ingest(stream_lines(spark, str(folder)), sink, state, "apache").awaitTermination()
    write(folder, "b.log", lines(50, 70) + ["loose"])
    start_ingest(stream_lines(spark, str(folder)), sink, state, "apache").awaitTermination()
    columns = ["pos", "id", "line_number", "level", "message", "fingerprint"]
    streamed = finalize(spark, sink).logs.select(*columns).orderBy("pos").collect()
    batch = LogStore.ingest(parse(read_lines(spark, str(folder)), "apache"))
    assert streamed == batch.logs.select(*columns).orderBy("pos").collect()
    assert len(streamed) == 121


def test_counts_hold_late_lines_and_the_end(spark, tmp_path):
    folder, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")

    def run():
        start_counts(parse_stream(stream_lines(spark, str(folder)), "apache"), sink, state).awaitTermination()

    write(folder, "a.log", lines(200, 100) + ["loose"])
    run()
    write(folder, "b.log", lines(0, 200))  # hours late
    run()
    got = read_counts(spark, sink)
    assert got.agg(F.sum("n")).head()[0] == 300
    assert got.select("bucket").distinct().count() == 20
    assert got.where("bucket = timestamp '2005-12-04 03:15:00' AND level = 'warn'").head()["n"] == 10

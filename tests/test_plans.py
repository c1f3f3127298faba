"""Plans: no Python in the relational operators, filters at the scan, bounded windows."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks.fixtures import Inputs
from siltlog.operators import chains, context, select
from siltlog.operators import patterns as P
from siltlog.sources import formats
from tests.conftest import SF_DIR


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF_DIR)


def test_parsing_is_a_narrow_projection(inputs):
    text = plan(inputs.parsed())
    assert "Exchange" not in text and "Python" not in text


def test_filters_reach_the_scan(inputs):
    text = plan(select.by_time_range(select.by_level(inputs.logs, "warn"), "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "EqualTo(level,warn)" in pushed and "GreaterThanOrEqual(ts" in pushed
    assert "log_date" in re.search(r"PartitionFilters: (.*)", text).group(1)


def test_page_reads_by_position(inputs):
    pushed = re.search(r"PushedFilters: (.*)", plan(select.page(inputs.logs, 3))).group(1)
    assert "GreaterThanOrEqual(pos,100)" in pushed


def test_pattern_counts_use_a_hash_aggregate_over_three_columns(inputs):
    text = plan(P.pattern_counts(inputs.logs))
    assert "HashAggregate" in text and "SortAggregate" not in text
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert schema == "struct<ts:timestamp,fingerprint:string,pos:bigint>"


def test_escalations_move_only_narrow_columns(inputs):
    for schema in re.findall(r"ReadSchema: (.*)", plan(chains.escalations(inputs.logs))):
        assert "raw" not in schema and "message" not in schema


@pytest.mark.parametrize("kind", ["context", "chains", "frames", "members"])
def test_row_windows_are_partitioned(inputs, kind):
    logs = inputs.logs
    df = {
        "context": lambda: context.error_context(logs, few=0),
        "chains": lambda: chains.escalations(logs),
        "frames": lambda: context.frame_counts(logs),
        "members": lambda: P.pattern_members(logs),
    }[kind]()
    text = plan(df)
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # The only unpartitioned window is over groups of 4096 blocks.
    for window in re.findall(r"windowspecdefinition\(([^)]*)\)", text):
        first = window.split(",")[0]
        assert not re.match(r"(pos|rank|ts)#\d+L? ASC", first), window


def test_few_centres_only_scan(inputs):
    text = plan(context.error_context(inputs.logs))
    assert "BroadcastHashJoin" in text and "Window" not in text


def test_detection_reads_five_lines(inputs):
    votes = formats.format_votes(inputs.lines())
    assert "event_id" in plan(votes) and votes.where("accepted").count() == 1


def test_queries_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_dense_rank_of_levels(inputs):
    total = inputs.logs.groupBy("level").agg(F.count("*").alias("n")).agg(F.sum("n")).head()[0]
    assert total == inputs.events.count()


def test_lines_survive_other_splits(spark, tmp_path):
    """The text is read once: later changes of the split size, or of the files, lose nothing."""
    from siltlog.sources.lines import read_lines

    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(10_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        (tmp_path / "a.log").write_text("gone")
        rows = lines.orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["line_number"], r["value"]) for r in rows] == [(i + 1, f"line {i}") for i in range(10_000)]


def test_ingest_leaves_no_stage(spark, tmp_path):
    import os

    from siltlog.sources.store import LogStore

    (tmp_path / "a.log").write_text('10.0.0.1 - - [04/Dec/2005:04:47:44 +0000] "GET / HTTP/1.1" 200 12 "-" "curl"\n' * 20)
    store = LogStore.ingest_file(spark, str(tmp_path / "a.log"), str(tmp_path / "store"))
    assert sorted(os.listdir(tmp_path / "store")) == ["logs", "patterns"]
    row = store.logs.head()
    assert (row["ip"], row["size"], row["user_agent"], store.logs.count()) == ("10.0.0.1", 12, "curl", 20)


def test_release_deletes_working_tables(spark, monkeypatch, tmp_path):
    import os

    from siltlog import session

    monkeypatch.setattr(session, "_WRITTEN", {})
    path = session.materialize(spark.range(3).toDF("x"), "scrap").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and session.release(spark) == 1 and not os.path.exists(path)

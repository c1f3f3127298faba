"""Versions of a store, incremental finalize, formats per file."""

import os

import pytest
from pyspark.sql import functions as F

from siltlog.operators import patterns as P
from siltlog.session import release
from siltlog.sources import formats, store as store_module, versions
from siltlog.sources.formats import parse
from siltlog.sources.lines import read_lines
from siltlog.sources.store import LogStore
from siltlog.streaming.ingest import finalize, start_ingest, stream_lines

STAMP = "[Sun Dec {:02d} {:02d}:{:02d}:00 2005] [{}] message {}"
ACCESS = '10.0.0.{} - - [04/Dec/2005:04:{:02d}:00 +0000] "GET /x HTTP/1.1" {} 17'
COLUMNS = ["pos", "line_number", "id", "raw", "ts", "level", "message", "fingerprint", "log_date"]


def day(d, n, level="info", start=0):
    return [STAMP.format(d, i // 60, i % 60, level, i % 5) for i in range(start, start + n)]


def rows(store):
    return sorted(tuple(r) for r in store.logs.select(*COLUMNS).collect())


def pattern_rows(df):
    return sorted(map(str, df.select(*[f for f in store_module.PATTERN_SCHEMA.fieldNames()]).collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_ingest_that_ends_early_leaves_the_version_before(spark, numbered, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = LogStore.ingest(parse(numbered(day(4, 30)), "apache"), path)
    before = rows(first)

    def killed(*_, **__):
        raise KeyboardInterrupt

    for step in ("patterns_of", "merged_patterns"):
        with monkeypatch.context() as m:
            m.setattr(store_module, step, killed)
            with pytest.raises(KeyboardInterrupt):
                LogStore.ingest(parse(numbered(day(5, 10)), "apache"), path)
        assert rows(LogStore.open(spark, path)) == before and LogStore.open(spark, path).patterns.count() == 5
    second = LogStore.ingest(parse(numbered(day(6, 10, "warn")), "apache"), path)
    assert rows(first) == before and len(rows(second)) == len(rows(LogStore.open(spark, path))) == 10
    assert versions.numbers(spark, path) == [1, 2]
    with pytest.raises(RuntimeError):
        versions.commit(spark, path, second.version)
    with pytest.raises(FileNotFoundError):
        LogStore.open(spark, str(tmp_path / "none"))


def test_replaced_folders_go_with_release(spark, numbered, tmp_path):
    path = str(tmp_path / "store")
    LogStore.ingest(parse(numbered(day(4, 30)), "apache"), path)
    old = files(path)
    LogStore.ingest(parse(numbered(day(4, 20)), "apache"), path)
    release(spark)
    assert not set(old) & set(files(path))
    assert len(rows(LogStore.open(spark, path))) == 20 and LogStore.open(spark, path).patterns.count() == 5


def test_an_epoch_rewrites_only_the_days_from_its_first_one(spark, tmp_path):
    folder, sink, state, path = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state"), str(tmp_path / "store")
    folder.mkdir()

    def land(name, lines):
        (folder / name).write_text("\n".join(lines) + "\n")
        start_ingest(stream_lines(spark, str(folder)), sink, state, "apache").awaitTermination()
        return finalize(spark, sink, path)

    first = land("a.log", day(4, 40) + day(5, 30) + day(6, 20) + ["undated"])
    assert rows(land("b.log", day(6, 10, "warn", 100) + day(7, 5) + ["undated too"])) != rows(first)
    untouched = {f: t for f, t in files(f"{path}/logs").items() if "log_date=2005-12-04" in f or "log_date=2005-12-05" in f}
    # Neither read nor written: their files may even be gone while a later epoch is taken in.
    hidden = {f: f"{tmp_path}/hidden-{i}" for i, f in enumerate(untouched)}
    for f, to in hidden.items():
        os.rename(f, to)
    third = land("c.log", day(7, 3, "crit", 300))
    for f, to in hidden.items():
        os.rename(to, f)
    assert {f: files(f"{path}/logs")[f] for f in untouched} == untouched
    assert third.version.days["2005-12-04"] == first.version.days["2005-12-04"] != third.version.days["2005-12-07"]
    late = land("d.log", day(5, 2, "error", 500))
    assert late.version.days["2005-12-04"] == first.version.days["2005-12-04"] != late.version.days["2005-12-05"]
    assert finalize(spark, sink, path).version == late.version  # nothing new
    whole = LogStore.ingest(parse(read_lines(spark, str(folder)), "apache"))
    for store in (late, LogStore.open(spark, path)):
        assert rows(store) == rows(whole)
        assert pattern_rows(store.patterns) == pattern_rows(whole.patterns) == pattern_rows(P.patterns_of(whole.logs))
    assert late.logs.where("pos BETWEEN 41 AND 43").count() == 3
    assert late.logs.where(F.col("log_date") == "2005-12-07").count() == 8


def test_an_empty_store(spark, numbered, tmp_path):
    store = LogStore.ingest(parse(numbered([]), "apache"), str(tmp_path / "store"))
    assert store.logs.count() == 0 and store.patterns.count() == 0 and store.summary().head()["total_lines"] == 0
    assert LogStore.open(spark, store.path).append(parse(numbered(day(4, 3)), "apache")).logs.count() == 3


def write(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in named.items():
        (folder / f"{name}.log").write_text("\n".join(lines) + "\n")
    return str(folder)


MIXED = {
    "a": day(4, 7),
    "b": ["", "  ", *[ACCESS.format(i, i, 200 + 100 * (i % 4)) for i in range(9)], "junk"],
    "c": ["junk"] * 3 + day(4, 2),  # two of five are not half
    "d": ["junk"] * 2 + day(4, 3) + [ACCESS.format(1, 1, 500)],
    "e": ["", " "],
    "f": ['[a] [b] c [04/Dec/2005:04:47:00 +0000] "GET /y HTTP/1.1" 503 1', *[ACCESS.format(2, 2, 404)] * 4],
    "g": [f"   {line}" for line in day(4, 3)],  # detection looks at lines as they are
}


def test_every_file_is_read_in_its_own_format(spark, tmp_path):
    folder = write(tmp_path / "mixed", **MIXED)
    with pytest.raises(ValueError, match="c.log.*g.log"):
        LogStore.ingest_file(spark, folder)
    named = {"a": "apache", "b": "apache-access", "d": "apache", "f": "apache-access"}
    only = write(tmp_path / "named", **{n: MIXED[n] for n in (*named, "e")})
    store = LogStore.ingest_file(spark, only)
    got = sorted(tuple(r) for r in store.logs.select("line_number", "raw", "ts", "level", "message", "fingerprint", "ip", "size").collect())
    want, at = [], 0
    for name, fmt in named.items():
        lines = [line for line in MIXED[name] if line.strip()]
        df = spark.createDataFrame([(at + i, v) for i, v in enumerate(lines, 1)], "line_number long, value string")
        parsed = store_module._with_extras(parse(df, fmt, extras=True))
        want += [tuple(r) for r in parsed.select("line_number", "raw", "ts", "level", "message", "fingerprint", "ip", "size").collect()]
        at += len(lines)
    assert got == sorted(want)
    # The first line of f fits both formats; its file is an access log.
    assert [r for r in got if r[1].startswith("[a]")][0][3] == "error"


def test_files_without_a_format_can_be_kept(spark, tmp_path):
    from siltlog.sources.lines import in_own_format, landed, placed_lines

    folder = write(tmp_path / "mixed", **MIXED)
    kept = in_own_format(landed(formats.parse_any(placed_lines(spark, folder))), "keep")
    levels = {(r["_file"][-5:-4], r["level"]): r["count"] for r in kept.groupBy("_file", "level").count().collect()}
    assert levels[("c", "unknown")] == 5 and levels[("g", "unknown")] == 3 and levels[("a", "info")] == 7
    assert levels[("d", "unknown")] == 3 and levels[("d", "info")] == 3 and levels[("b", "unknown")] == 1
    with pytest.raises(ValueError, match="Unable to detect"):
        LogStore.ingest_file(spark, write(tmp_path / "empty", e=["", " "]))


def test_lines_of_one_row_group_are_parsed_by_several_tasks(spark, monkeypatch):
    from checks import fixtures
    from tests.conftest import SF_DIR

    inputs = fixtures.Inputs(spark, SF_DIR)
    given, ingested = inputs.parsed("access"), []
    monkeypatch.setattr(fixtures, "_STORES", {})
    monkeypatch.setattr(LogStore, "ingest", lambda rows, source: ingested.append(rows))
    inputs.store("access")
    (dealt,) = ingested
    assert given.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, dealt.collect())) == sorted(map(str, given.collect()))

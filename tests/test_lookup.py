"""Tables kept next to a store: the same results, from fewer row groups."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siltlog.operators import context, lookup, select, stats
from siltlog.session import working_path
from siltlog.sources import kept
from siltlog.sources.formats import parse
from siltlog.sources.store import LogStore
from siltlog.streaming.ingest import compact_counts, parse_stream, read_counts, start_counts, stream_lines

STAMP = "[Sun Dec {:02d} {:02d}:{:02d}:00 2005] [{}] {}"


@pytest.fixture(scope="module")
def store(spark, numbered):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "kappa"]
    lines = [
        STAMP.format(rng.randint(4, 8), rng.randrange(24), rng.randrange(60), rng.choice(["info", "warn", "error"]), " ".join(rng.choices(words, k=3)))
        for _ in range(3000)
    ] + ["undated"] * 5 + [STAMP.format(5, 1, 1, "crit", "only once")]
    return LogStore.ingest(parse(numbered(lines), "apache"), working_path(spark, "lookup-store"))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


IDS = ["log_00050", "log_00003", "log_99999", "log_00050", "log_02999", "nope", "log_0", "log_000050", "log_123456"]


def test_ids_are_found_through_the_line_index(spark, store, monkeypatch):
    found = lookup.by_ids(store, IDS)
    assert same(found, select.by_ids(store.logs, IDS)) and found.count() == 4
    assert same(lookup.requested_context(store, IDS, 3), context.requested_context(store.logs, IDS, 3))
    assert lookup.by_ids(store, ["nope"]).count() == 0 and lookup.by_ids(store, []).count() == 0
    # The log table is read by literal positions, the index by literal line numbers.
    assert "GreaterThanOrEqual(pos," in plan(found) and "In(line_number" in plan(store.kept("lines").where(F.col("line_number").isin([1, 50])))
    monkeypatch.setattr(lookup, "MOST_LISTED", 2)
    assert same(lookup.by_ids(store, IDS), select.by_ids(store.logs, IDS))
    assert same(lookup.requested_context(store, IDS, 3), context.requested_context(store.logs, IDS, 3))


def test_line_numbers_of_ids():
    assert [lookup.line_of(x) for x in ("log_00001", "log_99999", "log_100000", "log_0001", "log_000001", "log_1e5", "x")] == [
        1, 99999, 100000, None, None, None, None,
    ]


def test_only_blocks_with_a_fingerprint_are_read(spark, store, numbered, monkeypatch):
    monkeypatch.setattr(kept, "BLOCK", 64)
    monkeypatch.setattr(lookup, "BLOCK", 64)
    small = LogStore.ingest(store.logs.select(*[c for c in store.logs.columns if c not in ("pos", "log_date")]), working_path(spark, "block-store"))
    counts = {r["fingerprint"]: r["occurrence_count"] for r in small.patterns.collect()}
    once = [f for f, n in counts.items() if n == 1][0]
    for wanted in ([once], sorted(counts, key=counts.get)[:4], sorted(counts), ["no such"]):
        got = lookup.by_fingerprints(small, wanted)
        assert same(got, small.logs.where(F.col("fingerprint").isin(wanted)))
    # One block of 64 rows for a pattern of one row.
    at = small.logs.where(F.col("fingerprint") == once).head()["pos"] // 64 * 64
    assert f"GreaterThanOrEqual(pos,{at})" in plan(lookup.by_fingerprints(small, [once])) and f"LessThanOrEqual(pos,{at + 63})" in plan(lookup.by_fingerprints(small, [once]))
    monkeypatch.setattr(lookup, "MOST_LISTED", 1)
    assert same(lookup.by_fingerprints(small, sorted(counts)[:3]), small.logs.where(F.col("fingerprint").isin(sorted(counts)[:3])))


def test_a_search_reads_only_blocks_with_all_trigrams(spark, store, monkeypatch):
    monkeypatch.setattr(kept, "BLOCK", 64)
    monkeypatch.setattr(lookup, "BLOCK", 64)
    odd = store.logs.withColumn("raw", F.when(F.col("pos") % 97 == 0, F.concat(F.lit("Ünïcode 😀😀x"), "raw")).otherwise(F.col("raw")))
    small = LogStore.ingest(odd.select(*[c for c in store.logs.columns if c not in ("pos", "log_date")]), working_path(spark, "search-store"))
    for query in ("only ONCE", "alpha beta", "ünïc", "😀😀X", "ïcode kappa", "on ce", "zzz", "  ", "a", "gamma [e", "undated"):
        assert same(lookup.search(small, query), select.search(small.logs, query)), query
    at = select.search(small.logs, "only once").head()["pos"] // 64 * 64
    assert [r["block"] for r in lookup.blocks_with(small, "only once").collect()] == [at // 64]
    assert lookup.blocks_with(small, "on ce") is None and f"GreaterThanOrEqual(pos,{at})" in plan(lookup.search(small, "once"))
    monkeypatch.setattr(lookup, "MOST_LISTED", 1)
    assert same(lookup.search(small, "alpha beta"), select.search(small.logs, "alpha beta"))


def test_trigrams_are_taken_in_compiled_code(spark):
    """Thousands of lines a second, whatever their length, and every run of three characters."""
    texts = ["", "ab", "abc", "abcabc", "a\nb c", "Ünï😀😀x", None, "ab" * 30_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", F.explode(kept.trigrams(F.col("t"))).alias("x"))
    got = {i: set() for i in range(len(texts))}
    for r in found.distinct().collect():
        got[r["i"]].add(r["x"])
    assert got == {i: {t[k : k + 3] for k in range(len(t) - 2)} if t else set() for i, t in enumerate(texts)}
    made = kept.trigrams(F.col("t"))
    told = rows.select(made)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in told and "Python" not in told


def test_the_cube_equals_scans_and_grows_by_runs(spark, store, numbered):
    def check(s):
        assert same(lookup.count_by_level(s), stats.count_by_level(s.logs))
        assert same(lookup.time_range(s), stats.time_range(s.logs))
        assert same(lookup.time_buckets(s), stats.time_buckets(s.logs))
        assert same(lookup.hourly_buckets(s), stats.hourly_buckets(s.logs))
        assert same(lookup.store_stats(s), stats.store_stats(s.logs, s.patterns))
        exact = stats.unique_patterns(s.logs).head()[0]
        assert abs(lookup.about_unique_patterns(s).head()[0] - exact) <= 3 * 0.0163 * exact

    check(store)
    first = set(os.listdir(f"{store.path}/cube"))
    more = parse(numbered([STAMP.format(8, 23, 59, "warn", f"x{i}y") for i in range(400)] + ["undated"]), "apache")
    shifted = more.withColumn("line_number", F.col("line_number") + 10_000).withColumn("id", F.format_string("log_%05d", F.col("line_number")))
    grown = store.append(shifted)
    check(grown)
    assert first < set(os.listdir(f"{store.path}/cube"))
    assert grown.version.days["2005-12-07"] == store.version.days["2005-12-07"] != grown.version.days["2005-12-08"]
    assert lookup.by_ids(grown, ["log_10001", "log_00003"]).count() == 2 and lookup.by_ids(store, ["log_10001"]).count() == 0
    day = grown.logs.where("log_date = '2005-12-08'")
    exact = stats.unique_patterns(day).head()[0]
    assert abs(lookup.about_unique_patterns(grown, "2005-12-08", "2005-12-08").head()[0] - exact) <= 3 * 0.0163 * exact


def test_counts_are_compacted_into_one_generation(spark, tmp_path):
    folder, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.log").write_text("\n".join(STAMP.format(4, i % 3, m, "info", "x") for m in range(10 + i)) + "\n")

    def run():
        stream = stream_lines(spark, str(folder), files_per_batch=1)
        start_counts(parse_stream(stream, "apache"), sink, state, compact_every=3).awaitTermination()
        return sorted(map(str, read_counts(spark, sink).collect()))

    before = run()
    assert sorted(d for d in os.listdir(sink) if d.startswith("epoch=")) == ["epoch=6"]
    assert [d for d in os.listdir(f"{sink}-generations") if not d.startswith(".")] == ["through=5"]
    assert read_counts(spark, sink).agg(F.sum("n")).head()[0] == sum(10 + i for i in range(7))
    assert compact_counts(spark, sink) == 5 and sorted(map(str, read_counts(spark, sink).collect())) == before
    (folder / "late.log").write_text(STAMP.format(4, 0, 0, "info", "x") + "\n")
    run()
    assert read_counts(spark, sink).agg(F.sum("n")).head()[0] == sum(10 + i for i in range(7)) + 1
    assert read_counts(spark, str(tmp_path / "none")).count() == 0

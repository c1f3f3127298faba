"""Patterns, statistics, filters and context groups."""

from pyspark.sql import functions as F

from siltlog.functions.times import iso_text
from siltlog.operators import context, patterns as P, select, signals, stats
from siltlog.sources.store import LogStore

STAMP = "[Sun Dec 04 04:47:{:02d} 2005] [{}] {}"


def test_pattern_takes_its_first_row_in_time(ingested):
    store = ingested(
        [
            STAMP.format(30, "error", "child 5 died"),
            STAMP.format(10, "error", "child 7 died"),
            STAMP.format(20, "error", "child 6 died"),
        ]
    )
    (row,) = store.patterns.collect()
    assert (row["id"], row["message"], row["occurrence_count"]) == ("log_00002", "child 7 died", 3)
    assert (row["first_seen"].second, row["last_seen"].second) == (10, 30)


def test_last_seen_is_null_when_a_member_has_no_time(ingested):
    store = ingested(
        [STAMP.format(10, "error", "same"), "[Sun Feb 31 04:47:44 2005] [error] same", "loose", "loose"]
    )
    mixed, undated = store.patterns.orderBy("pos").collect()
    assert mixed["first_seen"] is not None and mixed["last_seen"] is None
    assert (undated["first_seen"], undated["last_seen"], undated["occurrence_count"]) == (None, None, 2)


def test_statuses_merge_and_the_first_one_shows(numbered):
    from siltlog.sources.formats import parse

    line = '1.1.1.1 - - [01/Jul/2026:14:58:{:02d} +0000] "GET /a/{} HTTP/1.1" {} 5'
    store = LogStore.ingest(parse(numbered([line.format(9, 1, 404), line.format(3, 2, 403)]), "apache-access"))
    (row,) = store.patterns.collect()
    assert (row["message"], row["occurrence_count"]) == ("GET /a/2 - Status 403", 2)


def test_reingest_replaces(ingested, numbered, tmp_path):
    from siltlog.sources.formats import parse

    path = str(tmp_path / "store")
    LogStore.ingest(parse(numbered(["a", "b"]), "apache"), path)
    store = LogStore.ingest(parse(numbered([STAMP.format(1, "info", "x")]), "apache"), path)
    assert store.logs.count() == 1 and store.patterns.count() == 1


def test_empty_store(spark, numbered):
    from siltlog.sources.formats import parse

    store = LogStore.ingest(parse(numbered(["x"]).where("false"), "apache"))
    row = stats.store_stats(store.logs, store.patterns).head()
    assert (row["total_logs"], row["unique_patterns"], row["range_start"]) == (0, 0, None)


def test_top_patterns_break_ties_by_first_row(levels_table):
    df = levels_table(["x"] * 8, ["b", "a", "a", "b", "c", "d", "d", "c"])
    counted = P.pattern_counts(df).withColumnRenamed("first_pos", "pos")
    top = P.most_frequent(counted, 3).collect()
    assert [r["fingerprint"] for r in top] == ["b", "a", "c"]


def test_time_range_bounds(levels_table):
    df = levels_table(["x"] * 10)
    start = "2023-11-14T22:13:22Z"  # second 2 of the table
    assert [r["pos"] for r in select.by_time_range(df, start, "2023-11-14T22:13:24.000Z").orderBy("pos").collect()] == [2, 3, 4]
    assert select.by_time_range(df, "garbage", start).count() == 0


def test_symptom(levels_table):
    levels = ["error", "warn", "info", "crit"]
    df = levels_table(levels, ["Disk full", "disk slow", "disk ok", "net down"])
    assert {r["pos"] for r in select.by_symptom(df, "DISK").collect()} == {0, 1}
    assert {r["pos"] for r in select.by_symptom(df, "memory").collect()} == {0, 1, 3}


def test_pattern_ids_match_only_the_first_row(ingested):
    store = ingested([STAMP.format(10, "error", "child 5"), STAMP.format(20, "error", "child 6")])
    assert select.patterns_by_ids(store.patterns, ["log_00001"]).count() == 1
    assert select.patterns_by_ids(store.patterns, ["log_00002"]).count() == 0


def test_search_needs_every_word(levels_table):
    df = levels_table(["x"] * 3, ["Child 7 DIED now", "child alive", "died"])
    assert [r["pos"] for r in select.search(df, "died  child").collect()] == [0]
    assert select.search(df, "").count() == 3


def test_context_groups_count_within_the_context(levels_table):
    levels = ["info"] * 20
    levels[3] = levels[4] = "error"
    groups = context.context_groups(context.error_context(levels_table(levels), k=1)).orderBy("pos").collect()
    assert [(r["fingerprint"], r["n"], r["ids"]) for r in groups] == [
        ("info", 2, ["log_00003", "log_00006"]),
        ("error", 2, ["log_00004", "log_00005"]),
    ]


def test_context_groups_list_five_ids(levels_table):
    (group,) = context.context_groups(levels_table(["x"] * 40)).collect()
    assert (group["n"], group["ids"]) == (40, [f"log_{i:05d}" for i in range(1, 6)])


def test_search_context_falls_back(levels_table):
    levels = ["info"] * 30
    levels[20] = "warn"
    df = levels_table(levels, [f"m{i}" for i in range(30)])
    assert [r["pos"] for r in context.search_context(df, "M7", 1).orderBy("pos").collect()] == [6, 7, 8]
    assert [r["pos"] for r in context.search_context(df, "zzz", 1).orderBy("pos").collect()] == [19, 20, 21]


def test_signals_follow_the_first_row(ingested):
    # Both lines share a fingerprint; only the later one shows the attack.
    store = ingested(
        [STAMP.format(10, "error", "GET /missing/1"), STAMP.format(20, "error", "GET /../../etc/passwd")]
    )
    assert signals.pattern_signals(store.patterns).count() == 0
    assert [r["type"] for r in signals.line_signals(store.logs).collect()] == ["PATH_TRAVERSAL"]


def test_signal_types(ingested):
    store = ingested(
        [
            STAMP.format(1, "error", "x' OR 1=1 union 2"),
            STAMP.format(2, "error", "<SCRIPT>alert</script>"),
            STAMP.format(3, "error", "POST /login HTTP 500 after"),
            STAMP.format(4, "error", "Directory index forbidden by rule: /var/www"),
            STAMP.format(5, "error", "GET /wp-login with token"),
            STAMP.format(6, "error", "sqlmap/1.0"),
        ]
    )
    found = {}
    for r in signals.pattern_signals(store.patterns).orderBy("pos", "type_ord").collect():
        found.setdefault(r["pos"], []).append(r["type"])
    assert found == {
        0: ["SQL_INJECTION"],
        1: ["XSS_PROBE"],
        2: ["ADMIN_BRUTE_FORCE"],
        3: ["DIRECTORY_FORBIDDEN"],
        4: ["CREDENTIAL_PROBE"],
        5: ["SCANNER_SIGNATURE"],
    }


def test_buckets_leave_out_undated_rows(ingested):
    store = ingested([STAMP.format(1, "info", "a"), "loose"])
    rows = stats.time_buckets(store.logs).select(iso_text(F.col("bucket")).alias("b"), "n").collect()
    assert [tuple(r) for r in rows] == [("2005-12-04T04:45:00.000Z", 1)]
    assert stats.hourly_buckets(store.logs).count() == 1


def test_level_counts_and_approximate_patterns(levels_table):
    df = levels_table(["a", "b", "a"])
    assert {r["level"]: r["n"] for r in stats.count_by_level(df).collect()} == {"a": 2, "b": 1}
    assert stats.unique_patterns(df, approximate=True).head()[0] == 2


def test_batches(levels_table):
    rows = P.in_batches(levels_table(["x"] * 7), 3).orderBy("pos").collect()
    assert [(r["batch_id"], r["batch_ord"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]
    assert (P.batch_count(0, 5), P.batch_count(0, 5, empty_batch=True), P.batch_count(11, 5)) == (0, 1, 3)


def test_distinct_in_order(levels_table):
    df = levels_table(["a", "b", "a", "b"])
    assert [r["pos"] for r in P.distinct_in_order(df, "level", "pos").orderBy("pos").collect()] == [0, 1]


def test_many_patterns_take_the_other_path(ingested):
    store = ingested([STAMP.format(i % 60, "error", f"kind {chr(97 + i % 7)}") for i in range(90)] + ["loose"])
    few, many = P.patterns_of(store.logs), P.patterns_of(store.logs, few=0)
    assert few.columns == many.columns
    assert few.orderBy("pos").collect() == many.orderBy("pos").collect()

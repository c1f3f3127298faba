"""Positions, ranks, halos and everything built on neighbours, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltlog.operators import chains, context, order, sampling, select
from siltlog.operators.order import (
    _in_ranges,
    dense_index,
    halo_frame,
    own_block,
    lower_bound,
    rows_at_ranks,
    running_sum,
    with_halo,
    with_log_date,
    with_positions,
)
from siltlog.operators.sampling import equal_step_ranks
from siltlog.session import materialize
from siltlog.sources.formats import parse
from tests.generator import generate, generate_lines
from siltlog.sources.store import LogStore

LEVELS = ["info", "notice", "warn", "error", "crit", "debug", "unknown", "warning", "critical"]
SEEDS = [1, 2, 3]


def random_levels(seed, n=400):
    rng = random.Random(seed)
    weights = [rng.random() for _ in LEVELS]
    return rng.choices(LEVELS, weights, k=n)


def test_positions_with_ties_and_undated_rows(spark, numbered):
    stamp = "[Sun Dec 04 04:47:{:02d} 2005] [info] x{}"
    lines = [stamp.format(i * 7 % 5, i) if i % 4 else f"undated {i}" for i in range(200)]
    rows = with_positions(parse(numbered(lines), "apache"), partitions=7).orderBy("pos").collect()
    order = sorted(range(200), key=lambda i: (i % 4 == 0, (i * 7 % 5) if i % 4 else 0, i))
    assert [r["pos"] for r in rows] == list(range(200))
    assert [r["line_number"] - 1 for r in rows] == order


def test_one_timestamp_is_spread_over_tasks(spark, numbered):
    lines = ["[Sun Dec 04 04:47:44 2005] [info] same"] * 4000
    table = materialize(with_log_date(parse(numbered(lines), "apache")), "same-second")
    ranged, count = _in_ranges(table, [F.unix_micros("ts"), F.col("line_number")], 8)
    sizes = ranged.groupBy("_range").count().collect()
    assert count == 8 and len(sizes) == 8 and max(r["count"] for r in sizes) < 1000
    rows = with_positions(table, partitions=8).orderBy("pos").select("pos", "line_number").collect()
    assert [(r["pos"], r["line_number"]) for r in rows] == [(i, i + 1) for i in range(4000)]


def test_two_levels_of_bounds_give_the_same_order(spark, monkeypatch):
    monkeypatch.setattr(order, "COARSE_RANGES", 8)
    rng = random.Random(4)
    keys = [(rng.choice([0, 0, 0, rng.randrange(10**6)]), i) for i in range(5000)]
    df = spark.createDataFrame(rng.sample(keys, len(keys)), "a long, b long").repartition(6)
    ranged, count = _in_ranges(df, [F.col("a"), F.col("b")], 200)
    rows = ranged.collect()
    place = {(r["a"], r["b"]): r["_range"] for r in rows}
    order_of = [place[k] for k in sorted(keys)]
    assert len(rows) == 5000 and order_of == sorted(order_of) and 0 <= order_of[0] and order_of[-1] < count
    sizes = [order_of.count(r) for r in set(order_of)]
    assert len(sizes) > 150 and max(sizes) < 150
    indexed = order.global_index(df, [F.col("a"), F.col("b")], "i", 200).orderBy("i").collect()
    assert [(r["a"], r["b"], r["i"]) for r in indexed] == [(*k, i) for i, k in enumerate(sorted(keys))]
    assert running_sum(df, [F.col("a"), F.col("b")], "a", "s", 200).agg(F.max("s")).head()[0] == sum(a for a, _ in keys)
    one = order.global_index(df.limit(1), [F.col("a"), F.col("b")], "i", 200).collect()
    assert [r["i"] for r in one] == [0] and order.global_index(df.limit(0), [F.col("a")], "i", 200).count() == 0


def test_driver_and_plan_stay_small_with_a_million_ranges(spark, monkeypatch):
    df = materialize(spark.range(300_000).selectExpr("id * 7 AS a"), "many-keys")
    seen, frame = [], type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    plans = []
    for ranges in (20_000, 1_000_000):
        seen.clear()
        indexed = order.global_index(df, [F.col("a")], "i", ranges)
        assert max(map(len, seen)) <= 3 * order.COARSE_RANGES * order.SAMPLES_PER_RANGE
        plans.append(len(indexed._jdf.queryExecution().optimizedPlan().toString()))
    assert indexed.where("i * 7 <> a").count() == 0 and indexed.count() == 300_000
    # Literal bounds are those of the coarse ranges, however many runs there are.
    assert plans[1] < 1.02 * plans[0]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_running_sum(spark, ranges):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long")
    rows = running_sum(df, [F.col("k")], "v", "total", ranges).orderBy("k").collect()
    total = 0
    for row in rows:
        total += row["v"]
        assert row["total"] == total


def test_lower_bound(spark):
    df = spark.createDataFrame([([], 3), ([5], 5), ([1, 3, 5], 4), ([1, 3, 5], 9), (None, 1)], "a array<long>, x long")
    assert [r[0] for r in df.select(lower_bound(F.col("a"), F.col("x"))).collect()] == [0, 0, 2, 3, None]


def test_many_wanted_ranks(levels_table):
    df = levels_table(["x"] * 3000)
    wanted = list(range(0, 3000, 2))
    found = rows_at_ranks(df, [(r, r) for r in wanted], rows=64)
    assert sorted(r["rank"] for r in found.collect()) == wanted


@pytest.mark.parametrize("rows", [1, 3, 64, 10_000])
def test_dense_index_within_keys(levels_table, rows):
    levels = random_levels(5)
    df = dense_index(levels_table(levels), "rank", by=["level"], rows=rows)
    seen = {}
    expected = []
    for level in levels:
        expected.append(seen.get(level, 0))
        seen[level] = expected[-1] + 1
    assert [r["rank"] for r in df.orderBy("pos").collect()] == expected


def test_rows_at_ranks(levels_table):
    levels = random_levels(6)
    warns = [i for i, level in enumerate(levels) if level == "warn"]
    df = select.by_level(levels_table(levels), "warn")
    found = rows_at_ranks(df, [(0, 0), (2, 4), (9999, 9999)], rows=16).orderBy("pos").collect()
    assert [(r["pos"], r["rank"]) for r in found] == [(warns[i], i) for i in (0, 2, 3, 4) if i < len(warns)]


@pytest.mark.parametrize("rows", [4, 7, 1000])
def test_halo_frames(levels_table, rows):
    df = levels_table(["x"] * 50)
    total = F.sum("pos").over(halo_frame(3, 2))
    got = with_halo(df, 3, 2, rows=rows).withColumn("s", total).where(own_block(rows=rows))
    got = {r["pos"]: r["s"] for r in got.collect()}
    assert got == {p: sum(range(max(0, p - 3), min(49, p + 2) + 1)) for p in range(50)}


def near(levels, wanted, k):
    hits = [i for i, level in enumerate(levels) if level in wanted]
    return sorted({j for i in hits for j in range(max(0, i - k), min(len(levels), i + k + 1))})


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("few", [0, 50_000])
def test_error_context(levels_table, seed, few):
    levels = random_levels(seed)
    rows = context.error_context(levels_table(levels), k=2, few=few).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == near(levels, {"error", "crit", "warn"}, 2)
    assert all(r["is_error"] == (levels[r["pos"]] in ("error", "crit")) for r in rows)


@pytest.mark.parametrize("rows", [8, 50, 1000])
def test_merged_windows(levels_table, rows):
    levels = ["info"] * 200
    for i in (0, 12, 24, 70, 81, 93, 150, 199):
        levels[i] = "warn"
    got = context.context_windows(levels_table(levels), rows=rows).orderBy("window_id").collect()
    covered = near(levels, {"warn"}, 5)
    spans, start = [], covered[0]
    for a, b in zip(covered, covered[1:] + [10**9]):
        if b != a + 1:
            spans.append((start, a))
            start = b
    assert [(r["window_start"], r["window_end"]) for r in got] == spans


def replay_chains(levels):
    """Walk the rows once, keeping the last five lead-ins since the last failure."""
    buffer, found = [], []
    for i, level in enumerate(levels):
        if level in ("info", "notice", "warn"):
            buffer = [*buffer, i][-5:]
        elif level in ("error", "crit"):
            if any(levels[j] == "warn" for j in buffer):
                found.append((i, buffer))
            buffer = []
    return found


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("rows", [5, 64, 65536])
def test_escalations_equal_a_replay(levels_table, seed, rows):
    levels = random_levels(seed)
    got = chains.escalations(levels_table(levels), rows=rows).orderBy("pos").collect()
    assert [(r["pos"], r["preceding"]) for r in got] == replay_chains(levels)


def test_chain_edges(levels_table):
    # A warning more than five lead-ins back, other levels inside a chain, an open tail.
    levels = ["warn", *["info"] * 5, "error", "warn", "debug", "unknown", "crit", "error", "warn", "info"]
    got = chains.escalations(levels_table(levels)).collect()
    assert [(r["pos"], r["preceding"]) for r in got] == [(10, [7])]


def test_first_chains_count_repeats(levels_table):
    levels, messages = [], []
    for i in range(60):
        levels += ["warn", "error"]
        messages += [f"w{i}", f"e{i % 12}"]
    rows = chains.chain_rows(levels_table(levels, messages)).orderBy("chain_no", "step").collect()
    assert [r["message"] for r in rows if r["is_error"]] == [f"e{i}" for i in range(10)]
    assert {r["chain_count"] for r in rows} == {5}


def test_narrative(levels_table):
    levels = ["error" if i % 10 == 0 else "info" for i in range(100)]
    rows = context.narrative(levels_table(levels)).orderBy("window_id", "offset").collect()
    centres = [10 * math.floor(i * (10 / 6)) for i in range(6)]
    assert sorted({r["centre"] for r in rows}) == centres
    assert [r["pos"] for r in rows if r["window_id"] == 0] == [0, 1, 2]
    assert [r["offset"] for r in rows if r["window_id"] == 1] == [-3, -2, -1, 0, 1, 2]
    assert all(r["is_error"] == (r["pos"] == r["centre"]) for r in rows)


def test_narrative_without_failures(levels_table):
    assert context.narrative(levels_table(["info", "warn"])).count() == 0
    assert chains.chain_rows(levels_table(["info", "warn"])).count() == 0


@pytest.mark.parametrize("n", [59, 60, 61, 333])
def test_systematic_sample(levels_table, n):
    rows = sampling.systematic_sample(levels_table(["x"] * n), 60).orderBy("pos").collect()
    expected = list(range(n)) if n <= 60 else [math.floor(i * (n / 60)) for i in range(60)]
    assert [r["pos"] for r in rows] == expected


def test_group_sample_picks_the_same_ranks(levels_table):
    for n in (5, 60, 61, 119, 250):
        df = levels_table(["x"] * n).withColumn("batch_id", F.lit(0))
        got = sampling.sample_small_groups(df, ["batch_id"], 60).orderBy("pos").collect()
        assert [r["pos"] for r in got] == equal_step_ranks(n, 60)


def replay_proportional(levels, size):
    if len(levels) <= size:
        return list(range(len(levels)))
    picked = []
    for level in dict.fromkeys(levels):
        entries = [i for i, x in enumerate(levels) if x == level]
        count = max(1, math.floor(len(entries) * (size / len(levels)) + 0.5))
        for i in range(count):
            if len(picked) < size:
                picked.append(entries[math.floor(i * (len(entries) / count))])
    return sorted(picked)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("size", [4, 50, 1000])
def test_proportional_sample(levels_table, seed, size):
    levels = random_levels(seed)
    rows = sampling.proportional_sample(levels_table(levels), size).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == replay_proportional(levels, size)


def replay_cap(patterns, limit=40):
    if len(patterns) <= limit:
        return [p[0] for p in patterns]
    tiers = [[], [], []]
    for p in patterns:
        tiers[0 if p[1] in ("error", "crit", "critical") else 1 if p[1] in ("warn", "warning") else 2].append(p)
    by_count = [sorted(t, key=lambda p: (-p[2], p[0])) for t in tiers]
    critical = by_count[0][:25]
    left = limit - len(critical)
    warnings = by_count[1][: math.ceil(left * 0.7)]
    other = by_count[2][: left - len(warnings)]
    return [p[0] for p in critical + warnings + other]


@pytest.mark.parametrize("n, critical", [(30, 5), (41, 3), (200, 80), (200, 10), (90, 90)])
def test_cap_by_tier(spark, n, critical):
    rng = random.Random(n + critical)
    levels = ["critical"] * critical + rng.choices(["warn", "warning", "info", "debug"], k=n - critical)
    rng.shuffle(levels)
    patterns = [(i, level, rng.randint(1, 9)) for i, level in enumerate(levels)]
    df = spark.createDataFrame(patterns, "pos long, level string, occurrence_count long")
    got = sampling.cap_by_tier(df).orderBy("cap_ord").collect()
    assert [r["pos"] for r in got] == replay_cap(patterns)


def test_requested_context_keeps_request_order(levels_table):
    df = levels_table(["x"] * 30)
    ids = ["log_00021", "log_00002", "log_00777", "log_00021", "log_00023"]
    rows = context.requested_context(df, ids, k=2).orderBy("context_ord").collect()
    assert [r["pos"] for r in rows] == [18, 19, 20, 21, 22, 0, 1, 2, 3, 23, 24]


def test_ids_keep_repeats_and_drop_unknown(levels_table):
    rows = select.by_ids(levels_table(["x"] * 5), ["log_00003", "nope", "log_00001", "log_00003"])
    assert [r["pos"] for r in rows.orderBy("request_ord").collect()] == [2, 0, 2]


def test_pages(levels_table):
    levels = ["warn" if i % 3 == 0 else "info" for i in range(1000)]
    df = levels_table(levels)
    assert [r["pos"] for r in select.page(df, 2, 50).orderBy("pos").collect()] == list(range(50, 100))
    page = select.page(df, 2, 999, "warn").orderBy("pos").collect()
    assert [r["pos"] for r in page] == list(range(0, 1000, 3))[200:400]
    info = select.page_info(df, 2, 999, "warn").head()
    assert (info["limit"], info["total"], info["total_pages"]) == (200, 334, 2)
    assert select.page(df, 9, 200, "warn").count() == 0


@pytest.mark.parametrize("seed", SEEDS)
def test_generated_logs_keep_the_invariants(spark, seed):
    store = LogStore.ingest(parse(generate(spark, 1500, seed), "apache"))
    logs, patterns = store.logs, store.patterns
    assert logs.where("level = 'unknown' or ts is null").count() == 0
    assert patterns.agg(F.sum("occurrence_count")).head()[0] == 1500
    assert [r["pos"] for r in logs.orderBy("pos").select("pos").collect()] == list(range(1500))
    gaps = [r["ts"] for r in logs.orderBy("line_number").collect()]
    steps = {(b - a).seconds for a, b in zip(gaps, gaps[1:])}
    assert min(steps) >= 1 and max(steps) <= 30
    near_rows = context.error_context(logs)
    assert select.problems(logs).join(near_rows, "pos", "left_anti").count() == 0


def test_generator_does_not_depend_on_blocks(spark):
    rows = spark.range(500).withColumnRenamed("id", "pos")
    a = generate_lines(rows, 3, blocks=7).orderBy("line_number").collect()
    b = generate_lines(rows, 3).orderBy("line_number").collect()
    assert a == b


def test_lower_bound_looks_at_one_item_a_step(spark):
    rows = [(n, x) for n in (0, 1, 2, 3, 4, 7, 8, 9, 31, 33) for x in range(-1, 2 * n + 2)]
    df = spark.createDataFrame(rows, "n int, x int")
    values = F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: 2 * i - 1))
    placed = order.lower_bound(F.col("values"), F.col("x"))
    got = df.withColumn("values", values).select("n", "x", placed.alias("k")).collect()
    assert [(r.n, r.x, r.k) for r in got] == [(n, x, sum(2 * i - 1 < x for i in range(1, n + 1))) for n, x in rows]
    assert str(placed).count("get(") == 1

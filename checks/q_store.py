"""Queries over the ingested store: filters, joins, aggregates, windows, samples (B-G)."""

from functools import reduce

from pyspark.sql import functions as F

from checks.fixtures import ISO
from checks.q_sources import signals_sql
from checks.registry import query
from siltlog.functions.text import contains_all_of
from siltlog.functions.times import iso_text
from siltlog.operators import chains, context, lookup, patterns as P, sampling, select, signals, stats
from siltlog.operators.order import dense_index
from siltlog.plans.prompts import scope_text
from siltlog.plans.reports import patterns_by_hour
from siltlog.schema import is_failure, is_problem, severity_tier

TS_SQL = f"{ISO.format('ts')} AS ts"
ROW_SQL = f"pos, id, {TS_SQL}, level, message"


def ts():
    return iso_text(F.col("ts")).alias("ts")


def row():
    return ["pos", "id", ts(), "level", "message"]


PROBLEM = "level IN ('error', 'crit', 'warn')"
FAILURE = "level IN ('error', 'crit')"
IDS = ["log_00050", "log_00003", "log_99999", "log_00050", "log_00099", "log_00007"]
IDS_SQL = ", ".join(f"({i}::BIGINT, '{v}')" for i, v in enumerate(IDS))

# --- B: filters ---


@query("b01_by_level", f"SELECT {ROW_SQL} FROM logs WHERE level = 'warn'")
def by_level(x):
    return select.by_level(x.logs, "warn").select(*row())


@query(
    "b02_time_range",
    f"SELECT {ROW_SQL} FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'",
)
def time_range(x):
    return select.by_time_range(x.logs, "2024-01-05T06:00:00Z", "2024-01-09T18:30:00Z").select(*row())


@query("b02_unreadable_bound", f"SELECT {ROW_SQL} FROM logs WHERE FALSE")
def unreadable_bound(x):
    return select.by_time_range(x.logs, "yesterday", "2024-01-09T18:30:00Z").select(*row())


@query(
    "b03_search",
    f"SELECT {ROW_SQL} FROM logs WHERE contains(lower(raw), 'child') AND contains(lower(raw), 'slot') AND contains(lower(raw), '1')",
)
def search(x):
    return select.search(x.logs, " Child\tSLOT  1").select(*row())


@query("b03_search_everything", "SELECT count(*) AS n FROM logs")
def search_everything(x):
    return select.search(x.logs, "  ").agg(F.count("*").alias("n"))


@query(
    "b03_search_by_column",
    "SELECT conv_id, turn, contains(lower(text), lower(role)) AND contains(lower(text), 'a') AS hit FROM conversations",
    None,
)
def search_by_column(x):
    words = F.concat(F.col("role"), F.lit("  A "))
    return x.table("conversations").select(
        "conv_id", "turn", contains_all_of(F.col("text"), words).alias("hit")
    )


@query(
    "b04_severity_sets",
    f"""SELECT level, {PROBLEM} AS problem, {FAILURE} AS failure,
        CASE WHEN level IN ('error', 'crit', 'critical') THEN 0 WHEN level IN ('warn', 'warning') THEN 1 ELSE 2 END AS tier,
        count(*) AS n FROM logs GROUP BY ALL""",
)
def severity_sets(x):
    level = F.col("level")
    return (
        x.logs.groupBy("level", is_problem(level).alias("problem"), is_failure(level).alias("failure"), severity_tier(level).alias("tier"))
        .agg(F.count("*").alias("n"))
    )


PATTERN = ["id", "level", "message", "fingerprint", "occurrence_count"]
PATTERN_SQL = "id, level, message, fingerprint, occurrence_count"


@query(
    "b05_symptom",
    f"SELECT {PATTERN_SQL} FROM patterns WHERE {PROBLEM} AND contains(lower(message), 'forbidden by')",
)
def symptom(x):
    return select.by_symptom(x.patterns, "Forbidden BY").select(*PATTERN)


@query("b05_symptom_fallback", f"SELECT {PATTERN_SQL} FROM patterns WHERE {PROBLEM}")
def symptom_fallback(x):
    return select.by_symptom(x.patterns, "no such thing").select(*PATTERN)


@query(
    "b06_focus",
    f"SELECT 'errors' AS focus, {PATTERN_SQL} FROM patterns WHERE {PROBLEM} UNION ALL SELECT 'warnings', {PATTERN_SQL} FROM patterns",
)
def focus(x):
    parts = [select.focus(x.patterns, f).select(F.lit(f).alias("focus"), *PATTERN) for f in ("errors", "warnings")]
    return P.union_all(*parts)


@query(
    "b07_patterns_by_ids",
    f"SELECT {PATTERN_SQL} FROM patterns WHERE id IN (SELECT id FROM logs WHERE line_number IN (1, 2, 3, 4, 5, 9000))",
)
def patterns_by_ids(x):
    ids = [f"log_{n:05d}" for n in (1, 2, 3, 4, 5, 9000)]
    return select.patterns_by_ids(x.patterns, ids).select(*PATTERN)


@query(
    "b08_by_fingerprint",
    f"SELECT {ROW_SQL} FROM logs WHERE fingerprint IN (SELECT fingerprint FROM patterns WHERE level = 'warn')",
)
def by_fingerprint(x):
    return select.by_fingerprints(x.logs, x.patterns.where("level = 'warn'")).select(*row())


@query("b09_error_flag", f"SELECT pos, {FAILURE} AS is_error FROM logs")
def error_flag(x):
    return x.logs.select("pos", select.is_error_flag().alias("is_error"))


def near_sql(flag: str, k: int) -> str:
    return f"""SELECT pos FROM (SELECT pos, max(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER
      (ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS near FROM logs) WHERE near = 1"""


@query(
    "b10_search_context",
    "SELECT 'hit' AS kind, pos FROM (" + near_sql("contains(lower(raw), 'nikto')", 5) + ")"
    " UNION ALL SELECT 'none', pos FROM (" + near_sql(PROBLEM, 5) + ")",
    "sparse",
)
def search_context(x):
    logs = x.store("sparse").logs
    hit = context.search_context(logs, "NIKTO").select(F.lit("hit").alias("kind"), "pos")
    none = context.search_context(logs, "zzz qqq").select(F.lit("none").alias("kind"), "pos")
    return hit.unionByName(none)


# --- C: joins ---


@query(
    "c01_by_ids",
    f"SELECT r.ord AS request_ord, {ROW_SQL} FROM logs JOIN (VALUES {IDS_SQL}) r(ord, rid) ON rid = id",
)
def by_ids(x):
    return select.by_ids(x.logs, IDS).select("request_ord", *row())


@query(
    "c02_neighbours",
    f"""SELECT c.pos AS centre, l.pos - c.pos AS "offset", l.pos, l.id, strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
        l.level, l.message FROM logs c JOIN logs l ON l.pos BETWEEN c.pos - 5 AND c.pos + 5
        WHERE c.level IN ('error', 'warn')""",
    "sparse",
)
def neighbours(x):
    logs = x.store("sparse").logs
    return context.neighbours(logs, select.problems(logs)).select("centre", "offset", *row())


_ERROR_CONTEXT = f"SELECT pos, level, {FAILURE} AS is_error FROM logs WHERE pos IN ({near_sql(PROBLEM, 5)})"


@query("c03_error_context", _ERROR_CONTEXT)
def error_context(x):
    return context.error_context(x.logs).select("pos", "level", "is_error")


@query("c03_error_context_sparse", _ERROR_CONTEXT, "sparse")
def error_context_sparse(x):
    return context.error_context(x.store("sparse").logs).select("pos", "level", "is_error")


@query("c03_error_context_by_block", _ERROR_CONTEXT, "sparse")
def error_context_by_block(x):
    # The path for many problem rows: block shuffle with halo.
    return context.error_context(x.store("sparse").logs, few=0).select("pos", "level", "is_error")


_BATCHED = """, targets AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM patterns WHERE {where}),
  batches AS (SELECT *, ordinal // {size} AS batch_id, ordinal % {size} AS batch_ord FROM targets)"""
_PATTERN_CONTEXT = _BATCHED.format(where=PROBLEM, size=20) + """,
  ctx AS (SELECT DISTINCT b.batch_id, l.pos, l.id, l.ts, l.level, l.message, l.fingerprint FROM batches b
          JOIN logs l ON l.pos BETWEEN b.pos - 5 AND b.pos + 5)"""


@query("c04_pattern_context", _PATTERN_CONTEXT + f" SELECT batch_id, {ROW_SQL} FROM ctx")
def pattern_context(x):
    batches = P.in_batches(select.problems(x.patterns), 20)
    return context.pattern_context(x.logs, batches).select("batch_id", *row())


@query(
    "c07_requested_context",
    f"""SELECT row_number() OVER (ORDER BY request_ord, pos) - 1 AS context_ord, pos, id FROM
        (SELECT l.pos, l.id, min(r.ord) AS request_ord FROM (VALUES {IDS_SQL}) r(ord, rid) JOIN logs c ON c.id = rid
         JOIN logs l ON l.pos BETWEEN c.pos - 5 AND c.pos + 5 GROUP BY ALL)""",
)
def requested_context(x):
    rows = context.requested_context(x.logs, IDS)
    return rows.select(F.col("context_ord").cast("long").alias("context_ord"), "pos", "id")


# --- the same through the tables kept next to a store ---


@query(
    "c01_indexed_ids",
    f"SELECT r.ord AS request_ord, {ROW_SQL} FROM logs JOIN (VALUES {IDS_SQL}) r(ord, rid) ON rid = id",
)
def indexed_ids(x):
    return lookup.by_ids(x.store(), IDS).select("request_ord", *row())


@query(
    "b03_indexed_search",
    f"""SELECT 'child' AS kind, {ROW_SQL} FROM logs WHERE contains(lower(raw), 'child') AND contains(lower(raw), 'slot') AND contains(lower(raw), '1')
        UNION ALL SELECT 'rare', {ROW_SQL} FROM logs WHERE contains(lower(raw), 'unparsed') AND contains(lower(raw), '97')
        UNION ALL SELECT 'short', {ROW_SQL} FROM logs WHERE contains(lower(raw), '99')""",
)
def indexed_search(x):
    asked = {"child": " Child\tSLOT  1", "rare": "Unparsed 97", "short": "99", "none": "zzzz"}
    found = [lookup.search(x.store(), q).select(F.lit(kind).alias("kind"), *row()) for kind, q in asked.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "c07_indexed_context",
    f"""SELECT row_number() OVER (ORDER BY request_ord, pos) - 1 AS context_ord, pos, id FROM
        (SELECT l.pos, l.id, min(r.ord) AS request_ord FROM (VALUES {IDS_SQL}) r(ord, rid) JOIN logs c ON c.id = rid
         JOIN logs l ON l.pos BETWEEN c.pos - 5 AND c.pos + 5 GROUP BY ALL)""",
)
def indexed_context(x):
    rows = lookup.requested_context(x.store(), IDS)
    return rows.select(F.col("context_ord").cast("long").alias("context_ord"), "pos", "id")


@query(
    "b08_indexed_fingerprints",
    f"SELECT {ROW_SQL} FROM logs WHERE fingerprint IN (SELECT fingerprint FROM patterns ORDER BY occurrence_count, pos LIMIT 3)",
)
def indexed_fingerprints(x):
    rarest = x.patterns.orderBy("occurrence_count", "pos").limit(3).collect()
    return lookup.by_fingerprints(x.store(), [r["fingerprint"] for r in rarest]).select(*row())


@query(
    "d08_kept_cube",
    f"""SELECT 'level' AS part, level AS name, count(*) AS n FROM logs GROUP BY level
        UNION ALL SELECT 'bucket', {ISO.format("time_bucket(INTERVAL 15 MINUTE, ts)")}, count(*) FROM logs WHERE ts IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'hour', {ISO.format("date_trunc('hour', ts)")}, count(*) FROM logs WHERE ts IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'range', {ISO.format("min(ts)")} || ' ' || {ISO.format("max(ts)")}, count(*) FROM logs
        UNION ALL SELECT 'sizes', count(DISTINCT level) || ' ' || count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) || ' '
          || count(DISTINCT date_trunc('hour', ts)), count(DISTINCT fingerprint) FROM logs""",
)
def kept_cube(x):
    store = x.store()
    stat = lookup.store_stats(store)
    parts = [
        lookup.count_by_level(store).select(F.lit("level").alias("part"), F.col("level").alias("name"), "n"),
        lookup.time_buckets(store).select(F.lit("bucket"), iso_text(F.col("bucket")), "n"),
        lookup.hourly_buckets(store).select(F.lit("hour"), iso_text(F.col("bucket")), "n"),
        stat.select(F.lit("range"), F.concat_ws(" ", iso_text(F.col("range_start")), iso_text(F.col("range_end"))), "total_logs"),
        stat.select(F.lit("sizes"), F.concat_ws(" ", "levels", "time_windows", "hourly_buckets"), "unique_patterns"),
    ]
    return reduce(lambda a, b: a.union(b), parts)


# --- D: aggregates ---


@query("d01_count_by_level", "SELECT level, count(*) AS n, min(pos) AS first_pos FROM logs GROUP BY level")
def count_by_level(x):
    return stats.count_by_level(x.logs)


@query("d02_time_range", f"SELECT {ISO.format('min(ts)')} AS low, {ISO.format('max(ts)')} AS high FROM logs")
def range_of_times(x):
    return stats.time_range(x.logs).select(
        iso_text(F.col("range_start")).alias("low"), iso_text(F.col("range_end")).alias("high")
    )


@query("d03_unique_patterns", "SELECT count(DISTINCT fingerprint) AS unique_patterns FROM logs")
def unique_patterns(x):
    return stats.unique_patterns(x.logs)


@query(
    "d04_top_patterns",
    """SELECT fingerprint, occurrence_count, level, message, pos FROM patterns
       ORDER BY occurrence_count DESC, pos LIMIT 10""",
)
def top_patterns(x):
    return P.most_frequent(x.patterns).select("fingerprint", "occurrence_count", "level", "message", "pos")


@query(
    "d05_quarter_hours",
    f"SELECT {ISO.format('time_bucket(INTERVAL 15 MINUTE, ts)')} AS bucket, count(*) AS n FROM logs WHERE ts IS NOT NULL GROUP BY 1",
)
def quarter_hours(x):
    return stats.time_buckets(x.logs).select(iso_text(F.col("bucket")).alias("bucket"), "n")


@query(
    "d06_hours",
    f"""SELECT {ISO.format("date_trunc('hour', ts)")} AS bucket, count(*) AS n FROM logs WHERE ts IS NOT NULL GROUP BY 1""",
)
def hourly(x):
    return stats.hourly_buckets(x.logs).select(iso_text(F.col("bucket")).alias("bucket"), "n")


_PATTERNS_SQL = f"""SELECT {PATTERN_SQL}, raw, pos, last_pos, {TS_SQL}, {ISO.format('first_seen')} AS first_seen,
  {ISO.format('last_seen')} AS last_seen FROM patterns"""


def _pattern_rows(df):
    return df.select(
        *PATTERN,
        "raw",
        "pos",
        "last_pos",
        ts(),
        iso_text(F.col("first_seen")).alias("first_seen"),
        iso_text(F.col("last_seen")).alias("last_seen"),
    )


@query("d07_patterns", _PATTERNS_SQL)
def patterns(x):
    return _pattern_rows(P.patterns_of(x.logs))


@query("d07_access_patterns", _PATTERNS_SQL, "access")
def access_patterns(x):
    return _pattern_rows(x.store("access").patterns)


@query(
    "d07_pattern_members",
    "SELECT fingerprint, pos, id, row_number() OVER (PARTITION BY fingerprint ORDER BY pos) - 1 AS member FROM logs",
)
def pattern_members(x):
    return P.pattern_members(x.logs)


@query(
    "d08_store_stats",
    f"""SELECT count(*) AS total_logs, {ISO.format('min(ts)')} AS low, {ISO.format('max(ts)')} AS high,
        count(DISTINCT level) AS levels, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) AS time_windows,
        count(DISTINCT date_trunc('hour', ts)) AS hourly_buckets, 0::BIGINT AS parse_errors,
        count(DISTINCT fingerprint) AS unique_patterns FROM logs""",
)
def store_stats(x):
    result = stats.store_stats(x.logs, x.patterns)
    return result.select(
        iso_text(F.col("range_start")).alias("low"),
        iso_text(F.col("range_end")).alias("high"),
        *[c for c in result.columns if not c.startswith("range_")],
    )


_GROUPS = """, grp AS (SELECT batch_id, fingerprint, count(*) AS n, min(pos) AS pos, arg_min(level, pos) AS level,
  arg_min(message, pos) AS message, arg_min_null(ts, pos) AS first_ts, arg_max_null(ts, pos) AS last_ts,
  list(id ORDER BY pos)[1:5] AS ids FROM ctx GROUP BY batch_id, fingerprint)"""


@query(
    "d09_context_groups",
    _PATTERN_CONTEXT + _GROUPS
    + f""" SELECT batch_id, fingerprint, n, pos, level, message, {ISO.format('first_ts')} AS first_ts,
    {ISO.format('last_ts')} AS last_ts, array_to_string(ids, ', ') AS ids FROM grp""",
)
def context_groups(x):
    batches = P.in_batches(select.problems(x.patterns), 20)
    groups = context.context_groups(context.pattern_context(x.logs, batches), ["batch_id"])
    return groups.select(
        "batch_id",
        "fingerprint",
        "n",
        "pos",
        "level",
        "message",
        iso_text(F.col("first_ts")).alias("first_ts"),
        iso_text(F.col("last_ts")).alias("last_ts"),
        F.array_join("ids", ", ").alias("ids"),
    )


_CHAINS = f""", rel AS (SELECT pos, level, fingerprint, row_number() OVER (ORDER BY pos) AS r,
    coalesce(sum(CASE WHEN {FAILURE} THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
    FROM logs WHERE level IN ('info', 'notice', 'warn', 'error', 'crit')),
  chains AS (SELECT f.pos, f.fingerprint AS chain_key, list(e.pos ORDER BY e.pos) AS preceding FROM rel f
    JOIN rel e ON e.seg = f.seg AND e.r BETWEEN f.r - 5 AND f.r - 1
    WHERE f.level IN ('error', 'crit') GROUP BY f.pos, f.fingerprint HAVING bool_or(e.level = 'warn')),
  dchains AS (SELECT chain_key, count(*) AS chain_count, min(pos) AS pos, arg_min(preceding, pos) AS preceding
    FROM chains GROUP BY chain_key)"""
_FIRST_CHAINS = _CHAINS + """, fchains AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS chain_no FROM dchains
    ORDER BY pos LIMIT 10),
  crows AS (SELECT chain_no, chain_count, chain_key, unnest(list_append(preceding, pos)) AS at_pos,
    unnest(generate_series(0, len(preceding))) AS step FROM fchains)"""


@query("e02_escalations", _CHAINS + " SELECT pos, chain_key, array_to_string(preceding, ',') AS preceding FROM chains")
def escalations(x):
    found = chains.escalations(x.logs)
    return found.select("pos", "chain_key", F.array_join(F.col("preceding").cast("array<string>"), ",").alias("preceding"))


@query("e02_access_escalations", _CHAINS + " SELECT pos, chain_key, array_to_string(preceding, ',') AS preceding FROM chains", "access")
def access_escalations(x):
    # Small blocks, so that chains cross block borders.
    found = chains.escalations(x.store("access").logs, rows=64)
    return found.select("pos", "chain_key", F.array_join(F.col("preceding").cast("array<string>"), ",").alias("preceding"))


@query("d10_distinct_chains", _CHAINS + " SELECT chain_key, chain_count, pos, array_to_string(preceding, ',') AS preceding FROM dchains")
def distinct_chains(x):
    found = chains.distinct_chains(chains.escalations(x.logs))
    joined = F.array_join(F.col("preceding").cast("array<string>"), ",")
    return found.select("chain_key", "chain_count", "pos", joined.alias("preceding"))


@query(
    "f07_first_chains",
    _FIRST_CHAINS
    + f""" SELECT chain_no::INT AS chain_no, chain_count, step::INT AS step, pos, level, message, {TS_SQL}, {FAILURE} AS is_error
    FROM crows JOIN logs ON pos = at_pos""",
)
def first_chains(x):
    return chains.chain_rows(x.logs).select(
        "chain_no", "chain_count", "step", "pos", "level", "message", ts(), "is_error"
    )


_HOURS = "coalesce(strftime(ts, '%Y-%m-%dT%H:00'), 'unknown-time')"


@query(
    "d14_patterns_by_hour",
    f"""SELECT {_HOURS} AS key, count(*) AS n, min(pos) AS first_pos, sum(occurrence_count)::BIGINT AS logs
        FROM patterns GROUP BY 1""",
)
def hours_of_patterns(x):
    return patterns_by_hour(x.patterns)


@query(
    "d16_group_in_order",
    "SELECT l_shipmode_key AS key, count(*) AS n, min(pos) AS first_pos FROM "
    "(SELECT l_returnflag || l_linestatus AS l_shipmode_key, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) GROUP BY 1",
    None,
)
def group_in_order(x):
    rows = x.table("lineitem").withColumn("pos", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return P.group_in_order(rows, F.concat("l_returnflag", "l_linestatus"))


@query(
    "d18_analysis_metadata",
    f"""SELECT count(*) AS total_logs, count(*) FILTER (level = 'error') AS error_logs, {ISO.format('min(ts)')} AS low,
        {ISO.format('max(ts)')} AS high, 'Symptom search: "slow"' AS analysis_scope,
        (SELECT count(*) FROM (SELECT level FROM patterns ORDER BY occurrence_count DESC, pos LIMIT 10) WHERE level = 'error')
        AS unique_error_patterns FROM logs""",
)
def analysis_metadata(x):
    result = stats.analysis_metadata(x.logs, P.most_frequent(x.patterns), scope_text(symptom="slow"))
    return result.select(
        "total_logs",
        "error_logs",
        iso_text(F.col("range_start")).alias("low"),
        iso_text(F.col("range_end")).alias("high"),
        "analysis_scope",
        "unique_error_patterns",
    )


_SIG_KEEP = "fingerprint, level, message, occurrence_count, pos"


@query("d19_pattern_signals", signals_sql("patterns", "raw || ' ' || message", _SIG_KEEP), "access")
def pattern_signals(x):
    return signals.pattern_signals(x.store("access").patterns).select(
        *_SIG_KEEP.split(", "), "type", F.col("type_ord").cast("int").alias("type_ord")
    )


@query("d19_line_signals", signals_sql("logs", "raw || ' ' || message", "pos, level"), "access")
def line_signals(x):
    return signals.line_signals(x.store("access").logs).select(
        "pos", "level", "type", F.col("type_ord").cast("int").alias("type_ord")
    )


# --- E: windows ---


@query("e01_positions", "SELECT id, line_number, pos FROM logs", "access")
def positions(x):
    return x.store("access").logs.select("id", "line_number", "pos")


_PICKED = f"""f AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rank, count(*) OVER () AS n FROM logs WHERE {FAILURE}),
  picked AS (SELECT DISTINCT f.pos, f.rank FROM f, range(6) i(i)
    WHERE CASE WHEN n <= 6 THEN TRUE ELSE f.rank = floor(i.i * (n / 6.0::DOUBLE)) END),
  nar AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS window_id, pos AS centre FROM picked)"""


@query(
    "e03_narrative",
    ", " + _PICKED
    + f""" SELECT window_id, centre, pos - centre AS "offset", pos, {TS_SQL}, level, message, pos = centre AS is_error
    FROM nar JOIN logs ON pos BETWEEN centre - 3 AND centre + 2""",
)
def narrative(x):
    return context.narrative(x.logs).withColumn("ts", iso_text(F.col("ts")))


@query(
    "e04_row_frames",
    f"""SELECT pos, level, count(*) OVER w AS frame_rows,
        count(*) FILTER ({PROBLEM}) OVER w AS frame_problems FROM logs
        WINDOW w AS (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""",
)
def row_frames(x):
    return context.frame_counts(x.logs)


@query(
    "e04_row_frames_small_blocks",
    f"""SELECT pos, level, count(*) OVER w AS frame_rows,
        count(*) FILTER ({PROBLEM}) OVER w AS frame_problems FROM logs
        WINDOW w AS (ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""",
)
def row_frames_small_blocks(x):
    return context.frame_counts(x.logs, k=7, rows=100)


_ISLANDS = f""", prob AS (SELECT pos, lag(pos) OVER (ORDER BY pos) AS prev FROM logs WHERE {PROBLEM}),
  isl AS (SELECT pos, sum(CASE WHEN prev IS NULL OR pos - prev > 11 THEN 1 ELSE 0 END) OVER (ORDER BY pos) - 1 AS window_id FROM prob)
  SELECT window_id::BIGINT AS window_id, greatest(min(pos) - 5, 0) AS window_start,
    least(max(pos) + 5, (SELECT max(pos) FROM logs)) AS window_end FROM isl GROUP BY window_id"""


@query("e07_merged_windows", _ISLANDS, "sparse")
def merged_windows(x):
    return context.context_windows(x.store("sparse").logs)


@query("e07_merged_windows_small_blocks", _ISLANDS)
def merged_windows_small_blocks(x):
    return context.context_windows(x.logs, rows=64)


@query(
    "e08_first_and_last",
    "SELECT fingerprint, arg_min(id, pos) AS first_value, arg_max(id, pos) AS last_value FROM logs GROUP BY fingerprint",
)
def first_and_last(x):
    return P.first_and_last(x.logs, "fingerprint", "id")


# --- F: sorts, caps, samples ---


@query("f01_stable_order", "SELECT line_number, pos AS ord FROM logs ORDER BY pos")
def stable_order(x):
    # `pos` is the rank under this order; both are returned so that they can be compared.
    return x.logs.orderBy(F.col("ts").asc_nulls_last(), "line_number").select("line_number", F.col("pos").alias("ord"))


@query(
    "f02_top_levels",
    "SELECT fingerprint, n, pos FROM (SELECT fingerprint, count(*) AS n, min(pos) AS pos FROM logs GROUP BY 1) ORDER BY n DESC, pos LIMIT 25",
    "access",
)
def top_groups(x):
    groups = x.store("access").logs.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return P.most_frequent(groups, 25, count="n")


_CAP = """, t AS (SELECT *, CASE WHEN level IN ('error', 'crit', 'critical') THEN 0 WHEN level IN ('warn', 'warning') THEN 1 ELSE 2 END AS tier
    FROM patterns),
  rk AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY occurrence_count DESC, pos) AS rn FROM t),
  q0 AS (SELECT least(25, count(*)) AS c FROM t WHERE tier = 0),
  q1 AS (SELECT least(ceil((40 - (SELECT c FROM q0)) * 0.7::DOUBLE), count(*)) AS w FROM t WHERE tier = 1),
  cap AS (SELECT *, row_number() OVER (ORDER BY tier, rn) - 1 AS cap_ord FROM rk, q0, q1
    WHERE (tier = 0 AND rn <= 25) OR (tier = 1 AND rn <= w) OR (tier = 2 AND rn <= 40 - c - w))"""


@query("f03_capped_patterns", _CAP + " SELECT cap_ord::INT AS cap_ord, id, level, occurrence_count FROM cap")
def capped_patterns(x):
    return sampling.cap_by_tier(x.patterns).select("cap_ord", "id", "level", "occurrence_count")


_ALL_CONTEXT = f", ctx AS (SELECT 0::BIGINT AS batch_id, * FROM logs WHERE pos IN ({near_sql(PROBLEM, 5)}))" + _GROUPS


@query("f04_capped_groups", _ALL_CONTEXT + " SELECT fingerprint, n, pos FROM grp ORDER BY n DESC, pos LIMIT 30")
def capped_groups(x):
    groups = context.context_groups(context.error_context(x.logs))
    return sampling.cap_by_count(groups).select("fingerprint", "n", "pos")


@query(
    "f05_supplementary",
    f"SELECT {PATTERN_SQL} FROM patterns WHERE level NOT IN ('error', 'warn', 'crit') ORDER BY occurrence_count DESC, pos LIMIT 10",
)
def supplementary(x):
    return sampling.supplementary(x.patterns).select(*PATTERN)


@query("f06_page", f"SELECT {ROW_SQL} FROM logs WHERE pos BETWEEN 100 AND 149")
def page(x):
    return select.page(x.logs, number=3).select(*row())


@query(
    "f06_level_page",
    f"SELECT {ROW_SQL} FROM logs WHERE level = 'warn' ORDER BY pos LIMIT 200 OFFSET 800",
)
def level_page(x):
    return select.page(x.logs, number=5, limit=500, level="warn").select(*row())


@query(
    "f06_page_info",
    """SELECT 5::BIGINT AS page, 200::BIGINT AS "limit", count(*) AS total, ceil(count(*) / 200.0)::BIGINT AS total_pages
       FROM logs WHERE level = 'warn'""",
)
def page_info(x):
    return select.page_info(x.logs, number=5, limit=500, level="warn")


def _sample_sql(size: int, where: str) -> str:
    return f"""SELECT r.pos, r.rank FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rank, count(*) OVER () AS n
      FROM logs WHERE {where}) r WHERE r.n <= {size} OR r.rank IN
      (SELECT floor(i * (r.n / {size}.0::DOUBLE)) FROM range({size}) g(i))"""


@query("f10_systematic_sample", _sample_sql(60, PROBLEM))
def systematic_sample(x):
    return sampling.systematic_sample(select.problems(x.logs), 60).select("pos", "rank")


@query(
    "f11_proportional_sample",
    f""", lv AS (SELECT level, count(*) AS n, min(pos) AS p0, greatest(1, floor(count(*) * (50.0::DOUBLE / (SELECT count(*) FROM logs)) + 0.5)) AS c
      FROM logs GROUP BY level),
    st AS (SELECT *, coalesce(sum(c) OVER (ORDER BY p0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv),
    tg AS (SELECT level, floor(i * (n / c)) AS rank FROM st, range(50) g(i) WHERE i < c AND before + i < 50),
    rk AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY pos) - 1 AS rank FROM logs)
    SELECT rk.{ROW_SQL.replace(', ', ', rk.').replace('rk.strftime(ts, rk.', 'strftime(rk.ts, ')} FROM rk JOIN tg ON tg.level = rk.level AND tg.rank = rk.rank""",
)
def proportional_sample(x):
    return sampling.proportional_sample(x.logs).select(*row())


@query(
    "f12_first_ids",
    """SELECT fingerprint, array_to_string(list(id ORDER BY pos)[1:5], ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS ids
       FROM logs GROUP BY fingerprint""",
)
def first_ids(x):
    groups = context.context_groups(x.logs)
    return groups.select("fingerprint", sampling.first_ids_text(F.col("ids"), F.col("n")).alias("ids"))


@query(
    "f13_context_sample",
    f""", ctx AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rank, count(*) OVER () AS n FROM ({near_sql(PROBLEM, 5)}))
    SELECT pos, rank FROM ctx WHERE rank IN (SELECT floor(i * (n / 60.0::DOUBLE)) FROM range(60) g(i))""",
    "sparse",
)
def context_sample(x):
    near = context.error_context(x.store("sparse").logs)
    return sampling.systematic_sample(near, 60).select("pos", "rank")


# --- G: distinct, union, batches ---


@query(
    "g01_distinct_ids",
    "SELECT l_orderkey, min(pos) AS pos FROM (SELECT l_orderkey, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) GROUP BY 1",
    None,
)
def distinct_ids(x):
    rows = x.table("lineitem").select(
        "l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
    )
    return P.distinct_in_order(rows, "l_orderkey", "pos")


@query("g02_union_all", f"SELECT {ROW_SQL} FROM logs WHERE {PROBLEM} UNION ALL SELECT {ROW_SQL} FROM logs WHERE {FAILURE}")
def union_all(x):
    return P.union_all(select.problems(x.logs), select.failures(x.logs)).select(*row())


@query(
    "g03_batches",
    _BATCHED.format(where="TRUE", size=150) + " SELECT id, ordinal, batch_id, batch_ord FROM batches",
)
def batches(x):
    return P.in_batches(x.patterns, 150).select("id", "ordinal", "batch_id", "batch_ord")


@query(
    "e01_dense_index_small_blocks",
    "SELECT pos, level, row_number() OVER (PARTITION BY level ORDER BY pos) - 1 AS rank FROM logs",
)
def dense_index_small_blocks(x):
    return dense_index(x.logs.select("pos", "level"), "rank", by=["level"], rows=50)

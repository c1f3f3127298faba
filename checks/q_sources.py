"""Sources, parsing, sinks (A) and scalar functions (H1-H10)."""

from pyspark.sql import functions as F

from checks.fixtures import ACCESS_RE, ERROR_RE, ISO, ctes, set_ages
from checks.registry import query
from siltlog.functions.fingerprint import fingerprint, mask
from siltlog.functions.security import SIGNATURES, signal_types
from siltlog.functions.text import duration_text, is_blank, keywords, log_id, or_default, trimmed
from siltlog.functions.times import (
    access_log_time,
    bucket_start,
    error_log_time,
    hour_label,
    hour_start,
    iso_text,
)
from siltlog.session import working_path
from siltlog.sources import formats
from siltlog.sources.lines import detect_file_format, read_accepted, read_lines
from siltlog.sources.store import DEFAULT_LOG, LogStore
from siltlog.streaming.ingest import (
    finalize,
    parse_stream,
    read_counts,
    start_counts,
    start_ingest,
    stream_lines,
)

def log_row():
    return ["line_number", "id", "raw", iso_text(F.col("ts")).alias("ts"), "level", "message", "fingerprint"]


LOG_SQL = f"line_number, id, raw, {ISO.format('ts')} AS ts, level, message, fingerprint"


@query("a01_text_source", f"SELECT {LOG_SQL} FROM logs")
def text_source(x):
    return formats.parse(read_lines(x.spark, x.text_files()), "apache").select(*log_row())


@query("a02_ingested_file", f"SELECT pos, {LOG_SQL} FROM logs")
def ingested_file(x):
    store = LogStore.ingest_file(x.spark, x.text_files(parts=3))
    return store.logs.select("pos", *log_row())


@query("a03_line_list", "SELECT level, count(*) AS n, count(DISTINCT fingerprint) AS patterns FROM logs GROUP BY level", "access")
def line_list(x):
    parsed = formats.parse_lines(x.lines("access"))
    return parsed.groupBy("level").agg(
        F.count("*").alias("n"), F.count_distinct("fingerprint").alias("patterns")
    )


@query("a04_default_log", "SELECT level, count(*) AS n, min(pos) AS first_pos FROM logs GROUP BY level")
def default_log(x):
    written = x.text_files(suffix=f"/{DEFAULT_LOG}")
    store = LogStore.load_default(x.spark, written.rsplit("/", 1)[0])
    return store.logs.groupBy("level").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


_VOTES = f"""
SELECT f.variant, f.priority, f.format, count(*) AS tested,
  avg(CASE WHEN regexp_matches(value, CASE WHEN f.priority = 0 THEN '{ERROR_RE}' ELSE '{ACCESS_RE}' END)
      THEN 1.0 ELSE 0.0 END) AS share,
  share >= 0.5 AS accepted
FROM head h JOIN (VALUES ('a', 0, 'apache'), ('a', 1, 'apache-access'), ('e', 0, 'apache'), ('e', 1, 'apache-access'))
  f(variant, priority, format) ON f.variant = h.variant
GROUP BY ALL
"""


def _votes_sql():
    from checks.fixtures import _ACCESS_LINES, _ERROR_LINES, _EVENTS

    return (
        "WITH " + _EVENTS + _ERROR_LINES.replace("{sparse}", "FALSE").replace("lines AS", "e AS")
        + _ACCESS_LINES.replace("lines AS", "a AS")
        + "head AS (SELECT 'e' AS variant, value FROM e WHERE line_number <= 5 "
        "UNION ALL SELECT 'a', value FROM a WHERE line_number <= 5)" + _VOTES
    )


@query("a05_format_votes", _votes_sql(), None)
def format_votes(x):
    error = formats.format_votes(x.lines("error")).select(F.lit("e").alias("variant"), "*")
    access = formats.format_votes(x.lines("access")).select(F.lit("a").alias("variant"), "*")
    return error.unionByName(access)


@query(
    "a05_file_format",
    "SELECT 'apache-access' AS format, count(*) AS lines, count(DISTINCT level) AS levels FROM logs",
    "access",
)
def file_format(x):
    path = x.text_files("access", suffix=".log")
    fmt = detect_file_format(x.spark, path)
    parsed = formats.parse(read_lines(x.spark, path), fmt)
    return parsed.agg(
        F.lit(fmt.name).alias("format"), F.count("*").alias("lines"), F.count_distinct("level").alias("levels")
    )


# Two folders, one of access and one of error logs; the first comes first in file order.
_BOTH = f"""
WITH both_logs AS (
  SELECT line_number, raw, ts, level, message, fingerprint, ip FROM ({ctes("access")} SELECT * FROM parsed)
  UNION ALL
  SELECT line_number + (SELECT count(*) FROM events), raw, ts, level, message, fingerprint, NULL FROM ({ctes("error")} SELECT * FROM parsed)
)
SELECT row_number() OVER (ORDER BY ts NULLS LAST, line_number) - 1 AS pos, line_number, printf('log_%05d', line_number) AS id, raw,
  {ISO.format("ts")} AS ts, level, message, fingerprint, ip FROM both_logs
"""


@query("a05_format_per_file", _BOTH, None)
def format_per_file(x):
    """A folder of error and access logs: each file is read in its own format."""
    paths = [x.text_files("access", suffix=".log"), x.text_files("error", suffix=".log")]
    return LogStore.ingest_file(x.spark, paths).logs.select("pos", *log_row(), "ip")


@query("k1_streamed_formats", _BOTH, None)
def streamed_formats(x):
    """The same by stream, all files in one batch, without a named format."""
    folder, sink = working_path(x.spark, "mixed-logs"), working_path(x.spark, "mixed-sink")
    for name in ("access", "error"):
        x.text_files(name, path=f"{folder}/{name}")
    start_ingest(stream_lines(x.spark, f"{folder}/*"), sink, working_path(x.spark, "mixed-state")).awaitTermination()
    return finalize(x.spark, sink).logs.select("pos", *log_row(), "ip")


@query(
    "a06_named_format",
    "SELECT 'unknown' AS level, count(*) AS n, count(DISTINCT raw) AS raws FROM logs",
    "access",
)
def named_format(x):
    wrong = formats.parse(x.lines("access"), formats.format_by_name("apache"))
    return wrong.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("raw").alias("raws"))


@query("a07_error_format", f"SELECT {LOG_SQL} FROM logs")
def error_format(x):
    return x.parsed().select(*log_row())


@query("a08_access_format", f"SELECT {LOG_SQL}, ip, size, referrer, user_agent FROM logs", "access")
def access_format(x):
    return x.parsed("access").select(*log_row(), "ip", "size", "referrer", "user_agent")


@query("a09_unmatched_lines", f"SELECT {LOG_SQL} FROM logs WHERE level = 'unknown' AND ts IS NULL")
def unmatched_lines(x):
    return formats.unmatched(x.parsed()).select(*log_row())


_REPORT = """SELECT count(*) AS total_lines, count(*) AS parsed_lines,
  count(*) FILTER (level = 'unknown' AND ts IS NULL) AS unmatched_lines, 0::BIGINT AS parse_errors"""


@query("a10_parse_report", f"{_REPORT} FROM logs")
def parse_report(x):
    return formats.parse_report(x.parsed())


@query("a11_line_numbers", "SELECT line_number, value FROM lines", "access")
def line_numbers(x):
    return read_lines(x.spark, x.text_files("access", parts=5))


@query(
    "a12_ingest_summary",
    f"{_REPORT}, 'error' AS source, (SELECT count(*) FROM patterns) AS unique_patterns FROM logs",
)
def ingest_summary(x):
    return x.store().summary()


@query(
    "a13_stored_layout",
    """SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS log_date, level, count(*) AS n,
       min(pos) AS low, max(pos) AS high FROM logs GROUP BY ALL""",
)
def stored_layout(x):
    path = working_path(x.spark, "stored")
    LogStore.ingest(x.parsed("access"), path)
    again = LogStore.ingest(x.parsed("error"), path)  # replaces the first
    return LogStore.open(x.spark, again.path).logs.groupBy("log_date", "level").agg(
        F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )


@query("a14_accepted_files", "SELECT count(*) * 2 AS n, max(line_number) * 2 AS last_line FROM lines")
def accepted_files(x):
    folder = working_path(x.spark, "uploads")
    values = x.lines().select("value")
    for suffix in ("log", "txt", "csv"):
        values.write.text(f"{folder}/part.{suffix}")
    return read_accepted(x.spark, folder).agg(
        F.count("*").alias("n"), F.max("line_number").alias("last_line")
    )


@query("b11_missing_values", f"SELECT line_number, coalesce({ISO.format('ts')}, 'N/A') AS ts, coalesce(nullif(user_agent, ''), 'N/A') AS agent FROM logs", "access")
def missing_values(x):
    return x.parsed("access").select(
        "line_number",
        or_default(iso_text(F.col("ts")), "N/A").alias("ts"),
        or_default(F.col("user_agent"), "N/A").alias("agent"),
    )


# --- scalar functions, over documents, pages, orders and events ---

# White space to trim, for SQL.
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"
_MASKED = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(text, '\b\d{3,}\b', 'N', 'g'), 'slot\s+\d+', 'slot N', 'g'),
  'child\s+\d+', 'child N', 'g'), 'state\s+\d+', 'state N', 'g'), '/[\w/.\-]+', 'PATH', 'g'),
  @SPACES@)""".replace("@SPACES@", _SPACES)


@query(
    "h01_fingerprint",
    f"""SELECT doc_id, substr(sha256(lang || ':' || {_MASKED}), 1, 12) AS fingerprint,
        length({_MASKED}) AS masked_length FROM documents""",
    None,
)
def fingerprints(x):
    return x.table("documents").select(
        "doc_id",
        fingerprint(F.col("lang"), F.col("text")).alias("fingerprint"),
        F.length(mask(F.col("text"))).cast("long").alias("masked_length"),
    )


@query(
    "h02_error_log_time",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {ISO.format("date_trunc('second', o_orderdate) + INTERVAL (o_orderkey % 1000) MILLISECOND")}
        END AS ts FROM orders""",
    None,
)
def error_time(x):
    orders = x.table("orders")
    fraction = F.format_string(".%03d", F.col("o_orderkey") % 1000)
    stamp = F.concat(
        F.lit("Mon "),
        F.date_format("o_orderdate", "MMM d HH:mm:ss"),
        fraction,
        F.date_format("o_orderdate", " yyyy"),
    )
    bad = F.regexp_replace(stamp, r"[A-Z][a-z]{2} \d+ ", "Feb 31 ")
    text = F.when(F.col("o_orderkey") % 11 == 0, F.regexp_replace(bad, "^Feb", "Mon Feb")).otherwise(stamp)
    return orders.select("o_orderkey", iso_text(error_log_time(text)).alias("ts"))


@query(
    "h03_access_log_time",
    f"""SELECT o_orderkey, {ISO.format("date_trunc('second', o_orderdate) - to_hours(CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS INT))")} AS ts FROM orders""",
    None,
)
def access_time(x):
    offset = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" +0200")).otherwise("")
    text = F.concat(F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss"), offset)
    return x.table("orders").select("o_orderkey", iso_text(access_log_time(text)).alias("ts"))


@query(
    "h04_minute_buckets",
    f"""SELECT event_id, {ISO.format("time_bucket(INTERVAL 15 MINUTE, ts)")} AS quarter,
        {ISO.format("time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '2024-01-01')")} AS third FROM events""",
    None,
)
def minute_buckets(x):
    return x.events.select(
        "event_id",
        iso_text(bucket_start(F.col("ts"))).alias("quarter"),
        iso_text(bucket_start(F.col("ts"), 20)).alias("third"),
    )


@query(
    "h05_hours",
    f"""SELECT event_id, {ISO.format("date_trunc('hour', ts)")} AS hour,
        strftime(ts, '%Y-%m-%dT%H:00') AS label FROM events""",
    None,
)
def hours(x):
    return x.events.select(
        "event_id",
        iso_text(hour_start(F.col("ts"))).alias("hour"),
        hour_label(F.col("ts")).alias("label"),
    )


@query(
    "h06_status_level",
    """SELECT p_partkey, CASE WHEN p_size * 12 >= 500 THEN 'error' WHEN p_size * 12 >= 400 THEN 'warn'
       ELSE 'info' END AS level FROM part""",
    None,
)
def status_levels(x):
    return x.table("part").select("p_partkey", formats.status_level(F.col("p_size") * 12).alias("level"))


@query(
    "h07_request_message",
    """SELECT page_id, coalesce(nullif(string_split(rq, ' ')[1], ''), 'UNKNOWN') || ' ' ||
         coalesce(string_split(rq, ' ')[2], '') || ' - Status 404' AS message
       FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'GET ' || url || ' HTTP/1.1' WHEN 1 THEN url
             WHEN 2 THEN ' ' || url ELSE 'HEAD' END AS rq FROM pages)""",
    None,
)
def request_message(x):
    url, kind = F.col("url"), F.col("page_id") % 4
    request = (
        F.when(kind == 0, F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1")))
        .when(kind == 1, url)
        .when(kind == 2, F.concat(F.lit(" "), url))
        .otherwise("HEAD")
    )
    line = F.concat(F.lit('1.2.3.4 - - [01/Jul/2026:14:58:44 +0000] "'), request, F.lit('" 404 5'))
    lines = x.table("pages").select(F.col("page_id").alias("line_number"), line.alias("value"))
    return formats.parse(lines, "apache-access").select(F.col("line_number").alias("page_id"), "message")


@query("h08_log_ids", "SELECT l_orderkey * 7 + l_linenumber AS n, printf('log_%05d', l_orderkey * 7 + l_linenumber) AS id FROM lineitem", None)
def log_ids(x):
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return x.table("lineitem").select(n.alias("n"), log_id(n).alias("id"))


@query(
    "h09_text_functions",
    r"""SELECT doc_id, length(trim(t, @SPACES@)) AS kept, upper(lang) AS lang,
        trim(t, @SPACES@) = '' AS blank, contains(lower(text), 'the') AS has_word
        FROM (SELECT *, chr(9) || chr(160) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END || ' ' || chr(13) AS t FROM documents)""".replace("@SPACES@", _SPACES),
    None,
)
def text_functions(x):
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text"))
    text = F.concat(F.lit("\t\u00a0"), body, F.lit(" \r"))
    (word,) = keywords("  The ")
    return x.table("documents").select(
        "doc_id",
        F.length(trimmed(text)).cast("long").alias("kept"),
        F.upper("lang").alias("lang"),
        is_blank(text).alias("blank"),
        F.lower("text").contains(word).alias("has_word"),
    )


_SIGNATURES_SQL = dict(SIGNATURES)


def signals_sql(table: str, text: str, keep: str) -> str:
    """All (row, type) hits; ``type_ord`` counts from 1."""
    parts = [
        f"SELECT {keep}, '{name}' AS type, {i} AS type_ord FROM {table} WHERE regexp_matches({text}, '(?i)"
        + pattern.replace("'", "''")
        + "')"
        for i, (name, pattern) in enumerate(_SIGNATURES_SQL.items(), 1)
    ]
    return " UNION ALL ".join(parts)


@query("h10_security_signatures", signals_sql("pages", "url || ' ' || html", "page_id"), None)
def security_signatures(x):
    types = F.posexplode(signal_types(F.col("url"), F.col("html")))
    names = F.array(*[F.lit(n) for n in _SIGNATURES_SQL])
    hits = x.table("pages").select("page_id", types.alias("i", "type"))
    return hits.select("page_id", "type", F.array_position(names, F.col("type")).cast("int").alias("type_ord"))


@query(
    "h11_durations",
    """SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0)
       ELSE printf('%.1fm', ms / 60000.0) END AS took
       FROM (SELECT o_orderkey, o_orderkey % 131 * 1001 + o_orderkey % 7 AS ms FROM orders)""",
    None,
)
def durations(x):
    ms = F.col("o_orderkey") % 131 * 1001 + F.col("o_orderkey") % 7
    return x.table("orders").select("o_orderkey", duration_text(ms).alias("took"))


@query(
    "h12_json_text",
    """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS body FROM events""",
    None,
)
def json_text(x):
    return x.events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("body"))


@query("h18_iso_times", f"SELECT o_orderkey, {ISO.format('o_orderdate')} AS at FROM orders", None)
def iso_times(x):
    return x.table("orders").select("o_orderkey", iso_text(F.col("o_orderdate")).alias("at"))


# --- streaming ---


@query("k1_streamed_ingest", f"SELECT pos, {LOG_SQL} FROM logs")
def streamed_ingest(x):
    """One micro-batch per file; files are given ages in the order of their lines."""
    folder, sink = x.text_files(parts=4), working_path(x.spark, "stream-sink")
    set_ages(x.spark, folder)
    stream = stream_lines(x.spark, folder, files_per_batch=1)
    start_ingest(stream, sink, working_path(x.spark, "stream-state"), "apache").awaitTermination()
    return finalize(x.spark, sink).logs.select("pos", *log_row())


@query(
    "k2_streamed_counts",
    f"""SELECT {ISO.format("time_bucket(INTERVAL 15 MINUTE, ts)")} AS bucket, level, count(*) AS n FROM logs
        WHERE ts IS NOT NULL GROUP BY ALL""",
)
def streamed_counts(x):
    stream = stream_lines(x.spark, x.text_files(), files_per_batch=1)
    path = working_path(x.spark, "counts-sink")
    start_counts(parse_stream(stream, "apache"), path, working_path(x.spark, "counts-state")).awaitTermination()
    return read_counts(x.spark, path).select(iso_text(F.col("bucket")).alias("bucket"), "level", "n")


@query(
    "l1_registered_format",
    "SELECT et AS level, count(*) AS n, count(DISTINCT user_id) AS messages, min(event_id) + 1 AS first_line FROM ev GROUP BY et",
)
def registered_format(x):
    layout = r"^(\d+) (\w+) (\d+)\z"
    formats.register(
        formats.LogFormat(
            "counter",
            layout,
            lambda raw: {
                "matched": raw.rlike(layout),
                "_level": F.regexp_extract(raw, layout, 2),
                "_text": F.regexp_extract(raw, layout, 3),
            },
            lambda: {
                "ts": F.lit(None).cast("timestamp"),
                "level": F.col("_level"),
                "message": F.col("_text"),
                "fp_level": F.col("_level"),
                "fp_text": F.col("_text"),
            },
        )
    )
    try:
        value = F.concat_ws(" ", "event_id", "event_type", "user_id")
        lines = x.events.select((F.col("event_id") + 1).alias("line_number"), value.alias("value"))
        parsed = formats.parse_lines(lines)
    finally:
        formats.FORMATS.pop("counter")
    return parsed.groupBy("level").agg(
        F.count("*").alias("n"),
        F.count_distinct("message").alias("messages"),
        F.min("line_number").alias("first_line"),
    )

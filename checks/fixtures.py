"""Log lines rendered from the ``events`` table, the same way in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltlog.session import utc_session, working_path
from siltlog.sources.formats import parse
from siltlog.sources.store import LogStore

_STORES: dict[tuple, LogStore] = {}


class Inputs:
    """Tables, rendered lines and ingested stores for one data folder.

    A store is written once per session and folder, as one would ingest a log
    once and query it many times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = utc_session(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.regexp_extract("props", r"\d+", 0).cast("int"))

    def dealt_events(self) -> DataFrame:
        """The events dealt over all cores.

        They take a few bytes each, so a file of millions of them may be one row group,
        which one task reads; it would then render and parse all their lines as well.
        """
        return self.events.repartition(2 * self.spark.sparkContext.defaultParallelism, "event_id")

    def lines(self, variant: str = "error", dealt: bool = False) -> DataFrame:
        render = access_line if variant == "access" else error_line
        value = render() if variant != "sparse" else error_line(sparse=True)
        chatter = F.concat(F.lit("unparsed chatter "), F.col("event_id").cast("string"))
        events = self.dealt_events() if dealt else self.events
        return events.select(
            (F.col("event_id") + 1).alias("line_number"),
            F.when(F.col("event_id") % 97 == 0, chatter).otherwise(value).alias("value"),
        )

    def parsed(self, variant: str = "error", dealt: bool = False) -> DataFrame:
        fmt = "apache-access" if variant == "access" else "apache"
        return parse(self.lines(variant, dealt), fmt, extras=True)

    def store(self, variant: str = "error") -> LogStore:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, variant)
        if key not in _STORES:
            _STORES[key] = LogStore.ingest(self.parsed(variant, dealt=True), source=variant)
        return _STORES[key]

    @property
    def logs(self) -> DataFrame:
        return self.store().logs

    @property
    def patterns(self) -> DataFrame:
        return self.store().patterns

    def text_files(self, variant: str = "error", suffix: str = "", parts: int = 4, path: str | None = None) -> str:
        """The lines as text files, a blank line after every tenth."""
        path = path or working_path(self.spark, f"text-{variant}") + suffix
        blanks = F.when(F.col("line_number") % 10 == 0, F.array("value", F.lit("  "))).otherwise(
            F.array("value")
        )
        (
            self.lines(variant, dealt=True)
            .repartitionByRange(parts, "line_number")
            .sortWithinPartitions("line_number")
            .select(F.explode(blanks).alias("value"))
            .write.text(path)
        )
        return path


def set_ages(spark: SparkSession, folder: str) -> None:
    """Give the part files of a folder ages a second apart, in the order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
    now = max(fs.getFileStatus(f).getModificationTime() for f in found) // 1000 * 1000
    for age, f in enumerate(sorted(found, key=lambda f: f.getName(), reverse=True)):
        fs.setTimes(f, now - 1000 * age, -1)


def _is(kind: str):
    return F.col("event_type") == kind


def error_line(sparse: bool = False):
    k, event, user = F.col("k"), F.col("event_id"), F.col("user_id")
    login = F.concat(
        F.lit("GET /login?user="), user.cast("string"), F.when(k % 10 == 0, F.lit(" nikto")).otherwise("")
    )
    message = (
        F.when(_is("view"), F.lit("workerEnv.init() ok /etc/httpd/conf/workers2.properties"))
        .when(
            _is("click"),
            F.format_string(
                "jk2_init() Found child %d in scoreboard slot %d", 1000 + (event * 37) % 32000, 6 + k % 7
            ),
        )
        .when(_is("signup"), login)
        .when(_is("purchase"), F.format_string("slow backend %d ms", 100 + k))
        .when(
            k % 5 == 0,
            F.format_string(
                "[client 10.%d.0.%d] Directory index forbidden by rule: /var/www/html/", user % 7, k
            ),
        )
        .otherwise(F.format_string("mod_jk child workerEnv in error state %d", 6 + k % 5))
    )
    level = (
        F.when(_is("view") | _is("click"), F.lit("notice"))
        .when(_is("signup"), F.lit("info"))
        .when(F.lit(sparse) & (event % 50 != 0), F.lit("notice"))
        .when(_is("purchase"), F.lit("warn"))
        .otherwise("error")
    )
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy")
    return F.concat(F.lit("["), stamp, F.lit("] ["), level, F.lit("] "), message)


def access_line():
    k, user = F.col("k"), F.col("user_id")
    method = F.when(_is("purchase") | _is("signup"), F.lit("POST")).otherwise("GET")
    url = (
        F.when(_is("view"), F.lit("/index.html"))
        .when(_is("click"), F.format_string("/api/items?id=%d", k))
        .when(_is("signup"), F.lit("/login"))
        .when(_is("purchase"), F.format_string("/api/cart/%d", user))
        .when(k % 4 == 0, F.lit("/../../etc/passwd"))
        .when(k % 4 == 1, F.lit("/search?q=%27x"))
        .when(k % 4 == 2, F.lit("/admin/panel"))
        .otherwise(F.format_string("/missing/%d", k))
    )
    status = (
        F.when(_is("signup") & (k % 10 == 0), F.lit(403))
        .when(_is("signup") & (k % 10 == 1), F.lit(404))
        .when(~_is("error"), F.lit(200))
        .when(k % 4 == 0, F.lit(403))
        .when(k % 4 == 2, F.lit(503))
        .otherwise(404)
    )
    size = F.when(k == 0, F.lit("-")).otherwise((k * 10).cast("string"))
    agent = F.when(F.col("event_id") % 2 == 1, F.lit(' "-" "curl/8.5.0"')).otherwise("")
    return F.concat(
        F.format_string("10.0.%d.%d - - [", user % 256, k),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'),
        method,
        F.lit(" "),
        url,
        F.lit(' HTTP/1.1" '),
        status.cast("string"),
        F.lit(" "),
        size,
        agent,
    )


# --- the same lines and the tables derived from them, in SQL ---

_EVENTS = r"""
ev AS (SELECT event_id, ts AS ets, user_id, event_type AS et,
              CAST(regexp_extract(props, '\d+') AS INT) AS k FROM events),
"""

_ERROR_LINES = r"""
lines AS (SELECT event_id + 1 AS line_number, CASE WHEN event_id % 97 = 0
  THEN 'unparsed chatter ' || event_id
  ELSE '[' || strftime(ets, '%a %b %d %H:%M:%S %Y') || '] [' ||
    CASE WHEN et IN ('view', 'click') THEN 'notice' WHEN et = 'signup' THEN 'info'
         WHEN {sparse} THEN 'notice' WHEN et = 'purchase' THEN 'warn' ELSE 'error' END || '] ' ||
    CASE WHEN et = 'view' THEN 'workerEnv.init() ok /etc/httpd/conf/workers2.properties'
         WHEN et = 'click' THEN 'jk2_init() Found child ' || (1000 + (event_id * 37) % 32000)
              || ' in scoreboard slot ' || (6 + k % 7)
         WHEN et = 'signup' THEN 'GET /login?user=' || user_id || CASE WHEN k % 10 = 0 THEN ' nikto' ELSE '' END
         WHEN et = 'purchase' THEN 'slow backend ' || (100 + k) || ' ms'
         WHEN k % 5 = 0 THEN '[client 10.' || (user_id % 7) || '.0.' || k
              || '] Directory index forbidden by rule: /var/www/html/'
         ELSE 'mod_jk child workerEnv in error state ' || (6 + k % 5) END
  END AS value FROM ev),
"""

_ACCESS_LINES = r"""
lines AS (SELECT event_id + 1 AS line_number, CASE WHEN event_id % 97 = 0
  THEN 'unparsed chatter ' || event_id
  ELSE '10.0.' || (user_id % 256) || '.' || k || ' - - [' || strftime(ets, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
    || CASE WHEN et IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END || ' '
    || CASE WHEN et = 'view' THEN '/index.html' WHEN et = 'click' THEN '/api/items?id=' || k
            WHEN et = 'signup' THEN '/login' WHEN et = 'purchase' THEN '/api/cart/' || user_id
            WHEN k % 4 = 0 THEN '/../../etc/passwd' WHEN k % 4 = 1 THEN '/search?q=%27x'
            WHEN k % 4 = 2 THEN '/admin/panel' ELSE '/missing/' || k END
    || ' HTTP/1.1" '
    || CASE WHEN et = 'signup' AND k % 10 = 0 THEN 403 WHEN et = 'signup' AND k % 10 = 1 THEN 404
            WHEN et <> 'error' THEN 200 WHEN k % 4 = 0 THEN 403 WHEN k % 4 = 2 THEN 503 ELSE 404 END
    || ' ' || CASE WHEN k = 0 THEN '-' ELSE CAST(k * 10 AS VARCHAR) END
    || CASE WHEN event_id % 2 = 1 THEN ' "-" "curl/8.5.0"' ELSE '' END
  END AS value FROM ev),
"""

_FP = (
    r"substr(sha256({level} || ':' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    r"regexp_replace({text}, '\b\d{{3,}}\b', 'N', 'g'), 'slot\s+\d+', 'slot N', 'g'), "
    r"'child\s+\d+', 'child N', 'g'), 'state\s+\d+', 'state N', 'g'), "
    r"'/[\w/.\-]+', 'PATH', 'g'))), 1, 12)"
)

# The line layouts, for SQL.
ERROR_RE = r"^\[([^\]]+)\]\s+\[(\w+)\]\s+(.+)$"
ACCESS_RE = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?'
)

_ERROR_PARSED = (
    r"""
caps AS (SELECT line_number, value AS raw, regexp_extract(value, '@RE', 1) AS t,
  regexp_extract(value, '@RE', 2) AS l, regexp_extract(value, '@RE', 3) AS m FROM lines),
parsed AS (SELECT line_number, printf('log_%05d', line_number) AS id, raw,
  try_strptime(substr(t, 5), '%b %d %H:%M:%S %Y') AS ts,
  CASE WHEN l = '' THEN 'unknown' ELSE lower(l) END AS level,
  CASE WHEN l = '' THEN raw ELSE trim(m) END AS message,
  """.replace("@RE", ERROR_RE)
    + _FP.format(
        level="CASE WHEN l = '' THEN 'unknown' ELSE l END", text="CASE WHEN l = '' THEN raw ELSE m END"
    )
    + " AS fingerprint FROM caps),\n"
)

_ACCESS_PARSED = (
    r"""
caps AS (SELECT line_number, value AS raw, regexp_extract(value, '@RE', 1) AS ip,
  regexp_extract(value, '@RE', 2) AS t, string_split(regexp_extract(value, '@RE', 3), ' ') AS rq,
  TRY_CAST(regexp_extract(value, '@RE', 4) AS INT) AS st, regexp_extract(value, '@RE', 5) AS sz,
  regexp_extract(value, '@RE', 6) AS rf, regexp_extract(value, '@RE', 7) AS ua FROM lines),
lv AS (SELECT *, CASE WHEN st IS NULL THEN 'unknown' WHEN st >= 500 THEN 'error'
  WHEN st >= 400 THEN 'warn' ELSE 'info' END AS level FROM caps),
parsed AS (SELECT line_number, printf('log_%05d', line_number) AS id, raw,
  try_strptime(replace(t, ' +0000', ''), '%d/%b/%Y:%H:%M:%S') AS ts, level,
  CASE WHEN st IS NULL THEN raw ELSE rq[1] || ' ' || rq[2] || ' - Status ' || st END AS message,
  """.replace("@RE", ACCESS_RE)
    + _FP.format(
        level="level",
        text="CASE WHEN st IS NULL THEN raw ELSE rq[1] || ' ' || rq[2] || ' ' || st END",
    )
    + """ AS fingerprint, nullif(ip, '') AS ip, TRY_CAST(sz AS BIGINT) AS size,
  nullif(rf, '') AS referrer, nullif(ua, '') AS user_agent FROM lv),
"""
)

_LOGS = """
logs AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, line_number) - 1 AS pos FROM parsed),
patterns AS (SELECT fingerprint, count(*) AS occurrence_count, min(pos) AS pos, max(pos) AS last_pos,
  arg_min(id, pos) AS id, arg_min(raw, pos) AS raw, arg_min(level, pos) AS level,
  arg_min(message, pos) AS message, arg_min_null(ts, pos) AS ts, arg_min_null(ts, pos) AS first_seen,
  arg_max_null(ts, pos) AS last_seen FROM logs GROUP BY fingerprint)
"""

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def ctes(variant: str = "error") -> str:
    """``WITH`` list defining ``lines``, ``parsed``, ``logs`` and ``patterns``."""
    if variant == "access":
        return "WITH " + _EVENTS + _ACCESS_LINES + _ACCESS_PARSED + _LOGS
    sparse = "event_id % 50 <> 0" if variant == "sparse" else "FALSE"
    return "WITH " + _EVENTS + _ERROR_LINES.replace("{sparse}", sparse) + _ERROR_PARSED + _LOGS

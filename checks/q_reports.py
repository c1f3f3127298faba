"""Model answers, summaries, reports and analyses (C5, D11-D20, E5-E6, F8-F9, H13-H19, I, J)."""

from pyspark.sql import functions as F

from checks.fixtures import ISO
from checks.q_store import (
    _BATCHED,
    _CAP,
    _FIRST_CHAINS,
    _GROUPS,
    _PATTERN_CONTEXT,
    _PICKED,
    FAILURE,
    PROBLEM,
    near_sql,
)
from checks.q_sources import signals_sql
from checks.registry import query
from checks.rule_model import rule_model
from checks.stand_in_models import even_only, garbled, no_thirds
from siltlog.functions import json_text as J
from siltlog.operators import classify as C
from siltlog.operators import context, select
from siltlog.operators import patterns as P
from siltlog.plans import analysis, prompts, reports
from siltlog.plans.model import ask, read_audit, save_audit
from siltlog.session import working_path
from siltlog.functions.times import iso_text

# --- model answers rendered from `events`: eight wrappings of the same JSON ---
# 0 plain, 1 fenced, 2 object in prose, 3 array in prose, 4 trailing comma,
# 5 single quotes, 6 garbage, 7 empty

_BASE = r"(SELECT *, CAST(regexp_extract(props, '\d+') AS INT) AS k, event_id % 8 AS wrap FROM events)"


def _answers(x):
    """``event_id``, ``text``: one model answer per event."""
    k = F.col("k").cast("string")
    item = F.concat(
        F.lit('{"id": "e'),
        F.col("event_id").cast("string"),
        F.lit('", "category": "'),
        F.col("event_type"),
        F.lit('", "confidence": '),
        k,
        F.lit("}"),
    )
    wrap = F.col("event_id") % 8

    def around(before, body, after):
        return F.concat(F.lit(before), body, F.lit(after))

    text = (
        F.when(wrap == 0, item)
        .when(wrap == 1, around("Here:\n```json\n", item, "\n```\nbye"))
        .when(wrap == 2, around("The answer is ", item, " as asked."))
        .when(wrap == 3, F.concat(F.lit("List: ["), item, F.lit(", "), item, F.lit("] done")))
        .when(wrap == 4, F.replace(item, F.lit("}"), F.lit(", }")))
        .when(wrap == 5, F.replace(item, F.lit('"'), F.lit("'")))
        .when(wrap == 6, around("no json { here ", F.col("event_type"), ""))
        .otherwise("")
    )
    return x.events.select("event_id", text.alias("text"))


@query(
    "h13_json_in_text",
    f"""SELECT event_id, CASE WHEN wrap >= 6 THEN 'none' WHEN wrap = 3 THEN 'array' ELSE 'object' END AS kind,
        CASE WHEN wrap >= 6 THEN NULL ELSE event_type END AS category FROM {_BASE}""",
    None,
)
def json_in_text(x):
    found = _answers(x).select("event_id", J.json_in_text(F.col("text")).alias("v"))
    schema = F.schema_of_variant("v")
    first = F.coalesce(
        F.try_variant_get("v", "$.category", "string"), F.try_variant_get("v", "$[0].category", "string")
    )
    kind = (
        F.when(F.col("v").isNull(), F.lit("none"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .otherwise("object")
    )
    return found.select("event_id", kind.alias("kind"), first.alias("category"))


@query(
    "h14_classification_answers",
    f"""SELECT event_id, i AS item_ord, CASE event_id % 3 WHEN 2 THEN 'unknown' ELSE 'e' || event_id END AS result_id,
        CASE event_id % 5 WHEN 4 THEN 'Unknown' ELSE event_type END AS category,
        CASE event_id % 4 WHEN 0 THEN k + 0.5 WHEN 1 THEN k WHEN 2 THEN 0 ELSE k END::DOUBLE AS confidence,
        CASE WHEN event_id % 7 = 0 THEN 'medium' ELSE 'low' END AS severity,
        CASE event_id % 6 WHEN 0 THEN 'No explanation provided' ELSE 'why ' || user_id END AS explanation,
        CASE WHEN event_id % 2 = 0 THEN '' ELSE 'note' END AS insight
        FROM {_BASE}, range(2) r(i) WHERE i = 0 OR event_id % 9 = 0""",
    None,
)
def classification_answers(x):
    e, k = F.col("event_id"), F.col("k").cast("string")

    def pick(by, *options):
        chosen = F.lit("")
        for i, option in enumerate(options):
            chosen = F.when(e % by == i, option).otherwise(chosen)
        return chosen

    who = F.concat(F.lit("e"), e.cast("string"))
    name = F.format_string('"id": "%s", ', who)
    alias = F.format_string('"id": "", "logId": "%s", ', who)
    category = F.format_string('"category": "%s", ', F.col("event_type"))
    other = F.format_string('"classification": "%s", ', F.col("event_type"))
    why = F.format_string('"reason": "why %d", ', F.col("user_id"))
    item = F.concat(
        F.lit("{"),
        pick(3, name, alias, F.lit("")),
        pick(5, category, other, category, other, F.lit('"category": null, ')),
        pick(
            4,
            F.format_string('"confidence": %s.5, ', k),
            F.format_string('"confidence": "%s%%", ', k),
            F.lit('"confidence": "high", '),
            F.format_string('"confidence": %s, ', k),
        ),
        F.when(e % 7 == 0, F.lit('"severity": "", ')).otherwise('"severity": "low", '),
        F.when(e % 6 == 0, F.lit("")).otherwise(why),
        F.when(e % 2 == 0, F.lit('"x": 1')).otherwise('"insight": "note"'),
        F.lit("}"),
    )
    many = F.concat(F.lit('{"classifications": ['), item, F.lit(", "), item, F.lit("]}"))
    answers = x.events.select("event_id", F.when(e % 9 == 0, many).otherwise(item).alias("text"))
    return J.classification_rows(answers).withColumn("item_ord", F.col("item_ord").cast("long"))


@query(
    "h15_timeline_answers",
    f"""SELECT event_id, i AS item_ord, 'T' || k AS timestamp,
        CASE WHEN event_id % 2 = 0 THEN 'Unnamed Event' ELSE 'title ' || event_type END AS event_title,
        'error' AS severity, 'No summary' AS summary, 'warn/slow/;' AS steps, 'a,b' AS evidence, '' AS components,
        CASE WHEN event_id % 3 = 0 THEN 'Timeline generated from log data' ELSE 'sum' END AS overall_summary
        FROM {_BASE}, range(2) r(i)""",
    None,
)
def timeline_answers(x):
    e = F.col("event_id")
    event = F.concat(
        F.format_string('{"time": "T%d", "level": "error", ', "k"),
        F.when(e % 2 == 1, F.format_string('"title": "title %s", ', "event_type")).otherwise(""),
        F.lit('"escalation_path": [{"level": "warn", "message": "slow"}], "logs": ["a", "b"]}'),
    )
    key = F.when(e % 5 == 0, F.lit("events")).otherwise("timeline")
    told = F.when(e % 3 == 0, F.lit("")).otherwise(', "summary": "sum"')
    text = F.concat(F.lit('{"'), key, F.lit('": ['), event, F.lit(","), event, F.lit("]"), told, F.lit("}"))
    rows = J.timeline_rows(x.events.select("event_id", text.alias("text")))
    steps = F.transform(
        "escalation_path",
        lambda s: F.concat(s["level"], F.lit("/"), s["description"], F.lit("/"), s["timestamp"], F.lit(";")),
    )
    return rows.select(
        "event_id",
        F.col("item_ord").cast("long").alias("item_ord"),
        "timestamp",
        "event_title",
        "severity",
        "summary",
        F.array_join(steps, "").alias("steps"),
        F.array_join("supporting_evidence", ",").alias("evidence"),
        F.array_join("affected_components", ",").alias("components"),
        "overall_summary",
    )


@query(
    "h16_root_cause_answers",
    f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Unable to determine root cause' ELSE 'cause ' || event_type END AS root_cause,
        'seen/N/A/' || k || '/N/A' AS evidence, 's1>s2' AS causal_chain, 'Impact not assessed' AS impact,
        'act/medium/N/A' AS recommendations, k::DOUBLE AS confidence,
        CASE WHEN event_id % 3 = 0 THEN 'n' END AS analysis_notes FROM {_BASE}""",
    None,
)
def root_cause_answers(x):
    e = F.col("event_id")
    text = F.concat(
        F.lit("{"),
        F.when(e % 4 == 0, F.lit("")).otherwise(F.format_string('"root_cause": "cause %s", ', "event_type")),
        F.format_string('"evidence": [{"observation": "seen", "count": %d}], ', "k"),
        F.lit('"chain": ["s1", "s2"], "recommendations": [{"recommendation": "act"}], '),
        F.when(e % 3 == 0, F.lit('"notes": "n", ')).otherwise(""),
        F.format_string('"confidence": "%d"}', "k"),
    )
    rows = J.root_cause_rows(x.events.select("event_id", text.alias("text")))

    def flat(column, names):
        one = F.transform(column, lambda s: F.concat_ws("/", *[s[n].cast("string") for n in names]))
        return F.array_join(one, ";").alias(column)

    return rows.select(
        "event_id",
        "root_cause",
        flat("evidence", ("finding", "log_pattern", "occurrences", "significance")),
        F.array_join("causal_chain", ">").alias("causal_chain"),
        "impact",
        flat("recommendations", ("action", "priority", "rationale")),
        "confidence",
        "analysis_notes",
    )


@query(
    "h17_without_fence",
    """SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 THEN 'say ```json' || chr(10) || text ELSE text END) AS h FROM documents""",
    None,
)
def without_fence(x):
    docs = x.table("documents")
    kind = F.col("doc_id") % 3
    fenced = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .otherwise(F.concat(F.lit("say ```json\n"), "text"))
    )
    return docs.select("doc_id", F.sha2(J.without_fence(fenced).cast("binary"), 256).alias("h"))


# --- classification with the rule model ---

_RULES = """CASE WHEN contains(lower(message), 'forbidden') THEN 'Security' WHEN contains(lower(message), 'nikto') THEN 'Security'
  WHEN contains(lower(message), 'error state') THEN 'Service Instability' WHEN contains(lower(message), 'workerenv.init') THEN 'Configuration'
  WHEN contains(lower(message), 'found child') THEN 'Worker Initialization' WHEN contains(lower(message), 'slow') THEN 'Performance'
  WHEN contains(lower(message), 'status 404') THEN 'Resource Not Found' WHEN contains(lower(message), 'status 403') THEN 'Security'
  WHEN contains(lower(message), 'get /') OR contains(lower(message), 'post /') THEN 'Request Processing'
  WHEN level = 'error' THEN 'Error' WHEN level = 'warn' THEN 'Warning' ELSE 'Unknown' END"""
_SURE = """CASE WHEN contains(lower(message), 'forbidden') THEN 90 WHEN contains(lower(message), 'nikto') THEN 85
  WHEN contains(lower(message), 'error state') THEN 80 WHEN contains(lower(message), 'workerenv.init') THEN 88
  WHEN contains(lower(message), 'found child') THEN 92 WHEN contains(lower(message), 'slow') THEN 75
  WHEN contains(lower(message), 'status 404') THEN 95 WHEN contains(lower(message), 'status 403') THEN 82
  WHEN contains(lower(message), 'get /') OR contains(lower(message), 'post /') THEN 70
  WHEN level IN ('error', 'warn') THEN 60 ELSE 30 END"""
_CLASSIFIED = f""", cls AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal, {_RULES} AS category,
  CAST({_SURE} AS DOUBLE) AS confidence,
  CASE level WHEN 'error' THEN 'high' WHEN 'warn' THEN 'medium' WHEN 'notice' THEN 'info' WHEN 'info' THEN 'info' ELSE 'low' END AS severity,
  level || ' line' AS explanation FROM patterns), clsi AS (SELECT *, category || ' activity' AS insight FROM cls)"""
_CLASSIFICATIONS: dict = {}


def _classification(x, variant="error"):
    key = (x.spark.sparkContext.applicationId, x.sf_dir, variant)
    if key not in _CLASSIFICATIONS:
        _CLASSIFICATIONS[key] = analysis.classify(x.store(variant), rule_model)
    return _CLASSIFICATIONS[key]


_CLS_COLS = "id, ordinal, level, occurrence_count, category, confidence, severity, explanation, insight"


@query("j1_classify", _CLASSIFIED + f" SELECT {_CLS_COLS} FROM clsi")
def classify(x):
    return analysis.classify(x.store(), rule_model).classified.select(*_CLS_COLS.split(", "))


@query("j1_classify_access", _CLASSIFIED + f" SELECT {_CLS_COLS} FROM clsi", "access")
def classify_access(x):
    return _classification(x, "access").classified.select(*_CLS_COLS.split(", "))


@query(
    "j1_classify_given_lines",
    ", t AS (SELECT *, " + _RULES + " AS category FROM logs) SELECT level, category, count(*) AS n FROM t GROUP BY ALL",
)
def classify_given_lines(x):
    lines = analysis.lines_as_patterns(x.parsed())
    done = analysis.classify_patterns(lines, reports.DatasetFacts.of(x.store()), rule_model)
    return done.classified.groupBy("level", "category").agg(F.count("*").alias("n"))


@query(
    "d11_summary",
    _CLASSIFIED
    + """ SELECT count(*) AS total_classified, floor(avg(confidence) + 0.5)::BIGINT AS average_confidence,
    (SELECT category FROM clsi GROUP BY category ORDER BY count(*) DESC, min(ordinal) LIMIT 1) AS dominant_category FROM clsi""",
)
def summary(x):
    return _classification(x).summary()


@query("d11_category_counts", _CLASSIFIED + " SELECT category, count(*) AS pattern_count, sum(confidence) AS confidence_sum, min(ordinal) AS first_ord FROM clsi GROUP BY category")
def category_counts(x):
    return C.category_counts(_classification(x).classified)


_DIST = """, cells AS (SELECT category, severity, count(*) AS p, sum(occurrence_count)::BIGINT AS l, min(ordinal) AS o FROM clsi GROUP BY ALL),
  dist AS (SELECT category, sum(p)::BIGINT AS pattern_count, sum(l)::BIGINT AS log_count, min(o) AS first_ord,
    (SELECT severity FROM cells c WHERE c.category = cells.category ORDER BY l DESC, o LIMIT 1) AS dominant_severity,
    floor(sum(l)::DOUBLE / (SELECT sum(occurrence_count) FROM clsi) * 1000 + 0.5) / 10 AS percentage,
    (SELECT arg_min(insight, ordinal) FROM clsi c WHERE c.category = cells.category) AS insight
    FROM cells GROUP BY category)"""


@query("d12_distribution", _CLASSIFIED + _DIST + " SELECT * FROM dist")
def distribution(x):
    return _classification(x).distribution().drop("severity_breakdown")


@query("d12_severity_breakdown", _CLASSIFIED + _DIST + " SELECT category, severity, l AS logs FROM cells")
def severity_breakdown(x):
    return _classification(x).distribution().select(
        "category", F.explode("severity_breakdown").alias("severity", "logs")
    )


@query("f09_distribution_order", _CLASSIFIED + _DIST + " SELECT category, log_count, row_number() OVER (ORDER BY log_count DESC, first_ord)::INT AS place FROM dist")
def distribution_order(x):
    from pyspark.sql import Window

    rows = C.in_display_order(_classification(x).distribution())
    place = F.row_number().over(Window.orderBy(F.col("log_count").desc(), "first_ord"))
    return rows.select("category", "log_count", place.alias("place"))


@query(
    "e06_cumulative_share",
    _CLASSIFIED + _DIST
    + """ SELECT category, log_count, (r - log_count)::DOUBLE / t AS share_start, r::DOUBLE / t AS share_end FROM
    (SELECT *, sum(log_count) OVER (ORDER BY log_count DESC, first_ord) AS r, sum(log_count) OVER () AS t FROM dist)""",
)
def cumulative_share(x):
    return C.cumulative_share(_classification(x).distribution())


@query(
    "d13_usage",
    """SELECT coalesce(role, 'total') AS stage, sum(length(text))::BIGINT AS prompt_token_count,
       sum(turn)::BIGINT AS candidates_token_count, sum(length(text) + turn)::BIGINT AS total_token_count
       FROM conversations GROUP BY ROLLUP (role)""",
    None,
)
def usage(x):
    rows = x.table("conversations").select(
        F.col("role").alias("stage"),
        F.length("text").alias("prompt_token_count"),
        F.col("turn").alias("candidates_token_count"),
        (F.length("text") + F.col("turn")).alias("total_token_count"),
    )
    return C.usage_by_stage(rows)


@query(
    "d15_totals",
    "SELECT count(*) AS total_classified, sum(occurrence_count)::BIGINT AS total_logs_represented, ceil(count(*) / 150.0)::BIGINT AS batches_processed FROM patterns",
)
def totals(x):
    return _classification(x).totals()


@query(
    "d17_batch_summaries",
    """SELECT * FROM (SELECT conv_id AS batch_id, arg_min(text, turn) AS summary FROM conversations GROUP BY conv_id) WHERE summary <> ''""",
    None,
)
def batch_summaries(x):
    opening = x.table("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("overall_summary"))
    return analysis.batch_summaries(opening.withColumnRenamed("conv_id", "batch_id"))


@query(
    "c05_merged_results",
    f"""SELECT event_id AS ordinal, event_id // 100 AS batch_id,
        CASE WHEN event_id % 100 >= 90 THEN 'Unknown' WHEN event_id % 2 = 0 THEN event_type
        ELSE (SELECT e.event_type FROM events e WHERE e.event_id = b.event_id + CASE WHEN b.event_id % 100 % 2 = 1 THEN -1 ELSE 0 END) END AS category,
        CASE WHEN event_id % 100 >= 90 THEN 0.0::DOUBLE ELSE k END::DOUBLE AS confidence FROM
        (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN k ELSE lag(k) OVER (ORDER BY event_id) END AS k FROM {_BASE}) b""",
    None,
)
def merged_results(x):
    """Batches of 100 events. Answers exist for the even ones below 90, twice, in pairs of places."""
    e = F.col("event_id")
    place = e % 100
    batches = x.events.select(
        e.alias("ordinal"),
        F.expr("event_id div 100").alias("batch_id"),
        place.alias("batch_ord"),
        e.cast("string").alias("id"),
    )
    answers = x.events.where((place < 90) & (e % 2 == 0))
    copies = answers.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    results = copies.select(
        F.expr("event_id div 100").alias("batch_id"),
        (place + F.col("shift")).cast("int").alias("item_ord"),
        # The second copy repeats the id with another category: the first must win.
        e.cast("string").alias("result_id"),
        F.col("event_type").alias("category"),
        F.col("k").cast("double").alias("confidence"),
        F.lit("low").alias("severity"),
        F.lit("").alias("explanation"),
        F.lit("").alias("insight"),
    )
    return C.merge_results(batches, results).select("ordinal", "batch_id", "category", "confidence")


_EVENT_TS = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d/%m/%Y %I:%M:%S %p') WHEN 1 THEN strftime(ts, '%I:%M %p %d/%m/%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END"
_MERGED = f"""WITH ev AS (SELECT event_id % 7 AS batch_id, event_id AS item_ord, {_EVENT_TS} AS timestamp,
  CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) END AS event_ts FROM events)
  SELECT item_ord, batch_id, timestamp, {ISO.format('event_ts')} AS event_ts,
    row_number() OVER (ORDER BY event_ts NULLS LAST, batch_id, item_ord) AS sequence FROM ev"""


def _drafted_events(x):
    e = F.col("event_id")
    stamp = (
        F.when(e % 4 == 0, F.date_format("ts", "dd/MM/yyyy hh:mm:ss a"))
        .when(e % 4 == 1, F.date_format("ts", "hh:mm a dd/MM/yyyy"))
        .when(e % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("soon")
    )
    return x.events.select((e % 7).alias("batch_id"), e.alias("item_ord"), stamp.alias("timestamp"))


@query("f08_merged_events", _MERGED + " ORDER BY sequence LIMIT 50", None)
def merged_events(x):
    return analysis.merge_events(_drafted_events(x), 50).withColumn("event_ts", iso_text(F.col("event_ts")))


@query("e05_sequence_numbers", _MERGED, None)
def sequence_numbers(x):
    return analysis.merge_events(_drafted_events(x)).withColumn("event_ts", iso_text(F.col("event_ts")))


# --- text contexts, compared line by line ---

_LINES = """ SELECT batch_id, unnest(generate_series(0, len(l) - 1))::INT AS line_no, unnest(l) AS line
  FROM (SELECT batch_id, string_split(context, chr(10)) AS l FROM text)"""
_FACTS = f""", facts AS (SELECT count(*) AS total, {ISO.format('min(ts)')} AS lo, {ISO.format('max(ts)')} AS hi FROM logs),
  lj AS (SELECT '{{' || string_agg('"' || level || '":' || n, ',' ORDER BY p) || '}}' AS levels FROM
    (SELECT level, count(*) AS n, min(pos) AS p FROM logs GROUP BY level))"""
NL = " || chr(10) || "


def _iso_or(column: str, missing: str) -> str:
    return f"coalesce({ISO.format(column)}, '{missing}')"


_CLASS_TEXT = (
    _BATCHED.format(where="TRUE", size=150)
    + _FACTS
    + f""", entries AS (SELECT batch_id, count(*) AS n, string_agg('[ID: ' || id || ']' {NL} '  Level: ' || level {NL} '  Message: ' || message
    {NL} '  Occurrences: ' || occurrence_count {NL} '  First seen: ' || {_iso_or('first_seen', 'N/A')}
    {NL} '  Last seen: ' || {_iso_or('last_seen', 'N/A')} {NL} '  Raw: ' || raw || chr(10), chr(10) ORDER BY batch_ord) AS e
    FROM batches GROUP BY batch_id),
  text AS (SELECT batch_id, '=== LOG DATASET SUMMARY ===' {NL} 'Total logs in dataset: ' || total {NL} 'Unique patterns to classify: ' || n
    {NL} 'Time range: ' || lo || ' to ' || hi {NL} 'Level distribution: ' || levels {NL} '' {NL} '=== DEDUPLICATED LOG PATTERNS ==='
    {NL} e AS context FROM entries, facts, lj)"""
)


@query("i1_classification_context", _CLASS_TEXT + _LINES)
def classification_context(x):
    batches = P.in_batches(x.patterns, 150)
    contexts = reports.classification_contexts(batches, reports.DatasetFacts.of(x.store()))
    return reports.context_lines(contexts)


@query(
    "d20_context_reduction",
    _CLASS_TEXT
    + """ SELECT sum(strlen(context))::BIGINT AS context_bytes, (SELECT sum(strlen(raw))::BIGINT FROM logs) AS raw_bytes,
    1 - sum(strlen(context))::DOUBLE / (SELECT sum(strlen(raw)) FROM logs) AS reduction FROM text""",
)
def context_reduction(x):
    batches = P.in_batches(x.patterns, 150)
    contexts = reports.classification_contexts(batches, reports.DatasetFacts.of(x.store()))
    return reports.context_reduction(x.store(), contexts)


_TAG = "'[' || upper(level) || ']'"
_HOUR = "coalesce(strftime(ts, '%Y-%m-%dT%H:00'), 'unknown-time')"
_SIGNALS = (
    _FACTS
    + ", sig AS ("
    + signals_sql("patterns", "raw || ' ' || message", "level, message, occurrence_count, pos")
    + f"""), sigt AS (SELECT no // @PER AS batch_id, chr(10) || chr(10) || '=== SECURITY SIGNALS (Critical Context) ===' || chr(10) ||
    string_agg('[' || type || '] ' || {_TAG} || ' ' || message || ' | x' || occurrence_count, chr(10) ORDER BY no) AS t
    FROM (SELECT *, row_number() OVER (ORDER BY pos, type_ord) - 1 AS no FROM sig) GROUP BY ALL)"""
)
_STORY = f""", cht AS (SELECT string_agg(line, chr(10) ORDER BY chain_no, step) AS t FROM
    (SELECT chain_no, step, CASE WHEN step = 0 THEN '--- Chain ' || (chain_no + 1) || ' (x' || chain_count || ') ---' || chr(10) ELSE '' END
      || CASE WHEN {FAILURE} THEN '  → ' ELSE '  ' END || {_TAG} || ' ' || message AS line FROM crows JOIN logs ON pos = at_pos)),
  nt AS (SELECT string_agg(line, chr(10) ORDER BY window_id, pos) AS t FROM
    (SELECT window_id, l.pos, CASE WHEN l.pos = greatest(centre - 3, 0) THEN '--- Incident at ' ||
       (SELECT {_iso_or('c.ts', 'null')} FROM logs c WHERE c.pos = centre) || ' ---' || chr(10) ELSE '' END
      || CASE WHEN l.pos = centre THEN '>>> ' ELSE '    ' END || {_TAG} || ' ' || message AS line
     FROM nar JOIN logs l ON l.pos BETWEEN centre - 3 AND centre + 2))"""
_WHOLE_STORY = _FIRST_CHAINS + ", " + _PICKED + _STORY


def _timeline_text(source: str, order: str, supplement: str = "", per: int = 1000, story: str = _WHOLE_STORY) -> str:
    return (
        _SIGNALS.replace("@PER", str(per))
        + story
        + f""", ent AS (SELECT batch_id, {order} AS o, {_HOUR} AS hour, {_TAG} || ' ' || message || ' | x' || occurrence_count || ' | First: ' ||
      {_iso_or('first_seen', 'N/A')} || ' | Last: ' || {_iso_or('last_seen', 'N/A')} AS line FROM {source}),
    hrs AS (SELECT batch_id, hour, min(o) AS o, count(*) AS n, chr(10) || '--- ' || hour || ' ---' || chr(10) || string_agg(line, chr(10) ORDER BY o) AS t FROM ent GROUP BY batch_id, hour),
    secs AS (SELECT batch_id, sum(n)::BIGINT AS n, string_agg(t, chr(10) ORDER BY o) AS t FROM hrs GROUP BY batch_id),
    joint AS (SELECT coalesce(secs.batch_id, sigt.batch_id) AS batch_id, coalesce(n, 0) AS n, secs.t AS st, sigt.t AS gt FROM secs FULL JOIN sigt USING (batch_id)),
    text AS (SELECT batch_id, '=== LOG DATASET SUMMARY ===' {NL} 'Total logs in file: ' || total {NL} 'Unique log patterns: ' || (SELECT count(*) FROM patterns)
      {NL} 'Error/Warning patterns: ' || n {NL} 'Time range: ' || lo || ' to ' || hi {NL} 'Levels breakdown: ' || levels {NL} ''
      {NL} '=== ERROR/WARNING PATTERNS BY TIME WINDOW ===' || coalesce(chr(10) || st, '') || coalesce(gt, '')
      || coalesce(chr(10) || chr(10) || '=== INCIDENT ESCALATION CHAINS ===' || chr(10) || cht.t, '')
      || coalesce(chr(10) || chr(10) || '=== CHRONOLOGICAL INCIDENT NARRATIVE ===' || chr(10) || nt.t, '') {supplement} AS context
      FROM joint, facts, lj, cht, nt)"""
    )


@query(
    "i2_timeline_context",
    _BATCHED.format(where=PROBLEM, size=60) + _timeline_text("batches", "batch_ord", per=7) + _LINES,
)
def timeline_context(x):
    """More chunks of signals than batches of patterns."""
    batches = P.in_batches(select.focus(x.patterns, "errors"), 60)
    contexts = reports.timeline_contexts(
        x.store(), batches, reports.DatasetFacts.of(x.store()), signals_per_batch=7
    )
    return reports.context_lines(contexts)


_RANGE = """, every AS (SELECT * FROM logs), ranged AS (SELECT * REPLACE (row_number() OVER (ORDER BY pos) - 1 AS pos) FROM every
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'), logs_in AS (SELECT * FROM ranged)"""
_RANGE_STORY = _RANGE + (_FIRST_CHAINS + ", " + _PICKED + _STORY).replace("FROM logs", "FROM logs_in").replace("JOIN logs", "JOIN logs_in")


@query(
    "c06_ranged_context",
    _BATCHED.format(where=PROBLEM, size=60) + _timeline_text("batches", "batch_ord", story=_RANGE_STORY) + _LINES,
)
def ranged_context(x):
    """All patterns, with chains and narrative of one day."""
    batches = P.in_batches(select.focus(x.patterns, "errors"), 60)
    facts = reports.DatasetFacts.of(x.store())
    return reports.context_lines(
        reports.timeline_contexts(x.store(), batches, facts, "2024-01-05", "2024-01-06")
    )


_SUPPLEMENT = f"""|| chr(10) || chr(10) || '=== SUPPLEMENTARY: TOP NON-ERROR PATTERNS ===' || chr(10) ||
  (SELECT string_agg({_TAG} || ' ' || message || ' | x' || occurrence_count, chr(10) ORDER BY occurrence_count DESC, pos) FROM
   (SELECT * FROM patterns WHERE level NOT IN ('error', 'warn', 'crit') ORDER BY occurrence_count DESC, pos LIMIT 10))"""


@query(
    "i2_capped_timeline_context",
    _CAP + ", capb AS (SELECT 0::BIGINT AS batch_id, * FROM cap)" + _timeline_text("capb", "cap_ord", _SUPPLEMENT) + _LINES,
    "access",
)
def capped_timeline_context(x):
    store = x.store("access")
    contexts = reports.capped_timeline_context(store, store.patterns, reports.DatasetFacts.of(store))
    return reports.context_lines(contexts)


def _rca_text(list_order: str, keep: str = "TRUE") -> str:
    return (
        _FACTS
        + f""", gl AS (SELECT batch_id, string_agg({_TAG} || ' ' || message || ' | Occurrences: ' || n || ' | First: ' || {_iso_or('first_ts', 'N/A')}
      || ' | Last: ' || {_iso_or('last_ts', 'N/A')} || ' | IDs: ' || array_to_string(ids, ', ') || CASE WHEN n > 5 THEN '...' ELSE '' END,
      chr(10) ORDER BY {list_order}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, pos) AS rk, count(*) OVER (PARTITION BY batch_id) AS un FROM grp) WHERE {keep} GROUP BY batch_id),
    gn AS (SELECT batch_id, count(*) AS u FROM grp GROUP BY batch_id),
    cx AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM ctx),
    el AS (SELECT batch_id, max(n) AS n, string_agg('[' || {_iso_or('ts', 'null')} || '] ' || {_TAG} || ' ' || message, chr(10) ORDER BY r) AS t FROM cx
      WHERE n <= 60 OR r IN (SELECT floor(i * (cx.n / 60.0::DOUBLE)) FROM range(60) g(i)) GROUP BY batch_id),
    text AS (SELECT batch_id, '=== ROOT CAUSE ANALYSIS CONTEXT ===' {NL} 'Total logs in dataset: ' || total {NL} 'Error/Warning logs analyzed: ' || n
      {NL} 'Unique error patterns: ' || u {NL} 'Time range: ' || lo || ' to ' || hi {NL} '' {NL} '=== ERROR PATTERNS ===' {NL} gl.t {NL} ''
      {NL} '=== CHRONOLOGICAL EVENT SEQUENCE ===' {NL} el.t AS context FROM gl JOIN gn USING (batch_id) JOIN el USING (batch_id), facts)"""
    )


# The groups are sorted by count only when there are too many of them.
_CAPPED_ORDER = "CASE WHEN un > 30 THEN rk ELSE pos END"


@query("i3_root_cause_context", _PATTERN_CONTEXT + _GROUPS + _rca_text("pos") + _LINES)
def root_cause_context(x):
    batches = P.in_batches(select.problems(x.patterns), 20)
    contexts = reports.pattern_batch_contexts(x.store(), batches, reports.DatasetFacts.of(x.store()))
    return reports.context_lines(contexts)


@query("i3_capped_batch_context", _PATTERN_CONTEXT + _GROUPS + _rca_text(_CAPPED_ORDER, "rk <= 30") + _LINES)
def capped_batch_context(x):
    batches = P.in_batches(select.problems(x.patterns), 20)
    contexts = reports.pattern_batch_contexts(x.store(), batches, reports.DatasetFacts.of(x.store()), cap=30)
    return reports.context_lines(contexts)


@query(
    "i3_whole_context",
    f", ctx AS (SELECT 0::BIGINT AS batch_id, * FROM logs WHERE pos IN ({near_sql(PROBLEM, 5)}))"
    + _GROUPS
    + _rca_text(_CAPPED_ORDER, "rk <= 30")
    + _LINES,
)
def whole_context(x):
    near = context.error_context(x.logs)
    return reports.context_lines(reports.whole_root_cause_context(near, reports.DatasetFacts.of(x.store())))


@query(
    "i4_entry_list",
    f"""SELECT pos, '[ID: ' || id || '] [' || {_iso_or('ts', 'N/A')} || '] [' || level || '] ' || message {NL} '  Surrounding context:' {NL}
        '    ' || raw {NL} '    ' || level || chr(10) AS block FROM logs
        UNION ALL SELECT -1, '=== LOG ENTRIES FOR REVIEW ===' {NL} 'Total entries: ' || count(*) || chr(10) FROM logs""",
)
def entry_list(x):
    entries = x.logs.withColumn("around", F.array("raw", "level"))
    return reports.entry_list(entries, "review", "around")


@query(
    "i5_prompt_text",
    """SELECT doc_id, 'Find the root cause in the data below.' || chr(10) || chr(10) || 'Reported symptom: "slow"' || chr(10) || chr(10)
       || 'Return only JSON.' || chr(10) || chr(10) || text AS prompt FROM documents""",
    None,
)
def prompt_text(x):
    prompt = prompts.root_cause_prompt(F.col("text"), "slow")
    return x.table("documents").select("doc_id", prompt.alias("prompt"))


# --- analyses that call the model function ---


_HOURS = f""", hr AS (SELECT batch_id, {_HOUR} AS h, count(*) AS n, bool_or({FAILURE}) AS bad, min(batch_ord) AS p FROM batches GROUP BY ALL)"""
_DRAFTED = """ SELECT row_number() OVER (ORDER BY h, batch_id) AS sequence, h AS timestamp, n || ' patterns' AS event_title,
      CASE WHEN bad THEN 'error' ELSE 'info' END AS severity FROM hr"""


@query("j2_timeline", _BATCHED.format(where=PROBLEM, size=20) + _HOURS + _DRAFTED)
def timeline(x):
    events = analysis.timeline(x.store(), rule_model, "errors", batch_size=20).events
    return events.select("sequence", "timestamp", "event_title", "severity")


@query(
    "j2_timeline_metadata",
    f""", hr AS (SELECT DISTINCT {_HOUR} AS h FROM patterns WHERE {PROBLEM})
    SELECT (SELECT count(*) FROM logs) AS total_logs_analyzed, (SELECT count(*) FROM patterns WHERE {PROBLEM}) AS unique_patterns_used,
    (SELECT {ISO.format('min(ts)')} FROM logs) AS range_start, (SELECT {ISO.format('max(ts)')} FROM logs) AS range_end,
    'errors' AS focus, least(8, (SELECT count(*) FROM hr)) AS events_generated""",
)
def timeline_metadata(x):
    return analysis.timeline(x.store(), rule_model, "errors", 8).metadata


_STATUS = """ SELECT batch_id, CASE WHEN cut THEN 'unreadable' ELSE 'no_answer' END AS status FROM
  (SELECT batch_id, bool_or(contains(message, 'forbidden by')) AS cut, bool_or(contains(message, 'slow backend')) AS lost FROM {0} GROUP BY 1)
  WHERE cut OR lost"""


@query("j2_failed_batches", _BATCHED.format(where=PROBLEM, size=5) + _STATUS.format("batches"))
def timeline_failures(x):
    found = analysis.timeline(x.store(), garbled, "errors", batch_size=5, on_failed="keep")
    return found.failed.select("batch_id", "status")


_WORST = """SELECT message FROM grp ORDER BY level <> 'error', n DESC, pos LIMIT 1"""


@query(
    "j3_root_cause",
    _BATCHED.format(where=PROBLEM + " AND contains(lower(message), 'error state')", size=1000)
    + """, ctx AS (SELECT DISTINCT b.batch_id, l.pos, l.id, l.ts, l.level, l.message, l.fingerprint FROM batches b
          JOIN logs l ON l.pos BETWEEN b.pos - 5 AND b.pos + 5)"""
    + _GROUPS
    + f""" SELECT ({_WORST}) AS root_cause, count(*) || ' patterns involved' AS impact, 50.0::DOUBLE AS confidence,
    'Symptom search: "Error State"' AS analysis_scope FROM grp""",
)
def root_cause(x):
    found = analysis.root_cause(x.store(), rule_model, symptom="Error State")
    scope = found.metadata.select("analysis_scope").scalar()
    return found.report.select("root_cause", "impact", "confidence", scope.alias("analysis_scope"))


@query(
    "j3_merged_reports",
    _PATTERN_CONTEXT
    + _GROUPS
    + """, evid AS (SELECT batch_id, message, n, row_number() OVER (PARTITION BY batch_id ORDER BY level <> 'error', n DESC, pos) AS k FROM grp QUALIFY k <= 3)
    SELECT (SELECT message FROM evid ORDER BY n DESC, batch_id, k LIMIT 1) AS root_cause, count(*) || ' patterns involved' AS impact FROM evid""",
)
def merged_reports(x):
    """Reports of several batches, merged in one call."""
    return analysis.root_cause(x.store(), rule_model, batch_size=20).report.select("root_cause", "impact")


@query(
    "j3_failed_batches",
    _PATTERN_CONTEXT.replace("// 20", "// 2").replace("% 20", "% 2") + _GROUPS + _STATUS.format("grp"),
)
def root_cause_failures(x):
    found = analysis.root_cause(x.store(), garbled, batch_size=2, on_failed="keep")
    return found.failed.select("batch_id", "status")


def _document_requests(x):
    return x.table("documents").select(
        F.lit("ask").alias("stage"),
        F.col("doc_id").alias("batch_id"),
        F.lit("s").alias("system_prompt"),
        F.col("text").alias("user_prompt"),
    )


_FALLBACK = """FROM (SELECT doc_id AS batch_id, length(text) AS n FROM documents)"""


@query(
    "j4_fallback_answers",
    f"""SELECT batch_id, CASE WHEN n % 2 = 0 THEN n::VARCHAR WHEN n % 3 <> 0 THEN 'backup' END AS text,
        CASE WHEN n % 2 = 0 THEN 0 WHEN n % 3 <> 0 THEN 1 END AS model_ord,
        CASE WHEN n % 2 = 1 AND n % 3 = 0 THEN 'no answer' END AS error {_FALLBACK}""",
    None,
)
def fallback_answers(x):
    return ask(_document_requests(x), [even_only, no_thirds]).select("batch_id", "text", "model_ord", "error")


@query("l2_model_function", "SELECT doc_id AS batch_id, CASE WHEN length(text) % 2 = 0 THEN length(text)::VARCHAR END AS text FROM documents", None)
def model_function(x):
    return ask(_document_requests(x), even_only).select("batch_id", "text")


@query(
    "l3_key_function",
    f"SELECT substr(message, 1, 3) AS key, count(*) AS n, min(pos) AS first_pos FROM logs GROUP BY 1",
)
def key_function(x):
    return P.group_in_order(x.logs, F.substring("message", 1, 3))


@query(
    "a16_audit_records",
    "SELECT 'classification' AS stage, ordinal // 150 AS batch_id, count(*) AS items FROM (SELECT row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM patterns) GROUP BY ALL",
    "access",
)
def audit(x):
    path = working_path(x.spark, "audit")
    save_audit(_classification(x, "access").responses, path)
    records = x.spark.read.json(path)
    items = F.size(F.from_json("parsed", "array<string>"))
    return records.select("stage", "batch_id", items.cast("long").alias("items"))


@query(
    "a16_ledger_contents",
    _CLASSIFIED + " SELECT 'classification' AS stage, ordinal // 150 AS batch_id, id, category, confidence, severity, explanation, insight FROM clsi",
    "access",
)
def ledger_contents(x):
    """Every answer of an analysis that ran twice, from its ledger: one record a call."""
    ledger = working_path(x.spark, "ledger")
    for _ in range(2):
        analysis.classify(x.store("access"), rule_model, ledger=ledger)
    items = "array<struct<id string, category string, confidence double, severity string, explanation string, insight string>>"
    records = read_audit(x.spark, ledger)
    return records.select("stage", "batch_id", F.explode(F.from_json("parsed", items)).alias("item")).select("stage", "batch_id", "item.*")


@query(
    "j5_full_analysis",
    _CLASSIFIED
    + _BATCHED.format(where=PROBLEM, size=1000)
    + """, ctx AS (SELECT DISTINCT b.batch_id, l.pos, l.id, l.ts, l.level, l.message, l.fingerprint FROM batches b
          JOIN logs l ON l.pos BETWEEN b.pos - 5 AND b.pos + 5)"""
    + _GROUPS
    + _HOURS
    + f""" SELECT 'category' AS part, category AS name, sum(occurrence_count)::BIGINT AS n FROM clsi GROUP BY category
    UNION ALL SELECT 'event', h || ' ' || n || ' patterns', n FROM (SELECT * FROM hr ORDER BY h LIMIT 8)
    UNION ALL SELECT 'cause', ({_WORST}), count(*) FROM grp""",
    "access",
)
def full_analysis(x):
    """Categories, events and cause of the chained analysis; no pattern names the dominant category."""
    found = analysis.analyze(x.store("access"), rule_model)
    number = lambda c: F.regexp_extract(c, r"^\d+", 0).cast("long").alias("n")
    parts = found.classification.distribution().select(F.lit("category").alias("part"), F.col("category").alias("name"), F.col("log_count").alias("n"))
    events = found.timeline.events.select(
        F.lit("event").alias("part"), F.concat_ws(" ", "timestamp", "event_title").alias("name"), number("event_title")
    )
    cause = found.root_cause.report.select(F.lit("cause").alias("part"), F.col("root_cause").alias("name"), number("impact"))
    return parts.unionByName(events).unionByName(cause)

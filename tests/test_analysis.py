"""Model answers, merging, summaries, reports and the analyses built on them."""

import json

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import checks.rule_model
import siltlog.plans.model
from checks.rule_model import rule_model
from siltlog.functions import json_text as J
from siltlog.operators import classify as C
from siltlog.operators import patterns as P
from siltlog.plans import analysis, prompts, reports
from siltlog.plans.model import TOKEN_COLUMNS, LostAnswers, ask, audit_records
from siltlog.sources.formats import parse
from siltlog.sources.store import LogStore
from tests.generator import generate

for module in (siltlog.plans.model, checks.rule_model):
    cloudpickle.register_pickle_by_value(module)

STAMP = "[Sun Dec 04 04:{:02d}:{:02d} 2005] [{}] {}"


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", F.to_json(J.json_in_text(F.col("text"))).alias("j")).orderBy("i").collect()
    return [None if r["j"] is None else json.loads(r["j"]) for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"a": 1}', {"a": 1}),
        ("  [1, 2]\n", [1, 2]),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure:\n```\n[{"a": 1}]\n```\nDone', [{"a": 1}]),
        ('The result {"a": {"b": 2}} follows', {"a": {"b": 2}}),
        ('Two: [{"a": 1}, {"a": 2}] end', [{"a": 1}, {"a": 2}]),
        # An array of one object inside prose gives the object.
        ('One: [{"a": 1}] end', {"a": 1}),
        ('{"a": [1, 2, ], }', {"a": [1, 2]}),
        ("{'a': 'b'}", {"a": "b"}),
        ('{"a": 1} tail', {"a": 1}),
        ("nothing here", None),
        ("{broken", None),
        ("", None),
    ],
)
def test_json_in_text(spark, text, expected):
    assert parsed(spark, text) == [expected]


def test_classification_defaults(spark):
    text = json.dumps(
        [
            {"id": 0, "logId": "x", "confidence": "85%", "description": "d"},
            {"id": "y", "classification": "Network", "confidence": None, "severity": ""},
        ]
    )
    df = spark.createDataFrame([(1, text)], "batch_id long, text string")
    a, b = J.classification_rows(df).orderBy("item_ord").collect()
    assert (a["result_id"], a["category"], a["confidence"], a["explanation"]) == ("x", "Unknown", 85.0, "d")
    assert (b["result_id"], b["category"], b["confidence"], b["severity"]) == ("y", "Network", 0.0, "medium")


@pytest.mark.parametrize(
    "given, used",
    [('"x"', "x"), ('""', "d"), ("0", "d"), ("0.0", "d"), ("false", "d"), ("null", "d"), ('"0"', "0"), ('"false"', "false"), ("7", "7"), ("true", "true")],
)
def test_what_counts_as_missing(spark, given, used):
    item = F.parse_json(F.lit('{"a": %s}' % given))
    assert spark.range(1).select(J.text_of(item, ("a", "b"), "d")).head()[0] == used


def test_single_answer_and_wrapped_answers(spark):
    df = spark.createDataFrame(
        [(1, '{"id": "a"}'), (2, '{"results": [{"id": "b"}, {"id": "c"}]}'), (3, "garbage"), (4, "null")],
        "batch_id long, text string",
    )
    rows = J.classification_rows(df).orderBy("batch_id", "item_ord").collect()
    assert [(r["batch_id"], r["result_id"]) for r in rows] == [(1, "a"), (2, "b"), (2, "c")]


def test_timeline_shapes(spark):
    one = '{"timeline": {"title": "t"}}'
    bare = '[{"event": "e", "escalationPath": [{}]}]'
    df = spark.createDataFrame([(1, one), (2, bare), (3, '{"timeline": []}')], "batch_id long, text string")
    rows = J.timeline_rows(df).where("item_ord is not null").orderBy("batch_id").collect()
    assert [(r["batch_id"], r["event_title"]) for r in rows] == [(1, "t"), (2, "e")]
    assert rows[1]["escalation_path"][0].asDict() == {"level": "info", "description": "", "timestamp": ""}


def test_root_cause_defaults(spark):
    df = spark.createDataFrame([(1, "{}")], "batch_id long, text string")
    row = J.root_cause_rows(df).head()
    assert row["root_cause"] == "Unable to determine root cause"
    assert (row["evidence"], row["causal_chain"], row["confidence"], row["analysis_notes"]) == ([], [], 0.0, None)


def test_merge_by_id_then_place_then_default(spark):
    batches = spark.createDataFrame(
        [(0, i, f"p{i}") for i in range(4)], "batch_id long, batch_ord long, id string"
    )
    results = spark.createDataFrame(
        [(0, 0, "p2", "A"), (0, 1, "zz", "B"), (0, 2, "p2", "C")],
        "batch_id long, item_ord int, result_id string, category string",
    ).selectExpr("*", "1.0D confidence", "'s' severity", "'e' explanation", "'' insight")
    rows = C.merge_results(batches, results).orderBy("batch_ord").collect()
    # p0 by place, p1 by place, p2 by its first id match, p3 has nothing.
    assert [r["category"] for r in rows] == ["A", "B", "A", "Unknown"]
    assert rows[3]["explanation"] == "Classification unavailable"


def classified(spark, rows):
    return spark.createDataFrame(
        rows, "ordinal long, category string, confidence double, severity string, insight string, occurrence_count long"
    )


def test_summary_and_distribution(spark):
    df = classified(
        spark,
        [
            (0, "B", 50.0, "low", "", 1),
            (1, "A", 51.0, "high", "first", 5),
            (2, "A", 52.0, "low", "second", 5),
            (3, "B", 53.0, "low", "late", None),
        ],
    )
    row = C.summary(df).head()
    # 51.5 rounds up; A and B tie, B was seen first.
    assert (row["total_classified"], row["average_confidence"], row["dominant_category"]) == (4, 52, "B")
    rows = {r["category"]: r for r in C.distribution(df).collect()}
    assert (rows["A"]["log_count"], rows["A"]["percentage"], rows["A"]["insight"]) == (10, 83.3, "first")
    assert rows["A"]["dominant_severity"] == "high"
    assert rows["A"]["severity_breakdown"] == {"high": 5, "low": 5}
    assert (rows["B"]["log_count"], rows["B"]["insight"]) == (2, "late")
    share = C.cumulative_share(C.distribution(df)).orderBy("share_start").collect()
    assert [r["category"] for r in share] == ["A", "B"] and share[-1]["share_end"] == 1.0


def test_empty_summary(spark):
    row = C.summary(classified(spark, [])).head()
    assert (row["total_classified"], row["average_confidence"], row["dominant_category"]) == (0, 0, "Unknown")
    assert C.distribution(classified(spark, [])).count() == 0


def test_usage_rollup(spark):
    df = spark.createDataFrame(
        [("a", 1, 2, 3), ("a", 1, 1, 2), ("b", None, 1, 1)], "stage string, " + ", ".join(f"{c} long" for c in TOKEN_COLUMNS)
    )
    rows = {r["stage"]: tuple(r)[1:] for r in C.usage_by_stage(df).collect()}
    assert rows == {"a": (2, 3, 5), "b": (0, 1, 1), "total": (2, 4, 6)}


def test_timeline_merge_order(spark):
    df = spark.createDataFrame(
        [(1, 0, "04/12/2005 04:00:00 PM"), (0, 1, "soon"), (0, 0, "2005-12-04T10:00"), (2, 0, "")],
        "batch_id long, item_ord int, timestamp string",
    )
    for cap, expected in ((None, [(0, 0), (1, 0), (0, 1), (2, 0)]), (2, [(0, 0), (1, 0)])):
        rows = analysis.merge_events(df, cap).orderBy("sequence").collect()
        assert [(r["batch_id"], r["item_ord"]) for r in rows] == expected
        assert [r["sequence"] for r in rows] == list(range(1, len(expected) + 1))


def test_events_per_batch():
    assert analysis.events_per_batch(None, 1) == 20
    assert analysis.events_per_batch(8, 4) == 3
    assert analysis.events_per_batch(50, 2) == 25


def test_scope_text():
    assert prompts.scope_text() == "All Logs"
    assert prompts.scope_text(ids=["a"]) == "1 specific logs"
    assert prompts.scope_text(time_range=("x", "y")) == "Time range: x to y"
    assert prompts.scope_text(symptom="s") == 'Symptom search: "s"'


def failing(requests: pd.DataFrame) -> pd.DataFrame:
    raise RuntimeError("down")


def echo(requests: pd.DataFrame) -> pd.DataFrame:
    return requests.assign(text=requests["user_prompt"], **{c: 1 for c in TOKEN_COLUMNS})


@pytest.fixture(scope="module", autouse=True)
def ship_models():
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def requests(spark, prompts_):
    return spark.createDataFrame(
        [("s", i, "sys", p) for i, p in enumerate(prompts_)],
        "stage string, batch_id long, system_prompt string, user_prompt string",
    )


def test_fallback_after_an_exception(spark):
    rows = ask(requests(spark, ["a", "b"]), [failing, echo]).orderBy("batch_id").collect()
    assert [(r["text"], r["model_ord"], r["error"]) for r in rows] == [("a", 1, None), ("b", 1, None)]


def test_both_models_fail(spark):
    (row,) = ask(requests(spark, ["a"]), [failing, failing]).collect()
    assert row["text"] is None and row["error"] == "RuntimeError: down" and row["total_token_count"] == 0


def test_audit_strips_fences(spark):
    answers = ask(requests(spark, ['```json\n{"a": 1}\n```', "plain"]), echo)
    rows = audit_records(answers).orderBy("batch_id").collect()
    assert (rows[0]["response"], rows[0]["parsed"]) == ('{"a": 1}', '{"a":1}')
    assert (rows[1]["response"], rows[1]["parsed"]) == ("plain", None)


@pytest.fixture(scope="module")
def store(ingested):
    lines = []
    for i in range(30):
        lines.append(STAMP.format(i, 0, "info", f"GET /page{i % 3}"))
        lines.append(STAMP.format(i, 10, "warn", "slow backend"))
        lines.append(STAMP.format(i, 20, "error", f"mod_jk child workerEnv in error state {i % 4}"))
    return ingested(lines)


def lines_of(contexts):
    return [r["line"] for r in reports.context_lines(contexts).orderBy("batch_id", "line_no").collect()]


def test_classification_report(store):
    facts = reports.DatasetFacts.of(store)
    lines = lines_of(reports.classification_contexts(P.in_batches(store.patterns, 150), facts))
    assert lines[:7] == [
        "=== LOG DATASET SUMMARY ===",
        "Total logs in dataset: 90",
        "Unique patterns to classify: 3",
        "Time range: 2005-12-04T04:00:00.000Z to 2005-12-04T04:29:20.000Z",
        'Level distribution: {"info":30,"warn":30,"error":30}',
        "",
        "=== DEDUPLICATED LOG PATTERNS ===",
    ]
    assert lines[7:15] == [
        "[ID: log_00001]",
        "  Level: info",
        "  Message: GET /page0",
        "  Occurrences: 30",
        "  First seen: 2005-12-04T04:00:00.000Z",
        "  Last seen: 2005-12-04T04:29:00.000Z",
        "  Raw: [Sun Dec 04 04:00:00 2005] [info] GET /page0",
        "",
    ]


def test_timeline_report(store):
    facts = reports.DatasetFacts.of(store)
    text = "\n".join(lines_of(reports.timeline_contexts(store, P.in_batches(store.patterns, 1000), facts)))
    assert "\n\n--- 2005-12-04T04:00 ---\n[INFO] GET /page0 | x30 | First: " in text
    assert "\n\n=== INCIDENT ESCALATION CHAINS ===\n--- Chain 1 (x30) ---\n  [INFO] GET /page0\n  [WARN] slow backend\n  → [ERROR] mod_jk" in text
    assert "--- Incident at 2005-12-04T04:00:20.000Z ---\n    [INFO] GET /page0\n    [WARN] slow backend\n>>> [ERROR]" in text
    assert "SUPPLEMENTARY" not in text and "SECURITY" not in text


def test_timeline_range_limits_chains_not_patterns(store):
    facts = reports.DatasetFacts.of(store)
    batches = P.in_batches(store.patterns, 1000)
    text = "\n".join(
        lines_of(reports.timeline_contexts(store, batches, facts, "2005-12-04T04:10:00Z", "2005-12-04T04:12:00Z"))
    )
    assert "(x2)" in text and "GET /page0 | x30" in text


def test_capped_report_adds_the_supplement(store):
    facts = reports.DatasetFacts.of(store)
    lines = lines_of(reports.capped_timeline_context(store, store.patterns, facts))
    assert lines[-2:] == ["=== SUPPLEMENTARY: TOP NON-ERROR PATTERNS ===", "[INFO] GET /page0 | x30"]


def test_signals_are_dealt_to_batches(ingested):
    names = ["one", "two", "three", "four", "five", "six"]
    store = ingested([STAMP.format(0, i, "error", f"nikto {n}") for i, n in enumerate(names)])
    facts = reports.DatasetFacts.of(store)
    batches = P.in_batches(store.patterns, 2)

    def signal_lines(per_batch):
        contexts = reports.timeline_contexts(store, batches, facts, signals_per_batch=per_batch)
        rows = reports.context_lines(contexts).where("line LIKE '[SCANNER%'").orderBy("batch_id", "line_no").collect()
        return contexts.count(), [r["batch_id"] for r in rows], [r["line"] for r in rows]

    every = [f"[SCANNER_SIGNATURE] [ERROR] nikto {n} | x1" for n in names]
    assert signal_lines(1000) == (3, [0] * 6, every)
    assert signal_lines(2) == (3, [0, 0, 1, 1, 2, 2], every)
    assert signal_lines(1) == (6, list(range(6)), every)  # three batches without patterns


def test_header_counts_other_levels_together(ingested):
    store = ingested([STAMP.format(0, i, level, "x") for i, level in enumerate(["odd", "error", "rare", "rare"])])
    assert reports.DatasetFacts.of(store).levels_json == '{"error":1} (other levels: 2 kinds, 3 rows)'


def test_root_cause_report_cap(ingested):
    lines = [STAMP.format(i // 60, i % 60, "error", f"kind {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    store = ingested(lines + [STAMP.format(2, 0, "error", "kind zz")] * 3)
    facts = reports.DatasetFacts.of(store)
    context = store.logs
    capped = lines_of(reports.whole_root_cause_context(context, facts))
    listed = [x for x in capped if " | Occurrences: " in x]
    assert len(listed) == 30 and listed[0].startswith("[ERROR] kind zz | Occurrences: 3")
    assert "Unique error patterns: 61" in capped
    assert len([x for x in capped if x.startswith("[2005")]) == 60
    batched = reports.root_cause_contexts(context.withColumn("batch_id", F.lit(0).cast("long")), facts)
    assert lines_of(batched) == capped


def test_entry_list(levels_table):
    df = levels_table(["info"], ["hello"]).withColumn("around", F.array(F.lit("n1"), F.lit("n2")))
    blocks = [r["block"] for r in reports.entry_list(df, "review", "around").orderBy("pos").collect()]
    assert blocks[0] == "=== LOG ENTRIES FOR REVIEW ===\nTotal entries: 1\n"
    assert blocks[1].endswith("[info] hello\n  Surrounding context:\n    n1\n    n2\n")


def test_full_analysis(store):
    full = analysis.analyze(store, rule_model)
    assert full.classification.summary().head()["dominant_category"] == "Request Processing"
    rows = full.timeline.events.orderBy("sequence").collect()
    assert [(r["sequence"], r["severity"]) for r in rows] == [(1, "error")]
    # No problem pattern names the dominant category, so all of them are analysed.
    report = full.root_cause.report.head()
    assert report["root_cause"].startswith("mod_jk child workerEnv in error state")
    meta = full.root_cause.metadata.head()
    assert (meta["total_logs"], meta["error_logs"], meta["unique_error_patterns"]) == (90, 30, 1)
    assert {r["stage"] for r in full.usage().collect()} == {"classification", "timeline", "root_cause", "total"}


def test_timeline_without_problem_patterns(ingested):
    store = ingested([STAMP.format(0, 0, "info", "fine")])
    result = analysis.timeline(store, rule_model, "errors", 8)
    assert result.responses.count() == 1
    assert "Error/Warning patterns: 0" in result.responses.head()["user_prompt"]
    assert analysis.root_cause(store, rule_model).report.count() == 1


def kinds(ingested, n=9):
    return ingested([STAMP.format(0, i, "error", f"kind {c}") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"[:n])])


def test_many_reports_are_merged_in_rounds(ingested):
    result = analysis.root_cause(kinds(ingested), rule_model, batch_size=1, fan_in=4)
    stages = {r["stage"]: r["count"] for r in result.responses.groupBy("stage").count().collect()}
    # Groups of four, four and one; the one needs no call.
    assert stages == {"root_cause": 9, "root_cause_synthesis": 2 + 1}
    assert result.report.count() == 1


def sulking(requests: pd.DataFrame) -> pd.DataFrame:
    """The rule model, with an unreadable answer about kind b and none about kind c."""
    done = rule_model(requests)
    section = requests["user_prompt"].str.split("=== CHRONOLOGICAL").str[0]
    text = done["text"].mask(section.str.contains("kind b"), "{cut").mask(section.str.contains("kind c"), "")
    return done.assign(text=text)


@pytest.mark.parametrize("stage", ["classify", "timeline", "root_cause"])
def test_lost_answers_are_told(ingested, stage):
    store = kinds(ingested, 5)
    run = getattr(analysis, stage)
    extra = {"focus_on": "errors"} if stage == "timeline" else {}
    if stage == "root_cause":
        extra = {"fan_in": 50}

    def garble(requests):
        done = rule_model(requests)
        first = requests["user_prompt"].str.contains("kind b") & ~requests["user_prompt"].str.contains("SYNTH")
        return done.assign(text=done["text"].mask(first, "{cut"))

    with pytest.raises(LostAnswers):
        run(store, garble, batch_size=2, **extra)


def test_kept_batches_are_listed(ingested):
    store = kinds(ingested, 5)
    done = analysis.classify(store, sulking, batch_size=1, on_failed="keep")
    assert {(r["batch_id"], r["status"]) for r in done.failed.collect()} == {(1, "unreadable"), (2, "no_answer")}
    assert done.classified.count() == 5
    timeline = analysis.timeline(store, rule_model, "errors", batch_size=2)
    assert timeline.events.count() == 3 and timeline.summaries.count() == 3 and timeline.failed.count() == 0
    meta = timeline.metadata.head()
    assert (meta["total_logs_analyzed"], meta["unique_patterns_used"], meta["focus"], meta["events_generated"]) == (5, 5, "errors", 3)


def picky(requests: pd.DataFrame) -> pd.DataFrame:
    if (requests["user_prompt"] == "bad").any():
        raise RuntimeError("bad prompt")
    return echo(requests)


def backup(requests: pd.DataFrame) -> pd.DataFrame:
    return echo(requests).assign(text="backup")


def test_fallback_is_per_prompt(spark):
    rows = ask(requests(spark, ["a", "bad", "c"]), [picky, backup], parallelism=1).orderBy("batch_id").collect()
    assert [(r["text"], r["model_ord"]) for r in rows] == [("a", 0), ("backup", 1), ("c", 0)]


def test_classify_covers_every_generated_pattern(spark):
    store = LogStore.ingest(parse(generate(spark, 800, 4), "apache"))
    done = analysis.classify(store, rule_model)
    assert done.classified.count() == store.patterns.count()
    assert done.totals().head()["total_logs_represented"] == 800
    shares = done.distribution().agg(F.sum("percentage")).head()[0]
    assert abs(shares - 100) < 0.5


def test_a_task_hands_over_answers_by_batches_of_prompts(spark, monkeypatch):
    """One prompt a call, but not one frame a prompt on the way back."""
    handed, calls = [], []

    class Prompts:
        sparkSession = spark

        def select(self, *columns):
            return self

        repartition = select

        def mapInPandas(self, run, schema):
            frames = [pd.DataFrame({"stage": "s", "batch_id": range(k, k + 40), "system_prompt": "s", "user_prompt": [f"p{i}" for i in range(k, k + 40)]}) for k in (0, 40)]
            handed.extend(run(iter(frames)))

    def model(frame):
        calls.append(list(frame["user_prompt"]))
        return echo(frame) if frame["user_prompt"].iloc[0] != "p7" else echo(frame).assign(text="")

    monkeypatch.setattr(siltlog.plans.model, "materialize", lambda df, name: df)
    ask(Prompts(), [model, backup], parallelism=1)
    assert [len(frame) for frame in handed] == [40, 40] and calls == [[f"p{i}"] for i in range(80)]
    rows = pd.concat(handed)
    assert list(rows["text"]) == [f"p{i}" if i != 7 else "backup" for i in range(80)]
    assert list(rows["model_ord"]) == [int(i == 7) for i in range(80)] and rows["error"].isna().all()

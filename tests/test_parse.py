"""Parsing, fingerprints and times: the cases where engines differ."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltlog.functions.fingerprint import fingerprint, mask
from siltlog.functions.text import duration_text, keywords, log_id, trimmed
from siltlog.functions.times import access_log_time, bucket_start, error_log_time, iso_text, report_time
from siltlog.sources import formats
from siltlog.sources.lines import lines_from_list, read_accepted, read_lines

ERROR = "[Sun Dec 04 04:47:44 2005] [notice] workerEnv.init() ok /etc/httpd/conf/workers2.properties"
ACCESS = (
    '25.92.32.150 - - [01/Jul/2026:14:58:44 +0000] "DELETE /api/products HTTP/1.1" 200 211 '
    '"https://www.bing.com/" "curl/8.5.0"'
)


def fp(level, masked):
    return hashlib.sha256(f"{level}:{masked}".encode()).hexdigest()[:12]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).head()["r"]


def test_error_line(numbered):
    row = formats.parse(numbered([ERROR]), "apache").withColumn("ts", iso_text(F.col("ts"))).head()
    assert row["id"] == "log_00001"
    assert row["ts"] == "2005-12-04T04:47:44.000Z"
    assert row["level"] == "notice"
    assert row["message"] == "workerEnv.init() ok /etc/httpd/conf/workers2.properties"
    assert row["fingerprint"] == fp("notice", "workerEnv.init() ok PATH")


def test_access_line(numbered):
    row = formats.parse(numbered([ACCESS]), "apache-access", extras=True).head()
    assert (row["level"], row["message"]) == ("info", "DELETE /api/products - Status 200")
    assert row["fingerprint"] == fp("info", "DELETE PATH N")
    assert (row["ip"], row["size"], row["user_agent"]) == ("25.92.32.150", 211, "curl/8.5.0")


def test_access_line_variants(numbered):
    lines = [
        '1.2.3.4 - bob [01/Jul/2026:14:58:44] "GET" 404 -',
        '1.2.3.4 - - [bad time] " /x" 503 7 "-"',
    ]
    a, b = formats.parse(numbered(lines), "apache-access", extras=True).orderBy("line_number").collect()
    assert (a["message"], a["level"], a["size"], a["referrer"]) == ("GET  - Status 404", "warn", None, None)
    assert a["ts"] is not None
    assert (b["message"], b["level"], b["ts"], b["referrer"]) == ("UNKNOWN /x - Status 503", "error", None, "-")


def test_unmatched_line_is_kept(numbered):
    parsed = formats.parse(numbered(["what is this"]), "apache")
    row = parsed.head()
    assert (row["level"], row["ts"], row["message"]) == ("unknown", None, "what is this")
    assert row["fingerprint"] == fp("unknown", "what is this")
    assert formats.unmatched(parsed).count() == 1
    assert formats.parse_report(parsed).head()["parse_errors"] == 0


def test_level_is_hashed_as_written(numbered):
    line = "[Sun Dec 04 04:47:44 2005] [{}] same"
    a, b = formats.parse(numbered([line.format("Error"), line.format("error")]), "apache").collect()
    assert a["level"] == b["level"] == "error"
    assert a["fingerprint"] == fp("Error", "same") != b["fingerprint"]


def test_matched_line_with_bad_date_keeps_level(numbered):
    row = formats.parse(numbered(["[Sun Feb 31 04:47:44 2005] [crit] x"]), "apache").head()
    assert (row["level"], row["ts"]) == ("crit", None)


def test_line_separators_inside_a_message_do_not_match(numbered):
    line = "[Sun Dec 04 04:47:44 2005] [error] a{}b"
    found = formats.parse(numbered([line.format(c) for c in (" ", "\u0085", "\t")]), "apache")
    assert [r["level"] for r in found.orderBy("line_number").collect()] == ["unknown", "error", "error"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("pid 12 and 123 and 4567", "pid 12 and N and N"),
        ("slot   6 child 77 state 9", "slot N child N state N"),
        ("abc123 123abc 123_4 é123 (123)", "abc123 123abc 123_4 éN (N)"),
        ("GET / and /a-b/c.d_e?x=1", "GET / and PATH?x=1"),
        ("10.0.99.100", "10.0.99.N"),
        ("  padded 1234  ", "padded N"),
        ("child 12345", "child N"),
    ],
)
def test_mask(spark, text, expected):
    assert one(spark, text, mask) == expected


def test_fingerprint_matches_plain_sha(spark):
    assert one(spark, "child 5", lambda c: fingerprint(F.lit("warn"), c)) == fp("warn", "child N")


@pytest.mark.parametrize("text", ["\t x \r\n", " x﻿", "x　", " x"])
def test_trim(spark, text):
    assert one(spark, text, trimmed) == "x"


def test_keywords():
    assert keywords("  Foo\tBAR baz ") == ["foo", "bar", "baz"]
    assert keywords("") == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Sun Dec 04 04:47:44 2005", "2005-12-04T04:47:44.000Z"),
        ("Sun Dec  4 04:47:44 2005", "2005-12-04T04:47:44.000Z"),
        ("Mon Dec 04 04:47:44.123456 2005", "2005-12-04T04:47:44.123Z"),
        ("Dec 4 04:47:44 2005", "2005-12-04T04:47:44.000Z"),
        ("2005-12-04T04:47:44Z", "2005-12-04T04:47:44.000Z"),
        ("Sun Feb 31 04:47:44 2005", None),
        ("12:30", None),
        ("", None),
    ],
)
def test_error_time(spark, text, expected):
    assert one(spark, text, lambda c: iso_text(error_log_time(c))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01/Jul/2026:14:58:44 +0000", "2026-07-01T14:58:44.000Z"),
        ("01/Jul/2026:14:58:44 -0330", "2026-07-01T18:28:44.000Z"),
        ("01/Jul/2026:14:58:44", "2026-07-01T14:58:44.000Z"),
        ("31/Feb/2026:14:58:44 +0000", None),
    ],
)
def test_access_time(spark, text, expected):
    assert one(spark, text, lambda c: iso_text(access_log_time(c))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("04/12/2005 04:47:44 PM", "2005-12-04T16:47:44.000Z"),
        ("04:47 AM 04/12/2005", "2005-12-04T04:47:00.000Z"),
        ("2005-12-04T04:00", "2005-12-04T04:00:00.000Z"),
        ("Unknown", None),
    ],
)
def test_report_time(spark, text, expected):
    assert one(spark, text, lambda c: iso_text(report_time(c))) == expected


def test_bucket_that_does_not_divide_the_hour(spark):
    got = one(spark, "2024-01-01 10:59:59", lambda c: iso_text(bucket_start(c.cast("timestamp"), 25)))
    assert got == "2024-01-01T10:50:00.000Z"


def test_log_id_is_never_cut(spark):
    ids = spark.range(1).select(log_id(F.lit(7)).alias("a"), log_id(F.lit(123456)).alias("b")).head()
    assert tuple(ids) == ("log_00007", "log_123456")


@pytest.mark.parametrize("ms, text", [(999, "999ms"), (1500, "1.5s"), (45050, "45.0s"), (1250, "1.3s"), (90000, "1.5m")])
def test_duration(spark, ms, text):
    assert spark.range(1).select(duration_text(F.lit(ms))).head()[0] == text


def test_detection(numbered):
    junk = "junk"
    assert formats.detect_format(numbered([junk, junk, ERROR, ERROR, ERROR])).name == "apache"
    # Only five lines are tested, so later matches do not help.
    with pytest.raises(ValueError):
        formats.detect_format(numbered([junk, junk, junk, ERROR, ERROR, *[ERROR] * 5]))
    assert formats.detect_format(numbered([ACCESS, junk])).name == "apache-access"
    with pytest.raises(ValueError):
        formats.detect_format(numbered([]))
    with pytest.raises(ValueError):
        formats.format_by_name("syslog")


def test_in_memory_lines(spark):
    lines = lines_from_list(spark, [f"{ERROR}\r\n\r\n  \n{ERROR}", ERROR])
    assert [r["line_number"] for r in lines.orderBy("line_number").collect()] == [1, 2, 3]
    assert formats.parse_lines(lines).where("level = 'notice'").count() == 3


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    expected = []
    for name in ("a.log", "b.txt", "c.log"):
        lines = [f"{name} line {i}" + "x" * (i % 50) for i in range(700)]
        (tmp_path / name).write_text("\r\n\r\n".join(lines) + "\n \t\n")
        expected += lines
    (tmp_path / "skip.csv").write_text("not a log\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_accepted(spark, str(tmp_path)).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line_number"] for r in rows] == list(range(1, 2101))
    assert [r["value"] for r in rows] == expected


def test_crlf_and_tabs_at_line_ends(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes((f"\t{ERROR}\t\r\n\r\n" + f"{ERROR} \r\n").encode())
    parsed = formats.parse(read_lines(spark, str(path)), "apache").orderBy("line_number").collect()
    assert [r["raw"] for r in parsed] == [ERROR, ERROR]



def test_layouts_are_matched_once_a_line(spark):
    """Spark keeps no result of an expression it finds inside conditions, so a capture or mask
    there is matched again wherever it is named: 144 matches in the code of two formats."""
    lines = spark.range(1).select(F.col("id").cast("string").alias("value"), F.lit("f").alias("_file"), F.lit(0).alias("_block"))
    plan = formats.parse_any(lines)._jdf.queryExecution().executedPlan()
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    assert 0 < code.count("Pattern.compile(") < 40

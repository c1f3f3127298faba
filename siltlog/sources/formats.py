"""Log formats: detection and parsing as column expressions.

A format is a name, a detection regex and a function from the trimmed line to
named columns. :func:`register` adds one; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.functions.fingerprint import fingerprint
from siltlog.functions.text import ANY, NOT_SPACE, SPACE, log_id, or_default, trimmed
from siltlog.functions.times import access_log_time, error_log_time
from siltlog.schema import LOG_COLUMNS

DETECTION_LINES = 5
DETECTION_SHARE = 0.5

# Line layouts. `\z` is the very end of the line.
ERROR_LINE = rf"^\[([^\]]+)\]{SPACE}+\[([A-Za-z0-9_]+)\]{SPACE}+({ANY}+)\z"
ACCESS_LINE = (
    rf"^({NOT_SPACE}+){SPACE}+{NOT_SPACE}+{SPACE}+{NOT_SPACE}+{SPACE}+\[([^\]]+)\]"
    rf'{SPACE}+"([^"]+)"{SPACE}+(\d{{3}}){SPACE}+(\d+|-)'
    rf'(?:{SPACE}+"([^"]*)")?(?:{SPACE}+"([^"]*)")?'
)


@dataclass(frozen=True)
class LogFormat:
    """``captures`` pulls the raw groups; ``fields`` turns them into log columns.

    ``captures`` must include ``matched``. ``fields`` yields ``ts``, ``level``,
    ``message`` and the two fingerprint inputs ``fp_level`` and ``fp_text``.
    """

    name: str
    detect: str
    captures: Callable[[Column], dict[str, Column]]
    fields: Callable[[], dict[str, Column]]
    extras: tuple[str, ...] = ()


# Stands between groups; a line that holds it is matched group by group.
MARK = "\x01"


def _groups(raw: Column, layout: str, count: int) -> Column:
    """The groups of a layout that covers the whole line, from one match per line.

    A line that does not match is its own only piece, so its groups are empty.
    """
    marked = F.regexp_replace(raw, layout, MARK.join(f"${i}" for i in range(1, count + 1)))
    pieces = F.split(marked, MARK)
    slow = F.array(*[F.regexp_extract(raw, layout, i) for i in range(1, count + 1)])
    none = F.array(*[F.lit("")] * count)
    return F.when(raw.contains(MARK), slow).when(F.size(pieces) == count, pieces).otherwise(none)


def _group(i: int) -> Column:
    return F.get("_groups", F.lit(i - 1))


def _error_captures(raw: Column) -> dict[str, Column]:
    groups = _groups(raw, ERROR_LINE, 3)
    return {"_groups": groups, "matched": F.get(groups, F.lit(1)) != ""}


def _error_fields() -> dict[str, Column]:
    return {
        "ts": error_log_time(_group(1)),
        "level": F.lower(_group(2)),
        "message": trimmed(_group(3)),
        # The hash takes the level as written, before it is lower-cased.
        "fp_level": _group(2),
        "fp_text": _group(3),
    }


def _access_captures(raw: Column) -> dict[str, Column]:
    groups = _groups(raw, rf"{ACCESS_LINE}{ANY}*\z", 7)

    def group(i: int) -> Column:
        return F.get(groups, F.lit(i - 1))

    return {
        "_groups": groups,
        "_request": F.split(group(3), " "),
        "_status": group(4).try_cast("int"),
        "matched": group(4) != "",
        "ip": F.nullif(group(1), F.lit("")),
        "size": group(5).try_cast("long"),
        "referrer": F.nullif(group(6), F.lit("")),
        "user_agent": F.nullif(group(7), F.lit("")),
    }


def status_level(status: Column) -> Column:
    return (
        F.when(status >= 500, F.lit("error")).when(status >= 400, F.lit("warn")).otherwise("info")
    )


def _access_fields() -> dict[str, Column]:
    method = or_default(F.get("_request", F.lit(0)), "UNKNOWN")
    url = F.coalesce(F.get("_request", F.lit(1)), F.lit(""))
    status = F.col("_status").cast("string")
    return {
        "ts": access_log_time(_group(2)),
        "level": status_level(F.col("_status")),
        "message": F.concat(method, F.lit(" "), url, F.lit(" - Status "), status),
        "fp_level": status_level(F.col("_status")),
        "fp_text": F.concat_ws(" ", method, url, status),
    }


FORMATS: dict[str, LogFormat] = {}


def register(fmt: LogFormat) -> None:
    """Add a format; detection tries formats in registration order."""
    FORMATS[fmt.name] = fmt


register(LogFormat("apache", ERROR_LINE, _error_captures, _error_fields))
register(
    LogFormat(
        "apache-access",
        ACCESS_LINE,
        _access_captures,
        _access_fields,
        ("ip", "size", "referrer", "user_agent"),
    )
)


def format_by_name(name: str) -> LogFormat:
    if name not in FORMATS:
        raise ValueError(f"Unknown log format: {name}")
    return FORMATS[name]


def format_votes(lines: DataFrame) -> DataFrame:
    """Share of the first five lines each format matches.

    ``lines`` needs ``line_number`` (dense from 1 over non-blank lines) and ``value``.
    """
    head = lines.where(F.col("line_number") <= DETECTION_LINES)
    shares = [
        F.avg(F.col("value").rlike(fmt.detect).cast("double")).alias(fmt.name)
        for fmt in FORMATS.values()
    ]
    names = list(FORMATS)
    return (
        head.agg(F.count("*").alias("tested"), *shares)
        .select(
            "tested",
            F.posexplode(
                F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("share")) for n in names])
            ).alias("priority", "vote"),
        )
        .select(
            "priority",
            F.col("vote.name").alias("format"),
            "tested",
            F.col("vote.share").alias("share"),
            F.coalesce(F.col("vote.share") >= DETECTION_SHARE, F.lit(False)).alias("accepted"),
        )
    )


def detect_format(lines: DataFrame) -> LogFormat:
    """First registered format matching at least half of the first five lines."""
    best = format_votes(lines).where("accepted").orderBy("priority").head()
    if best is None:
        raise ValueError("Unable to detect log format. Supported formats: " + ", ".join(FORMATS))
    return FORMATS[best["format"]]


PLACE = ("_file", "_block")


def parse(lines: DataFrame, fmt: LogFormat | str, extras: bool = False) -> DataFrame:
    """Turn ``(line_number, value)`` into log records; unmatched lines stay, as ``unknown``.

    Lines that are not numbered yet (with ``_file`` and ``_block`` instead of a
    number) give records without ``id`` and ``line_number``; see :func:`numbered`.
    """
    if isinstance(fmt, str):
        fmt = format_by_name(fmt)
    raw = F.col("raw")
    place = ["line_number"] if "line_number" in lines.columns else list(PLACE)
    captured = lines.select(*place, trimmed(F.col("value")).alias("raw")).select(
        *place, "raw", *[c.alias(n) for n, c in fmt.captures(raw).items()]
    )
    fields = fmt.fields()
    hit = F.col("matched")
    fp_level = F.when(hit, fields["fp_level"]).otherwise("unknown")
    fp_text = F.when(hit, fields["fp_text"]).otherwise(raw)
    columns = {
        "raw": raw,
        "ts": F.when(hit, fields["ts"]),
        "level": F.when(hit, fields["level"]).otherwise("unknown"),
        "message": F.when(hit, fields["message"]).otherwise(raw),
        "fingerprint": fingerprint(fp_level, fp_text),
    }
    more = [F.col(name) for name in fmt.extras] if extras else []
    records = captured.select(*place, *[c.alias(n) for n, c in columns.items()], *more)
    return numbered(records) if place == ["line_number"] else records


def _extras() -> list[str]:
    """Names of the fields that only some registered formats have."""
    return list(dict.fromkeys(name for fmt in FORMATS.values() for name in fmt.extras))


def _tried(rows: DataFrame, tries: Callable[[int, str], Column]) -> DataFrame:
    """Replace ``raw`` by itself and the record of the one format that is tried and matches.

    ``tries(i, name)`` says of which rows format ``i`` is tried; the records of earlier
    formats are the columns ``_r0``, ``_r1`` and so on. ``_format`` is the format that matched.
    """
    own = rows.columns
    for i, fmt in enumerate(FORMATS.values()):
        # A line that isn't tried is hidden from the format. With a condition around each
        # capture instead, Spark would match the layout again for each of them.
        hidden = rows.withColumn("_line", F.when(tries(i, fmt.name), F.col("raw")))
        captured = hidden.select(*hidden.columns, *[c.alias(n) for n, c in fmt.captures(F.col("_line")).items()])
        record = F.struct(*[c.alias(n) for n, c in fmt.fields().items()], *fmt.extras)
        hit = F.col("matched") & F.col("_line").isNotNull()
        rows = captured.select(*rows.columns, F.when(hit, record).alias(f"_r{i}"))

    def first(name: str) -> Column:
        found = [F.col(f"_r{i}.{name}") for i, f in enumerate(FORMATS.values()) if name in (*FIELDS, *f.extras)]
        return F.coalesce(*found)

    names = [F.when(F.col(f"_r{i}").isNotNull(), F.lit(f.name)) for i, f in enumerate(FORMATS.values())]
    rows = rows.select(*own, *[first(n).alias(n) for n in (*FIELDS, *_extras())], F.coalesce(*names).alias("_format"))
    # Masks refer to their text many times, so they stand outside of any condition as well.
    made = fingerprint(F.col("fp_level"), F.col("fp_text")).alias("fingerprint")
    return rows.select(*own, *[c for c in FIELDS if not c.startswith("fp_")], made, *_extras(), "_format")


FIELDS = ("ts", "level", "message", "fp_level", "fp_text")
RECORD = ("ts", "level", "message", "fingerprint")


def parse_any(lines: DataFrame) -> DataFrame:
    """Records by the first registered format that matches each line, its name in ``_format``.

    Lines come with their place in the files. Which format a line is to be read in is
    its file's to say, see :func:`by_elected_format`; ``_value`` keeps the line where
    trimming changed it, as formats are detected on lines as they are.
    """
    raw, value = trimmed(F.col("value")), F.col("value")
    rows = lines.select(*PLACE, raw.alias("raw"), F.when(raw != value, value).alias("_value"))
    return _tried(rows, lambda i, name: _none_of(i))


def _none_of(n: int) -> Column:
    """No format before the ``n``-th one has matched."""
    return F.lit(True) if n == 0 else reduce(lambda a, b: a & b, [F.col(f"_r{j}").isNull() for j in range(n)])


def by_elected_format(rows: DataFrame) -> DataFrame:
    """Final records of :func:`parse_any` rows that have the format of their file as ``_elected``.

    A record made by that format stands, and what no format or no file's format
    matches is ``unknown``. Lines that another format matched first are matched again;
    there are hardly ever any, so they are a branch of their own.
    """
    fields = [*RECORD, *_extras()]
    place = [c for c in rows.columns if c not in ("raw", "_value", "_format", "_elected", *fields)]
    again = F.coalesce(F.col("_format") != F.col("_elected"), F.lit(False))
    fine = F.coalesce(F.col("_format") == F.col("_elected"), F.lit(False))
    settled = rows.where(~again).select(*place, "raw", *_final(fine, fields))
    doubtful = rows.where(again).select(*place, "raw", "_elected")
    if doubtful.isEmpty():
        return settled
    tried = _tried(doubtful, lambda i, name: F.col("_elected") == name)
    return settled.unionByName(tried.select(*place, "raw", *_final(F.col("_format").isNotNull(), fields)))


def _final(matched: Column, fields: Sequence[str]) -> list[Column]:
    unknown = {"level": F.lit("unknown"), "message": F.col("raw"), "fingerprint": fingerprint(F.lit("unknown"), F.col("raw"))}
    return [F.when(matched, F.col(n)).otherwise(unknown.get(n)).alias(n) for n in fields]


def elected_formats(heads: DataFrame) -> DataFrame:
    """``_file, tested, format``: the first registered format that matches at least half of a
    file's first lines; null if none does. ``heads`` is ``_file, value`` of those lines."""
    shares = [F.avg(F.col("value").rlike(fmt.detect).cast("double")).alias(f"_s{i}") for i, fmt in enumerate(FORMATS.values())]
    chosen = [F.when(F.col(f"_s{i}") >= DETECTION_SHARE, F.lit(name)) for i, name in enumerate(FORMATS)]
    votes = heads.groupBy("_file").agg(F.count("*").alias("tested"), *shares)
    return votes.select("_file", "tested", F.coalesce(*chosen, F.lit(None).cast("string")).alias("format"))


def numbered(records: DataFrame) -> DataFrame:
    """Add the id that a line number gives, columns in the order of the log table."""
    rest = [c for c in records.columns if c not in LOG_COLUMNS]
    return records.withColumn("id", log_id(F.col("line_number"))).select(*LOG_COLUMNS, *rest)


def unmatched(parsed: DataFrame) -> DataFrame:
    """Lines the format did not recognise."""
    return parsed.where((F.col("level") == "unknown") & F.col("ts").isNull())


def parse_report(parsed: DataFrame) -> DataFrame:
    """Line counts. Column expressions cannot throw, so ``parse_errors`` is always zero."""
    lost = (F.col("level") == "unknown") & F.col("ts").isNull()
    return parsed.agg(
        F.count("*").alias("total_lines"),
        F.count("*").alias("parsed_lines"),
        F.count_if(lost).alias("unmatched_lines"),
        F.lit(0).cast("long").alias("parse_errors"),
    )


def parse_lines(lines: DataFrame, extras: bool = False) -> DataFrame:
    """Detect the format of numbered lines and parse them without storing anything."""
    return parse(lines, detect_format(lines), extras)

"""Conversations without quotes, in reply order, by linking quotations.

Messages quote earlier ones by lines that start with one or more ``>``. The lines
of a message are grouped into paragraphs: a change of the quote level and a blank
line end one. Every quoted paragraph, its lines joined, and every line of it is
normalised and hashed; so are the unquoted paragraphs and lines of all messages. A
quotation may thus be wrapped anew or leave out other paragraphs. A join on the hash
finds the first message of the conversation that holds the paragraph. A message answers the message that its
outermost linked quotation comes from; threads are the trees of those answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.session import materialize

# A quote mark may have blanks around it; line ends.
_MARKS = r"^[\x20\t>]*>[\x20\t]?"
_LINE_END = r"\r\n|\n|\r"
_INTRODUCTION = r"(?i)^[\x20\t]*(?:on\b.{1,200}\bwrote|.{1,100}\b(?:wrote|schrieb|a écrit|escribió))[\x20\t]*:[\x20\t]*$"


def quoted_lines(text: Column) -> Column:
    """Lines of a text as ``level`` (number of quote marks) and ``body``."""
    lines = F.split(F.coalesce(text, F.lit("")), _LINE_END)
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)
    return F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_count(marks(line), F.lit(">")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body")
        ),
    )


def normalised(body: Column) -> Column:
    """Lower case, single blanks, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(body), r"[\s ]+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, row, at, level, bodies``: one row per paragraph that isn't blank.

    A line starts a paragraph where the level changes or a blank line meets another
    one. Paragraphs are cut from the list of lines before they become rows, so the
    lines are copied once and not for every paragraph.
    """
    lines = messages.withColumn("lines", quoted_lines(F.col("text"))).drop("text")
    body = lambda i: F.element_at("lines", i)
    before = lambda i: F.element_at("lines", F.greatest(i - 1, F.lit(1)))
    blank = lambda line: normalised(line["body"]) == ""
    starts = F.filter(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: (i == 1) | (body(i)["level"] != before(i)["level"]) | (blank(body(i)) != blank(before(i))),
    )
    lines = lines.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines") + 1))
    lines = lines.withColumn("runs", F.arrays_zip(F.col("starts").alias("from"), ends.alias("to")))
    paragraph = lambda run: F.struct(
        body(run["from"])["level"].alias("level"),
        # Line by line: a slice would copy the whole list for every paragraph.
        F.transform(F.sequence(run["from"], run["to"] - 1), lambda i: body(i)["body"]).alias("bodies"),
    )
    lines = lines.withColumn("paragraphs", F.transform("runs", paragraph))
    # From an inner generator Spark infers a filter on the array's size, pushes it down to
    # the scan and there works out the lines again for every line. Each message has a
    # paragraph, so an outer one gives the same rows.
    cut = lines.select("conv_id", "turn", "row", F.posexplode_outer("paragraphs").alias("at", "paragraph"))
    return cut.select("conv_id", "turn", "row", "at", "paragraph.level", "paragraph.bodies")


def _hashed(passages: DataFrame) -> DataFrame:
    """Add ``hash`` rows: of the paragraph (``part`` 0) and, if there are several, of its lines (1, 2, ...)."""
    whole = normalised(F.array_join("bodies", " "))
    several = F.when(F.size("bodies") > 1, F.transform("bodies", normalised)).otherwise(F.array().cast("array<string>"))
    parts = passages.select("conv_id", "turn", "row", "at", "level", F.posexplode_outer(F.concat(F.array(whole), several)).alias("part", "norm"))
    hashes = F.xxhash64("norm").alias("hash"), F.xxhash64(F.lit(1), "norm").alias("check")
    return parts.where("norm <> ''").select("conv_id", "turn", "row", "at", "level", "part", *hashes)


def linked_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, row, at, level, part, source_turn``: every quoted paragraph (part 0) and
    line, and the first earlier message of the conversation that says it unquoted.

    First sayings are a pre-aggregated minimum per conversation and hash, so a
    sentence that fills a conversation is one row there. Texts are compared by two
    64-bit hashes.
    """
    parts = materialize(_hashed(_passages(messages)), "passages")
    first = (
        parts.where("level = 0")
        .groupBy("conv_id", "hash", "check")
        .agg(F.min("turn").alias("source_turn"))
        .withColumnsRenamed({"conv_id": "_conv", "hash": "_hash", "check": "_check"})
    )
    quoted = parts.where("level > 0")
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash")) & (F.col("check") == F.col("_check"))
    )
    earlier = F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn"))
    return quoted.join(first, same, "left").select(
        "conv_id", "turn", "row", "at", "level", "part", earlier.alias("source_turn")
    )


def without_quotes(text: Column) -> Column:
    """The unquoted lines; a line that only introduces the quotation behind it goes too.

    Blank lines at either end and around removed quotes are closed up.
    """
    lines = quoted_lines(text)
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))))
    kept = F.filter(
        F.zip_with(
            lines,
            after,
            lambda line, following: F.struct(
                ((line["level"] == 0) & ~(line["body"].rlike(_INTRODUCTION) & (following["level"] > 0))).alias("keep"),
                line["body"].alias("body"),
            ),
        ),
        lambda x: x["keep"],
    )
    joined = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    changed = F.exists(lines, lambda x: x["level"] > 0)
    closed = F.regexp_replace(joined, r"\n[\x20\t]*\n[\x20\t\n]*\n", "\n\n")
    tidy = F.rtrim(F.regexp_replace(closed, r"\A[\x20\t\n]*\n", ""), F.lit(" \t\n"))
    return F.when(text.isNotNull(), F.when(changed, tidy).otherwise(text))


def _threads(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``conv_id, turn, thread``: the first turn of each answering message's thread, by
    pointer doubling; a number of rounds that grows with the logarithm of the depth."""
    jump = answers.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        onward = jump.select(
            F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("thread").alias("onward")
        )
        moved = jump.join(onward, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("thread") == F.col("_turn")), "left")
        moved = materialize(
            moved.select("conv_id", "turn", F.coalesce("onward", "thread").alias("thread"), F.col("onward").isNotNull().alias("moved")),
            "threads",
        )
        jump = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return jump


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message of ``conv_id, turn, role, text``: ``reply_to`` (turn of the message
    it quotes, or null), ``thread`` (turn of the first message of its thread),
    ``depth_quoted``, ``n_quotes`` (paragraphs), ``n_linked`` of them, ``n_partly`` of which
    only some line is linked, and ``body`` without quotes.

    Conversations in reply order are the rows sorted by ``conv_id, thread, turn``: a
    message answers an earlier turn of its own thread, so it always follows it.
    Of the linked quotations the one of the lowest level counts, whole paragraphs
    before lines, then the earliest in the text. A message that quotes nothing
    known starts a thread. Null texts have a null body; null turns are never
    linked. Rows that repeat a conversation and turn are messages of their own
    that share the first one's answers. Other columns are ignored.
    """
    messages = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("conv_id", "turn", "role", "text").alias("row"))
    links = materialize(linked_quotes(messages), "links")
    linked = F.col("source_turn").isNotNull()
    source = F.when(linked, F.struct("level", F.least("part", F.lit(1)).alias("line"), "at", "part", "source_turn"))
    per_quote = links.groupBy("conv_id", "turn", "row", "at").agg(
        F.max("level").alias("level"),
        F.max((F.col("part") == 0) & linked).alias("whole"),
        F.max(linked).alias("some"),
        F.min(source).alias("source"),
    )
    per_row = per_quote.groupBy("conv_id", "turn", "row").agg(
        F.count("*").alias("n_quotes"),
        F.count_if("whole").alias("n_linked"),
        F.count_if(F.col("some") & ~F.col("whole")).alias("n_partly"),
        F.max("level").alias("depth_quoted"),
        F.min("source")["source_turn"].alias("reply_to"),
    )
    per_row = materialize(per_row, "answers")
    answers = per_row.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    threads = _threads(messages, answers).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    counted = per_row.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "row": "_row"})
    own = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("row") == F.col("_row"))
    )
    joined = messages.join(counted, own, "left").drop("_conv", "_turn", "_row")
    at = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn"))
    joined = joined.join(threads, at, "left").drop("_conv", "_turn")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth_quoted", "n_quotes", "n_linked", "n_partly")],
        without_quotes(F.col("text")).alias("body"),
    )

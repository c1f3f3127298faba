"""Cheapest repair of conversation structure by depth-first branch-and-bound.

A conversation should be an optional system message and then user and assistant in
turn. Its rows are kept, given another role or deleted, and empty messages are inserted,
at the least cost and, of equal costs, with the least audit: the string of the
edits' initials. The search keeps an explicit stack of prefixes and extends them in
the order of the initials, so prefixes come up in the order of their audits. A prefix
is dropped when its cost and the least cost of the rows behind it exceed the best repair
found, and when an earlier prefix, which has the lesser audit, came to the same
row and role state at no more cost. What is left when the stack is empty is proved.

A conversation may hold any share of all rows, so the search works on pieces of at most
4,096 consecutive rows. A piece of a longer conversation is first reduced to the
costs between its role states; those of one conversation are added up from its end,
which gives each piece the cost of all behind it, and every piece is then searched from
each state it may be entered in. Texts stay out of all this: a line knows its row
by two 64-bit values and meets its text once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siltlog.llm.words import bounded_batches
from siltlog.session import broadcast_if_small, materialize

PIECE_BITS = 12
BROADCAST_ROWS = 100_000
SHORT = 32  # rows of a conversation whose repair is remembered
CHUNK_BYTES = 1 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NEVER = 1 << 50

# Role states: nothing said, system said, user said, assistant said.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None,) * 4}
ANSWERS = (USER, USER, ASSISTANT, USER)  # the state after the one role that may be inserted or given
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (0, NEVER, NEVER, 0)  # what ending in each state costs
CLOSED = (0, 2 * INSERT, INSERT, 0)  # with empty messages at the end

# One letter for a row: its role's initial (o: any other), a capital if it is
# truncated, a digit if it has to be deleted.
CODES = {"": "suao", "truncated": "SUAO", "deleted": "0123"}
INITIAL = {c: i for kind in CODES.values() for c, i in zip(kind, "suao")}
LEGAL = {"su", "ua", "au"}


def suffix_bounds(codes: str, ends: tuple) -> list[tuple]:
    """For every row and state the least cost of the rows from there on; ``ends`` are costs behind the last."""
    bounds = [ends]
    for code in reversed(codes):
        behind, initial = bounds[-1], INITIAL[code]
        extra = TRUNCATED if code.isupper() else 0
        here = []
        for state in range(4):
            best = DELETE + behind[state]
            if not code.isdigit():
                if (kept := AFTER_KEEP[initial][state]) is not None:
                    best = min(best, KEEP + extra + behind[kept])
                best = min(best, REROLE + extra + behind[ANSWERS[state]])
            here.append(best)
        for _ in range(2):  # up to two empty messages may precede the row
            here = [min(here[s], INSERT + here[ANSWERS[s]]) for s in range(4)]
        bounds.append(tuple(min(b, NEVER) for b in here))
    return bounds[::-1]


def search(codes: str, entry: int, ends: tuple, last: bool) -> tuple[str, int] | None:
    """The audit of the cheapest edits of ``codes`` entered in state ``entry`` and the state
    they end in; None if there are none.

    ``ends`` are the costs behind the piece. Only the last piece may end with inserted
    messages; elsewhere they belong to the piece of the row they precede.
    """
    closing = tuple(min(e, c) for e, c in zip(ends, CLOSED)) if last else ends
    bounds = suffix_bounds(codes, closing)
    most = bounds[0][entry]  # some repair has this cost
    if most >= NEVER:
        return None
    found, n = None, len(codes)
    dominant: list[list] = [[None] * 4 for _ in range(n + 1)]  # the least cost so far of each row and state
    stack = [(0, entry, 0, None)]
    while stack:
        row, state, cost, audit = stack.pop()
        if cost + bounds[row][state] > most or found is not None and cost + bounds[row][state] >= most:
            continue
        if dominant[row][state] is not None and dominant[row][state] <= cost:
            continue
        dominant[row][state] = cost
        steps = []  # the last one is tried first
        if row < n:
            code = codes[row]
            extra = TRUNCATED if code.isupper() else 0
            if not code.isdigit():
                steps.append((row + 1, ANSWERS[state], cost + REROLE + extra, (audit, "R")))
                if (kept := AFTER_KEEP[INITIAL[code]][state]) is not None:
                    steps.append((row + 1, kept, cost + KEEP + extra, (audit, "K")))
            steps.append((row, ANSWERS[state], cost + INSERT, (audit, "I")))
            steps.append((row + 1, state, cost + DELETE, (audit, "D")))
        else:
            if cost + ends[state] <= most and (found is None or cost + ends[state] < most):
                most, found = cost + ends[state], (audit, state)
                continue
            if last:
                steps.append((row, ANSWERS[state], cost + INSERT, (audit, "I")))
        stack.extend(step for step in steps if step[2] + bounds[step[0]][step[1]] <= most)
    audit, state = found
    letters = []
    while audit is not None:
        audit, letter = audit
        letters.append(letter)
    return "".join(reversed(letters)), state


def price(codes: str, audit: str) -> int:
    """The cost of edits."""
    row, cost = 0, 0
    for letter in audit:
        if letter == "I":
            cost += INSERT
            continue
        cost += {"D": DELETE, "K": KEEP, "R": REROLE}[letter]
        cost += TRUNCATED if letter != "D" and codes[row].isupper() else 0
        row += 1
    return cost


def repaired_lines(codes: str, audit: str, state: int) -> Iterator[tuple[int, str | None]]:
    """``row, role`` of each line of a repair: row -1 for an empty message, role None as it was."""
    row = 0
    for letter in audit:
        if letter == "I":
            state = ANSWERS[state]
            yield -1, ROLE[state]
            continue
        if letter == "K":
            state = AFTER_KEEP[INITIAL[codes[row]]][state]
            yield row, None
        elif letter == "R":
            state = ANSWERS[state]
            yield row, ROLE[state]
        row += 1


def illegal_pairs(codes: str) -> int:
    initials = [INITIAL[c] for c in codes]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``entry, audit, cost, illegal`` to conversations of one piece; short ones repeat a lot."""
    known: dict[str, tuple[str, int, int]] = {}
    for batch in batches:
        audits, costs, pairs = [], [], []
        for codes in batch.column("codes").to_pylist():
            repaired = known.get(codes)
            if repaired is None:
                audit, _ = search(codes, START, ACCEPTED, True)
                repaired = audit, price(codes, audit), illegal_pairs(codes)
                if len(codes) <= SHORT and len(known) < 1 << 16:
                    known[codes] = repaired
            audits.append(repaired[0])
            costs.append(repaired[1])
            pairs.append(repaired[2])
        entries = pa.array([START] * batch.num_rows, pa.int32())
        yield _with(batch, entry=entries, audit=pa.array(audits, pa.string()), cost=pa.array(costs, pa.int64()), illegal=pa.array(pairs, pa.int64()))


def _costs_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``codes`` by ``costs``: from each state a piece is entered in to each it is left in."""
    for batch in batches:
        costs = []
        for codes in batch.column("codes").to_pylist():
            leave = [suffix_bounds(codes, tuple(0 if s == end else NEVER for s in range(4)))[0] for end in range(4)]
            costs.append([leave[end][entry] for entry in range(4) for end in range(4)])
        yield _with(batch.drop_columns(["codes"]), costs=pa.array(costs, pa.list_(pa.int64())))


def _costs_behind(pieces: pa.Table) -> pa.Table:
    """Of one conversation: ``ends``, the costs behind each piece, and whether it is the ``last``."""
    pieces = pieces.sort_by("first_at")
    costs = np.array(pieces.column("costs").to_pylist(), dtype=np.int64).reshape(-1, 4, 4)
    ends, behind = [], np.array(CLOSED, dtype=np.int64)
    for i in reversed(range(len(costs))):
        ends.append(list(ACCEPTED) if i == len(costs) - 1 else behind.tolist())
        behind = np.minimum((costs[i] + behind[None, :]).min(axis=1), NEVER)
    last = [False] * (len(costs) - 1) + [True]
    out = pieces.select(["first_at"])
    return out.append_column("ends", pa.array(ends[::-1], pa.list_(pa.int64()))).append_column("last", pa.array(last))


def _repair_each_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``audits``, ``costs`` and ``exits`` for each state a piece may be entered in, and its ``inner`` illegal pairs."""
    for batch in batches:
        audits, costs, exits, inner = [], [], [], []
        for codes, ends, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "ends", "last"))):
            found = [search(codes, entry, tuple(ends), last) or (None, -1) for entry in range(4)]
            audits.append([audit for audit, _ in found])
            costs.append([None if audit is None else price(codes, audit) for audit, _ in found])
            exits.append([state for _, state in found])
            inner.append(illegal_pairs(codes))
        yield _with(
            batch.drop_columns(["ends", "last"]),
            audits=pa.array(audits, pa.list_(pa.string())),
            costs=pa.array(costs, pa.list_(pa.int64())),
            exits=pa.array(exits, pa.list_(pa.int32())),
            inner=pa.array(inner, pa.int64()),
        )


def _entries(pieces: pa.Table) -> pa.Table:
    """Of one conversation: the state each piece is entered in and whether it begins with an illegal ``seam``."""
    pieces = pieces.sort_by("first_at")
    state, before, entries, seams = START, "", [], []
    for exits, head, tail in zip(*(pieces.column(c).to_pylist() for c in ("exits", "head", "tail"))):
        entries.append(state)
        seams.append(illegal_pairs(before + head))
        state, before = exits[state], tail
    out = pieces.select(["first_at"])
    return out.append_column("entry", pa.array(entries, pa.int32())).append_column("seam", pa.array(seams, pa.int64()))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line: the place in its piece, the two values of its row and a role, if it has a new one."""
    for batch in batches:
        take, place, one, two, roles = [], [], [], [], []
        own = (batch.column(c).to_pylist() for c in ("codes", "audit", "entry", "one", "two"))
        for i, (codes, audit, entry, ones, twos) in enumerate(zip(*own)):
            for n, (row, role) in enumerate(repaired_lines(codes, audit, entry)):
                take.append(i)
                place.append(n)
                one.append(None if row < 0 else ones[row])
                two.append(None if row < 0 else twos[row])
                roles.append(role)
        named = batch.select(["conv", "piece", "whole"]).take(pa.array(take, pa.int64()))
        yield _with(named, place=pa.array(place, pa.int32()), one=pa.array(one, pa.int64()), two=pa.array(two, pa.int64()), new_role=pa.array(roles, pa.string()))


class _Chunks:
    """Joins the lines of a conversation's piece: to a digest if it is whole, else to chunks of bytes."""

    def __init__(self):
        self.key, self.rows = None, []

    def end(self):
        if self.key is not None:
            if self.whole:
                self.rows.append((self.conv, self.piece, 0, None, self.digest.hexdigest()))
            elif self.held:
                self.flush()
        self.key = None

    def flush(self):
        self.rows.append((self.conv, self.piece, self.chunk, b"".join(self.held), None))
        self.held, self.bytes, self.chunk = [], 0, self.chunk + 1

    def add(self, conv, piece, place, whole, line: bytes):
        if self.key != (conv, piece):
            self.end()
            self.key, self.conv, self.piece, self.whole = (conv, piece), conv, piece, whole
            self.digest, self.held, self.bytes, self.chunk, self.place = sha256(), [], 0, 0, None
        if place == self.place:  # a text that came twice
            return
        if whole:
            self.digest.update((b"\n" if self.place is not None else b"") + line)
        else:
            self.held.append(line + b"\n")
            self.bytes += len(line)
            if self.bytes >= CHUNK_BYTES:
                self.flush()
        self.place = place


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, schema = _Chunks(), None

    def taken():
        rows, chunks.rows = chunks.rows, []
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    for batch in batches:
        own = [batch.schema.field("conv"), batch.schema.field("piece")]
        schema = pa.schema([*own, ("chunk", pa.int32()), ("bytes", pa.binary()), ("digest", pa.string())])
        columns = (batch.column(c).to_pylist() for c in ("conv", "piece", "place", "whole", "role", "text"))
        for conv, piece, place, whole, role, text in zip(*columns):
            chunks.add(conv, piece, place, whole, f"{role}:{text}".encode())
        if chunks.rows:
            yield taken()
    chunks.end()
    if chunks.rows:
        yield taken()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation from its chunks in order, without the last line's end."""
    convs, digests, digest, schema = [], [], None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv"), ("digest", pa.string())])
        for conv, data in zip(batch.column("conv").to_pylist(), batch.column("bytes").to_pylist()):
            if digest is None or conv != convs[-1]:
                if digest is not None:
                    digests.append(digest.hexdigest())
                convs.append(conv)
                digest = sha256()
            else:
                digest.update(b"\n")
            digest.update(data[:-1])
    if digest is not None:
        digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"conv": convs, "digest": digests}, schema=schema)


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def unfinished(text: Column) -> Column:
    """The last character that isn't white space is no end of a sentence."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _coded(said: DataFrame) -> DataFrame:
    """``conv, turn, at, code, one, two`` of ``conv, turn, role, text``: ``at`` orders the rows of a conversation."""
    role, text = F.col("role"), F.col("text")
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("o")
    keyed = said.select(
        "conv",
        "turn",
        initial.alias("initial"),
        blank(text).alias("blank"),
        unfinished(text).alias("unfinished"),
        F.xxhash64("role", "text").alias("said"),
        F.xxhash64(F.lit(1), "role", "text").alias("said_too"),
        *_row_values(),
        F.monotonically_increasing_id().alias("spread"),  # equal rows need not go to one task
    )
    order = ["conv", "turn", "said", "said_too", "spread"]
    at = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("at", F.monotonically_increasing_id())
    at = materialize(at, "ordered")
    first = at.groupBy("conv", "said", "said_too").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = at.join(first, "at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("unfinished"), "truncated").otherwise("")
    shown = F.when(fault == "truncated", F.upper("initial")).when(fault == "", F.col("initial"))
    code = F.coalesce(shown, F.translate("initial", CODES[""], CODES["deleted"]))
    coded = told.select("conv", "turn", "at", fault.alias("fault"), code.alias("code"), "one", "two")
    return materialize(coded, "coded")


def _row_values() -> list[Column]:
    """Two values that tell a row's conversation, turn, role and text."""
    own = [F.col("conv"), F.col("turn"), F.col("role"), F.col("text")]
    return [F.xxhash64(*own).alias("one"), F.xxhash64(F.lit(1), *own).alias("two")]


def _settled(coded: DataFrame) -> DataFrame:
    """``conv, piece, first_at, codes, one, two, whole, entry, audit, cost, illegal`` of every piece."""
    listed = F.array_sort(F.collect_list(F.struct("at", "code", "one", "two")))
    pieces = coded.groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(listed.alias("rows"))
    pieces = pieces.select(
        "conv", "piece", F.col("rows.at")[0].alias("first_at"), F.array_join("rows.code", "").alias("codes"), "rows.one", "rows.two"
    )
    pieces = materialize(pieces, "pieces")
    split = pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("split_conv"))
    split = broadcast_if_small(materialize(split, "split-conversations"), BROADCAST_ROWS)
    same = F.col("conv").eqNullSafe(F.col("split_conv"))
    whole = pieces.join(split, same, "left_anti").withColumn("whole", F.lit(True))
    kinds = T.StructType([*whole.schema.fields]).add("entry", "integer").add("audit", "string").add("cost", "long").add("illegal", "long")
    repaired = whole.mapInArrow(_repair_whole, kinds)
    parts = materialize(pieces.join(split, same, "left_semi"), "parts")
    return materialize(repaired.unionByName(_settled_parts(parts).select(*kinds.names)), "settled")


def _settled_parts(parts: DataFrame) -> DataFrame:
    """:func:`_settled` for the pieces of long conversations; only a few numbers of each piece meet the others."""
    longs, place = T.ArrayType(T.LongType()), T.StructType().add("first_at", "long")
    few = T.StructType([parts.schema["conv"], *place.fields])
    between = parts.select("conv", "first_at", "codes").mapInArrow(_costs_between, T.StructType([*few.fields]).add("costs", longs))
    ends = T.StructType([*place.fields]).add("ends", longs).add("last", "boolean")
    behind = materialize(between.groupBy("conv").applyInArrow(_costs_behind, ends), "piece-ends")
    tried = T.StructType([*few.fields]).add("codes", "string").add("audits", T.ArrayType(T.StringType()))
    tried = tried.add("costs", longs).add("exits", T.ArrayType(T.IntegerType())).add("inner", "long")
    searched = parts.select("conv", "first_at", "codes").join(behind, "first_at").select(*few.names, "codes", "ends", "last")
    searched = materialize(searched.mapInArrow(_repair_each_entry, tried), "searched")
    chain = searched.select("conv", "first_at", "exits", F.left("codes", F.lit(1)).alias("head"), F.right("codes", F.lit(1)).alias("tail"))
    entered = T.StructType([*place.fields]).add("entry", "integer").add("seam", "long")
    entries = materialize(chain.groupBy("conv").applyInArrow(_entries, entered), "piece-entries")
    chosen = searched.select("first_at", "audits", "costs", "inner").join(entries, "first_at").select(
        "first_at",
        "entry",
        F.col("audits")[F.col("entry")].alias("audit"),
        F.col("costs")[F.col("entry")].alias("cost"),
        (F.col("inner") + F.col("seam")).alias("illegal"),
    )
    return parts.withColumn("whole", F.lit(False)).join(chosen, "first_at")


def _said_lines(settled: DataFrame, said: DataFrame) -> DataFrame:
    """``conv, piece, whole, place, role, text`` of every line of the repaired conversations."""
    kinds = T.StructType([settled.schema[c] for c in ("conv", "piece", "whole")])
    lines = settled.mapInArrow(_lines, kinds.add("place", "integer").add("one", "long").add("two", "long").add("new_role", "string"))
    lines = materialize(lines, "lines")
    texts = said.select(*_row_values(), "role", "text").dropDuplicates(["one", "two"])
    columns = ["conv", "piece", "whole", "place"]
    kept = lines.where("one IS NOT NULL").join(texts, ["one", "two"]).select(*columns, F.coalesce("new_role", "role").alias("role"), "text")
    added = lines.where("one IS NULL").select(*columns, F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(added)


def _line_digests(lines: DataFrame) -> DataFrame:
    """``conv, digest`` of all lines ``role:text`` of each conversation.

    A digest has to be taken from one end to the other, so one task reads the bytes
    of a conversation, whatever its length, but it reads them in large chunks that
    other tasks have joined, and never holds more than a few.
    """
    conv = lines.schema["conv"]
    joined = T.StructType([conv, lines.schema["piece"]]).add("chunk", "integer").add("bytes", "binary").add("digest", "string")
    parts = lines.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "place").mapInArrow(_joined, joined)
    parts = materialize(parts, "joined-lines")
    digests = T.StructType([conv]).add("digest", "string")
    open_ = parts.where("digest IS NULL").repartition("conv").sortWithinPartitions("conv", "piece", "chunk").select("conv", "bytes")
    return parts.where("digest IS NOT NULL").select("conv", "digest").unionByName(open_.mapInArrow(_digests, digests))


def _prepared(messages: DataFrame, id_col: str) -> DataFrame:
    """``conv, turn, role, text``; a null role or text is one blank."""
    own = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" ")).alias(name)
    return messages.select(F.col(f"`{id_col}`").alias("conv"), F.col("turn").cast("long").alias("turn"), own("role"), own("text"))


def damaged(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``messages`` with every fault that :func:`repair` mends, for trials: id, turn, role, text.

    The CRC-32 of ``id:turn`` modulo 20 says what happens to a row: 0 drops it, 1
    empties its text, 2 removes ends of sentences, 3 repeats it, 4 makes it the
    user's. A null counts as one blank.
    """
    said = _prepared(messages, id_col)
    blank_or = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank_or("conv"), blank_or("turn")).cast("binary")) % 20
    hurt = said.withColumn("kind", kind).where("kind <> 0")
    hurt = hurt.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return hurt.select(F.col("conv").alias(id_col), "turn", role.alias("role"), text.alias("text"))


def repaired_messages(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The lines of the repaired conversations: the id, ``line`` (from 0 within ``piece``), ``piece``, ``role``, ``text``.

    Sorted by id, piece and line they are the conversations; rows and rules as in :func:`repair`.
    """
    bounded_batches(messages.sparkSession)
    said = _prepared(messages, id_col)
    lines = _said_lines(_settled(_coded(said)), said)
    return lines.select(F.col("conv").alias(id_col), "piece", F.col("place").alias("line"), "role", "text")


def repair(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``messages`` (id, ``turn``, ``role``, ``text``): ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    Rows are taken by turn, nulls first, then in an order of their own; equal rows
    stay next to each other. Null roles and texts are one blank, a null id is a
    conversation of its own. Blank rows and rows whose role and text came earlier must
    be deleted (3); a row whose last character ends no sentence costs 1 unless it is.
    Another role, user or assistant, costs 2, and so does an empty message. A role
    counts by its first letter. ``gaps`` ignores null turns. A conversation may end
    up empty. Other columns are ignored; an empty table gives no rows. The audit
    has a letter for every row and must fit a string; nothing else grows with a
    conversation.
    """
    bounded_batches(messages.sparkSession)
    said = _prepared(messages, id_col)
    coded = _coded(said)
    settled = _settled(coded)
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    turns = coded.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    faults = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    audits = settled.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_list(F.struct("piece", "audit")))["audit"], "").alias("audit"),
    )
    digests = _line_digests(_said_lines(settled, said)).withColumnRenamed("conv", "digest_conv")
    audits = audits.withColumnRenamed("conv", "audit_conv")
    joined = faults.join(audits, F.col("conv").eqNullSafe(F.col("audit_conv"))).join(digests, F.col("conv").eqNullSafe(F.col("digest_conv")), "left")
    empty = F.lit(sha256(b"").hexdigest())
    return joined.select(
        F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", empty).alias("repaired_sha256")
    )

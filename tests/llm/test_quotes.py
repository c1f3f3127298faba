"""Quotation links against a linker of dictionaries, and on long and re-wrapped messages."""

import random
import re
from itertools import groupby

from siltlog.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def cut(text):
    """Level and lines of every paragraph that isn't blank."""
    lines = []
    for line in re.split(r"\r\n|\n|\r", text or ""):
        mark = re.match(r"[ \t>]*>[ \t]?", line)
        lines.append((mark[0].count(">") if mark else 0, line[mark.end() :] if mark else line))
    runs = groupby(lines, key=lambda x: (x[0], not x[1].strip()))
    return [(at, level, [b for _, b in run]) for at, ((level, blank), run) in enumerate(runs) if not blank]


def norm(body):
    return " ".join(body.lower().split())


def linked(messages):
    """``reply_to, n_quotes, n_linked, n_partly`` of every message of ``conv, turn, text``."""
    first, out = {}, {}
    for conv, turn, text in messages:
        for _, level, bodies in cut(text):
            for said in [norm(" ".join(bodies)), *map(norm, bodies)] if level == 0 else []:
                first[conv, said] = min(turn, first.get((conv, said), turn))

    def source(conv, turn, said):
        found = first.get((conv, said))
        return found if found is not None and found < turn else None

    for conv, turn, text in messages:
        best, counts = [], [0, 0, 0]
        for at, level, bodies in cut(text):
            if level:
                whole = source(conv, turn, norm(" ".join(bodies)))
                parts = [(n, source(conv, turn, norm(b))) for n, b in enumerate(bodies, 1)] if len(bodies) > 1 else []
                parts = [(n, s) for n, s in parts if s is not None]
                counts[0] += 1
                counts[1] += whole is not None
                counts[2] += whole is None and bool(parts)
                best += [(level, 0, at, 0, whole)] if whole is not None else []
                best += [(level, 1, at, n, s) for n, s in parts]
        out[conv, turn] = (min(best)[-1] if best else None, *counts)
    return out


def thread(rng, conv):
    said, rows = [], []
    for turn in range(rng.randint(1, 12)):
        lines = []
        for _ in range(rng.randint(0, 3) if said else 0):
            level, bodies = rng.choice(said)
            bodies = bodies[: rng.randint(1, len(bodies))] if rng.random() < 0.4 else bodies
            if rng.random() < 0.3:  # wrapped anew
                words = " ".join(bodies).split()
                bodies = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)]
            marks = rng.choice(["> ", ">", ">> ", " > > "])
            lines += [marks + b.upper() for b in bodies] + rng.choice([[], [""], [">"]])
        for _ in range(rng.randint(0, 3)):
            bodies = [" ".join(rng.choices(["yes", "no", "the", "plan", "ünder", "x1"], k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
            said.append((0, bodies))
            lines += bodies + rng.choice([[""], ["", ""]])
        rows.append((conv, turn, "\n".join(lines)))
    return rows


def test_same_as_a_linker_of_dictionaries(spark):
    rng = random.Random(8)
    rows = [row for conv in range(60) for row in thread(rng, conv)]
    want = linked(rows)
    assert sum(w[1] > 0 for w in want.values()) > 100 and sum(w[3] > 0 for w in want.values()) > 20
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], SCHEMA)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"], r["n_linked"], r["n_partly"]) for r in quotes.reply_ordered(df).collect()}
    assert got == want


def test_paragraphs_are_linked_however_they_are_wrapped(spark):
    rows = [
        (1, 0, "a", "First part of it\nin two lines.\n\nSecond part, all in one line."),
        (1, 1, "b", "> Second part,\n> all in\n> one line.\nAgreed."),
        (1, 2, "c", "> First part\n> of it in two lines.\n>\n> Never said.\nHm."),
        (1, 3, "d", "> First part of it\n> left out\n"),
    ]
    got = {r["turn"]: r for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[t]["reply_to"], got[t]["n_quotes"], got[t]["n_linked"], got[t]["n_partly"]) for t in (1, 2, 3)] == [
        (0, 1, 1, 0), (0, 2, 1, 0), (0, 1, 0, 1),
    ]


def test_work_grows_with_the_text(spark):
    lines = [f"{'> ' if i % 2 else ''}line {i}" for i in range(100_000)]
    rows = [(1, 0, "a", "\n".join(f"line {i}" for i in range(100_000))), (1, 1, "b", "\n".join(lines)), (1, 2, "c", "\n\n".join(lines))]
    got = {r["turn"]: r for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["n_quotes"] == got[1]["n_linked"] == got[2]["n_linked"] == 50_000 and got[1]["reply_to"] == got[2]["reply_to"] == 0
    assert got[1]["body"].count("\n") == 49_999

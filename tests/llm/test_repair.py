import heapq
import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pyarrow.parquet as pq
import pytest

from siltlog.llm import repair
from tests.conftest import SF_DIR

WHITE = " \t\n\v\f\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Edits of ``(role, text, fault)`` rows by cost, then audit: Dijkstra over row and last initial."""
    heap, done, n = [(0, "", 0, "", ())], set(), len(rows)
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == n and last in ("", "a"):
            return cost, audit, list(lines)
        if (i, last) in done:
            continue
        done.add((i, last))
        given = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[given]
        heapq.heappush(heap, (cost + 2, audit + "I", i, given, (*lines, (name, ""))))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, given, (*lines, (name, text))))
                if role[:1] and role[:1] in NEXT[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, (role, text))))


def exhaustive(rows, most_inserted=2):
    inserts = [w for n in range(most_inserted + 1) for w in itertools.product("ua", repeat=n)]
    best = None
    edits = [[("D", "")] + ([] if f in ("blank", "duplicate") else [("K", r[:1] or "?"), ("R", "u"), ("R", "a")]) for r, _, f in rows]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for chosen in itertools.product(*edits):
            audit, said, cost = "I" * len(gaps[0]), "".join(gaps[0]), 2 * len(gaps[0])
            for (letter, initial), gap, (_, _, fault) in zip(chosen, gaps[1:], rows):
                audit += letter + "I" * len(gap)
                said += initial + "".join(gap)
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and fault == "truncated") + 2 * len(gap)
            if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(WHITE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def replay(messages):
    """Expected rows of ``repair`` for ``conv, turn, role, text`` without ties of one turn."""
    held = defaultdict(list)
    for conv, turn, role, text in messages:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        told = faults([r[1:] for r in rows])
        cost, audit, lines = cheapest(told)
        initials = [r[:1] for r, _, _ in told]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == k for _, _, f in told) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def damage(messages):
    for conv, turn, role, text in messages:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        yield from [row] * (0 if kind == 0 else 2 if kind == 3 else 1)


def got(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in columns) for r in df.collect()}


def code(role, fault):
    initial = role[:1] if role[:1] in ("s", "u", "a") and role else "o"
    return initial.upper() if fault == "truncated" else initial if not fault else str("suao".index(initial))


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), "x", rng.choice(["", "", "", "blank", "truncated"])) for _ in range(n)]


def test_search_is_exhaustive_on_short_conversations():
    rng = random.Random(5)
    for n, times in ((0, 1), (1, 20), (2, 60), (3, 4)):
        for _ in range(times):
            rows = random_rows(rng, n)
            codes = "".join(code(r, f) for r, _, f in rows)
            audit, _ = repair.search(codes, repair.START, repair.ACCEPTED, True)
            assert (repair.price(codes, audit), audit) == exhaustive(rows), rows


def test_search_is_cheapest_on_long_conversations():
    rng = random.Random(6)
    for n in (5, 8, 20, 60, 300):
        for _ in range(10):
            rows = random_rows(rng, n)
            codes = "".join(code(r, f) for r, _, f in rows)
            audit, _ = repair.search(codes, repair.START, repair.ACCEPTED, True)
            cost, want, _ = cheapest(rows)
            assert (repair.price(codes, audit), audit) == (cost, want)


def test_search_is_linear_on_a_full_piece():
    codes = "uusaoUA013" * 410
    audit, _ = repair.search(codes, repair.START, repair.ACCEPTED, True)
    assert len(audit) - audit.count("I") == len(codes)


@pytest.mark.parametrize("bits", [12, 2])
def test_random_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    monkeypatch.setattr(repair, "CHUNK_BYTES", 20)
    rng = random.Random(bits)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "User", "", None]
    texts = ["Yes.", "No", "why? ", "", None, " \n", "Ünï!\n\n", "a.b", "word " * 50 + "."]
    rows = []
    for conv in [*range(40), None]:
        n = 120 if conv in (3, 4, None) else rng.randrange(9)
        turns = rng.sample(range(-5, 400), n)
        rows += [(conv, t, rng.choice(roles), (rng.choice(texts) or "") + (str(t) if rng.random() < 0.5 else "")) for t in turns]
        rows += [(conv, None, "user", "no turn.")] if rng.random() < 0.3 else []
    rows += [(77, 1, "user", "twice."), (77, 1, "user", "twice."), (78, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "conv_id long, turn long, role string, text string, piece int, at long, conv string")
    want = replay(rows)
    assert got(repair.repair(df.repartition(7))) == want
    lines = repair.repaired_messages(df).orderBy("conv_id", "piece", "line").collect()
    own = [f"{r.role}:{r.text}" for r in lines if r.conv_id == 3]
    assert sha256("\n".join(own).encode()).hexdigest() == want[3][-1]
    assert got(repair.repair(repair.damaged(df))) == replay(damage(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(df).count() == 0 and repair.repaired_messages(df).count() == 0


def test_whole_table(spark):
    from siltlog.llm import queries

    rows = [tuple(r.values()) for r in pq.read_table(f"{SF_DIR}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    want = replay(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert got(queries.op12(spark, SF_DIR)) == {conv: want.get(conv, empty) for conv in {r[0] for r in rows}}

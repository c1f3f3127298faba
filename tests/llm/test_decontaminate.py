import random
import re

import pytest

from siltlog.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "ünder", "a1", "b2", "cat", "Dog", "x"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 3, 10, 14, 25]))) for i in range(12)] + [(3, text(12)), (50, None)]
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)] + [(90, None), (91, items[5][1])]
    docs += [(100 + i, text(5) + " " + (t or "") + " " + text(4)) for i, (_, t) in enumerate(items)]
    found = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in found.collect()}
    assert got == brute_force(docs, items)


def test_proximity(spark):
    item = "alpha beta gamma delta"
    docs = [(1, "so alpha beta gamma delta it"), (2, "alpha then beta gamma now delta"), (3, "alpha one two three four beta gamma delta"), (4, "delta")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    exact = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in decontaminate.overlaps(docs, items).collect()}
    assert exact == {1: [("i", 1, 4)], 2: [], 3: [], 4: []}
    near = {r["doc_id"]: len(r["matches"]) > 0 for r in decontaminate.overlaps(docs, items, slop=2).collect()}
    assert near == {1: True, 2: True, 3: False, 4: False}


def test_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "?!")], "item_id long, text string")
    kept = decontaminate.decontaminated(edges, items)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
    assert decontaminate.decontaminated(nothing, items).count() == 0
    assert decontaminate.decontaminated(edges, items.where("false")).count() == edges.count()

import random
import re

import pytest

from siltlog.llm import graph, neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def family(rng, copies, length=90):
    """Copies of one text with one to ten words replaced: some are alike, some are not."""
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(1, 10)):
            words[rng.randrange(length)] = rng.choice(["the", "of", "and", "to"])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "STAR_PART", 7 if seed == 1 else 512)
    rng = random.Random(seed)
    texts = family(rng, 120) + family(rng, 25, 30) + ["Same  TEXT here", "same text here", "same text", None, "", " \t"]
    texts += [" ".join(rng.choices("pqrstuvw", k=12)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows)


def test_edges(spark, edges, nothing):
    rows = {}
    for r in neardup.near_duplicates(edges).collect():
        rows.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert rows[1] == [(0, 1, True)] and rows[2] == [(0, 2, True)] and rows[3] == [(0, 3, True)]
    assert rows[4] == [(1, 4, True)] and rows[5] == [(1, 4, False)] * 2
    assert rows[None] == [(1, None, True)]
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.deduplicated(edges)
    assert kept.columns == edges.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_repeated_kept_rows_stay_once(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.deduplicated(df).collect()) == [1, 2]


def test_rows_of_one_id_are_judged_apart(spark):
    rows = [(2, "t"), (5, "t"), (5, "another text"), (5, "another text")]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "t"), (5, "another text")]

    rows = [(None, "t"), (1, "t"), (None, "of no other"), (None, None), (None, "u u"), (None, "u u")]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [
        ("1", "t"), ("None", "None"), ("None", "of no other"), ("None", "u u"),
    ]


def test_one_of_several_near_copies_with_the_least_id_is_kept(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join([*base[:-1], "y"])]
    for least in (1, None):
        rows = [(least, texts[0]), (least, texts[1]), (least if least is None else 9, texts[2])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = neardup.near_duplicates(df).collect()
        assert [r["component_id"] for r in found] == [least] * 3 and sum(r["kept"] for r in found) == 1
        assert [r["doc_id"] for r in neardup.deduplicated(df).collect()] == [least]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    rows = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots) == 41 + 60
    assert all(roots[i] == 0 for i in range(41)) and all(roots[1000 + i] == 1000 for i in range(60))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sets_with_one_number_are_told_apart(spark):
    rows = [(1, 7, 70), (2, 7, 70), (3, 7, 71), (4, 8, 80), (5, None, None)]
    sigs = spark.createDataFrame(rows, "row_key long, node long, node_check long")
    got = {r["row_key"]: r["node"] for r in neardup._told_apart(sigs).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 8 and got[5] is None and len({got[1], got[3], 7, 8}) == 4

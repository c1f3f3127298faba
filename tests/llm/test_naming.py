from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltlog.llm import naming


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    return sorted((i, max(groups[lowered(t)]), len(groups[lowered(t)]), sha256(lowered(t).encode()).hexdigest()) for i, t in rows)


TEXTS = [None, "", "a", "A", "abcd", "abcde", "ABCDE", "abcdabcd", "abcdabcdabcd", "abcdabcdabce", "É" * 9, "é" * 9, "z" * 40, "z" * 41, "Z" * 41]


def weak(block):
    """Many blocks share one value."""
    return F.pmod(F.xxhash64(block), F.lit(3))


@pytest.mark.parametrize("value, block_bytes", [(F.xxhash64, 4), (weak, 7), (weak, 2048)])
def test_same_as_comparing_texts(spark, value, block_bytes):
    rows = [(i, TEXTS[i * 7 % len(TEXTS)]) for i in range(60)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(5)
    found = naming.exact_groups(df, ["doc_id"], block_bytes=block_bytes, value=value).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_blocks_tile_texts():
    texts = ["", "AbC", None, "x" * 9, "Ä" * 5]
    digests, blocks = naming.cut_blocks(pa.array(texts), 4)
    assert [b"".join(b) for b in blocks.to_pylist()] == [lowered(t).encode() for t in texts]
    assert [len(b) for b in blocks.to_pylist()] == [1, 1, 1, 3, 3]
    assert digests[1] == sha256(b"abc").hexdigest()


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(5, "t"), (5, "T"), (5, "other"), (None, "t"), (None, "alone"), (3, None)]
    names = "keep_id string, `Group_Size` int, row string, rid int, name int, id int, value int, at int, blocks int"
    df = spark.createDataFrame([(*r, "k", 1, "r", 2, 3, 4, 5, 6, 7) for r in rows], f"doc_id long, text string, {names}")
    found = naming.exact_groups(df)
    assert set(found.columns) == {
        "doc_id", "text", "input_keep_id", "input_Group_Size", "row", "rid", "name", "id", "value", "at", "blocks", *naming.ADDED,
    }
    got = found.collect()
    assert sorted((r.doc_id or 0, r.text or "", r.keep_id or 0, r.group_size) for r in got) == [
        (0, "alone", 0, 1), (0, "t", 5, 3), (3, "", 3, 1), (5, "T", 5, 3), (5, "other", 5, 1), (5, "t", 5, 3),
    ]
    assert sum(r.kept for r in got if r.group_size == 3) == 1 and sum(r.kept for r in got) == 4
    left = naming.deduplicated(df)
    assert left.columns == df.columns and left.count() == 4


def test_empty_table_and_one_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, "word " * 400_000 + "x"), (3, "WORD " * 400_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in naming.exact_groups(df, ["doc_id"]).collect()) == [(1, 3), (2, 2), (3, 3)]
    assert naming.exact_groups(df.where("false")).count() == 0

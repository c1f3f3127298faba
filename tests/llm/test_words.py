import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siltlog.llm import decontaminate, neardup, words


def batch(total, length=2_000, seed=1):
    """A batch of about ``total`` bytes of text."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5_000)]
    texts = [" ".join(rng.choices(pool, k=length // 6)) for _ in range(total // length)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row_key", "text"])


def peak(work, rows):
    """The most bytes of Python and numpy that a worker takes for one batch."""
    for _ in work(iter([batch(100_000)])):  # tables that are made once
        pass
    tracemalloc.start()
    try:
        for _ in work(iter([rows])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("work", [neardup._signatures, neardup._sets])
def test_a_worker_takes_little_beside_its_batch(work):
    assert peak(work, batch(8 << 20)) < 24 << 20


def test_a_worker_takes_little_beside_its_segment():
    tests = np.unique(words.mix(np.arange(10_000, dtype=np.uint64)))
    assert peak(decontaminate._segments(tests, 74), batch(8 << 20)) < 48 << 20


@pytest.mark.parametrize("piece", [1, 7, 64, 256 << 10])
def test_words_do_not_depend_on_pieces(piece, monkeypatch):
    texts = batch(40_000, 400).column("text").to_pylist() + [None, "", " ", "x", "y" * 300, "  A b\nC "]
    data, bounds = words.text_buffer(pa.array(texts))
    monkeypatch.setattr(words, "PIECE_BYTES", 4 << 20)
    values, at = words.hash_words(data, bounds, words.SPACED)
    monkeypatch.setattr(words, "PIECE_BYTES", piece)
    own, own_at = words.hash_words(data, bounds, words.SPACED)
    assert (own == values).all() and (own_at == at).all()
    assert list(np.diff(at)) == [len((t or "").split()) for t in texts]


def test_batches_of_near_duplicates_and_of_the_index_are_small(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    words.bounded_batches(spark)
    neardup.signatures(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    words.bounded_batches(spark)
    decontaminate.overlaps(docs, spark.createDataFrame([("i", "a b")], "item_id string, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"

"""What a worker and a reader hold of long prompts and answers."""

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siltlog import session
from siltlog.plans import ledger, model
from siltlog.plans.model import TOKEN_COLUMNS, ask

for module in (ledger, model):
    cloudpickle.register_pickle_by_value(module)

LENGTH = 40_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="module")
def long_prompts(spark):
    """As long as those of 150 patterns, and hard to compress."""
    digests = F.transform(F.sequence(F.lit(1), F.lit(LENGTH // 64)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))
    return spark.range(400).select(
        F.lit("s").alias("stage"), F.col("id").alias("batch_id"), F.lit("sys").alias("system_prompt"),
        F.array_join(digests, "").alias("user_prompt"),
    )


def answering(text_of):
    return lambda frame: frame.assign(text=text_of(frame), **{c: 1 for c in TOKEN_COLUMNS})


def test_a_worker_holds_few_long_prompts_at_once(long_prompts):
    """A frame's first label is its row's place in what the worker took from its batch."""
    found = ask(long_prompts, answering(lambda frame: str(frame.index[0])), 1)
    places = [int(r["text"]) for r in found.select("text").collect()]
    assert len(places) == 400 and (max(places) + 1) * LENGTH < 2 << 20


def test_a_reader_takes_few_long_answers_at_once(long_prompts):
    found = ask(long_prompts, answering(lambda frame: frame["user_prompt"]), 1)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 400 and max(g.num_rows for g in groups) * LENGTH < 10 << 20
    assert found.where("text = user_prompt").count() == 400


@pytest.mark.parametrize("size, at_once", [(1, 1), (30, 1), (30, 2), (250, 2), (1000, 1)])
def test_calls_stay_whole_whatever_the_batches_are(long_prompts, size, at_once):
    found = ask(long_prompts, answering(lambda frame: str(len(frame))), 1, size, at_once=at_once)
    rows = found.select("batch_id", "text", F.length("user_prompt").alias("n")).collect()
    assert sorted(r["batch_id"] for r in rows) == list(range(400)) and {r["n"] for r in rows} == {LENGTH}
    rest = 400 % size
    assert sorted(int(r["text"]) for r in rows) == sorted([min(size, 400)] * (400 - rest) + [rest] * rest)


def test_a_setting_is_put_back(spark, long_prompts):
    before = spark.conf.getAll.get(BATCH)
    try:
        for own in (None, "16m"):
            spark.conf.set(BATCH, own) if own else spark.conf.unset(BATCH)
            ask(long_prompts.limit(2), answering(lambda frame: "x"), 1)
            assert spark.conf.getAll.get(BATCH) == own and "parquet.block.size" not in spark.conf.getAll
        with pytest.raises(KeyError), session.setting(spark, BATCH, "1m"):
            assert spark.conf.get(BATCH) == "1m"
            raise KeyError
        assert spark.conf.getAll.get(BATCH) == "16m"
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)

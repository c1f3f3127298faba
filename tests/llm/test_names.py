"""A caller's columns may have any name the operators work with."""

import pytest

import corpus_pipeline
from siltlog.llm import decontaminate, naming, neardup, quality, secrets
from tests.conftest import SF_DIR

WORKING = (
    "_id _key _y _bad _found _steps _ends _text _base _all _markov _tokens _assign _access _hex _copy _host _path _source _in "
    "row key id y own_id own_key row_key node node_check bands n_shingles root least c m nc nm kept group_size keep_id rid name value block "
    "n_words n_hit items matches keys segment host path q evidence score n good k host_rate path_rate size copies shard slot old_shard "
    "mix_shard mix_pass mix_order base spans n_assign n_access n_hex n_markov input_kept input_score text_sha256"
).split()
OWN = ["doc_id", "text", "lang", "source"]


@pytest.fixture(scope="module")
def clashing(spark, edges):
    docs = edges.select(*OWN).withColumns({name: edges["doc_id"].cast("string") for name in WORKING})
    return spark.createDataFrame(docs.collect(), docs.schema)


def same_values(rows, names=WORKING):
    return all(str(r[n]) == str(r["doc_id"]) for r in rows for n in names)


def test_filters_return_the_rows_as_they_are(spark, clashing):
    labels = spark.createDataFrame([(4, 1, 7), (5, 0, 7), (6, 1, 7)], "doc_id long, quality int, _y int")
    items = spark.createDataFrame([(1, "one two", 2)], "item_id long, text string, key int")
    for out, n in (
        (neardup.deduplicated(clashing), 8),
        (naming.deduplicated(clashing), 7),
        (decontaminate.decontaminated(clashing, items), 7),
        (quality.accepted(clashing, labels.where("quality = 1")), 10),
    ):
        assert out.columns == clashing.columns
        rows = out.collect()
        assert len(rows) == n and same_values(rows)


def test_operators_keep_clashing_columns_as_inputs(spark, clashing):
    found = secrets.find_secrets(clashing, [0.0] * secrets.PAIRS)
    added = ["n_assign", "n_access", "n_hex", "n_markov", "base", "spans"]
    rows = found.collect()
    assert len(rows) == clashing.count()
    assert same_values(rows, [f"input_{n}" if n in added else n for n in WORKING])
    searched = decontaminate.overlaps(clashing, spark.createDataFrame([(1, "one two")], "item_id long, text string")).collect()
    assert same_values(searched, [f"input_{n}" if n in decontaminate.FOUND else n for n in WORKING])
    assert sum(r["n_hit"] > 0 for r in searched) == 3


def test_every_stage_keeps_clashing_columns(spark, clashing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SF_DIR)
        assert out.columns == clashing.columns, name
        assert same_values(out.collect()), name
    last = corpus_pipeline.STAGES[-1][1](spark, clashing, SF_DIR)
    rows = last.collect()
    added = ["shard", "slot", "old_shard"]
    assert len(rows) == clashing.count() and same_values(rows, [f"input_{n}" if n in added else n for n in WORKING])

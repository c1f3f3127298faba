import corpus_pipeline
from siltlog.llm import neardup
from tests.conftest import SF_DIR
from tests.llm.test_decontaminate import brute_force


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF_DIR)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in rows.collect()})
        before, at = at, rows
    good, unlike, unseen, mixed = kept
    wrong = [d for d, q in labels.items() if (d in good) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    found = neardup.near_duplicates(spark.createDataFrame(list(good.items()), "doc_id long, text string")).collect()
    assert set(unlike) == {r["doc_id"] for r in found if r["kept"]}
    hit = brute_force(list(unlike.items()), benchmark)
    assert set(unseen) == {d for d, (_, n, _) in hit.items() if n == 0}
    assert set(mixed) <= set(unseen)
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF_DIR)
    assert last.count() == at.count() and {"shard", "slot"} <= set(last.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing", "sharding"]


def test_final_shards_hold_the_shares_of_the_mix(spark):
    docs = spark.range(8_000).selectExpr(
        "id DIV 2 AS doc_id", "concat('text ', id DIV 2) AS text", "CASE WHEN id % 20 < 12 THEN 'hot' ELSE concat('s', id % 20 DIV 4) END AS source"
    )
    rows = corpus_pipeline.sharded(spark, docs, "").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert len(rows) == 8_000 and len(shards) == corpus_pipeline.SHARDS and "_copy" not in rows[0].asDict()
    for own in shards.values():
        assert 0.45 <= sum(r["source"] == "hot" for r in own) / len(own) <= 0.75
        assert len({r["source"] for r in own}) == 3
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    places = {}
    for r in rows:
        places.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    close = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for a, b in places.values())
    assert close <= 0.01 * len(places)

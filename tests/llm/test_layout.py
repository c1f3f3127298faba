"""Sharding, mixing and the archive."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltlog.llm import mixing, sharding, warc
from siltlog.session import working_path


def test_flow_moves_the_least(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(0, 100, 6).tolist()
        total = sum(sizes)
        capacities = [total // 5 + (k < total % 5) for k in range(5)]
        flow = sharding.min_cost_flow(sizes, capacities)
        assert flow.sum(axis=1).tolist() == sizes and (flow.sum(axis=0) <= capacities).all() and (flow >= 0).all()
        # With unit prices, what stays is what fits under its own number.
        stays = sum(min(s, c) for s, c in zip(sizes, capacities))
        assert flow.sum() - np.trace(flow[:5, :5]) == total - stays
    cost = np.array([[0, 5, 1], [5, 0, 1]])
    assert sharding.min_cost_flow([10, 0], [4, 4, 4], cost).tolist() == [[4, 2, 4], [0, 0, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2])


def test_reshard(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(pmod(xxhash64(id), 40) as int))").alias("text"), (F.col("id") % 3 * 7).cast("int").alias("shard")
    )
    out = sharding.reshard(docs, 8, F.col("shard"), blocks_per_shard=64)
    assert out.columns == ["doc_id", "text", "input_shard", "shard", "slot", "old_shard"]
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 3000
    slots, size = {}, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] = size.get(r["shard"], 0) + len(r["text"]) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(8))
    assert max(size.values()) - min(size.values()) < 300
    # Three old shards of a third each: two of them keep an eighth, one is shard 14 and keeps nothing.
    assert sum(r["old_shard"] == r["shard"] for r in rows) > 600


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    text = F.expr("repeat('x', 100)")
    docs = spark.range(900).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 3).cast("int").alias("shard"), (F.col("id") / 3).cast("long").alias("slot"))
    first = sharding.write_shards(docs, str(tmp_path / "a"))
    same, plan = sharding.rewrite_shards(spark, first.where("shard < 3"), str(tmp_path / "b"), 3, blocks_per_shard=300)
    assert plan.moved_bytes <= 3 * 116
    grown, plan = sharding.rewrite_shards(spark, first, str(tmp_path / "c"), 4, blocks_per_shard=100)
    rows = sharding.read_shards(spark, grown).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("doc_id").alias("d")).collect()
    assert sum(r["d"] for r in rows) == 900 and all(r["m"] == r["n"] - 1 for r in rows) and len(rows) == 4
    assert plan.least_moved_bytes == 900 * 116 // 4


def test_layout_edges(spark, edges, nothing):
    out = sharding.reshard(edges, 4, F.lit(None).cast("int"))
    assert out.count() == edges.count() and {"input_shard", "row", "score", "key"} <= set(out.columns)
    assert sharding.reshard(nothing, 4, F.lit(1)).count() == 0
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mix(edges, shards=3)
    assert set(edges.columns) < set(mixed.columns)
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).head()[0] <= 6  # two equal rows, three passes


def test_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.capped_targets([300, 10, 0, 90], [1, 2, 3, 1]) == [185.0, 30.0, 0.0, 185.0]
    assert mixing.capped_targets([], []) == []


def test_quota_tree():
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 40, 0, 7])
    got = mixing.split_quotas(quotas, 7, rng)
    assert (got.sum(axis=0) == quotas).all() and got.shape == (7, 4)
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1


def test_mix_takes_near_its_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('word ', 1 + cast(pmod(xxhash64(id), 30) as int))").alias("text"),
        F.expr("case when id % 3 = 0 then 'big' when id % 50 = 1 then null when id % 7 = 1 then 'Zed' else 'é' end").alias("source"),
    )
    rows = mixing.digest(docs).select("row.doc_id", "source", "key", "size")
    drawn = mixing.draw(rows, mixing.plan_mix(rows)).withColumn("taken", F.col("size") * F.size("copies"))
    per = drawn.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("s"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per) == 4000
    assert all(r["size"] == r["s"] and abs(r["taken"] - r["target"]) <= 31 for r in per)
    assert drawn.where("taken > 3 * size").count() == 0
    again = mixing.draw(rows.repartition(5), mixing.plan_mix(rows.repartition(5))).select("doc_id", "copies")
    assert again.exceptAll(drawn.select("doc_id", "copies")).count() == 0
    assert mixing.mix(docs).count() == drawn.agg(F.sum(F.size("copies"))).head()[0]


PAGES = [(1, "http://a/\r\nx", "same"), (2, "http://b/", "same"), (3, None, "other ü"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "n", "same")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, address string")
    path = working_path(spark, "archive")
    archive = warc.write_archive(pages, path)
    assert archive.payloads.count() == 3 and archive.headers.count() == len(PAGES)
    rows = warc.read_archive(archive, with_records=True).collect()
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), None: ("revisit", 2)}
    html = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        body = html[r["page_id"]]
        assert (r["record_type"], r["refers_to"]) == want[r["page_id"]] and r["verified"]
        assert r["payload_bytes"] == len(body) and bytes(r["payload"]) == body
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, _, tail = bytes(r["record"]).partition(b"\r\n\r\n")
        assert tail == (body if r["record_type"] == "response" else b"") + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    some = warc.archived(pages, shared_from=4).where("payload_bytes = 0").collect()
    assert {r["record_type"] for r in some} == {"response"}
    assert warc.archived(pages.where("false")).count() == 0


def test_crc_is_of_the_utf8_bytes(spark):
    assert spark.createDataFrame([("ü",)], "t string").select(F.crc32("t")).head()[0] == zlib.crc32("ü".encode())

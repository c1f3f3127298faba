"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltlog.llm import decontaminate, kdtree, mixing, naming, neardup, negatives, pii, quality, quotes, repair, secrets, sharding, warc, words
from siltlog.llm.registry import query, table
from siltlog.session import materialize

# Workers may run without the package on their path.
for module in (words, decontaminate, kdtree, naming, neardup, negatives, pii, repair):
    cloudpickle.register_pickle_by_value(module)


@query("op2_flow_resharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by a hash of their source, resharded to 40 equal shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32("source"), F.lit(40)).cast("int"), F.lit(sharding.NO_SHARD)).alias("old_shard"),
        F.xxhash64("doc_id", "text").alias("key"),
        sharding.text_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    # The texts are read once: moves and slots need only these few columns.
    rows = materialize(rows, "shard-rows")
    placed = sharding.apply_plan(rows, sharding.plan_moves(rows, 40))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        (F.col("old_shard") != F.col("shard")).alias("moved"),
    )


@query("op3_quota_tree_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = materialize(mixing.digest(docs).select("row.doc_id", "source", "key", "size"), "mix-rows")
    drawn = mixing.draw(rows, mixing.plan_mix(rows))
    return drawn.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("copies")).alias("taken"),
        F.size("copies").alias("times"),
        F.transform("copies", lambda c: c["shard"]).alias("mix_shards"),
    )


_OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(body), (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to, TRUE AS verified
FROM p
"""


@query("op8_addressed_archive", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as an archive and read back."""
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9_SQL = rf"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), gram AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) r(i)
), hit AS (
  SELECT doc_id, i, n, item_id FROM gram JOIN win USING (n, s)
), pos AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(10) r(k) WHERE k < n GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op9_positional_index", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP10_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM doc, unnest(range(1, len(w) - least(5, len(w)) + 2)) r(i) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least_id AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_id LEFT JOIN size USING (doc_id)
"""


@query("op10_star_minhash", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op4_shard_kdtrees", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_hidden_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"pii.n_{kind}" for kind in pii.KINDS],
        F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"),
        "pii.spans",
        "pii.n_hidden",
    )


@query("op1_markov_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets of every document; the models are trained on the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = secrets.train(secrets.labelled_samples(docs))
    return secrets.find_secrets(docs, weights).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_markov",
    )


@query("op5_bayes_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality posterior of every document, with the source as host and the language as path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    host, path = quality.document_sites(docs)
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), host, path, keep=["doc_id"])
    return judged.select("doc_id", "evidence", "host_rate", "path_rate", "score", "kept")


@query("op6_quotation_links")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with its thread."""
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


_OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query("op11_slot_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the labels of every seventh moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_search_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with rows damaged by a checksum of their place, and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    repaired = repair.repair(repair.damaged(rows)).withColumnRenamed("conv_id", "repaired_id")
    ids = rows.select("conv_id").distinct()
    joined = ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query("op13_block_naming", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return naming.exact_groups(table(spark, sf_dir, "documents"), ["doc_id"])

"""The queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from thermoband.llm import conversations, host_reputation, merkle, pii, quality, secret_scan, sql
from thermoband.llm.common import table
from thermoband.llm.decontaminate import find_benchmark
from thermoband.llm.frames import round_trip
from thermoband.llm.packing import pack
from thermoband.llm.sharding import shard
from thermoband.llm.simhash import near_duplicates
from thermoband.llm.token_count import count_tokens
from thermoband.llm.vectors import near_duplicate_vectors


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), pii.fit(spark))

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"),
        pii.named(F.col("spans")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of the query.
URL_RULES = tuple(
    host_reputation.Rule(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
)


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = host_reputation.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return host_reputation.judge(pages, outcomes, URL_RULES)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    leaves = docs.select(
        "lang",
        F.col("doc_id").cast("bigint").alias("doc_id"),
        merkle.document_leaf().alias("leaf"),
        F.when(tampered, merkle.document_leaf(lowered)).alias("altered"),
    )
    proofs = merkle.manifest(leaves, "lang", "doc_id", "leaf", "altered")
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("altered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = F.lit(" ")
    turns = table(spark, sf_dir, "conversations").withColumns({c: F.col(c).cast("bigint") for c in ("conv_id", "turn")})
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    damaged = turns.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1))).alias("copy"),
    )
    found = conversations.report(damaged).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in conversations.COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secret_scan,
        op3_decontaminate,
        op4_shard_slots,
        op5_pack_windows,
        op6_token_frames,
        op7_embedding_dedup,
        op8_pii,
        op9_quality,
        op10_simhash,
        op11_url_reputation,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op3_decontaminate": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (
    SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM tests WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM docs, sizes),
spans AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM places),
hits AS (SELECT s.doc_id, s.size, s.i, x.item_id FROM spans s JOIN windows x ON s.size = x.size AND s.win = x.win),
words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(t.names, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words s ON d.doc_id = s.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
""",
    "op7_embedding_dedup": """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
""",
    "op11_url_reputation": sql.REPUTATION.format(
        suffixes=", ".join(f"'{s}'" for s in host_reputation.SUFFIXES),
        rules=", ".join(
            f"({k}, '{r.verdict}', '{r.where.partition('/')[0]}', '/{r.where.partition('/')[2]}')" for k, r in enumerate(URL_RULES)
        ),
    ),
    "op12_merkle_manifest": sql.MERKLE,
}

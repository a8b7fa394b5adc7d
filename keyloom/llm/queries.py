"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import scratch, table
from keyloom.llm.decontaminate import find_benchmark_items
from keyloom.llm.embedding_dedup import embedding_components
from keyloom.llm.mixing import mix_counts
from keyloom.llm.pii import BASE, find_personal_data
from keyloom.llm.quality import held_out, score_documents, train
from keyloom.llm.sharding import shard_documents
from keyloom.llm.simhash import simhash_components
from keyloom.llm.substring_dedup import repeated_passages
from keyloom.llm.token_counts import count_tokens
from keyloom.llm.token_store import read_tokens, write_tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri, tokenizer_path())
    return read_tokens(spark, uri, with_ids=False)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_components(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), name), ",")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), scores.alias("scores"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(strlen(text), 0)::BIGINT AS b
  FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY k) AS r FROM sources),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER lower_ones, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER lower_ones, 0)) AS level
  FROM weighed WINDOW lower_ones AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT k, r, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels),
wanted AS (
  SELECT *, (source_size + 255) // 256 AS nb, floor(target)::BIGINT // source_size AS whole, floor(target)::BIGINT % source_size AS rest
  FROM targets WHERE source_size > 0),
blocks AS (SELECT *, unnest(range(nb)) AS blk FROM wanted),
drawn AS (
  SELECT *, least(256, source_size - blk * 256) AS len, (blk * 65537 + r) % 2147483647 AS low FROM blocks),
mixed AS (SELECT *, ((low * 48271 + 1) % 2147483647 * ((low * 48271 + 1) % 2147483647) + low * 16807) % 2147483647 AS m FROM drawn),
parts AS (
  SELECT k, blk, greatest(0, least(len, rest - coalesce(sum(len) OVER (PARTITION BY k ORDER BY m, blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM mixed),
docs AS (SELECT *, ((coalesce(doc_id, -1) + size * 31 + b) % 2147483647 + 2147483647) % 2147483647 AS low FROM sized),
ordered AS (SELECT *, ((low * 48271 + 1) % 2147483647 * ((low * 48271 + 1) % 2147483647) + low * 16807) % 2147483647 AS m FROM docs),
placed AS (
  SELECT doc_id, k, size, coalesce(sum(size) OVER (PARTITION BY k ORDER BY m, doc_id NULLS FIRST, size, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM ordered),
pieces AS (SELECT *, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS blk FROM placed WHERE size > 0),
once AS (
  SELECT p.k, p.start, p.doc_id, p.size, sum(greatest(0, least(q.part, least(256, p.start + p.size - p.blk * 256)) - greatest(0, p.start - p.blk * 256)))::BIGINT AS n
  FROM pieces p JOIN parts q USING (k, blk) GROUP BY ALL)
SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN s.size = 0 THEN 0 ELSE (floor(t.target)::BIGINT // t.source_size) * s.size + o.n END::BIGINT AS taken
FROM placed s JOIN targets t USING (k) LEFT JOIN once o ON o.k = s.k AND o.start = s.start AND o.size = s.size AND o.doc_id IS NOT DISTINCT FROM s.doc_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_token_planes": op2_token_planes,
        "op3_embeddings": op3_embeddings,
        "op4_quality": op4_quality,
        "op5_decontamination": op5_decontamination,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_simhash": op7_simhash,
        "op8_personal_data": op8_personal_data,
        "op9_mixing": op9_mixing,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": OP3_SQL, "op9_mixing": OP9_SQL}

"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, language, licences, media, mixing, sentencepieces, sharding, simhash, suffixes

SHARDS = 24
#: Where the public tokenizer model is; read on the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A conversation that holds the format's control strings.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    profiles = language.fit(docs.where(~apart), "doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", apart.alias("held_out"), "text"), "text", profiles)


def op2_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash.near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign(sharding.assign(rows, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    out = sharding.with_slots(placed, "doc_id", ["size", "text_crc32"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = licences.scan(docs, "text", licences.fit(docs, "doc_id", "text"))
    sure = F.filter("findings", lambda f: f["confirmed"])
    families = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda f: f["family"]))), ",")
    return found.select(
        "doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        families(sure).alias("families"), families(F.filter("findings", lambda f: ~f["confirmed"])).alias("unconfirmed"), F.array_max(F.transform("findings", lambda f: f["probability"])).alias("probability"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mapping = chat.select_mapping(rows.schema)
    rows = rows.select(*mapping.paths())
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(EXTRA_TEXT))
    out = chat.format_rows(rows.unionAll(extra), mapping)
    turns = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text)
    + 2 * length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')) - length(replace(role || text, '>', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, "doc_id", "source", mixing.word_count(F.col("text")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    made = media.with_media(rows, "text")
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )


def op8_transducer_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = sentencepieces.load(model)
    read = sentencepieces.decode(sentencepieces.encode(docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), "text", machine), "ids", machine)
    back = F.sha2("text", 256)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.length("text").cast("long").alias("decoded_chars"), back.alias("decoded_sha256"), (back == F.col("text_sha256")).alias("round_trip"))


def op9_kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def op10_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = suffixes.remove_repeats(docs, "doc_id", "text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rank_order_language": op1_rank_order_language,
    "op2_gray_simhash": op2_gray_simhash,
    "op3_rendezvous_sharding": op3_rendezvous_sharding,
    "op4_licence_classifier": op4_licence_classifier,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_png_media": op7_png_media,
    "op8_transducer_pieces": op8_transducer_pieces,
    "op9_kmeans_embeddings": op9_kmeans_embeddings,
    "op10_induced_suffixes": op10_induced_suffixes,
}
ORACLE_SQL: dict[str, str] = {"op5_chat_formatting": OP5_SQL}

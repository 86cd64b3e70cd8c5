"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.llm import (
    chat, fingerprint, hard_negatives, html_extract, line_dedup, lm, minhash, packing, quality, sentencepiece_codec,
    simhash, warc, whitening,
)
from wiresift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def word_tokenizer() -> str:
    """Where the public word-level BPE file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query()
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(line_dedup.ORACLE)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_dropped")


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", "statistics.n_words", "statistics.word_chars", "statistics.n_symbols",
        "statistics.n_dup_lines", "statistics.n_repeat_words", "base_failed", "kept")


@query()
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LENGTH = "length(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<|turn|>', '<\\|turn|>'), " \
    "'</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'))"


@query(f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + {_LENGTH.format("role")} + length(role) - length(replace(role, chr(10), '')) + 1
    + {_LENGTH.format("text")} + 5) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


@query()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(
        sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), model, decode=True))


@query()
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query(hard_negatives.ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.shifted_labels(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))

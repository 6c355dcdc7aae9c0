"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix

    _, chosen = mix(_table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.chat import digests, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = digests(format_conversations(turns.unionByName(probe)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS et,
  replace(replace(replace(replace(replace(role, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS er,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN before IS NULL OR before <> role THEN 22 + length(er) ELSE 3 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from weft.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), path or tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_lattice_score(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from weft.llm.lattice import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), path or tokenizer_path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import fit, judge, measure

    measured = measure(_table(spark, sf_dir, "documents"))
    return judge(measured, fit(measured, _table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.warc import read_bundles, write_bundles

    return read_bundles(write_bundles(_table(spark, sf_dir, "pages")))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.linededup import report

    return report(_table(spark, sf_dir, "documents"))


def _base32(hex40: str) -> str:
    """SQL for the base-32 text of a 40-digit hex string: five digits make four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    out = []
    for k in range(8):
        v = f"('0x' || substr({hex40}, {5 * k + 1}, 5))::INT"
        out += [f"substr({letters}, ({v} // {32**p}) % 32 + 1, 1)" for p in (3, 2, 1, 0)]
    return " || ".join(out)


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_shard": op3_shard,
    "op4_pack": op4_pack,
    "op5_lattice_score": op5_lattice_score,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
}

SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op8_warc": OP8_SQL}

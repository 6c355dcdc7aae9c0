"""A corpus pipeline: rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and hands it to the next stage. All stages
but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty table; extra
columns go along whatever their names; rows with a null doc_id or a doc_id that
occurs several times are documents of their own. Null and empty texts and texts
without a word fail the quality rules; handed to a later stage, line dedup and
near-dedup keep them, mixing takes none of them and packing gives an end token
alone. Equal rows: the rules treat them alike, line dedup takes the lines of
all but the first, near-dedup keeps one, mixing draws for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import linededup, minhash, mixing, packing, quality
from weft.llm.common import durable, numbered, release
from weft.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; calibrated on the table ``labels``."""
    rules = quality.fit(quality.measure(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_documents(docs, rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line of the corpus matches."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the first by doc_id."""
    rows = numbered(docs)
    found = minhash.near_duplicates(rows.select(F.col("__node").alias("doc_id"), "text"))
    gone = durable(found.filter("not kept").select(F.col("doc_id").alias("__gone")))
    return rows.join(gone, F.col("__node") == F.col("__gone"), "left_anti").drop("__node")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No SQL: the forest, hashed ranks and packing patterns aren't expressible; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        release(spark, [before] if k else [])
    return docs

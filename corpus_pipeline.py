"""The corpus pipeline: five stages, each an operator of ``tessera.llm`` with its production parameters.

Every function takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, quality, shards
from tessera.llm.store import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality.judge(docs).where(f"{quality.prefix(docs.columns)}kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Of rows that repeat an id one stays for each text (its words, A-Z as a-z). Rows without an id have no near
    copies; one stays of each text that no row with an id has. Texts without words are copies only under one id."""
    kept = neardup.near_duplicates(docs, k=5).where("kept and doc_id is not null").select(F.col("doc_id").alias("_n_kept")).distinct()
    rows, unnamed = docs.join(kept, docs["doc_id"] == kept["_n_kept"], "left_semi"), docs.where("doc_id is null")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_n_id"))
    words = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+", " ")
    text = F.sha2(F.trim(words), 256).alias("_n_text")
    one = lambda table: table.groupBy("doc_id", text).agg(F.min(F.struct(*docs.columns)).alias("_n_row"))
    out = rows
    if not several.isEmpty():
        again = rows["doc_id"] == several["_n_id"]
        out = rows.join(several, again, "left_anti").unionByName(one(rows.join(several, again, "left_semi")).select("_n_row.*"))
    if not unnamed.isEmpty():
        wordless = F.trim(words) == ""
        named = docs.where("doc_id is not null").select(text).distinct()
        out = out.unionByName(one(unnamed.where(~wordless)).join(named, "_n_text", "left_anti").select("_n_row.*")).unionByName(unnamed.where(wordless))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.mark(docs, benchmark).where(F.size(decontam.hits_name(docs.columns)) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, parts of a pass counted as one; names keep clear of the mix's own."""
    named = docs.select(*[F.col(c).alias(f"_m_{c}") for c in docs.columns])
    others = [c for c in named.columns if c != "_m_doc_id"]
    mixed = mixing.mix(named, key="_m_doc_id", text="_m_text", source="_m_source", carry=others).where("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.try_divide("taken", "size")).cast("int"))
    return mixed.withColumn("_copy", F.explode(copies)).select(*[F.col(f"_m_{c}").alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its place in it."""
    return shards.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Series out of the driver's tables: one row per entity with an ordered array of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, series ``w`` (12 values) and ``d`` (the next 16), the class ``tgt`` in 0..3 and ``label``."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(e, 1, 12).alias("w"), F.slice(e, 13, 16).alias("d"), F.slice(e, 29, 8).alias("latent"), (F.col("label") % 4).cast("int").alias("tgt"), "label")


def collected_series(df: DataFrame, entity: str, order: list[str], value: str, n: int | None = None, least: int = 1) -> DataFrame:
    """``entity`` and its values ``a`` in order (the first ``n``), of entities with ``least`` values or more."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))), lambda s: s["__v"])
    out = df.groupBy(entity).agg(ordered.alias("a")).where(F.size("a") >= least)
    return out.withColumn("a", F.slice("a", 1, n)) if n else out


def event_series(spark: SparkSession, sf_dir: str, n: int | None = 12) -> DataFrame:
    """The first ``n`` values of users that have so many; whole series of all users for ``n`` of None."""
    return collected_series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", n, n or 1)


def order_series(spark: SparkSession, sf_dir: str, least: int = 12) -> DataFrame:
    return collected_series(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", None, least)


def student_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of the shape that feature builders take, out of embeddings: packed series, eight latent
    scores, task counters, a class identifier, an order in 0..1, a test score and the label."""
    x = lambda i: F.get("latent", F.lit(i))
    names = ("motivation", "discipline", "distance", "activities", "attendance", "literacy", "siblings", "interest")
    given = F.pmod(F.col("vec_id"), F.lit(7)) + 3
    return embedding_series(spark, sf_dir).select(
        F.col("vec_id").alias("id"), "w", "d", *[x(i).alias(n) for i, n in enumerate(names)], F.pmod(F.col("vec_id") * 5, given + 1).alias("done"), given.alias("given"),
        F.pmod(F.col("vec_id") * 37, F.lit(101)).alias("room"), (F.pmod(F.col("vec_id") * 17, F.lit(100)) / 100).alias("exam_order"), (F.aggregate("w", F.lit(0.0), lambda s, v: s + v) * 10 + 50).alias("tryout"), F.col("tgt").alias("target"),
    )

"""Readers, validated sinks, score caches and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema its types are inferred by reading it twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest id."""
    return df.orderBy(id_col).limit(n)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects; a missing or null ``text`` is empty."""
    pages = spark.read.option("multiLine", True).json(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in pages.columns else F.lit("")
    return pages.withColumn("text", text)


def read_config(path: str, defaults: dict) -> dict:
    """Settings of a JSON file over ``defaults``; the defaults if it isn't there."""
    try:
        with open(path) as f:
            return defaults | json.load(f)
    except FileNotFoundError:
        return dict(defaults)


def read_queue(spark: SparkSession, path: str, field: str = "experiments", priority: str | None = None) -> DataFrame:
    """Entries of a JSON work queue, of one priority if asked."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("e")).select("e.*")
    return rows.where(F.col("priority") == priority) if priority else rows


def queue_entry(queue: DataFrame, entry_id: str) -> DataFrame:
    return queue.where(F.col("id") == entry_id)


def check_predictions(df: DataFrame, expected_ids: DataFrame, id_col: str = "id", label: str = "target", labels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """``df`` if it has just these two columns, the expected ids and known labels; raises otherwise."""
    if df.columns != [id_col, label]:
        raise ValueError(f"columns are {df.columns}, not {[id_col, label]}")
    wanted = expected_ids.select(F.col(id_col).cast(df.schema[id_col].dataType))
    got = df.select(id_col)
    if not got.exceptAll(wanted).isEmpty() or not wanted.exceptAll(got).isEmpty():
        raise ValueError(f"the values of {id_col} aren't those expected")
    if not df.where(F.col(label).isNull() | ~F.col(label).isin(*labels)).isEmpty():
        raise ValueError(f"{label} has values other than {list(labels)}")
    return df


def contract_report(df: DataFrame, expected_ids: DataFrame, id_col: str, label: str, labels: Sequence[int]) -> DataFrame:
    """The same checks as one row of counts: rows, unexpected ids, missing ids, unknown labels."""
    got = df.select(F.col(id_col).alias("id"), F.lit(1).alias("g"), F.lit(0).alias("w"), (F.col(label).isNull() | ~F.col(label).isin(*labels)).cast("int").alias("bad"))
    wanted = expected_ids.select(F.col(id_col).alias("id"), F.lit(0).alias("g"), F.lit(1).alias("w"), F.lit(0).alias("bad"))
    per_id = got.unionByName(wanted).groupBy("id").agg(F.sum("g").alias("g"), F.sum("w").alias("w"), F.sum("bad").alias("bad"))
    over = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0)).cast("long")
    return per_id.agg(F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("n_rows"), over("g", "w").alias("unexpected"), over("w", "g").alias("missing"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad_labels"))


def read_predictions(spark: SparkSession, path: str, expected_ids: DataFrame, id_col: str = "id", label: str = "target", labels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    return check_predictions(read_csv(spark, path, f"{id_col} long, {label} int"), expected_ids, id_col, label, labels)


def write_predictions(df: DataFrame, path: str, expected_ids: DataFrame, id_col: str = "id", label: str = "target", labels: Sequence[int] = (0, 1, 2, 3)) -> None:
    """One CSV part in order of ids, after the checks."""
    check_predictions(df, expected_ids, id_col, label, labels).orderBy(id_col).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cached_scores(spark: SparkSession, path: str, seeds: Sequence[int], compute) -> DataFrame:
    """Scores (``seed``, id, score) kept at ``path`` if their seeds are those asked for, else computed and kept."""
    from pyspark.errors import AnalysisException

    try:
        kept = spark.read.parquet(path)
        if {r[0] for r in kept.select("seed").distinct().collect()} == set(seeds):
            return kept
    except AnalysisException:
        pass
    compute(seeds).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_metrics(path: str, metrics: dict) -> None:
    with open(path, "w") as f:
        json.dump(metrics, f, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, limit: int = 20, digits: int = 4) -> str:
    """The first rows as a Markdown table; reports are small by intent."""
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(limit).collect()])


def write_report(path: str, title: str, sections: dict[str, DataFrame | str], limit: int = 20) -> None:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body, limit)]
    with open(path, "w") as f:
        f.write("\n\n".join(parts) + "\n")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of even bins between least and largest: what a bar plot shows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (float(high) - float(low)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.lit(float(low)) + F.col("bin") * width).alias("low"), (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("high"), "n")


def interpret(best_raw: float, best_pattern: float, overlap: int, low: float = 0.40, high: float = 0.55) -> list[str]:
    """Sentences for an audit report, by rule."""
    out = ["Rows of the two splits overlap." if overlap else "No obvious row overlap between the splits."]
    if best_pattern >= high:
        out.append("Identifiers alone predict the label: treat as leakage.")
    elif best_pattern >= low:
        out.append("Identifiers carry some signal: look closer.")
    else:
        out.append("No obvious signal in identifiers.")
    out.append("Raw features predict the label well." if best_raw >= high else "Raw features predict the label moderately." if best_raw >= low else "Raw features predict the label weakly.")
    return out

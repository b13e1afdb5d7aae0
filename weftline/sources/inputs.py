"""Workflow inputs: iteration counts, inline JSON, JSON files, text files and tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_value(spark: SparkSession, value) -> DataFrame:
    """An int gives that many empty calls, 0-based; a list one row for each dict."""
    if isinstance(value, int):
        return spark.range(value).withColumnRenamed("id", "iteration")
    if not value:
        return spark.range(0).withColumnRenamed("id", "iteration")
    names = list(dict.fromkeys(k for row in value for k in row))
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in value], 1)).select(*names)


def resolve(spark: SparkSession, graph, file: str | None = None, data: str | None = None, iterations: int | None = None) -> dict:
    """Inputs by node name; a file goes before inline data, and that before a count for all roots."""
    if file:
        given = json.loads(Path(file).read_text())
    elif data:
        given = json.loads(data)
    else:
        flat = graph.flatten()
        roots = [n for n in flat.nodes if n.inputs and not any(e.target is n for e in flat.edges)]
        given = {n.name: iterations if iterations is not None else 1 for n in roots}
    return {k: from_value(spark, v) for k, v in given.items()}


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def integers(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers between blanks of a text file; other words are dropped."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w"))
    return words.select(F.col("w").try_cast("bigint").alias("v")).where("v is not null")


def write_integers(df: DataFrame, column: str, path: str) -> None:
    """Numbers of each partition on one line, between blanks."""
    df.groupBy(F.spark_partition_id().alias("p")).agg(F.array_join(F.collect_list(F.col(column).cast("string")), " ").alias("value")).select("value").write.mode("overwrite").text(path)

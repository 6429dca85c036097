"""Trace readers. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_parquet_trace(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_csv_bz2_trace(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, bzip2-compressed or plain; bzip2 files are split among tasks."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("enforceSchema", False).csv(path))

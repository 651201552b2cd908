"""A1-A4: delimited text with a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    sep: str = "\t",
    encoding: str = "UTF-8",
    header: bool = True,
) -> DataFrame:
    """A1/A3/A4: one pass over the files, no schema inference."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("encoding", encoding)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_parts(
    spark: SparkSession, paths: Sequence[str], schema: StructType | str, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """A2: several files of one schema as one table."""
    return read_delimited(spark, list(paths), schema, sep, encoding)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", encoding: str = "UTF-8") -> str:
    """Text form of a table, header in every part file."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("encoding", encoding).csv(path)
    return path

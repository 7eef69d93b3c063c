"""Benchmark reports: one line per image, one column per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(h: int, w: int, seconds: float) -> float:
    """Source megabytes a second, three bytes a pixel."""
    return h * w * 3 / (seconds * 1e6)


def pivoted(measures: DataFrame, operators: list[str] | None = None) -> DataFrame:
    """(image, operator, value) as a table of images by operators."""
    return measures.groupBy("image").pivot("operator", operators).agg(F.first("value"))


def write_report(measures: DataFrame, path: str, operators: list[str] | None = None) -> None:
    pivoted(measures, operators).write.mode("overwrite").option("header", True).csv(path)

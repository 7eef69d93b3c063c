"""Key files: one line per key, idx:idy:oct:step:angle:scale:d0:...:dn: with six decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decimals(x: Column) -> Column:
    """x with six decimals as C's %.6f writes it: the exact value is rounded, ties to even.

    Spark's format_string rounds the shortest digits that stand for x, ties away from zero: 0.0078125 as 0.007813.
    format_number heeds the exact value as long as those digits reach beyond the sixth decimal; of larger numbers it gets
    the part after the point alone. The digits from 2^62 on are those of format_string.
    """
    six = lambda y: F.call_function("format_number", y, F.lit("0.000000"))
    size, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    whole = F.floor(size)
    part = six(size - whole)  # 1.000000 at most
    large = F.concat(sign, (whole + F.substring(part, 1, 1).cast("long")).cast("string"), F.substring(part, 2, 7))
    return F.when(size < 2.0**30, six(x)).when(size < 2.0**62, large).when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.format_string("%.6f", x))


def lines(keys: DataFrame) -> DataFrame:
    """Keys as text lines (column value); an unknown angle or scale is written as 0."""
    six = lambda x: decimals(F.coalesce(x, F.lit(0.0)))
    head = [F.col(c).cast("string") for c in ("idx", "idy", "oct", "step")]
    return keys.select(F.concat(F.concat_ws(":", *head, six(F.col("angle")), six(F.col("scale")), F.array_join(F.transform("descriptors", six), ":")), F.lit(":")).alias("value"))


def parsed(text: DataFrame) -> DataFrame:
    """Keys of lines (column value); lines with fewer than six fields are left out."""
    parts = text.select(F.filter(F.split("value", ":"), lambda x: x != "").alias("p")).where(F.size("p") >= 6)
    at = lambda k, kind, name: F.element_at("p", k).cast(kind).alias(name)
    rest = F.transform(F.slice("p", F.lit(7), F.size("p") - 6), lambda x: x.cast("double"))
    return parts.select(at(1, "int", "idx"), at(2, "int", "idy"), at(3, "int", "oct"), at(4, "int", "step"), at(5, "double", "angle"), at(6, "double", "scale"), rest.alias("descriptors"))


def write_keys(keys: DataFrame, path: str) -> None:
    lines(keys).write.mode("overwrite").text(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))

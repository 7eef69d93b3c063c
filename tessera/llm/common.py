"""Small helpers that the text operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stored

__all__ = ["HotTexts", "Memo", "SLICE", "boxed", "code_points", "hashed_text", "held_out", "mix64", "partitions", "slices", "stored", "table"]

SLICE = 1 << 20  # characters of a text that are worked on at once, which bounds the memory that a long one takes
SPACE = re.compile(r"\s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one struct column `row`, so that no column of theirs can clash with an operator's, beside copies of `columns`."""
    return docs.select(F.struct("*").alias("row"), *columns)


def hashed_text() -> tuple:
    """_h1, _h2: 128 bits that stand for the column `text`."""
    return F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2")


class HotTexts:
    """Joins on a text's hashes (_h1, _h2) in which the rows of a text with many copies are dealt over several tasks.

    `counted` has the hashes and _n, the rows of each text. Hot are texts of more than `most` rows, which is a 10,000th
    of all or more, so there are at most 10,000 of them, whatever the input, and they are broadcast.
    """

    def __init__(self, counted: DataFrame, rows: int, most: int = 1_000):
        most = max(most, -(-rows // 10_000))
        hot = counted.where(F.col("_n") > most).select("_h1", "_h2", F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
        self.hot = stored(hot, "hot")

    def _salted(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.hot), ["_h1", "_h2"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    def join(self, rows: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
        """rows joined with texts on _h1 and _h2; rows come from a scan, so that a row's place is the same when a task runs again."""
        dealt = self._salted(rows).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts"))).drop("_salts")
        repeated = self._salted(texts).withColumn("_salt", F.explode(F.expr("sequence(0L, _salts - 1L)"))).drop("_salts")
        return dealt.join(repeated, ["_h1", "_h2", "_salt"], how).drop("_salt")


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents that is kept for testing; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE characters, cut before white space so that no word is."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Memo(dict):
    """token -> 64-bit hash (as int), remembered; emptied when it grows beyond `most` entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def hashed(self, token: str) -> int:
        """The token's hash, when it is not remembered."""
        if len(self) >= self.most:
            self.clear()
        return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))

    def __missing__(self, token: str) -> int:
        value = self[token] = self.hashed(token)
        return value

"""Harmonic packing of documents into token sequences of a fixed capacity.

A piece of length L belongs to the class k = capacity div L, of which k pieces fit a sequence. Every sequence of class k is
given exactly k pieces. Each worker (a partition of the tokenised documents) fills the sequences of its classes by itself;
the fewer than k pieces a class that remain of each worker are numbered over all workers and filled in the same way; what then
remains (fewer than k pieces a class, so less than one sequence's tokens for each of some 90 classes, whatever the input)
is put together by first fit, long pieces first.

Where k pieces of a remainder would leave more than `slack` of their sequence empty, capacity div (k + 1) tokens are cut off, which
fill their class (almost) exactly, and the rest is judged again: full sequences first, then seldom more than three pieces.

Cuts depend on the document alone. Defined cases: a null or empty text is the end id alone; repeated rows are packed each by
itself; without rows there are no pieces; sequence ids are unique but not gapless; other columns are left out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tessera.llm.common import stored


@dataclass(frozen=True)
class Settings:
    vocabulary: str  # a tokenizer file of the `tokenizers` library
    ranks: str | None = None  # the same vocabulary as ranks, with `pattern`: gives the same ids several times as fast
    pattern: str | None = None
    capacity: int = 2048
    slack: float = 0.01
    end: int = 1


def public(**changes) -> Settings:
    """Settings with the byte-level vocabulary of the public_tokenizers package."""
    import public_tokenizers

    return Settings(**{"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN} | changes)


@lru_cache(maxsize=2)
def _encoder(settings: Settings):
    """A function from a text to its ids. Texts that hold a special token's string, which the vocabulary reads as that token, go the slow way."""
    slow = Tokenizer.from_file(settings.vocabulary)
    whole = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    if settings.ranks is None:
        return whole
    with open(settings.ranks, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=settings.pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda text: whole(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), "<u4")


def lengths(n: int, capacity: int, slack: float) -> list[int]:
    """The lengths of the pieces that n tokens are cut into."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        part = rest if capacity - k * rest <= slack * capacity else capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


def pieces(docs: DataFrame, settings: Settings, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and (with_ids) ids of every piece of every document."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(settings)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)}
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids = np.append(encode(text or ""), np.array([settings.end], "<u4")).astype("<u4")
                start = 0
                for length in lengths(len(ids), settings.capacity, settings.slack):
                    part = ids[start : start + length]
                    for c, value in zip(rows, (None if pd.isna(doc_id) else doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32))):
                        rows[c].append(value)
                    start += length
            yield pd.DataFrame({c: pd.array(v, "Int64") if c == "doc_id" and doc_type in ("bigint", "int") else v for c, v in rows.items()})

    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


SECOND, LAST = 1 << 62, 3 << 61  # bits of sequence ids


def _running(over: Window, order: str):
    return F.coalesce(F.sum("length").over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset")


def placed(found: DataFrame, capacity: int) -> DataFrame:
    """Pieces (column length, at most capacity) with sequence_id and offset."""
    columns = found.columns
    found = stored(found.select("*", F.expr(f"{capacity} div length").alias("_k"), F.spark_partition_id().cast("long").alias("_worker")), "pieces")
    own = Window.partitionBy("_worker", "_k")
    ranked = found.select("*", (F.row_number().over(own.orderBy("doc_id", "start", "ids_crc32")) - 1).cast("long").alias("_r"), F.count("*").over(own).alias("_n"))
    ranked = ranked.withColumn("_bin", F.expr("_r div _k"))
    full = ranked.where("_r < _n - _n % _k")
    first = full.select(*columns, F.expr("(_worker << 40) | (_k << 28) | _bin").alias("sequence_id"), _running(Window.partitionBy("_worker", "_k", "_bin"), "_r"))

    rest = stored(ranked.where("_r >= _n - _n % _k").select(*columns, "_k", "_worker", F.expr("_r - (_n - _n % _k)").alias("_r")), "rest")
    sizes = rest.groupBy("_worker", "_k").agg(F.count("*").alias("_m"))  # a row a worker and class
    every = Window.partitionBy("_k")
    sizes = sizes.select("_worker", "_k", F.coalesce(F.sum("_m").over(every.orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_m").over(every).alias("_n"))
    again = rest.join(sizes, ["_worker", "_k"]).withColumn("_r", F.col("_r") + F.col("_base")).withColumn("_bin", F.expr("_r div _k"))
    second = again.where("_r < _n - _n % _k").select(*columns, F.expr(f"{SECOND}L | (_k << 40) | _bin").alias("sequence_id"), _running(Window.partitionBy("_k", "_bin"), "_r"))

    def fit(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        used, at, offset = [], [], []
        for length in left["length"]:
            k = next((i for i, u in enumerate(used) if u + length <= capacity), len(used))
            if k == len(used):
                used.append(0)
            at.append(LAST + k)
            offset.append(used[k])
            used[k] += length
        return left.assign(sequence_id=at, offset=offset)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*columns).schema) + ", sequence_id long, offset long"
    last = again.where("_r >= _n - _n % _k").select(*columns, F.lit(0).alias("_one")).groupBy("_one").applyInPandas(fit, schema)  # fewer than k pieces a class
    return first.unionByName(second).unionByName(last)


def pack(docs: DataFrame, settings: Settings, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    return placed(pieces(docs, settings, with_ids), settings.capacity)


def sequences(packed: DataFrame, capacity: int, padding: int = 0) -> DataFrame:
    """sequence_id, ids, tokens: the packed ids side by side, padded to the capacity unless they are a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("_ids"))
    n = F.size("_ids")
    bare = F.bit_count(n) == 1
    return rows.select("sequence_id", F.when(bare, F.col("_ids")).otherwise(F.concat("_ids", F.array_repeat(F.lit(padding), capacity - n))).alias("ids"), n.alias("tokens"))

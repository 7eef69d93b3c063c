"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven code points sets the boundaries; each piece between them gives one of 64 signs. The
block size is the power-of-two multiple of three under which a text has about 64 pieces; a fingerprint is
`block:signs:signs` with the signs at the block size and at twice it. A signature has at most LONGEST signs: the
last one hashes all the rest of the text, so whole texts count. Texts are read in slices, so a long one takes little
more memory than itself. Fingerprints are compared by edit distance where
their block sizes are equal or a factor of two apart, else their likeness is 0.

Defined cases: a null text is empty; the empty text has the fingerprint `3::`, equal ones have likeness 1;
with a single document it is its own next; a null doc_id comes first; rows that repeat doc_id and text count once
as the next document and each get a row; several texts under one doc_id are ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common
from tessera.llm.common import code_points, mix64, partitions, stored

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SMALLEST, WIDE, LONGEST = 3, 7, 128
BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _hashed(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the text: hashes of its code points, and the rolling hash that ends at each of them."""
    for at in range(0, len(text), common.SLICE):
        before = min(at, WIDE - 1)
        values = mix64(code_points(text[at - before : at + common.SLICE]).astype(np.uint64) + np.uint64(1))
        rolled = values.copy()
        for k in range(1, min(WIDE, len(values))):
            rolled[k:] += values[:-k] << np.uint64(5 * k)
        yield values[before:], mix64(rolled[before:])


def _signature(parts: Iterable[tuple[np.ndarray, np.ndarray]], block: int) -> str:
    """One sign per piece; pieces end where the rolling hash triggers, and the last one goes to the end."""
    done: list[int] = []
    held = length = 0  # hash and length of the piece that the next slice goes on with
    for values, rolled in parts:
        ends = np.flatnonzero(rolled % np.uint64(block) == block - 1)[: LONGEST - 1 - len(done)] + 1
        starts = np.concatenate([[0], ends[ends < len(values)]])
        lengths = np.diff(np.append(starts, len(values)))
        offset = np.arange(len(values)) - np.repeat(starts, lengths)
        longest = 1 << int(lengths.max()).bit_length()
        pieces = np.add.reduceat(values * _powers(longest)[offset], starts).tolist()
        pieces[0] = pieces[0] * pow(BASE, length, 1 << 64) + held & (1 << 64) - 1
        length = int(lengths[-1]) + (length if len(pieces) == 1 else 0)
        held = pieces.pop()
        done += pieces
        if len(ends) and ends[-1] == len(values):
            done.append(held)
            held = length = 0
    if length:
        done.append(held)
    return "".join(SIGNS[k] for k in (mix64(np.array(done, np.uint64)) >> np.uint64(58)).tolist())


def fingerprint(text: str) -> str:
    if not text:
        return f"{SMALLEST}::"
    short = list(_hashed(text)) if len(text) <= common.SLICE else None  # a longer text is hashed anew for each block size
    block = SMALLEST
    while block * 64 < len(text):
        block *= 2
    signs = _signature(short or _hashed(text), block)
    while len(signs) < 32 and block > SMALLEST:
        block //= 2
        signs = _signature(short or _hashed(text), block)
    return f"{block}:{signs}:{_signature(short or _hashed(text), 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel: one column of the table is held in two integers."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for ch in b:
        match = at.get(ch, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, diagonal & up
        distance += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | 1) & full
        up, down = (right_down << 1 | ~(diagonal | right_up)) & full, right_up & diagonal
    return distance


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where the block sizes are not compatible."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = (x.split(":") for x in (a, b))
    pairs = {int(n) == int(m): [(a1, b1), (a2, b2)], int(n) == 2 * int(m): [(a1, b2)], 2 * int(n) == int(m): [(a2, b1)]}.get(True, [])
    return max((1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in pairs if x or y), default=0.0)


def _likenesses(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float)


def likeness_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(_likenesses, "double")(a, b)


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t or "") for t in texts], dtype=object)


def fingerprint_of(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "string")(text)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def _compared(doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
    """A row of RESULT, from the text and the next document's, and the fingerprints of both."""
    e = edited(text, following)
    of_edited = fingerprint(e)
    digest = hashlib.sha256()
    for at in range(0, len(e), common.SLICE):
        digest.update(e[at : at + common.SLICE].encode("utf-8", "surrogatepass"))
    return doc_id, len(text), digest.hexdigest(), own, of_edited, likeness(own, of_edited), likeness(own, next_own)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a range in order: each document is compared with the next one; the first and the last come out as they are, for the ranges beside."""
    held: tuple | None = None  # key, hash, doc_id, text, fingerprint, copies
    part = -1
    for b in batches:
        out = []
        for part, key, mark, doc_id, text in zip(b["_range"], b["_key"], b["_hash"], b["doc_id"], b["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            if held is not None and held[:2] == (key, mark):
                held = (*held[:5], held[5] + 1)
                continue
            own = fingerprint(text)
            if held is None:
                out.append((part, "first", 1, *[None] * len(COLUMNS), text))
            else:
                out.append((part, "done", held[5], *_compared(*held[2:5], text, own), None))
            held = (key, mark, doc_id, text, own, 1)
        yield _frame(out)
    if held is not None:
        yield _frame([(part, "last", held[5], held[2], *[None] * (len(COLUMNS) - 1), held[3])])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_range", "role", "copies", *COLUMNS, "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [_compared(None if pd.isna(i) else int(i), t, fingerprint(t), n, fingerprint(n)) for i, t, n in zip(b["doc_id"], b["text"], b["following"])]
        yield pd.DataFrame([(c, *r) for c, r in zip(b["copies"], rows)], columns=["copies", *COLUMNS]).astype({"doc_id": "Int64"})


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness with it and with the next document's.

    Texts move once, into ranges of the order, and are compared while a range is read; what is left is the last
    document of each range and the first one of the next.
    """
    spark = docs.sparkSession
    order = ["_key", "_hash"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_key"), F.xxhash64("text").alias("_hash"))
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    walked = stored(dealt.mapInPandas(_walk, f"_range int, role string, copies long, {RESULT}, text string"), "walked")
    over = Window.orderBy("_range")
    first = walked.where("role = 'first'").select("_range", F.col("text").alias("following"))
    links = first.select("_range", F.coalesce(F.lead("_range").over(over), F.first("_range").over(over)).alias("_next"))  # a row per range
    last = walked.where("role = 'last'").select("_range", "copies", "doc_id", "text").join(links, "_range").drop("_range")
    ends = last.join(first.withColumnRenamed("_range", "_next"), "_next").select("copies", "doc_id", "text", "following").mapInPandas(_joined, f"copies long, {RESULT}")
    every = walked.where("role = 'done'").select("copies", *COLUMNS).unionByName(ends)
    return every.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)

"""Removal of repeated passages by level-wise doubling.

A window is a run of words of one document. Windows of `first` words are looked at first; only where two that touch
both occur more than once can the window of twice their length do so, and so on up to `window` words, or until no
candidate survives. Every word that is covered by a window of that length whose words also start earlier (in a document
of smaller id, or earlier in the same one) is removed; windows are judged on the input.

Documents are packed into chunks (written once); a chunk sends the distinct hashes of its windows to
buckets of the hash, and each bucket answers every chunk with one bit per hash. The levels before the last one need
only know which hashes occur in several chunks (32 bits within a bucket, a false hit adds a candidate and is found out
later); the last compares 128 bits and the place. So a passage that is in every document costs one hash per chunk, and
no bucket is larger than its share of the distinct hashes of chunks.

Defined cases: null texts have no words; documents of fewer words than a window lose nothing; rows that
repeat a doc_id count as one document after the other in an order that is fixed for the run; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, stored

LOWEST = -(1 << 63)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x5851F42D4C957F2D
AT_ONCE = 1 << 17  # words of a chunk that are hashed at once, which bounds the memory that a long text takes


@dataclass(frozen=True)
class Settings:
    window: int = 20
    first: int = 10
    chunk_bytes: int = 1_500_000
    per_bucket: int = 400_000  # windows, about


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _both(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, at least n of them."""
    n = 1 << max(16, int(n).bit_length())
    return _powers(n, base), _powers(n, pow(base, -1, 1 << 64))


@lru_cache(maxsize=2)
def _letters() -> np.ndarray:
    out = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[SPACE] = 0
    return out


class Chunk:
    """Words of a chunk's documents: hashes, document number and place in the document."""

    def __init__(self, ids: bytes, lengths: bytes, blob: bytes):
        self.ids, sizes = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(blob)
        b = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum(sizes)
        space = SPACE[b]
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])[: len(b)])
        end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])[: len(b)]) + 1
        self.words = np.empty(len(begin), np.uint64)
        for at in range(0, len(begin), AT_ONCE):
            low, high = begin[at : at + AT_ONCE], end[at : at + AT_ONCE]
            part = b[low[0] : high[-1]]
            up, down = _both(len(part))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_letters()[part] * up[: len(part)])])
            self.words[at : at + AT_ONCE] = mix64((sums[high - low[0]] - sums[low - low[0]]) * down[low - low[0]])
        self.doc = np.searchsorted(self.ends, begin, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(self.ids)))
        self.place = np.arange(len(begin)) - self.first[self.doc] if len(begin) else np.zeros(0, np.int64)

    def texts(self) -> Iterator[bytes]:
        begin = 0
        for end in self.ends.tolist():
            yield self.data[begin:end]
            begin = end

    def windows(self, length: int, at: np.ndarray | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places (of all windows, or those of `at` that fit) and hashes of windows of `length` words."""
        n = len(self.words) - length + 1
        at = np.arange(max(n, 0)) if at is None else at[at < n]
        at = at[self.doc[at] == self.doc[at + length - 1]] if len(at) else at
        up, down = _both(len(self.words))
        values = mix64(self.words + np.uint64(salt)) if salt else self.words
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)])])
        return at, mix64((sums[at + length] - sums[at]) * down[at] + np.uint64(length))


def _pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of documents: number, ids, byte lengths, compressed texts, number of words (about)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []

        def row() -> pd.DataFrame:
            nonlocal count
            held.sort()
            texts = [t + b" " for _, t in held]
            blob = b"".join(texts)
            out = {"chunk": (part << 32) + count, "ids": np.array([i for i, _ in held], np.int64).tobytes(), "lengths": np.array([len(t) for t in texts], np.int64).tobytes(), "blob": zstandard.ZstdCompressor(level=3).compress(blob), "words": blob.count(b" ")}
            count += 1
            held.clear()
            return pd.DataFrame([out])

        size = 0
        for b in batches:
            for i, t in zip(b["_id"], b["text"]):
                data = t.encode("utf-8", "surrogatepass")
                held.append((i, data))
                size += len(data)
                if size >= settings.chunk_bytes:
                    yield row()
                    size = 0
        if held:
            yield row()

    rows = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(pack, "chunk long, ids binary, lengths binary, blob binary, words long")


def _grouped(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (first bits) of sorted hashes and where they lie."""
    numbers = (h >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(h)])
    for k, begin in enumerate(begins):
        yield int(numbers[begin]), slice(begin, begins[k + 1] if k + 1 < len(begins) else len(h))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Level:
    """A chunk's windows at one length before the last: places, and for each its entry among the distinct short hashes."""

    at: np.ndarray
    entry: np.ndarray
    distinct: np.ndarray  # sorted hashes cut to bucket and short part
    count: np.ndarray


def _level(c: Chunk, length: int, at: np.ndarray | None, bits: int) -> Level:
    at, h = c.windows(length, at)
    distinct, entry, count = np.unique(h & np.uint64((1 << 64) - (1 << (32 - bits))), return_inverse=True, return_counts=True)
    return Level(at, entry, distinct, count)


def _answered(distinct: np.ndarray, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(distinct), bool)
    for bucket, where in _grouped(distinct, bits):
        if bucket in answers:
            out[where] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8))[: where.stop - where.start].astype(bool)
    return out


def _candidates(c: Chunk, lengths: list[int], answers: list[dict[int, bytes]], bits: int) -> np.ndarray | None:
    """Places where a window of twice the last answered length may occur more than once; None before any answer."""
    at = None
    for length, given in zip(lengths, answers):
        level = _level(c, length, at, bits)
        repeated = (level.count > 1) | _answered(level.distinct, bits, given)
        hit = np.zeros(len(c.words) + 2 * length, bool)
        hit[level.at[repeated[level.entry]]] = True
        at = np.flatnonzero(hit[: len(c.words)] & hit[length : len(c.words) + length])
    return at


def _final(c: Chunk, length: int, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the last level in the order of their hashes, then place: places, both hashes, whether first of its kind in the chunk."""
    at, h1 = c.windows(length, at)
    _, h2 = c.windows(length, at, salt=0x3C6EF372FE94F82B)
    order = np.lexsort((at, h2, h1))
    at, h1, h2 = at[order], h1[order], h2[order]
    first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(at)]
    return at, h1, h2, first, np.flatnonzero(first)


def _answers(row: pd.Series) -> dict[int, bytes]:
    return {a["bucket"]: a["bits"] for a in row} if row is not None else {}


def _ask(chunks: DataFrame, lengths: list[int], k: int, bits: int) -> DataFrame:
    """What each chunk asks the buckets at level k, given the answers a0.. to the levels before."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                c = Chunk(row.ids, row.lengths, row.blob)
                at = _candidates(c, lengths, [_answers(getattr(row, f"a{i}")) for i in range(k)], bits)
                out = []
                if k < len(lengths) - 1:
                    distinct = _level(c, lengths[k], at, bits).distinct
                    short = _short(distinct, bits)
                    out = [(bucket, row.chunk, short[where].tobytes()) for bucket, where in _grouped(distinct, bits)]
                else:
                    at, h1, h2, _, first = _final(c, lengths[k], at)
                    at, h1, h2 = at[first], h1[first], h2[first]
                    ids, places = c.ids[c.doc[at]], c.place[at].astype(np.int64)
                    out = [(bucket, row.chunk, b"".join(x[where].tobytes() for x in (h1, h2, ids, places))) for bucket, where in _grouped(h1, bits)]
                yield pd.DataFrame(out, columns=["bucket", "chunk", "asked"])

    return chunks.mapInPandas(ask, "bucket int, chunk long, asked binary")


def _reply(asked: DataFrame, last: bool) -> DataFrame:
    """One bit per hash that was asked: whether it occurs in other chunks, or at the last level earlier in another one."""

    def several(b: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint32) for x in b["asked"]]
        every = np.concatenate(parts)
        ordered = np.sort(every)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        hit = twice[np.minimum(np.searchsorted(twice, every), len(twice) - 1)] == every if len(twice) else np.zeros(len(every), bool)
        return _bits(b, hit, [len(p) for p in parts])

    def earlier(b: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64).reshape(4, -1) for x in b["asked"]]
        h1, h2, ids, places = np.concatenate(parts, axis=1)
        chunk = np.repeat(b["chunk"].to_numpy(), [p.shape[1] for p in parts])
        order = np.lexsort((chunk, places, ids.view(np.int64), h2, h1))
        same = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
        hit = np.empty(len(order), bool)
        hit[order] = same
        return _bits(b, hit, [p.shape[1] for p in parts])

    def _bits(b: pd.DataFrame, hit: np.ndarray, sizes: list[int]) -> pd.DataFrame:
        ends = np.cumsum(sizes)
        rows = [(chunk, bucket, np.packbits(hit[end - n : end]).tobytes()) for chunk, bucket, n, end in zip(b["chunk"], b["bucket"], sizes, ends) if hit[end - n : end].any()]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "bits"])

    return asked.groupBy("bucket").applyInPandas(earlier if last else several, "chunk long, bucket int, bits binary")


def remove(docs: DataFrame, settings: Settings = Settings(), texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and with texts=True the kept words as `text`."""
    chunks = stored(_pack(docs, settings), "chunks")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    bits = max(8, int(words // settings.per_bucket).bit_length())
    lengths = [settings.first]
    while lengths[-1] < settings.window:
        lengths.append(min(2 * lengths[-1], settings.window))
    assert lengths[-1] == settings.window and all(b == 2 * a for a, b in zip(lengths, lengths[1:])), "window must be first times a power of two"
    asked_with = chunks
    for k in range(len(lengths)):
        answers = stored(_reply(_ask(asked_with, lengths, k, bits), k == len(lengths) - 1), f"answers{k}")
        per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"a{k}"))
        asked_with = asked_with.join(per_chunk, "chunk", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(lengths)
        for b in batches:
            for row in b.itertuples(index=False):
                c = Chunk(row.ids, row.lengths, row.blob)
                given = [_answers(getattr(row, f"a{i}")) for i in range(n)]
                at = _candidates(c, lengths[:-1], given[:-1], bits)
                at, h1, _, first, firsts = _final(c, settings.window, at)
                gone = ~first
                gone[firsts] = _answered(h1[firsts], bits, given[-1])
                change = np.zeros(len(c.words) + 1, np.int64)
                np.add.at(change, at[gone], 1)
                np.add.at(change, at[gone] + settings.window, -1)
                kept = np.cumsum(change)[:-1] == 0
                out = []
                for i, (doc, text) in enumerate(zip(c.ids.tolist(), c.texts())):
                    these = text.split()
                    mask = kept[c.first[i] : c.first[i] + len(these)]
                    left = b" ".join(these if mask.all() else list(compress(these, mask.tolist())))
                    out.append((None if doc == LOWEST else doc, len(these), int(len(these) - mask.sum()), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "surrogatepass")] if texts else [])))
                yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if texts else [])]).astype({"doc_id": "Int64"})

    return asked_with.mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)

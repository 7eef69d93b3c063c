"""Near duplicates by Order MinHash, verified by banded alignment.

k-mers are shingles of five words (the whole text if it has fewer), labelled with how often they occurred before.
Each of `sketches` orders takes the `minima` labelled k-mers that come first, and also the `few` that do, and keeps them in the
order of the text; equal sketches make candidates. Two texts are near duplicates if a sketch of theirs is equal and an alignment of
their words within a band matches a share of `similarity` of the words of both (twice the matched over all).

Classes are the connected components of the verified links between different texts. Candidates of a bucket are not
paired with each other but with one leader and with the next one by length; after the components of the verified links are
known, each bucket that still holds several components proposes links between members of them, for up to `rounds` rounds. Links
inside a component can't change it, so none are tried there. Texts that are equal are one node from the start.

For texts whose shingles agree (aligned, matched over matched and unmatched ones) to a share of `similarity`, what this leaves
open is finished exactly (`between`): members of buckets of `minima` that still hold several components are joined on the
prefixes of their shingles, rare ones first. Such a pair shares a shingle of both prefixes, so every one of two components
is verified. Texts of up to `short` shingles take part too, as few k-mers make sketches miss more: whole short
texts don't even share one with a text that is longer. Pairs whose words agree but fewer of their shingles do are found with the
chance that sketches of `few` give.

Defined cases: null texts and texts without words are near each other and nothing else; a candidate pair of exactly
`similarity` is linked; a document without near copies is a class of its own; class_id is the smallest doc_id of the
class, and so is the id of the document that stays, of equal ones that of the smallest text hash; rows that repeat
a doc_id with other texts are judged by their texts, and so are rows with a null doc_id; a class of such rows alone
gets a negative number; of rows with equal ids and texts distinct_documents keeps any one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import HotTexts, Memo, boxed, mix64, slices, stored


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    sketches: int = 32
    minima: int = 6
    few: int = 2
    short: int = 50  # shingles of texts that are compared exactly, whatever their sketches
    rounds: int = 3  # of cheap proposals per bucket, before the rest is finished exactly
    salt: int = 4096  # members of one prefix shingle that meet in a task


def word_hashes(text: str | None, memo: Memo) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(np.array([memo[w] for w in s.split()], np.uint64) for s in slices(text or ""))])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; the whole text if it is shorter."""
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix64(h)


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of its earlier occurrences mixed in."""
    order = np.argsort(s, kind="stable")
    same = np.concatenate([[False], s[order][1:] == s[order][:-1]])[: len(s)]
    begins = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    earlier = np.empty(len(s), np.uint64)
    earlier[order] = np.arange(len(s)) - begins
    return np.where(earlier > 0, mix64(s + earlier * np.uint64(0x9E3779B97F4A7C15)), s)


@lru_cache(maxsize=4)
def _orders(n: int) -> np.ndarray:
    return np.random.default_rng(41).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def order_min_hash(s: np.ndarray, settings: Settings) -> np.ndarray:
    """Two hashes per order: of the first `minima` labelled k-mers under it and of the first `few`, in the order of the text."""
    if not len(s):
        s = np.zeros(1, np.uint64)
    s = labelled(s)
    n, most, few = settings.sketches, min(settings.minima, len(s)), min(settings.few, len(s))
    out = np.empty(2 * n, np.uint64)
    step = max(1, (1 << 20) // len(s))
    for at in range(0, settings.sketches, step):
        a = _orders(settings.sketches)[at : at + step]
        ranks = a[:, None] * s[None, :]
        ranks ^= ranks >> np.uint64(32)
        ranks *= a[:, None]
        first = np.argpartition(ranks, most - 1, axis=1)[:, :most] if most < len(s) else np.broadcast_to(np.arange(len(s)), ranks.shape)
        first = np.sort(first, axis=1)
        out[at : at + len(a)] = _chained(a, s[first])
        least = np.sort(np.argsort(np.take_along_axis(ranks, first, axis=1), axis=1)[:, :few], axis=1)
        out[n + at : n + at + len(a)] = _chained(~a, s[np.take_along_axis(first, least, axis=1)])
    return out


def _chained(a: np.ndarray, kept: np.ndarray) -> np.ndarray:
    h = a.copy()
    for i in range(kept.shape[1]):
        h = (h ^ kept[:, i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix64(h)


MASKED = 1 << 15  # words of a text up to which the places of each word are kept as one bit set


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the banded alignment of two word sequences matches the wanted share.

    m matched pairs of n and k words are enough if 2 * m >= similarity * (n + k). Then no matched places are further
    apart than the unmatched ones of either, which bounds the band. Rows are bit sets: a longest common
    subsequence is found with one addition of integers per word.
    """
    n, k = len(a), len(b)
    need = similarity * (n + k) / 2
    if min(n, k) < need - 1e-9:
        return False
    left = int(np.argmin(np.append(a[: min(n, k)] == b[: min(n, k)], False)))
    right = int(np.argmin(np.append((a[::-1][: min(n, k)] == b[::-1][: min(n, k)]), False)))
    right = min(right, min(n, k) - left)
    matched = left + right
    if matched >= need - 1e-9:
        return True
    a, b = a[left : n - right], b[left : k - right]
    if matched + _in_common(a, b) < need - 1e-9:
        return False
    band = int(max(n, k) - need) + 1
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in places) for x, places in where.items()} if len(a) <= MASKED else None
    # The row's bits from `low` to `low + width`, all that the band can change; below it zeros are matches for good.
    low, width, row = 0, min(len(a), band + 1), (1 << min(len(a), band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        while low < j - band and width:
            matched += 1 - (row & 1)
            row, low, width = row >> 1, low + 1, width - 1
        while low + width < min(len(a), j + band + 1):
            row, width = row | 1 << width, width + 1
        if masks is not None:
            m = masks.get(x, 0) >> low & (1 << width) - 1
        else:
            places = where.get(x, [])
            m = sum(1 << (i - low) for i in places[bisect_left(places, low) : bisect_left(places, low + width)])
        if m:
            row = (row + (row & m) | row & ~m) & (1 << width) - 1
    return matched + width - row.bit_count() >= need - 1e-9


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words the two have in common, repeated ones as often as both have them: no alignment matches more."""
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], k[j]).sum())


def _verified(similarity: float):
    @F.pandas_udf("boolean")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([aligned(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), similarity) for a, b in zip(left, right)], dtype=bool)

    return verify


def _sketched(docs: DataFrame, settings: Settings) -> DataFrame:
    @F.pandas_udf("sketch array<long>, size int")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo()
        for texts in batches:
            words = [word_hashes(t, memo) for t in texts]
            yield pd.DataFrame({"sketch": [order_min_hash(shingles(w, settings.words), settings).view(np.int64) for w in words], "size": [len(w) for w in words]})

    columns = "doc_id", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2"), sketch("text").alias("_")
    return docs.select(*columns).select("doc_id", "_h1", "_h2", F.col("_.sketch").alias("_sketch"), F.col("_.size").alias("_size"))


def _worded(docs: DataFrame) -> DataFrame:
    """The word sequences (32 bits each) of these nodes."""

    @F.pandas_udf("binary")
    def sequence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo()
        for texts in batches:
            yield pd.Series([(word_hashes(t, memo) >> np.uint64(32)).astype(np.uint32).tobytes() for t in texts], dtype=object)

    return docs.select("node", sequence("text").alias("_s"))


def _shingles_of(words: bytes, settings: Settings) -> np.ndarray:
    """The shingles (32 bits each) of a stored word sequence."""
    return (shingles(np.frombuffer(words, np.uint32).astype(np.uint64), settings.words) >> np.uint64(32)).astype(np.uint32)


COUNTER_BITS, BLOCK_BITS = 18, 10


def _levels(sequences: DataFrame, settings: Settings) -> np.ndarray:
    """How often shingles occur, as a coarse logarithm per counter; a shingle's counter is its upper bits.

    A task's counters are one array, passed on in blocks that are summed by block. Near copies dealt over many tasks would
    be counted with the same counters in each; there is one task for each core, so the size doesn't grow with the texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for s in b["_s"]:
                np.add.at(counts, _shingles_of(s, settings) >> np.uint32(32 - COUNTER_BITS), 1)
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"at": at, "n": [blocks[i].tobytes() for i in at]})

    @F.pandas_udf("binary")
    def total(blocks: pd.Series) -> bytes:
        return np.sum([np.frombuffer(b, np.int64) for b in blocks], axis=0).tobytes()

    cores = sequences.sparkSession.sparkContext.defaultParallelism
    counted = sequences.select("_s").coalesce(cores).mapInPandas(count, "at long, n binary").groupBy("at").agg(total("n").alias("n")).toArrow()
    out = np.zeros((1 << COUNTER_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for at, n in zip(counted["at"].to_pylist(), counted["n"].to_pylist()):
        out[at] = np.minimum(8 * np.log2(np.maximum(np.frombuffer(n, np.int64), 1)), 255)
    return out.ravel()


def prefix(s: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The labelled shingles that come first, rare ones before frequent ones: so many that a near text must share one.

    m >= similarity * (n + k - m) and m <= k give m >= similarity * n; all but the last ceil(similarity * n) - 1 are taken.
    """
    rare = levels[s >> np.uint32(32 - COUNTER_BITS)]
    s = labelled(s.astype(np.uint64))
    return s[np.lexsort((s, rare))[: len(s) - ceil(similarity * len(s) - 1e-9) + 1]] if len(s) else s


def _prefixes(sequences: DataFrame, settings: Settings) -> DataFrame:
    """key, node, n (its shingles), at (the key's place in the prefix), rank (of the node among the key's), many (of them)."""
    levels = _levels(sequences, settings)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, s in zip(b["node"], b["_s"]):
                s = _shingles_of(s, settings)
                keys = prefix(s, levels, settings.similarity).view(np.int64)
                yield pd.DataFrame({"key": keys, "node": node, "n": len(s), "at": np.arange(len(keys))})

    found = sequences.mapInPandas(take, "key long, node long, n int, at int")
    key = Window.partitionBy("key")
    ranked = found.withColumn("rank", F.row_number().over(key.orderBy("at", F.xxhash64("node"), "node"))).withColumn("many", F.count("*").over(key))
    return stored(ranked.where("many > 1"), "prefixes")


def between(prefixes: DataFrame, roots: DataFrame, low: int, high: int, settings: Settings) -> DataFrame:
    """Pairs (a > b) of two components that may be near: those of ranks from low below high with all of higher rank."""
    now = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    live = now.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    now = now.join(live, "key").withColumn("salts", F.ceil(F.col("many") / settings.salt).cast("int"))
    centres = now.where(F.col("rank").between(low, high - 1)).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
    others = now.where(F.col("rank") > low).withColumn("salt", F.pmod(F.hash("node"), "salts"))
    need = settings.similarity / (1 + settings.similarity) * (F.col("c.n") + F.col("o.n")) - 1e-6
    most = F.least(F.col("c.n") - F.col("c.at"), F.col("o.n") - F.col("o.at"))  # matches that the first shared shingle leaves possible
    pairs = centres.alias("c").join(others.alias("o"), ["key", "salt"]).where("o.rank > c.rank and o.root <> c.root").where(most >= need)
    return pairs.select(F.greatest("c.node", "o.node").alias("a"), F.least("c.node", "o.node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that it is connected with.

    Alternating star operations: each node's larger neighbours are linked to its smallest one, then each node and its
    smaller neighbours to the smallest, until nothing changes.
    """

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before, now = None, state(edges)
    if now[1] is not None and edges.groupBy("a").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
        before = now  # all are stars already
    while now[0] and before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a > b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("a"), "m").selectExpr("inline(array(struct(x AS a, m AS b), struct(a AS a, m AS b)))")
        edges = stored(small.where("a > b").distinct(), "edges")
        before, now = now, state(edges)
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b): only the components that the links join are worked on."""
    ends = links.select("a", "b")
    for end in "ab":
        ends = ends.join(roots.withColumnsRenamed({"node": end, "root": f"_{end}"}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    up = stored(components(ends), "up")
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return stored(moved.unionByName(up.join(roots, "node", "left_anti")), "roots")


def _matching(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows whose text hashes and doc_id are those of `texts`. The id is a key too, so copies of one text don't meet."""
    other = texts.withColumnsRenamed({"_h1": "_g1", "_h2": "_g2"})
    return rows.join(other, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")) & F.col("doc_id").eqNullSafe(F.col("_doc")))


def _classed(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Text hashes of every row (doc_id, _h1, _h2), and of every distinct text its smallest doc_id (_doc), its number of rows (_n) and its class (_root)."""
    sketched = stored(_sketched(docs.select("doc_id", "text"), settings), "sketches")
    texts = sketched.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_n"), F.first("_sketch").alias("_sketch"), F.first("_size").alias("_size"))
    nodes = stored(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")  # as written, so the numbers stay
    keys = nodes.select("node", "_size", F.posexplode("_sketch").alias("_k", "_v")).select(F.xxhash64("_k", "_v").alias("key"), "node", "_size", (F.col("_k") < settings.sketches).alias("strict"))
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last"), F.min_by("_size", "node").alias("_led"), F.count("*").alias("_many")).where("_last > leader").drop("_last")
    members = stored(keys.join(shared, "key"), "members")
    short = nodes.where(F.col("_size").between(1, settings.short + settings.words - 1)).select("node")
    ids = nodes.join(members.select("node").union(short).distinct(), "node").select("node", "_h1", "_h2", "_doc")
    # One row of each text is enough; the smallest id finds it without moving the text of its copies.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2"))
    wanted = _matching(rows, ids).select("node", "text")
    sequences = stored(_worded(wanted).dropDuplicates(["node"]), "sequences")

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs with ok: whether the two texts are near duplicates."""
        out = pairs.join(sequences.select(F.col("node").alias("a"), F.col("_s").alias("_sa")), "a").join(sequences.select(F.col("node").alias("b"), F.col("_s").alias("_sb")), "b")
        return out.select("a", "b", _verified(settings.similarity)("_sa", "_sb").alias("ok"))

    # Members meet the leader and, sorted by length in chunks of bounded size, the one before them; texts too unlike in length don't.
    alike = lambda x, y: 2 * F.least(x, y) >= settings.similarity * (x + y) - 1e-6
    led = members.where("node > leader").where(alike(F.col("_size"), F.col("_led"))).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("_many") / settings.salt))
    beside = Window.partitionBy("key", "_chunk").orderBy("_size", "node")
    beside = members.where("_many > 2").withColumn("_chunk", chunk).select("node", "_size", F.lag("node").over(beside).alias("_n"), F.lag("_size").over(beside).alias("_p"))
    beside = beside.where(F.col("_n").isNotNull() & alike(F.col("_size"), F.col("_p"))).select(F.greatest("node", "_n").alias("a"), F.least("node", "_n").alias("b"))
    tried = stored(verified(led.unionByName(beside).distinct()), "tried")
    roots = stored(components(tried.where("ok")), "roots")
    for _ in range(settings.rounds):
        inside = members.join(roots, "node", "left").select("key", "node", "_size", F.coalesce("root", "node").alias("root"))
        proposal = F.struct(F.xxhash64("node", "key").alias("h"), "node", "_size")
        each = inside.groupBy("key", "root").agg(F.min(proposal).alias("m")).select("key", "root", "m.node", "m._size")
        centre = each.groupBy("key").agg(F.min(F.struct(F.xxhash64("root", "key").alias("h"), "root", "node", "_size")).alias("c"), F.count("*").alias("n")).where("n > 1")
        pairs = each.join(centre, "key").where("root <> c.root").where(alike(F.col("_size"), F.col("c._size"))).select(F.greatest("node", F.col("c.node")).alias("a"), F.least("node", F.col("c.node")).alias("b")).distinct()
        more = stored(verified(pairs.join(tried, ["a", "b"], "left_anti")), "more")
        if more.where("ok").isEmpty():
            tried = tried.unionByName(more)
            break
        tried, roots = tried.unionByName(more), merged(roots, more.where("ok"))

    inside = members.where("strict").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = inside.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    unresolved = inside.join(open_keys, "key").select("node").union(short).distinct()
    prefixes = _prefixes(sequences.join(unresolved, "node", "left_semi"), settings)
    most = prefixes.agg(F.max("many")).first()[0] or 0
    low, high = 1, 2
    while low < most:
        more = stored(verified(between(prefixes, roots, low, high, settings).join(tried, ["a", "b"], "left_anti")), "more")
        tried = tried.unionByName(more)
        if not more.where("ok").isEmpty():
            roots = merged(roots, more.where("ok"))
        low, high = high, 32 * high
    whole = nodes.join(roots, "node", "left").select("_h1", "_h2", "_doc", "_n", F.coalesce("root", "node").alias("_root"))
    return sketched.select("doc_id", "_h1", "_h2"), whole


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, class_size for every row."""
    rows, texts = _classed(docs, settings)
    of = texts.groupBy("_root").agg(F.min("_doc").alias("_least"), F.sum("_n").alias("class_size")).withColumn("class_id", F.coalesce("_least", -F.col("_root") - 1))
    named = texts.select("_h1", "_h2", "_root").join(of, "_root")
    return HotTexts(texts, rows.count()).join(rows, named).select("doc_id", "class_id", "class_size")


def distinct_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each class, the one with the smallest id, all columns as they were."""
    _, texts = _classed(docs, settings)
    first = F.min(F.struct(F.col("_doc").isNull().alias("_null"), "_doc", "_h1", "_h2"))
    kept = texts.groupBy("_root").agg(first.alias("m")).select("m._doc", "m._h1", "m._h2")
    rows = boxed(docs, "doc_id", "text").select("row", "doc_id", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2"))
    return _matching(rows, stored(kept, "kept")).dropDuplicates(["_h1", "_h2"]).select("row.*")

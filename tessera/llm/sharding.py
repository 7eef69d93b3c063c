"""Sharding by minimax contiguous partition, with DataFrame operations only.

Atomic groups (equal texts; those whose 64-bit hashes are equal stay together as well) lie in the order of their
text's hash. The smallest feasible shard capacity is found by binary search: a capacity is feasible if filling
shards greedily in that order needs no more than there are. The search sees sums over blocks, which are ranges of
the hash: at first 2^FIRST of them, then those blocks that a cut may fall into are split further, until each holds
one group. So the driver handles a bounded number of sums whatever the size of the corpus. Within the capacity
each cut goes to the place nearest to its even share. A group that is larger than an even share of what is left
takes a shard of its own first, so that it does not leave the others uneven (there are fewer of them than shards).

Defined cases: a null text has size EXTRA, checksum 0 and the group of null texts; empty tables give an empty
result; shards may stay empty if there are fewer groups than shards; repeated rows each get a slot.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import boxed, stored

EXTRA = 16
FIRST, FINER = 12, 6  # bits of the hash for the first blocks, and for each split
CELLS = 50_000  # about so many cells at most number the rows
WHOLE = 64
HOT, HOT_GROUPS = 100_000, 1000  # rows of a group that is split by place, and how many such groups there can be


def cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity for contiguous groups of these sizes, and the index of the group that begins each
    later shard. Feasibility is checked greedily; within the capacity cuts lie nearest to even shares."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    total = ends[-1]

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + capacity) - 1
        return at >= len(sizes)

    low, high = max([-(-total // shards), *sizes]), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    earliest = [0] * (shards + 1)  # the first group that may begin shard k
    earliest[shards] = len(sizes)
    for k in range(shards - 1, 0, -1):
        left = ends[earliest[k + 1]] - low
        earliest[k] = next_at_least(ends, left)
    begins, at = [], 0
    for k in range(1, shards):
        most = bisect_right(ends, ends[at] + low) - 1
        wanted = total * k // shards
        near = next_at_least(ends, wanted)
        if near and wanted - ends[near - 1] <= ends[near] - wanted:
            near -= 1
        at = min(max(near, earliest[k], at), most)
        begins.append(at)
    return low, begins


def next_at_least(ends: list[int], value: int) -> int:
    return bisect_right(ends, value - 1)


def _doubtful(ends: list[int], counts: list[int], shards: int, capacity: int) -> set[int]:
    """Blocks that a cut of the true solution may fall into, given a feasible capacity: the k-th cut lies no further
    than greedy filling reaches from the left, nor before what greedy filling reaches from the right."""
    last = len(counts) - 1
    furthest, nearest = [0], [ends[-1]]
    for _ in range(1, shards):
        at = min(ends[-1], furthest[-1] + capacity)
        i = bisect_right(ends, at) - 1
        furthest.append(ends[i] if i <= last and counts[i] == 1 else at)
        at = max(0, nearest[-1] - capacity)
        i = bisect_right(ends, at) - 1
        nearest.append(ends[i + 1] if i <= last and counts[i] == 1 and ends[i] < at else at)
    found: set[int] = set()
    for k in range(1, shards):
        low, high = nearest[shards - k], furthest[k]
        found.update(range(max(0, bisect_right(ends, low) - 1), min(last + 1, bisect_right(ends, high))))
    return found


def _block(bits: int):
    """Number of the hash range that a group lies in, by the first bits of its (signed) hash taken as unsigned."""
    return F.shiftrightunsigned(F.col("_h"), 64 - bits)


def _plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """The hashes (unsigned) that begin shards 1.. of those shared, and the hashes of groups with a shard of their own."""
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    large = [(r["_bytes"], r["_h"]) for r in groups.orderBy(F.desc("_bytes"), "_h").limit(shards).collect()]
    alone: list[int] = []
    for size, h in large:
        if len(alone) < shards - 1 and size * (shards - len(alone)) > total:
            alone.append(h)
            total -= size
    left = shards - len(alone)
    rest = groups.where(~F.col("_h").isin(alone)) if alone else groups
    sums = lambda df, bits: [(r["b"], bits, r["s"], r["n"]) for r in df.groupBy(_block(bits).alias("b")).agg(F.sum("_bytes").alias("s"), F.count("*").alias("n")).collect()]
    blocks, bits = sorted(sums(rest, FIRST)), FIRST
    while True:
        capacity, begins = cuts([s for *_, s, _ in blocks], left)
        ends = [0]
        for *_, s, _ in blocks:
            ends.append(ends[-1] + s)
        doubtful = _doubtful(ends, [n for *_, n in blocks], left, capacity)
        split = [blocks[i] for i in doubtful if blocks[i][3] > 1 and blocks[i][1] == bits and bits < 60]
        if not split:
            break
        kept = {b for b, *_ in split}
        wanted = groups.sparkSession.createDataFrame([(b,) for b in sorted(kept)], "b long")
        finer = min(60, bits + FINER)
        inside = rest.withColumn("b", _block(bits)).join(F.broadcast(wanted), "b", "left_semi")
        blocks = [x for x in blocks if not (x[1] == bits and x[0] in kept)] + sums(inside, finer)
        blocks.sort(key=lambda x: x[0] << (64 - x[1]))
        bits = finer
    return [blocks[i][0] << (64 - blocks[i][1]) if i < len(blocks) else 1 << 64 for i in begins], alone


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows (_id, _u, _h, size, text_crc32 and any others) with law, shard and slot."""
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("_h").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "groups")
    begins, alone = _plan(groups, shards)
    # With the sign bit turned, the order of signed numbers is that of the unsigned hashes.
    turned = F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))
    number = F.lit(0)
    for b in begins:
        if b < 1 << 64:
            number = number + F.when(turned >= F.lit(b - (1 << 63)), 1).otherwise(0)
    for i, h in enumerate(alone):
        number = F.when(F.col("_h") == F.lit(h), F.lit(shards - len(alone) + i)).otherwise(number)
    rows = rows.withColumn("shard", number.cast("int"))
    return _numbered(rows, groups).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        *more,
        F.col("doc_id").alias("_id"),
        F.monotonically_increasing_id().alias("_u"),  # written before it is used, so it stays as it is
        (F.coalesce(F.octet_length("text"), F.lit(0)) + EXTRA).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("_h"),
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id with size, text_crc32, law, shard, slot and grown_shard, for every row of docs."""
    return _placed(_measured(docs), shards).select(F.col("_id").alias("doc_id"), *COLUMNS)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every row of docs, its columns as they were but for those named in COLUMNS, which are set."""
    return _placed(_measured(boxed(docs.drop(*COLUMNS), "doc_id", "text"), "row"), shards).select("row.*", *COLUMNS)


def _numbered(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """slot: the row's gapless number in its shard. Rows fall into cells (a block of hashes, split where it has many
    rows), cells are counted and their first slots summed, and rows numbered within cells. Blocks are split by a hash of
    the document, and where that does not tell rows apart (null ids, groups of very many rows) by their place in the table."""
    block = _block(FIRST).alias("_b")
    counts = groups.groupBy(block).agg(F.sum("_rows").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    target = max(WHOLE, total // CELLS)
    salts = counts.select("_b", F.ceil(F.col("n") / target).cast("int").alias("_salts"))  # 2^FIRST rows at most
    large = groups.where(F.col("_rows") > max(HOT, total // HOT_GROUPS)).select("_h", F.lit(True).alias("_hot"))  # HOT_GROUPS rows at most
    cells = rows.withColumn("_b", block).join(F.broadcast(salts), "_b").join(F.broadcast(large), "_h", "left")
    alike = F.when(F.col("_hot") | F.col("_id").isNull(), F.col("_u"))
    cells = cells.withColumn("_c", F.pmod(F.xxhash64("_id", "_h", alike, F.lit(17)), F.col("_salts"))).drop("_hot")
    first = cells.groupBy("shard", "_b", "_c").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "_b", "_c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))  # bounded: about CELLS + 2^FIRST + shards cells
    within = Window.partitionBy("shard", "_b", "_c").orderBy("_h", "_id", "_u")
    return cells.withColumn("_r", F.row_number().over(within)).join(F.broadcast(first), ["shard", "_b", "_c"]).withColumn("slot", F.col("_first") + F.col("_r") - 1)

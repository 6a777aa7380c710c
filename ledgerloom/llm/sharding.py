"""Sharding (6): minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atomic and ordered by a 64-bit hash. The smallest shard capacity for which a greedy pass
needs at most k shards is found by binary search; the cuts are then key thresholds. The driver never holds all groups:
it sees runs (key ranges with their byte sums) and refines only those runs in which a cut may fall, so what it collects
is bounded by RUNS rows per refined run at any input size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import bounded, stash

BITS = 10
RUNS = 1 << BITS
#: Rows in a cell in which they are numbered, about; the cells' counts are all that crosses tasks.
CELL_ROWS = 5_000


@dataclass(frozen=True)
class Run:
    """Groups with ``start <= key < start + 2 ** width``: bytes in all, of the largest group, number of groups."""

    start: int
    width: int
    size: int
    largest: int
    groups: int


def greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """Positions at which new shards begin when each is filled up to ``capacity`` in order; None if a size exceeds it."""
    cuts, used = [], 0
    for k, size in enumerate(sizes):
        if size > capacity:
            return None
        if used + size > capacity:
            cuts.append(k)
            used = 0
        used += size
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """By binary search: the least capacity at which greedy() makes at most ``shards`` shards."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        cuts = greedy(sizes, mid)
        low, high = (low, mid) if cuts is not None and len(cuts) < shards else (mid + 1, high)
    return low


def unsure(runs: list[Run], shards: int) -> list[Run]:
    """Runs with several groups in which some cut of the best partition may fall."""
    total = sum(r.size for r in runs)
    low = max(max(r.largest for r in runs), -(-total // shards))
    wide = [r for r in runs if r.groups > 1 and r.size > low]
    if wide:
        return wide
    high = smallest_capacity([r.size for r in runs], shards)
    ends = [0]
    for r in runs:
        ends.append(ends[-1] + r.size)
    spans, least, most = [], 0, 0
    for _ in range(shards - 1):
        least = max((e for e in ends if e <= least + low), default=least)
        most = min(total, most + high)
        spans.append((least, most))
    return [r for r, a, b in zip(runs, ends, ends[1:], strict=False) if r.groups > 1 and any(a < y and x < b for x, y in spans)]


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... begin, and the smallest feasible capacity. ``groups``: key long, size long."""

    def summed(rows: DataFrame, width: int) -> list[Run]:
        prefix = F.shiftright("key", width)
        found = rows.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"))
        return [Run(r.p << width, width, r.s, r.m, r.n) for r in found.collect()]

    runs = sorted(summed(groups, 64 - BITS), key=lambda r: r.start)
    while runs and (todo := unsure(runs, shards)):
        fine: list[Run] = []
        for width in sorted({r.width for r in todo}):
            inside = F.shiftright("key", width).isin([r.start >> width for r in todo if r.width == width])
            fine += summed(groups.filter(inside), max(0, width - BITS))
        gone = set(todo)
        runs = sorted([r for r in runs if r not in gone] + fine, key=lambda r: r.start)
    if not runs:
        return [], 0
    sizes = [r.size for r in runs]
    capacity = smallest_capacity(sizes, shards)
    return [runs[k].start for k in greedy(sizes, capacity) or []], capacity


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), capacity.

    Equal texts (null counts as empty) share a shard; sizes are UTF-8 bytes + 1. Slots number a shard's rows from 0.
    Repeated rows get a slot each; ids may be null; other columns are ignored; with fewer groups than shards the rest
    stay empty; no rows give no rows.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sized",
    )
    groups = stash(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts, capacity = find_cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    cells = max(1, -(-rows.count() // (shards * CELL_ROWS)))
    placed = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id"), F.lit(cells)))  # repeated rows are spread too
    placed = stash(placed, "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "key", "text_crc32")
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1).join(bounded(offsets), ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )

"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are never divided.  Sorted by size, each enters the bin with the least remaining capacity
that still holds it, found in a balanced tree of bins.  The packing has two levels so that no task and not the
driver sees all groups: within hash buckets, groups are packed into bundles of a small fixed capacity; the
bundles, whose number is bounded by the bundle capacity and the number of buckets and not by the rows, are
then packed into the shards under the smallest capacity found to hold them all.  A group larger than a
shard's fair part gets a shard of its own and the others share the rest evenly.

Defined results: size is the text's bytes in UTF-8 plus 1, so null and empty texts (one group each) weigh 1;
repeated rows are each placed, with slots of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import buckets_for, for_python
from ledgerlens.scratch import written

#: Bundles that make up one shard, about.
BUNDLES_PER_SHARD = 256
#: Groups that one bucket packs into bundles, and the most buckets.
BUCKET_GROUPS, MOST_BUCKETS = 16384, 1 << 16
#: Rows that one task numbers.
SLOT_ROWS = 16384


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key, rank):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class BinTree:
    """A balanced search tree of (remaining capacity, bin): a treap whose ranks follow from a fixed generator."""

    def __init__(self):
        self.root, self._seed = None, 1

    def _split(self, node, key):
        """The nodes under `node` with smaller keys, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def put(self, key) -> None:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, _Node(key, self._seed >> 20)), high)

    def take_from(self, key):
        """The smallest key of at least `key`, which is removed; None if there is none."""
        low, high = self._split(self.root, key)
        parent, node = None, high
        while node is not None and node.left is not None:
            parent, node = node, node.left
        if node is not None:
            if parent is None:
                high = node.right
            else:
                parent.left = node.right
        self.root = self._merge(low, high)
        return node and node.key


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; `sizes` descend, and an item above the capacity fills a bin of its own."""
    tree, bins, out = BinTree(), 0, []
    for size in sizes:
        found = tree.take_from((size, -1)) if size < capacity else None
        room, number = found or (max(size, capacity), bins)
        bins += found is None
        out.append(number)
        if room > size:
            tree.put((room - size, number))
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, for sizes that descend: items above a fair part stand alone, the others share the rest.

    The capacity is raised from the fair part by small steps until best fit needs no more shards than there are.
    Where items are coarse best fit may leave the last shards short; items then move from the fullest of the
    sharing shards to the emptiest while that brings the two closer.
    """
    total, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    capacity = max([1, -(-total // bins), *rest[:1]])
    while max(placed := best_fit_decreasing(rest, capacity), default=0) >= bins:
        capacity += max(1, capacity >> 12)
    return [*range(alone), *(alone + p for p in _evened(rest, placed, bins))]


def _evened(sizes: list[int], placed: list[int], bins: int) -> list[int]:
    """The same items with the gap between the fullest and the emptiest bin closed as far as single moves can."""
    placed, held = list(placed), [0] * bins
    inside: list[list[tuple[int, int]]] = [[] for _ in range(bins)]
    for item, size in enumerate(sizes):
        insort(inside[placed[item]], (size, item))
        held[placed[item]] += size
    while True:
        full, empty = held.index(max(held)), held.index(min(held))
        gap = held[full] - held[empty]
        # the largest item of up to half the gap, or else the smallest if it is below the gap
        at = max(0, bisect_right(inside[full], (gap // 2, len(sizes))) - 1)
        if not inside[full] or inside[full][at][0] >= gap:
            return placed
        size, item = inside[full].pop(at)
        insort(inside[empty], (size, item))
        placed[item], held[full], held[empty] = empty, held[full] - size, held[empty] + size


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, group_key, shard, slot), one per row of `docs`."""
    for_python(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(body.cast("binary"), 256)).alias("group_key"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    n = min(MOST_BUCKETS, buckets_for(count, BUCKET_GROUPS, 16))
    capacity = max(1, -(-total // (shards * BUNDLES_PER_SHARD)))

    def bundle(key: tuple, held: pa.Table) -> pa.Table:
        held = held.select(["group_key", "group_size"]).sort_by([("group_size", "descending"), ("group_key", "ascending")])
        placed = best_fit_decreasing(held["group_size"].to_pylist(), capacity)
        return held.append_column("bundle", pa.array((key[0].as_py() << 32) + np.array(placed, np.int64)))

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(n)))
    bundled = written(dealt.groupBy("bucket").applyInArrow(bundle, "group_key string, group_size long, bundle long"))
    # at most two bundles a capacity, and one half empty in each bucket
    bundles = bundled.groupBy("bundle").agg(F.sum("group_size").alias("size")).orderBy(F.desc("size"), "bundle").toPandas()
    placed = pd.DataFrame({"bundle": bundles["bundle"].astype("int64"), "shard": np.array(into_shards([int(x) for x in bundles["size"]], shards), np.int32)})
    of_bundle = docs.sparkSession.createDataFrame(placed, "bundle long, shard int")
    of_group = bundled.join(F.broadcast(of_bundle), "bundle").select("group_key", "shard")
    return _slots(written(rows.join(of_group, "group_key")))


def _slots(rows: DataFrame) -> DataFrame:
    """`rows` with slot, gapless from 0 within each shard: rows are numbered within parts of a shard, and parts by their counts."""
    parts = buckets_for(rows.count(), SLOT_ROWS, 16)
    order = ["doc_id", "text_crc32", "group_key"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)))
    return numbered.join(first, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("nth") - 1).drop("part", "nth", "first")

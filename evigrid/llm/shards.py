"""Sharding by Karmarkar-Karp differencing over groups that stay together.

Groups of equal texts are indivisible. Each is an item of its own if it is large;
the others are bundled by hash into a bounded number of items. Every item starts
as a partial partition of one shard; the two partial partitions with the largest
spread are combined, the heaviest part of one with the lightest of the other,
until one is left. Only item sizes, at most ``shards * (fine + 1) * 2``, reach the
driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrid.plans.lineage import written

#: Bundles per shard: items are at most 1/fine of a shard, unless one group is larger.
FINE = 256
#: Parts per shard in which slots are counted.
RUNS = 1024


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item. Ties are broken by the items' order, so the result is fixed."""
    if not sizes:
        return []
    # A partial partition: sums in descending order, and for each part a node of a
    # binary forest whose leaves are items.
    empty = -1
    left: list[int] = []
    right: list[int] = []
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, (s,) + (0,) * (shards - 1), (i,) + (empty,) * (shards - 1)))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        parts = []
        for x, tx, y, ty in zip(a, ta, reversed(b), reversed(tb)):
            if tx == empty or ty == empty:
                parts.append((x + y, ty if tx == empty else tx))
            else:
                left.append(tx)
                right.append(ty)
                parts.append((x + y, len(sizes) + len(left) - 1))
        parts.sort(key=lambda p: -p[0])
        sums, trees = zip(*parts)
        heapq.heappush(heap, (sums[-1] - sums[0], count, sums, trees))
        count += 1
    found = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree] if tree != empty else []
        while stack:
            t = stack.pop()
            if t < len(sizes):
                found[t] = shard
            else:
                stack += (left[t - len(sizes)], right[t - len(sizes)])
    return found


def sharded(docs: DataFrame, shards: int = 16, fine: int = FINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    The law is ``bytes``: shard sizes are near equal, as far as whole groups of equal
    texts allow. ``size`` is the UTF-8 length plus 1 (null: 1, with no checksum; all
    null texts are one group). Slots count from 0 without gaps inside each shard, in
    an order fixed by what a row holds. Repeated rows and null ids each get a slot; very
    long texts count whole; ties in size keep the order of the items; other columns are
    not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    t = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.substring(F.sha2(t, 256), 1, 32)), F.lit(b"")).alias("key"),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = max(1, total // (shards * fine))
    item = F.pmod(F.xxhash64("key"), F.lit(shards * fine))
    giants = groups.where(F.col("bytes") > large).select("key", "bytes")  # at most shards * fine + fine
    giants = written(giants, "giants")
    small = groups.where(F.col("bytes") <= large).groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes"))
    items = [(None, r[0], r[1]) for r in small.collect()] + [(bytes(r[0]), None, r[1]) for r in giants.collect()]
    items.sort(key=lambda x: (x[1] is None, x[1] or 0, x[0] or b""))
    of = differencing([x[2] for x in items], shards)
    by_key = spark.createDataFrame([(k, s) for (k, _, _), s in zip(items, of) if k is not None], "key binary, giant int")
    by_item = spark.createDataFrame([(i, s) for (_, i, _), s in zip(items, of) if i is not None], "item long, bundle int")
    # Both tables are bounded by the item count, whatever the input.
    placed = rows.withColumn("item", item).join(F.broadcast(by_key), "key", "left").join(F.broadcast(by_item), "item", "left")
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.coalesce("giant", "bundle").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(RUNS)).alias("run"),
    )
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # shards * RUNS rows
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

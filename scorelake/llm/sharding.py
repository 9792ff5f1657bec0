"""Sharding: minimum-cost-flow resharding by the law of rows (shard counts at most one apart).

The old shards' rows are summed in blocks (old shard, size class). A minimum-cost flow from blocks to new shards, where
staying costs nothing and leaving costs the block's bytes a row, finds the transfers. Its graph is bounded by old shards
times size classes, never by rows. Rows are ranked by size within a block, and a block's smallest rows leave it: of each
old shard exactly its smallest rows leave, which are the fewest bytes for that many rows. (Which shards end with one row
more is decided by the classes' mean sizes; that is the only place where the bytes can exceed the least, by at most one
row's share of a class, a fifth of its size, for each shard.)

A row's rank is the rows of smaller sizes in its block, from counts by size, and a row number within its size; sizes of
many rows are dealt to buckets, so no window holds a whole shard or a whole size. The flow's rank intervals then give
shard and slot at once.

Defined cases: null texts have size 1 and checksum 0; null ids and repeated rows are rows like any other; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size classes in an octave, and about how many rows one bucket of a block may hold.
CLASSES, BUCKET_ROWS = 4, 5_000


def min_cost_flow(edges: list[tuple[int, int, int, float]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a cheapest maximum flow, by successive shortest paths."""
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in edges:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    potential = [0.0] * nodes
    while True:
        far, by = [float("inf")] * nodes, [-1] * nodes
        far[source] = 0.0
        queue = [(0.0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] > 0 and (new := d + max(0.0, cost[e] + potential[x] - potential[to[e]])) < far[to[e]] - 1e-9:
                    far[to[e]], by[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if by[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(edges))]
        potential = [p + (d if d < float("inf") else 0.0) for p, d in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        least = min(cap[e] for e in path)
        for e in path:
            cap[e] -= least
            cap[e ^ 1] += least


def plan_transfers(blocks: list[tuple[int, int, int, int]], n_new: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rank intervals (old, class, lo, hi, shard, first slot) for blocks (old, class, rows, bytes).

    A block stays at no cost in the new shard of its own number; its rows leave through a pool at their mean bytes, the
    lowest ranks first. A new shard takes floor(rows / n_new) freely and one more at a price above any transfer, so counts end at most one apart.
    """
    total = sum(b[2] for b in blocks)
    floor = total // n_new
    pool, sink, source = len(blocks) + n_new, len(blocks) + n_new + 1, len(blocks) + n_new + 2
    high = 1.0 + max((b[3] / b[2] for b in blocks), default=0.0) * 4
    edges: list[tuple[int, int, int, float]] = []
    for k, (old, _, rows, size) in enumerate(blocks):
        edges.append((source, k, rows, 0.0))
        edges.append((k, pool, rows, size / rows))
        edges.append((k, len(blocks) + old, rows, 0.0) if old < n_new else (k, pool, 0, 0.0))
    for j in range(n_new):
        edges.append((pool, len(blocks) + j, total, 0.0))
        edges.append((len(blocks) + j, sink, floor, 0.0))
        edges.append((len(blocks) + j, sink, 1, high))
    flow = min_cost_flow(edges, source, sink, source + 1)
    stays = [flow[3 * k + 2] if blocks[k][0] < n_new else 0 for k in range(len(blocks))]
    takes = [flow[3 * len(blocks) + 3 * j] for j in range(n_new)]
    used, out, j = [0] * n_new, [], 0
    for k, (old, cls, rows, _) in enumerate(blocks):
        at, rows = 0, rows - stays[k]
        if stays[k]:
            out.append((old, cls, rows, rows + stays[k], old, used[old]))
            used[old] += stays[k]
        while at < rows:
            while not takes[j]:
                j += 1
            n = min(rows - at, takes[j])
            out.append((old, cls, at, at + n, j, used[j]))
            used[j] += n
            takes[j] -= n
            at += n
    return out


def reshard(docs: DataFrame, old_shard: Column, n_new: int, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, salt: Column | None = None) -> DataFrame:
    """docs with size, text_crc32, old_shard, shard and slot.

    old_shard: an int column from 0, the number of the shard that a row lies in now (as many as the layout has files).
    salt: a number of the row that a second read repeats (as a hash of its file and place there); it deals rows of equal
    id and text to several buckets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    made = {"__salt": salt if salt is not None else F.lit(0), "__size": size, "__crc": F.crc32(F.encode(text, "utf-8")), "__old_shard": old_shard.cast("int")}
    named = {"__size": "size", "__crc": "text_crc32", "__old_shard": "old_shard"}
    rows = docs.withColumns(made).drop(*named.values(), "shard", "slot").withColumnsRenamed(named)
    rows = rows.withColumn("__class", F.floor(F.log2(F.col("size").cast("double")) * CLASSES).cast("int"))
    cells = rows.groupBy("old_shard", "__class", "size").agg(F.count("*").alias("__rows"))
    summed = cells.groupBy("old_shard", "__class").agg(F.sum("__rows").alias("n"), F.sum(F.col("size") * F.col("__rows")).alias("bytes"))
    blocks = sorted((r["old_shard"], r["__class"], r["n"], r["bytes"]) for r in summed.collect())
    intervals = docs.sparkSession.createDataFrame(
        plan_transfers(blocks, n_new), "__old int, __cls int, __lo long, __hi long, shard int, __slot long"
    )
    smaller = Window.partitionBy("old_shard", "__class").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__smaller", F.coalesce(F.sum("__rows").over(smaller), F.lit(0)))
    cell = ["old_shard", "__class", "size"]
    buckets = F.floor(F.col("__rows") / bucket_rows) + 1
    dealt = rows.join(cells, cell).withColumn("__bucket", F.pmod(F.xxhash64(id_col, "text_crc32", "__salt"), buckets).cast("long"))
    counts = dealt.groupBy(*cell, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*cell).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*cell, "__bucket").orderBy(F.col(id_col), F.col("text_crc32"), F.col("__salt"))
    ranked = dealt.withColumn("__rank", F.row_number().over(within).cast("long") - 1).join(offsets, [*cell, "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before") + F.col("__smaller"))
    # bounded: one interval a block, and one more for each new shard at most
    found = ranked.join(
        F.broadcast(intervals),
        (F.col("old_shard") == F.col("__old")) & (F.col("__class") == F.col("__cls")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")),
    )
    out = found.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__lo"))
    return out.drop("__salt", "__class", "__rows", "__smaller", "__bucket", "__rank", "__before", "__old", "__cls", "__lo", "__hi", "__slot")


def rewrite_affected(resharded: DataFrame, path: str) -> None:
    """Write the shards that gain or lose rows, one folder shard=N each; shards that keep just their own rows stay as they are."""
    moves = resharded.where(F.col("shard") != F.col("old_shard"))
    touched = moves.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()  # bounded by the number of shards
    numbers = [r["s"] for r in touched.collect()]
    affected = resharded.where(F.col("shard").isin(numbers))
    # a shard is written by many tasks: rows are dealt by shard and slot range, not by shard alone
    dealt = affected.repartition(F.col("shard"), F.floor(F.col("slot") / BUCKET_ROWS))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

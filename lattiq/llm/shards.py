"""Sharding by longest processing time: groups that stay together, largest first, to the least-loaded shard.

Groups of equal size are interchangeable, so the heap works on size classes (size, number of groups): a
class puts its groups on the shards in one step that gives exactly what one heap step a group would give.
Distinct sizes are few: D of them need at least D(D+1)/2 bytes of input, so D <= sqrt(2 x bytes).  The heap is
sequential by nature; it runs over the classes in one task that keeps nothing of them, and none comes to the driver.  Which group
of its class goes where, and a row's slot in its shard, come from ranks inside hash buckets of bounded size
plus offsets of the buckets; no class's groups and no shard's rows are ever brought into one task.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, written

#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Rows that share a ranking bucket, about.
BUCKET_ROWS = 100_000


class Schedule:
    """Loads of the shards, and the heap over them; takes classes in falling order of size."""

    def __init__(self, shards: int):
        self.loads = [0] * shards
        self.heap = [(0, s) for s in range(shards)]

    def place(self, size: int, c: int) -> list[int]:
        """How many of a class's c groups each shard gets; ties of load go to the lower shard.

        The greedy rule gives a class's groups, one by one, to the lowest of the levels load + i * size (i = 0, 1,
        ...) of all shards; so all but few of the c lowest levels are taken at once.
        """
        loads, heap = self.loads, self.heap
        n = len(loads)
        row = [0] * n
        if c > 4 * n and size > 0:
            lo, hi = min(loads), max(loads) + size * (c // n + 2)
            while lo < hi:  # the highest level below which at most c groups lie
                mid = (lo + hi + 1) // 2
                if sum(max(0, -((load - mid) // size)) for load in loads) <= c:
                    lo = mid
                else:
                    hi = mid - 1
            for s, load in enumerate(loads):
                k = max(0, -((load - lo) // size))
                row[s] += k
                loads[s] = load + k * size
                c -= k
            heap[:] = [(load, s) for s, load in enumerate(loads)]
            heapify(heap)
        for _ in range(c):
            load, s = heap[0]
            row[s] += 1
            loads[s] = load + size
            heapreplace(heap, (load + size, s))
        return row


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(class x shard counts, loads) for classes in falling order of size."""
    plan = Schedule(shards)
    out = [plan.place(size, c) for size, c in zip(sizes.tolist(), counts.tolist())]
    return np.array(out, np.int64).reshape(len(sizes), shards), np.array(plan.loads)


def _plan(shards: int):
    """mapInArrow function over all classes in falling order of size: for each, up to which of its ranks a shard takes."""

    def run(batches):
        plan = Schedule(shards)
        for b in batches:
            totals, cuts = b.column("total").to_pylist(), []
            for total, n in zip(totals, b.column("n").to_pylist()):
                until, own = 0, []
                for s, k in enumerate(plan.place(total, n)):
                    if k:
                        until += k
                        own.append({"until": until, "shard": s})
                cuts.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("until", pa.int64()), ("shard", pa.int32())])))], ["total", "cuts"])

    return run


def _ranked(df: DataFrame, by: list[str], rows: DataFrame, seed: str, order: list[str], name: str) -> DataFrame:
    """df with name: its rank from 0 within by, whatever the number of rows that share by.

    rows(by..., n) tells how many.  Ranks are counted within hash buckets of about BUCKET_ROWS, then shifted.
    """
    cut = df.join(rows.select(*by, F.ceil(F.col("n") / BUCKET_ROWS).alias("__cuts")), by).withColumn("__bucket", F.pmod(F.xxhash64(seed), F.col("__cuts")))
    held = cut.groupBy(*by, "__bucket").agg(F.count("*").alias("__held"))
    shift = held.withColumn("__shift", F.coalesce(F.sum("__held").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__held")
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order)) - 1
    return cut.withColumn("__in", inside).join(shift, [*by, "__bucket"]).withColumn(name, (F.col("__in") + F.col("__shift")).cast("long")).drop("__in", "__shift", "__bucket", "__cuts")


def shard(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, digest, shard, slot for each row; rows of equal text share a shard.

    size: UTF-8 bytes of the text plus 8; a null text counts as an empty one and shares its group.  Slots run
    from 0 without gaps in each shard.  Repeated rows get a
    slot each; a group heavier than a fair share fills its shard, which can't be helped, and the others
    share the rest evenly.  Other columns are ignored; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        documents.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "sizes",
    )
    groups = rows.groupBy("digest").agg(F.count("*").alias("members"), F.sum("size").alias("total"))
    groups = durable(groups)
    classes = groups.groupBy("total").agg(F.count("*").alias("n"))
    # one task walks the classes, a row each, and holds nothing but the shards' loads
    lists = durable(classes.repartition(1).sortWithinPartitions(F.desc("total")).mapInArrow(_plan(shards), "total long, cuts array<struct<until:long,shard:int>>"))
    ranked = _ranked(groups, ["total"], classes, "digest", ["digest"], "rank")
    placed = ranked.join(lists, "total").select("digest", "members", F.expr("element_at(filter(cuts, c -> c.until > rank), 1).shard").alias("shard"))
    full = durable(rows.join(placed.select("digest", "shard"), "digest"))
    held = full.groupBy("shard").agg(F.count("*").alias("n"))
    keyed = full.withColumn("__seed", F.xxhash64("doc_id", "digest"))
    return _ranked(keyed, ["shard"], held, "__seed", ["doc_id", "digest"], "slot").select("doc_id", "size", "text_crc32", "digest", "shard", "slot")

"""Sharding by Karmarkar-Karp differencing: indivisible groups, nearly equal bytes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.shared import query, table, written

SHARDS = 24
CHUNK = 2000  # groups of one differencing task
FAN = 1000  # partial partitions of one differencing task
TOP = 400  # chunks whose bundles the last task takes
DIRECT = 8000  # groups that it takes one by one
LARGE = 64  # it also takes groups larger than this part of a shard
SLOT_ROWS = 1000  # rows numbered together within a shard


def difference(partials: list[tuple[np.ndarray, list[list]]], ways: int) -> list[list]:
    """Combine partial partitions into one and give the members of its parts.

    A partial partition is ``ways`` sums and, for each, what lies there. The two of largest
    spread are put together, the largest sum of one on the smallest of the other, until one is left.
    """
    heap = []
    for number, (sums, members) in enumerate(partials):
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heap.append((int(sums[0] - sums[-1]), number, sums, [members[i] for i in order]))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums, members = a + b[::-1], []
        for x, y in zip(in_a, in_b[::-1], strict=True):
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            x.extend(y)
            members.append(x)
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), number, sums, [members[i] for i in order]))
        number += 1
    return heap[0][3]


def combined(units: DataFrame, ways: int) -> DataFrame:
    """Difference the units of each parent: (parent, unit, slot, bytes) to (parent, unit, slot, part)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "slot"], kind="stable").reset_index(drop=True)
        unit, slot, size = rows["unit"].to_numpy(), rows["slot"].to_numpy(), rows["bytes"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        partials = []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            sums, members = np.zeros(ways, np.int64), [[] for _ in range(ways)]
            for i in range(a, b):
                sums[slot[i]] += size[i]
                members[slot[i]].append(i)
            partials.append((sums, members))
        part = np.zeros(len(rows), np.int32)
        for number, members in enumerate(difference(partials, ways)):
            part[members] = number
        return rows[["parent", "unit", "slot"]].assign(part=part)

    kind = units.schema["unit"].dataType.simpleString()
    return units.groupBy("parent").applyInPandas(run, f"parent long, unit {kind}, slot int, part int")


def balanced(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) for ``groups`` of (key, bytes).

    Most groups are differenced in chunks, in parallel, which leaves ``shards`` bundles of nearly
    equal bytes a chunk. One last task differences the bundles, the groups that are large against
    a shard (there can be only so many) and about DIRECT others, which even out what bundles
    cannot; the chunks of a larger table are first combined with each other until TOP are left.
    """
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    alone = (F.col("bytes") > total // (shards * LARGE)) | (F.pmod(F.xxhash64("key"), F.lit(max(n, 1))) < DIRECT)
    small = groups.where(~alone)
    chunks = max(1, -(-n // CHUNK))
    units = small.select(
        F.pmod(F.hash("key"), F.lit(chunks)).cast("long").alias("parent"), F.col("key").alias("unit"),
        F.lit(0).alias("slot"), "bytes",
    )
    placed = written(combined(units, shards).join(units.select("unit", "bytes"), "unit"))
    sums = placed.groupBy("parent", "part").agg(F.sum("bytes").alias("bytes"))
    placed = placed.select(F.col("unit").alias("key"), F.col("parent").alias("unit"), F.col("part").alias("slot"))
    while chunks > TOP:
        chunks = max(TOP // 2, -(-chunks // FAN))
        units = sums.select(F.pmod("parent", F.lit(chunks)).alias("parent"), F.col("parent").alias("unit"),
                            F.col("part").alias("slot"), "bytes")
        moved = written(combined(units, shards).join(units.select("unit", "slot", "bytes"), ["unit", "slot"]))
        sums = moved.groupBy("parent", "part").agg(F.sum("bytes").alias("bytes"))
        placed = placed.join(moved.select("unit", "slot", "parent", "part"), ["unit", "slot"]).select(
            "key", F.col("parent").alias("unit"), F.col("part").alias("slot"))
    bundle = F.concat_ws(":", "unit", "slot")
    last = groups.where(alone).select(F.hex("key").alias("unit"), "bytes").unionByName(
        sums.select(F.concat_ws(":", "parent", "part").alias("unit"), "bytes"))
    shard = written(combined(last.withColumns({"parent": F.lit(0).cast("long"), "slot": F.lit(0)}).select(
        "parent", "unit", "slot", "bytes"), shards).select("unit", F.col("part").alias("shard")))
    single = shard.where("unit NOT LIKE '%:%'").select(F.unhex("unit").alias("key"), "shard")
    return placed.select("key", bundle.alias("unit")).join(shard, "unit").select("key", "shard").unionByName(single)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its shard; equal texts stay together, the shards' bytes are near equal.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document's size is the
    UTF-8 bytes of its text (null: none) plus 8. Texts are told apart by their 128-bit hash and
    their length; a null text is equal to an empty one. Returns doc_id, size, text_crc32, law,
    shard, slot (gapless from 0 in a shard) and grown_shard (null under this law). Rows that
    repeat a doc_id are documents of their own; a null doc_id stays null. An empty table gives no
    rows. A group of texts larger than its share of all bytes makes its shard as large as it is.

    Sizes are summed per text before the shuffle. Slots are numbered in buckets of hashed ids and
    moved up by the counts of the buckets before, so that no shard is sorted as a whole.
    """
    text = F.coalesce("text", F.lit(""))
    digest = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(F.unhex(F.md5(text)), F.unhex(F.hex(F.octet_length(text).cast("long")))).alias("key"),
    ))
    groups = written(digest.groupBy("key").agg(F.sum("size").alias("bytes")))
    assigned = written(balanced(groups, shards))
    buckets = max(1, digest.count() // (shards * SLOT_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    rows = written(digest.join(assigned, "key").select("doc_id", "size", "text_crc32", "shard", bucket))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return rows.withColumn("place", F.row_number().over(own)).join(counts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))

"""Sharding by Karmarkar-Karp differencing: near-equal bytes with groups of equal texts kept whole.

Differencing starts with one partial partition per item (the item in one bin, the others empty) and
again and again combines the two with the largest spread between fullest and emptiest bin, fullest on
emptiest, so that their differences cancel. No task and not the driver ever sees all items: items are
dealt by hash into parts of bounded size, each part is differenced into bundles by one task, and the
bundles are the items of the next round, until they fit one part. A part makes its bundles from one half
of its items, from a quarter, an eighth and so on, down to single items, so that every round has small
items left to level what the large ones leave uneven.

Law ``bytes``: shard sizes as near equal as whole groups allow; a group above the mean size has a shard
almost to itself. Defined cases: a null text counts as empty, so it has size 8 and CRC 0 and is in the
group of the empty texts; repeated rows are separate rows of one group; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hrefmill.llm.tables import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 24
ROW_BYTES = 8
PART = 20_000
SLOT_ROWS = 50_000


def difference(sizes: list[int], bins: int) -> list[int]:
    """Bin of each item by Karmarkar-Karp differencing; bins are numbered from the fullest."""
    if not sizes:
        return []
    # A bin holds a node: an item number, or beyond them a pair of nodes.
    pairs: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for item, size in enumerate(sizes):
        heap.append((-size, item, [size] + [0] * (bins - 1), [item] + [-1] * (bins - 1)))
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other_sums, other_nodes = heapq.heappop(heap)
        merged = []
        for s, a, t, b in zip(sums, nodes, reversed(other_sums), reversed(other_nodes)):
            if a >= 0 and b >= 0:
                pairs.append((a, b))
                a = n + len(pairs) - 1
            merged.append((s + t, a if a >= 0 else b))
        merged.sort(key=lambda x: -x[0])
        sums, nodes = [s for s, _ in merged], [a for _, a in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], stamp, sums, nodes))
        stamp += 1
    out = [0] * n
    for number, root in enumerate(heap[0][3]):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node >= n:
                stack.extend(pairs[node - n])
            else:
                out[node] = number
    return out


def _bundle_task(bins: int) -> Callable:
    """Bins of each item among the items of its class; class c holds every 2**(c+1)-th item."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item").reset_index(drop=True)
        place = (part.index + 1).to_numpy()
        part["layer"] = [int(x) for x in (place & -place)]
        part["bin"] = 0
        for _, rows in part.groupby("layer"):
            part.loc[rows.index, "bin"] = difference(rows["size"].tolist(), bins)
        return part[["item", "size", "part", "layer", "bin"]]

    return run


def _last_task(bins: int) -> Callable:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item")
        return pd.DataFrame({"item": part["item"], "bin": difference(part["size"].tolist(), bins)})

    return run


def assign(items: DataFrame, bins: int = SHARDS, part: int = PART) -> DataFrame:
    """``(item, bin)`` for a table of unique ``item`` (string) and ``size``: the bins' sizes near equal.

    Items must not begin with ``bundle ``. ``part`` bounds what one task gets, some four times ``bins`` at least.
    """
    items = keep(items.select("item", F.col("size").cast("long").alias("size")))
    steps: list[DataFrame] = []
    n = items.count()
    while n > part:
        parts = math.ceil(n / (part // 2))
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(len(steps))), F.lit(parts)))
        bundled = keep(
            dealt.groupBy("part")
            .applyInPandas(_bundle_task(bins), "item string, size long, part long, layer long, bin int")
            .withColumn("bundle", F.format_string(f"bundle {len(steps)} %d %d %d", "part", "layer", "bin"))
        )
        steps.append(bundled.select("item", "bundle"))
        items = keep(bundled.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "item"))
        before, n = n, items.count()
        if n >= before:
            raise ValueError("part is too small for this number of bins")
    one_part = items.withColumn("part", F.lit(0)).groupBy("part")
    placed = keep(one_part.applyInPandas(_last_task(bins), "item string, bin int"))
    for step in reversed(steps):
        placed = step.join(placed.withColumnRenamed("item", "bundle"), "bundle").select("item", "bin")
    return placed


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", part: int = PART
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: every row in a shard and a slot of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text).alias("item"),
        )
    )
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = rows.join(assign(groups, shards, part), "item")
    # Slots: numbers inside small hash cells of a shard, after the rows of the cells before.
    cells = max(64, rows.count() // (shards * SLOT_ROWS))
    placed = keep(placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells))).drop("item"))
    sizes = placed.groupBy("bin", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("bin").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("bin", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("bin", "cell").orderBy("doc_id", "text_crc32")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(offsets, ["bin", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("bin").alias("shard"),
            (F.col("offset") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, equal texts together."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

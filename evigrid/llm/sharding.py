"""Consistent-hash ring with virtual nodes and bounded loads.

A key's place on the ring is a hash of its id; all keys between two virtual nodes (an arc) meet the shards in the same
clockwise order. Loads are summed by arc, which gives a table of shards * virtual nodes rows whatever the input; on it
the driver lets every arc fill the shards clockwise, each up to its bound. That gives for each arc the loads that
stay and that continue. Keys stand in hash order in their arc and the cuts fall between them.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RING = 1 << 32


def _place(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big")


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes by place; a shard's nodes don't depend on the number of shards."""
    return sorted((_place(f"shard-{s}-{k}"), s) for s in range(shards) for k in range(nodes))


def route(loads: dict[int, int], points: list[tuple[int, int]], shards: int, bound: float) -> dict[int, list[tuple[int, int]]]:
    """(shard, load) in clockwise order for each arc: the first shard with room takes what fits, the rest continues.

    Rounds: first every arc offers to its own shard, then what is left to the next one clockwise, and so on, so that a
    key leaves its shard only if that is full of its own keys. bound is a shard's largest load.
    """
    free = [bound] * shards
    orders = {}
    for arc in loads:
        seen = dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points)))
        orders[arc] = list(seen)
    left, out = dict(loads), {arc: [] for arc in loads}
    for turn in range(shards):
        for arc in sorted(left):
            if left[arc] > 0 and turn < len(orders[arc]):
                shard = orders[arc][turn]
                now = int(min(left[arc], max(0, free[shard])))
                if now:
                    out[arc].append((shard, now))
                    free[shard] -= now
                    left[arc] -= now
    for arc, rest in left.items():  # fractions of the bound
        if rest > 0:
            out[arc].append((orders[arc][0] if not out[arc] else out[arc][-1][0], rest))
    return out


def shard_by_ring(
    docs: DataFrame, shards: int = 16, nodes: int = 256, load_factor: float = 1.001, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Put each row into a shard by its id's place on the ring, no shard over load_factor times the mean load.

    A row's load is its text's UTF-8 bytes plus 1 (null text: 1). A cut falls between two rows, so a shard may exceed its
    bound by half a row for each arc that is cut. Returns per row: doc_id, size, text_crc32, home (the shard without
    bounds), shard, slot (gapless in the shard, in ring order). The place of a null id is that of its text; rows at one place
    are in the order of their texts' hashes, and equal rows in any order. Null and empty texts have size 1. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_md5"))
    place = F.conv(F.substring(F.md5(F.concat(F.lit("key-"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), "_md5"))).cast("binary")), 1, 8), 16, 10).cast("long")
    points = ring(shards, nodes)
    starts = [p for p, _ in points]
    # the arc is the number of virtual nodes before the place: a lookup by the leading bits, then the few nodes in that range
    bits = 12
    table, low = [], []
    for prefix in range(1 << bits):
        a, b = bisect.bisect_left(starts, prefix << (32 - bits)), bisect.bisect_left(starts, (prefix + 1) << (32 - bits))
        low.append(a)
        table.append(starts[a:b])
    lookup = spark.createDataFrame([(i, low[i], table[i]) for i in range(1 << bits)], "prefix int, low int, near array<long>")
    rows = rows.withColumn("place", place).withColumn("prefix", F.shiftright("place", 32 - bits).cast("int"))
    rows = rows.join(F.broadcast(lookup), "prefix")
    arc = F.pmod(F.col("low") + F.size(F.filter("near", lambda x: x < F.col("place"))), F.lit(len(points)))
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "_md5", "place", arc.cast("int").alias("arc")), "ring")
    loads = {r["arc"]: r["load"] for r in rows.groupBy("arc").agg(F.sum("size").alias("load")).collect()}
    total = sum(loads.values())
    routed = route(loads, points, shards, load_factor * total / shards if total else 1)
    pieces = []
    for a, parts in routed.items():
        at = 0
        for k, (shard, load) in enumerate(parts):
            pieces.append((a, k, shard, at, 1 << 62 if k == len(parts) - 1 else at + load))
            at += load
    cuts = {}
    for a, _, shard, lo, hi in pieces:
        cuts.setdefault(a, []).append((hi, shard))
    by_arc = spark.createDataFrame([(a, points[a][1], [h for h, _ in c], [s for _, s in c]) for a, c in cuts.items()], "arc int, home int, ends array<long>, to array<int>")
    order = Window.partitionBy("arc").orderBy("place", "_md5", "doc_id")
    placed = rows.withColumn("middle", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2).withColumn("nth", F.row_number().over(order))
    placed = placed.join(F.broadcast(by_arc), "arc").withColumn("piece", F.size(F.filter("ends", lambda x: x <= F.col("middle"))))
    placed = placed.withColumn("shard", F.element_at("to", F.col("piece") + 1))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "home", "shard", "arc", "piece", "nth"), "placed")
    firsts = placed.groupBy("shard", "arc", "piece").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("arc", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    firsts = firsts.withColumn("base", base)  # at most a row for each cut of the ring
    out = placed.join(F.broadcast(firsts.select("shard", "arc", "piece", "first", "base")), ["shard", "arc", "piece"])
    return out.select("doc_id", "size", "text_crc32", "home", "shard", (F.col("base") + F.col("nth") - F.col("first")).alias("slot"))

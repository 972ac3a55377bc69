"""K-d tree partitioning of documents into shards of near-equal bytes.

The unit is a group of equal texts (a group of more than a share of a shard, in
bytes or in rows, is broken into pieces by a hash of doc_id, so a hot group can
be balanced, and no task gets all its rows).
Its dimensions are metadata: bytes of the text, source and language. A node
is split along its widest dimension (extent relative to the whole table's) at
the median weighted by bytes; ties on that dimension are ordered by a hash of
the text, so a cut never has to break a value of many rows badly.

Medians come from histograms aggregated on the executors: every round counts
the weight in 4096 bins of each node's current range and narrows the range to
the bin that holds the median, for all nodes of a level at once. The driver
sees at most nodes x 4096 sums a round, whatever the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.llm.common import fingerprint, stage

_BINS = 4096
_HASH_BITS = 40
#: Dimensions, in the order that breaks ties of width.
DIMENSIONS = ("d_bytes", "d_source", "d_lang")


def _cuts(units: DataFrame, dims: dict[int, str], weights: dict[int, float], tolerance: float) -> dict[int, int]:
    """For each node, the largest key that goes left."""
    lo = {n: 0 for n in dims}
    hi = {n: (1 << 62) for n in dims}
    below = {n: 0.0 for n in dims}
    cut: dict[int, int] = {}
    while live := [n for n in dims if n not in cut]:
        step = {n: max(1, -(-(hi[n] - lo[n]) // _BINS)) for n in live}
        key = _by_node({n: F.col(f"k_{dims[n]}") for n in live})
        first, last, width = (_by_node({n: F.lit(x[n]).cast("long") for n in live}) for x in (lo, hi, step))
        b = units.where(F.col("node").isin(live)).withColumn("__k", key).where((F.col("__k") >= first) & (F.col("__k") < last))
        b = b.groupBy("node", ((F.col("__k") - first - (F.col("__k") - first) % width) / width).cast("long").alias("bin")).agg(F.sum("w").alias("w"))
        bins: dict[int, list[tuple[int, float]]] = {n: [] for n in live}
        for r in b.collect():
            bins[r["node"]].append((r["bin"], float(r["w"])))
        for n in live:
            half = weights[n] / 2
            acc, found = below[n], None
            for at, w in sorted(bins[n]):
                if acc + w >= half or found is None and at == max(x for x, _ in bins[n]):
                    found = (at, w)
                    break
                acc += w
            if found is None:
                cut[n] = hi[n] - 1
                continue
            at, w = found
            start, end = lo[n] + at * step[n], min(hi[n], lo[n] + (at + 1) * step[n])
            if w <= tolerance * weights[n] or end - start <= 1:
                cut[n] = end - 1 if acc + w - half <= half - acc else start - 1
            else:
                lo[n], hi[n], below[n] = start, end, acc
    return cut


def _by_node(values: dict[int, Column]) -> Column:
    out = F.lit(None).cast("long")
    for n, v in values.items():
        out = F.when(F.col("node") == n, v).otherwise(out)
    return out


def kd_shards(docs: DataFrame, depth: int | None = 3, tolerance: float = 1e-4, target_bytes: int | None = None) -> DataFrame:
    """Put every row into one of 2**depth shards of near-equal bytes; with target_bytes, of as many levels as leaves need to hold no more than that.

    docs: doc_id, text, source, lang; others are ignored. Returns doc_id,
    size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32,
    shard, slot (gapless from 0 in each shard, same on every run). Equal texts
    share a shard unless their group outweighs a twentieth of one, in bytes or
    in rows; null is a text of its own, and rows that repeat a document are
    rows. A table with fewer groups than shards leaves shards empty; an empty
    table gives no rows. Null source or language is a value of its own.
    """
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(-1)).cast("long")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        fingerprint(F.col("text")).alias("th"),
        code("source").alias("s"),
        code("lang").alias("l"),
    )
    rows = stage(rows, "rows")
    total, many = rows.agg(F.sum("size"), F.count("*")).first()
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if target_bytes is not None:
        depth = max(0, math.ceil(math.log2(max(1, total / target_bytes))))
    leaf, crowd = total / 2**depth, many / 2**depth
    groups = rows.groupBy("th", "size").agg(F.min("s").alias("s"), F.min("l").alias("l"), F.sum("size").alias("gw"), F.count("*").alias("c"))
    # at most 20 * 2**depth groups can outweigh a twentieth of a shard, and as many by rows
    heavy = F.greatest(F.col("gw") / (leaf / 40), F.col("c") / (crowd / 40))
    hot = groups.where((heavy > 2) & (F.col("c") > 1)).select("th", "size", F.ceil(heavy).cast("int").alias("np"), F.col("s").alias("gs"), F.col("l").alias("gl"))
    hot = stage(hot, "hot")
    piece = F.coalesce(F.expr("pmod(xxhash64(doc_id), np)").cast("int"), F.lit(0))
    rows = rows.join(F.broadcast(hot), ["th", "size"], "left").withColumn("piece", piece).withColumn("hot", F.col("np").isNotNull())
    rows = rows.withColumn("s", F.coalesce("gs", "s")).withColumn("l", F.coalesce("gl", "l")).drop("np", "gs", "gl")
    units = rows.groupBy("th", "size", "piece").agg(F.min("s").alias("s"), F.min("l").alias("l"), F.sum("size").alias("w"), F.first("hot").alias("hot"))
    ends = units.agg(F.min("size"), F.max("size"), F.min("s"), F.max("s"), F.min("l"), F.max("l")).first()
    tie = F.shiftrightunsigned(F.xxhash64("th.x", "piece", F.lit(7)), 64 - _HASH_BITS)
    for d, c, a, b in zip(DIMENSIONS, ("size", "s", "l"), ends[::2], ends[1::2], strict=True):
        x = F.log2(F.col(c)) if c == "size" else F.col(c).cast("double")
        first, last = (F.log2(F.lit(v)) if c == "size" else F.lit(float(v)) for v in (a, b))
        place = F.when(last > first, (x - first) / (last - first)).otherwise(F.lit(0.0))
        units = units.withColumn(d, place).withColumn(f"k_{d}", F.shiftleft(F.floor(F.col(d) * ((1 << 21) - 1)).cast("long"), _HASH_BITS) + tie)
    units = stage(units.withColumn("node", F.lit(1)), "units")
    node = F.lit(1)
    for level in range(depth):
        live = range(2**level, 2 ** (level + 1))
        at = units.withColumn("node", node)
        stats = at.groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        dims = {r["node"]: max(DIMENSIONS, key=lambda d: (r[d], -DIMENSIONS.index(d))) for r in stats}
        cut = _cuts(at, dims, {r["node"]: float(r["w"]) for r in stats}, tolerance)
        nxt = F.lit(0)
        for n in live:
            if n in cut:
                nxt = F.when(node == n, F.when(F.col(f"k_{dims[n]}") <= cut[n], 2 * n).otherwise(2 * n + 1)).otherwise(nxt)
        node = nxt
        units = stage(units.withColumn("node", node), "units") if level < depth - 1 else units.withColumn("node", node)
        node = F.col("node")
    placed = units.select("th", "size", "piece", "hot", (F.col("node") - 2**depth).cast("int").alias("shard"))
    on = ["th", "size", "piece"]
    # the pieces of hot groups, of which there are few, go to their rows; the others meet theirs by a shuffle
    out = rows.where("hot").join(F.broadcast(placed.where("hot").drop("hot")), on).unionByName(rows.where("not hot").join(placed.where("not hot").drop("hot"), on))
    out = stage(out.select("doc_id", "size", "text_crc32", F.col("th.x").alias("th"), "shard"), "placed")
    parts = max(1, -(-out.count() // 4_000))
    out = out.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, th), {parts}) as int)"))
    sums = out.groupBy("shard", "part").agg(F.count("*").alias("c"))
    ahead = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "th", "size")) - 1
    out = out.withColumn("r", inner).join(sums.select("shard", "part", ahead.alias("base")), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("r") + F.col("base")).cast("long").alias("slot"))

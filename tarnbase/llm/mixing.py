"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a seeded hash and laid end to end, a
line of words that is cut into blocks of equal length. The points of a
golden-ratio (or van der Corput) sequence are mapped through the cumulative
shares of the sources, so that any run of slots holds the sources near their
weights; the rank of a slot among its source's slots names the block it
takes. A source whose target exceeds its size starts over, up to the allowed
number of times; the last block is cut where the target is reached.

What a document gives to the mix, and where, is what the slots take of the
blocks it lies in. The mix itself is written in the order of the slots.

Cumulative sums and ranks are two-level (sums of hash buckets or of chunks of
slots first, then within them), so that no source is ordered in one task: a
source of n documents has about sqrt(n) buckets of sqrt(n) documents. Sources
themselves are ordered in one task; they must number in the thousands or less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.llm.common import fingerprint, n_words, nested, stage

#: Weights by rank of the source, repeating (fixed values of the contract).
PATTERN = (5, 2, 1)
#: Words of a block.
BLOCK = 4096
_GRID, _CHUNK = 4096, 50_000
_GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, pattern: tuple[int, ...] = PATTERN, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to the same with weight and target.

    Sources by code point, null last, get the pattern's weights in turn. The
    targets sum to share times all sizes (if most allows it); none exceeds
    most times its source's size, the excess is shared by weight among the
    others until none is above: target = min(most * size, level * weight),
    with one level for all.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, pattern))
    t = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(rank) - 1) % len(pattern) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("rest"))
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    open_ = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", F.first(fits, ignorenulls=True).over(open_))
    return t.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _points(spark, n: int, kind: str) -> DataFrame:
    i = spark.range(n).withColumnRenamed("id", "i")
    if kind == "golden":
        u = (F.col("i") + 0.5) * F.lit(_GOLDEN)
        return i.withColumn("u", u - F.floor(u))
    # van der Corput, base 2: the bits of i mirrored at the point
    return i.withColumn("u", F.conv(F.reverse(F.lpad(F.bin("i"), 52, "0")), 2, 10).cast("double") / F.lit(float(2**52)))


def schedule(sources: DataFrame, kind: str = "golden") -> DataFrame:
    """(source, slots) to one row per slot: source, rank (from 0), at (place in the schedule). Slots that the points leave missing go to the end."""
    spark = sources.sparkSession
    src = sources.where("slots > 0")
    total, n = src.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long"), F.count("*")).first()
    if not total:
        return src.select("source", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("at"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumn("hi", F.sum("slots").over(order) / F.lit(float(total))).withColumn("lo", F.col("hi") - F.col("slots") / F.lit(float(total)))
    last = F.least(F.floor(F.col("hi") * _GRID).cast("int"), F.lit(_GRID - 1))
    cells = src.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0.0)) * _GRID).cast("int"), last)))
    count = int(total * 1.02) + 16 * n + 16
    pts = _points(spark, count, kind).withColumn("cell", F.floor(F.col("u") * _GRID).cast("int"))
    hits = pts.join(cells, "cell").where("u >= lo and u < hi").select("source", "slots", "i", F.floor(F.col("i") / _CHUNK).alias("chunk"))
    hits = stage(hits, "slots")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hits = hits.withColumn("sk", key)
    per = hits.groupBy("sk", "chunk").agg(F.count("*").alias("c"))
    base = per.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("sk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("sk", "chunk").orderBy("i")) - 1
    ranked = hits.withColumn("r", within).join(base.select("sk", "chunk", "base"), ["sk", "chunk"]).withColumn("rank", F.col("r") + F.col("base"))
    ranked = ranked.where("rank < slots").select("source", "rank", F.col("i").alias("at"))
    have = per.groupBy("sk").agg(F.sum("c").alias("have"))
    short = src.withColumn("sk", key).join(have, "sk", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    more = short.select("source", F.explode(F.expr("sequence(cast(have as long), cast(slots as long) - 1)")).alias("rank")).select("source", "rank", (F.col("rank") + F.lit(count)).alias("at"))
    return ranked.unionByName(more)


def _plan(docs: DataFrame, tag: Column, pattern: tuple[int, ...] = PATTERN, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: str = "mix", kind: str = "golden") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents on their lines (row, doc_id, size, sk, start); sources (sk, source, source_size, target); what slots take (row, start, turn, words, at): of the document in row that begins at start, in the source's turn, the first so many words, from the slot at on. Rows with the same tag must be equal."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), h.alias("h"), tag.alias("row"))
    sized = stage(sized.withColumn("sk", key), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = source_targets(totals.select("source", "source_size"), pattern, share, most).withColumn("sk", key)
    goal = goal.withColumn("words", F.round("target").cast("long")).withColumn("nb", F.ceil(F.col("source_size") / block).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("slots", full * F.col("nb") + F.ceil((F.col("words") - full * F.col("source_size")) / block).cast("long"))
    goal = stage(goal.join(totals.select(key.alias("sk"), F.ceil(F.sqrt("n")).cast("long").alias("buckets")), "sk"), "goal")

    spread = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(2**32))).cast("long")
    t = sized.join(goal.select("sk", "buckets"), "sk").withColumn("bucket", spread)
    sums = t.groupBy("sk", "bucket").agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("s0", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums.select("sk", "bucket", ahead.alias("s1")), ["sk", "bucket"])
    t = stage(t.select("row", "doc_id", "size", "sk", (F.col("s0") + F.col("s1")).alias("start")), "lines")

    slots = schedule(goal.select("source", "slots"), kind).withColumn("sk", key).join(goal.select("sk", "source_size", "nb", "words"), "sk")
    turn, b = F.floor(F.col("rank") / F.col("nb")).cast("int"), (F.col("rank") % F.col("nb")).cast("long")
    upto = F.least(F.least((b + 1) * block, F.col("source_size")), F.col("words") - turn * F.col("source_size"))
    slots = slots.select("sk", b.alias("block"), turn.alias("turn"), upto.alias("upto"), "at")
    held = t.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    part = F.least(F.col("start") + F.col("size"), F.col("upto")) - F.greatest("start", F.col("block") * block)
    got = held.join(slots, ["sk", "block"]).withColumn("words", part.cast("long")).where("words > 0")
    return t, goal, got.groupBy("row", "start", "turn").agg(F.sum("words").alias("words"), F.min("at").alias("at"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """How many words of each document the mix takes, and from which slot on.

    docs: doc_id, text, source; others are ignored. options: pattern (weights
    by rank of the source), share and most (see source_targets), block (words
    of a block), seed, kind (golden or corput). Returns one row per row:
    doc_id, size, source, source_size, target, taken, first_slot (the place in
    the schedule of the first slot that takes words of it; null if none does)
    and start (the document's place on its source's line). A null or blank
    text has size 0 and nothing is taken. Null is a source, the last one. The
    order on a line is by seeded hash of doc_id, ties by doc_id and size; rows
    that repeat a document stand next to each other, each for itself. Long
    documents lie in many blocks. An empty table gives no rows.
    """
    t, goal, got = _plan(docs, F.monotonically_increasing_id(), **options)
    got = got.groupBy("row").agg(F.sum("words").alias("taken"), F.min("at").alias("first_slot"))
    out = t.join(got, "row", "left").join(goal.select("sk", "source", "source_size", "target"), "sk")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "start")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the order of the slots: each document as often as it is taken, at the slot that takes its first word; a document in which a target is reached is cut after its last taken word. Columns stay, whatever their names; n_chars, if there, is brought up to date. Documents of which nothing is taken go, so null and blank texts do; rows that are equal in all columns are taken one by one."""
    plain = lambda c: F.to_json(F.struct(c)) if docs.schema[c].dataType.typeName() in ("array", "map", "struct", "variant") else F.col(f"`{c}`")
    whole = docs.select(nested(docs), fingerprint(*map(plain, docs.columns)).alias("row"))
    t, _, got = _plan(whole.select("d.doc_id", "d.text", "d.source", "row"), F.col("row"), **options)
    # by plain columns, so that the texts are dealt by them once for both steps
    key = [F.col(f"row.{c}").alias(c) for c in ("x", "y")]
    takes = got.join(t.select("row", "start", "size"), ["row", "start"]).select(*key, "start", "turn", "words", "at", "size").distinct()
    out = whole.select("d", *key).dropDuplicates(["x", "y"]).join(takes, ["x", "y"]).orderBy("at", "start", "turn")
    cut = F.expr(r"regexp_extract(d.text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', words, '}+'), 0)")
    new = {"text": F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])

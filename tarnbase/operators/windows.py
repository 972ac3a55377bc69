"""Sequences: turns, contexts, neighbours, islands, gaps, caps and paging.

Orders are total (ties broken by a row id), so results do not depend on how
rows are dealt to partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def samples_per_key(df: DataFrame, key: str, n: int, first: Column, time: str, tie: str) -> DataFrame:
    """At most n rows per key: those that hold `first` (say, a reply) before others, the newest first."""
    w = Window.partitionBy(key).orderBy(first.cast("int").desc(), F.desc(time), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def answer_turns(df: DataFrame, group: str, order: Sequence[str], speaker: str, eligible: str, epoch: str, mention: str | None = None, gap: int = 180) -> DataFrame:
    """df with turn: eligible messages that follow each other from one speaker, 0 to gap seconds apart, without different leading mentions. Any other message closes the turn; null where not eligible."""
    w = Window.partitionBy(group).orderBy(*order)
    prev = lambda c: F.lag(c).over(w)
    same = prev(eligible) & F.col(speaker).eqNullSafe(prev(speaker)) & (F.col(epoch) - prev(epoch)).between(0, gap)
    if mention:
        both = (F.coalesce(F.col(mention), F.lit("")) != "") & (F.coalesce(prev(mention), F.lit("")) != "")
        same &= ~(both & (F.col(mention) != prev(mention)))
    start = F.when(F.col(eligible) & ~F.coalesce(same, F.lit(False)), 1).otherwise(0)
    t = df.withColumn("__start", start)
    turn = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("turn", F.when(F.col(eligible), turn)).drop("__start")


def turn_summary(df: DataFrame, group: str, order: str, text: str, speaker: str) -> DataFrame:
    """Turns with their first and last row, number of messages and text."""
    t = df.where("turn is not null").groupBy(group, "turn")
    return t.agg(F.min(order).alias("start_row"), F.max(order).alias("end_row"), F.count("*").alias("n_messages"), F.min(speaker).alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def suppress_repeats(df: DataFrame, keys: Sequence[str], epoch: str, order: str, seconds: int = 120) -> DataFrame:
    """Drop a message that repeats one of the same keys within `seconds` of the last one *kept*. A message whose time can't be read goes if the keys were seen.

    Whether a message is kept depends on those before it only if one of them
    is within `seconds`; so a message later than all before it by more begins
    a burst of its own, and only the times of a burst are folded in order. In
    a burst only messages that others are near to need the fold at all.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.max(epoch).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = df.withColumn("__n", F.row_number().over(w)).withColumn("__fresh", F.col(epoch).isNotNull() & (before.isNull() | (F.col(epoch) > before + seconds)))
    t = t.withColumn("__burst", F.sum(F.col("__fresh").cast("long")).over(w))
    item = F.struct(F.col("__n").alias("n"), F.col(epoch).cast("double").alias("e"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("keep"))
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col(epoch).isNotNull(), item))),
        start,
        lambda a, x: F.when((x["e"] >= a["last"]) & (x["e"] - a["last"] <= seconds), a).otherwise(F.struct(x["e"].alias("last"), F.concat(a["keep"], F.array(x["n"])).alias("keep"))),
        lambda a: a["keep"],
    )
    bursts = t.groupBy(*keys, "__burst").agg(kept.alias("__keep")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.explode("__keep").alias("__m"))
    same = F.col("__n") == F.col("__m")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # the first of its keys stays even if its time can't be read
    read = t.where(F.col(epoch).isNotNull()).join(bursts, same, "left_semi")
    return read.unionByName(t.where(F.col(epoch).isNull() & (F.col("__n") == 1))).drop("__n", "__fresh", "__burst")


def context_before(df: DataFrame, group: str, order: Sequence[str], text: str, n: int = 50, name: str = "context") -> DataFrame:
    """The n messages before each, oldest first, joined by lines."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(name, F.array_join(F.collect_list(text).over(w), "\n"))


def neighbours(df: DataFrame, group: str, order: Sequence[str], is_text: Column, is_image: Column, text: str, n: int = 2) -> DataFrame:
    """For every picture the n text messages before and after it, however many other messages stand between."""
    w = Window.partitionBy(group).orderBy(*order)
    t = df.withColumn("__t", is_text).withColumn("__i", is_image)
    t = t.withColumn("__no", F.sum(F.when(F.col("__t"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pics = t.where("__i and not __t")
    words = t.where("__t").select(F.col(group).alias("__g"), F.col("__no").alias("__n2"), F.col(text).alias("__x"))
    wanted = pics.withColumn("__d", F.explode(F.array(*[F.lit(d) for d in range(-n + 1, n + 1)])))
    j = wanted.join(words, (F.col(group) == F.col("__g")) & (F.col("__no") + F.col("__d") == F.col("__n2")), "left")
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c & F.col("__x").isNotNull(), F.struct("__d", "__x")))), lambda x: x["__x"]), "\n")
    return j.groupBy(group, *order).agg(side(F.col("__d") <= 0).alias("before"), side(F.col("__d") > 0).alias("after"))


def running_number(df: DataFrame, group: str, order: Sequence[str], count: Column, name: str = "first_number") -> DataFrame:
    """The number of the first picture of each message when pictures are numbered through the group from 1."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)) + 1)


def capped(df: DataFrame, theme: str, order: Sequence[Column], per_theme: int, most: int) -> DataFrame:
    """At most per_theme rows of a theme, then at most `most` in all, by the same order."""
    t = df
    if per_theme:
        t = t.withColumn("__r", F.row_number().over(Window.partitionBy(theme).orderBy(*order))).where(F.col("__r") <= per_theme).drop("__r")
    return t.orderBy(*order).limit(most)


def evidence_order(priority: str = "priority", evidence: str = "evidence", text: str = "query") -> list[Column]:
    return [F.col(priority).asc(), (-F.log1p(F.col(evidence))).asc(), F.col(text).asc()]


def group_survivor(df: DataFrame, group: str, level: str, answer: str, tie: str) -> DataFrame:
    """One survivor of each duplicate group: the longest high answer, else the longest mid one. The others turn low, with the reason."""
    rank = F.when(F.col(level) == "high", 0).when(F.col(level) == "mid", 1).otherwise(2)
    w = Window.partitionBy(group).orderBy(rank, F.length(answer).desc(), tie)
    t = df.withColumn("__r", F.when(F.col(group).isNotNull(), F.row_number().over(w)).otherwise(1))
    lost = (F.col("__r") > 1) & (rank < 2)
    return t.withColumn("new_level", F.when(lost, "low").otherwise(F.col(level))).withColumn("reason", F.when(lost, "duplicate_in_group")).drop("__r")


def clip_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments cut to their chunk; what lies outside goes, repeats stay once. segments: chunk, title, s, e; chunks: chunk, lo, hi."""
    t = segments.join(chunks, "chunk").select("chunk", F.coalesce("title", F.lit("")).alias("title"), F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))
    return t.where("s is not null and e is not null and s <= e").distinct()


def fixed_segments(chunks: DataFrame, pages: int = 3) -> DataFrame:
    """Chunks cut into runs of `pages` pages. chunks: chunk, lo, hi."""
    t = chunks.select("chunk", "hi", F.explode(F.expr(f"sequence(lo, hi, {pages})")).alias("s"))
    return t.select("chunk", "s", F.least(F.col("s") + pages - 1, F.col("hi")).alias("e"))


def fill_gaps(segments: DataFrame, chunks: DataFrame, pages: int = 3) -> DataFrame:
    """Clipped segments, and the pages that none covers as runs of `pages`. Both as in clip_segments. Gaps come from a running maximum of the ends, so pages are never expanded."""
    have = clip_segments(segments, chunks)
    w = Window.partitionBy("chunk").orderBy("s", "e")
    ends = have.select("chunk", "s", "e").join(chunks, "chunk").select("chunk", "s", "e", "lo", "hi")
    seen = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo") - 1)
    inner = ends.select("chunk", (seen + 1).alias("lo"), (F.col("s") - 1).alias("hi"))
    last = ends.groupBy("chunk").agg(F.max("e").alias("m"))
    tail = chunks.join(last, "chunk", "left").select("chunk", F.coalesce(F.col("m") + 1, F.col("lo")).alias("lo"), "hi")
    gaps = fixed_segments(inner.union(tail).where("lo <= hi"), pages)
    return have.withColumn("is_gap", F.lit(False)).unionByName(gaps.withColumn("title", F.concat(F.lit("第"), F.col("s"), F.lit("-"), F.col("e"), F.lit("页"))).withColumn("is_gap", F.lit(True)))


def pack_pages(df: DataFrame, doc: str, page: str, size: str, most_chars: int, most_pages: int) -> DataFrame:
    """Pages packed in order into windows of at most most_chars and most_pages; a page too large on its own is a window of its own. Joined pages count one character between them. Returns doc, window, start_page, end_page."""
    acc = F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def st(s: Column, e: Column, n: Column, out: Column) -> Column:
        return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), n.cast("long").alias("n"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        p, n = x["p"], x["n"]
        one = F.array(F.struct(p.alias("s"), p.alias("e")))
        null = F.lit(None)
        fresh = lambda out: F.when(n > most_chars, st(null, null, F.lit(0), F.concat(out, one))).otherwise(st(p, p, n, out))
        grown = a["n"] + F.when((a["n"] > 0) & (n > 0), 1).otherwise(0) + n
        full = (p - a["s"] + 1 > most_pages) | ((n > 0) & (grown > most_chars))
        closed = F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))
        return F.when(a["s"].isNull(), fresh(a["out"])).when(full, fresh(closed)).otherwise(st(a["s"], p, grown, a["out"]))

    done = lambda a: F.when(a["s"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))
    items = F.array_sort(F.collect_list(F.struct(F.col(page).cast("long").alias("p"), F.col(size).cast("long").alias("n"))))
    t = df.groupBy(doc).agg(F.aggregate(items, acc, step, done).alias("w"))
    return t.select(doc, F.posexplode("w").alias("window", "w")).select(doc, "window", F.col("w.s").alias("start_page"), F.col("w.e").alias("end_page"))


def page_of(hits: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered result over several indexes."""
    w = Window.orderBy(*order)
    return hits.orderBy(*order).limit(page * size).withColumn("place", F.row_number().over(w)).where(F.col("place") > (page - 1) * size)


def high_water(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The latest time per group: what the next run starts after."""
    return df.groupBy(*keys).agg(F.max(time).alias("mark"))


def speakers(df: DataFrame, group: str, speaker: str, colleagues: Sequence[str] = ()) -> DataFrame:
    """Speakers of a chat with their number of lines, most first."""
    t = df.groupBy(group, speaker).agg(F.count("*").alias("n_lines"))
    return t.withColumn("is_colleague", F.col(speaker).isin(*colleagues) if colleagues else F.lit(False)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n_lines"), speaker)))


def question_islands(df: DataFrame, doc: str, text: str, queries: DataFrame) -> DataFrame:
    """Pieces between full stops and colons; a piece that holds a known query opens a pair and those that follow are its answer. queries: query. Returns doc, no, question, answer."""
    piece = df.select(doc, F.posexplode(F.split(text, "[。：]")).alias("pos", "piece")).where("trim(piece) <> ''").withColumn("piece", F.trim("piece"))
    known = piece.join(queries.select(F.trim("query").alias("__q")).distinct(), F.col("piece") == F.col("__q"), "left_semi").select(doc, "pos").withColumn("opens", F.lit(1))
    t = piece.join(known, [doc, "pos"], "left").fillna(0, ["opens"])
    t = t.withColumn("no", F.sum("opens").over(Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("no > 0")
    q = F.max(F.when(F.col("opens") == 1, F.col("piece")))
    a = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens") == 0, F.struct("pos", "piece")))), lambda x: x["piece"]), "。")
    return t.groupBy(doc, "no").agg(q.alias("question"), a.alias("answer"))


def merge_adjacent_texts(df: DataFrame, doc: str, order: str, kind: str, content: str) -> DataFrame:
    """Neighbouring text items as one, joined by line breaks; blank ones go."""
    w = Window.partitionBy(doc).orderBy(order)
    new = F.when((F.col(kind) == "text") & (F.lag(kind).over(w) == "text"), 0).otherwise(1)
    t = df.withColumn("__n", new).withColumn("island", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n")
    out = t.groupBy(doc, "island").agg(F.min(kind).alias(kind), text.alias(content), F.min(order).alias(order))
    return out.where((F.col(kind) != "text") | (F.trim(content) != "")).drop("island")


def in_order(df: DataFrame, keys: Sequence[str], order: str, fn, schema: str) -> DataFrame:
    """Run a sequential algorithm over each group in a declared order: fn takes and returns a pandas frame. For algorithms whose next step depends on all steps before; a group must fit in one worker."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)

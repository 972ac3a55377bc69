"""Greedy clusterings whose result depends on an order, and an order-free one.

The greedy ones run over each group in a declared total order in one worker;
they are meant for the groups they name (a platform's questions, a client's
queries). Where a group is too large, the order-free variant counts the links
of every text and gives the pairs of different ones, to be merged on the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: str, b: str) -> float:
    x, y = set(a or ""), set(b or "")
    return len(x & y) / len(x | y) if x and y else 0.0


def overlap_ratio(a: str, b: str) -> float:
    """Of normalised texts: 1 if one contains the other, else shared characters by the smaller set."""
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 1.0
    x, y = set(a), set(b)
    return len(x & y) / min(len(x), len(y))


def levenshtein_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`; rows are cut to the band that can matter."""
    if abs(len(a) - len(b)) > most:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != b[j - 1]))
        if min(row) > most:
            return False
        prev = row
    return prev[-1] <= most


def qa_dedup(df: DataFrame, platform: str = "platform", key: str = "id", q: str = "q", a: str = "a", q_above: float = 0.9, a_above: float = 0.8, no_answer: str = "未提供答案") -> DataFrame:
    """Question-answer pairs without near repeats: longest answers first, a pair goes if its question, or an answer that is one, is too like a kept one of its platform."""
    cols = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf[a].fillna("").str.len()).sort_values(["_n", key], ascending=[False, True], kind="stable")
        kept: list[tuple[str, str]] = []
        keep = []
        for x, y in zip(pdf[q].fillna(""), pdf[a].fillna(""), strict=True):
            ok = not any(jaccard(x, p) > q_above or (jaccard(y, r) > a_above and no_answer not in y) for p, r in kept)
            keep.append(ok)
            if ok:
                kept.append((x, y))
        return pdf[keep][cols]

    return df.groupBy(platform).applyInPandas(run, df.schema)


def chat_dedup(df: DataFrame, group: str, key: str = "id", q: str = "q", a: str = "a") -> DataFrame:
    """Pairs of a chat without repeats: like questions (0.86), or nearly equal answers (0.95) to somewhat like questions (0.55); of nearly equal answers the shorter question stays, in the place of the first."""
    from tarnbase.functions.text import qa_key

    cols = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        kept: list[int] = []
        for i in range(len(pdf)):
            x, y = pdf.at[i, "_q"], pdf.at[i, "_a"]
            if not x or not y:
                continue
            for at, k in enumerate(kept):
                s, t = overlap_ratio(pdf.at[k, "_q"], x), overlap_ratio(pdf.at[k, "_a"], y)
                if s >= 0.86 or (t >= 0.95 and s >= 0.55):
                    if t >= 0.95 and len(pdf.at[i, q]) < len(pdf.at[k, q]):
                        kept[at] = i
                    break
            else:
                kept.append(i)
        return pdf.loc[kept, cols]

    return df.withColumn("_q", qa_key(q)).withColumn("_a", qa_key(a)).groupBy(group).applyInPandas(run, df.schema)


def regroup(df: DataFrame, platform: str = "platform", key: str = "id", group: str = "group", q: str = "q", a: str = "a") -> DataFrame:
    """df with regroup: the number, in order of appearance within the platform, of the first earlier pair that is alike or has the same group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", regroup long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        out: list[int] = []
        n = 0
        for i in range(len(pdf)):
            g = pdf.at[i, group]
            hit = next((out[k] for k in range(i) if (g is not None and pdf.at[k, group] == g) or jaccard(pdf.at[i, q], pdf.at[k, q]) > 0.9 or (jaccard(pdf.at[i, a], pdf.at[k, a]) > 0.8 and "未提供答案" not in (pdf.at[i, a] or ""))), None)
            out.append(n if hit is None else hit)
            n += hit is None
        return pdf.assign(regroup=out)

    return df.groupBy(platform).applyInPandas(run, schema)


def leaders(df: DataFrame, group: str, key: str, vec: str, threshold: float = 0.7, seeds: DataFrame | None = None) -> DataFrame:
    """(key, leader): each vector joins the most similar leader so far, if its cosine exceeds the threshold, else becomes one; seeds (same columns) are leaders from the start. In order of key within the group."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, leader {df.schema[key].dataType.simpleString()}, {group} {df.schema[group].dataType.simpleString()}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_new", key], kind="stable")
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        held = np.empty_like(x)
        names: list = []
        out = []
        for v, k, new in zip(x, pdf[key], pdf["_new"], strict=True):
            if new and names:
                s = held[: len(names)] @ v
                best = int(s.argmax())
                if s[best] > threshold:
                    out.append(names[best])
                    continue
            held[len(names)] = v
            names.append(k)
            out.append(k)
        return pd.DataFrame({key: pdf[key], "leader": out, group: pdf[group]})[pdf["_new"].to_numpy(bool)]

    t = df.select(group, key, vec).withColumn("_new", F.lit(True))
    if seeds is not None:
        t = seeds.select(group, key, vec).withColumn("_new", F.lit(False)).unionByName(t)
    return t.groupBy(group).applyInPandas(run, schema)


def two_level_leaders(df: DataFrame, user: str, key: str, vec: str, threshold: float = 0.7) -> DataFrame:
    """Leaders within each user, then among the users' leaders: key, leader (of the user), top_leader."""
    one = leaders(df, user, key, vec, threshold)
    heads = df.join(one.where(F.col(key) == F.col("leader")).select(key), key, "left_semi").withColumn("__all", F.lit(0))
    two = leaders(heads, "__all", key, vec, threshold).select(F.col(key).alias("leader"), F.col("leader").alias("top_leader"))
    return one.join(two, "leader").select(key, "leader", "top_leader")


def edit_clusters(df: DataFrame, group: str, order: str, word: str, most: int = 2, ratio: float = 0.3) -> DataFrame:
    """df with cluster: each word joins the first centre within max(most, floor(shorter length * ratio)) edits, else becomes one; blank words stand alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cluster long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        centres: list[str] = []
        out = []
        for w in pdf[word].fillna("").str.strip().str.lower():
            at = next((i for i, c in enumerate(centres) if w and c and levenshtein_within(w, c, max(most, int(min(len(w), len(c)) * ratio)))), None)
            if at is None:
                centres.append(w)
                at = len(centres) - 1
            out.append(at)
        return pdf.assign(cluster=out)

    return df.groupBy(group).applyInPandas(run, schema)


def similar_links(df: DataFrame, block: Sequence[str], key: str, q: str, above: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Texts of a block whose character sets are alike: (key, rep, n_links) of every row, and the pairs (a, b) of different sets that link, by their representatives.

    Equal sets are one class, named by its smallest key, and all its members
    link; they are counted, not expanded. Two sets can only be alike if one
    of the rarest |A| - ceil(above |A|) + 1 characters of one is in the
    other, so sets meet by those, with rarity counted over the block's sets.
    """
    from tarnbase.functions.lineage import cut
    from tarnbase.functions.similarity import chars, jaccard

    on = list(block)
    t = df.select(*on, F.col(key).alias("key"), F.array_sort(chars(q)).alias("cs"))
    sets = cut(t.groupBy(*on, "cs").agg(F.min("key").alias("rep"), F.count("*").alias("m")).where("size(cs) > 0"))
    each = sets.select(*on, "rep", F.explode("cs").alias("c"))
    rare = each.groupBy(*on, "c").agg(F.count("*").alias("df"))
    order = each.join(rare, [*on, "c"]).groupBy(*on, "rep").agg(F.array_sort(F.collect_list(F.struct("df", "c"))).alias("o"))
    need = F.greatest(F.size("o") - F.ceil(F.size("o") * above).cast("int") + 1, F.lit(1))
    probe = order.select(*on, F.col("rep").alias("a"), F.explode(F.slice("o", 1, need)).alias("p")).select(*on, "a", F.col("p.c").alias("c"))
    met = probe.join(each.select(*on, F.col("rep").alias("b"), "c"), [*on, "c"]).where("a <> b").select(*on, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: sets.select(*on, F.col("rep").alias(n), F.col("cs").alias(f"c{n}"), F.col("m").alias(f"m{n}"))
    pairs = cut(met.join(side("a"), [*on, "a"]).join(side("b"), [*on, "b"]).where(jaccard(F.col("ca"), F.col("cb")) > above).select(*on, "a", "b", "ma", "mb"))
    other = pairs.select(*on, F.col("a").alias("rep"), F.col("mb").alias("n")).unionByName(pairs.select(*on, F.col("b").alias("rep"), F.col("ma").alias("n"))).groupBy(*on, "rep").agg(F.sum("n").alias("n"))
    links = sets.join(other, [*on, "rep"], "left").select(*on, "cs", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    rows = t.join(links, [*on, "cs"], "left").select(F.col("key").alias(key), F.coalesce("rep", "key").alias("rep"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, pairs.select(*on, "a", "b")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Ordered distinct: the first row of each case-folded key."""
    w = Window.partitionBy(F.lower(F.trim(key))).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fuller(df: DataFrame, key: str, body: str, top: str) -> DataFrame:
    """Blocks harvested again, merged by key: the longer body and the smallest position."""
    return df.groupBy(key).agg(F.max_by(body, F.struct(F.length(body), F.col(body))).alias(body), F.min(top).alias(top))

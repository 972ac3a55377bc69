"""Category trees and maps that point on: closures over adjacency tables.

Trees are shallow; each level is one equi join, and a depth guard ends cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbase.functions.lineage import cut


def paths(tree: DataFrame, depth: int = 10, sep: str = "-") -> DataFrame:
    """Every node with its full path. tree: id, parent_id, name. Returns id, name, level, path, path_ids, root_id. Nodes without a known way to a root are left out."""
    node = tree.select("id", "parent_id", "name")
    step = node.where("parent_id is null").select("id", "name", F.lit(1).alias("level"), F.col("name").alias("path"), F.array("id").alias("path_ids"), F.col("id").alias("root_id"))
    out = step
    for _ in range(depth - 1):
        up = step.select(F.col("id").alias("__p"), F.col("level").alias("__l"), F.col("path").alias("__path"), F.col("path_ids").alias("__ids"), F.col("root_id").alias("__root"))
        step = node.join(up, F.col("parent_id") == F.col("__p")).where(~F.array_contains("__ids", F.col("id")))
        step = step.select("id", "name", (F.col("__l") + 1).alias("level"), F.concat_ws(sep, "__path", "name").alias("path"), F.concat("__ids", F.array("id")).alias("path_ids"), F.col("__root").alias("root_id"))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def leaf_paths(tree_paths: DataFrame) -> DataFrame:
    """Leaf names with all their full paths."""
    parents = tree_paths.select(F.explode(F.slice("path_ids", 1, F.size("path_ids") - 1)).alias("__id")).distinct()
    leaf = tree_paths.join(parents, F.col("id") == F.col("__id"), "left_anti")
    return leaf.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def with_parents(df: DataFrame, col: str, sep: str = "-") -> DataFrame:
    """Category paths completed by all their prefixes, in order of level: path, level."""
    parts = F.split(F.col(col), sep)
    t = df.where(f"trim({col}) <> '' and not startswith(trim({col}), '#')")
    t = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))).alias("path")).distinct()
    return t.withColumn("level", F.size(F.split("path", sep))).orderBy("level", "path")


def follow(links: DataFrame, most: int = 100) -> DataFrame:
    """What each key of a map ends at after following it on: src, final, hops. Stops after `most` hops. links: src, dst.

    Pointers double in length each round, so a chain of n takes log n joins.
    """
    t = cut(links.select("src", F.col("dst").alias("final"), F.lit(1).alias("hops")))
    while True:
        nxt = t.select(F.col("src").alias("__s"), F.col("final").alias("__f"), F.col("hops").alias("__h"))
        on = F.col("__f").isNotNull() & (F.col("hops") + F.col("__h") <= most)
        j = t.join(nxt, F.col("final") == F.col("__s"), "left")
        j = cut(j.select("src", F.when(on, F.col("__f")).otherwise(F.col("final")).alias("final"), F.when(on, F.col("hops") + F.col("__h")).otherwise(F.col("hops")).alias("hops"), on.alias("__on")))
        t = j.drop("__on")
        if not j.where("__on").take(1):
            return t


def name_with_fallback(rows: DataFrame, names: DataFrame, key: str = "name", category: str = "category") -> DataFrame:
    """A name as its category calls it, else as "all" does, else as it is. names: category, name, mapped."""
    own = names.select(F.col("category").alias("__c"), F.col("name").alias("__n"), F.col("mapped").alias("__m1"))
    every = names.where("category = 'all'").select(F.col("name").alias("__n2"), F.col("mapped").alias("__m2"))
    t = rows.join(own, (F.col(category) == F.col("__c")) & (F.col(key) == F.col("__n")), "left").join(every, F.col(key) == F.col("__n2"), "left")
    first = F.when(F.col("__m1") != F.col(key), F.col("__m1"))
    return t.withColumn("mapped", F.coalesce(first, "__m2", key)).drop("__c", "__n", "__m1", "__n2", "__m2")


def disambiguate(df: DataFrame, keys: tuple[str, str] = ("platform", "site"), url: str = "url") -> DataFrame:
    """Sites that collide within a platform get eight characters of their address's hash; every member does."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(keys[1], F.when(n > 1, F.concat(F.col(keys[1]), F.lit("_"), F.left(F.md5(url), F.lit(8)))).otherwise(F.col(keys[1])))


def breadth_first(links: DataFrame, start: DataFrame, depth: int = 2, most: int = 300) -> DataFrame:
    """Pages found from a start along links, up to a depth and a number: url, depth. links: src, dst; start: url."""
    seen = start.select("url", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        nxt = links.join(front.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        front = nxt.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(most)


def level_of(path: Column | str, sep: str = "-") -> Column:
    return F.size(F.split(F.col(path) if isinstance(path, str) else path, sep))

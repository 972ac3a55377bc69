"""Facets, statistics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _exploded(df: DataFrame, field: str) -> DataFrame:
    """(key) rows; an array counts once for each different member."""
    col = F.col(field)
    if df.select(col).schema[0].dataType.typeName() == "array":
        return df.select(F.explode(F.array_distinct(col)).alias("key"), "*")
    return df.select(col.alias("key"), "*").where(col.isNotNull())


def terms(df: DataFrame, field: str, size: int = 1000, sub: dict[str, Column] | None = None) -> DataFrame:
    """key, doc_count and sub-aggregates of the most frequent values; ties by key."""
    aggs = [F.count("*").alias("doc_count"), *[c.alias(n) for n, c in (sub or {}).items()]]
    return _exploded(df, field).groupBy("key").agg(*aggs).orderBy(F.desc("doc_count"), "key").limit(size)


def unique_values(df: DataFrame, field: str, size: int = 10000, counts: bool = False) -> DataFrame:
    """Different values of the active rows."""
    t = _exploded(df.where("del_flag = 0") if "del_flag" in df.columns else df, field)
    out = t.groupBy("key").agg(F.count("*").alias("doc_count")).orderBy("key").limit(size)
    return out if counts else out.select("key")


def field_statistics(df: DataFrame, field: str, top: int = 10) -> DataFrame:
    """One row: unique_count, total_docs and the top values with their counts."""
    t = _exploded(df, field).groupBy("key").agg(F.count("*").alias("c"))
    best = t.withColumn("r", F.row_number().over(Window.orderBy(F.desc("c"), "key")))
    return best.agg(F.count("*").alias("unique_count"), F.sum("c").alias("total_docs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "key", "c")))), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["c"].cast("string"))), ",").alias("top_values"))


def file_list(df: DataFrame, file_col: str = "from_file_name", types: Sequence[str] = ("qa", "segment", "doc"), size: int = 200) -> DataFrame:
    """Files with the number of rows, and by data type."""
    by = [F.count(F.when(F.col("data_type") == t, 1)).alias(f"n_{t}") for t in types]
    t = df.where(F.col(file_col).isNotNull()).groupBy(F.col(file_col).alias("file_name")).agg(F.count("*").alias("doc_count"), *by)
    return t.orderBy(F.desc("doc_count"), "file_name").limit(size)


def delete_preview(df: DataFrame, file_col: str = "from_file_name", samples: int = 10, cut: int = 120) -> DataFrame:
    """What a delete by file would remove: per file the counts by type and audit result, and samples."""
    few = F.slice(F.array_sort(F.collect_list(F.struct("id", F.left("content", F.lit(cut)).alias("content")))), 1, samples)
    per = Window.partitionBy(file_col).orderBy("id")
    sample = df.withColumn("r", F.row_number().over(per)).where(F.col("r") <= samples).groupBy(file_col).agg(few.alias("samples"))
    counts = df.groupBy(file_col).agg(F.count("*").alias("total"), *[F.count(F.when(F.col("data_type") == t, 1)).alias(f"n_{t}") for t in ("qa", "segment", "doc")], *[F.count(F.when(F.col("audit_result") == a, 1)).alias(f"audit_{str(a).replace('-', 'm')}") for a in (-1, 0, 1, 2)])
    return counts.join(sample, file_col)


def coverage(df: DataFrame, field: str) -> DataFrame:
    """total, has_count, missing_count and the share that has the field in per cent, two places; 100 if there are no rows."""
    has = F.count(F.col(field))
    return df.agg(F.count("*").alias("total"), has.alias("has_count"), (F.count("*") - has).alias("missing_count"), F.when(F.count("*") == 0, 100.0).otherwise(F.round(has * 100.0 / F.count("*"), 2)).alias("rate"))


def value_distribution(df: DataFrame, field: str, top: int = 20) -> DataFrame:
    """The top values and "missing"."""
    t = df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "value").limit(top + 1)


def candidate_stats(df: DataFrame, text: str, message: str = "msg_id", row: str = "id", customer: str = "customer", category: str = "category", time: str = "create_time") -> DataFrame:
    """Per text: different messages (or rows, where a message has no id), customers and categories in order, last time."""
    ident = F.coalesce(F.nullif(F.col(message).cast("string"), F.lit("")), F.col(row).cast("string"))
    lists = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",")
    return df.groupBy(F.col(text).alias("query")).agg(F.count_distinct(ident).alias("cnt"), lists(customer).alias("customers"), lists(category).alias("categories"), F.max(time).alias("last_time"))


def merge_stats(stats: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """Stats of several batches under a common key: sums, unions of the lists, the latest time, the most frequent wording."""
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split(c, ","))), lambda x: x != ""))), ",")
    best = F.max_by("query", F.struct("cnt", F.col("query")))
    t = stats.groupBy(key.alias("key")).agg(best.alias("query"), F.sum("cnt").alias("cnt"), union("customers").alias("customers"), union("categories").alias("categories"), F.max("last_time").alias("last_time"))
    return t.orderBy(F.desc("cnt"), F.desc("last_time"), "key").limit(most) if most else t


def query_dedup(df: DataFrame, text: Column, time: str = "create_time", ident: str = "msg_id", order: str = "id", samples: int = 3) -> DataFrame:
    """Different queries with count, first and last time, up to three ids in order and the place of the first."""
    t = df.withColumn("query", text).where("query <> ''")
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col(ident).isNull(), order)))
    few = F.array_sort(F.collect_list(F.when((F.col("r") <= samples) & F.col(ident).isNotNull(), F.struct("r", F.col(ident).cast("string").alias("v")))))
    return ranked.groupBy("query").agg(F.count("*").alias("count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.array_join(F.transform(few, lambda x: x["v"]), ",").alias("sample_ids"), F.min(order).alias("first_row"))


def merge_records(df: DataFrame, keep: int = 8) -> DataFrame:
    """Records of one query from several batches: evidence adds up, platforms and source queries form capped ordered unions, the most urgent priority stays. df: key, ord, query, priority, evidence, sources (array), platforms (array)."""
    union = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))), 1, n)
    return df.groupBy("key").agg(F.min_by("query", "ord").alias("query"), F.min("priority").alias("priority"), F.sum("evidence").alias("evidence"), union("sources", keep).alias("sources"), union("platforms", 1000).alias("platforms"))


def learning_report(tasks: DataFrame, rows: DataFrame) -> DataFrame:
    """Per client: tasks, users, and rows by quality, audit and qualification; tasks that did not end well count apart. tasks: client, user, run_status, qa_num; rows: client, quality_level, audit_result, is_qualified."""
    t = tasks.groupBy("client").agg(F.count("*").alias("n_tasks"), F.count(F.when(F.col("run_status") == 3, 1)).alias("n_done"), F.count_distinct("user").alias("n_users"), F.sum(F.when(F.col("run_status") == 3, F.col("qa_num")).otherwise(0)).alias("qa_total"))
    r = rows.groupBy("client").agg(*[F.count(F.when(F.col("quality_level") == q, 1)).alias(f"n_{q}") for q in ("high", "mid", "low")], F.count(F.when(F.col("audit_result") >= 1, 1)).alias("n_approved"), F.count(F.when(F.col("is_qualified"), 1)).alias("n_qualified"))
    return t.join(r, "client", "left").fillna(0)


def top_users(tasks: DataFrame, n: int = 3) -> DataFrame:
    """The users with most tasks per client, joined as text."""
    u = tasks.groupBy("client", "user").agg(F.count("*").alias("c"))
    u = u.withColumn("r", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("c"), "user"))).where(F.col("r") <= n)
    return u.groupBy("client").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "user", F.col("c").cast("string")).alias("s")))), lambda x: x["s"]), ", ").alias("top_users"))


def quality_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by quality level and qualification, per group of keys."""
    aggs = [F.count("*").alias("total"), *[F.count(F.when(F.col("quality_level") == q, 1)).alias(f"n_{q}") for q in ("high", "mid", "low")]]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def export_summary(df: DataFrame) -> DataFrame:
    """Rows per index, data type and source; totals of each level stand in rows with nulls."""
    return df.rollup("index_name", "data_type", "from_type_norm").agg(F.count("*").alias("n"))


def level_transitions(decisions: DataFrame) -> DataFrame:
    """How many rows an audit moved from which level to which."""
    return decisions.groupBy("old_level", "new_level").agg(F.count("*").alias("n"))


def prefix_frequency(df: DataFrame, text: str, n: int = 30, top: int = 20, samples: int = 3, order: str = "id") -> DataFrame:
    """The most frequent openings, white space left out; ties by first appearance."""
    t = df.withColumn("prefix", F.left(F.regexp_replace(F.col(text), r"\s+", ""), F.lit(n))).where("prefix <> ''")
    per = Window.partitionBy("prefix").orderBy(order)
    t = t.withColumn("r", F.row_number().over(per))
    out = t.groupBy("prefix").agg(F.count("*").alias("n"), F.min(order).alias("first_row"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.struct("r", F.col(text).alias("t"))))), lambda x: x["t"]).alias("samples"))
    return out.orderBy(F.desc("n"), "first_row").limit(top)


def frequent_hashes(df: DataFrame, size_col: str, hash_expr: Column, threshold: int) -> DataFrame:
    """Content hashes of more than `threshold` rows. Sizes are counted first, so contents are hashed only where a size is frequent enough."""
    sizes = df.groupBy(size_col).agg(F.count("*").alias("c")).where(F.col("c") > threshold).select(size_col)
    t = df.join(sizes, size_col, "left_semi").groupBy(hash_expr.alias("hash")).agg(F.count("*").alias("n"))
    return t.where(F.col("n") > threshold)


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("group_count", F.when(F.col(key).isNotNull(), F.count("*").over(Window.partitionBy(key))).otherwise(1))


def shares(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Values divided by their sum (per group)."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def run_totals(df: DataFrame) -> DataFrame:
    """Totals of a model run: groups, failed groups, calls. df: robot, group_name, failed, calls."""
    return df.agg(F.count("*").alias("groups"), F.count(F.when(F.col("failed"), 1)).alias("failed_groups"), F.sum("calls").alias("calls"), F.count_distinct("robot").alias("robots"))


def document_cost(df: DataFrame, text: Column, per_document: int = 100) -> DataFrame:
    """Estimated tokens and credits of all documents."""
    from tarnbase.functions.text import token_estimate

    return df.agg(F.count("*").alias("documents"), F.sum(token_estimate(text)).alias("tokens"), (F.count("*") * per_document).alias("credits"))


def knowledge_report(df: DataFrame, group: str, time: str, start: str, end: str) -> DataFrame:
    """Rows per group and day of a closed time range."""
    t = df.where(F.col(time).between(start, end))
    return t.groupBy(group, F.left(F.col(time), F.lit(10)).alias("day")).agg(F.count("*").alias("n"))


def pending_audit(df: DataFrame, aged: Column) -> DataFrame:
    """What an automatic audit would do: total, high, other, unchanged, and how many of them are soft-deleted."""
    high = F.col("quality_level") == "high"
    other = ~F.coalesce(high, F.lit(False)) & ~F.coalesce(F.col("data_type") == "segment", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    t = df.where(aged).agg(F.count("*").alias("total_count"), n(high).alias("high_count"), n(other).alias("other_count"), n(F.col("del_flag") == 1).alias("soft_deleted_count"))
    return t.withColumn("unchanged_count", F.greatest(F.col("total_count") - F.col("high_count") - F.col("other_count"), F.lit(0)))


def verdict_report(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Records per verdict with their share in per cent."""
    t = df.groupBy(verdict).agg(F.count("*").alias("n"))
    return t.withColumn("rate", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))

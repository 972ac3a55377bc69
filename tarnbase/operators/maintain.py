"""Writes as transformations: upsert, conditional update, soft delete, audit, backfill, copy.

Each takes a state and returns the next one; a sink then overwrites or merges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(state: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """state with rows put in by key; among rows of one key the last by `order` wins, and rows win over the state."""
    cols = state.columns
    new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in cols], (F.col(order) if order else F.lit(0)).alias("__o"))
    best = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__o")))).where("__r = 1").drop("__r", "__o")
    return state.join(best.select(key), key, "left_anti").select(*cols).unionByName(best)


def drop_zero_vectors(col: Column) -> Column:
    """Index entries without those whose vector is all zeros."""
    return F.filter(col, lambda i: i["embedding"].isNull() | F.exists(i["embedding"], lambda v: v != 0))


def assert_dimension(df: DataFrame, vec: str, n: int) -> DataFrame:
    """df, failing at the first vector of another length."""
    return df.withColumn(vec, F.when(F.col(vec).isNull() | (F.size(vec) == n), F.col(vec)).otherwise(F.raise_error(F.concat(F.lit(f"vector must have {n} dimensions, has "), F.size(vec).cast("string"))).cast(df.schema[vec].dataType)))


def assign(df: DataFrame, values: Mapping[str, Column | object], where: Column | None = None) -> DataFrame:
    """Set fields, dotted ones inside their struct, where a condition holds. A parent that is null or missing is an error, not created."""
    out = df
    for path, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        root, _, rest = path.partition(".")
        if root not in df.columns:
            raise ValueError(f"no such field: {root}")
        new = v.cast(df.schema[root].dataType) if not rest else F.when(F.col(root).isNull(), F.raise_error(F.lit(f"missing parent: {root}")).cast(df.schema[root].dataType)).otherwise(F.col(root).withField(rest, v))
        out = out.withColumn(root, new if where is None else F.when(where, new).otherwise(F.col(root)))
    return out


def conditional_update(df: DataFrame, values: Mapping[str, object], where: Column) -> tuple[DataFrame, DataFrame]:
    """The updated state and a one-row count of the rows concerned; rows that already hold the values count too, and none is no error."""
    return assign(df, values, F.coalesce(where, F.lit(False))), df.where(where).agg(F.count("*").alias("updated"))


def compare_and_set(state: DataFrame, updates: DataFrame, key: str = "id", version: str = "revision") -> DataFrame:
    """Updates applied only to rows whose version is still the one they were made from; versions go up by one. updates: key, expected, and the new values. Adds conflict."""
    values = [c for c in updates.columns if c not in (key, "expected")]
    u = updates.select(F.col(key).alias("__k"), "expected", *[F.col(c).alias(f"__{c}") for c in values])
    t = state.join(u, F.col(key) == F.col("__k"), "left")
    ok = F.col("__k").isNotNull() & (F.col(version) == F.col("expected"))
    t = t.withColumn("conflict", F.col("__k").isNotNull() & ~F.coalesce(F.col(version) == F.col("expected"), F.lit(False)))
    for c in values:
        t = t.withColumn(c, F.when(ok, F.col(f"__{c}")).otherwise(F.col(c)))
    return t.withColumn(version, F.when(ok, F.col(version) + 1).otherwise(F.col(version))).drop("__k", "expected", *[f"__{c}" for c in values])


def join_update(state: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Fields set from a table of updates by key; a null there leaves the field as it is."""
    values = [c for c in updates.columns if c != key]
    t = state.join(updates.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in values]), F.col(key) == F.col("__k"), "left")
    for c in values:
        t = t.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return t.drop("__k", *[f"__{c}" for c in values])


def insert_gate(new: DataFrame, duplicates: DataFrame, replace: bool = False) -> DataFrame:
    """What to do with new rows that duplicate stored ones: skip them, or let them replace. duplicates: id, other. Adds outcome (insert, skip, replace) and the ids it covers."""
    d = duplicates.groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("covers"))
    t = new.join(d, "id", "left")
    return t.withColumn("outcome", F.when(F.col("covers").isNull(), "insert").otherwise("replace" if replace else "skip"))


def cover(state: DataFrame, gated: DataFrame) -> DataFrame:
    """Stored rows that new ones replace, soft-deleted with the reason."""
    c = gated.where("outcome = 'replace'").select(F.explode("covers").alias("__k"), F.col("id").alias("by")).groupBy("__k").agg(F.min("by").alias("by"))
    t = state.join(c, F.col("id") == F.col("__k"), "left")
    return t.withColumn("del_flag", F.when(F.col("__k").isNotNull(), 1).otherwise(F.col("del_flag"))).withColumn("del_reason", F.when(F.col("__k").isNotNull(), F.concat(F.lit("cover_by_new "), F.col("by").cast("string")))).drop("__k", "by")


def upload_outcome(df: DataFrame, levels: Sequence[str] = ("high", "mid"), review: str | None = None, duplicate: str | None = None) -> DataFrame:
    """Rows of an upload with their outcome: quality not wanted, review not passed, tagged duplicate, or inserted."""
    out = F.when(~F.coalesce(F.col("quality_level").isin(*levels), F.lit(False)), "skip_quality")
    if review:
        out = out.when(F.coalesce(F.col(review), F.lit("accept")) != "accept", "skip_review")
    if duplicate:
        out = out.when(F.coalesce(F.col(duplicate), F.lit(False)), "skip_duplicate")
    return df.withColumn("outcome", out.otherwise("insert"))


def soft_delete(df: DataFrame, where: Column, flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The state with the rows marked as deleted, and a snapshot of them as they were."""
    values: dict[str, object] = {"del_flag": 1}
    if flag is not None and "flag" in df.columns:
        values["flag"] = flag
    return assign(df, values, F.coalesce(where, F.lit(False))), df.where(where)


def restore(state: DataFrame, snapshot: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Old values of a snapshot put back."""
    return join_update(state, snapshot.select(key, *fields), key)


def apply_retire(state: DataFrame, plan: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """Rows that a retire plan deletes, marked; the others as they are."""
    p = plan.where("action = 'delete'").select(F.col(key).alias("__k"))
    t = state.join(p, F.col(key) == F.col("__k"), "left")
    return t.withColumn("del_flag", F.when(F.col("__k").isNotNull(), 1).otherwise(F.col("del_flag"))).withColumn("flag", F.when(F.col("__k").isNotNull(), flag).otherwise(F.col("flag"))).drop("__k")


def backfill(df: DataFrame, values: Mapping[str, Column | object], where: Column | None = None) -> DataFrame:
    """Missing fields filled; with `where`, only there."""
    out = df
    for c, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        new = F.coalesce(F.col(c), v.cast(df.schema[c].dataType)) if c in df.columns else v
        out = out.withColumn(c, new if where is None else F.when(where, new).otherwise(F.col(c)) if c in df.columns else F.when(where, new))
    return out


def auto_audit(df: DataFrame, aged: Column) -> DataFrame:
    """Aged unaudited rows: high ones are approved, others rejected, other segments left."""
    high = F.col("quality_level") == "high"
    other = ~F.coalesce(high, F.lit(False)) & ~F.coalesce(F.col("data_type") == "segment", F.lit(False))
    return df.withColumn("audit_result", F.when(aged & high, 2).when(aged & other, 0).otherwise(F.col("audit_result")))


def drop_paths(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """df without fields, dotted ones dropped inside their struct; unknown ones are ignored."""
    out = df
    for p in paths:
        root, _, rest = p.partition(".")
        if root in out.columns:
            out = out.withColumn(root, F.col(root).dropFields(rest)) if rest else out.drop(root)
    return out


def drop_matching(df: DataFrame, part: str = "embedding") -> DataFrame:
    """df without any field, at any depth, whose name holds `part`."""
    def keep(dt: T.DataType, col: Column) -> Column | None:
        if isinstance(dt, T.StructType):
            fields = [(f.name, keep(f.dataType, col[f.name])) for f in dt if part not in f.name]
            return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in fields if c is not None])) if fields else None
        if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
            return F.transform(col, lambda x: keep(dt.elementType, x))
        return col

    return df.select(*[keep(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema if part not in f.name])


def vector_fields(df: DataFrame) -> list[str]:
    """Dotted names of the fields that hold vectors of floats."""
    def walk(dt: T.DataType, name: str) -> list[str]:
        if isinstance(dt, T.ArrayType):
            return [name] if isinstance(dt.elementType, (T.FloatType, T.DoubleType)) else walk(dt.elementType, name)
        return [x for f in dt for x in walk(f.dataType, f"{name}.{f.name}")] if isinstance(dt, T.StructType) else []

    return [x for f in df.schema for x in walk(f.dataType, f.name)]


def same_schema(expected: T.StructType, got: T.StructType) -> list[str]:
    """What keeps two schemas from being the same: missing, further and differently typed fields."""
    e, g = ({f.name: f.dataType.simpleString() for f in s} for s in (expected, got))
    return [f"missing {n}" for n in e if n not in g] + [f"unknown {n}" for n in g if n not in e] + [f"{n} is {g[n]}, not {e[n]}" for n in e if n in g and e[n] != g[n]]


def get(df: DataFrame, key: object, indexes: Sequence[str], id_col: str = "id") -> DataFrame:
    """The row of an id in the first index that has it."""
    place = F.array_position(F.array(*map(F.lit, indexes)), F.col("index_name"))
    return df.where((F.col(id_col) == key) & F.col("index_name").isin(*indexes)).orderBy(place).limit(1)


def delete(df: DataFrame, keys: Sequence[object], id_col: str = "id") -> DataFrame:
    return df.where(~F.col(id_col).isin(*keys))


def keyset_page(df: DataFrame, last: object | None, n: int, key: str = "id") -> DataFrame:
    """The next n rows after a key."""
    return (df.where(F.col(key) > last) if last is not None else df).orderBy(key).limit(n)


def current_state(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def insert_unique(state: DataFrame, rows: DataFrame, business_key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The state with rows whose business key is new, and the rows refused. Among new rows of one key the first wins."""
    taken = state.select(*business_key).distinct()
    clash = rows.join(taken, list(business_key), "left_semi")
    fresh = rows.join(taken, list(business_key), "left_anti").dropDuplicates(list(business_key))
    return state.unionByName(fresh, allowMissingColumns=True), clash


def prepare(df: DataFrame, schema_fields: Sequence[str], now: str, embed=None, keywords=None) -> DataFrame:
    """Rows made ready to be stored.

    Unknown fields move into ext_info (a JSON text); new rows (without id)
    get defaults for audit, level, deletion, times and source kind; texts to
    index come from the title, its synonyms and the pictures' texts, blank
    and repeated ones left out; segments lose their titles. embed and
    keywords are injected functions from a text column to a column.
    """
    from tarnbase.functions.text import data_id, source_kind, text

    unknown = [c for c in df.columns if c not in schema_fields and c not in ("id", "ext_info")]
    t = df
    if unknown:
        t = t.withColumn("ext_info", F.to_json(F.struct(*unknown)))
    has = lambda c, k: F.col(c) if c in df.columns else F.lit(None).cast(k)
    new = has("id", "string").isNull()
    title = F.when(has("data_type", "string") == "segment", F.lit(None).cast("string")).otherwise(has("title", "string"))
    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce(has("image_texts", "array<string>"), none), F.array(has("title", "string")), F.coalesce(has("synonyms_title", "array<string>"), none))
    audit = F.when(has("audit_result", "int").isin(-1, 0, 1, 2), has("audit_result", "int")).when(has("audit_result", "int").isNotNull() | new, -1)
    level = F.when(has("quality_level", "string").isin("high", "mid", "low") | ~new, has("quality_level", "string")).otherwise("mid")
    from_type = F.when(has("from_type", "string").isNull() & new, "unknown").otherwise(has("from_type", "string"))
    file_name = F.get_json_object("ext_info", "$.from_file_name") if "ext_info" in t.columns else F.lit(None).cast("string")
    t = t.withColumns({
        "index_texts": F.array_distinct(F.filter(texts, lambda s: s.isNotNull() & (F.trim(s) != ""))),
        "audit_result": audit,
        "quality_level": level,
        "from_type": from_type,
        "from_type_norm": F.coalesce(has("from_type_norm", "string"), F.when(new, source_kind(from_type, file_name))),
        "del_flag": F.coalesce(has("del_flag", "int"), F.when(new, 0)),
        "insert_time": F.coalesce(has("insert_time", "string"), F.when(new, now)),
        "update_time": F.lit(now),
    })
    t = t.withColumn("id", F.coalesce(has("id", "string"), data_id(text(has("title", "string")), text(has("content", "string")), text(has("data_type", "string"))))).withColumn("title", title)
    if embed:
        t = t.withColumn("title_embedding", embed(F.col("title"))).withColumn("content_embedding", embed(F.col("content")))
    if keywords:
        t = t.withColumn("keywords", keywords(F.col("content")))
    return t.drop(*unknown)

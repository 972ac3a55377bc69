"""Versioned ontology documents: validation, scope selection, ranking, status."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbase.functions.text import text

#: Ranks of a match by name, alias, description and content.
MATCH_SCORES = (100, 90, 70, 50, 20)

DOCUMENT = "schema_version string, name string, alias_name array<string>, client string, product string, language string, object_types array<struct<name:string,identity:array<string>,attributes:array<struct<name:string,data_type:string,item_type:string,value_set:string,ref:string>>>>, relations array<struct<name:string,subject:string,predicate:string,object:string,cardinality:string>>, value_sets array<struct<name:string,values:array<struct<value:string,label:string>>>>, rules array<struct<name:string,condition:string,effect:string,severity:string,applies_to:array<string>>>, terms array<struct<name:string,description:string,refers_to:string>>"


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded; there is no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold().strip())


def parse(df: DataFrame, col: str = "data_json") -> DataFrame:
    return df.withColumn("doc", F.from_json(col, DOCUMENT))


def select_scope(df: DataFrame, client: str, product: str, name: str | None = None) -> DataFrame:
    """The document that serves a scope: exact client counts 2, exact product 1; common ones are the fallback; ties prefer no product, then the newest. df: id, client, product, name, status, audit_status, del_flag, update_time."""
    t = df.where("del_flag = 0 and status = 'active' and audit_status = 'approved'").where(F.col("client").isin(client, ""))
    t = t.where((F.col("product") == product) | (F.col("client") == client)) if client and not product else t.where(F.col("product").isin(product, ""))
    if name:
        t = t.where(F.col("name") == name)
    rank = F.when((F.col("client") == client) & F.lit(client != ""), 2).otherwise(0) + F.when((F.col("product") == product) & F.lit(product != ""), 1).otherwise(0)
    t = t.withColumn("scope_rank", rank)
    return t.orderBy(F.desc("scope_rank"), (F.col("product") == "").desc(), F.desc("update_time"), F.desc("id")).limit(1)


def scope_label(client: Column, product: Column, want_client: str, want_product: str) -> Column:
    """(scope, fallback): how wide the scope of a row is, and whether it is not the one asked for."""
    s = F.when(client.isNull(), "none").when((client == "") & (product == ""), "global").when(client == "", "industry").when(product == "", "client").otherwise("client_product")
    return F.struct(s.alias("scope"), (~F.coalesce((client == want_client) & (product == want_product), F.lit(False))).alias("fallback"))


def match_score(q: str, name: str = "name", aliases: str = "alias_name", description: str = "description", data: str | None = None) -> Column:
    """100 for the name, 90 for an alias, 70 for a part of the name, 50 of the description, 20 of the content; null for no match."""
    low = q.lower()
    s = F.when(F.lower(name) == low, MATCH_SCORES[0]).when(F.exists(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.lower(a) == low), MATCH_SCORES[1])
    s = s.when(F.lower(name).contains(low), MATCH_SCORES[2]).when(F.lower(text(description)).contains(low), MATCH_SCORES[3])
    return s.when(F.lower(text(data)).contains(low), MATCH_SCORES[4]) if data else s


def ranked_list(df: DataFrame, q: str | None = None, where: Column | None = None, deep: str | None = None, deleted: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of documents, best match first, then the newest, with the total of all pages."""
    from pyspark.sql import Window

    t = df if deleted else df.where("del_flag = 0")
    if where is not None:
        t = t.where(where)
    t = t.withColumn("q_score", match_score(q, data=deep)) if q else t.withColumn("q_score", F.lit(0))
    if q:
        t = t.where("q_score is not null")
    t = t.withColumn("total", F.count("*").over(Window.partitionBy()))
    return t.orderBy(F.desc("q_score"), F.desc("update_time"), F.desc("id")).offset(offset).limit(limit)


def duplicate_names(df: DataFrame, key: str, path: str, names: Column) -> DataFrame:
    """Names that occur twice in one list of a document, folded."""
    t = df.select(key, F.explode(names).alias("name")).withColumn("folded", nfkc_fold("name"))
    return t.groupBy(key, "folded").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1").select(key, F.lit(path).alias("path"), F.lit("duplicate_name").alias("issue"), "name")


def broken_references(df: DataFrame, key: str, targets: Column, refs: Column, path: str) -> DataFrame:
    """References that no target of the same document has."""
    have = df.select(key, F.explode(targets).alias("name")).distinct()
    want = df.select(key, F.explode(F.filter(refs, lambda r: r.isNotNull() & (r != ""))).alias("name")).distinct()
    return want.join(have, [key, "name"], "left_anti").select(key, F.lit(path).alias("path"), F.lit("unknown_reference").alias("issue"), "name")


def combination_issues(df: DataFrame, key: str) -> DataFrame:
    """Attributes whose fields do not go together: enumerations need a value set, references a target, lists a member type; others must not have them."""
    a = df.select(key, F.explode("doc.object_types").alias("o")).select(key, F.col("o.name").alias("object"), F.explode("o.attributes").alias("a")).select(key, "object", "a.*")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    need = F.when((F.col("data_type") == "enum") != has("value_set"), "value_set").when((F.col("data_type") == "ref") != has("ref"), "ref").when((F.col("data_type") == "array") != has("item_type"), "item_type")
    return a.withColumn("field", need).where("field is not null").select(key, F.concat_ws(".", "object", "name").alias("path"), F.lit("field_combination").alias("issue"), F.col("field").alias("name"))


def validate(df: DataFrame, key: str = "id", most_bytes: int = 1 << 20, reserved: Sequence[str] = ("id", "revision", "status")) -> DataFrame:
    """All issues of parsed documents (see parse): key, path, issue, name. A document without rows here is valid."""
    names = lambda c: F.transform(F.coalesce(F.col(f"doc.{c}"), F.array().cast(df.schema["doc"].dataType[c].dataType)), lambda x: x["name"])
    unread = df.where("doc is null").select(key, F.lit("").alias("path"), F.lit("unreadable").alias("issue"), F.lit("").alias("name"))
    large = df.where(F.octet_length("data_json") > most_bytes).select(key, F.lit("").alias("path"), F.lit("too_large").alias("issue"), F.lit("").alias("name"))
    ok = df.where("doc is not null")
    own = ok.select(key, F.explode(F.json_object_keys("data_json")).alias("name")).where(F.col("name").isin(*reserved)).select(key, F.lit("").alias("path"), F.lit("reserved_field").alias("issue"), "name")
    attrs = F.flatten(F.transform(F.coalesce("doc.object_types", F.array().cast(df.schema["doc"].dataType["object_types"].dataType)), lambda o: o["attributes"]))
    ends = F.concat(F.transform("doc.relations", lambda r: r["subject"]), F.transform("doc.relations", lambda r: r["object"]))
    issues = [unread, large, own, combination_issues(ok, key)]
    issues += [duplicate_names(ok, key, c, names(c)) for c in ("object_types", "relations", "value_sets", "rules", "terms")]
    issues.append(duplicate_names(ok, key, "alias_name", F.concat(F.array("doc.name"), F.coalesce("doc.alias_name", F.array().cast("array<string>")))))
    issues.append(broken_references(ok, key, names("object_types"), F.coalesce(ends, F.array().cast("array<string>")), "relations"))
    issues.append(broken_references(ok, key, names("value_sets"), F.transform(attrs, lambda a: a["value_set"]), "attributes.value_set"))
    issues.append(broken_references(ok, key, names("object_types"), F.transform(attrs, lambda a: a["ref"]), "attributes.ref"))
    out = issues[0]
    for i in issues[1:]:
        out = out.unionByName(i)
    return out

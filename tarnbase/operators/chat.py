"""Chat messages: speakers, rooms, pictures, formatting and the steps from raw lines to rooms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbase.functions import text as X
from tarnbase.operators import noise as N
from tarnbase.operators import windows as W

#: Fixed schema of a message, with its historical spelling of the content's key.
MESSAGE = "send_user string, send_user_id string, actual_user_id string, actual_user_nickname string, from_user_id string, from_user_nickname string, group_name string, conent string, content string, ctype string, msg_id string"


def speaker(fallback: Column | None = None) -> Column:
    """Who speaks: the actual user, else the sender, by nickname or id, else the fallback."""
    cols = [F.nullif(F.col(c), F.lit("")) for c in ("actual_user_nickname", "actual_user_id", "from_user_nickname", "from_user_id", "send_user")]
    return F.coalesce(*cols, fallback if fallback is not None else F.lit(""))


def to_wire(df: DataFrame, name: str = "from_user_nickname", ident: str = "from_user_id", time: str = "create_time") -> DataFrame:
    """History rows as lines of name, time and JSON."""
    body = F.to_json(F.struct(*[c for c in df.columns if c not in (time,)]))
    return df.select(F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(ident)).alias("send_name"), F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time"), body.alias("json"))


def read_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of name, time and JSON as messages; lines that can't be read go."""
    p = F.split(F.col(col), "\t", 3)
    t = lines.where(F.size(p) == 3).select(p[0].alias("send_name"), X.message_time(p[1]).alias("message_time"), F.from_json(p[2], MESSAGE).alias("m")).where("m is not null")
    return t.select("send_name", "message_time", "m.*").withColumn("content", F.coalesce("content", "conent")).drop("conent")


def rooms(messages: DataFrame, marks: DataFrame | None = None, order: str = "msg_id", rules: N.NoiseRules = N.NoiseRules(), seconds: int = 120) -> DataFrame:
    """Messages cleaned, classified, rid of noise and repeats, and grouped by room in order of time; what a room's mark already covers is skipped."""
    t = messages.withColumn("content", X.sanitise_chat("content")).withColumn("speaker", speaker(F.col("send_name")))
    if marks is not None:
        t = t.join(marks.select(F.col("group_name").alias("__g"), "mark"), F.col("group_name") == F.col("__g"), "left").where(F.col("mark").isNull() | (F.col("message_time") > F.col("mark"))).drop("__g", "mark")
    image = X.kind_is("ctype", X.IMAGE_KINDS)
    mixed = X.kind_is("ctype", X.MIXED_KINDS)
    t = t.withColumn("kind", F.when(image, "image").when(mixed, "mixed").when(X.kind_is("ctype", X.TEXT_KINDS), "text").otherwise("other")).where("kind <> 'other'")
    t = t.where((F.col("kind") == "image") | ~N.is_noise("content", rules, clean=True) | ((F.col("kind") == "mixed") & N.keep_image_of_noise("content", rules, clean=True)))
    t = t.withColumn("epoch", X.message_epoch("message_time"))
    return W.suppress_repeats(t, ["group_name", "speaker", "content"], "epoch", order, seconds)


def room_config(lines: DataFrame, only: str = "all", col: str = "value") -> DataFrame:
    """Rooms and their types of tab-separated lines; comments and blank lines are skipped."""
    p = F.split(F.col(col), "\t")
    t = lines.where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.trim(p[0]).alias("robot"), F.trim(F.try_element_at(p, F.lit(2))).alias("group_name"), F.trim(F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("chat"))).alias("room_type"))
    return t if only == "all" else t.where(F.col("group_name") == only)


def allowed_rooms(messages: DataFrame, white: DataFrame | None, black: DataFrame | None, robot: str = "robot", group: str = "group_name") -> DataFrame:
    """Messages of white-listed robots outside black-listed groups."""
    t = messages
    if white is not None:
        t = t.join(white.select(robot).distinct(), robot, "left_semi")
    return t.join(black.select(group).distinct(), group, "left_anti") if black is not None else t


def image_payload(content: Column, supplement: Column, label: str = "[图片]") -> Column:
    """A picture message as a label, its first address and, if there are more, all of them."""
    found = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", content, supplement), F.lit(r"(?i)(?:https?|s3|oss|cos|minio)://[^\s\"'<>,，]+"), F.lit(0)))
    found = F.filter(found, X.is_image_address)
    return F.struct(F.lit(label).alias("content"), F.try_element_at(found, F.lit(1)).alias("address"), F.when(F.size(found) > 1, found).alias("addresses"))


def message_line(index: Column | None, time: Column, role: Column, name: Column, purpose: Column, content: Column) -> Column:
    """A message as a model reads it: on one line."""
    head = F.concat(F.lit("["), time, F.lit("] "), role, F.lit("("), name, F.lit(")"))
    line = F.concat(head, F.when(X.text(purpose) != "", F.concat(F.lit(" <"), purpose, F.lit(">"))).otherwise(""), F.lit(": "), F.regexp_replace(content, r"\s*\n\s*", " / "))
    return line if index is None else F.concat(index.cast("string"), F.lit(". "), line)


def merge_supplements(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Supplements merged: pictures once per label and address, missing attributes filled from later copies; notes distinct in order. df: keys, order, images (array of struct with label, address, note), notes (array)."""
    img = df.select(*keys, order, F.posexplode("images").alias("p", "i")).select(*keys, order, "p", "i.*")
    one = img.groupBy(*keys, "label", "address").agg(F.min_by("note", F.when(F.col("note").isNotNull(), F.struct(order, "p"))).alias("note"), F.min(F.struct(order, "p")).alias("at"))
    pics = one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct("label", "address", "note").alias("i")))), lambda x: x["i"]).alias("images"))
    notes = df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "notes"))), lambda x: x["notes"]))).alias("notes"))
    return notes.join(pics, list(keys), "left")


def same_images(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: F.exists(b, lambda y: (x["label"] == y["label"]) | (x["address"] == y["address"])))


def normalise_candidates(df: DataFrame, default_platform: str | None = None) -> DataFrame:
    """A model's items as candidates: question and answer under either name, de-identified unless the answer is a picture, levels and scopes by their main names; empty ones go."""
    has = lambda *cs: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs if c in df.columns], F.lit(""))
    q, a = has("q", "question"), has("a", "answer")
    t = df.withColumn("__q0", q).withColumn("__a0", a)
    t = X.generalise_column(X.generalise_column(t, "__q0", "__q"), "__a0", "__a1")
    t = t.withColumn("__a", F.when(X.is_image_answer("__a0"), F.col("__a0")).otherwise(F.col("__a1"))).drop("__q0", "__a0", "__a1")
    t = t.where("__q <> '' and __a <> ''")
    for c, f in (("quality_level", X.level), ("reuse_scope", X.scope), ("confidence", X.confidence), ("is_qualified", X.flag)):
        if c in df.columns:
            t = t.withColumn(c, f(c))
    if default_platform is not None:
        t = t.withColumn("platform", F.coalesce(F.nullif(F.col("platform"), F.lit("")), F.lit(default_platform)) if "platform" in df.columns else F.lit(default_platform))
    return t.drop(*[c for c in ("q", "question", "a", "answer") if c in df.columns]).withColumnRenamed("__q", "q").withColumnRenamed("__a", "a")


def buckets(df: DataFrame, level: str = "quality_level", *, rows: Sequence[str]) -> DataFrame:
    """Rows gathered by level; unknown levels count as mid."""
    t = df.withColumn("bucket", F.when(F.col(level).isin("high", "mid", "low"), F.col(level)).otherwise("mid"))
    return t.groupBy("bucket").agg(F.collect_list(F.struct(*rows)).alias("rows"))


def generalise_by_rule(df: DataFrame, themes: dict[str, Sequence[str]], platforms: dict[str, list[str]], other: str = "其他") -> DataFrame:
    """Candidates to records without a model: priority by count, theme and platform by the first keyword, the text as a question. df: query, cnt."""
    t = df.withColumn("text", X.chat_line("query"))
    theme = None
    for name, words in themes.items():
        hit = X.contains_any("text", words)
        theme = F.when(hit, name) if theme is None else theme.when(hit, name)
    first = F.try_element_at(X.platform_names("text", platforms), F.lit(1))
    return t.select("query", X.sanitise_query("text").alias("question"), (theme.otherwise(other) if theme is not None else F.lit(other)).alias("theme"), F.coalesce(first, F.lit("")).alias("platform"), F.when(F.col("cnt") >= 20, "P0").when(F.col("cnt") >= 5, "P1").otherwise("P2").alias("priority"), F.col("cnt").alias("evidence"))


def sample_evenly(df: DataFrame, by: str, ident: str, total: int, seed: int = 0) -> DataFrame:
    """A seeded sample split evenly: the first `remainder` groups, in order of name, get one more."""
    from pyspark.sql import Window

    groups = df.select(by).distinct()
    n = groups.count()
    if not n:
        return df.limit(0)
    base, more = divmod(total, n)
    quota = groups.withColumn("__q", F.lit(base) + F.when(F.row_number().over(Window.orderBy(by)) <= more, 1).otherwise(0))
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident)
    return df.withColumn("__r", F.row_number().over(w)).join(quota, by).where("__r <= __q").drop("__r", "__q")


def recent_queries(df: DataFrame, text: str, time: str, limit: int = 1000) -> DataFrame:
    """Different queries, case folded, the newest of each, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower(F.trim(text))).orderBy(F.desc(time), text)
    return df.where(F.trim(text) != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy(F.desc(time), text).limit(limit)


def existing_contents(df: DataFrame, text: str, time: str, limit: int = 20000) -> DataFrame:
    """Normalised contents in use, the latest first."""
    t = df.where(F.trim(text) != "").groupBy(F.trim(text).alias("content")).agg(F.max(time).alias("last_time"))
    return t.orderBy(F.desc("last_time"), "content").limit(limit)

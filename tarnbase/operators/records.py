"""Candidates and segments as knowledge rows, and knowledge rows as export rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbase.functions.text import category_label, clean_cell, text

#: What else of a candidate is kept in ext_info, and what on the row itself.
EXT_FIELDS = (
    "quality_reason", "knowledge_type", "business_tags", "scenario_tags", "entity_tags", "es_tags", "reuse_scope", "should_enter_reuse_evaluation", "confidence", "source_quote",
    "candidate_answer_time", "from_user", "source", "client", "marketplace", "model_platform", "supplement", "supplement_mapping_error", "source_message_ids", "source_user_id",
    "source_identity", "source_identity_reason", "is_qualified", "from_chat_history",
)
ROW_FIELDS = (
    "review_decision", "review_reason_codes", "review_reason", "review_model", "review_version", "extractor_quality_level", "grounded", "knowledge_scope", "sensitive", "temporary",
    "valid_until", "auto_import",
)
#: A placeholder of a picture in a text.
PLACEHOLDER = r"\[图(\d+)\]"


def file_source(name: Column | str) -> Column:
    """The kind of source that a file's name tells."""
    n = F.lower(text(name))
    return F.when(n.endswith(".pdf"), "pdf").when(n.endswith(".doc") | n.endswith(".docx"), "doc").when(n.endswith(".html") | n.startswith("http"), "html").otherwise("doc")


def categories(ids: Column, names: Column, source: str = "manual") -> Column:
    """Comma-separated ids and names side by side as candidates with score 1."""
    parts = lambda c: F.filter(F.transform(F.split(text(c), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.zip_with(parts(ids), parts(names), lambda i, n: F.struct(i.alias("category_id"), n.alias("category_name"), F.lit(1.0).alias("score"), F.lit(source).alias("source")))


def _ext(df: DataFrame, always: dict[str, Column]) -> Column:
    cols = [c.alias(n) for n, c in always.items()] + [F.col(c) for c in EXT_FIELDS if c in df.columns and c not in always]
    return F.to_json(F.struct(*cols))


def _common(df: DataFrame, platform: str | None, task: str | None) -> dict[str, Column]:
    has = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    p = F.coalesce(has("platform"), F.lit(platform))
    out = {"platform": p, "client": F.coalesce(has("client"), p), "audit_result": F.lit(-1)}
    if task is not None:
        out |= {"task_id": F.lit(task), "flag": F.coalesce(has("flag"), F.lit(task))}
    elif "flag" in df.columns:
        out["flag"] = F.col("flag")
    if "category_infos" in df.columns:
        out["category_infos"] = F.col("category_infos")
    else:
        out["category_infos"] = categories(has("category_id"), F.coalesce(has("category_name"), has("category")))
    return out


def qa_to_knowledge(df: DataFrame, platform: str | None = None, task: str | None = None, from_type: str | None = None) -> DataFrame:
    """Question-answer candidates (q, a, from_file_name, …) as unaudited knowledge rows: the question is the title and the text to index; candidates of a chat group come from a chat, others from the kind of their file."""
    has = lambda c, k="string": F.col(c) if c in df.columns else F.lit(None).cast(k)
    kind = F.when(text(has("group_name")) != "", "chat").otherwise(file_source(has("from_file_name"))) if "group_name" in df.columns else file_source(has("from_file_name"))
    ext = _ext(df, {"from_file_name": text(has("from_file_name")), "from_page": has("from_page", "array<int>"), "quality_info": has("quality_info", "array<string>")})
    cols = {"title": text("q"), "content": text("a"), "data_type": F.lit("qa"), "quality_level": text(has("quality_level")), "from_type": F.lit(from_type) if from_type else kind, "indexes": F.array(F.struct(text("q").alias("text"))), "ext_info": ext}
    if "tags" in df.columns:
        cols["tags"] = F.col("tags")
    cols |= _common(df, platform, task) | {c: F.col(c) for c in ROW_FIELDS if c in df.columns}
    return df.select(*[c.alias(n) for n, c in cols.items()])


def segment_to_knowledge(df: DataFrame, platform: str | None = None, task: str | None = None, html: bool = False) -> DataFrame:
    """Segments (content, keywords, topics, from_file_name, from_page, …) of documents or pages as unaudited knowledge rows without titles; keywords, phrases and topics are the texts to index."""
    has = lambda c, k="string": F.col(c) if c in df.columns else F.lit(None).cast(k)
    none = F.array().cast("array<string>")
    terms = F.array_distinct(F.concat(*[F.coalesce(has(c, "array<string>"), none) for c in ("keywords", "phrases", "topics")]))
    terms = F.filter(terms, lambda s: F.trim(s) != "")
    ext = _ext(df, {"from_file_name": text(has("from_file_name")), "from_page": has("from_page", "array<int>")})
    cols = {"content": text("content"), "data_type": F.lit("segment"), "quality_level": F.coalesce(F.nullif(has("quality_level"), F.lit("")), F.lit("mid")), "from_type": F.lit("html") if html else file_source(has("from_file_name")), "keywords": F.coalesce(has("keywords", "array<string>"), none), "indexes": F.transform(terms, lambda s: F.struct(s.alias("text"))), "ext_info": ext}
    return df.select(*[c.alias(n) for n, c in (cols | _common(df, platform, task)).items()])


def export_row(df: DataFrame, default_category: str = "默认分组", levels: int = 4) -> DataFrame:
    """Nested knowledge rows flattened for export, with clean cells."""
    has = lambda c: F.col(c) if c.split(".")[0] in df.columns else F.lit(None).cast("string")
    primary = "primary_category" in df.columns
    names = [F.col(f"primary_category.cate{i}_name") for i in range(1, levels + 1)] if primary else [F.lit(None).cast("string")]
    infos = F.col("category_infos") if "category_infos" in df.columns else F.array().cast("array<struct<category_id:string,category_name:string,score:double,source:string>>")
    path = F.col("primary_category.category_path") if primary else F.lit(None).cast("string")
    file = F.get_json_object("ext_info", "$.from_file_name") if "ext_info" in df.columns else has("from_file_name")
    flat = {c: text(has(c)) for c in ("dataset", "data_type", "from_type_norm", "title", "content", "quality_level", "insert_time")}
    flat |= {"from_file_name": text(file), "category_path": category_label(path, names, F.coalesce(infos, F.array().cast("array<struct<category_id:string,category_name:string,score:double,source:string>>")), default_category)}
    keep = [c for c in ("id", "index_name", "audit_result") if c in df.columns]
    return df.select(*keep, *[clean_cell(c).alias(n) for n, c in flat.items()])


def restore_placeholders(x: Column | str, urls: Column) -> Column:
    """Placeholders of pictures as markdown; urls: map from placeholder to address. Unknown ones go."""
    t = text(x)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0)))
    return F.aggregate(found, t, lambda acc, p: F.replace(acc, p, F.coalesce(F.concat(F.lit("![嵌入图片]("), F.try_element_at(urls, p), F.lit(' "Flowchart")')), F.lit(""))))


def strip_placeholders(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(x), PLACEHOLDER, ""))


def typed_items(x: Column | str, known: Sequence[str]) -> Column:
    """A text with addresses as items (type, value): known addresses as media, all else as text; blank texts go. Neighbouring texts are merged by windows.merge_adjacent_texts."""
    rx = r"(?i)https?://[^\s<>\"'`\]]+"
    texts = F.transform(F.split(text(x), rx, -1), lambda s: F.struct(F.lit("text").alias("type"), F.trim(s).alias("value")))
    urls = F.transform(F.regexp_extract_all(text(x), F.lit(rx), F.lit(0)), lambda u: F.struct(F.when(u.isin(*known), "media").otherwise("text").alias("type"), u.alias("value")))
    return F.filter(F.flatten(F.zip_with(texts, urls, lambda a, b: F.array(a, b))), lambda e: e.isNotNull() & (e["value"] != ""))


def parse_segment(x: Column | str) -> Column:
    """A model's segment: content, keywords, label and attribute from their labelled lines; what is left is the content."""
    t = text(x)
    one = lambda rx: F.nullif(F.trim(F.regexp_extract(t, rx, 1)), F.lit(""))
    keys, label, attr = r"-.*?关键词：(.*?)\n", r"-.*?图谱标签: (.*?)\n", r"-.*?属性：(.*?)$"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, keys, ""), label, ""), attr, "")
    return F.struct(rest.alias("content"), F.coalesce(F.split(one(keys), "[、, ]"), F.array().cast("array<string>")).alias("keywords"), one(label).alias("label"), one(attr).alias("attribute"))

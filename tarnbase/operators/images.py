"""Pictures of knowledge rows: which belong, which go, which are attached."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = r"\[multimodal_prefix\]([^\s\)\]]+)"


def markers(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, path) of the picture marks in a text, in order."""
    found = F.regexp_extract_all(F.col(content), F.lit(MARK), F.lit(1))
    return df.select(key, F.posexplode(found).alias("pos", "path"))


def page_index(mapping: DataFrame) -> DataFrame:
    """Pictures by file and page of a parse mapping. Those never uploaded stay (their content still counts as belonging), marked as not attachable. mapping: file, page_no, images (array of struct with md5, s3_path, fileName)."""
    t = mapping.select("file", "page_no", F.explode("images").alias("i")).select("file", "page_no", "i.*")
    return t.withColumn("attachable", F.coalesce(F.col("s3_path"), F.lit("")) != "")


def plan(marks: DataFrame, contents: DataFrame, allowed: DataFrame, pointed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """What to do with each mark: a repeat of the same content goes, one whose content is not on the row's pages goes unless a phrase points at it, the others stay. marks: key, pos, path; contents: path, md5; allowed: key, md5; pointed: key, pos."""
    t = marks.join(contents, "path", "left")
    ok = allowed.select(F.col(key).alias("__k"), F.col("md5").alias("__m")).distinct().withColumn("__on", F.lit(True))
    t = t.join(ok, (F.col(key) == F.col("__k")) & (F.col("md5") == F.col("__m")), "left").drop("__k", "__m")
    if pointed is not None:
        t = t.join(pointed.select(key, "pos").withColumn("__p", F.lit(True)), [key, "pos"], "left")
    else:
        t = t.withColumn("__p", F.lit(None).cast("boolean"))
    again = F.row_number().over(Window.partitionBy(key, F.coalesce("md5", "path")).orderBy("pos")) > 1
    off = F.col("md5").isNotNull() & F.col("__on").isNull() & F.col("__p").isNull()
    t = t.withColumn("__again", again)
    return t.select(key, "pos", "path", F.when(F.col("__again"), "drop_duplicate").when(off, "drop_page_mismatch").otherwise("keep").alias("action"))


def pointing(content: str | None, phrases: Sequence[str], window: int = 12) -> list[int]:
    """Places of marks that a phrase such as "as shown below" stands right before, with no other mark between. Phrases are found longest first and do not overlap."""
    content = content or ""
    rx = re.compile("|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))) if phrases else None
    ends = [m.end() for m in rx.finditer(content)] if rx else []
    out, last = [], 0
    for i, m in enumerate(re.finditer(MARK, content)):
        if any(last <= e <= m.start() and m.start() - e <= window for e in ends):
            out.append(i)
        last = m.end()
    return out


def pointed_marks(df: DataFrame, key: str, content: str, phrases: Sequence[str], window: int = 12) -> DataFrame:
    @F.pandas_udf("array<int>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pointing(x, phrases, window))

    return df.select(key, F.explode(find(F.col(content))).alias("pos"))


def rebuild(texts: Column, images: Column, keep: Column, attach: Column | None = None) -> Column:
    """Parts of a row again: texts first, then kept pictures in the order of their marks, then attached ones. images: array of struct with path."""
    kept = F.filter(F.transform(keep, lambda p: F.try_element_at(F.filter(images, lambda i: i["path"] == p), F.lit(1))), lambda i: i.isNotNull())
    return F.concat(texts, kept, attach) if attach is not None else F.concat(texts, kept)


def delete_exactly(content: Column, urls: Sequence[str]) -> Column:
    """A text without dead links, unless more than the links would change."""
    from tarnbase.functions.text import remove_urls

    bare = content
    for u in sorted(urls, key=lambda u: (-len(u), u)):
        bare = F.replace(bare, F.lit(u), F.lit(""))
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    out = remove_urls(content, list(urls))
    return F.when(squeeze(out) == squeeze(bare), out).otherwise(content)


def clean_parts(parts: Column, urls: Sequence[str]) -> Column:
    """Dead links taken out of the text parts only. parts: array of struct with type, content."""
    from tarnbase.functions.text import remove_urls

    return F.transform(parts, lambda p: p.withField("content", F.when(p["type"] == "text", remove_urls(p["content"], list(urls))).otherwise(p["content"])))


def link_status(df: DataFrame, url: str, status: DataFrame) -> DataFrame:
    """Links with the status of an injected probe: dead if it is 404 or 410. status: url, code."""
    t = df.join(status.select(F.col("url").alias("__u"), "code"), F.col(url) == F.col("__u"), "left").drop("__u")
    return t.withColumn("dead", F.coalesce(F.col("code").isin(404, 410), F.lit(False)))

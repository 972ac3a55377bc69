"""Reading: JSON, lines, tables, workbooks, text folders, databases, indexes."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers of question-answer sheets and the fields they mean (fixed values).
HEADERS = {
    "q": ("问题", "标准问题", "标题", "question", "q", "title"),
    "a": ("答案", "回答", "内容", "answer", "a", "content"),
    "synonyms": ("相似问题", "相似问法", "扩展问", "synonyms", "similar"),
    "tags": ("标签", "tags", "tag"),
    "category": ("分类", "类目", "category"),
}


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, with_id: bool = True) -> DataFrame:
    """A file of JSON lines, or every file under a folder; with an id from the sorted fields where asked."""
    r = spark.read.option("recursiveFileLookup", "true")
    df = (r.schema(schema) if schema is not None else r).json(path)
    return df.withColumn("id", F.md5(F.to_json(F.struct(*sorted(df.columns))))) if with_id and "id" not in df.columns else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_texts(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """Whole text files with their names: source, text."""
    t = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source"), F.col("value").alias("text"))


def read_table_file(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    """CSV or TSV, comment lines skipped, a byte-order mark taken off the first header."""
    r = spark.read.option("sep", sep).option("header", header).option("comment", "#").option("multiLine", "true")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column where given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def dictionary(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """A two- or three-level dictionary: the last key and value as a map per the others."""
    *outer, inner = keys
    m = F.map_from_entries(F.collect_list(F.struct(inner, value)))
    return df.dropDuplicates(list(keys)).groupBy(*outer).agg(m.alias("map")) if outer else df.dropDuplicates(list(keys)).agg(m.alias("map"))


def recipients(df: DataFrame, name: str, address: str) -> DataFrame:
    """Recipients once per address; comments are skipped."""
    t = df.where(~F.startswith(F.trim(name), F.lit("#")) & (F.trim(address) != ""))
    return t.dropDuplicates([address])


def map_headers(columns: Sequence[str], headers: dict[str, Sequence[str]] = HEADERS) -> dict[str, str]:
    """Columns of a sheet to the fields they mean; the first of several wins."""
    out: dict[str, str] = {}
    for c in columns:
        field = next((f for f, names in headers.items() if str(c).strip().lower() in {n.lower() for n in names}), None)
        if field and field not in out.values():
            out[c] = field
    return out


def classify_sheet(columns: Sequence[str], sample: Sequence[Sequence[object]] = ()) -> str:
    """How a sheet is imported: qa if it has the standard columns, mapped if other names mean them, unstructured otherwise or if its sample rows are empty."""
    fields = map_headers(columns)
    filled = not sample or any(any(v not in (None, "") for v in row) for row in sample)
    if {"q", "a"} <= set(fields.values()) and filled:
        return "qa" if {"问题", "答案"} <= {str(c).strip() for c in columns} or {"q", "a"} <= set(map(str, columns)) else "mapped"
    return "unstructured"


def read_workbooks(spark: SparkSession, path: str, suffix: str = "*.xls*") -> DataFrame:
    """Sheets of workbooks as rows: file, sheet, row_no, cells (header to text). Needs a workbook reader on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for sheet, t in pd.read_excel(io.BytesIO(content), sheet_name=None, dtype=str).items():
                    rows = [{str(k): v for k, v in r.items() if isinstance(v, str)} for r in t.to_dict("records")]
                    yield pd.DataFrame({"file": name, "sheet": str(sheet), "row_no": range(1, len(rows) + 1), "cells": rows})

    return files.select("path", "content").mapInPandas(run, "file string, sheet string, row_no int, cells map<string,string>")


def qa_rows(cells: DataFrame, headers: dict[str, Sequence[str]] = HEADERS) -> DataFrame:
    """Rows of a sheet as question, answer, synonyms, tags and category; rows without question and answer go."""
    low = F.transform_keys("cells", lambda k, _: F.lower(F.trim(k)))

    def field(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(n.lower()))), F.lit("")) for n in names])

    t = cells.select("file", "sheet", "row_no", *[field(n).alias(f) for f, n in headers.items()])
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"[\n;；|]+"), lambda v: F.trim(v)), lambda s: s != "")
    return t.where("q is not null and a is not null").withColumn("synonyms", parts("synonyms")).withColumn("tags", parts("tags"))


def binary_documents(spark: SparkSession, path: str, parse, schema: str, suffix: str = "*") -> DataFrame:
    """Files of any kind through an injected parser: a function from (name, bytes) to rows of the schema. Adds `error`: a file that the parser fails on is one row, with nulls and what went wrong; of a file without rows there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows, error = list(parse(name, content)), None
                except Exception as e:  # a parser may fail on any file, and must not end the others
                    rows, error = [[None] * len(names)], f"{name}: {type(e).__name__}: {e}"
                yield pd.DataFrame(rows, columns=names).assign(error=error)

    return files.select("path", "content").mapInPandas(run, f"{schema}, error string")


def crawled(texts: DataFrame, manifest: DataFrame, least: int = 400, timely: Column | None = None) -> DataFrame:
    """Crawled texts that are in the manifest, long enough and not passing news. manifest: file, url, title, status."""
    t = texts.join(manifest.where("status = 'ok'").select(F.col("file").alias("source"), "url", "title"), "source").where(F.length("text") >= least)
    return t.where(~timely) if timely is not None else t


def index_scan(df: DataFrame, indexes: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of one index or several (a comma-separated list or a sequence); names are lower-case."""
    if not indexes:
        return df
    names = indexes.split(",") if isinstance(indexes, str) else indexes
    return df.where(F.col("index_name").isin(*[n.strip().lower() for n in names]))


def pages_of_rows(df: DataFrame, order: str, size: int = 30) -> DataFrame:
    """Rows of a sheet as numbered pages."""
    n = F.row_number().over(Window.partitionBy("file", "sheet").orderBy(order))
    return df.withColumn("page_no", F.floor((n - 1) / size).cast("int") + 1)


def task_segments(df: DataFrame, task: str, files: Sequence[str] | None = None) -> DataFrame:
    t = df.where((F.col("task_id") == task) & (F.col("data_type") == "segment"))
    return t.where(F.col("from_file_name").isin(*files)) if files else t


def sample(df: DataFrame, n: int, columns: Sequence[str] = ()) -> DataFrame:
    return (df.select(*columns) if columns else df).limit(n)

"""The driver's tables as this library's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as knowledge rows."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__d"), "quality", "toxic")
    t = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("__d"), "left")
    return t.select(
        F.col("doc_id").alias("id"),
        F.expr("substring_index(text, '\n', 1)").alias("title"),
        F.col("text").alias("content"),
        F.expr("case doc_id % 3 when 0 then 'qa' when 1 then 'segment' else 'doc' end").alias("data_type"),
        F.col("source").alias("platform"),
        F.col("lang").alias("client"),
        F.expr("case quality when 1 then 'high' when 0 then 'low' else 'mid' end").alias("quality_level"),
        F.expr("cast(coalesce(toxic, 0) as int)").alias("del_flag"),
        F.expr("cast(doc_id % 4 - 1 as int)").alias("audit_result"),
        F.expr("case doc_id % 5 when 0 then 'pdf' when 1 then 'html' when 2 then 'chat_auto' when 3 then 'chat' else 'manual' end").alias("from_type"),
        F.expr("case doc_id % 5 when 0 then 'document' when 1 then 'html' when 2 then 'auto_learning' when 3 then 'teacher_training' else 'manual' end").alias("from_type_norm"),
        F.expr("concat(source, '/', doc_id % 50, '.pdf')").alias("from_file_name"),
        F.expr("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0), 'yyyy-MM-dd HH:mm:ss')").alias("insert_time"),
        F.array("lang", "source").alias("tags"),
        F.expr("concat('task', doc_id % 20)").alias("task_id"),
        F.expr("concat('kb', doc_id % 3)").alias("index_name"),
        "n_chars",
    )


KB = """kb AS (SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS content,
    CASE d.doc_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'segment' ELSE 'doc' END AS data_type, d.source AS platform, d.lang AS client,
    CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'mid' END AS quality_level, CAST(coalesce(l.toxic, 0) AS INTEGER) AS del_flag,
    CAST(d.doc_id % 4 - 1 AS INTEGER) AS audit_result,
    CASE d.doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'chat_auto' WHEN 3 THEN 'chat' ELSE 'manual' END AS from_type,
    CASE d.doc_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'html' WHEN 2 THEN 'auto_learning' WHEN 3 THEN 'teacher_training' ELSE 'manual' END AS from_type_norm,
    d.source || '/' || (d.doc_id % 50) || '.pdf' AS from_file_name,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id), '%Y-%m-%d %H:%M:%S') AS insert_time,
    [d.lang, d.source] AS tags, 'task' || (d.doc_id % 20) AS task_id, 'kb' || (d.doc_id % 3) AS index_name, d.n_chars
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of a chat history."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.expr("concat('c', user_id % 7)").alias("customer"),
        F.expr("concat('u', user_id)").alias("user"),
        F.expr("cast(user_id % 3 as int)").alias("app_id"),
        F.expr("if(event_type = 'error', 'IMAGE', 'TEXT')").alias("send_type"),
        F.expr("concat(event_type, ' ', cast(floor(value) as bigint) % 50)").alias("send_content"),
        F.expr("if(event_id % 4 = 0, '', concat('reply ', event_id % 9))").alias("reply_content"),
        F.expr("if(event_id % 5 = 0, 'robot', null)").alias("channel_type"),
        F.expr("if(event_id % 6 = 0, '', concat('m', event_id div 2))").alias("msg_id"),
        F.expr("concat('cat', user_id % 4)").alias("category"),
        F.expr("cast(event_id % 11 = 0 as int)").alias("del_flag"),
        F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss')").alias("create_time"),
        F.expr("cast(event_id % 2 as int)").alias("is_group"),
        F.expr("concat('nick', user_id % 13)").alias("from_user_nickname"),
        F.col("value"),
    )


CHAT = """chat AS (SELECT event_id AS id, 'c' || (user_id % 7) AS customer, 'u' || user_id AS "user", CAST(user_id % 3 AS INTEGER) AS app_id,
    CASE WHEN event_type = 'error' THEN 'IMAGE' ELSE 'TEXT' END AS send_type, event_type || ' ' || (CAST(floor(value) AS BIGINT) % 50) AS send_content,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'reply ' || (event_id % 9) END AS reply_content, CASE WHEN event_id % 5 = 0 THEN 'robot' END AS channel_type,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE 'm' || (event_id // 2) END AS msg_id, 'cat' || (user_id % 4) AS category,
    CAST(event_id % 11 = 0 AS INTEGER) AS del_flag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS create_time, CAST(event_id % 2 AS INTEGER) AS is_group,
    'nick' || (user_id % 13) AS from_user_nickname, value FROM events)"""

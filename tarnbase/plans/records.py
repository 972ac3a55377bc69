"""Queries: knowledge rows from candidates and segments, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.operators import aggregates as A
from tarnbase.operators import records as R
from tarnbase.plans.registry import query
from tarnbase.plans.tables import KB, knowledge, table

_W = "WITH " + KB + " "


@query("SELECT p_name AS title, p_type AS content, 'qa' AS data_type, CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'html' ELSE 'doc' END AS from_type, 'shop' AS platform, 'shop' AS client, -1 AS audit_result, 't1' AS task_id, 't1' AS flag, CAST(p_partkey AS VARCHAR) AS category_id, p_brand AS category_name FROM part")
def h66_qa_records(spark, d):
    t = table(spark, d, "part").select(F.col("p_name").alias("q"), F.col("p_type").alias("a"), F.expr("case p_size % 4 when 0 then 'a.PDF' when 1 then 'b.docx' when 2 then 'http://x' else '' end").alias("from_file_name"), F.col("p_partkey").alias("category_id"), F.col("p_brand").alias("category_name"))
    r = R.qa_to_knowledge(t, "shop", "t1")
    return r.select("title", "content", "data_type", "from_type", "platform", "client", "audit_result", "task_id", "flag", F.col("category_infos")[0]["category_id"].alias("category_id"), F.col("category_infos")[0]["category_name"].alias("category_name"))


@query("SELECT doc_id AS id, text AS content, 'segment' AS data_type, 'mid' AS quality_level, lang || '|' || source AS texts FROM documents")
def h67_segment_records(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", F.lit(" ")).alias("keywords"), F.array("source", "lang").alias("topics"))
    r = R.segment_to_knowledge(t.withColumn("category_id", F.col("id")))
    return r.select(F.col("category_infos")[0]["category_id"].cast("long").alias("id"), "content", "data_type", "quality_level", F.array_join(F.transform("indexes", lambda i: i["text"]), "|").alias("texts"))


@query(_W + "SELECT id, index_name, audit_result, '' AS dataset, data_type, from_type_norm, CASE WHEN length(title) > 32767 THEN left(title, 32757) || '…[已截断]' ELSE title END AS title, CASE WHEN length(content) > 32767 THEN left(content, 32757) || '…[已截断]' ELSE content END AS content, quality_level, insert_time, from_file_name, '默认分组' AS category_path FROM kb")
def h69_export_row(spark, d):
    return R.export_row(knowledge(spark, d))


@query("SELECT p_partkey AS id, p_name || ' ![嵌入图片](http://c/' || p_partkey || ' \"Flowchart\") and  end' AS restored, trim(p_name || '  and  end') AS stripped FROM part")
def h54_placeholders(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(p_name, ' [图1] and [图2] end')").alias("x"), F.expr("map('[图1]', concat('http://c/', p_partkey))").alias("m"))
    return t.select("id", R.restore_placeholders("x", F.col("m")).alias("restored"), R.strip_placeholders("x").alias("stripped"))


@query("SELECT p_partkey AS id, replace(p_brand, ' ', '_') || ',' || replace(p_type, ' ', '_') AS keywords, 'L' AS label, p_name AS content FROM part")
def h64_parse_segment(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.parse_segment(F.expr("concat('- 关键词：', replace(p_brand, ' ', '_'), '、', replace(p_type, ' ', '_'), '\n- 图谱标签: L\n', p_name)")).alias("s"))
    return t.select("id", F.array_join("s.keywords", ",").alias("keywords"), "s.label", "s.content")


@query("SELECT o_custkey AS key, min(o_orderkey) AS query, min(o_orderpriority) AS priority, CAST(sum(o_orderkey % 10) AS BIGINT) AS evidence, CAST(least(count(DISTINCT o_orderpriority), 8) AS VARCHAR) AS raw_sources FROM orders GROUP BY 1")
def a13_merge_records(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("query"), F.col("o_orderpriority").alias("priority"), F.expr("o_orderkey % 10").alias("evidence"), F.array("o_orderpriority").alias("sources"), F.array("o_orderstatus").alias("platforms"))
    return A.merge_records(t).select("key", "query", "priority", "evidence", F.size("sources").cast("string").alias("raw_sources"))

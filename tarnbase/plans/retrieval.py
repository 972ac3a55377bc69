"""Queries: filters, facets, joins, search, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.functions import similarity as S
from tarnbase.functions import text as X
from tarnbase.operators import aggregates as A
from tarnbase.operators import joins as J
from tarnbase.operators import maintain as M
from tarnbase.operators import predicates as P
from tarnbase.operators import search as V
from tarnbase.plans.registry import query
from tarnbase.plans.tables import CHAT, KB, chat, knowledge, table

_W = "WITH " + KB + " "
_C = "WITH " + CHAT + " "


# -- filters ---------------------------------------------------------------

@query(_W + "SELECT id, data_type, platform FROM kb WHERE ((quality_level IN ('high') AND data_type = 'qa') OR (list_contains(tags, 'de') AND audit_result IN (1, 2)))")
def f1_dnf_filter(spark, d):
    t = knowledge(spark, d)
    return t.where(P.attribute_filter(t, [{"quality_level": ["high"], "data_type": "qa"}, {"tags": ["de"], "audit_result": [1, 2]}])).select("id", "data_type", "platform")


@query(_W + "SELECT id, insert_time, del_flag FROM kb WHERE insert_time >= '2024-01-01 02:00:00' AND insert_time <= '2024-01-01 12:30:00' AND data_type = 'segment' AND del_flag = 0")
def f3_time_range_active(spark, d):
    t = knowledge(spark, d)
    q = {"insert_time": ["2024-01-01 02:00:00", "2024-01-01 12:30:00"], "attribute": {"data_type": "segment"}}
    return t.where(P.query_filter(t, q)).select("id", "insert_time", "del_flag")


@query(_W + "SELECT id FROM kb WHERE ((quality_level = 'high' AND data_type = 'qa' AND audit_result IN (1, 2, -1)) OR (audit_result IN (1, 2) AND data_type = 'qa')) AND del_flag = 0")
def f4_search_defaults(spark, d):
    t = knowledge(spark, d)
    return t.where(P.query_filter(t, {"attribute": P.search_conditions()})).select("id")


@query(_W + "SELECT id, from_file_name FROM kb WHERE del_flag = 0 AND from_type_norm IN ('document', 'html', 'manual') AND from_file_name IN ('src0/0.pdf', 'src5/5.pdf', 'src4/24.pdf') AND data_type IN ('qa', 'doc')")
def f6_file_query(spark, d):
    return knowledge(spark, d).where(P.file_filter(["src0/0.pdf", "src5/5.pdf", "src4/24.pdf"], ["qa", "doc"])).select("id", "from_file_name")


@query(_W + "SELECT DISTINCT from_file_name FROM kb WHERE contains(lower(from_file_name), 'src1')")
def f7_name_contains(spark, d):
    return knowledge(spark, d).where(P.name_contains("from_file_name", " SRC1")).select("from_file_name").distinct()


@query(_W + "SELECT k.id FROM kb k LEFT JOIN labels l ON k.id = l.doc_id WHERE k.del_flag = 0 AND (l.quality IS NULL OR l.toxic IS NULL)")
def f8_any_missing(spark, d):
    t = knowledge(spark, d).join(table(spark, d, "labels"), F.col("id") == F.col("doc_id"), "left")
    return t.where(P.any_missing(["quality", "toxic"])).select("id")


@query(_C + "SELECT id, customer, create_time FROM chat WHERE customer IN ('c1', 'c2') AND send_type = 'TEXT' AND trim(coalesce(send_content, '')) <> '' AND create_time >= '2024-01-01 00:00:00' AND create_time < '2024-01-02 00:00:00' AND (channel_type IS NULL OR channel_type <> 'robot') AND app_id IN (0, 2) AND trim(coalesce(reply_content, '')) <> '' AND NOT contains(reply_content, 'reply 3')")
def f9_chat_predicate(spark, d):
    return chat(spark, d).where(P.chat_filter(["c1", "c2"], "2024-01-01 00:00:00", "2024-01-02 00:00:00", apps=[0, 2], apology="reply 3", channel_out="robot")).select("id", "customer", "create_time")


@query(_C + "SELECT id FROM chat WHERE customer = 'c3' AND app_id = 0 AND create_time BETWEEN '2024-01-01 00:10:00' AND '2024-01-03 00:00:00' AND coalesce(del_flag, 0) <> 1 AND NOT contains(from_user_nickname, 'nick1') AND is_group = 1")
def s2_chat_history(spark, d):
    return chat(spark, d).where(P.history_filter("c3", "0", "2024-01-01 00:10:00", "2024-01-03 00:00:00", ["nick1"], True)).select("id")


@query(_W + "SELECT id, audit_result FROM kb WHERE from_type_norm IN ('document', 'html') AND data_type = 'qa' AND audit_result >= 1 AND del_flag = 0")
def f10_export_filter(spark, d):
    return knowledge(spark, d).where(P.export_filter(["document", "html"], 1, P.data_types_of("qa"))).select("id", "audit_result")


@query(_W + "SELECT id FROM kb WHERE from_type = 'chat_auto' AND data_type = 'qa' AND quality_level = 'high' AND audit_result = -1 AND del_flag = 0")
def f11_audit_target(spark, d):
    return knowledge(spark, d).where(P.audit_target()).select("id")


@query(_W + "SELECT count(*) AS n FROM kb WHERE quality_level = 'high' AND from_type = 'chat_auto' AND insert_time BETWEEN '2024-01-01 01:00:00' AND '2024-01-01 10:00:00'")
def f13_from_type_count(spark, d):
    return knowledge(spark, d).where(P.from_type_filter("chat_auto", "2024-01-01 01:00:00", "2024-01-01 10:00:00")).agg(F.count("*").alias("n"))


@query(_W + "SELECT id FROM kb WHERE (task_id IN ('task1', 'task2') OR from_file_name = 'src3/3.pdf') AND del_flag = 0")
def f14_rollback_locate(spark, d):
    return knowledge(spark, d).where(P.rollback_filter(["task1", "task2"], ["src3/3.pdf"])).select("id")


@query(_W + "SELECT id, platform, client FROM kb WHERE platform IS DISTINCT FROM 'src1' OR client IS DISTINCT FROM 'en'")
def f17_scope_violations(spark, d):
    return P.scope_violations(knowledge(spark, d).select("id", "platform", "client"), "src1", "en")


@query(_C + "SELECT id, reply_content FROM chat WHERE (contains(reply_content, 'reply 7') OR contains(reply_content, 'reply 8')) AND create_time >= '2024-01-01 00:30:00' AND create_time < '2024-01-01 12:00:00'")
def s10_fallback_answered(spark, d):
    return chat(spark, d).where(P.fallback_answered(["reply 7", "reply 8"], "2024-01-01 00:30:00", "2024-01-01 12:00:00")).select("id", "reply_content")


# -- facets and reports ----------------------------------------------------

@query(_W + "SELECT key, count(*) AS doc_count, count(CASE WHEN quality_level = 'high' THEN 1 END) AS high FROM (SELECT unnest(list_distinct(tags)) AS key, quality_level FROM kb) GROUP BY key ORDER BY doc_count DESC, key LIMIT 10")
def a1_terms_facet(spark, d):
    return A.terms(knowledge(spark, d), "tags", 10, {"high": F.count(F.when(F.col("quality_level") == "high", 1))})


@query(_W + "SELECT platform AS key, count(*) AS doc_count FROM kb WHERE del_flag = 0 GROUP BY 1 ORDER BY 1 LIMIT 10000")
def a2_unique_values(spark, d):
    return A.unique_values(knowledge(spark, d), "platform", counts=True)


@query(_W + ", c AS (SELECT platform AS key, count(*) AS c FROM kb GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, key) AS r FROM c) SELECT count(*) AS unique_count, CAST(sum(c) AS BIGINT) AS total_docs, string_agg(CASE WHEN r <= 10 THEN key || ':' || c END, ',' ORDER BY r) AS top_values FROM r")
def a3_field_stats(spark, d):
    return A.field_statistics(knowledge(spark, d), "platform")


@query(_W + "SELECT from_file_name AS file_name, count(*) AS doc_count, count(CASE WHEN data_type = 'qa' THEN 1 END) AS n_qa, count(CASE WHEN data_type = 'segment' THEN 1 END) AS n_segment, count(CASE WHEN data_type = 'doc' THEN 1 END) AS n_doc FROM kb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def a6_file_list_subcount(spark, d):
    return A.file_list(knowledge(spark, d))


@query(_W + "SELECT from_file_name, count(*) AS total, count(CASE WHEN data_type = 'qa' THEN 1 END) AS n_qa, count(CASE WHEN audit_result = -1 THEN 1 END) AS audit_m1, string_agg(CASE WHEN r <= 3 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS sample_ids FROM (SELECT *, row_number() OVER (PARTITION BY from_file_name ORDER BY id) AS r FROM kb WHERE from_file_name LIKE 'src0/%') GROUP BY 1")
def a7_delete_preview(spark, d):
    t = A.delete_preview(knowledge(spark, d).where(F.col("from_file_name").startswith("src0/")), samples=3)
    return t.select("from_file_name", "total", "n_qa", "audit_m1", F.array_join(F.transform("samples", lambda x: x["id"].cast("string")), ",").alias("sample_ids"))


@query("SELECT count(*) AS total, count(l.quality) AS has_count, count(*) - count(l.quality) AS missing_count, CASE WHEN count(*) = 0 THEN 100.0 ELSE round(count(l.quality) * 100.0 / count(*), 2) END::DOUBLE AS rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a8_coverage(spark, d):
    return A.coverage(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query("SELECT coalesce(CAST(l.quality AS VARCHAR), 'missing') AS value, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 21")
def a8_value_distribution(spark, d):
    return A.value_distribution(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


_STATS = "SELECT send_content AS query, count(DISTINCT coalesce(nullif(msg_id, ''), CAST(id AS VARCHAR))) AS cnt, array_to_string(list_sort(list(DISTINCT customer)), ',') AS customers, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, max(create_time) AS last_time FROM chat GROUP BY 1"


@query(_C + _STATS)
def a9_candidate_stats(spark, d):
    return A.candidate_stats(chat(spark, d), "send_content")


@query(_C + f", s AS ({_STATS}), k AS (SELECT *, split_part(query, ' ', 1) AS key FROM s) SELECT key, arg_max(query, (cnt, query)) AS query, CAST(sum(cnt) AS BIGINT) AS cnt, (SELECT array_to_string(list_sort(list(DISTINCT x)), ',') FROM (SELECT unnest(string_split(z.customers, ',')) AS x FROM k z WHERE z.key = k.key)) AS customers, max(last_time) AS last_time FROM k GROUP BY key")
def a11_merge_stats(spark, d):
    t = A.merge_stats(A.candidate_stats(chat(spark, d), "send_content"), F.substring_index("query", " ", 1))
    return t.select("key", "query", "cnt", "customers", "last_time")


@query(_C + ", r AS (SELECT send_content AS query, *, row_number() OVER (PARTITION BY send_content ORDER BY (msg_id = ''), id) AS rn FROM chat WHERE send_content <> '') SELECT query, count(*) AS count, min(create_time) AS first_seen, max(create_time) AS last_seen, min(id) AS first_row FROM r GROUP BY 1")
def a12_query_dedup(spark, d):
    return A.query_dedup(chat(spark, d).withColumn("msg_id", F.nullif(F.col("msg_id"), F.lit(""))), F.col("send_content")).drop("sample_ids")


@query("""WITH t AS (SELECT 'c' || (c_nationkey) AS client, 'u' || o_custkey AS "user", CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS run_status, o_orderkey % 7 AS qa_num FROM orders JOIN customer ON o_custkey = c_custkey),
 r AS (SELECT 'c' || (o_custkey % 25) AS client, CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'mid' ELSE 'low' END AS quality_level, CAST(l_linenumber % 4 - 1 AS INTEGER) AS audit_result, l_returnflag = 'A' AS is_qualified FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 a AS (SELECT client, count(*) AS n_tasks, count(CASE WHEN run_status = 3 THEN 1 END) AS n_done, count(DISTINCT "user") AS n_users, CAST(sum(CASE WHEN run_status = 3 THEN qa_num ELSE 0 END) AS BIGINT) AS qa_total FROM t GROUP BY 1),
 b AS (SELECT client, count(CASE WHEN quality_level = 'high' THEN 1 END) AS n_high, count(CASE WHEN quality_level = 'mid' THEN 1 END) AS n_mid, count(CASE WHEN quality_level = 'low' THEN 1 END) AS n_low, count(CASE WHEN audit_result >= 1 THEN 1 END) AS n_approved, count(CASE WHEN is_qualified THEN 1 END) AS n_qualified FROM r GROUP BY 1)
 SELECT a.*, coalesce(n_high, 0) AS n_high, coalesce(n_mid, 0) AS n_mid, coalesce(n_low, 0) AS n_low, coalesce(n_approved, 0) AS n_approved, coalesce(n_qualified, 0) AS n_qualified FROM a LEFT JOIN b ON a.client = b.client""")
def a14_learning_report(spark, d):
    o, c, li = (table(spark, d, x) for x in ("orders", "customer", "lineitem"))
    tasks = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c"), "c_nationkey").alias("client"), F.concat(F.lit("u"), "o_custkey").alias("user"), F.expr("case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end").alias("run_status"), F.expr("o_orderkey % 7").alias("qa_num"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.expr("concat('c', o_custkey % 25)").alias("client"), F.expr("case when l_quantity > 30 then 'high' when l_quantity > 15 then 'mid' else 'low' end").alias("quality_level"), F.expr("cast(l_linenumber % 4 - 1 as int)").alias("audit_result"), F.expr("l_returnflag = 'A'").alias("is_qualified"))
    return A.learning_report(tasks, rows)


@query("""WITH u AS (SELECT 'c' || c_nationkey AS client, 'u' || o_custkey AS "user", count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY c DESC, "user") AS r FROM u) SELECT client, string_agg("user" || ':' || c, ', ' ORDER BY r) AS top_users FROM r WHERE r <= 3 GROUP BY 1""")
def a15_top_users(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.top_users(t.select(F.concat(F.lit("c"), "c_nationkey").alias("client"), F.concat(F.lit("u"), "o_custkey").alias("user")))


@query(_W + "SELECT platform, count(*) AS total, count(CASE WHEN quality_level = 'high' THEN 1 END) AS n_high, count(CASE WHEN quality_level = 'mid' THEN 1 END) AS n_mid, count(CASE WHEN quality_level = 'low' THEN 1 END) AS n_low FROM kb GROUP BY 1")
def a17_quality_counts(spark, d):
    return A.quality_counts(knowledge(spark, d), "platform")


@query(_W + "SELECT index_name, data_type, from_type_norm, count(*) AS n FROM kb GROUP BY ROLLUP (index_name, data_type, from_type_norm)")
def a18_summary(spark, d):
    return A.export_summary(knowledge(spark, d))


@query(_W + ", p AS (SELECT left(regexp_replace(title, '\\s+', '', 'g'), 30) AS prefix, id FROM kb) SELECT prefix, count(*) AS n, min(id) AS first_row FROM p WHERE prefix <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 20")
def a20_prefix_frequency(spark, d):
    return A.prefix_frequency(knowledge(spark, d), "title").drop("samples")


@query("WITH h AS (SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1) SELECT * FROM h WHERE n > 1")
def a21_frequent_hashes(spark, d):
    return A.frequent_hashes(table(spark, d, "documents"), "n_chars", F.md5("text"), 1)


@query("WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(v / sum(v) OVER (PARTITION BY user_id), 6) AS share FROM s")
def a23_normalise(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return A.shares(t, "event_type", "v", ["user_id"]).select("user_id", "event_type", F.round("share", 6).alias("share"))


@query(r"SELECT count(*) AS documents, CAST(sum(CAST(floor(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) * 1.5 + len(regexp_extract_all(text, '[A-Za-z]+')) * 1.2 + length(regexp_replace(text, '[\x{4e00}-\x{9fff}A-Za-z\s]', '', 'g')) * 0.25) AS BIGINT)) AS BIGINT) AS tokens, count(*) * 100 AS credits FROM documents")
def a25_document_cost(spark, d):
    return A.document_cost(table(spark, d, "documents"), F.col("text"))


@query(_W + "SELECT platform, left(insert_time, 10) AS day, count(*) AS n FROM kb WHERE insert_time BETWEEN '2024-01-01 03:00:00' AND '2024-01-01 15:00:00' GROUP BY 1, 2")
def a26_knowledge_report(spark, d):
    return A.knowledge_report(knowledge(spark, d), "platform", "insert_time", "2024-01-01 03:00:00", "2024-01-01 15:00:00")


@query(_W + ", p AS (SELECT * FROM kb WHERE from_type_norm IN ('document', 'auto_learning') AND audit_result = -1 AND insert_time <= '2024-01-01 12:00:00') SELECT count(*) AS total_count, count(CASE WHEN quality_level = 'high' THEN 1 END) AS high_count, count(CASE WHEN quality_level <> 'high' AND data_type <> 'segment' THEN 1 END) AS other_count, count(CASE WHEN del_flag = 1 THEN 1 END) AS soft_deleted_count, greatest(count(*) - count(CASE WHEN quality_level = 'high' THEN 1 END) - count(CASE WHEN quality_level <> 'high' AND data_type <> 'segment' THEN 1 END), 0) AS unchanged_count FROM p")
def a27_pending_audit(spark, d):
    return A.pending_audit(knowledge(spark, d), P.aged_unaudited(["document", "auto_learning"], "2024-01-01 12:00:00"))


@query("SELECT event_type AS verdict, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2)::DOUBLE AS rate FROM events GROUP BY 1")
def a28_verdict_report(spark, d):
    return A.verdict_report(table(spark, d, "events").select(F.col("event_type").alias("verdict")))


# -- joins -----------------------------------------------------------------

_APPS = """WITH cfg AS (SELECT o_orderkey AS id, o_custkey AS app_id, 'c' || (o_custkey % 5) AS client, CASE o_orderkey % 4 WHEN 0 THEN 'learn' WHEN 1 THEN 'scene' WHEN 2 THEN 'force' ELSE 'other' END AS config_key, o_orderpriority AS config_value, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_enabled, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS del_flag FROM orders),
 app AS (SELECT c_custkey AS id, c_mktsegment AS customer, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS is_enabled, 0 AS del_flag FROM customer) """


@query(_APPS + ", live AS (SELECT * FROM cfg WHERE coalesce(del_flag, 0) = 0), sc AS (SELECT app_id, arg_max(config_value, id) AS scene FROM live WHERE config_key = 'scene' GROUP BY 1) SELECT DISTINCT c.app_id, c.client, a.customer, sc.scene FROM live c JOIN app a ON a.id = c.app_id AND a.is_enabled = 1 LEFT JOIN sc ON sc.app_id = c.app_id WHERE c.config_key = 'learn' AND (c.is_enabled = 1 OR EXISTS (SELECT 1 FROM live f WHERE f.app_id = c.app_id AND f.config_key = 'force' AND f.is_enabled = 1))")
def j1_enabled_apps(spark, d):
    cfg = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as app_id", "concat('c', o_custkey % 5) as client", "case o_orderkey % 4 when 0 then 'learn' when 1 then 'scene' when 2 then 'force' else 'other' end as config_key", "o_orderpriority as config_value", "if(o_orderstatus = 'F', 1, 0) as is_enabled", "if(o_orderkey % 9 = 0, 1, 0) as del_flag")
    app = table(spark, d, "customer").selectExpr("c_custkey as id", "c_mktsegment as customer", "if(c_acctbal > 0, 1, 0) as is_enabled", "0 as del_flag")
    return J.enabled_apps(cfg, app, "learn", "force")


@query("WITH q AS (SELECT item_id AS key, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS norm FROM benchmark), l AS (SELECT doc_id AS ord, text AS query, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS norm FROM documents) SELECT q.key, coalesce((SELECT arg_min(query, ord) FROM l WHERE l.norm = q.norm), '') AS local_query FROM q")
def j8_align_exact(spark, d):
    peer = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), X.qa_key("text").alias("norm"))
    local = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("query"), X.qa_key("text").alias("norm"))
    first = local.groupBy("norm").agg(F.min_by("query", "ord").alias("q"))
    return peer.join(first, "norm", "left").select("key", F.coalesce("q", F.lit("")).alias("local_query"))


_SETS = "list_distinct(list_filter(string_split({}, ''), lambda c: c <> ''))"
_DICE = "2.0 * len(list_intersect(a.cs, b.cs)) / (len(a.cs) + len(b.cs))"


@query(f"WITH a AS (SELECT s_suppkey AS key, lower(s_name) AS norm, {_SETS.format('lower(s_name)')} AS cs FROM supplier), b AS (SELECT c_custkey AS ord, c_name AS query, lower(c_name) AS norm, {_SETS.format('lower(c_name)')} AS cs FROM customer), e AS (SELECT a.key, a.norm, a.cs, arg_min(b.query, b.ord) AS q FROM a LEFT JOIN b ON a.norm = b.norm GROUP BY 1, 2, 3), s AS (SELECT a.key, b.query, {_DICE} AS dice, row_number() OVER (PARTITION BY a.key ORDER BY {_DICE} DESC, b.ord) AS r FROM e a, b WHERE a.q IS NULL) SELECT e.key, CASE WHEN q IS NOT NULL THEN 'exact' WHEN s.dice >= 0.75 THEN 'fuzzy' ELSE 'none' END AS match_type, coalesce(q, CASE WHEN s.dice >= 0.75 THEN s.query END, '') AS local_query, round(CASE WHEN q IS NOT NULL THEN 1.0 WHEN s.dice >= 0.75 THEN s.dice ELSE 0.0 END, 6)::DOUBLE AS similarity FROM e LEFT JOIN s ON e.key = s.key AND s.r = 1")
def j8_align_fuzzy(spark, d):
    peer = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lower("s_name").alias("norm"))
    local = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("query"), F.lower("c_name").alias("norm"))
    return J.align_queries(peer, local).select("key", "match_type", "local_query", F.round("similarity", 6).alias("similarity"))


@query(_W + ", s AS (SELECT DISTINCT id * 2 AS id FROM kb) SELECT s.id, CASE WHEN k.id IS NULL THEN 'missing' WHEN k.del_flag <> 0 THEN 'already_del' WHEN k.insert_time >= '2024-01-01 10:00:00' THEN 'overwritten' ELSE 'delete' END AS action FROM s LEFT JOIN kb k ON s.id = k.id")
def j11_retire_plan(spark, d):
    t = knowledge(spark, d)
    return J.retire_plan(t.select((F.col("id") * 2).alias("id")), t, "2024-01-01 10:00:00")


_GATE = ", n AS (SELECT DISTINCT source || '/' || (doc_id % 60) || '.pdf' AS source_name FROM documents), p AS (SELECT from_file_name, count(CASE WHEN coalesce(del_flag, 0) = 0 THEN 1 END) AS active, count(CASE WHEN del_flag = 1 THEN 1 END) AS deleted FROM kb GROUP BY 1), v AS (SELECT source_name, coalesce(active, 0) AS active, coalesce(deleted, 0) AS deleted, CASE WHEN coalesce(active, 0) = 0 AND coalesce(deleted, 0) = 0 THEN 'never_indexed' WHEN coalesce(active, 0) = 0 THEN 'all_deleted' WHEN deleted > 0 THEN 'partial_deleted' ELSE 'ok' END AS verdict FROM n LEFT JOIN p ON source_name = from_file_name) "


def _names(spark, d):
    return table(spark, d, "documents").select(F.expr("concat(source, '/', doc_id % 60, '.pdf')").alias("source_name"))


@query(_W + _GATE + "SELECT * FROM v")
def j12_source_gate(spark, d):
    return J.source_status(_names(spark, d), knowledge(spark, d))


@query(_W + _GATE + "SELECT k.id, k.from_file_name, coalesce(v.verdict <> 'all_deleted', true) AS keep FROM kb k LEFT JOIN v ON v.source_name = k.from_file_name")
def j13_split(spark, d):
    t = knowledge(spark, d)
    return J.split_by_status(t.select("id", "from_file_name"), J.source_status(_names(spark, d), t), "from_file_name")


@query("WITH h AS (SELECT o_custkey AS id, o_totalprice AS similarity, o_orderpriority AS variant FROM orders) SELECT id, max(similarity) AS similarity, array_to_string(list_sort(list(DISTINCT variant)), ',') AS variants FROM h GROUP BY 1")
def j16_multi_route_max(spark, d):
    return J.best_of_variants(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("similarity"), F.col("o_orderpriority").alias("variant")))


@query("WITH r AS (SELECT o_orderkey AS id, o_custkey % 20 AS file, o_orderkey % 40 AS s, o_orderkey % 40 + o_orderkey % 7 AS e FROM orders), i AS (SELECT s_suppkey % 20 AS file, s_suppkey % 45 AS page_no, 'h' || (s_suppkey % 30) AS md5 FROM supplier) SELECT r.id, i.md5, min(i.page_no) AS page_no FROM r JOIN i ON r.file = i.file AND i.page_no BETWEEN r.s AND r.e GROUP BY 1, 2")
def j17_page_range_join(spark, d):
    r = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey % 20 as file", "o_orderkey % 40 as start_page", "o_orderkey % 40 + o_orderkey % 7 as end_page")
    i = table(spark, d, "supplier").selectExpr("s_suppkey % 20 as file", "s_suppkey % 45 as page_no", "concat('h', s_suppkey % 30) as md5")
    return J.page_images(r, i)


@query("WITH a AS (SELECT 'i' || (doc_id % 7) AS index_name FROM labels), b AS (SELECT 'i' || (doc_id % 8) AS index_name FROM documents), x AS (SELECT index_name, count(*) AS n FROM a GROUP BY 1), y AS (SELECT index_name, count(*) AS n FROM b GROUP BY 1) SELECT coalesce(x.index_name, y.index_name) AS index_name, coalesce(x.n, 0) AS exported, coalesce(y.n, 0) AS stored, coalesce(y.n, 0) - coalesce(x.n, 0) AS difference FROM x FULL JOIN y ON x.index_name = y.index_name")
def j25_reconcile(spark, d):
    t = table(spark, d, "documents")
    return J.reconcile(table(spark, d, "labels").select(F.expr("concat('i', doc_id % 7)").alias("index_name")), t.select(F.expr("concat('i', doc_id % 8)").alias("index_name")))


@query("SELECT s_suppkey AS key, n_name AS chain FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 WHERE n_name IS NOT NULL UNION ALL SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 1 JOIN region ON r_regionkey = n_regionkey")
def j2_chain_lookup(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = J.chain_lookup(s, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("chain")), r.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("chain")), "s_nationkey", "n_regionkey")
    return t.select(F.col("s_suppkey").alias("key"), "chain")


@query("WITH m AS (SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || (user_id % 20) END AS uid, 'n' || (user_id % 15) AS name FROM events), i AS (SELECT 'id' AS key_type, 'u' || (c_custkey % 30) AS k, c_mktsegment AS role, c_custkey % 5 AS priority FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'name', 'n' || (c_custkey % 10), c_mktsegment, c_custkey % 5 FROM customer WHERE c_custkey % 2 = 1), b AS (SELECT key_type, k, arg_max(role, (priority, role)) AS role FROM i GROUP BY 1, 2) SELECT m.key, coalesce(x.role, y.role) AS role FROM m LEFT JOIN b x ON x.key_type = 'id' AND x.k = m.uid LEFT JOIN b y ON y.key_type = 'name' AND y.k = m.name")
def j6_speaker_identity(spark, d):
    m = table(spark, d, "events").selectExpr("event_id as key", "if(event_id % 3 = 0, null, concat('u', user_id % 20)) as uid", "concat('n', user_id % 15) as name")
    c = table(spark, d, "customer")
    i = c.where("c_custkey % 2 = 0").selectExpr("'id' as key_type", "concat('u', c_custkey % 30) as key", "c_mktsegment as role", "c_custkey % 5 as priority").unionByName(c.where("c_custkey % 2 = 1").selectExpr("'name' as key_type", "concat('n', c_custkey % 10) as key", "c_mktsegment as role", "c_custkey % 5 as priority"))
    return J.speaker_identity(m, i, ["uid"], ["name"], "key").select("key", "role")


# -- search ----------------------------------------------------------------

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25(field: str, weight: float) -> str:
    t = _TOK.format(field)
    return f"""f_{weight:.0f} AS (WITH t AS (SELECT doc_id AS id, len({t}) AS len, {t} AS toks FROM docs WHERE len({t}) > 0),
 st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM t), p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(toks) AS term FROM t) GROUP BY 1, 2, 3),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
 SELECT q.qid, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) * qtf) AS score FROM p JOIN df USING (term) JOIN q ON q.term = p.term, st GROUP BY 1, 2)"""


_BM25 = f"""WITH docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents),
 q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
 {_bm25('title', 2)}, {_bm25('content', 1)}, u AS (SELECT qid, id, 2.0 * score AS w FROM f_2 UNION ALL SELECT qid, id, 1.5 * score FROM f_1),
 s AS (SELECT qid, id, max(w) + 0.3 * (sum(w) - max(w)) AS score FROM u GROUP BY 1, 2), k AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) """


def _hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return V.bm25(docs, "doc_id", {"title": ("title", 2.0), "content": ("content", 1.5)}, q).withColumn("score", F.round("score", 6))


@query(_BM25 + "SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def v1_bm25_topk(spark, d):
    return V.top(_hits(spark, d), 10)


@query(_BM25 + ", b AS (SELECT id, round(score, 6) AS score FROM s) SELECT id, max(score) AS score FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def v19_multi_query_max(spark, d):
    return V.best_over_queries(_hits(spark, d), 50).select("id", "score")


@query(_BM25 + "SELECT qid, id, round(least(round(score, 6) / 5.0, 1.0), 6)::DOUBLE AS page_score FROM k WHERE rank <= 20")
def v20_scale(spark, d):
    return V.top(_hits(spark, d), 20).select("qid", "id", F.round(V.page_score("score"), 6).alias("page_score"))


_VEC = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
#: Queries: every id that 20 divides, against all rows.
_KNN = f"WITH e AS ({_VEC}), q AS (SELECT id AS qid, v AS qv FROM e WHERE id % 20 = 0), s AS (SELECT qid, id, round(list_cosine_similarity(v, qv), 6) AS cosine FROM e, q), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM s) "


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e, e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@query(_KNN + "SELECT qid, id, cosine, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def v2_knn_topk(spark, d):
    return V.knn(*_vectors(spark, d), 10)


@query(_KNN + "SELECT qid, id, cosine FROM s WHERE cosine >= 0.25")
def v5_min_score(spark, d):
    return V.cosines(*_vectors(spark, d), least=0.25)


#: A question is an item of the benchmark; its vector is the one whose id is 20 times its own.
_BOTH = _BM25 + f", bk AS (SELECT qid, id, round(score, 6) AS score, rank FROM k), e AS ({_VEC}), vs AS (SELECT q.id // 20 AS qid, e.id, round(list_cosine_similarity(e.v, q.v), 6) AS cosine FROM e, e q WHERE q.id % 20 = 0), vk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM vs), routes AS (SELECT qid, id, score AS bm25, NULL::DOUBLE AS cosine, 0 AS route, rank FROM bk WHERE rank <= 5 UNION ALL SELECT qid, id, NULL, cosine, 1, rank FROM vk WHERE rank <= 5), dual AS (SELECT qid, id, max(bm25)::DOUBLE AS bm25, max(cosine) AS cosine, CAST(min(route) AS INTEGER) AS route, CAST(arg_min(rank, route) AS INTEGER) AS rank FROM routes GROUP BY 1, 2) "


def _dual(spark, d):
    e, q = _vectors(spark, d)
    return V.dual(_hits(spark, d), V.knn(e, q.select(F.expr("qid div 20").alias("qid"), "qvec"), 5), 10)


@query(_BOTH + "SELECT * FROM dual")
def v4_dual_merge(spark, d):
    return _dual(spark, d)


@query(f"WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT a.id, b.id AS other FROM e a JOIN e b ON a.id <> b.id AND a.label = b.label WHERE round(list_cosine_similarity(a.v, b.v), 6) > 0.25) SELECT e.id, count(l.other) AS n_links, least(e.id, min(l.other)) AS first FROM e LEFT JOIN l ON l.id = e.id GROUP BY e.id")
def v6_duplicate_links(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("qa").alias("data_type"), F.col("label").cast("string").alias("platform"), F.col("embedding").alias("vec"))
    return J.duplicate_links(e, basic=0.2, strict=0.25)


@query(f"WITH e AS ({_VEC}) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.id = a.id + 1")
def v7_cosine(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    f = e.select(F.col("a").alias("b"), F.col("va").alias("vb"))
    return e.join(f, F.col("b") == F.col("a") + 1).select("a", "b", F.round(S.cosine("va", "vb"), 6).alias("cosine"))


@query(_BOTH + ", m AS (SELECT h.qid, h.id, round(CASE WHEN h.id % 3 <> 0 THEN list_cosine_similarity(q.v, t.v) + 0.2 * coalesce(list_cosine_similarity(q.v, c.v), 0) ELSE coalesce(list_cosine_similarity(q.v, c.v), 0) END, 6) AS similarity FROM dual h JOIN e q ON q.id = 20 * h.qid JOIN e t ON t.id = h.id LEFT JOIN e c ON c.id = h.id + 1), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM m WHERE similarity > 0.0) SELECT qid, id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def v8_rerank(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # what both routes found, by its own vector as the title's and the next one as the content's
    t = _dual(spark, d).select("qid", "id").join(e.select(F.expr("id div 20").alias("qid"), F.col("id").alias("i"), F.col("v").alias("qv")).where("i % 20 = 0"), "qid").join(e, "id")
    t = t.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("cv")), "id", "left")
    t = t.withColumn("similarity", F.round(S.rank_similarity(S.cosine("qv", "v"), S.cosine("qv", "cv"), F.col("id") % 3 != 0), 6))
    return V.rerank(t.select("qid", "id", "similarity"), 0.0, 10)


@query(f"WITH a AS (SELECT p_partkey AS id, {_SETS.format('p_name')} AS cs FROM part) SELECT a.id, round(CASE WHEN len(a.cs) = 0 OR len(b.cs) = 0 THEN 0.0 ELSE len(list_intersect(a.cs, b.cs))::DOUBLE / len(list_distinct(list_concat(a.cs, b.cs))) END, 6)::DOUBLE AS jaccard, round(len(list_intersect(a.cs, b.cs))::DOUBLE / least(len(a.cs), len(b.cs)), 6) AS overlap, round(2.0 * len(list_intersect(a.cs, b.cs)) / (len(a.cs) + len(b.cs)), 6)::DOUBLE AS dice FROM a JOIN a b ON b.id = a.id + 1")
def v11_char_similarities(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return p.join(q, "id").select("id", F.round(S.char_jaccard("a", "b"), 6).alias("jaccard"), F.round(S.char_overlap("a", "b"), 6).alias("overlap"), F.round(S.char_dice("a", "b"), 6).alias("dice"))


_BI = "list_distinct(list_transform(range(1, greatest(len({0}), 2)), lambda i: substr(lower({0}), i, 2)))"


@query(f"WITH a AS (SELECT p_partkey AS id, {_BI.format('p_name')} AS g FROM part) SELECT a.id, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6)::DOUBLE AS dice FROM a JOIN a b ON b.id = a.id + 1")
def v12_bigram_dice(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return p.join(q, "id").select("id", F.round(S.bigram_dice("a", "b"), 6).alias("dice"))


@query("WITH q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]+')) AS kw FROM benchmark), c AS (SELECT doc_id AS id, lower(split_part(text, chr(10), 1)) AS t, lower(split_part(text, chr(10), 1) || ' ' || text) AS h FROM documents), s AS (SELECT qid, id, count(*) + 2 * count(CASE WHEN contains(t, kw) THEN 1 END) AS score FROM c JOIN q ON contains(c.h, q.kw) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8")
def v18_keyword_recall(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9][a-z0-9_\-]+"), F.lit(0)).alias("keywords"))
    return V.keyword_recall(c, q, 8)


@query("WITH a AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders), u AS (SELECT qid, id, 0 AS route, rank FROM a WHERE rank <= 2 UNION ALL SELECT qid, id, 1, rank FROM b WHERE rank <= 4), m AS (SELECT qid, id, min(route * 1000 + rank) AS p FROM u GROUP BY 1, 2), k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY p, id) AS place FROM m) SELECT qid, id, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4")
def u2_hybrid_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    from pyspark.sql import Window

    a = o.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("o_totalprice"), "id")))
    b = o.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("o_orderdate", "id")))
    return V.hybrid(a, b, 4)


# -- maintenance -----------------------------------------------------------

_UPS = "n AS (SELECT id // 2 AS id, max(id) AS by FROM kb GROUP BY 1)"


@query(_W + f", {_UPS} SELECT id, platform, 'old' AS state FROM kb WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, k.platform, 'new' FROM n JOIN kb k ON k.id = n.by")
def k1_upsert_latest(spark, d):
    t = knowledge(spark, d).select("id", "platform").withColumn("state", F.lit("old"))
    new = t.select(F.expr("id div 2").alias("id"), "platform", F.lit("new").alias("state"), F.col("id").alias("seq"))
    return M.upsert(t, new, "id", "seq")


@query(_W + "SELECT id, CASE WHEN platform = 'src1' AND quality_level IN ('mid', 'low') THEN 2 ELSE audit_result END AS audit_result FROM kb")
def k5_conditional_update(spark, d):
    t = knowledge(spark, d)
    return M.conditional_update(t, {"audit_result": 2}, P.update_filter(t, [{"platform": "src1"}, {"quality_level": ["mid", "low"]}]))[0].select("id", "audit_result")


@query(_W + "SELECT count(*) AS updated FROM kb WHERE platform = 'src1' AND quality_level IN ('mid', 'low')")
def k5_update_count(spark, d):
    t = knowledge(spark, d)
    return M.conditional_update(t, {"audit_result": 2}, P.update_filter(t, [{"platform": "src1"}, {"quality_level": ["mid", "low"]}]))[1]


@query(_W + ", s AS (SELECT id, audit_result, id % 5 AS revision FROM kb), u AS (SELECT id, (id % 3) AS expected, 9 AS audit_result FROM kb WHERE data_type = 'qa') SELECT s.id, CAST(CASE WHEN s.revision = u.expected THEN 9 ELSE s.audit_result END AS INTEGER) AS audit_result, CASE WHEN s.revision = u.expected THEN s.revision + 1 ELSE s.revision END AS revision, u.id IS NOT NULL AND s.revision <> u.expected AS conflict FROM s LEFT JOIN u ON s.id = u.id")
def k7_compare_and_set(spark, d):
    t = knowledge(spark, d)
    s = t.select("id", "audit_result", (F.col("id") % 5).alias("revision"))
    u = t.where("data_type = 'qa'").select("id", (F.col("id") % 3).alias("expected"), F.lit(9).alias("audit_result"))
    return M.compare_and_set(s, u)


@query(_W + ", h AS (SELECT md5(content) AS h, min(id) AS first, count(*) AS c FROM kb GROUP BY 1) SELECT k.id, CASE WHEN h.first <> k.id THEN 'skip' ELSE 'insert' END AS outcome FROM kb k JOIN h ON md5(k.content) = h.h")
def k10_insert_gate(spark, d):
    t = knowledge(spark, d)
    first = t.groupBy(F.md5("content").alias("h")).agg(F.min("id").alias("other"))
    dup = t.select("id", F.md5("content").alias("h")).join(first, "h").where("id <> other").select("id", "other")
    return M.insert_gate(t.select("id"), dup).select("id", "outcome")


@query(_W + "SELECT CASE WHEN quality_level NOT IN ('high', 'mid') THEN 'skip_quality' WHEN id % 7 = 0 THEN 'skip_duplicate' ELSE 'insert' END AS outcome, count(*) AS n FROM kb GROUP BY 1")
def k11_outcome_counts(spark, d):
    t = knowledge(spark, d).withColumn("dup", F.col("id") % 7 == 0)
    return M.upload_outcome(t, duplicate="dup").groupBy("outcome").agg(F.count("*").alias("n"))


@query(_W + "SELECT id, CASE WHEN del_flag = 0 AND from_type_norm IN ('document', 'html', 'manual') AND from_file_name LIKE 'src1/%' THEN 1 ELSE del_flag END AS del_flag FROM kb")
def k12_soft_delete(spark, d):
    t = knowledge(spark, d)
    names = [f"src1/{i}.pdf" for i in range(50)]
    return M.soft_delete(t, P.file_filter(names))[0].select("id", "del_flag")


@query(_W + ", p AS (SELECT k.id, CASE WHEN k.del_flag <> 0 THEN 'x' WHEN k.insert_time >= '2024-01-01 10:00:00' THEN 'x' ELSE 'delete' END AS action FROM kb k WHERE k.quality_level = 'low') SELECT k.id, CASE WHEN p.action = 'delete' THEN 1 ELSE k.del_flag END AS del_flag, CASE WHEN p.action = 'delete' THEN 'retired' ELSE 'live' END AS flag FROM kb k LEFT JOIN p ON k.id = p.id")
def k14_retire(spark, d):
    t = knowledge(spark, d).withColumn("flag", F.lit("live"))
    plan = J.retire_plan(t.where("quality_level = 'low'").select("id"), t, "2024-01-01 10:00:00")
    return M.apply_retire(t, plan, "retired").select("id", "del_flag", "flag")


@query("SELECT d.doc_id AS id, coalesce(l.quality, -9) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def k15_backfill(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return M.backfill(t, {"quality": -9, "toxic": 0}).select(F.col("doc_id").alias("id"), "quality", "toxic")


@query(_W + ", a AS (SELECT *, from_type_norm IN ('document', 'auto_learning') AND audit_result = -1 AND insert_time <= '2024-01-01 12:00:00' AS aged FROM kb) SELECT id, CAST(CASE WHEN aged AND quality_level = 'high' THEN 2 WHEN aged AND data_type <> 'segment' THEN 0 ELSE audit_result END AS INTEGER) AS audit_result FROM a")
def k16_auto_audit(spark, d):
    return M.auto_audit(knowledge(spark, d), P.aged_unaudited(["document", "auto_learning"], "2024-01-01 12:00:00")).select("id", "audit_result")


@query("SELECT vec_id, label FROM embeddings")
def k18_copy_drop(spark, d):
    return M.drop_matching(table(spark, d, "embeddings"))


@query(_W + "SELECT id, CASE WHEN quality_level = 'low' THEN 'fixed' ELSE quality_level END AS quality_level FROM kb")
def k9_join_update(spark, d):
    t = knowledge(spark, d).select("id", "quality_level")
    return M.join_update(t, t.where("quality_level = 'low'").select("id", F.lit("fixed").alias("quality_level")))


@query(_W + "SELECT id FROM kb WHERE id > 500 ORDER BY id LIMIT 50")
def s25_keyset_page(spark, d):
    return M.keyset_page(knowledge(spark, d).select("id"), 500, 50)


@query(_W + "SELECT k.id, k.del_flag FROM kb k WHERE k.id IN (SELECT item_id * 3 FROM benchmark)")
def s27_current_state(spark, d):
    return M.current_state(knowledge(spark, d).select("id", "del_flag"), table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id")))


@query(_W + "SELECT md5(title || '_' || content || '_' || data_type) AS doc_key, count(*) AS n FROM kb GROUP BY 1")
def id_md5(spark, d):
    return knowledge(spark, d).groupBy(X.data_id("title", "content", "data_type").alias("doc_key")).agg(F.count("*").alias("n"))

"""Queries: windows, sequences, clusters, trees, ontologies, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.operators import chat as C
from tarnbase.operators import cluster as K
from tarnbase.operators import ontology as O
from tarnbase.operators import tree as T
from tarnbase.operators import windows as W
from tarnbase.plans.registry import query
from tarnbase.plans.tables import CHAT, chat, table
from tarnbase.streaming import incremental as R

_C = "WITH " + CHAT + " "
_EV = "SELECT event_id, user_id, user_id % 10 AS grp, event_type, value, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.expr("user_id % 10").alias("grp"), "event_type", "value", F.expr("unix_timestamp(cast(date_trunc('second', ts) as timestamp))").alias("sec"))


@query(_C + """, r AS (SELECT id, send_content, reply_content, create_time, row_number() OVER (PARTITION BY send_content ORDER BY (reply_content <> '') DESC, create_time DESC, id) AS rank FROM chat) SELECT id, send_content, create_time, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def w1_samples_per_key(spark, d):
    return W.samples_per_key(chat(spark, d), "send_content", 3, F.col("reply_content") != "", "create_time", "id").select("id", "send_content", "create_time", "rank")


@query(f"""WITH e AS ({_EV}), l AS (SELECT *, event_type IN ('view', 'click') AS ok, lag(event_type IN ('view', 'click')) OVER w AS pok, lag(user_id) OVER w AS puser, lag(sec) OVER w AS pat FROM e WINDOW w AS (PARTITION BY grp ORDER BY sec, event_id)),
 s AS (SELECT *, CASE WHEN ok AND NOT coalesce(pok AND user_id = puser AND sec - pat BETWEEN 0 AND 180, false) THEN 1 ELSE 0 END AS st FROM l), t AS (SELECT *, sum(st) OVER (PARTITION BY grp ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM s)
 SELECT grp, CAST(turn AS BIGINT) AS turn, min(event_id) AS start_row, count(*) AS n_messages, min(user_id) AS speaker FROM t WHERE ok GROUP BY grp, turn""")
def w2_answer_turns(spark, d):
    e = _events(spark, d).withColumn("ok", F.col("event_type").isin("view", "click"))
    t = W.answer_turns(e, "grp", ["sec", "event_id"], "user_id", "ok", "sec")
    return W.turn_summary(t, "grp", "event_id", "event_type", "user_id").select("grp", "turn", "start_row", "n_messages", "speaker")


@query(f"""WITH RECURSIVE e AS ({_EV}), o AS (SELECT *, row_number() OVER (PARTITION BY grp, event_type ORDER BY event_id) AS rn FROM e), r AS (SELECT grp, event_type, event_id, rn, sec AS last, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.grp, o.event_type, o.event_id, o.rn, CASE WHEN o.sec - r.last BETWEEN 0 AND 120 THEN r.last ELSE o.sec END, NOT (o.sec - r.last BETWEEN 0 AND 120) FROM r JOIN o ON o.grp = r.grp AND o.event_type = r.event_type AND o.rn = r.rn + 1) SELECT event_id, grp, event_type FROM r WHERE kept""")
def w3_dedup_120s(spark, d):
    return W.suppress_repeats(_events(spark, d), ["grp", "event_type"], "sec", "event_id").select("event_id", "grp", "event_type")


@query(f"WITH e AS ({_EV}) SELECT event_id, coalesce(string_agg(event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), '') AS context FROM e")
def w4_context_50(spark, d):
    return W.context_before(_events(spark, d), "user_id", ["sec", "event_id"], "event_type").select("event_id", "context")


@query(f"""WITH e AS ({_EV}), n AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
 SELECT p.grp, p.sec, p.event_id, coalesce((SELECT string_agg(t.event_id, chr(10) ORDER BY t.no) FROM n t WHERE t.grp = p.grp AND t.event_type <> 'error' AND t.no BETWEEN p.no - 1 AND p.no), '') AS before, coalesce((SELECT string_agg(t.event_id, chr(10) ORDER BY t.no) FROM n t WHERE t.grp = p.grp AND t.event_type <> 'error' AND t.no BETWEEN p.no + 1 AND p.no + 2), '') AS after FROM n p WHERE p.event_type = 'error'""")
def w5_neighbours(spark, d):
    e = _events(spark, d).withColumn("label", F.col("event_id").cast("string"))
    return W.neighbours(e, "grp", ["sec", "event_id"], F.col("event_type") != "error", F.col("event_type") == "error", "label")


@query(f"WITH e AS ({_EV}) SELECT event_id, coalesce(sum(event_id % 3) OVER (PARTITION BY grp ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS first_number FROM e")
def w6_running_number(spark, d):
    return W.running_number(_events(spark, d), "grp", ["sec", "event_id"], F.col("event_id") % 3).select("event_id", "first_number")


@query("WITH t AS (SELECT o_orderkey AS query, o_orderpriority AS theme, 'P' || (o_orderkey % 3) AS priority, o_custkey AS evidence FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY priority, -ln(1 + evidence), query) AS r FROM t) SELECT query, theme, priority, evidence FROM r WHERE r <= 20 ORDER BY priority, -ln(1 + evidence), query LIMIT 60")
def w7_theme_cap(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderpriority").alias("theme"), F.expr("concat('P', o_orderkey % 3)").alias("priority"), F.col("o_custkey").alias("evidence"))
    return W.capped(t, "theme", W.evidence_order(), 20, 60)


@query("WITH t AS (SELECT o_orderkey AS id, o_custkey AS grp, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'mid' ELSE 'low' END AS level, o_orderpriority AS answer FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, length(answer) DESC, id) AS r FROM t) SELECT id, CASE WHEN r > 1 AND level <> 'low' THEN 'low' ELSE level END AS new_level, CASE WHEN r > 1 AND level <> 'low' THEN 'duplicate_in_group' END AS reason FROM r")
def w8_group_survivor(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.expr("case o_orderstatus when 'F' then 'high' when 'O' then 'mid' else 'low' end").alias("level"), F.col("o_orderpriority").alias("answer"))
    return W.group_survivor(t, "grp", "level", "answer", "id").select("id", "new_level", "reason")


_SEG = "c AS (SELECT DISTINCT o_custkey AS chunk, 1 AS lo, 40 AS hi FROM orders), g AS (SELECT o_custkey AS chunk, 't' || (o_orderkey % 2) AS title, CAST(o_orderkey % 50 AS INTEGER) AS s, CAST(o_orderkey % 50 + o_orderkey % 9 AS INTEGER) AS e FROM orders), k AS (SELECT DISTINCT g.chunk, title, greatest(s, lo) AS s, least(e, hi) AS e FROM g JOIN c ON g.chunk = c.chunk WHERE greatest(s, lo) <= least(e, hi))"


def _segments(spark, d):
    o = table(spark, d, "orders")
    chunks = o.select(F.col("o_custkey").alias("chunk"), F.lit(1).alias("lo"), F.lit(40).alias("hi")).distinct()
    return o.select(F.col("o_custkey").alias("chunk"), F.expr("concat('t', o_orderkey % 2)").alias("title"), F.expr("cast(o_orderkey % 50 as int)").alias("s"), F.expr("cast(o_orderkey % 50 + o_orderkey % 9 as int)").alias("e")), chunks


@query(f"WITH {_SEG} SELECT * FROM k")
def w11_clip_segments(spark, d):
    return W.clip_segments(*_segments(spark, d))


@query(f"""WITH {_SEG}, p AS (SELECT c.chunk, unnest(range(1, 41)) AS p FROM c), f AS (SELECT p.chunk, p.p FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chunk = p.chunk AND p.p BETWEEN k.s AND k.e)), i AS (SELECT chunk, p, p - row_number() OVER (PARTITION BY chunk ORDER BY p) AS g FROM f), b AS (SELECT chunk, g, min(p) AS lo, max(p) AS hi FROM i GROUP BY 1, 2), x AS (SELECT chunk, hi, unnest(range(lo, hi + 1, 3)) AS s FROM b)
 SELECT chunk, title, s, e, false AS is_gap FROM k UNION ALL SELECT chunk, '第' || s || '-' || least(s + 2, hi) || '页', CAST(s AS INTEGER), CAST(least(s + 2, hi) AS INTEGER), true FROM x""")
def w13_gap_fill(spark, d):
    return W.fill_gaps(*_segments(spark, d))


@query("WITH RECURSIVE p AS (SELECT conv_id AS doc, turn + 1 AS page, length(text) AS n FROM conversations), r AS (SELECT doc, page, n, CASE WHEN n > 800 THEN NULL ELSE page END AS s, CASE WHEN n > 800 THEN 0 ELSE n END AS acc, page AS start FROM p WHERE page = 1 UNION ALL SELECT p.doc, p.page, p.n, CASE WHEN (r.s IS NULL OR p.page - r.s + 1 > 3 OR (p.n > 0 AND r.acc + (CASE WHEN r.acc > 0 AND p.n > 0 THEN 1 ELSE 0 END) + p.n > 800)) THEN CASE WHEN p.n > 800 THEN NULL ELSE p.page END ELSE r.s END, CASE WHEN (r.s IS NULL OR p.page - r.s + 1 > 3 OR (p.n > 0 AND r.acc + (CASE WHEN r.acc > 0 AND p.n > 0 THEN 1 ELSE 0 END) + p.n > 800)) THEN CASE WHEN p.n > 800 THEN 0 ELSE p.n END ELSE r.acc + (CASE WHEN r.acc > 0 AND p.n > 0 THEN 1 ELSE 0 END) + p.n END, CASE WHEN (r.s IS NULL OR p.page - r.s + 1 > 3 OR (p.n > 0 AND r.acc + (CASE WHEN r.acc > 0 AND p.n > 0 THEN 1 ELSE 0 END) + p.n > 800)) THEN p.page ELSE r.start END FROM r JOIN p ON p.doc = r.doc AND p.page = r.page + 1) SELECT doc, start AS start_page, max(page) AS end_page FROM r GROUP BY 1, 2")
def w9_page_pack(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), F.length("text").alias("n"))
    return W.pack_pages(t, "doc", "page", "n", 800, 3).select("doc", "start_page", "end_page")


@query("WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey % 3, o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_orderkey, CAST(place AS INTEGER) AS place FROM t WHERE place BETWEEN 41 AND 60")
def w15_paging(spark, d):
    order = [F.expr("o_orderkey % 3"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return W.page_of(table(spark, d, "orders"), order, 3, 20).select("o_orderkey", "place")


@query("SELECT user_id, event_type, max(ts) AS mark FROM events GROUP BY 1, 2")
def w16_high_water(spark, d):
    return W.high_water(table(spark, d, "events"), ["user_id", "event_type"], "ts")


@query("WITH s AS (SELECT conv_id, role, count(*) AS n_lines FROM conversations GROUP BY 1, 2) SELECT conv_id, role, n_lines, role = 'assistant' AS is_colleague, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n_lines DESC, role) AS INTEGER) AS place FROM s")
def w17_speakers(spark, d):
    return W.speakers(table(spark, d, "conversations"), "conv_id", "role", ["assistant"])


@query("WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS n FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'image' ELSE 'user' END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM t) SELECT conv_id, min(CASE role WHEN 'user' THEN 'text' ELSE 'image' END) AS kind, string_agg(text, chr(10) ORDER BY turn) AS content, min(turn) AS turn FROM i GROUP BY conv_id, g")
def x81_merge_texts(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.expr("if(turn % 3 = 0, 'image', 'text')").alias("kind"), F.col("text").alias("content"))
    return W.merge_adjacent_texts(t, "conv_id", "turn", "kind", "content")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(o_orderpriority)), o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_orderkey FROM r WHERE r = 1")
def u3_ordered_distinct(spark, d):
    t = table(spark, d, "orders").withColumn("k", F.concat_ws("|", "o_orderpriority", "o_custkey"))
    return K.first_seen(t, "k", "o_orderkey").select("o_orderkey")


@query("SELECT p_brand AS key, arg_max(p_name, (length(p_name), p_name)) AS body, min(p_size) AS top FROM part GROUP BY 1")
def u5_merge_fuller(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("body"), F.col("p_size").alias("top"))
    return K.fuller(t, "key", "body", "top")


_CHARS = "list_distinct(list_filter(string_split({}, ''), lambda c: c <> ''))"
_JACCARD = "(len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))"


@query(f"""WITH RECURSIVE o AS (SELECT p_partkey AS id, p_brand AS platform, {_CHARS.format('p_name')} AS qs, {_CHARS.format("p_type || ' ' || p_name")} AS xs, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_type || ' ' || p_name) DESC, p_partkey) AS rn FROM part),
 r AS (SELECT platform, rn, id, true AS keep, [{{'q': qs, 'x': xs}}] AS ls FROM o WHERE rn = 1 UNION ALL SELECT platform, rn, id, keep, CASE WHEN keep THEN list_append(ls, {{'q': qs, 'x': xs}}) ELSE ls END FROM (SELECT o.*, r.ls, len(list_filter(r.ls, lambda k: {_JACCARD.format('k.q', 'o.qs')} > 0.9 OR {_JACCARD.format('k.x', 'o.xs')} > 0.8)) = 0 AS keep FROM r JOIN o ON o.platform = r.platform AND o.rn = r.rn + 1)) SELECT id, platform FROM r WHERE keep""")
def v9_qa_dedup(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("platform"), F.col("p_name").alias("q"), F.concat("p_type", F.lit(" "), "p_name").alias("a"))
    return K.qa_dedup(t).select("id", "platform")


_OVER = "CASE WHEN contains({0}, {1}) OR contains({1}, {0}) THEN 1.0 ELSE len(list_intersect({2}, {3}))::DOUBLE / least(len({2}), len({3})) END"
_QKEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand AS grp, p_name AS raw, {_QKEY.format('p_name')} AS q, {_QKEY.format("p_type || ' ' || p_name")} AS x FROM part), o AS (SELECT *, {_CHARS.format('q')} AS qc, {_CHARS.format('x')} AS xc, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM p),
 r AS (SELECT grp, rn, [{{'id': id, 'raw': raw, 'q': q, 'x': x, 'qc': qc, 'xc': xc}}] AS ls FROM o WHERE rn = 1 UNION ALL
 SELECT grp, rn, CASE WHEN hit IS NULL THEN list_append(ls, me) WHEN tt >= 0.95 AND length(me.raw) < length(ls[hit].raw) THEN list_transform(ls, lambda k, i: CASE WHEN i = hit THEN me ELSE k END) ELSE ls END FROM (SELECT *, {_OVER.format('ls[hit].x', 'me.x', 'ls[hit].xc', 'me.xc')} AS tt FROM (SELECT *, list_position(list_transform(ls, lambda k: ({_OVER.format('k.q', 'me.q', 'k.qc', 'me.qc')}) >= 0.86 OR (({_OVER.format('k.x', 'me.x', 'k.xc', 'me.xc')}) >= 0.95 AND ({_OVER.format('k.q', 'me.q', 'k.qc', 'me.qc')}) >= 0.55)), true) AS hit FROM (SELECT o.grp, o.rn, r.ls, {{'id': o.id, 'raw': o.raw, 'q': o.q, 'x': o.x, 'qc': o.qc, 'xc': o.xc}} AS me FROM r JOIN o ON o.grp = r.grp AND o.rn = r.rn + 1))))
 SELECT unnest(list_transform(ls, lambda k: k.id)) AS id, grp FROM (SELECT grp, arg_max(ls, rn) AS ls FROM r GROUP BY 1)""")
def v13_chat_dedup(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("q"), F.concat("p_type", F.lit(" "), "p_name").alias("a"))
    return K.chat_dedup(t, "grp").select("id", "grp")


_LEADERS = "e AS (SELECT vec_id AS id, label AS client, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), r AS (SELECT client, rn, id, id AS leader, [{'k': id, 'v': v}] AS ls FROM e WHERE rn = 1 UNION ALL SELECT client, rn, id, CASE WHEN best > 0.3 THEN ls[list_position(sims, best)].k ELSE id END, CASE WHEN best > 0.3 THEN ls ELSE list_append(ls, {'k': id, 'v': v}) END FROM (SELECT *, list_max(sims) AS best FROM (SELECT e.*, r.ls, list_transform(r.ls, lambda x: list_cosine_similarity(x.v, e.v)) AS sims FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)))"


@query(f"WITH RECURSIVE {_LEADERS} SELECT id, leader FROM r")
def v14_leader_cluster(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("client"), F.col("embedding").alias("vec"))
    return K.leaders(e, "client", "id", "vec", 0.3).select("id", "leader")


@query(f"WITH RECURSIVE {_LEADERS}, h AS (SELECT e.id, e.v, row_number() OVER (ORDER BY e.id) AS rn FROM e JOIN r ON r.id = e.id WHERE r.leader = r.id), t AS (SELECT rn, id, id AS top, [{{'k': id, 'v': v}}] AS ls FROM h WHERE rn = 1 UNION ALL SELECT rn, id, CASE WHEN best > 0.3 THEN ls[list_position(sims, best)].k ELSE id END, CASE WHEN best > 0.3 THEN ls ELSE list_append(ls, {{'k': id, 'v': v}}) END FROM (SELECT *, list_max(sims) AS best FROM (SELECT h.*, t.ls, list_transform(t.ls, lambda x: list_cosine_similarity(x.v, h.v)) AS sims FROM t JOIN h ON h.rn = t.rn + 1))) SELECT r.id, r.leader, t.top AS top_leader FROM r JOIN t ON t.id = r.leader")
def v15_two_level(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user"), F.col("embedding").alias("vec"))
    return K.two_level_leaders(e, "user", "id", "vec", 0.3)


@query("WITH RECURSIVE o AS (SELECT p_partkey AS id, p_brand AS grp, lower(trim(p_name)) AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part), r AS (SELECT grp, rn, id, CAST(0 AS BIGINT) AS cluster, [w] AS ls FROM o WHERE rn = 1 UNION ALL SELECT grp, rn, id, CASE WHEN hit IS NULL THEN len(ls) ELSE hit - 1 END, CASE WHEN hit IS NULL THEN list_append(ls, w) ELSE ls END FROM (SELECT o.*, r.ls, list_position(list_transform(r.ls, lambda c: c <> '' AND o.w <> '' AND levenshtein(c, o.w) <= greatest(2, CAST(floor(least(length(c), length(o.w)) * 0.3) AS BIGINT))), true) AS hit FROM r JOIN o ON o.grp = r.grp AND o.rn = r.rn + 1)) SELECT id, cluster FROM r")
def v17_edit_cluster(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("word"))
    return K.edit_clusters(t, "grp", "id", "word").select("id", "cluster")


@query(f"""WITH RECURSIVE o AS (SELECT p_partkey AS id, p_brand AS platform, CASE WHEN p_size < 5 THEN 'g' || p_size END AS g, {_CHARS.format('p_name')} AS qs, {_CHARS.format('p_type')} AS xs, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
 r AS (SELECT platform, rn, id, CAST(0 AS BIGINT) AS regroup, CAST(1 AS BIGINT) AS n, [{{'g': g, 'q': qs, 'x': xs, 'o': CAST(0 AS BIGINT)}}] AS ls FROM o WHERE rn = 1 UNION ALL SELECT platform, rn, id, got, n + CASE WHEN hit IS NULL THEN 1 ELSE 0 END, list_append(ls, {{'g': g, 'q': qs, 'x': xs, 'o': got}}) FROM (SELECT *, CASE WHEN hit IS NULL THEN n ELSE ls[hit].o END AS got FROM (SELECT o.*, r.ls, r.n, list_position(list_transform(r.ls, lambda k: coalesce(k.g = o.g, false) OR {_JACCARD.format('k.q', 'o.qs')} > 0.9 OR {_JACCARD.format('k.x', 'o.xs')} > 0.8), true) AS hit FROM r JOIN o ON o.platform = r.platform AND o.rn = r.rn + 1))) SELECT id, regroup FROM r""")
def w18_regroup(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("platform"), F.expr("if(p_size < 5, concat('g', p_size), null)").alias("group"), F.col("p_name").alias("q"), F.col("p_type").alias("a"))
    return K.regroup(t).select("id", "regroup")


_TREE = "t AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"


def _tree(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT id, name, 1 AS level, name AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, t.name, p.level + 1, p.path || '-' || t.name FROM t JOIN p ON t.parent_id = p.id) SELECT id, name, level, path FROM p")
def h31_tree_paths(spark, d):
    return T.paths(_tree(spark, d)).select("id", "name", "level", "path")


@query("WITH RECURSIVE l AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey <> c_custkey // 2), r AS (SELECT src, dst, 1 AS hops FROM l UNION ALL SELECT r.src, l.dst, r.hops + 1 FROM r JOIN l ON r.dst = l.src) SELECT src, arg_max(dst, hops) AS final, max(hops) AS hops FROM r GROUP BY 1")
def h38_closure(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst")).where("src <> dst")
    return T.follow(t)


@query("WITH p AS (SELECT p_brand AS site, CASE WHEN p_size < 10 THEN 'a' ELSE 'b' END AS platform, 'http://x/' || p_partkey AS url FROM part) SELECT platform, url, CASE WHEN count(*) OVER (PARTITION BY platform, site) > 1 THEN site || '_' || left(md5(url), 8) ELSE site END AS site FROM p")
def x93_disambiguate(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("site"), F.expr("if(p_size < 10, 'a', 'b')").alias("platform"), F.expr("concat('http://x/', p_partkey)").alias("url"))
    return T.disambiguate(t)


@query("SELECT path, CAST(level AS INTEGER) AS level FROM (SELECT DISTINCT r_name AS path, 1 AS level FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT DISTINCT r_name || '/' || n_name, 2 FROM region JOIN nation ON r_regionkey = n_regionkey)")
def t7_with_parents(spark, d):
    t = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("p"))
    return T.with_parents(t, "p", "/")


_ONT = "o AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'acme' ELSE 'other' END AS client, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'shop' ELSE 'bank' END AS product, c_name AS name, c_mktsegment AS description, CASE WHEN c_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'approved' END AS audit_status, CAST(c_custkey % 11 = 0 AS INTEGER) AS del_flag, c_nationkey AS update_time FROM customer)"


def _ontologies(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as id", "case c_custkey % 3 when 0 then '' when 1 then 'acme' else 'other' end as client", "case c_custkey % 4 when 0 then '' when 1 then 'shop' else 'bank' end as product", "c_name as name", "c_mktsegment as description", "if(c_custkey % 5 = 0, 'inactive', 'active') as status", "if(c_custkey % 7 = 0, 'pending', 'approved') as audit_status", "cast(c_custkey % 11 = 0 as int) as del_flag", "c_nationkey as update_time", "cast(array() as array<string>) as alias_name")


@query(f"WITH {_ONT} SELECT id, CAST((client = 'acme') AS INTEGER) * 2 + CAST((product = 'shop') AS INTEGER) AS scope_rank FROM o WHERE del_flag = 0 AND status = 'active' AND audit_status = 'approved' AND client IN ('acme', '') AND product IN ('shop', '') ORDER BY 2 DESC, (product = '') DESC, update_time DESC, id DESC LIMIT 1")
def j21_scope_select(spark, d):
    return O.select_scope(_ontologies(spark, d), "acme", "shop").select("id", "scope_rank")


@query(f"WITH {_ONT}, s AS (SELECT *, CASE WHEN lower(name) = 'customer#000000007' THEN 100 WHEN contains(lower(name), 'customer#000000007') THEN 70 WHEN contains(lower(coalesce(description, '')), 'customer#000000007') THEN 50 END AS q1, CASE WHEN lower(name) = 'auto' THEN 100 WHEN contains(lower(name), 'auto') THEN 70 WHEN contains(lower(description), 'auto') THEN 50 END AS q_score FROM o WHERE del_flag = 0) SELECT id, CAST(q_score AS INTEGER) AS q_score, count(*) OVER () AS total FROM s WHERE q_score IS NOT NULL ORDER BY q_score DESC, update_time DESC, id DESC LIMIT 20 OFFSET 5")
def t4_ranked_list(spark, d):
    return O.ranked_list(_ontologies(spark, d), "AUTO", limit=20, offset=5).select("id", "q_score", "total")


@query("SELECT n_nationkey AS id, 'relations' AS path, 'unknown_reference' AS issue, 'missing' AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'object_types', 'duplicate_name', 'A' FROM nation WHERE n_nationkey % 5 = 0")
def q23_refs(spark, d):
    obj = F.expr("if(n_nationkey % 5 = 0, '[{\"name\":\"A\",\"attributes\":[]},{\"name\":\"Ａ\",\"attributes\":[]}]', '[{\"name\":\"A\",\"attributes\":[]}]')")
    end = F.expr("if(n_nationkey % 2 = 0, 'missing', 'A')")
    doc = F.concat(F.lit('{"name":"n","object_types":'), obj, F.lit(',"relations":[{"name":"r","subject":"A","object":"'), end, F.lit('"}],"value_sets":[],"rules":[],"terms":[]}'))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), doc.alias("data_json"))
    return O.validate(O.parse(t))


@query("WITH m AS (SELECT user_id % 50 AS user_id, max(ts) AS mark FROM events WHERE event_type = 'view' GROUP BY 1) SELECT e.event_id FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE m.mark IS NULL OR e.ts > m.mark")
def r1_incremental(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'view'").groupBy(F.expr("user_id % 50").alias("user_id")).agg(F.max("ts").alias("mark"))
    return R.after_marks(e, marks, ["user_id"], "ts").select("event_id")


@query("WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id, max(ts) AS mark FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type <> 'error') GROUP BY 1) SELECT user_id, max(mark) AS mark FROM (SELECT * FROM m UNION ALL SELECT * FROM n) GROUP BY 1")
def r2_next_marks(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return R.next_marks(marks, e, ["user_id"], "ts", e.where("event_type <> 'error'"))


@query("SELECT user_id AS app_id, arg_max(value, event_id) AS run_time FROM events GROUP BY 1")
def r3_last_runs(spark, d):
    return R.last_runs(table(spark, d, "events").select(F.col("user_id").alias("app_id"), F.col("value").alias("run_time"), F.col("event_id").alias("seq")))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 180 SECOND THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 180 SECOND AS session_end, count(*) AS n FROM i GROUP BY user_id, s")
def r4_session(spark, d):
    return R.sessions(table(spark, d, "events"), "user_id", "ts", "180 seconds")


@query("SELECT time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 3 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def r7_tumbling(spark, d):
    return R.tumbling(table(spark, d, "events"), "ts", "3 days", "event_type").withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, event_type, count(*) AS n FROM w GROUP BY 1, 2, 3")
def r7_sliding(spark, d):
    return R.sliding(table(spark, d, "events"), "ts", "60 minutes", "30 minutes", "event_type")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id * 2 FROM events)")
def r9_pending(spark, d):
    e = table(spark, d, "events")
    return R.pending(e.select(F.col("event_id").alias("id")), e.select((F.col("event_id") * 2).alias("id"))).withColumnRenamed("id", "event_id")


@query("SELECT content, last_time FROM (SELECT trim(event_type || ' ' || user_id) AS content, max(ts) AS last_time FROM events GROUP BY 1) ORDER BY last_time DESC, content LIMIT 100")
def s9_existing_contents(spark, d):
    return C.existing_contents(table(spark, d, "events").withColumn("c", F.concat_ws(" ", "event_type", "user_id")), "c", "ts", 100)


@query("WITH r AS (SELECT event_id, event_type || ' ' || user_id AS q, ts, row_number() OVER (PARTITION BY lower(trim(event_type || ' ' || user_id)) ORDER BY ts DESC) AS r FROM events) SELECT event_id FROM r WHERE r = 1 ORDER BY ts DESC LIMIT 200")
def s7_recent_queries(spark, d):
    return C.recent_queries(table(spark, d, "events").withColumn("q", F.concat_ws(" ", "event_type", "user_id")), "q", "ts", 200).select("event_id")


@query(None)
def s5_even_sample(spark, d):
    return C.sample_evenly(table(spark, d, "events"), "event_type", "event_id", 103, 7).select("event_id", "event_type")


@query(None)
def s4_rooms(spark, d):
    t = table(spark, d, "conversations").select(F.expr("concat('room', conv_id % 5)").alias("group_name"), F.col("role").alias("send_name"), F.expr("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int), 0), 'yyyy-MM-dd HH:mm:ss')").alias("message_time"), F.col("text").alias("content"), F.lit("TEXT").alias("ctype"), F.expr("conv_id * 1000 + turn").alias("msg_id"), *[F.lit(None).cast("string").alias(c) for c in ("actual_user_nickname", "actual_user_id", "from_user_nickname", "from_user_id", "send_user")])
    return C.rooms(t).select("group_name", "msg_id", "speaker")

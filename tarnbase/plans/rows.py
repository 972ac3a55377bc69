"""Queries: lookups, maintenance, pictures, reports and scans that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.operators import aggregates as A
from tarnbase.operators import chat as C
from tarnbase.operators import cluster as K
from tarnbase.operators import images as I
from tarnbase.operators import joins as J
from tarnbase.operators import maintain as M
from tarnbase.operators import ontology as O
from tarnbase.operators import predicates as P
from tarnbase.operators import quality as Q
from tarnbase.operators import search as V
from tarnbase.operators import tree as T
from tarnbase.plans.registry import query
from tarnbase.plans.sequences import _ONT, _TREE, _ontologies, _tree
from tarnbase.plans.tables import CHAT, KB, chat, knowledge, table
from tarnbase.sources import readers as S
from tarnbase.streaming import incremental as R

_W = "WITH " + KB + " "
_C = "WITH " + CHAT + " "


def _orders(spark, d):
    return table(spark, d, "orders")


def _part(spark, d):
    return table(spark, d, "part")


# -- predicates ----------------------------------------------------------------

@query(_W + "SELECT id FROM kb WHERE from_file_name = 'src1/1.pdf' OR (client = 'de' AND quality_level = 'low')")
def f2_alias_filter(spark, d):
    t = knowledge(spark, d)
    return t.where(P.attribute_filter(t, [{"from_file_name": "src1/1.pdf"}, {"client": ["de"], "quality_level": "low"}, {}])).select("id")


@query(_W + "SELECT id FROM kb WHERE ((audit_result IN (1, 2) AND data_type = 'doc') OR (audit_result = 0 AND platform = 'src2')) AND del_flag = 0")
def f5_search_conditions(spark, d):
    t = knowledge(spark, d)
    return t.where(P.query_filter(t, {"attribute": P.search_conditions([{"data_type": "doc"}, {"platform": "src2", "audit_result": 0}], (1, 2))})).select("id")


@query(_W + "SELECT id, quality_level = 'high' AS high FROM kb WHERE from_type_norm IN ('document', 'html') AND audit_result = -1 AND insert_time <= '2024-01-01 09:00:00'")
def f12_aged(spark, d):
    return knowledge(spark, d).where(P.aged_unaudited(["document", "html"], "2024-01-01 09:00:00")).select("id", (F.col("quality_level") == "high").alias("high"))


@query(_W + "SELECT id, n_chars FROM kb WHERE n_chars > 500")
def f15_above(spark, d):
    return knowledge(spark, d).where(P.above("n_chars", 500)).where(P.above("n_chars", -1)).select("id", "n_chars")


@query("SELECT event_id FROM events WHERE user_id % 5 IN (1, 2) AND event_type NOT IN ('error')")
def f18_allowed_rooms(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("user_id % 5").alias("robot"), F.col("event_type").alias("group_name"))
    white = spark.createDataFrame([(1,), (2,), (2,)], "robot long")
    return C.allowed_rooms(e, white, spark.createDataFrame([("error",)], "group_name string")).select("event_id")


@query(_W + "SELECT id FROM kb WHERE data_type IN ('qa', 'doc') AND index_name IN ('kb0', 'kb2')")
def f20_data_types(spark, d):
    return S.index_scan(knowledge(spark, d).where(F.col("data_type").isin(*P.data_types_of(["qa, doc", "qa"]))), " KB0, kb2").select("id")


# -- scans ------------------------------------------------------------------------

@query(_W + "SELECT id, from_file_name FROM kb WHERE task_id = 'task7' AND data_type = 'segment'")
def s28_task_segments(spark, d):
    return S.task_segments(knowledge(spark, d), "task7").select("id", "from_file_name")


@query("SELECT c_mktsegment AS address, count(*) > 0 AS some FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1")
def s30_recipients(spark, d):
    t = table(spark, d, "customer").select(F.expr("if(c_custkey % 4 = 0, concat('# ', c_name), c_name)").alias("name"), F.col("c_mktsegment").alias("address"))
    return S.recipients(t, "name", "address").select("address", F.lit(True).alias("some"))


@query("SELECT r_name AS region, n_name AS nation, CAST(n_nationkey AS BIGINT) AS k FROM nation JOIN region ON r_regionkey = n_regionkey")
def s31_dictionary(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("n_nationkey").cast("long").alias("k"))
    return S.dictionary(t, "region", "nation", value="k").select("region", F.explode("map").alias("nation", "k"))


@query("SELECT p.page_id, length(d.text) AS n FROM documents d JOIN pages p ON p.page_id = d.doc_id WHERE length(d.text) >= 400 AND d.lang <> 'de' AND d.text NOT LIKE '%an%'")
def s13_crawled(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.expr("if(lang = 'de', 'gone', 'ok')").alias("status"))
    manifest = table(spark, d, "pages").join(lang, "page_id").select(F.col("page_id").cast("string").alias("file"), "url", F.lit("t").alias("title"), "status")
    return S.crawled(texts, manifest, 400, F.col("text").contains("an")).select(F.col("source").cast("long").alias("page_id"), F.length("text").alias("n"))


@query("SELECT p_partkey AS row_no, p_name AS q, p_brand AS a, CAST(2 AS INTEGER) AS n_synonyms FROM part WHERE p_size % 3 <> 0")
def s20_qa_rows(spark, d):
    cells = F.expr("map(' 标准问题', p_name, '答案', if(p_size % 3 = 0, ' ', p_brand), 'Synonyms', concat(p_type, '; x'))")
    t = _part(spark, d).select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.col("p_partkey").alias("row_no"), cells.alias("cells"))
    return S.qa_rows(t).select("row_no", "q", "a", F.size("synonyms").alias("n_synonyms"))


# -- lookups -----------------------------------------------------------------------

@query(f"WITH {_TREE} SELECT n.name, r.name || '-' || n.name AS path FROM t n JOIN t r ON n.parent_id = r.id")
def j3_leaf_paths(spark, d):
    return T.leaf_paths(T.paths(_tree(spark, d))).select("name", F.explode("paths").alias("path"))


@query(f"WITH {_TREE} SELECT id, CAST(CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS level, coalesce(parent_id, id) AS root_id FROM t")
def h32_tree_nodes(spark, d):
    p = T.paths(_tree(spark, d))
    return p.select("id", T.level_of("path").alias("level"), "root_id")


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 25 <> 24 THEN o_custkey % 25 ELSE 0 END AS BIGINT) AS category_id, CASE WHEN o_custkey % 25 <> 24 THEN 0.9 ELSE 0.5 END::DOUBLE AS score FROM orders")
def j4_best_category(spark, d):
    c = lambda i, s: F.struct(i.cast("long").alias("category_id"), F.lit(s).alias("score"))
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("id"), F.array(c(F.lit(99), 1.0), c(F.expr("o_custkey % 25"), 0.9), c(F.lit(0), 0.5), c(F.lit(1), 0.5)).alias("cs"))
    chains = table(spark, d, "nation").where("n_nationkey < 24").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("chain"))
    return J.best_category(rows, "cs", chains, "id").select("id", "category_id", "score")


_LEAF = "l AS (SELECT r_name || '-' || n_name AS path, n_name AS leaf FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {_LEAF}, n AS (SELECT s_suppkey AS id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT id, CAST(CASE id % 3 WHEN 0 THEN 300 WHEN 1 THEN 200 ELSE 100 END AS INTEGER) AS score, l.leaf AS category_name FROM n JOIN l ON l.leaf = n.n_name")
def j5_infer_category(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    tree = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("-", "r_name", "n_name").alias("path"), F.col("n_name").alias("leaf"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 3 = 0, lower(n_name), 'none')").alias("explicit"), F.expr("if(s_suppkey % 3 = 1, array('x', concat('in ', n_name)), array('y'))").alias("tags"), F.expr("if(s_suppkey % 3 = 2, concat('about ', n_name, ' and'), 'nothing')").alias("title"))
    return J.infer_category(rows, tree, "id", "explicit", "tags", "title").select("id", "score", "category_name")


@query("WITH t AS (SELECT a.p_partkey AS id, replace(a.p_name, ' ', '') AS x, replace(b.p_name, ' ', '') AS y, split_part(b.p_name, ' ', 1) AS w FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT id, contains(x, y) OR contains(y, x) OR contains(x, w) OR contains(w, x) AS hit FROM t")
def j7_names_match(spark, d):
    p = _part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    t = p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return t.select("id", (J.names_match(F.col("a"), F.concat(F.col("b"), F.lit(" (x)"))) | J.names_match(F.upper("a"), F.substring_index("b", " ", 1))).alias("hit"))


_QA = "p AS (SELECT DISTINCT conv_id, turn, text, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM conversations), o AS (SELECT a.conv_id AS a_grp, a.turn AS a_pos, b.turn AS b_pos, a.k AS ak, b.k AS bk, list_distinct(string_split(a.k, '')) AS ac, list_distinct(string_split(b.k, '')) AS bc FROM p a JOIN p b ON a.conv_id = b.conv_id)"
_OV = "CASE WHEN ak = '' OR bk = '' THEN 0 WHEN contains(ak, bk) OR contains(bk, ak) THEN 1 ELSE len(list_intersect(ac, bc))::DOUBLE / least(len(ac), len(bc)) END"


@query(f"WITH {_QA}, s AS (SELECT a_grp AS grp, a_pos AS x, b_pos AS y, {_OV} AS s FROM o), q AS (SELECT grp, x AS key, y AS qpos, s AS qs FROM s WHERE s >= 0.8), n AS (SELECT q.grp, q.key, q.qpos, a.y AS pos, a.s AS sa, q.qs FROM q JOIN s a ON a.grp = q.grp AND a.x = q.key + 1 AND a.y BETWEEN q.qpos - 5 AND q.qpos + 9), b AS (SELECT grp, key, max(sa) AS best FROM n GROUP BY 1, 2) SELECT grp * 1000 + key AS key, best::DOUBLE AS sa FROM b WHERE best >= 0.8")
def j9_history_match(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text").distinct()
    h = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    a = c.select(F.col("conv_id").alias("g"), (F.col("turn") - 1).alias("t"), F.col("text").alias("a"))
    pairs = c.join(a, (F.col("conv_id") == F.col("g")) & (F.col("turn") == F.col("t"))).select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("conv_id").alias("grp"), F.col("text").alias("q"), "a")
    return J.history_match(pairs, h).select("key", F.col("as").alias("sa"))


@query("WITH a AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) SELECT a.conv_id AS key, min(c.role) AS speaker FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.t GROUP BY 1")
def j10_answer_speaker(spark, d):
    c = table(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    lines = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.col("text").alias("content"))
    return J.answer_speaker(first.select(F.col("conv_id").alias("key"), F.col("conv_id").alias("grp"), "answer"), lines).select("key", "speaker")


@query("WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s) SELECT id, other, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def j14_duplicate_candidates(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("qa").alias("data_type"), F.col("label").cast("string").alias("platform"), F.col("embedding").alias("vec"))
    return J.duplicate_candidates(e, e).select("id", "other", "similarity", "rank")


@query("WITH a AS (SELECT doc_id AS id, lang AS x, CAST(NULL AS BIGINT) AS y FROM documents WHERE source = 'src0'), b AS (SELECT doc_id AS id, source AS x, n_chars AS y FROM documents WHERE lang = 'en') SELECT id, coalesce(a.x, b.x) AS x, b.y, CAST(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS route, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN '0,1' WHEN a.id IS NOT NULL THEN '0' ELSE '1' END AS routes FROM a FULL JOIN b USING (id)")
def j15_merge_routes(spark, d):
    t = table(spark, d, "documents")
    a = t.where("source = 'src0'").select(F.col("doc_id").alias("id"), F.col("lang").alias("x"), F.lit(None).cast("long").alias("y"))
    b = t.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("source").alias("x"), F.col("n_chars").alias("y"))
    m = J.merge_routes(a, b, fill=("y",))
    return m.select("id", "x", "y", "route", F.array_join(F.transform("routes", lambda r: r.cast("string")), ",").alias("routes"))


@query("SELECT p_partkey AS idx, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS tags FROM part")
def j18_verified_labels(spark, d):
    p = _part(spark, d)
    labels = p.select(F.col("p_partkey").alias("idx"), F.expr("if(p_size % 4 = 0, 'zz qq', p_name)").alias("question"), F.col("p_brand").alias("tags"))
    return J.verified_labels(p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("q")), labels).select("idx", "tags")


@query("WITH o AS (SELECT c_mktsegment AS md5, min('old/' || c_custkey) AS path FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT o_orderkey AS id, coalesce(o.path, 'new/' || o_orderkey) AS path FROM orders LEFT JOIN o ON o.md5 = CASE o_orderkey % 3 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'HOUSEHOLD' ELSE 'none' END")
def j19_remap(spark, d):
    old = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("md5"), F.expr("concat('old/', c_custkey)").alias("path"))
    new = _orders(spark, d).select(F.col("o_orderkey").alias("id"), F.expr("case o_orderkey % 3 when 0 then 'MACHINERY' when 1 then 'HOUSEHOLD' else 'none' end").alias("md5"), F.expr("concat('new/', o_orderkey)").alias("path"))
    return J.remap_by_hash(new, old).select("id", "path")


@query("WITH a AS (SELECT p_type AS sheet, p_partkey AS row_no, p_name, p_brand FROM part), b AS (SELECT p_type AS sheet, p_partkey AS row_no, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part WHERE p_type <> 'ECONOMY' AND p_size <> 7), j AS (SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.row_no, b.row_no) AS row_no, a.p_name AS an, b.p_name AS bn, a.p_brand AS ab, b.p_brand AS bb FROM (SELECT * FROM a WHERE sheet IN (SELECT sheet FROM b)) a FULL JOIN b ON a.sheet = b.sheet AND a.row_no = b.row_no) SELECT sheet, row_no, 'p_name' AS \"column\", an AS old, bn AS new FROM j WHERE an IS DISTINCT FROM bn UNION ALL SELECT sheet, row_no, 'p_brand', ab, bb FROM j WHERE ab IS DISTINCT FROM bb")
def j20_sheet_diff(spark, d):
    p = _part(spark, d)
    a = p.select(F.col("p_type").alias("sheet"), F.col("p_partkey").alias("row_no"), "p_name", "p_brand")
    b = p.where("p_type <> 'ECONOMY' and p_size <> 7").select(F.col("p_type").alias("sheet"), F.col("p_partkey").alias("row_no"), F.expr("if(p_size % 5 = 0, upper(p_name), p_name)").alias("p_name"), "p_brand")
    return J.sheet_diff(a, b, ["p_name", "p_brand"])


@query("WITH u AS (SELECT p_brand AS platform, p_name AS w FROM part WHERE p_size < 25 UNION SELECT p_brand, p_type FROM part WHERE p_size > 10) SELECT platform, string_agg(w, ',' ORDER BY w) AS words FROM u GROUP BY 1")
def j22_merge_word_lists(spark, d):
    p = _part(spark, d)
    a = p.where("p_size < 25").groupBy(F.col("p_brand").alias("platform")).agg(F.collect_set("p_name").alias("words"))
    b = p.where("p_size > 10").groupBy(F.col("p_brand").alias("platform")).agg(F.collect_set("p_type").alias("words"))
    return J.merge_word_lists(a, b).select("platform", F.array_join(F.array_sort("words"), ",").alias("words"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS category_id, n_name AS category_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j23_fill_names(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 2 = 0, cast(s_nationkey as bigint), null)").alias("category_id"), F.expr("if(s_suppkey % 2 = 1, n_name, null)").alias("category_name"))
    return J.fill_names(rows, n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))).select("id", "category_id", "category_name")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE r_name || '-' || n_name END AS category_path, CAST(CASE WHEN n_nationkey % 3 = 0 THEN r_regionkey + 1000 ELSE n_nationkey END AS BIGINT) AS category_id FROM nation JOIN region ON r_regionkey = n_regionkey")
def j24_deepest_category(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    paths = t.select(F.concat_ws("-", "r_name", "n_name").alias("path"), F.col("n_nationkey").cast("long").alias("category_id")).unionByName(t.select(F.col("r_name").alias("path"), (F.col("r_regionkey") + 1000).cast("long").alias("category_id")).distinct())
    rows = t.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("platform"), F.expr("if(n_nationkey % 3 = 0, 'nowhere', n_name)").alias("site"))
    return J.deepest_category(rows, paths).select("id", "category_path", "category_id")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'own ' || n_name WHEN 1 THEN 'all ' || n_name ELSE n_name END AS mapped FROM nation")
def x42_name_with_fallback(spark, d):
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("c").alias("category"))
    names = n.where("n_nationkey % 3 = 0").select(F.lit("c").alias("category"), F.col("n_name").alias("name"), F.concat(F.lit("own "), "n_name").alias("mapped"))
    names = names.unionByName(n.where("n_nationkey % 3 < 2").select(F.lit("all").alias("category"), F.col("n_name").alias("name"), F.concat(F.lit("all "), "n_name").alias("mapped")))
    return T.name_with_fallback(rows, names).select("id", "mapped")


@query("WITH l AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer), a AS (SELECT DISTINCT dst AS url FROM l WHERE src IN (SELECT max(c_custkey) FROM customer)), b AS (SELECT DISTINCT dst AS url FROM l WHERE src IN (SELECT url FROM a)) SELECT (SELECT max(c_custkey) FROM customer) AS url, CAST(0 AS INTEGER) AS depth UNION ALL SELECT url, 1 FROM a UNION ALL SELECT url, 2 FROM b WHERE url NOT IN (SELECT url FROM a)")
def x94_breadth_first(spark, d):
    c = table(spark, d, "customer")
    return T.breadth_first(c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst")), c.agg(F.max("c_custkey").alias("url")), 2)


# -- aggregates ------------------------------------------------------------------

@query("SELECT count(*) AS groups, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS failed_groups, CAST(sum(o_orderkey % 7) AS BIGINT) AS calls, count(DISTINCT o_custkey) AS robots FROM orders")
def a24_run_totals(spark, d):
    return A.run_totals(_orders(spark, d).select(F.col("o_custkey").alias("robot"), F.col("o_orderkey").alias("group_name"), (F.col("o_orderstatus") == "F").alias("failed"), F.expr("o_orderkey % 7").alias("calls")))


@query("SELECT o_orderstatus AS old_level, o_orderpriority AS new_level, count(*) AS n FROM orders GROUP BY 1, 2")
def a19_level_transitions(spark, d):
    return A.level_transitions(_orders(spark, d).select(F.col("o_orderstatus").alias("old_level"), F.col("o_orderpriority").alias("new_level")))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 9 THEN 1 ELSE count(*) OVER (PARTITION BY CASE WHEN p_size >= 9 THEN p_brand END) END AS group_count FROM part")
def a22_group_sizes(spark, d):
    return A.group_sizes(_part(spark, d).select(F.col("p_partkey").alias("id"), F.expr("if(p_size < 9, null, p_brand)").alias("g")), "g").select("id", "group_count")


@query("SELECT event_type AS key, count(*) AS doc_count, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a5_complete_terms(spark, d):
    return A.terms(table(spark, d, "events"), "event_type", 1000, {"mean": F.round(F.avg("value"), 6)})


# -- maintenance -----------------------------------------------------------------

@query(_W + "SELECT id, CASE WHEN data_type = 'qa' THEN 'x' ELSE platform END AS platform, CASE WHEN data_type = 'qa' THEN 'n' ELSE client END AS name, quality_level AS lvl FROM kb")
def k2_assign_dotted(spark, d):
    t = knowledge(spark, d).select("id", "platform", "data_type", F.struct(F.col("client").alias("name"), F.col("quality_level").alias("lvl")).alias("info"))
    return M.assign(t, {"platform": "x", "info.name": F.lit("n")}, F.col("data_type") == "qa").select("id", "platform", "info.name", "info.lvl")


@query(_W + "SELECT id, index_name FROM kb WHERE id = 7")
def k3_get(spark, d):
    return M.get(knowledge(spark, d), 7, ["kb2", "kb1", "kb0"]).select("id", "index_name")


@query(_W + "SELECT id, platform FROM kb WHERE id NOT IN (1, 2, 3)")
def k3_delete(spark, d):
    return M.delete(knowledge(spark, d), [1, 2, 3]).select("id", "platform")


@query(_W + "SELECT del_flag = 0 AS active, count(*) AS n FROM (SELECT CASE WHEN task_id = 'task3' THEN 1 ELSE del_flag END AS del_flag FROM kb WHERE task_id IN ('task3', 'task4')) GROUP BY 1")
def k13_delete_batch(spark, d):
    t, _ = M.soft_delete(knowledge(spark, d), F.col("task_id") == "task3")
    return t.where("task_id in ('task3', 'task4')").groupBy((F.col("del_flag") == 0).alias("active")).agg(F.count("*").alias("n"))


@query(_W + "SELECT id, quality_level, del_flag FROM kb")
def k27_restore(spark, d):
    t = knowledge(spark, d).select("id", "quality_level", "del_flag", "data_type")
    changed, before = M.soft_delete(t, F.col("data_type") == "doc")
    changed = M.assign(changed, {"quality_level": "lost"}, F.col("data_type") == "doc")
    return M.restore(changed, before, ["quality_level", "del_flag"]).select("id", "quality_level", "del_flag")


@query(_C + "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'tag' || (id % 5) END, category) AS category FROM chat")
def k26_write_back(spark, d):
    t = chat(spark, d).select("id", "category")
    return M.join_update(t, t.select("id", F.expr("if(id % 3 = 0, concat('tag', id % 5), null)").alias("category")))


@query(_W + "SELECT id, coalesce(CASE WHEN l.toxic = 1 THEN NULL ELSE l.toxic END, CASE WHEN k.data_type = 'qa' THEN 5 END) AS toxic, 'd' AS dataset FROM kb k LEFT JOIN labels l ON l.doc_id = k.id")
def x11_static_backfill(spark, d):
    t = knowledge(spark, d).select("id", "data_type").join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.expr("if(toxic = 1, null, toxic)").alias("toxic")), "id", "left")
    return M.backfill(M.backfill(t, {"toxic": 5}, F.col("data_type") == "qa"), {"dataset": "d"}).select("id", "toxic", "dataset")


@query("SELECT vec_id AS id, label AS a, 'k' AS c FROM embeddings")
def x20_drop_paths(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.struct(F.col("label").alias("a"), F.col("embedding").alias("b"), F.lit("k").alias("c")).alias("s"), "embedding")
    return M.drop_paths(t, ["s.b", "embedding", "nothing.x"]).select("id", "s.*")


@query("WITH s AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10), n AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size >= 10) SELECT p_brand, p_type, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM n WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM s)) GROUP BY 1, 2")
def x30_insert_unique(spark, d):
    p = _part(spark, d)
    state = p.where("p_size < 10").select("p_brand", "p_type").distinct()
    fresh, _ = M.insert_unique(state, p.where("p_size >= 10").select("p_brand", "p_type"), ["p_brand", "p_type"])
    return fresh.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS refused FROM part WHERE p_size >= 10 AND (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_size < 10)")
def x30_refused(spark, d):
    p = _part(spark, d)
    _, clash = M.insert_unique(p.where("p_size < 10").select("p_brand", "p_type").distinct(), p.where("p_size >= 10").select("p_brand", "p_type"), ["p_brand", "p_type"])
    return clash.agg(F.count("*").alias("refused"))


@query(_W + "SELECT k.id, CASE WHEN n.other IS NOT NULL THEN 1 ELSE k.del_flag END AS del_flag, CASE WHEN n.other IS NOT NULL THEN 'cover_by_new ' || n.by END AS del_reason FROM kb k LEFT JOIN (SELECT md5(content) AS h, min(id) AS by FROM kb GROUP BY 1 HAVING count(*) > 1) g ON g.h = md5(k.content) LEFT JOIN (SELECT id AS other, 0 AS x, NULL AS by FROM kb WHERE false) n2 ON false LEFT JOIN LATERAL (SELECT CASE WHEN g.by <> k.id THEN k.id END AS other, g.by AS by) n ON true")
def k4_cover(spark, d):
    t = knowledge(spark, d)
    first = t.groupBy(F.md5("content").alias("h")).agg(F.min("id").alias("id"))
    dup = t.select(F.col("id").alias("other"), F.md5("content").alias("h")).join(first, "h").where("id <> other").select("id", "other")
    return M.cover(t, M.insert_gate(t.select("id"), dup, replace=True)).select("id", "del_flag", "del_reason")


@query("SELECT vec_id AS id, CAST(1 AS INTEGER) AS n FROM embeddings")
def k1_drop_zero_vectors(spark, d):
    i = lambda t, v: F.struct(F.lit(t).alias("text"), v.alias("embedding"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(i("a", F.col("embedding")), i("z", F.transform("embedding", lambda x: x * 0))).alias("idx"))
    return e.select("id", F.size(M.drop_zero_vectors(F.col("idx"))).alias("n"))


_NEW = "p_size % 2 = 0"


@query(f"SELECT CASE WHEN {_NEW} THEN md5(p_name || '_' || p_type || '_' || 'qa') ELSE 'k' || p_partkey END AS id, p_name AS title, CASE WHEN {_NEW} THEN 'mid' ELSE 'odd' END AS quality_level, CASE WHEN {_NEW} THEN 0 END AS del_flag, '{{\"extra\":\"' || p_brand || '\"}}' AS ext_info, p_name AS index_texts, count(*) AS n FROM part GROUP BY ALL")
def g1_prepare(spark, d):
    t = _part(spark, d).select(F.expr(f"if({_NEW}, null, concat('k', p_partkey))").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.lit("qa").alias("data_type"), F.expr(f"if({_NEW}, null, 'odd')").alias("quality_level"), F.col("p_brand").alias("extra"), F.array(F.lit(" "), F.col("p_name")).alias("synonyms_title"))
    out = M.prepare(t, ["title", "content", "data_type", "quality_level", "synonyms_title"], "2024-01-01 00:00:00")
    return out.groupBy("id", "title", "quality_level", "del_flag", "ext_info", F.array_join("index_texts", "|").alias("index_texts")).agg(F.count("*").alias("n"))


# -- pictures ----------------------------------------------------------------------

def _marked(spark, d):
    """Rows of two or three marks: an own picture, one of the brand, and the own one again."""
    x = F.expr("concat('as shown: [multimodal_prefix]p/', p_partkey, ') then see below [multimodal_prefix]b/', substring(p_brand, 7), if(p_size % 2 = 0, concat(' again [multimodal_prefix]p/', p_partkey, ' end'), ''))")
    return _part(spark, d).select(F.col("p_partkey").alias("id"), "p_size", "p_brand", x.alias("content"))


_MARKS = "m AS (SELECT p_partkey AS id, 0 AS pos, 'p/' || p_partkey AS path, 'h' || p_partkey AS md5, p_size, p_brand FROM part UNION ALL SELECT p_partkey, 1, 'b/' || substr(p_brand, 7), 'B' || substr(p_brand, 7), p_size, p_brand FROM part UNION ALL SELECT p_partkey, 2, 'p/' || p_partkey, 'h' || p_partkey, p_size, p_brand FROM part WHERE p_size % 2 = 0)"


@query(f"WITH {_MARKS} SELECT id, CAST(pos AS INTEGER) AS pos, path FROM m")
def x24_markers(spark, d):
    return I.markers(_marked(spark, d), "id", "content")


@query(f"WITH {_MARKS} SELECT id, CAST(pos AS INTEGER) AS pos FROM m WHERE pos = 0 OR pos = 1")
def x26_pointed_marks(spark, d):
    return I.pointed_marks(_marked(spark, d), "id", "content", ["as shown", "shown", "see below"])


@query(f"WITH {_MARKS} SELECT id, CAST(pos AS INTEGER) AS pos, path, CASE WHEN pos = 2 THEN 'drop_duplicate' WHEN pos = 1 AND p_size % 3 = 0 THEN 'drop_page_mismatch' ELSE 'keep' END AS action FROM m")
def q19_prune_plan(spark, d):
    t = _marked(spark, d)
    marks = I.markers(t, "id", "content")
    contents = t.select(F.expr("concat('p/', id)").alias("path"), F.expr("concat('h', id)").alias("md5")).unionByName(t.select(F.expr("concat('b/', substring(p_brand, 7))").alias("path"), F.expr("concat('B', substring(p_brand, 7))").alias("md5")).distinct())
    allowed = t.select("id", F.expr("concat('h', id)").alias("md5")).unionByName(t.where("p_size % 3 = 1").select("id", F.expr("concat('B', substring(p_brand, 7))").alias("md5")))
    return I.plan(marks, contents, allowed, t.where("p_size % 3 = 2").select("id", F.lit(1).alias("pos")))


@query("SELECT s_suppkey AS file, CAST(unnest([1, 1]) AS INTEGER) AS page_no, unnest(['a', 'b']) AS md5, unnest([true, false]) AS attachable FROM supplier")
def x25_page_index(spark, d):
    i = lambda m, s: F.struct(F.lit(m).alias("md5"), F.lit(s).cast("string").alias("s3_path"), F.lit("f").alias("fileName"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(1).alias("page_no"), F.array(i("a", "s3://x"), i("b", None)).alias("images"))
    return I.page_index(t).select("file", "page_no", "md5", "attachable")


@query("SELECT p_partkey AS id, 't,a/' || p_partkey || ',new' AS paths FROM part")
def x29_rebuild(spark, d):
    i = lambda c: F.struct(c.alias("path"))
    own = F.expr("concat('a/', p_partkey)")
    out = I.rebuild(F.array(i(F.lit("t"))), F.array(i(F.lit("z")), i(own)), F.array(own, F.lit("gone")), F.array(i(F.lit("new"))))
    return _part(spark, d).select(F.col("p_partkey").alias("id"), F.array_join(out["path"], ",").alias("paths"))


@query("SELECT p_partkey AS id, p_name || ' end' AS cleaned, p_brand AS text_part, 'http://h/x' AS image_part FROM part")
def x21_clean_parts(spark, d):
    p = lambda k, c: F.struct(F.lit(k).alias("type"), c.alias("content"))
    parts = I.clean_parts(F.array(p("text", F.concat("p_brand", F.lit(" http://h/x"))), p("image", F.lit("http://h/x"))), ["http://h/x"])
    return _part(spark, d).select(F.col("p_partkey").alias("id"), I.delete_exactly(F.concat("p_name", F.lit("http://h/x end")), ["http://h/x"]).alias("cleaned"), F.trim(parts[0]["content"]).alias("text_part"), parts[1]["content"].alias("image_part"))


@query("SELECT page_id, page_id % 3 = 0 AS dead FROM pages")
def x23_link_status(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("u"))
    status = p.where("page_id % 3 <> 2").select(F.col("u").alias("url"), F.expr("if(page_id % 3 = 0, 404 + 6 * (page_id % 2), 200)").alias("code"))
    return I.link_status(p, "u", status).select("page_id", "dead")


# -- ontologies --------------------------------------------------------------------

@query(f"WITH {_ONT} SELECT id, CASE WHEN client = '' AND product = '' THEN 'global' WHEN client = '' THEN 'industry' WHEN product = '' THEN 'client' ELSE 'client_product' END AS scope, NOT (client = 'acme' AND product = 'shop') AS fallback FROM o")
def x34_scope_label(spark, d):
    return _ontologies(spark, d).select("id", O.scope_label(F.col("client"), F.col("product"), "acme", "shop").alias("s")).select("id", "s.*")


@query("SELECT n_nationkey AS id, 'p' AS path, 'duplicate_name' AS issue, upper(n_name) AS name FROM nation WHERE n_nationkey % 4 = 0")
def x35_duplicate_names(spark, d):
    names = F.array(F.upper("n_name"), F.when(F.expr("n_nationkey % 4 = 0"), F.concat(F.lower("n_name"), F.lit(" "))).otherwise("other"))
    return O.duplicate_names(table(spark, d, "nation").withColumn("id", F.col("n_nationkey")), "id", "p", names)


@query("SELECT n_nationkey AS id, 'O.' || n_name AS path, 'field_combination' AS issue, CASE n_nationkey % 4 WHEN 1 THEN 'value_set' WHEN 2 THEN 'ref' ELSE 'item_type' END AS name FROM nation WHERE n_nationkey % 4 <> 0")
def x36_combination_issues(spark, d):
    kind = F.expr("case n_nationkey % 4 when 1 then 'enum' when 2 then 'ref' when 3 then 'array' else 'string' end")
    doc = F.concat(F.lit('{"name":"n","object_types":[{"name":"O","attributes":[{"name":"'), F.col("n_name"), F.lit('","data_type":"'), kind, F.lit('"}]}]}'))
    return O.combination_issues(O.parse(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), doc.alias("data_json"))), "id")


@query("SELECT n_nationkey AS id, 'r' AS path, 'unknown_reference' AS issue, n_name AS name FROM nation WHERE n_nationkey % 3 = 0")
def x37_broken_references(spark, d):
    t = table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
    return O.broken_references(t, "id", F.array(F.when(F.expr("n_nationkey % 3 = 0"), F.lit("x")).otherwise(F.col("n_name")), F.lit("y")), F.array("n_name", F.lit("y"), F.lit("")), "r")


# -- batches, marks, samples -------------------------------------------------------

@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN 'l' || o_orderkey END AS label FROM orders")
def q20_batched_labels(spark, d):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = _orders(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"), pos.alias("pos"))
    labels = o.select("batch", "pos", F.expr("concat('l', id)").alias("label")).where("not (batch % 4 = 0 and pos = 1)")
    return Q.batched_labels(o, labels).select("id", "label")


@query("SELECT user_id, max(ts) AS mark FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type <> 'error') GROUP BY 1")
def x91_marks_of_completed(spark, d):
    e = table(spark, d, "events")
    none = e.where("false").select("user_id", F.col("ts").alias("mark"))
    return R.next_marks(none, e, ["user_id"], "ts", e.where("event_type <> 'error'"))


@query(_W + "SELECT id FROM kb WHERE id NOT IN (SELECT doc_id FROM labels)")
def x75_pending(spark, d):
    return R.pending(knowledge(spark, d).select("id"), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("WITH o AS (SELECT o_custkey AS id, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT id AS qid, o_orderkey AS id, CAST(r AS INTEGER) AS rank FROM o WHERE r <= 3")
def t1_rerank(spark, d):
    t = _orders(spark, d).select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("similarity"))
    return V.rerank(t, 100000.0, 3).select("qid", "id", "rank")


@query("WITH b AS (SELECT o_orderkey % 1000 AS id, max(o_totalprice) AS score FROM orders GROUP BY 1) SELECT id, score FROM b ORDER BY score DESC, id LIMIT 25")
def t2_best_of_queries(spark, d):
    t = _orders(spark, d).select(F.col("o_custkey").alias("qid"), F.expr("o_orderkey % 1000").alias("id"), F.col("o_totalprice").alias("score"))
    return V.best_over_queries(t, 25).select("id", "score")


_SETS = "list_sort(list_distinct(list_filter(string_split({}, ''), lambda c: c <> '')))"


@query(f"WITH p AS (SELECT p_partkey AS id, p_type, {_SETS.format('p_name || p_brand')} AS cs FROM part), l AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON a.p_type = b.p_type AND a.id <> b.id WHERE len(list_intersect(a.cs, b.cs))::DOUBLE / len(list_distinct(list_concat(a.cs, b.cs))) > 0.9) SELECT p.id AS p_partkey, min(p.id) OVER (PARTITION BY p.p_type, p.cs) AS rep, (SELECT count(*) FROM l WHERE l.id = p.id) AS n_links FROM p")
def v10_similar_links(spark, d):
    t = _part(spark, d).withColumn("q", F.concat("p_name", "p_brand"))
    return K.similar_links(t, ["p_type"], "p_partkey", "q")[0]


@query(_W + "SELECT id, CASE WHEN platform = 'src0' THEN 'high' ELSE quality_level END AS quality_level, del_flag FROM kb")
def x32_status_update(spark, d):
    t = knowledge(spark, d)
    return M.conditional_update(t, {"quality_level": "high"}, F.col("platform") == "src0")[0].select("id", "quality_level", "del_flag")


@query(_W + "SELECT id, content, title, platform FROM kb WHERE audit_result >= 1 AND data_type = 'qa' AND del_flag = 0")
def x13_audit_export(spark, d):
    return knowledge(spark, d).where(P.export_filter([], 1, ["qa"])).select("id", "content", "title", "platform")

import pytest
from pyspark.sql import functions as F

from tarnbase.operators import chat as C
from tarnbase.operators import cluster as K
from tarnbase.operators import images as I
from tarnbase.operators import joins as J
from tarnbase.operators import maintain as M
from tarnbase.operators import ontology as O
from tarnbase.operators import predicates as P
from tarnbase.operators import noise as N
from tarnbase.operators import quality as Q
from tarnbase.operators import search as V
from tarnbase.operators import segment as G
from tarnbase.operators import tree as T
from tarnbase.operators import windows as W


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


def test_attribute_filter_is_or_of_ands(spark):
    t = spark.createDataFrame([(1, "qa", ["x"], 0), (2, "doc", ["y"], 0), (3, "qa", None, 1)], "id int, data_type string, keywords array<string>, del_flag int")
    assert rows(t.where(P.attribute_filter(t, [{"data_type": "qa", "del_flag": 0}, {"keywords": "y"}, {}])), "id") == [(1,), (2,)]
    assert rows(t.where(P.query_filter(t, {"attribute": {"del_flag": 1}})), "id") == [(3,)]
    assert rows(t.where(P.query_filter(t, {})), "id") == [(1,), (2,)]


def test_repeats_follow_the_last_kept(spark):
    t = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 100.0), ("a", 3, 200.0), ("a", 4, None), ("b", 5, None), ("b", 6, None), ("a", 7, 320.0)], "k string, id int, e double")
    assert rows(W.suppress_repeats(t, ["k"], "e", "id"), "id") == [(1,), (3,), (5,)]
    far = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 121.0)], "k string, id int, e double")
    assert rows(W.suppress_repeats(far, ["k"], "e", "id"), "id") == [(1,), (2,)]


def test_turns(spark):
    t = spark.createDataFrame([("g", 1, "a", True, 0, ""), ("g", 2, "a", True, 180, "@x"), ("g", 3, "a", True, 361, ""), ("g", 4, "b", False, 362, ""), ("g", 5, "a", True, 363, "@y"), ("g", 6, "a", True, 364, "@z")], "g string, id int, who string, ok boolean, at int, m string")
    got = W.answer_turns(t, "g", ["at", "id"], "who", "ok", "at", "m")
    assert rows(got, "id", "turn") == [(1, 1), (2, 1), (3, 2), (4, None), (5, 3), (6, 4)]


def test_pages_and_gaps(spark):
    t = spark.createDataFrame([("d", 1, 50), ("d", 2, 60), ("d", 3, 500), ("d", 4, 10), ("d", 5, 10), ("d", 6, 10), ("d", 7, 10)], "doc string, page int, n int")
    assert rows(W.pack_pages(t, "doc", "page", "n", 100, 3), "start_page", "end_page") == [(1, 1), (2, 2), (3, 3), (4, 6), (7, 7)]
    seg = spark.createDataFrame([("c", "t", 2, 3), ("c", "t", 9, 20), ("c", "u", 30, 31)], "chunk string, title string, s int, e int")
    chunks = spark.createDataFrame([("c", 1, 10), ("d", 1, 4)], "chunk string, lo int, hi int")
    assert rows(W.fill_gaps(seg, chunks), "chunk", "s", "e", "is_gap") == [("c", 1, 1, True), ("c", 2, 3, False), ("c", 4, 6, True), ("c", 7, 8, True), ("c", 9, 10, False), ("d", 1, 3, True), ("d", 4, 4, True)]


def test_align(spark):
    peer = spark.createDataFrame([(1, "abcd"), (2, "abcx"), (3, "zzzz"), (4, "")], "key int, norm string")
    local = spark.createDataFrame([(1, "Q1", "abcd"), (2, "Q2", "abcd"), (3, "Q3", "abce")], "ord int, query string, norm string")
    assert rows(J.align_queries(peer, local), "key", "match_type", "local_query") == [(1, "exact", "Q1"), (2, "fuzzy", "Q1"), (3, "none", ""), (4, "none", "")]


def test_retire_plan(spark):
    state = spark.createDataFrame([("a", 0, "2024-01-01"), ("b", 1, "2024-01-01"), ("c", 0, "2024-02-01")], "id string, del_flag int, insert_time string")
    snap = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "id string")
    assert rows(J.retire_plan(snap, state, "2024-01-15")) == [("a", "delete"), ("b", "already_del"), ("c", "overwritten"), ("x", "missing")]


def test_history_and_speaker(spark):
    h = spark.createDataFrame([("g", i, c) for i, c in enumerate(["how to pay", "x", "use the card please", "bye"])], "grp string, pos int, content string")
    qa = spark.createDataFrame([(1, "g", "how to pay", "use the card please")], "key int, grp string, q string, a string")
    assert rows(J.history_match(qa, h), "key", "qpos", "pos") == [(1, 0, 2)]
    a = spark.createDataFrame([(1, "g", "use the card please")], "key int, grp string, answer string")
    assert J.answer_speaker(a, h.withColumn("speaker", F.concat(F.lit("s"), "pos"))).first()["speaker"] == "s2"


def test_infer_category(spark):
    tree = spark.createDataFrame([("p-Amazon", "Amazon"), ("p-eBay Shop", "eBay Shop")], "path string, leaf string")
    t = spark.createDataFrame([(1, "amazon", ["x"], "t"), (2, None, ["my ebay shop tips"], "Amazon"), (3, "", [], "about Amazon"), (4, "", [], "Amazonas")], "id int, platform string, tags array<string>, title string")
    assert rows(J.infer_category(t, tree, "id", "platform", "tags", "title"), "id", "score", "category_path") == [(1, 300, "p-Amazon"), (2, 200, "p-eBay Shop"), (3, 100, "p-Amazon"), (4, None, None)]


def test_sheet_diff(spark):
    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("only", 1, "z")], "sheet string, row_no int, v string")
    b = spark.createDataFrame([("s", 1, "x"), ("s", 2, "q"), ("s", 3, "n")], "sheet string, row_no int, v string")
    assert rows(J.sheet_diff(a, b, ["v"])) == [("s", 2, "v", "y", "q"), ("s", 3, "v", None, "n")]


def test_merge_routes(spark):
    a = spark.createDataFrame([(1, 5.0, None), (2, 4.0, "t2")], "id int, score double, title string")
    b = spark.createDataFrame([(1, 0.9, "t1"), (3, 0.8, "t3")], "id int, score double, title string")
    assert rows(J.merge_routes(a, b, fill=("title",)), "id", "score", "title", "route") == [(1, 5.0, "t1", 0), (2, 4.0, "t2", 0), (3, 0.8, "t3", 1)]


def test_bm25_prefers_the_rare_term(spark):
    t = spark.createDataFrame([(1, "apple pie"), (2, "apple tart"), (3, "plum pie")], "id int, c string")
    q = spark.createDataFrame([(1, "apple pie")], "qid int, text string")
    top = V.top(V.bm25(t, "id", {"c": ("c", 1.0)}, q), 3).orderBy("rank").collect()
    assert [r["id"] for r in top] == [1, 2, 3] and top[1]["score"] == pytest.approx(top[2]["score"])


def test_dual_halves(spark):
    b = spark.createDataFrame([(1, i, float(10 - i)) for i in range(6)], "qid int, id int, score double")
    k = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(2, 9)], "qid int, id int, cosine double")
    assert rows(V.dual(b, k, 4), "id", "route") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert rows(V.dual(b, k, 4, "bm25"), "id") == [(0,), (1,), (2,), (3,)]


def test_keywords(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.2)], "id int, term string, score double")
    b = spark.createDataFrame([(1, "x", 1.0), (1, "z", 0.9)], "id int, term string, score double")
    assert [r["term"] for r in V.merge_keywords(a, b, 2).orderBy("rank").collect()] == ["x", "z"]


@pytest.mark.parametrize("title, content, want", [("t", "请关注公众号", "boilerplate"), ("t", "https://a/b.png", "image_only_no_text"), ("t", "![x](https://a/b.png)", "image_only_no_text"), ("t", "看图", "thin_no_concrete_value"), ("t", "点击提交", None), ("t", "甲方、乙方、丙方", None), ("t", "https://official.site/x", None)])
def test_reject_reason(spark, title, content, want):
    t = spark.createDataFrame([(title, content)], "t string, c string")
    assert t.select(Q.reject_reason("t", "c")).first()[0] == want


def test_kept_and_rejected_are_all(spark):
    t = spark.createDataFrame([(str(i), "x" * i) for i in range(50)], "title string, content string")
    kept, gone = Q.split_quality(t)
    assert kept.count() + gone.count() == 50


def test_repair(spark):
    t = spark.createDataFrame([("活动内容", "本次活动有礼", "跨境电商年度峰会，报名"), ("跨境电商年度峰会安排", "正文", "跨境电商年度峰会，报名"), ("本次", "x", "")], "title string, content string, from_file_name string")
    got = rows(Q.repair_self_contained(t), "title", "content", "needs_review")
    assert ("跨境电商年度峰会：活动内容", "跨境电商年度峰会有礼", False) in got and ("本次", "x", True) in got


@pytest.mark.parametrize("line, want", [("好的", True), ("扫码马上报名", True), ("扫码报名吗?", False), ("https://a.b 教程", True), ("店铺怎么绑定收款账号", False), ("", True), ("http://a/b.png", False), ("@bob hi", True)])
def test_noise(spark, line, want):
    assert N.mark_noise(spark.createDataFrame([(line,)], "x string"), "x").first()["noise"] is want


def test_review_fails_closed(spark):
    t = spark.range(1).select(Q.review(F.lit("accept"), F.lit("high"), F.lit("universal"), F.lit(True), F.lit(True), F.lit(False), F.array().cast("array<string>")).alias("r"), Q.review(F.lit("yes"), F.lit("?"), F.lit("?"), F.lit(None).cast("boolean"), F.lit(False), F.lit(False), F.array().cast("array<string>")).alias("s")).first()
    assert (t["r"]["decision"], t["r"]["quality_level"], t["r"]["auto_import"]) == ("reject", "low", False)
    assert (t["s"]["decision"], t["s"]["quality_level"]) == ("review", "mid")


@pytest.mark.parametrize("x, want", [("カタカナ", "ja"), ("한국", "ko"), ("中文中文a", "zh"), ("中文abc", None), ("中" * 101, None), ("", None)])
def test_language_rule(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(Q.language_rule("x")).first()[0] == want


def test_greedy_clusters(spark):
    t = spark.createDataFrame([(1, "p", "how to pay now", "long answer here"), (2, "p", "how to pay now now", "short"), (3, "p", "zzz", "qqq"), (4, "o", "how to pay now", "x")], "id int, platform string, q string, a string")
    assert rows(K.qa_dedup(t), "id") == [(1,), (3,), (4,)]
    w = spark.createDataFrame([(1, "g", "Color"), (2, "g", "colour"), (3, "g", "shape"), (4, "g", " ")], "id int, grp string, word string")
    assert rows(K.edit_clusters(w, "grp", "id", "word"), "id", "cluster") == [(1, 0), (2, 0), (3, 1), (4, 2)]
    v = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [0.9, 0.1]), (3, "c", [0.0, 1.0]), (4, "c", [0.0, 0.0])], "id int, c string, v array<double>")
    assert rows(K.leaders(v, "c", "id", "v"), "id", "leader") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_upsert_and_audit(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    n = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert rows(M.upsert(s, n, "id", "seq")) == [(1, "a"), (2, "d"), (3, "e")]
    t = spark.createDataFrame([(1, "high", "qa", -1), (2, "mid", "segment", -1), (3, None, "qa", -1), (4, "high", "qa", 1)], "id int, quality_level string, data_type string, audit_result int")
    assert rows(M.auto_audit(t, F.col("audit_result") == -1), "id", "audit_result") == [(1, 2), (2, -1), (3, 0), (4, 1)]


def test_assign_needs_the_parent(spark):
    t = spark.createDataFrame([(1, (2,))], "id int, e struct<x:int>")
    assert M.assign(t, {"e.x": 5}).first()["e"]["x"] == 5
    bad = spark.createDataFrame([(1, None)], "id int, e struct<x:int>")
    with pytest.raises(Exception, match="missing parent"):
        M.assign(bad, {"e.x": 5}).collect()
    with pytest.raises(ValueError):
        M.assign(t, {"nope": 1})


def test_prepare(spark):
    t = spark.createDataFrame([("T", "C", "qa", ["S", " "], 9, "extra", None), ("T", "C", "segment", None, None, "y", "old")], "title string, content string, data_type string, synonyms_title array<string>, audit_result int, foo string, id string")
    got = {r["data_type"]: r for r in M.prepare(t, ["id", "title", "content", "data_type", "synonyms_title", "audit_result"], "2024-01-01 00:00:00").collect()}
    assert got["qa"]["audit_result"] == -1 and got["qa"]["index_texts"] == ["T", "S"] and got["qa"]["del_flag"] == 0 and "extra" in got["qa"]["ext_info"]
    assert got["segment"]["title"] is None and got["segment"]["del_flag"] is None and got["segment"]["id"] == "old"


def test_vectors_dropped_anywhere(spark):
    t = spark.createDataFrame([(1, [("a", [1.0])], [2.0])], "id int, indexes array<struct<text:string, embedding:array<float>>>, title_embedding array<float>")
    assert M.vector_fields(t) == ["indexes.embedding", "title_embedding"]
    assert M.drop_matching(t).schema.simpleString() == "struct<id:int,indexes:array<struct<text:string>>>"


def test_compare_and_set(spark):
    s = spark.createDataFrame([(1, "a", 3), (2, "b", 5)], "id int, v string, revision int")
    u = spark.createDataFrame([(1, 3, "x"), (2, 4, "y")], "id int, expected int, v string")
    assert rows(M.compare_and_set(s, u), "id", "v", "revision", "conflict") == [(1, "x", 4, False), (2, "b", 5, True)]


def test_materials():
    raw = "Title\n\n## One\n" + "A sentence here. " * 20 + "\n## Two\nshort\n## Three\n" + "Word word word. " * 200
    got = G.heading_chunks(raw)
    assert got[0][0] == "Title / One" and all(t != "Title / Two" for t, _ in got) and len(got) > 3
    assert all(len(b) <= 900 for t, b in got if t == "Title / Three")
    assert G.heading_chunks(None) == []
    assert G.table_blocks("a\tb\n1\n" + "x\ty\n" * 5, 40)[0].startswith("| a | b |\n| --- | --- |\n| 1 |  |")


def test_sentence_windows(spark):
    t = spark.createDataFrame([(1, "Aa. Bb. Cc. Dd.")], "id int, x string")
    got = rows(G.windows_by_limit(t, "id", "x", 8, 1), "no", "text", "overlapped")
    assert got == [(0, "Aa. Bb.", "Aa. Bb. Cc."), (1, " Cc. Dd.", " Bb. Cc. Dd.")]


def test_tree_guards_cycles(spark):
    t = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent_id string, name string")
    assert rows(T.paths(t), "id", "path") == [("a", "A"), ("b", "A-B"), ("c", "A-B-C")]
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 100)], "src int, dst int")
    got = {r["src"]: r["final"] for r in T.follow(links).collect()}
    assert got[0] == 20 and got[19] == 20
    page = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    assert rows(T.breadth_first(page, spark.createDataFrame([("a",)], "url string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("status", ["active", "inactive"])
@pytest.mark.parametrize("audit", ["pending", "approved", "rejected"])
@pytest.mark.parametrize("deleted", [0, 1])
def test_scope_serves_only_live_documents(spark, status, audit, deleted):
    t = spark.createDataFrame([(1, "c", "", "n", status, audit, deleted, 1)], "id int, client string, product string, name string, status string, audit_status string, del_flag int, update_time int")
    assert O.select_scope(t, "c", "p").count() == int((status, audit, deleted) == ("active", "approved", 0))


def test_image_plan(spark):
    marks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "id int, pos int, path string")
    content = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", "m2"), ("d", "m3")], "path string, md5 string")
    allowed = spark.createDataFrame([(1, "m1")], "id int, md5 string")
    pointed = spark.createDataFrame([(1, 3)], "id int, pos int")
    assert rows(I.plan(marks, content, allowed, pointed), "pos", "action") == [(0, "keep"), (1, "drop_duplicate"), (2, "drop_page_mismatch"), (3, "keep")]
    assert I.pointing("see below: [multimodal_prefix]x then [multimodal_prefix]y", ["see below", "below"]) == [0]


def test_rooms_skip_what_is_marked(spark):
    cols = "group_name string, send_name string, message_time string, content string, ctype string, msg_id int"
    t = spark.createDataFrame([("g", "a", "2024-01-01 00:00:00", "店铺怎么绑定账号", "TEXT", 1), ("g", "a", "2024-01-01 00:01:00", "店铺怎么绑定账号", "TEXT", 2), ("g", "a", "2024-01-01 00:10:00", "店铺怎么绑定账号", "text", 3), ("g", "a", "2024-01-01 00:11:00", "好的", "TEXT", 4), ("g", "a", "2024-01-01 00:12:00", "x.png", "IMG", 5)], cols)
    t = t.withColumns({c: F.lit(None).cast("string") for c in ("actual_user_nickname", "actual_user_id", "from_user_nickname", "from_user_id", "send_user")})
    assert rows(C.rooms(t), "msg_id") == [(1,), (3,), (5,)]
    marks = spark.createDataFrame([("g", "2024-01-01 00:10:00")], "group_name string, mark string")
    assert rows(C.rooms(t, marks), "msg_id") == [(5,)]


def test_wire_lines(spark):
    t = spark.createDataFrame([("bob\t2024-01-0200:00:00\t{\"conent\": \"hi\"}",), ("bad",)], "value string")
    assert rows(C.read_lines(t), "send_name", "message_time", "content") == [("bob", "2024-01-02 00:00:00", "hi")]

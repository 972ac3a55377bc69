"""Queries: text functions, web pages, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.functions import text as X
from tarnbase.functions import web as H
from tarnbase.operators import quality as Q
from tarnbase.operators import segment as G
from tarnbase.plans.registry import query
from tarnbase.plans.tables import KB, knowledge, table

_W = "WITH " + KB + " "


def _docs(spark, d, *cols):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), *cols)


@query(r"SELECT doc_id AS id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM documents")
def h1_norm_key(spark, d):
    return _docs(spark, d, F.md5(X.qa_key("text")).alias("key"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS content FROM conversations")
def h2_regular(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.regular_content("text").alias("content"))


@query(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)https?://|www\.|\.(jpg|jpeg|png|gif|webp|bmp|pdf)\b')), lambda s: trim(regexp_replace(s, '^(回复|引用|转发|@[^：:]+[:：]|[A-Za-z0-9_\-\x{4e00}-\x{9fff}]{1,20}[:：])', ''))), lambda s: s <> '') AS ls FROM conversations) SELECT conv_id, turn, left(trim(regexp_replace(array_to_string(ls, ' '), '\s+', ' ', 'g')), 300) AS line FROM l""")
def h3_chat_line(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.chat_line("text").alias("line"))


@query("WITH t AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d%H:%M:%S') AS glued FROM events) SELECT id, left(glued, 10) || ' ' || substr(glued, 11) AS time, CAST(epoch(CAST(left(glued, 10) || ' ' || substr(glued, 11) AS TIMESTAMP)) AS BIGINT) AS at FROM t")
def h9_message_time(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("date_format(ts, 'yyyy-MM-ddHH:mm:ss')").alias("glued"))
    return t.select("id", X.message_time("glued").alias("time"), X.message_epoch("glued").alias("at"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || 'x', '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content FROM conversations")
def h12_sanitise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.sanitise_chat(F.concat("text", F.lit("\n\n\n​x"))).alias("content"))


@query(r"WITH t AS (SELECT doc_id AS id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]') AS mail FROM documents) SELECT id, mail <> '' AS has_mail FROM t")
def h16_deidentify(spark, d):
    return X.generalise_column(table(spark, d, "documents"), "text", "clean").select(F.col("doc_id").alias("id"), F.col("clean").contains("[邮箱]").alias("has_mail"))


@query("SELECT o_orderkey AS id, CASE WHEN regexp_replace(lower(o_orderpriority), '[^\\p{L}\\p{N}]+', '', 'g') IN ('high', 'h', 'good') THEN 'high' WHEN regexp_replace(lower(o_orderpriority), '[^\\p{L}\\p{N}]+', '', 'g') IN ('low', 'l', 'bad') THEN 'low' ELSE 'mid' END AS level, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN false ELSE true END AS flag, greatest(0.0, least(1.0, CASE WHEN o_totalprice / 1000 > 1 THEN o_totalprice / 1000 / 100.0 ELSE o_totalprice / 1000 END))::DOUBLE AS confidence FROM orders")
def h17_norm_enum(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), X.level("o_orderpriority").alias("level"), X.flag(F.expr("case o_orderstatus when 'F' then 'No' when 'O' then '0' else 'YES' end")).alias("flag"), X.confidence(F.expr("cast(o_totalprice / 1000 as string)")).alias("confidence"))


@query(r"SELECT p_partkey AS id, regexp_extract(p_name || ' #a#b', '((?:#[^#\s]+)+)$', 1) AS raw, array_to_string(list_filter(string_split(regexp_extract(p_name || ' #a#b', '((?:#[^#\s]+)+)$', 1), '#'), lambda s: s <> ''), ',') AS tags, p_name AS body FROM part")
def h26_tags(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" #a#b")).alias("x"))
    return t.select("id", F.regexp_extract("x", r"((?:#[^#\s]+)+)$", 1).alias("raw"), F.array_join(X.trailing_tags("x"), ",").alias("tags"), X.without_tags("x").alias("body"))


@query("SELECT p_partkey AS id, p_name AS q, p_brand || ' x' AS a, p_type AS source FROM part")
def h24_parse_qa(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('###\n问题：', p_name, ' 答案: ', p_brand, ' [note]x', '\n来源: [', p_type, ']')").alias("x"))
    return t.select("id", F.explode(X.parse_qa("x")).alias("p")).select("id", "p.*")


@query(r"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS INTEGER) AS cjk, CAST(len(regexp_extract_all(text, '[A-z]')) AS INTEGER) AS letters FROM documents")
def h35_cjk_count(spark, d):
    return _docs(spark, d, X.cjk_count("text").alias("cjk"), X.letter_count("text").alias("letters"))


@query("SELECT doc_id AS id, array_to_string(list_concat(w, list_transform(range(5), lambda i: '[mask]'))[1:5], '|') AS seq FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def h39_pad_cut(spark, d):
    return _docs(spark, d, F.array_join(X.pad_cut(F.split("text", " "), 5), "|").alias("seq"))


@query(r"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]')) + len(regexp_extract_all(regexp_replace(text, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', ' ', 'g'), '\S+')) AS INTEGER) AS n FROM documents")
def h41_length(spark, d):
    return _docs(spark, d, X.text_length("text").alias("n"))


@query(r"SELECT doc_id AS id, coalesce(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) * 1.0 / nullif(length(text), 0) > 0.3, false) AS chinese FROM documents")
def h42_mostly_chinese(spark, d):
    return _docs(spark, d, X.mostly_chinese("text").alias("chinese"))


@query("SELECT p_partkey AS id, '![i](http://h/' || replace(p_brand, ' ', '_') || '.png)' AS markdown, 'http://h/' || replace(p_brand, ' ', '_') || '.png' AS url FROM part")
def h43_markdown_images(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(p_name, ' ![i](http://h/', replace(p_brand, ' ', '_'), '.png) tail')").alias("x"))
    return t.select("id", F.explode(X.markdown_images("x")).alias("m")).select("id", "m.*")


@query("SELECT p_partkey AS id, unnest([0, 1, 2])::INTEGER AS pos, unnest(['text', 'image_url', 'text']) AS type, unnest([trim(p_name), 'http://h/1.png', 'tail']) AS value FROM part")
def h44_elements(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(p_name, ' ![i](http://h/1.png) tail')").alias("x"))
    return t.select("id", F.posexplode(X.text_elements("x")).alias("pos", "e")).select("id", "pos", "e.*")


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_extract(lower(url), '^https?://([^/:?#]*)', 1), '.') AS h FROM pages) SELECT page_id, CASE WHEN len(h) >= 3 AND h[1] IN ('www', 'wap', 'm', 'mobile', 'api', 'blog', 'news') THEN array_to_string(h[2:], '.') WHEN len(h) >= 2 THEN array_to_string(h[-2:], '.') ELSE h[1] END AS domain FROM p""")
def h29_domain(spark, d):
    return table(spark, d, "pages").select("page_id", H.domain("url").alias("domain"))


@query(r"SELECT page_id, left(CASE WHEN s = '' THEN 'index' ELSE s END, 120) AS slug FROM (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '^/+|/+$', '', 'g'), '[^a-zA-Z0-9\-_/]+', '-', 'g'), '/', '_') AS s FROM pages)")
def h33_slug(spark, d):
    return table(spark, d, "pages").select("page_id", H.slug("url").alias("slug"))


_UN = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


def _bare(x: str) -> str:
    return "regexp_replace(regexp_replace(" + _UN.format(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')") + r", '[\s\x{00a0}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, trim(regexp_extract({_bare(chr(39) + chr(39))} || {_bare('raw')}, '^(.*?)(\\s*[|｜]|$)', 1)) AS title FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>(.*?)</title>') THEN regexp_extract(html, '(?is)<title>(.*?)</title>', 1) ELSE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) END AS raw FROM pages)")
def h45_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.page_title("html").alias("title"))


_BODY = "html"
for _tag in ("script", "style", "noscript", "nav", "footer", "header"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"


@query(f"SELECT page_id, trim({_bare(_BODY)}) AS text FROM pages")
def h47_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.page_text("html").alias("text"))


@query(None)
def h46_sections(spark, d):
    t = table(spark, d, "pages").select("page_id", F.posexplode(H.page_sections("html")).alias("pos", "s"))
    return t.select("page_id", "pos", "s.head", F.length("s.text").alias("n_chars"))


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#]+)', 1)) AS h FROM pages), f AS (SELECT page_id, base, regexp_replace(CASE WHEN h LIKE 'http%://%' THEN h ELSE base || h END, '/+$', '') AS u FROM a WHERE h LIKE '/%' OR h LIKE 'http%://%') SELECT DISTINCT page_id, u AS link FROM f WHERE u = base OR starts_with(u, base || '/') OR starts_with(u, base || '?')""")
def h48_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(H.page_links("url", "html")).alias("link")).distinct()


@query("SELECT p_partkey AS id, 'see http://cdn/' || 'a?b/' || p_partkey || '&filename=' || replace(p_brand, '#', '%23') || ' and http://cdn/rest' AS content FROM part")
def h51_render(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('see [multimodal_prefix]a?b/', p_partkey, ' and [multimodal_prefix]rest')").alias("c"), F.array(F.struct(F.expr("concat('a?b/', p_partkey)").alias("path"), F.col("p_brand").alias("fileName"))).alias("items"))
    return t.select("id", X.render_addresses("c", "items", "http://cdn/").alias("content"))


@query("SELECT p_partkey AS id, p_name || chr(10) || '[multimodal_prefix]p/' || p_partkey || chr(10) || 'http://u' AS content FROM part")
def h52_join_parts(spark, d):
    part = lambda kind, content, path, url: F.struct(F.lit(kind).alias("type"), content.alias("content"), path.alias("path"), url.alias("url"))
    null = F.lit(None).cast("string")
    items = F.array(part("text", F.col("p_name"), null, null), part("image", null, F.expr("concat('p/', p_partkey)"), null), part("file", null, null, F.lit("http://u")), part("video", null, null, null))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.join_parts(items).alias("content"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 3000 THEN left(text, 2990) || '…[已截断]' ELSE text END AS cell FROM documents")
def h55_clean_cell(spark, d):
    return _docs(spark, d, X.clean_cell("text", 3000).alias("cell"))


@query("SELECT p_partkey AS id, CASE WHEN length(trim(p)) >= 6 THEN trim(p) ELSE left(p || ', ' || p_brand, 30) END AS subject FROM (SELECT p_partkey, translate(p_name, ',:', '  ') AS p, p_brand FROM part)")
def h63_source_subject(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.source_subject(F.concat(F.translate("p_name", ",:", "  "), F.lit(", "), "p_brand")).alias("subject"))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'auto_learning' WHEN 2 THEN 'teacher_training' WHEN 3 THEN 'html' WHEN 4 THEN 'manual' ELSE 'other' END AS kind FROM customer")
def h30_source_kind(spark, d):
    t = table(spark, d, "customer")
    kind = F.expr("case c_custkey % 6 when 0 then 'pdf' when 1 then 'chat_auto' when 2 then 'chat_forward_answer' when 3 then 'html' when 4 then 'by_manual' else 'x' end")
    return t.select(F.col("c_custkey").alias("id"), X.source_kind(kind, F.col("c_name")).alias("kind"))


# -- quality ---------------------------------------------------------------

_BARE = r"length(regexp_replace(content, '\s+', '', 'g'))"
_ITEMS = r"len(list_filter(regexp_split_to_array(trim(content), '[、，,;；/／]'), lambda s: length(trim(s)) >= 2))"
_THIN = rf"CASE WHEN {_BARE} = 0 THEN true WHEN {_BARE} >= 40 THEN false ELSE NOT (regexp_matches(content, '[0-9]|https?://|[A-Za-z]{{3,}}|%') OR {_ITEMS} >= 3) END"
_BOIL = " OR ".join(f"contains(lower(title || chr(10) || content), '{w.lower()}')" for w in Q.BOILERPLATE)


@query(f"SELECT doc_id AS id, CASE WHEN {_BOIL} THEN 'boilerplate' WHEN doc_id % 50 = 0 THEN 'needs_review_dangling_or_generic' WHEN {_THIN} THEN 'thin_no_concrete_value' END AS reason FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents)")
def q1_reject_reason(spark, d):
    t = table(spark, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return t.select(F.col("doc_id").alias("id"), Q.reject_reason("title", "text", F.col("doc_id") % 50 == 0).alias("reason"))


@query(f"SELECT id, {_THIN} AS thin FROM (SELECT doc_id AS id, text AS content FROM documents)")
def q2_thin(spark, d):
    return _docs(spark, d, Q.is_thin("text").alias("thin"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'high' WHEN c_custkey % 4 = 1 THEN 'low' ELSE 'mid' END AS level FROM customer")
def q5_level(spark, d):
    tags = F.expr("case c_custkey % 4 when 0 then array('可用', '不相关') when 1 then array('不通用') when 2 then array('无法判断') else array() end")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), Q.level_of_tags(tags.cast("array<string>"), ("可用",)).alias("level"))


_WEAK = ", ".join(f"'{w}'" for w in Q.WEAK_ANSWERS)


@query(f"WITH k AS (SELECT conv_id, turn, text, trim(text) AS t, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM conversations) SELECT conv_id, turn, t <> '' AND NOT (regexp_matches(t, '{Q.QUESTION}') AND NOT regexp_matches(t, '{Q.ANSWER}')) AS answer_like, k IN ({_WEAK}) OR length(k) <= 2 OR regexp_matches(text, '[?？]\\s*$') AS weak FROM k")
def q8_answer_like(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", Q.is_answer_like("text").alias("answer_like"), Q.is_weak_answer("text").alias("weak"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'high' WHEN c_custkey % 5 = 1 THEN 'low' WHEN c_custkey % 5 = 2 THEN 'mid' ELSE c_mktsegment END AS level, CASE WHEN c_custkey % 5 = 3 THEN 'empty_llm_result' WHEN c_custkey % 5 = 4 THEN 'bad_verdict' ELSE '' END AS skip FROM customer")
def q12_decide_level(spark, d):
    t = table(spark, d, "customer")
    verdict = F.expr("case c_custkey % 5 when 0 then 'keep' when 1 then 'downgrade' when 2 then 'Downgrade' when 3 then null else 'maybe' end")
    tags = F.array().cast("array<string>")
    r = Q.decide_level(F.col("c_mktsegment"), verdict, tags, F.lit("agent"), F.expr("c_custkey % 5 <> 1"), F.lit(True), F.lit(True), F.lit(False))
    return t.select(F.col("c_custkey").alias("id"), r.alias("r")).select("id", "r.level", "r.skip")


@query("SELECT doc_id AS id, contains(split_part(text, chr(10), 1), 'th') OR contains(left(text, 1500), 'ing') AS timely FROM documents")
def q13_timely(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), Q.is_timely(F.substring_index("text", "\n", 1), "text", "th", "ing").alias("timely"))


@query("SELECT page_id, regexp_matches(left(html, 600), '(?i)(erreur\\s*404|error\\s*404|404\\s*[-—:]?\\s*(not found|page)|page not found)') AS error FROM pages")
def q16_error_page(spark, d):
    return table(spark, d, "pages").select("page_id", H.is_error_page("html").alias("error"))


@query(r"SELECT doc_id AS id, CASE WHEN length(text) > 100 THEN NULL WHEN regexp_matches(text, '[\x{3040}-\x{30ff}]') THEN 'ja' WHEN regexp_matches(text, '[\x{ac00}-\x{d7af}]') THEN 'ko' WHEN length(text) > 0 AND len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) >= 0.8 * length(text) THEN 'zh' END AS lang FROM documents")
def q22_language_rule(spark, d):
    return _docs(spark, d, Q.language_rule("text").alias("lang"))


@query(_W + "SELECT id, CASE WHEN k.quality_level = 'low' THEN 'low' ELSE 'mid' END AS level FROM kb k")
def q11_review(spark, d):
    t = knowledge(spark, d)
    r = Q.review(F.when(F.col("quality_level") == "low", "reject").otherwise("review"), F.lit("high"), F.lit("universal"), F.lit(True), F.lit(False), F.lit(False), F.array().cast("array<string>"))
    return t.select("id", r["quality_level"].alias("level"))


@query(None)
def q4_self_contained(spark, d):
    t = knowledge(spark, d).select("id", F.expr("if(id % 2 = 0, '活动内容', concat('本次', title))").alias("title"), "content", F.expr("concat('跨境电商峰会报名，', id)").alias("from_file_name"))
    return Q.repair_self_contained(t).select("id", "title", "needs_review", "repaired")


# -- segmentation ----------------------------------------------------------

@query("SELECT doc_id AS id, pos::INTEGER AS pos, part FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS part FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda s: trim(s)), lambda s: s <> '') AS p FROM documents))")
def g3_split(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.posexplode(G.split_content("text", r"\n", r"\n\s*-")).alias("pos", "part"))


@query("WITH t AS (SELECT doc_id AS id, 'nav END' || chr(10) || text AS x FROM documents), p AS (SELECT *, length(x) - strpos(reverse(x), 'DNE') - 2 AS pos FROM t), e AS (SELECT *, CASE WHEN strpos(substr(x, pos + 1), chr(10)) > 0 THEN pos + strpos(substr(x, pos + 1), chr(10)) END AS stop FROM p) SELECT id, CAST(CASE WHEN stop <= 3000 AND stop <= length(x) * 0.5 AND length(x) - stop >= 50 THEN stop END AS INTEGER) AS end_at FROM e")
def g5_nav_prefix(spark, d):
    t = _docs(spark, d, F.concat(F.lit("nav END\n"), "text").alias("x"))
    return t.select("id", G.nav_prefix_end("x", ["END"]).cast("int").alias("end_at"))


@query(None)
def g7_chunks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"\n", "\n\n## part\n").alias("x"))
    return G.chunk_materials(t, "id", "x").select("id", "chunk_no", F.length("text").alias("n_chars"))


@query(None)
def w14_sentence_overlap(spark, d):
    t = G.windows_by_limit(table(spark, d, "documents"), "doc_id", "text", 500)
    return t.select(F.col("doc_id").alias("id"), "s", "e", F.length("text").alias("n_chars"), F.length("overlapped").alias("n_overlapped"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ps FROM documents), p AS (SELECT id, unnest(range(1, len(ps) + 1)) AS rn, unnest(ps) AS t FROM d), n AS (SELECT id, rn, length(t) AS c, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]')) + len(regexp_extract_all(regexp_replace(t, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', ' ', 'g'), '\S+')) AS n FROM p),
 r AS (SELECT id, rn, n AS acc, c, 1 AS page FROM n WHERE rn = 1 UNION ALL SELECT n.id, n.rn, CASE WHEN r.acc > 0 AND r.acc + n.n > 200 THEN n.n ELSE r.acc + n.n END, n.c, r.page + CASE WHEN r.acc > 0 AND r.acc + n.n > 200 THEN 1 ELSE 0 END FROM r JOIN n ON n.id = r.id AND n.rn = r.rn + 1) SELECT id, CAST(page AS INTEGER) AS page_no, CAST(sum(c) + 2 * (count(*) - 1) AS INTEGER) AS n_chars FROM r GROUP BY 1, 2""")
def g4_text_pages(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("x"))
    return G.text_pages(t, "id", "x", 200).select("id", "page_no", F.length("text").alias("n_chars"))

"""Queries: text and page functions, quality predicates, one per function."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbase.functions import similarity as S
from tarnbase.functions import text as X
from tarnbase.functions import web as H
from tarnbase.operators import chat as C
from tarnbase.operators import ontology as O
from tarnbase.operators import quality as Q
from tarnbase.operators import records as R
from tarnbase.operators import segment as G
from tarnbase.operators import search as V
from tarnbase.operators import windows as W
from tarnbase.plans.registry import query
from tarnbase.plans.tables import CHAT, chat, table

_C = "WITH " + CHAT + " "


def _part(spark, d, *cols):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *cols)


def _talk(spark, d, *cols):
    return table(spark, d, "conversations").select("conv_id", "turn", *cols)


# -- keys and cleaning -------------------------------------------------------

_LINE = r"""l AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)https?://|www\.|\.(jpg|jpeg|png|gif|webp|bmp|pdf)\b')), lambda s: trim(regexp_replace(s, '^(回复|引用|转发|@[^：:]+[:：]|[A-Za-z0-9_\-\x{4e00}-\x{9fff}]{1,20}[:：])', ''))), lambda s: s <> '') AS ls FROM conversations), c AS (SELECT conv_id, turn, left(trim(regexp_replace(array_to_string(ls, ' '), '\s+', ' ', 'g')), 300) AS line FROM l)"""


@query(rf"""WITH {_LINE} SELECT conv_id, turn, left(regexp_replace(replace(lower(line), 'the', 'a'), '[\s，。！？!?、,.；;：:（）()【】\[\]《》<>"''“”‘’`~\-_/\\|]+', '', 'g'), 120) AS key FROM c""")
def h4_query_key(spark, d):
    return _talk(spark, d, X.query_key("text", {"The": "A"}).alias("key"))


@query("SELECT p_partkey AS id, 'ask ' || p_name || ' 具体编号 to 注册邮箱 please？' AS q FROM part")
def h5_sanitise_query(spark, d):
    return _part(spark, d, X.sanitise_query(F.expr("concat('ask ', p_name, ' ', 10000000 + p_partkey, ' to a', p_partkey, '@mail.com  @tom please。')")).alias("q"))


@query("SELECT p_partkey AS id, replace(replace(replace(p_name || '？', 'widget', '{platform}'), 'ring', '{platform}'), 'band', '{platform}') AS template, replace(replace(replace(replace(p_name || '？', 'widget', '{platform}'), 'ring', '{platform}'), 'band', '{platform}'), '{platform}', p_brand) AS filled FROM part")
def h6_platform_template(spark, d):
    t = _part(spark, d, X.platform_template("p_name", {"widget": [], "ring": ["band"]}).alias("template"), "p_brand")
    return t.select("id", "template", X.fill_template("template", "p_brand").alias("filled"))


@query("SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN contains(p_name, 'widget') OR contains(p_name, 'bolt') THEN 'Widget' END, CASE WHEN contains(p_name, 'red') THEN 'Red' END], lambda x: x IS NOT NULL), ',') AS names FROM part")
def h7_platform_names(spark, d):
    return _part(spark, d, F.array_join(X.platform_names("p_name", {"Widget": ["WIDGET", "bolt"], "Red": ["red"]}), ",").alias("names"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) + INTERVAL 86399 SECOND WHEN 2 THEN date_trunc('second', ts) END AS at FROM events")
def h8_time_arg(spark, d):
    x = F.expr("case event_id % 4 when 0 then date_format(ts, 'yyyyMMddHHmmss') when 1 then date_format(ts, 'yyyy-MM-dd') when 2 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") else 'yesterday' end")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.time_arg(x, end_of_day=True).cast("timestamp_ntz").alias("at"))


@query("SELECT p_partkey AS id, p_name AS rest, p_name AS plain FROM part")
def h10_strip_quoted(spark, d):
    return _part(spark, d, X.strip_quoted_reply(F.expr("concat('「tom：', p_brand, '」\n- - - - - - - - - -\n/', p_name)")).alias("rest"), X.strip_quoted_reply("p_name").alias("plain"))


@query("SELECT p_partkey AS id, CASE WHEN trim(regexp_replace(p_name, ' ring$', '')) = '' THEN p_name ELSE trim(regexp_replace(p_name, ' ring$', '')) END AS x FROM part")
def h11_strip_tail(spark, d):
    return _part(spark, d, X.strip_tail("p_name", [" ring$", "^(?=never$).*"]).alias("x"))


@query(_C + "SELECT id, send_type IN ('TEXT') AS is_text, send_type IN ('IMAGE') AS is_image FROM chat")
def h13_kind(spark, d):
    return chat(spark, d).select("id", X.kind_is("send_type", X.TEXT_KINDS).alias("is_text"), X.kind_is(F.lower("send_type"), X.IMAGE_KINDS).alias("is_image"))


@query("SELECT p_partkey AS id, p_size % 3 <> 2 AS one, p_size % 3 <> 2 AS whole FROM part")
def h14_image_address(spark, d):
    x = F.expr("case p_size % 3 when 0 then concat('HTTP://h/', p_partkey, '.PNG?v=1') when 1 then concat('s3://img/', p_partkey, '.dat') else p_name end")
    return _part(spark, d, X.is_image_address(x).alias("one"), X.is_image_answer(F.concat(x, F.lit(",\nhttp://h/a.jpg"))).alias("whole"))


@query("SELECT p_partkey AS id, p_name || ' [u] and [u]，' || p_brand AS x FROM part")
def h15_replace_urls(spark, d):
    return _part(spark, d, X.replace_urls(F.expr("concat(p_name, ' http://a.b/c?d=', p_partkey, ' and www.x.cn，', p_brand)"), "[u]").alias("x"))


@query("SELECT p_partkey AS id, p_name AS x, p_brand AS first FROM part")
def h18_strip_mentions(spark, d):
    return _part(spark, d, X.strip_mentions(F.expr("concat('@tom  ', p_name, ' @eve —')")).alias("x"), X.first_text(F.lit(None), F.lit(" @bob "), "p_brand", "p_name").alias("first"))


@query("SELECT p_partkey AS id, p_name AS x FROM part")
def h22_strip_think(spark, d):
    return _part(spark, d, X.strip_think(F.expr("concat('<think>a\n', p_brand, '</think> ', p_name, '<think></think>')")).alias("x"))


@query("SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def h25_attributes(spark, d):
    m = X.attributes(F.expr("concat(p_name, '#属性:brand:', p_brand, ',size:', p_size, ',odd')"))
    return _part(spark, d, F.try_element_at(m, F.lit("brand")).alias("brand"), F.try_element_at(m, F.lit("size")).alias("size"))


@query("SELECT p_partkey AS id, '1. ' || p_name || chr(10) || p_brand || chr(10) || '2. b' || chr(10) || p_type AS x FROM part")
def h28_numbered_lines(spark, d):
    return _part(spark, d, X.numbered_lines(F.array("p_name", F.lit("b")), F.array("p_brand", "p_type")).alias("x"))


@query("SELECT doc_id AS id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])') AS whole, contains(lower(text), 'ß') AS part FROM documents")
def h34_name_occurs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.name_occurs("text", "The").alias("whole"), X.name_occurs("text", "ß").alias("part"))


@query("SELECT p_partkey AS id, '中|文|' || p_name || '|字' AS x FROM part")
def h36_segment_chars(spark, d):
    return _part(spark, d, F.array_join(X.segment_chars(F.expr("concat('中文', p_name, '字')")), "|").alias("x"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_value(p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)), lambda s: s <> 'red'), '|') AS x FROM part")
def h37_split_values(spark, d):
    return _part(spark, d, F.array_join(X.split_values(F.array(F.concat("p_brand", F.lit("；")), F.concat("p_name", F.lit("、"), "p_brand")), ("red",)), "|").alias("x"))


@query("SELECT p_partkey AS id, unnest([0, 1, 2])::INTEGER AS pos, unnest(['text', 'media', 'text']) AS type, unnest([p_name, 'http://known/a', 'tail']) AS value FROM part")
def h53_typed_items(spark, d):
    t = _part(spark, d, F.expr("concat(p_name, ' http://known/a tail')").alias("x"))
    return t.select("id", F.posexplode(R.typed_items("x", ["http://known/a"])).alias("pos", "e")).select("id", "pos", "e.type", "e.value")


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand || '-' || p_name WHEN 2 THEN 'best' ELSE '默认分组' END AS label FROM part")
def h56_category_label(spark, d):
    info = lambda n, s: F.struct(F.lit(n).alias("category_name"), F.lit(s).alias("score"))
    infos = F.when(F.expr("p_size % 4 <= 2"), F.array(info("x", 0.1), info("best", 0.9))).otherwise(F.array(info("", 1.0)))
    names = [F.when(F.expr("p_size % 4 <= 1"), F.col("p_brand")), F.when(F.expr("p_size % 4 <= 1"), F.col("p_name"))]
    return _part(spark, d, X.category_label(F.when(F.expr("p_size % 4 = 0"), F.col("p_type")).otherwise(""), names, infos, "默认分组").alias("label"))


@query("SELECT p_partkey AS id, p_name || ' and' || chr(10) || p_brand AS x FROM part")
def h57_remove_urls(spark, d):
    return _part(spark, d, X.remove_urls(F.expr("concat(p_name, ' and http://h/ab \nhttp://h/a', p_brand, '\n\n')"), ["http://h/a", "http://h/ab"]).alias("x"))


@query("SELECT p_partkey AS id, lower(replace(replace(p_name, ' ', ''), '#', '')) || lower(replace(p_brand, '#', '#')) AS key, right(p_name, 4) AS tail FROM part")
def h58_name_key(spark, d):
    return _part(spark, d, X.name_key(F.expr("concat(upper(p_name), ' （', p_type, '） ', p_brand)")).alias("key"), X.tail_evidence("p_name", 4).alias("tail"))


@query("SELECT p_partkey AS id, lower(p_name) || 'abc1' AS x FROM part")
def h61_nfkc_fold(spark, d):
    return _part(spark, d, O.nfkc_fold(F.concat(F.upper("p_name"), F.lit("ＡＢＣ１ "))).alias("x"))


@query("SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN contains(p_name, 'ring') THEN replace(p_name, 'ring', 'loop') END, CASE WHEN contains(p_name, 'ring') THEN replace(p_name, 'ring', 'hoop') END, CASE WHEN contains(p_name, 'red') THEN replace(p_name, 'red', 'rot') END], lambda x: x IS NOT NULL)[1:2], '|') AS x FROM part")
def h65_term_variants(spark, d):
    return _part(spark, d, F.array_join(G.term_variants("p_name", {"ring": ["loop", "hoop"], "red": ["rot"]}, 2), "|").alias("x"))


@query("WITH t AS (SELECT doc_id AS id, text, length(text) AS n FROM documents), x AS (SELECT id, right(text, 2000) AS t, n FROM t), g AS (SELECT id, t, n, list_transform(range(1, greatest(length(t) - 6, 1)), lambda i: substr(t, i, 8)) AS gs, list_distinct(string_split(t, '')) AS cs FROM x) SELECT id, n >= 2000 AND (len(list_filter(cs, lambda c: c <> '')) < 10 OR list_bool_or(list_transform(range(1, 13), lambda p: length(t) >= 15 * p AND right(t, 15 * p) = repeat(right(t, p), 15))) OR len(list_distinct(gs)) < len(gs) * 0.2) AS looped FROM g")
def h23_degenerate(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.is_degenerate("text").alias("looped"))


@query("SELECT doc_id AS id, regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]+', '', 'g') AS cjk FROM documents")
def h35_only_cjk(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.only_cjk("text").alias("cjk"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_distinct([trim(p_name), p_brand]), lambda s: s <> ''), '|') <> '' AS any, CAST(len(list_distinct([p_name, p_brand])) AS INTEGER) AS n FROM part")
def x40_clean_list(spark, d):
    c = X.clean_list(F.array(F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_brand", "p_name", F.lit(None).cast("string")))
    return _part(spark, d, (F.array_join(c, "|") != "").alias("any"), F.size(c).alias("n"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'universal' WHEN 1 THEN 'client_specific' ELSE 'industry_specific' END AS scope, CASE o_orderkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'other' WHEN 2 THEN 'teacher_training' WHEN 3 THEN 'manual' ELSE 'html' END AS kind FROM orders")
def h17_scope(spark, d):
    x = F.expr("case o_orderkey % 5 when 0 then 'Cross-Industry' when 1 then '客户专属' when 2 then '行业级别' when 3 then '?' else null end")
    k = F.expr("case o_orderkey % 5 when 0 then 'pdf' when 1 then 'pdfx' when 2 then 'chat' when 3 then 'handle_x' else 'html' end")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.scope(x).alias("scope"), X.source_kind(k, F.lit("f")).alias("kind"))


# -- similarity ----------------------------------------------------------------

_CS = "list_distinct(list_filter(string_split({}, ''), lambda c: c <> ''))"


@query(f"WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM part), s AS (SELECT id, k, {_CS.format('k')} AS cs FROM p) SELECT a.id, round(CASE WHEN a.k = '' OR b.k = '' THEN 0 WHEN contains(a.k, b.k) OR contains(b.k, a.k) THEN 1 ELSE len(list_intersect(a.cs, b.cs))::DOUBLE / least(len(a.cs), len(b.cs)) END, 6)::DOUBLE AS overlap FROM s a JOIN s b ON b.id = a.id + 3")
def x39_text_overlap(spark, d):
    p = _part(spark, d, F.col("p_name").alias("a"))
    return p.join(p.select((F.col("id") - 3).alias("id"), F.col("a").alias("b")), "id").select("id", F.round(S.text_overlap("a", "b"), 6).alias("overlap"))


@query("WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), j AS (SELECT a.id, list_cosine_similarity(a.v, b.v) AS own, list_cosine_similarity(a.v, c.v) AS syn FROM e a JOIN e b ON b.id = a.id + 1 JOIN e c ON c.id = a.id + 2) SELECT id, round(greatest(own, syn), 6) AS with_synonym, round(own, 6) AS plain, round((1 + own) / 2, 6) AS engine FROM j")
def v8b_title_similarity(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    t = e.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id").join(e.select((F.col("id") - 2).alias("id"), F.col("v").alias("c")), "id")
    index = F.array(F.struct(F.lit("syn").alias("text"), F.col("c").alias("embedding")), F.struct(F.lit("other").alias("text"), F.col("v").alias("embedding")), F.struct(F.lit("syn").alias("text"), F.lit(None).cast("array<float>").alias("embedding")))
    both = S.title_similarity(F.col("v"), F.col("b"), index, F.array(F.lit("syn")))
    return t.select("id", F.round(both, 6).alias("with_synonym"), F.round(S.title_similarity(F.col("v"), F.col("b")), 6).alias("plain"), F.round(S.engine_score(S.cosine("v", "b")), 6).alias("engine"))


# -- pages -----------------------------------------------------------------------

@query("SELECT p_partkey AS id, p_brand || ' [image] ' || p_type AS x FROM part")
def x78_url_context(spark, d):
    return _part(spark, d, H.url_context(F.expr("concat('first\n', p_brand, '\n\nhttp://u/', p_partkey, '\n \n', p_type, '\nlast')"), F.expr("concat('http://u/', p_partkey)")).alias("x"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'file' END AS kind FROM part")
def x79_file_kind(spark, d):
    return _part(spark, d, H.file_kind(F.expr("concat('a/', p_partkey, case p_size % 4 when 0 then '.JPEG?x=1' when 1 then '.mp4' when 2 then '.wav#t' else '.tar' end)")).alias("kind"))


@query("SELECT p_partkey AS id, array_to_string(list_sort([p_brand, p_type]), ',') AS keywords, p_name AS topics FROM part")
def x82_index_answer(spark, d):
    m = G.parse_index_answer(F.expr("concat('关键词：', p_brand, '、', p_type, '；\nnoise\ntopics: ', p_name, ';')"))
    return _part(spark, d, F.array_join(F.array_sort(F.try_element_at(m, F.lit("关键词"))), ",").alias("keywords"), F.array_join(F.try_element_at(m, F.lit("topics")), ",").alias("topics"))


@query("SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN contains(p_name, 'widget') AND contains(p_name, 'red') THEN 'widgetred' END, CASE WHEN contains(p_name, 'widget') AND contains(p_name, 'small') THEN 'widgetsmall' END, CASE WHEN contains(p_name, 'ring') AND contains(p_name, 'red') THEN 'ringred' END, CASE WHEN contains(p_name, 'ring') AND contains(p_name, 'small') THEN 'ringsmall' END], lambda x: x IS NOT NULL)[1:1], ',') AS topics FROM part")
def x83_object_metric_topics(spark, d):
    return _part(spark, d, F.array_join(G.object_metric_topics(["ring", "widget"], ["red", "small"], "p_name", 1), ",").alias("topics"))


# -- quality predicates ------------------------------------------------------------

@query("SELECT p_partkey AS id, p_size % 3 = 0 AS bare, p_size % 3 <> 2 AS any FROM part")
def q3_image_only(spark, d):
    x = F.expr("case p_size % 3 when 0 then '![a](http://h/x) 、http://h/b.png' when 1 then concat(p_name, ' http://h/b.png') else p_name end")
    return _part(spark, d, Q.is_image_only(x).alias("bare"), (Q.is_image_only(x) | x.contains("http")).alias("any"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'empty_question' WHEN 1 THEN 'empty_answer' WHEN 2 THEN 'weak_answer' WHEN 3 THEN 'answer_repeats_question' END AS reason FROM part")
def q9_misextract(spark, d):
    q = F.expr("if(p_size % 5 = 0, ' - ', p_name)")
    a = F.expr("case p_size % 5 when 1 then '。' when 2 then 'Noted' when 3 then upper(p_name) else concat('use ', p_brand, ' of ', p_type, ' kind') end")
    return _part(spark, d, Q.misextract_reasons(q, a).alias("reason"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'qq zz xx' END AS answer, p_size % 3 <> 2 AS ok FROM part")
def q10_candidate_answer(spark, d):
    a = F.expr("if(p_size % 3 = 0, p_type, 'qq zz xx')")
    quote = F.expr("if(p_size % 3 = 1, 'qq zz xx', 'jj')")
    cand = F.expr("if(p_size % 3 = 2, '一二三', concat(p_type, ' qq zz xx'))")
    r = Q.from_candidate_answer(a, cand, F.lit(False), quote)
    return _part(spark, d, r["answer"].alias("answer"), r["ok"].alias("ok"))


_MEANING = "NOT (length(line) < 4) AND length(line) <= 220 AND NOT (lower(line) IN ('你好', '您好', '在吗', 'hello', 'hi', '谢谢', '好的', 'ok', '收到') OR (length(line) <= 8 AND regexp_matches(lower(line), '你好|您好|在吗|hello|hi|谢谢|好的|ok|收到'))) AND NOT regexp_matches(line, '^[^\\p{L}\\p{N}]+$') AND NOT regexp_matches(line, '^[\\d\\s.,，。:：-]+$') AND NOT (length(line) <= 12 AND regexp_matches(line, '这个|那个|看下|如图|图片|截图'))"


@query(f"WITH {_LINE} SELECT conv_id, turn, line <> '' AND {_MEANING} AS meaningful, line <> '' AND {_MEANING} AND contains(lower(line), 'the') AS business FROM c")
def q14_meaningful_query(spark, d):
    return _talk(spark, d, Q.is_meaningful_query("text").alias("meaningful"), (Q.is_meaningful_query("text") & Q.is_business_query("text", ("the",))).alias("business"))


@query("SELECT p_partkey AS id, coalesce((p_size > 20 AND p_size * 1.0 / nullif(p_size + 9, 0) > 0.4) OR (14 < p_size % 20 AND p_size * 1.0 / (p_size + 9) > 0.4), false) AS rich, p_size >= 30 OR p_size * 10 >= 250 AS valid FROM part")
def q17_images(spark, d):
    return _part(spark, d, Q.rich_image(F.col("p_size"), F.col("p_size") + 9, F.expr("p_size % 20")).alias("rich"), Q.valid_image(F.col("p_size"), F.col("p_size"), F.lit(10), 30, 250).alias("valid"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Japanese' WHEN 1 THEN 'ko' ELSE 'x' || p_size END AS lang FROM part")
def q21_detect_language(spark, d):
    x = F.expr("case p_size % 3 when 0 then 'これ' when 1 then '한국어' else p_name end")
    return _part(spark, d, Q.detect_language(x, F.expr("concat('x', p_size)"), {"ja": "Japanese"}).alias("lang"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'silent' WHEN contains(lower(c_name), '000001') THEN 'assistant' WHEN c_custkey % 5 = 0 THEN 'leader' WHEN c_custkey % 3 = 0 THEN 'colleague' WHEN c_mktsegment = 'MACHINERY' THEN 'contact' WHEN c_name LIKE 'Customer#00000000%' THEN 'colleague' WHEN c_acctbal > 0 THEN 'customer' ELSE 'unknown' END AS role FROM customer")
def q24_speaker_role(spark, d):
    c = table(spark, d, "customer")
    role = Q.speaker_role(F.col("c_name"), F.expr("c_custkey % 7 = 0"), ("000001",), F.expr("c_custkey % 5 = 0"), F.expr("c_custkey % 3 = 0"), F.expr("if(c_mktsegment = 'MACHINERY', 'contact', null)"), ("Customer#00000000",), F.col("c_acctbal") > 0)
    return c.select(F.col("c_custkey").alias("id"), role.alias("role"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'ai_answer_source' WHEN 1 THEN 'non_human_answer_source' WHEN 2 THEN 'direct_identifier_exposed' ELSE '' END AS codes FROM part")
def x66_reject_codes(spark, d):
    a = F.expr("if(p_size % 4 = 2, concat('mail a', p_partkey, '@b.cn'), p_name)")
    c = Q.reject_codes("p_name", a, F.expr("p_size % 4 = 0"), F.expr("if(p_size % 4 = 1, 'bot', 'leader')"), ("leader",))
    return _part(spark, d, F.array_join(c, ",").alias("codes"))


@query("SELECT p_partkey AS id, array_to_string(list_distinct(list_filter(['m', p_brand] || list_filter(string_split(p_name, ' '), lambda w: length(w) BETWEEN 2 AND 12), lambda s: s <> '')), '') <> '' AS some, CAST(len(list_distinct(['m', p_brand] || list_filter(string_split(p_name, ' '), lambda w: length(w) BETWEEN 2 AND 12))) AS INTEGER) AS n FROM part")
def x85_entity_markers(spark, d):
    m = Q.entity_markers(F.array(F.lit("m"), F.lit(" ")), F.col("p_brand"), F.array("p_name"))
    return _part(spark, d, (F.array_join(m, "") != "").alias("some"), F.size(m).alias("n"))


# -- chat --------------------------------------------------------------------------

@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'n' || user_id WHEN event_id % 3 = 1 THEN 'f' || user_id ELSE '?' END AS speaker FROM events")
def x48_speaker(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("if(event_id % 3 = 0, concat('n', user_id), '')").alias("actual_user_nickname"), F.lit(None).cast("string").alias("actual_user_id"), F.expr("if(event_id % 3 = 1, concat('f', user_id), null)").alias("from_user_nickname"), F.lit("").alias("from_user_id"), F.lit("").alias("send_user"))
    return e.select("id", C.speaker(F.lit("?")).alias("speaker"))


@query("SELECT conv_id, turn, turn || '. [' || '10:00] ' || role || '(u' || conv_id || ')' || CASE WHEN turn % 2 = 0 THEN ' <ask>' ELSE '' END || ': ' || regexp_replace(text, '\\s*\\n\\s*', ' / ', 'g') AS line FROM conversations")
def x54_message_line(spark, d):
    return _talk(spark, d, C.message_line(F.col("turn"), F.lit("10:00"), F.col("role"), F.expr("concat('u', conv_id)"), F.expr("if(turn % 2 = 0, 'ask', '')"), F.col("text")).alias("line"))


@query("SELECT p_partkey AS id, '[图片]' AS content, 'http://h/' || p_partkey || '.png' AS address, CASE WHEN p_size % 2 = 0 THEN 2 END AS n FROM part")
def x51_image_payload(spark, d):
    r = C.image_payload(F.expr("concat('<', 'http://h/', p_partkey, '.png>')"), F.expr("if(p_size % 2 = 0, 's3://img/b.jpg http://x/doc.pdf', 'none')"))
    return _part(spark, d, r["content"].alias("content"), r["address"].alias("address"), F.when(r["addresses"].isNotNull(), F.size(r["addresses"])).alias("n"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM part")
def x55_same_images(spark, d):
    i = lambda label, at: F.struct(F.lit(label).alias("label"), at.alias("address"))
    a = F.array(i("x", F.lit("1")), i("y", F.expr("concat('u', p_partkey)")), i("z", F.lit("3")))
    b = F.array(i("x", F.lit("9")), i("q", F.expr("if(p_size % 2 = 0, concat('u', p_partkey), '')")))
    return _part(spark, d, F.size(C.same_images(a, b)).alias("n"))


@query("WITH r AS (SELECT p_brand AS query, count(*) AS cnt FROM part GROUP BY 1) SELECT query, query || '？' AS question, CASE WHEN contains(query, '#1') THEN 'one' WHEN contains(query, '#2') THEN 'two' ELSE '其他' END AS theme, CASE WHEN contains(query, '#12') THEN 'Twelve' ELSE '' END AS platform, CASE WHEN cnt >= 20 THEN 'P0' WHEN cnt >= 5 THEN 'P1' ELSE 'P2' END AS priority, cnt AS evidence FROM r")
def x73_generalise_by_rule(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("query")).agg(F.count("*").alias("cnt"))
    return C.generalise_by_rule(t, {"one": ["#1"], "two": ["#2"]}, {"Twelve": ["#12"]})


@query("SELECT CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' ELSE 'mid' END AS bucket, count(*) AS n, min(d.doc_id) AS first FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def x68_buckets(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.expr("case quality when 1 then 'high' when 0 then 'low' else 'odd' end").alias("quality_level"))
    return C.buckets(t, rows=["doc_id"]).select("bucket", F.size("rows").cast("long").alias("n"), F.array_min("rows.doc_id").alias("first"))


# -- search helpers -----------------------------------------------------------------

@query("SELECT item_id AS id, array_to_string(list_distinct(CASE WHEN contains(lower(text), 'the') THEN ['der', 'die'] ELSE [] END || regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]+')), '') <> '' AS some, CAST(len(list_distinct(CASE WHEN contains(lower(text), 'the') THEN ['der', 'die'] ELSE [] END || regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]+'))) AS INTEGER) AS n FROM benchmark")
def x74_expand_keywords(spark, d):
    k = V.expand_keywords("text", {"the": ["der", "die"]})
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.array_join(k, "") != "").alias("some"), F.size(k).alias("n"))


_TFIDF = r"WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT id, len(w) AS len, unnest(w) AS term FROM t), c AS (SELECT id, len, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), s AS (SELECT id, term, tf::DOUBLE / len * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / df) AS s FROM c JOIN df USING (term)), k AS (SELECT id, term, CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS score FROM s WINDOW w AS (PARTITION BY id)) "


@query(_TFIDF + "SELECT id, count(*) AS terms, round(sum(score), 4)::DOUBLE AS total, max(score)::DOUBLE AS best FROM k GROUP BY 1")
def v24_keyword_scores(spark, d):
    return V.keyword_scores(table(spark, d, "documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("score"), 4).alias("total"), F.max("score").alias("best"))


@query("WITH t AS (SELECT user_id AS id, event_type AS term, count(*) * 1.0 / 100 AS s1, avg(value) / 100 AS s2 FROM events GROUP BY 1, 2), m AS (SELECT id, term, s1 * 0.7 + s2 * 0.3 AS score FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (score >= 0.8) DESC, score DESC, term) AS rank FROM m) SELECT id, term, round(score, 6)::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def x44_merge_keywords(spark, d):
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("term")).agg((F.count("*") / 100).alias("s1"), (F.avg("value") / 100).alias("s2"))
    return V.merge_keywords(t.select("id", "term", F.col("s1").alias("score")), t.select("id", "term", F.col("s2").alias("score")), 2).select("id", "term", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id AS id, true AS same, 2 AS n FROM embeddings")
def x5_fill_vectors(spark, d):
    i = lambda t, v: F.struct(F.lit(t).alias("text"), v.alias("embedding"))
    none = F.lit(None).cast("array<float>")
    out = V.fill_vectors(F.array(i("a", none), i("b", none)), F.array(i("a", F.col("embedding")), i("c", F.col("embedding"))))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (out[0]["embedding"] == F.col("embedding")).alias("same"), F.size(out).alias("n"))


# -- segmentation ---------------------------------------------------------------------

@query("SELECT DISTINCT conv_id AS doc, string_agg('[第' || (turn + 1) || '页]' || chr(10) || text, chr(10) ORDER BY turn + 1) AS text FROM conversations GROUP BY conv_id")
def g2_merge_pages(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")
    return G.merge_pages(t, "doc", "page", "text", numbers=True)


@query("SELECT o_custkey AS chunk, s, least(s + 2, hi) AS e FROM (SELECT o_custkey, hi, unnest(range(1, hi + 1, 3)) AS s FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS hi FROM orders GROUP BY 1))")
def w12_fixed_segments(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("chunk")).agg(F.lit(1).cast("long").alias("lo"), F.count("*").alias("hi"))
    return W.fixed_segments(t.select("chunk", F.col("lo"), "hi"))


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 + 1 AS INTEGER) AS page_no FROM orders")
def s23_row_pages(spark, d):
    return G.row_pages(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"], 4)


@query("WITH q AS (SELECT DISTINCT p_name AS q FROM part WHERE p_size < 20), p AS (SELECT p_partkey AS doc, unnest(range(3)) AS pos, unnest([p_name, p_brand, p_type]) AS piece FROM part), k AS (SELECT p.*, CASE WHEN q.q IS NULL THEN 0 ELSE 1 END AS opens FROM p LEFT JOIN q ON p.piece = q.q), n AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY pos) AS no FROM k) SELECT doc, CAST(no AS BIGINT) AS no, max(CASE WHEN opens = 1 THEN piece END) AS question, coalesce(string_agg(CASE WHEN opens = 0 THEN piece END, '。' ORDER BY pos), '') AS answer FROM n WHERE no > 0 GROUP BY 1, 2")
def x86_question_islands(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("doc"), F.concat_ws("。", "p_name", "p_brand", "p_type").alias("text"))
    return W.question_islands(t, "doc", "text", p.where("p_size < 20").select(F.col("p_name").alias("query")))

import pytest
from pyspark.sql import functions as F

from tarnbase.functions import hooks
from tarnbase.functions import similarity as S
from tarnbase.functions import text as X
from tarnbase.functions import web as H


def one(spark, col, value=None):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("value, want", [("你好_a B!é1", "你好abé1"), (None, ""), ("--", "")])
def test_qa_key(spark, value, want):
    assert one(spark, X.qa_key("x"), value) == want


def test_chat_line(spark):
    assert one(spark, X.chat_line("x"), "回复 hi\nsee http://a.b\n@bob: how  are you\r\n\npic.png") == "hi how are you"


@pytest.mark.parametrize("value, want", [("a@b.co 问 12345678 好吗??", "注册邮箱 问 具体编号 好吗？"), ("", ""), ("如何注册。", "如何注册？")])
def test_sanitise_query(spark, value, want):
    assert one(spark, X.sanitise_query("x"), value) == want


@pytest.mark.parametrize("value, want", [("20240102030405", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 23:59:59"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("x", None)])
def test_time_arg(spark, value, want):
    got = one(spark, X.time_arg("x", end_of_day=True), value)
    assert (str(got) if got else None) == want


def test_glued_time(spark):
    assert one(spark, X.message_time("x"), "2024-01-0203:04:05") == "2024-01-02 03:04:05"
    assert one(spark, X.message_epoch("x"), "nonsense") is None


def test_quoted_reply(spark):
    assert one(spark, X.strip_quoted_reply("x"), "「bob：old」\n- - - - - - - -\nnew answer") == "new answer"
    assert one(spark, X.strip_quoted_reply("x"), "a ------ b") == "a ------ b"


def test_generalise(spark):
    assert one(spark, X.generalise("x"), "mail a.b@c.io or 13800138000, see https://x.y/z id wxid_abcdef 订单: A12345") == "mail [邮箱] or [手机号], see [链接] id [用户ID] 订单[已脱敏]"


@pytest.mark.parametrize("value, want", [("高", "high"), ("Medium", "mid"), ("bad", "low"), ("?", "mid"), (None, "mid")])
def test_level(spark, value, want):
    assert one(spark, X.level("x"), value) == want


@pytest.mark.parametrize("value, want", [("0.5", 0.5), ("80", 0.8), ("x", 0.0), ("-1", 0.0), ("900", 1.0)])
def test_confidence(spark, value, want):
    assert one(spark, X.confidence("x"), value) == want


def test_scope_flag_list(spark):
    assert one(spark, X.scope("x"), "跨行业 通用") == "universal"
    assert one(spark, X.flag("x"), "是") is True
    assert one(spark, X.clean_list(F.array(F.lit(" a"), F.lit("a "), F.lit(""), F.lit("b")))) == ["a", "b"]


def test_parse_qa(spark):
    rows = one(spark, X.parse_qa("x"), "问题：甲 答案：乙[注]\n来源: [书]###q: one a: two")
    assert [(r["q"], r["a"], r["source"]) for r in rows] == [("甲", "乙", "书"), ("one", "two", "")]


def test_tags_and_attributes(spark):
    assert one(spark, X.trailing_tags("x"), "text #a#b") == ["a", "b"]
    assert one(spark, X.without_tags("x"), "text #a#b") == "text"
    assert one(spark, X.attributes("x"), "a #属性:k:v,bad,z:1") == {"k": "v", "z": "1"}


def test_degenerate(spark):
    assert one(spark, X.is_degenerate("x"), "ab" * 2000) is True
    assert one(spark, X.is_degenerate("x"), "".join(chr(97 + i * i % 26) + str(i) for i in range(2000))) is False
    assert one(spark, X.is_degenerate("x"), "aaa") is False


def test_cells_and_urls(spark):
    assert one(spark, X.clean_cell("x", 20), "a\x01b" + "c" * 40) == "ab" + "c" * 8 + "…[已截断]"
    assert one(spark, X.remove_urls("x", ["http://a", "http://a/b"]), "see http://a/b  \n\n\n\nend http://a\n ") == "see\n\nend"


@pytest.mark.parametrize("value, want", [("深圳跨境电商峰会，第一期", "深圳跨境电商峰会"), ("abc:def|ghi", "abc:def"), ("", "")])
def test_source_subject(spark, value, want):
    assert one(spark, X.source_subject("x"), value) == want


def test_similarities(spark):
    t = spark.createDataFrame([("abc", "bcd")], "a string, b string")
    r = t.select(S.char_jaccard("a", "b"), S.char_overlap("a", "b"), S.char_dice("a", "b"), S.bigram_dice("a", "b"), S.text_overlap("a", F.lit("xabcx"))).first()
    assert [round(v, 4) for v in r] == [0.5, 0.6667, 0.6667, 0.5, 1.0]


def test_cosine_of_zero(spark):
    t = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert t.select(S.cosine("a", "b")).first()[0] == 0.0


@pytest.mark.parametrize("url, want", [("https://www.example.co.uk:80/a", "example.co.uk"), ("shop.example.com/x", "example.com"), ("", "其他"), ("localhost", "localhost")])
def test_domain(spark, url, want):
    assert one(spark, H.domain("x"), url) == want


HTML = "<html><title>Foo &amp; Bar | Site</title><nav>no</nav><h1>Cookie policy</h1><p>c</p><h2>Head</h2><p>Body <b>x</b></p><a href='/in/'>i</a><a href='http://h.io/out#f'>o</a><a href='mailto:x'>m</a></html>"


def test_page(spark):
    assert one(spark, H.page_title("x"), HTML) == "Foo & Bar"
    assert [tuple(r) for r in one(spark, H.page_sections("x"), HTML)] == [("Head", "Body x i o m")]
    assert one(spark, H.page_links(F.lit("http://h.io/a"), F.col("x")), HTML) == ["http://h.io/in", "http://h.io/out"]
    assert one(spark, H.is_error_page("x"), "Error 404") is True


def test_json_repair():
    assert hooks.extract_json('x ```json\n{"a": [1, 2,], "b": "}"}``` y') == '{"a": [1, 2], "b": "}"}'
    assert hooks.extract_json('{"a": [1, {"b": "c') == '{"a": [1, {"b": "c"}]}'
    assert hooks.extract_json("none") is None


def test_hashing_embedder(spark):
    embed = hooks.embedder(hooks.hashing_embedder(16))
    t = spark.createDataFrame([("hello",), (None,), (" ",)], "x string").select(embed(F.col("x")).alias("v")).collect()
    assert len(t[0]["v"]) == 16 and t[1]["v"] is None and t[2]["v"] is None


def test_rich_text_and_images():
    assert hooks.rich_text_html({"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "a<b"}]}]}) == "<h2>a&lt;b</h2>"
    assert hooks.image_addresses({"a": ["http://x/1.png", {"b": "see s3://k/2.jpg now"}]}) == ["http://x/1.png", "s3://k/2.jpg"]
    assert hooks.levelled_text({"a": {"b": "c"}}) == "# a\n## b\nc"

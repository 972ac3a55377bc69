"""Text as column expressions: keys, cleaning, de-identification, counts, parsing.

Everything stays in the JVM. Patterns avoid what Java and other engines treat
differently: word characters are spelled as Unicode classes, because \\W means
ASCII in Java.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What chat systems call the kinds of a message.
TEXT_KINDS = ("TEXT", "TXT", "")
IMAGE_KINDS = ("IMAGE", "IMG", "PIC", "PICTURE", "PHOTO", "EMOTICON_IMAGE")
MIXED_KINDS = ("IMAGE_TEXT_MIX", "IMAGE_TEXT", "MIX_IMAGE_TEXT", "MIXED_IMAGE_TEXT", "MULTI_TYPE_MIX", "MULTI_TYPE", "MIXED_MESSAGE")

#: Spellings of the quality levels.
LEVELS = {
    "high": ("high", "h", "good", "高", "高质量", "优质", "高中低高"),
    "mid": ("mid", "medium", "middle", "m", "中", "中等", "中质量", "高中低中"),
    "low": ("low", "l", "bad", "低", "低质量", "较低", "高中低低"),
}
#: Spellings of yes and no.
YES = ("true", "yes", "y", "1", "是", "可以", "合格", "qualified", "可进入", "进入", "可复用", "可评估")
NO = ("false", "no", "n", "0", "否", "不可以", "不合格", "unqualified", "不进入", "不可复用", "不评估")
#: Spellings of the reuse scopes.
SCOPES = {
    "universal": ("universal", "general", "allindustrycommon", "crossindustry", "全行业通用", "跨行业通用", "通用"),
    "industry_specific": ("industryspecific", "platformspecific", "行业专属", "行业级别", "专属行业级别", "平台内通用", "平台专属"),
    "client_specific": ("clientspecific", "singleclient", "singleclientonly", "customerspecific", "singlecustomer", "singlecustomeronly", "casespecific", "单一client使用", "单client使用", "client专属", "单一客户使用", "单客户使用", "客户专属", "个案", "个案专属"),
}
#: Fixed value: a link in a chat line.
CHAT_URL = r'(?i)https?://[^\s，。；、）)】\]\}<>"“”]+|www\.[^\s，。；、）)】\]\}<>"“”]+'
#: Fixed value: a line that holds a link or names a picture.
URL_OR_IMAGE = r"(?i)https?://|www\.|\.(jpg|jpeg|png|gif|webp|bmp|pdf)\b"
#: Fixed value: what opens a quoted, forwarded or addressed line.
QUOTE_PREFIX = r"^(回复|引用|转发|@[^：:]+[:：]|[A-Za-z0-9_\-\x{4e00}-\x{9fff}]{1,20}[:：])"
#: Fixed value: punctuation that a query key ignores.
KEY_PUNCTUATION = r"[\s，。！？!?、,.；;：:（）()【】\[\]《》<>\"'“”‘’`~\-_/\\|]+"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Fixed value: ideographs, their punctuation and full-width forms count as one word each.
WIDE = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def qa_key(x: Column | str) -> Column:
    """Lower-case letters and digits of any script, nothing else."""
    return F.regexp_replace(F.lower(text(x)), r"[^\p{L}\p{N}]+", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"\s+", " "))


def regular_content(x: Column | str) -> Column:
    return collapse(F.lower(text(x)))


def chat_line(x: Column | str, limit: int = 300) -> Column:
    """The lines of a chat message without links, pictures and quote prefixes, joined by spaces, cut at limit."""
    plain = F.regexp_replace(F.translate(text(x), "  \r", "  \n"), " ", "")
    lines = F.transform(F.split(plain, "\n"), lambda v: F.trim(v))
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike(URL_OR_IMAGE))
    lines = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, QUOTE_PREFIX, ""))), lambda s: s != "")
    return F.left(collapse(F.array_join(lines, " ")), F.lit(limit))


def query_key(x: Column | str, aliases: dict[str, str] | None = None, limit: int = 120) -> Column:
    """Key under which queries are counted: cleaned, lower-case, aliases in their main form, no punctuation."""
    out = F.lower(chat_line(x))
    for alias, main in (aliases or {}).items():
        out = F.replace(out, F.lit(alias.lower()), F.lit(main.lower()))
    return F.left(F.regexp_replace(out, KEY_PUNCTUATION, ""), F.lit(limit))


def sanitise_query(x: Column | str, email: str = "注册邮箱", number: str = "具体编号", mark: str = "？") -> Column:
    """A query without addresses, long numbers and mentions, that ends in a question mark."""
    t = F.regexp_replace(chat_line(x), r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", email)
    t = F.regexp_replace(t, r"(?<![0-9])[0-9]{8,}(?![0-9])", number)
    t = F.regexp_replace(t, r"@[\p{L}\p{N}_\-+·.]{1,35}(?:\s*[（(][^）)]*[）)])?", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ，,。]+|[ ，,。]+$", "")
    t = F.regexp_replace(t, r"[?？]+", mark)
    return F.when((t != "") & ~t.endswith(mark), F.concat(F.regexp_replace(t, r"[。.]+$", ""), F.lit(mark))).otherwise(t)


def platform_names(x: Column | str, platforms: dict[str, list[str]]) -> Column:
    """Main names of the platforms whose name or alias stands in the text, in the dictionary's order."""
    low = F.lower(text(x))
    hits = [F.when(F.lit(False) if not names else _any(low, [n.lower() for n in names]), F.lit(main)) for main, names in platforms.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def contains_any(x: Column | str, words, fold: bool = True) -> Column:
    """Whether any of the words stands in the text, without regard to case."""
    return _any(F.lower(text(x)) if fold else text(x), [w.lower() if fold else w for w in words])


def platform_template(x: Column | str, platforms: dict[str, list[str]], slot: str = "{platform}") -> Column:
    """The sanitised query with any platform's name replaced by a slot."""
    t = sanitise_query(x)
    for main, names in platforms.items():
        for n in [main, *names]:
            t = F.replace(t, F.lit(n), F.lit(slot))
    return t


def fill_template(template: Column | str, platform: Column | str, slot: str = "{platform}") -> Column:
    return F.replace(_c(template), F.lit(slot), _c(platform))


def time_arg(x: Column | str, end_of_day: bool = False) -> Column:
    """Timestamps of yyyyMMddHHmmss, of a date (its first or last second) or of a full time; null for others."""
    t = F.trim(text(x))
    day = F.concat(t, F.lit(" 23:59:59" if end_of_day else " 00:00:00"))
    full = F.when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    full = full.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd HH:mm:ss")))
    return full.otherwise(F.try_to_timestamp(F.translate(t, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def message_time(x: Column | str) -> Column:
    """A message time whose date and time were glued together, parted."""
    return F.regexp_replace(F.trim(text(x)), r"^(\d{4}-\d{2}-\d{2})(\d{2}:\d{2}:\d{2})$", "$1 $2")


def message_epoch(x: Column | str) -> Column:
    """Seconds since 1970 of a message time; null if it can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(message_time(x), F.lit("yyyy-MM-dd HH:mm:ss")))


_RULE = r"(?:-\s*){6,}"


def strip_quoted_reply(x: Column | str) -> Column:
    """What follows the last rule of dashes that has a tail, if the text quotes something; else the text."""
    t = F.trim(text(x))
    quoted = t.rlike(_RULE) & t.rlike(r"(?s)[「“\"].+[」”\"]|：\s*/|:\s*/|/\s*-{3,}\s*/|^\s*「|\[图片\]")
    parts = F.transform(F.split(t, _RULE), lambda s: F.trim(F.regexp_replace(s, r"^[\s/：:，,。;；\"“”]+", "")))
    tails = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s != "")
    return F.when(quoted & (F.size(tails) > 0), F.element_at(tails, -1)).otherwise(t)


def sanitise_chat(x: Column | str) -> Column:
    """No zero-width or control characters, no runs of spaces, at most one blank line, no quoted reply."""
    t = F.regexp_replace(text(x), "[​﻿]|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(strip_quoted_reply(t), r"^\s+|\s+$", ""))


def strip_tail(x: Column | str, patterns: list[str]) -> Column:
    """Cut what the patterns match at the end, unless nothing would be left."""
    t = F.trim(text(x))
    out = t
    for p in patterns:
        out = F.trim(F.regexp_replace(out, p, ""))
    return F.when(out == "", t).otherwise(out)


def kind_is(x: Column | str, kinds: tuple[str, ...]) -> Column:
    return F.upper(F.trim(text(x))).isin(*kinds)


def is_image_address(x: Column | str) -> Column:
    t = F.trim(text(x))
    named = t.rlike(r"(?i)\.(?:png|jpe?g|gif|webp|bmp|heic|heif)(?:[?#].*)?$")
    placed = t.rlike(r"(?i)https?://|s3://|oss://|cos://|minio://|/|\\") & t.rlike(r"(?i)image|img|pic|photo|wechat|wx|\.dat$")
    return (t != "") & (named | placed)


def is_image_answer(x: Column | str) -> Column:
    """Whether every part of the text is the address of a picture."""
    parts = F.filter(F.transform(F.split(text(x), r"[\n,，]+"), lambda v: F.trim(v)), lambda s: s != "")
    return (F.size(parts) > 0) & F.forall(parts, is_image_address)


def replace_urls(x: Column | str, by: str = "") -> Column:
    return F.regexp_replace(text(x), CHAT_URL, by)


def mask_identifiers(x: Column | str) -> Column:
    """Links, e-mail, phone numbers, user, business and numeric ids masked; the order of the steps matters. Patterns and labels are fixed values."""
    t = replace_urls(F.trim(text(x)), "[链接]")
    w, edge, end = r"[\p{L}\p{N}_]", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    steps = [
        # possessive, and only from where a run of its characters begins: long runs are read once
        (rf"(?:(?<![{w[1:-1]}.+-])|\G)[{w[1:-1]}.+-]++@[{w[1:-1]}-]++(?:\.[{w[1:-1]}-]++)++", "[邮箱]"),
        (rf"{edge}1[3-9][0-9]{{9}}{end}", "[手机号]"),
        (rf"(?i){edge}(?:wxid|ww|corp)[_-]?[A-Za-z0-9_-]{{5,}}{end}", "[用户ID]"),
        (rf"(?i){edge}gh[_-][A-Za-z0-9_-]{{5,}}{end}", "[用户ID]"),
        (rf"{edge}[A-Za-z]{{1,8}}[-_][0-9]{{5,}}[-_A-Za-z0-9]*{end}", "[业务ID]"),
        (rf"{edge}[A-Z0-9][A-Z0-9_-]{{9,}}{end}", "[业务ID]"),
        (r"(?<![0-9])[0-9]{6,}(?![0-9])", "[数字ID]"),
        (r"(账号|账户|店铺|订单|申请|工单|物流单|运单|case|Case|CASE)[：: ]*[A-Za-z0-9_-]{4,}", "$1[已脱敏]"),
        (r"(客户|卖家|用户|联系人|对接人|负责人|店主|运营|经理|同事)[：: ]+[A-Za-z][A-Za-z ._-]{1,30}", "$1"),
    ]
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return t


def generalise(x: Column | str) -> Column:
    """De-identified for reuse and cleaned. Over long texts use generalise_column, which masks once."""
    return sanitise_chat(mask_identifiers(x))


def generalise_column(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with the de-identified text as a column. The masked text is a step of its own: cleaning looks at it several times."""
    return df.withColumn("__masked", mask_identifiers(col)).withColumn(name, sanitise_chat("__masked")).drop("__masked")


def _lookup(x: Column, table: dict[str, tuple[str, ...]], default: Column | str | None) -> Column:
    out = None
    for main, spellings in table.items():
        hit = x.isin(*spellings)
        out = F.when(hit, F.lit(main)) if out is None else out.when(hit, F.lit(main))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def level(x: Column | str, default: str = "mid") -> Column:
    return _lookup(qa_key(x), LEVELS, default)


def flag(x: Column | str, default: bool = False) -> Column:
    k = qa_key(x)
    return F.when(k.isin(*YES), True).when(k.isin(*NO), False).otherwise(F.lit(default))


def scope(x: Column | str, default: str = "industry_specific") -> Column:
    return _lookup(qa_key(x), SCOPES, default)


def confidence(x: Column | str) -> Column:
    """A number from 0 to 1; what exceeds 1 is a percentage, what is no number is 0."""
    v = _c(x).try_cast("double")
    v = F.coalesce(F.when(v > 1, v / 100).otherwise(v), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def clean_list(x: Column | str, limit: int | None = None) -> Column:
    """Trimmed, non-blank, distinct members in order."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(_c(x), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda s: s.isNotNull() & (s != "")))
    return F.slice(out, 1, limit) if limit else out


def strip_mentions(x: Column | str) -> Column:
    """A query without mentions, wrapping quotes and dashes at its ends."""
    t = collapse(F.regexp_replace(text(x), r"@[^\s\x{2005}@]+[\s\x{2005}]?", " "))
    t = F.regexp_replace(t, r"^[「“\"](.*)[」”\"]$", "$1")
    return collapse(F.regexp_replace(t, r"^[ \-—、,，。:：;；]+|[ \-—、,，。:：;；]+$", ""))


def first_text(*xs: Column | str) -> Column:
    """The first that is not blank after cleaning; empty if none."""
    return F.coalesce(*[F.nullif(strip_mentions(x), F.lit("")) for x in xs], F.lit(""))


def strip_think(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(x), r"(?s)<think>.*?</think>", ""))


def is_degenerate(x: Column | str, cut_off: Column | str | bool = False, gate: int = 2000, tail: int = 2000, least: int = 10, gram: int = 8, ratio: float = 0.2) -> Column:
    """Whether a model's output has run into a loop: few different characters, a short period at the end, or few different n-grams. Only outputs cut off for length, or longer than gate, are looked at."""
    t = F.right(text(x), F.lit(tail))
    chars = F.size(F.array_distinct(F.split(t, "")))
    grams = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1))
    cut = F.lit(cut_off) if isinstance(cut_off, bool) else _c(cut_off)
    low = F.size(F.array_distinct(grams)) < F.size(grams) * ratio
    return (text(x) != "") & (cut | (F.length(text(x)) >= gate)) & ((chars < least) | t.rlike(r"(?s)(.{1,12})\1{14}$") | low)


def trailing_tags(x: Column | str) -> Column:
    """The tags of #one#two at the very end."""
    found = F.regexp_extract(text(x), r"((?:#[^#\s]+)+)$", 1)
    return F.filter(F.split(found, "#"), lambda s: s != "")


def without_tags(x: Column | str) -> Column:
    t = text(x)
    return F.when(F.size(trailing_tags(x)) > 0, F.trim(F.regexp_replace(t, r"(?:#[^#\s]+)+$", ""))).otherwise(t)


def parse_qa(x: Column | str, question: str = "问题", answer: str = "答案", source: str = "来源", sep: str = "###") -> Column:
    """Question-answer pairs of a model's output: array of (q, a, source). Pairs are labelled in either language; [notes] in labelled answers go."""
    parts = F.filter(F.transform(F.split(F.replace(text(x), F.lit("："), F.lit(":")), sep), lambda v: F.trim(v)), lambda s: s != "")

    def one(part: Column, q: str, a: str, fold: str, drop: bool) -> Column:
        rx = rf"(?s){fold}{q}\s*:(.*?){a}\s*:(.*?)(?={q}\s*:|$)"
        qs, ans = F.regexp_extract_all(part, F.lit(rx), F.lit(1)), F.regexp_extract_all(part, F.lit(rx), F.lit(2))

        def row(qt: Column, at: Column) -> Column:
            src = F.regexp_extract(at, rf"(?s)\n{source}:\s*\[(.*?)\]", 1)
            body = F.regexp_replace(at, rf"(?s)\n{source}:\s*\[(.*?)\]", "")
            return F.struct(F.trim(F.regexp_replace(qt, r"^\s+|\s+$", "")).alias("q"), F.trim(F.regexp_replace(F.regexp_replace(body, r"\[(.*?)\]", "") if drop else body, r"^\s+|\s+$", "")).alias("a"), src.alias("source"))

        return F.zip_with(qs, ans, row)

    def pairs(part: Column) -> Column:
        named = one(part, question, answer, "", True)
        return F.when(F.size(named) > 0, named).otherwise(one(part, r"\bq", r"\ba", "(?i)", False))

    return F.flatten(F.transform(parts, pairs))


def attributes(x: Column | str, mark: str = "#属性:") -> Column:
    """The k:v,k:v list behind the mark as a map; malformed entries are left out."""
    tail = F.element_at(F.concat(F.split(text(x), mark), F.array(F.lit(""))), 2)
    pairs = F.filter(F.transform(F.split(tail, ","), lambda s: F.split(s, ":")), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))


def source_kind(from_type: Column | str, file_name: Column | str) -> Column:
    """Where a document comes from, in six kinds."""
    t, f = _c(from_type), _c(file_name)
    docs = ("pdf", "docx", "doc", "txt", "md", "csv", "xls", "xlsx", "ppt", "pptx", "excel")
    out = F.when(t.isin(*docs) & (text(f) != ""), "document").when(t == "chat_auto", "auto_learning")
    out = out.when(t.isin("chat", "chat_forward_answer"), "teacher_training").when(t == "html", "html")
    return out.when(t.contains("handle") | t.contains("manual"), "manual").otherwise("other")


def name_occurs(x: Column | str, name: str) -> Column:
    """Whether a name stands in the text: as a whole word if it is ASCII, else anywhere, without regard to case."""
    import re

    if re.fullmatch(r"[A-Za-z0-9 .&/()_-]+", name):
        return text(x).rlike(r"(?i)(?<![A-Za-z0-9])\Q" + name + r"\E(?![A-Za-z0-9])")
    return contains_any(x, [name])


def cjk_count(x: Column | str) -> Column:
    return F.regexp_count(text(x), F.lit(CJK))


def letter_count(x: Column | str) -> Column:
    """Characters from A to z in code order, which includes the six between Z and a."""
    return F.regexp_count(text(x), F.lit(r"[A-z]"))


def only_cjk(x: Column | str) -> Column:
    return F.regexp_replace(text(x), r"[^\x{4e00}-\x{9fff}]+", "")


def segment_chars(x: Column | str) -> Column:
    """Ideographs one by one, what stands between them as a whole."""
    return F.regexp_extract_all(text(x), F.lit(CJK + r"|[^\x{4e00}-\x{9fff}]+"), F.lit(0))


def split_values(x: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """Attribute values parted at the usual separators; distinct, without stop words."""
    parts = F.flatten(F.transform(_c(x), lambda s: F.split(s, r"[\t ；、,，+|]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda s: (s != "") & ~s.isin(*stop) if stop else s != ""))


def pad_cut(x: Column | str, n: int, pad: str = "[mask]") -> Column:
    return F.slice(F.concat(_c(x), F.array_repeat(F.lit(pad), n)), 1, n)


def text_length(x: Column | str) -> Column:
    """Wide characters plus words of the rest."""
    rest = F.regexp_count(F.regexp_replace(text(x), WIDE, " "), F.lit(r"\S+"))
    return F.regexp_count(text(x), F.lit(WIDE)) + rest


def mostly_chinese(x: Column | str, share: float = 0.3) -> Column:
    return F.coalesce(cjk_count(x) / F.nullif(F.length(text(x)), F.lit(0)) > share, F.lit(False))


def token_estimate(x: Column | str) -> Column:
    """1.5 per ideograph, 1.2 per Latin word, 0.25 per other character, rounded down."""
    t = text(x)
    words = F.regexp_count(t, F.lit(r"[A-Za-z]+"))
    other = F.length(F.regexp_replace(t, r"[\x{4e00}-\x{9fff}A-Za-z\s]", ""))
    return F.floor(cjk_count(x) * 1.5 + words * 1.2 + other * 0.25).cast("long")


def markdown_images(x: Column | str) -> Column:
    """(markdown, url) of every ![alt](url)."""
    rx = r"!\[([^\]]*)\]\(([^\)]+)\)"
    whole = F.regexp_extract_all(text(x), F.lit(rx), F.lit(0))
    urls = F.regexp_extract_all(text(x), F.lit(rx), F.lit(2))
    clean = lambda u: F.split(F.regexp_replace(F.trim(u), "^[\"']+|[\"']+$", ""), r"\s+")[0]
    return F.zip_with(whole, urls, lambda w, u: F.struct(w.alias("markdown"), clean(u).alias("url")))


def text_elements(x: Column | str) -> Column:
    """Texts and pictures of a markdown text in turn: array of (type, value)."""
    rx = r"!\[[^\]]*\]\([^\)]+\)"
    texts = F.transform(F.split(text(x), rx, -1), lambda s: F.struct(F.lit("text").alias("type"), F.trim(s).alias("value")))
    images = F.transform(markdown_images(x), lambda m: F.struct(F.lit("image_url").alias("type"), m["url"].alias("value")))
    both = F.flatten(F.zip_with(texts, images, lambda a, b: F.array(a, b)))
    return F.filter(both, lambda e: e.isNotNull() & (e["value"] != ""))


def clean_cell(x: Column | str, limit: int = 32767, mark: str = "…[已截断]") -> Column:
    """A spreadsheet cell: no control characters, at most limit long."""
    t = F.regexp_replace(_c(x), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 10)), F.lit(mark))).otherwise(t)


def remove_urls(x: Column | str, urls: list[str]) -> Column:
    """Take dead links out of a text, the longest first, and tidy the blank lines."""
    t = text(x)
    for u in sorted(urls, key=lambda u: (-len(u), u)):
        t = F.replace(t, F.lit(u), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"\s+$", "")


def render_addresses(content: Column | str, items: Column | str, prefix: str, mark: str = "[multimodal_prefix]") -> Column:
    """Placeholders to addresses: longest path first, the file name encoded as a query parameter; the rest get the bare prefix. items: array of struct with path and fileName."""
    usable = F.filter(_c(items), lambda i: (F.coalesce(i["path"], F.lit("")) != "") & (F.coalesce(i["fileName"], F.lit("")) != ""))
    ordered = F.array_sort(usable, lambda a, b: F.length(b["path"]) - F.length(a["path"]))

    def put(acc: Column, i: Column) -> Column:
        sep = F.when(i["path"].contains("?"), "&").otherwise("?")
        name = F.replace(F.url_encode(i["fileName"]), F.lit("+"), F.lit("%20"))
        return F.replace(acc, F.concat(F.lit(mark), i["path"]), F.concat(F.lit(prefix), i["path"], sep, F.lit("filename="), name))

    return F.replace(F.coalesce(F.aggregate(ordered, text(content), put), text(content)), F.lit(mark), F.lit(prefix))


def join_parts(items: Column | str, mark: str = "[multimodal_prefix]") -> Column:
    """Texts and addresses of the parts on lines of their own. items: array of struct with type, content, path, url."""
    address = lambda i: F.coalesce(F.concat(F.lit(mark), F.nullif(i["path"], F.lit(""))), i["url"])
    parts = F.transform(_c(items), lambda i: F.when(i["type"] == "text", i["content"]).when(i["type"].isin("image", "video", "audio", "file"), address(i)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def category_label(path: Column, names: list[Column], infos: Column, default: str) -> Column:
    """Label of a category: its path, else its level names joined, else the best scored candidate, else the default."""
    joined = F.nullif(F.concat_ws("-", *[F.nullif(n, F.lit("")) for n in names]), F.lit(""))
    named = F.filter(infos, lambda i: F.coalesce(i["category_name"], F.lit("")) != "")
    best = F.array_sort(named, lambda a, b: F.when(F.coalesce(a["score"], F.lit(0.0)) > F.coalesce(b["score"], F.lit(0.0)), -1).when(F.coalesce(a["score"], F.lit(0.0)) < F.coalesce(b["score"], F.lit(0.0)), 1).otherwise(0))
    return F.coalesce(F.nullif(path, F.lit("")), joined, F.try_element_at(best, F.lit(1))["category_name"], F.lit(default))


def source_subject(x: Column | str, least: int = 6, most: int = 30) -> Column:
    """The subject in a file name: what stands before the first separator, in a fixed order of separators, that leaves enough of it."""
    t = F.trim(F.translate(text(x), "丨|", "：："))
    out = None
    for sep in ("，", ",", "！", "!", "？", "?", "：", ":", "—", "－", "、"):
        head = F.trim(F.substring_index(t, sep, 1))
        hit = t.contains(sep) & (F.length(head) >= least)
        out = F.when(hit, head) if out is None else out.when(hit, head)
    return out.otherwise(F.left(t, F.lit(most)))


def name_key(x: Column | str) -> Column:
    """A speaker's name without white space, brackets' contents and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text(x), r"[（(【\[][^）)】\]]*[）)】\]]", ""), r"\s+", ""))


def tail_evidence(x: Column | str, most: int = 24000) -> Column:
    return F.right(text(x), F.lit(most))


def data_id(title: Column | str, content: Column | str, data_type: Column | str) -> Column:
    """Deterministic id of a knowledge document: equal content overwrites itself."""
    return F.md5(F.concat_ws("_", text(title), text(content), text(data_type)))


def numbered_lines(questions: Column | str, answers: Column | str) -> Column:
    """Question-answer lists as numbered text."""
    rows = F.zip_with(_c(questions), _c(answers), lambda q, a: F.concat(q, F.lit("\n"), a))
    return F.array_join(F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")


def scores_to_shares(scores: Column | str) -> Column:
    """A map's values divided by their sum."""
    total = F.aggregate(F.map_values(_c(scores)), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(_c(scores), lambda _, v: v / total)

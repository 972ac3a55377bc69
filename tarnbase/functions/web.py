"""Web pages and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnbase.functions.text import _c, collapse, text

#: Host prefixes that do not name a site.
COMMON_SUBDOMAINS = ("www", "wap", "m", "mobile", "api", "blog", "news")
#: Fixed value: headings of consent banners.
CONSENT = r"(?i)(cookie|prywatno|privacy|consent|zgod|RODO|akceptuj|datenschutz|confidentialit|vie priv|einwilligung)"
#: Fixed value: openings of error pages.
ERROR_PAGE = r"(?i)(erreur\s*404|error\s*404|404\s*[-—:]?\s*(not found|page)|page not found|页面不存在|页面未找到|seite nicht gefunden|página no encontrada)"
_DROPPED = r"(?is)<(script|style|noscript|nav|footer|header)\b.*?</\1>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(x: Column | str) -> Column:
    """The entities that pages use most."""
    t = text(x)
    for name, c in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def _bare(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(F.regexp_replace(x, r"<[^>]+>", " ")), "[\\s ]+", " "), r"^ | $", "")


def domain(x: Column | str, other: str = "其他") -> Column:
    """The site of an address: its host without port and common prefix, else its last two labels."""
    u = text(x)
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.split(F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)), ":")[0]
    parts = F.split(host, r"\.")
    n = F.size(parts)
    site = F.when((n >= 3) & parts[0].isin(*COMMON_SUBDOMAINS), F.array_join(F.slice(parts, 2, n), "."))
    site = site.when(n >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host)
    return F.when((text(x) == "") | (host == ""), other).otherwise(site)


def slug(x: Column | str, limit: int = 120) -> Column:
    t = F.regexp_replace(F.regexp_replace(text(x), r"^https?://[^/]+/", ""), r"^/+|/+$", "")
    t = F.replace(F.regexp_replace(t, r"[^a-zA-Z0-9\-_/]+", "-"), F.lit("/"), F.lit("_"))
    return F.left(F.when(t == "", "index").otherwise(t), F.lit(limit))


def page_title(html: Column | str) -> Column:
    """The title element, else the first h1; cut at the first vertical bar."""
    raw = text(html)
    own = F.regexp_extract(raw, r"(?is)<title>(.*?)</title>", 1)
    head = F.when(raw.rlike(r"(?is)<title>(.*?)</title>"), own).otherwise(F.regexp_extract(raw, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.trim(F.split(_bare(head), r"\s*[|｜]\s*")[0])


def page_body(html: Column | str) -> Column:
    return F.regexp_replace(text(html), _DROPPED, " ")


def page_text(html: Column | str) -> Column:
    """What a reader sees, without scripts, styles and navigation."""
    return F.trim(_bare(page_body(html)))


def page_sections(html: Column | str) -> Column:
    """(head, text) under each h1 to h4; consent banners and empty ones are left out."""
    rx = r"(?is)<h([1-4])[^>]*>(.*?)</h\1>"
    body = page_body(html)
    heads = F.regexp_extract_all(body, F.lit(rx), F.lit(2))
    texts = F.slice(F.split(body, rx, -1), 2, F.size(heads))
    rows = F.zip_with(heads, texts, lambda h, t: F.struct(F.trim(_bare(h)).alias("head"), F.trim(_bare(t)).alias("text")))
    return F.filter(rows, lambda r: (r["head"] != "") & (r["text"] != "") & ~r["head"].rlike(CONSENT))


def is_error_page(x: Column | str, look: int = 600) -> Column:
    return F.left(text(x), F.lit(look)).rlike(ERROR_PAGE)


def page_links(url: Column | str, html: Column | str, drop: str | None = None) -> Column:
    """Distinct links of a page that stay on its host; absolute and root-relative ones, and names beside the page. No fragments or closing slashes."""
    base = F.regexp_extract(text(url), r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(text(url), r"[?#].*$", ""), r"(^https?://[^/]+.*/)[^/]*$", "$1")
    hrefs = F.transform(F.regexp_extract_all(text(html), F.lit("(?i)<a[^>]+href=[\"']([^\"'#]+)"), F.lit(1)), lambda h: F.trim(unescape(h)))
    hrefs = F.filter(hrefs, lambda h: ~h.rlike(r"^(mailto|tel|javascript):"))
    full = F.transform(hrefs, lambda h: F.when(h.rlike(r"^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(base, h)).otherwise(F.concat(folder, h)))
    full = F.transform(full, lambda h: F.regexp_replace(h, r"/+$", ""))
    kept = F.filter(full, lambda h: (h == base) | h.startswith(F.concat(base, F.lit("/"))) | h.startswith(F.concat(base, F.lit("?"))))
    if drop:
        kept = F.filter(kept, lambda h: ~h.rlike(drop))
    return F.array_distinct(kept)


def file_kind(path: Column | str) -> Column:
    """Kind of a file by its suffix."""
    end = F.lower(F.regexp_extract(text(path), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(end.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "heic", "heif"), "image").when(end.isin("mp4", "mov", "avi", "mkv", "webm"), "video").when(end.isin("mp3", "wav", "m4a", "amr", "aac"), "audio").otherwise("file")


def url_context(content: Column | str, url: Column | str, slot: str = "[image]") -> Column:
    """The nearest lines that are not blank before and after an address, around a slot."""
    t, u = text(content), _c(url)
    at = F.instr(t, u)
    before = F.filter(F.split(F.substring(t, F.lit(1), F.greatest(at - 1, F.lit(0))), "\n"), lambda s: F.trim(s) != "")
    after = F.filter(F.split(F.substring(t, at + F.length(u), F.length(t)), "\n"), lambda s: F.trim(s) != "")
    line = lambda a, i: F.trim(F.coalesce(F.try_element_at(a, F.lit(i)), F.lit("")))
    return F.when(at > 0, collapse(F.concat_ws("\n", line(before, -1), F.lit(slot), line(after, 1))))

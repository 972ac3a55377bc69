"""Injected models: embedders, judges, lenient JSON; each with a deterministic stand-in.

No model is called from here. A hook is a function from a list of texts to a
list of results; it becomes a vectorised UDF.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed hashes of character trigrams, normalised: like texts get like vectors."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            s = f"  {(t or '').lower()} "
            for i in range(len(s) - 2):
                h = zlib.crc32(s[i : i + 3].encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embedder(fn: Callable[[list[str]], list[list[float]]], most_chars: int = 8000) -> Callable[[Column], Column]:
    """Column of texts to column of vectors; null and blank texts have none."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        ok = s.notna() & (s.fillna("").str.strip() != "")
        if ok.any():
            out[ok] = pd.Series(fn(s[ok].str[:most_chars].tolist()), index=s.index[ok])
        return out

    return run


def judge(fn: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """Column of prompts to column of a model's answers; a failed batch answers null, so callers fail closed."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        try:
            return pd.Series(fn(s.tolist()), index=s.index, dtype=object)
        except Exception:  # an answer that never came is no answer
            return pd.Series([None] * len(s), index=s.index, dtype=object)

    return run


def extract_json(text: str | None) -> str | None:
    """The first JSON value in a model's answer: fences are taken off, braces matched outside strings, trailing commas and missing closers repaired; null if there is none."""
    if not text:
        return None
    t = re.sub(r"```(?:json)?", "", text)
    start = next((i for i, c in enumerate(t) if c in "{["), None)
    if start is None:
        return None
    stack, quoted, skip, end = [], False, False, len(t)
    for i in range(start, len(t)):
        c = t[i]
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]":
            if stack:
                stack.pop()
            if not stack:
                end = i + 1
                break
    body = t[start:end] + ('"' if quoted else "") + "".join(reversed(stack))
    for candidate in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


def json_of(col: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(extract_json)

    return run(F.col(col) if isinstance(col, str) else col)


def rich_text_html(node, assets: dict | None = None) -> str:
    """Nested rich-text nodes (type, text, content, attrs, marks) as HTML."""
    import html

    if isinstance(node, list):
        return "".join(rich_text_html(n, assets) for n in node)
    if not isinstance(node, dict):
        return ""
    kind = node.get("type") or node.get("nodeType") or ""
    inner = rich_text_html(node.get("content") or [], assets)
    if kind == "text":
        t = html.escape(node.get("text") or node.get("value") or "")
        return f"<b>{t}</b>" if any((m.get("type") if isinstance(m, dict) else m) in ("bold", "strong") for m in node.get("marks") or []) else t
    if kind.startswith("heading"):
        n = (node.get("attrs") or {}).get("level") or kind[-1]
        return f"<h{n}>{inner}</h{n}>"
    if "image" in kind or "asset" in kind:
        ident = (node.get("attrs") or {}).get("src") or (((node.get("data") or {}).get("target") or {}).get("sys") or {}).get("id", "")
        return f'<img src="{html.escape((assets or {}).get(ident, ident))}">'
    if kind in ("hyperlink", "link"):
        return f'<a href="{html.escape((node.get("data") or node.get("attrs") or {}).get("uri") or (node.get("attrs") or {}).get("href", ""))}">{inner}</a>'
    tag = {"paragraph": "p", "bulletList": "ul", "unordered-list": "ul", "orderedList": "ol", "ordered-list": "ol", "listItem": "li", "list-item": "li", "blockquote": "blockquote", "table": "table", "table-row": "tr", "table-cell": "td"}.get(kind)
    return f"<{tag}>{inner}</{tag}>" if tag else inner


def levelled_text(value, depth: int = 1) -> str:
    """A nested dictionary as text with headings by level."""
    if isinstance(value, dict):
        return "\n".join(f"{'#' * depth} {k}\n{levelled_text(v, depth + 1)}" for k, v in value.items())
    return "\n".join(levelled_text(v, depth) for v in value) if isinstance(value, list) else str(value)


def image_addresses(value, depth: int = 3) -> list[str]:
    """Addresses of pictures in a nested value down to a depth, distinct, in order."""
    found: dict[str, None] = {}

    def walk(v, d: int) -> None:
        if isinstance(v, str):
            for u in [v.strip(), *re.findall(r"(?:https?|s3|oss|cos|minio)://[^\s\"'<>,，]+", v)]:
                if re.search(r"\.(?:png|jpe?g|gif|webp|bmp|heic|heif)(?:[?#].*)?$", u, re.I) and " " not in u:
                    found.setdefault(u)
        elif d and isinstance(v, dict):
            for x in v.values():
                walk(x, d - 1)
        elif d and isinstance(v, (list, tuple)):
            for x in v:
                walk(x, d - 1)

    walk(value, depth)
    return list(found)

"""Logical queries to filter columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a request and where they are kept.
FIELD_MAP = {"from_file_name": "ext_info.from_file_name", "category_path": "primary_category.category_path", "category_ids": "primary_category.category_ids"}
#: The two sets of retrieval defaults differ on purpose.
SEARCH_DEFAULTS = [{"quality_level": ["high"], "data_type": ["qa"], "audit_result": [1, 2, -1]}, {"audit_result": [1, 2], "data_type": ["qa"]}]
MULTI_DEFAULTS = [{"quality_level": ["high"], "data_type": ["qa"], "audit_result": [1, -1]}, {"audit_result": [1], "data_type": ["qa"]}]


def all_of(conds: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conds, F.lit(True))


def any_of(conds: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conds, F.lit(False))


def _column(df: DataFrame, field: str) -> tuple[Column, bool]:
    """The column of a field and whether it holds arrays."""
    name = field if field in df.columns else FIELD_MAP.get(field, field)
    col = F.col(name)
    return col, df.select(col).schema[0].dataType.typeName() == "array"


def attribute_filter(df: DataFrame, attributes: Mapping | Sequence[Mapping] | None) -> Column:
    """A mapping is the conjunction of its fields; a list of them is a disjunction of conjunctions. A list value means any of its members; for a field of arrays, that any of them is in it. Groups without fields are left out."""
    def one(group: Mapping) -> Column:
        conds = []
        for field, value in group.items():
            col, is_array = _column(df, field)
            values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
            hit = any_of(F.array_contains(col, v) for v in values) if is_array else col.isin(*values) if values else F.lit(False)
            conds.append(F.coalesce(hit, F.lit(False)))
        return all_of(conds)

    if not attributes:
        return F.lit(True)
    if isinstance(attributes, Mapping):
        return one(attributes)
    groups = [one(g) for g in attributes if g]
    return any_of(groups) if groups else F.lit(True)


def mentions(attributes, field: str) -> bool:
    groups = [attributes] if isinstance(attributes, Mapping) else attributes or []
    return any(field in g for g in groups)


def time_range(col: Column, bounds: Sequence[str | None] | None) -> Column:
    """Closed on both sides; either may be open. Times are fixed-width text and compare as text."""
    lo, hi = bounds or (None, None)
    conds = [col >= lo] if lo else []
    return all_of(conds + ([col <= hi] if hi else []))


def query_filter(df: DataFrame, query: Mapping, active_by_default: bool = True) -> Column:
    """Time ranges, attributes and, unless an attribute mentions it, del_flag = 0."""
    conds = [time_range(F.col(f), query.get(f)) for f in ("insert_time", "update_time") if query.get(f)]
    conds.append(attribute_filter(df, query.get("attribute")))
    if active_by_default and not mentions(query.get("attribute"), "del_flag"):
        conds.append(F.col("del_flag") == 0)
    return all_of(conds)


def search_conditions(groups: Sequence[Mapping] | None = None, audits: Sequence[int] = (1, 2, -1)) -> list[dict]:
    """Retrieval defaults, with the audit condition added to groups that lack one."""
    return [{"audit_result": list(audits)} | dict(g) for g in (groups or SEARCH_DEFAULTS)]


def update_filter(df: DataFrame, conditions: Sequence[Mapping]) -> Column:
    """Conditions of an update: all must hold, and soft-deleted rows are not left out by default."""
    return all_of(attribute_filter(df, c) for c in conditions)


def file_filter(names: Sequence[str], data_types: Sequence[str] | None = None, audits: Sequence[int] | None = None, file_col: str = "from_file_name", supersedes_col: str | None = None) -> Column:
    """Active rows of document, page or manual sources whose file, or the file it supersedes, is named."""
    hit = F.col(file_col).isin(*names)
    if supersedes_col:
        hit = hit | F.coalesce(F.col(supersedes_col).isin(*names), F.lit(False))
    cond = (F.col("del_flag") == 0) & F.col("from_type_norm").isin("document", "html", "manual") & hit
    if data_types:
        cond &= F.col("data_type").isin(*data_types)
    return cond & F.col("audit_result").isin(*audits) if audits else cond


def any_missing(fields: Sequence[str], force: bool = False) -> Column:
    """Active rows that lack any of the fields; with force, all active rows."""
    return (F.col("del_flag") == 0) & (F.lit(True) if force else any_of(F.col(f).isNull() for f in fields))


def chat_filter(customers: Sequence[str], start: str, end: str, users: Sequence[str] | None = None, apps: Sequence | None = None, require_reply: bool = True, apology: str | None = None, channel_out: str | None = None) -> Column:
    """Text messages of the customers in a half-open time range, answered with something else than the apology."""
    c = F.col("customer").isin(*customers) & (F.col("send_type") == "TEXT") & (F.trim(F.coalesce("send_content", F.lit(""))) != "")
    c &= (F.col("create_time") >= start) & (F.col("create_time") < end)
    if channel_out is not None:
        c &= F.col("channel_type").isNull() | (F.col("channel_type") != channel_out)
    if users:
        c &= F.col("user").isin(*users)
    if apps:
        c &= F.col("app_id").cast("string").isin(*[str(a) for a in apps])
    if require_reply:
        reply = F.coalesce(F.col("reply_content"), F.lit(""))
        c &= (F.trim(reply) != "") & (~reply.contains(apology) if apology else F.lit(True))
    return c


def history_filter(client: str, app: str, start: str, end: str, black: Sequence[str] = (), group: bool | None = None) -> Column:
    """Chat history of an app in a closed time range, without deleted rows and black-listed names."""
    c = (F.col("customer") == client) & (F.col("app_id") == app) & F.col("create_time").between(start, end) & (F.coalesce("del_flag", F.lit(0)) != 1)
    for name in black:
        c &= ~F.coalesce(F.col("from_user_nickname").contains(name), F.lit(False))
    return c if group is None else c & (F.col("is_group") == int(group))


def export_filter(sources: Sequence[str], least_audit: int = 1, data_types: Sequence[str] = (), deleted: bool = False, missing: Sequence[str] = ()) -> Column:
    """Rows to export; asking for missing fields drops the bound on the audit result."""
    conds = [F.col("from_type_norm").isin(*sources)] if sources else []
    if data_types:
        conds.append(F.col("data_type").isin(*data_types))
    if not missing:
        conds.append(F.col("audit_result") >= least_audit)
    if not deleted:
        conds.append(F.col("del_flag") == 0)
    if missing:
        conds.append(any_of(F.col(m).isNull() for m in missing))
    return all_of(conds)


def data_types_of(value: str | Sequence[str] | None) -> list[str]:
    """A data type, several, or all (none)."""
    values = [value] if isinstance(value, str) else list(value or [])
    values = [v.strip() for x in values for v in x.split(",") if v.strip()]
    return [] if "all" in values else list(dict.fromkeys(values))


def audit_target(from_type: str = "chat_auto", data_type: str = "qa", level: str = "high", audits: Sequence[int] = (-1,)) -> Column:
    return (F.col("from_type") == from_type) & (F.col("data_type") == data_type) & (F.col("quality_level") == level) & F.col("audit_result").isin(*audits) & (F.col("del_flag") == 0)


def aged_unaudited(sources: Sequence[str], threshold: str) -> Column:
    """Unaudited rows of the sources that were inserted by the threshold, one literal for the whole run."""
    if not sources:
        raise ValueError("sources must not be empty")
    return F.col("from_type_norm").isin(*sources) & (F.col("audit_result") == -1) & (F.col("insert_time") <= threshold)


def from_type_filter(from_type: str, start: str | None = None, end: str | None = None, level: str = "high") -> Column:
    """High quality rows of a source type; the time range counts only if both ends are given."""
    c = (F.col("quality_level") == level) & (F.col("from_type") == from_type)
    return c & F.col("insert_time").between(start, end) if start and end else c


def rollback_filter(tasks: Sequence[str] = (), files: Sequence[str] = (), only_active: bool = True, file_col: str = "from_file_name") -> Column:
    hit = (F.col("task_id").isin(*tasks) if tasks else F.lit(False)) | (F.col(file_col).isin(*files) if files else F.lit(False))
    return hit & (F.col("del_flag") == 0) if only_active else hit


def fallback_answered(patterns: Sequence[str], start: str | None = None, end: str | None = None, col: str = "reply_content") -> Column:
    """Replies that hold any of the fallback phrases, in a half-open time range."""
    c = any_of(F.col(col).contains(p) for p in patterns)
    c = c & (F.col("create_time") >= start) if start else c
    return c & (F.col("create_time") < end) if end else c


def name_contains(col: str, keyword: str, most: int = 48) -> Column:
    """Case-insensitive part of a name, of which the first `most` characters count."""
    return F.lower(F.col(col)).contains(keyword.strip().lower()[:most])


def above(score: str, threshold: float) -> Column:
    """A threshold of -1 or less lets everything pass."""
    return F.col(score) > threshold if threshold > -1 else F.lit(True)


def scope_violations(rows: DataFrame, platform: str, client: str) -> DataFrame:
    """Rows that do not belong to the task's client: any blocks the write."""
    bad = any_of(~F.col(c).eqNullSafe(F.lit(v)) for c, v in (("platform", platform), ("client", client)) if c in rows.columns)
    return rows.where(bad)


def index_name(value: str) -> str:
    """One physical index: lower-case, no lists, wildcards or paths."""
    name = (value or "").strip().lower()
    if not name or any(c in name for c in ",*?/\\ \"<>|#"):
        raise ValueError(f"not a single index: {value!r}")
    return name

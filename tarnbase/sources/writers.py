"""Writing: snapshots, backups, copies, exports; each names what it leaves out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.functions.text import clean_cell
from tarnbase.operators.maintain import drop_matching, drop_paths, vector_fields


def snapshot(df: DataFrame, path: str) -> int:
    """JSON lines of rows as they are, to restore from; the number of rows."""
    df.write.mode("errorifexists").json(path)
    return df.sparkSession.read.json(path).count() if not df.isEmpty() else 0


def backup(df: DataFrame, path: str, compress: bool = True, with_vectors: bool = False) -> dict:
    """JSON lines without vectors, and the schema beside them."""
    t = df if with_vectors else drop_paths(df, vector_fields(df))
    t.write.mode("errorifexists").option("compression", "gzip" if compress else "none").json(f"{path}/data")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("errorifexists").text(f"{path}/schema")
    return {"path": path, "left_out": [] if with_vectors else vector_fields(df)}


def copy_indexes(df: DataFrame, path: str, black: Sequence[str] = (), part: str = "embedding") -> DataFrame:
    """All indexes but the black-listed, without embeddings, partitioned by index; the counts per index."""
    t = drop_matching(df, part)
    t = t.where(~F.col("index_name").isin(*black)) if black else t
    t.write.mode("overwrite").partitionBy("index_name").parquet(path)
    return t.groupBy("index_name").agg(F.count("*").alias("n"))


def export_rows(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "json") -> int:
    """Chosen columns as JSON lines or CSV with clean cells; the number of rows read back must agree."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    t = df.select(*[clean_cell(c).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in columns])
    w = t.write.mode("errorifexists")
    (w.option("header", True).option("quoteAll", True).csv(path) if fmt == "csv" else w.json(path))
    r = df.sparkSession.read
    n = r.option("header", True).option("multiLine", True).csv(path).count() if fmt == "csv" else r.json(path).count() if not t.isEmpty() else 0
    if n != t.count():
        raise RuntimeError(f"wrote {t.count()} rows, read back {n}")
    return n


def split_by_level(df: DataFrame, path: str, level: str = "quality_level") -> None:
    """One folder for each quality level."""
    df.write.mode("overwrite").partitionBy(level).json(path)


def write_manifest(docs: DataFrame, path: str) -> None:
    docs.select("file", "url", "title", F.length("text").alias("n_chars"), F.lit("ok").alias("status")).write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, url: str, table: str, limit: int | None = None, **options: str) -> None:
    """Copy rows to a database table; with a limit, only if there are no more rows than that."""
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ValueError(f"{table} has more than {limit} rows")
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def to_workbook(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One workbook on the driver, for people to read; refuses more rows than `most`."""
    t = df.limit(most + 1).toPandas()
    if len(t) > most:
        raise ValueError(f"more than {most} rows; export them as files instead")
    t.to_excel(path, index=False)
    return len(t)


def push(df: DataFrame, send: Callable[[list[dict]], None], batch: int = 100) -> None:
    """Rows in batches to an injected client; executors send, so it must be safe to repeat a batch."""
    def each(rows) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(each)

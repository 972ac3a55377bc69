"""Shared helpers: staged tables, connected components, word rules."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"

#: Rows of one Arrow batch handed to Python; bounds a worker's memory.
BATCH = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the executors are threads of this machine's driver (tests); on a cluster that is an error, as executors would write where nobody else reads."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tarnbase.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tarnbase-")
        spark.conf.set("tarnbase.shared.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; nothing is left to ask
        pass


#: Paths staged inside each open scratch().
_OPEN: list[list[str]] = []

#: Where each staged table is.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end of the block; what is still needed then must have been written, or staged with keep."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            _remove(spark, path)


def stage(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and keeps sizes known to the planner. Removed at the end of the scratch() around it (unless keep), or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarnbase/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Staged tables that nothing reads any more go now."""
    for df in tables:
        _remove(df.sparkSession, _STAGED.pop(df))


#: Spark removes the shuffle files of a query as it ends, and not when the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is staged or collected inside go when that is done. What is returned is to be put together outside: a DataFrame made inside would shuffle anew each time it is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows at most: a batch of long texts must fit in a Python worker. Only ever lowers the session's setting, so it does not matter which of several lazy results runs first."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


#: What this Python worker remembers from task to task.
_REMEMBERED: dict[tuple, Any] = {}


def remembered(key: tuple, make: Callable[[], T]) -> T:
    """What the tasks of one operator remember in a Python worker; make() if it is new. Workers are reused by the stages of all operators, and what each of them remembers would add up, so what another has left goes."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """For tasks that remember nothing: what others have left goes, back to the system where its allocators can do that."""
    if _REMEMBERED:
        _REMEMBERED.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def nested(docs: DataFrame, name: str = "d") -> Column:
    """All columns of docs as one struct, so that no name of theirs clashes with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def fingerprint(*cols: Column) -> Column:
    """128 bits of the values of the columns, nulls included."""
    values = [x for c in cols for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*values).alias("x"), F.xxhash64(F.lit(1), *values).alias("y"))


def n_words(text: str = "text"):
    """Number of words, without building them; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Neighbours from which a node is a hub, whose edges are not sent to one task; and hubs at most, which bounds what is broadcast.
HUB, HUBS = 50_000, 20_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    edges: two integer columns. Returns (node, component) for every node that
    has an edge to another; component is the smallest node reachable. Loops,
    repeats and either direction are allowed; null ends are dropped. An empty
    input gives an empty result.

    Alternating large-star and small-star rounds, until nothing changes: each
    links every node to the smallest neighbour seen, so stars hold after
    O(log^2 n) rounds. Minima are aggregated before the shuffle; a hub's edges
    meet its minimum by a broadcast of the hubs, of which there are few.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    e = stage(e.distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _to_minimum(both, mark["n"], own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = _to_minimum(star, mark["n"], own=False)
        flat = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = stage(flat.select("p.u", "p.v").where("u <> v").distinct(), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _to_minimum(star: DataFrame, n: int, own: bool) -> DataFrame:
    """(u, v, m): m is u's smallest neighbour, or u itself if own is set and u is smaller."""
    hub = max(HUB, 2 * n // HUBS)  # of the 2n ends of n edges no more than HUBS nodes have so many
    low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    low = low.select(F.col("u").alias("k"), (F.least("u", "m") if own else F.col("m")).alias("m"), "c")
    if n < hub:
        return star.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
    low = stage(low, "low")
    hubs = F.broadcast(low.where(F.col("c") >= hub).select("k", "m"))
    far = star.join(hubs, F.col("u") == F.col("k")).select("u", "v", "m")
    near = star.join(hubs, F.col("u") == F.col("k"), "left_anti").join(low.where(F.col("c") < hub), F.col("u") == F.col("k"))
    return near.select("u", "v", "m").union(far)

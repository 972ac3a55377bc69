"""Approximate nearest neighbours through stable projections and kd-trees.

A Gaussian (2-stable) projection to m dimensions shrinks a vector's distance
to a query by a factor whose square is chi-square with m degrees of freedom.
So when the projected neighbours of a query are met in increasing distance r,
a vector not met yet is nearer than the k-th best d found so far only with
probability 1 - F_m(r^2 / d^2); the search verifies vectors in the original
space until F_m reaches the wanted confidence.

Across the cluster, a shallow kd-tree of medians (fitted on a bounded sample
of projected vectors) deals the vectors into cells, and a crowded cell into
blocks of bounded size. Queries first search their own cell, which gives a
bound d; then the cells nearest to them, which tighten it; then every other
cell whose box the stopping test does not exclude at that bound. In a block,
rows are grouped by a local kd-tree whose leaves are met in order of their
distance to the query, in growing steps, with the test before each step.
Every vector is indexed and every query answered; equal vectors are searched
once, with their k + 1 smallest ids, which is all that a top k can hold. A
vector that very many rows share meets its queries by broadcast, so that they
are not sent to one task; there are HOT such vectors at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.llm.common import small_batches, stage
from tarnbase.llm.vectordedup import as_binary, matrices, valid_vectors

DIMENSIONS = 8
#: Probability at which a query stops; the miss of one true neighbour is at most its complement.
CONFIDENCE = 0.995
FIT_ROWS = 20_000
#: Vectors of a block and of a leaf.
BLOCK, LEAF = 8192, 128
MOST_CELLS = 4096
#: Cells, in order of their distance to the query, of the second and of the third pass.
PASSES = ((1, 9), (9, MOST_CELLS))
#: A vector of more than one row in HOT is hot.
HOT = 1000


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution of chi-square with an even number m of degrees of freedom."""
    h = np.minimum(x, 1e6) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def _projection(d: int, m: int) -> np.ndarray:
    return np.random.default_rng(1_000 + d).standard_normal((d, m))


class Tree:
    """kd-tree of median splits over projected rows: flat arrays, leaf boxes."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        m = x.shape[1]
        self._grow(x, max(1, math.ceil(len(x) / max(1, leaves))), np.full(m, -np.inf), np.full(m, np.inf))

    def _grow(self, x, most, lo, hi) -> int:
        """Returns the node, or -1 - leaf."""
        if len(x) > most:
            a = int((x.max(axis=0) - x.min(axis=0)).argmax())
            c = float(np.median(x[:, a]))
            left = x[:, a] <= c
            if 0 < left.sum() < len(x):
                node = len(self.axis)
                self.axis.append(a), self.cut.append(c), self.kids.append((0, 0))
                h2, l2 = hi.copy(), lo.copy()
                h2[a], l2[a] = c, c
                self.kids[node] = (self._grow(x[left], most, lo, h2), self._grow(x[~left], most, l2, hi))
                return node
        self.lo.append(lo), self.hi.append(hi)
        return -len(self.lo)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        if not self.axis:
            return out
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            left = x[rows, self.axis[node]] <= self.cut[node]
            todo += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return out

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        lo, hi = np.stack(self.lo), np.stack(self.hi)
        d = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0)
        return (d * d).sum(axis=2)


def _search(pdf: pd.DataFrame, k: int, m: int, confidence: float) -> pd.DataFrame:
    """One block: its queries against its vectors. Rows: side (0 vectors, 1 queries), id (class), v, bound."""
    vec, qry = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    empty = pd.DataFrame({"q": [], "id": [], "score": []})
    if vec.empty or qry.empty:
        return empty
    x = np.frombuffer(b"".join(vec["v"])).reshape(len(vec), -1)
    ids = vec["id"].to_numpy()
    r = _projection(x.shape[1], m)
    px = x @ r
    tree = Tree(px, max(1, math.ceil(len(x) / LEAF)))
    leaf = tree.place(px)
    order = np.argsort(leaf, kind="stable")
    first = np.searchsorted(leaf[order], np.arange(len(tree.lo) + 1))
    outs = []
    for s in range(0, len(qry), 256):
        part = qry.iloc[s : s + 256]
        q = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
        gaps = tree.gaps(q @ r)
        turn = np.argsort(gaps, axis=1, kind="stable")
        for i, (qid, bound) in enumerate(zip(part["id"].to_numpy(), part["bound"].to_numpy(), strict=True)):
            got_d, got_i = np.empty(0), np.empty(0, np.int64)
            near, step = gaps[i, turn[i]], 1
            j = 0
            while j < len(near):
                kth = min(bound, got_d[k - 1] if len(got_d) >= k else np.inf)
                if kth < np.inf and near[j] > 0 and (kth == 0 or chi2_cdf(np.array(near[j] / (kth * kth)), m) >= confidence):
                    break
                rows = np.concatenate([order[first[t] : first[t + 1]] for t in turn[i, j : j + step]])
                j, step = j + step, 2 * step
                diff = x[rows] - q[i]
                d = np.sqrt((diff * diff).sum(axis=1))
                got_d, got_i = np.r_[got_d, d], np.r_[got_i, ids[rows]]
                if len(got_d) > k:  # ties of the k-th stay for the order by id
                    close = got_d <= np.partition(got_d, k - 1)[k - 1]
                    got_d, got_i = got_d[close], got_i[close]
                best = np.lexsort((got_i, got_d))[:k]
                got_d, got_i = got_d[best], got_i[best]
            outs.append(pd.DataFrame({"q": qid, "id": got_i, "score": got_d}))
    return pd.concat(outs) if outs else empty


def nearest(df: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, m: int = DIMENSIONS, confidence: float = CONFIDENCE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found to each query, itself excluded; ties to the smaller id.

    Queries are the rows whose id is divisible by `every` (or the given ids).
    Null, empty, zero and non-finite vectors take no part; vectors of
    different lengths are not compared. With fewer than k others, all are
    returned. Rows that repeat an id with the same vector are one; if the
    vectors differ, each is searched and found. Extra columns are ignored. An
    empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    valid = valid_vectors(df, id_col, vec_col).distinct()
    # a class of equal vectors: its k + 1 smallest ids are all that any top k can show
    few = Window.partitionBy("v").orderBy("id")
    low = stage(valid.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1), "low")
    classes = stage(low.where("n = 1").select("id", "v"), "classes")
    asked = valid.where(F.col("id") % every == 0) if queries is None else valid.join(queries.select(F.col(queries.columns[0]).alias("qid")).distinct(), F.col("id") == F.col("qid"), "left_semi")
    n = classes.count()
    if not n:
        return classes.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # each query's class, by the vector itself
    asked = stage(asked, "asked")
    often = asked.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") * HOT > asked.count()).select("v")
    named = classes.select(F.col("id").alias("q"), "v")
    hot = stage(named.join(often, "v", "left_semi"), "hot")
    owner = asked.join(F.broadcast(hot), "v").select("id", "q").union(asked.join(F.broadcast(hot), "v", "left_anti").join(named, "v").select("id", "q"))
    owner = stage(owner, "owner")
    keep = min(1.0, FIT_ROWS / n)
    sample = classes.where(F.abs(F.xxhash64("id") % 1_000_003) < int(keep * 1_000_003) + 1).orderBy("id").toPandas()
    trees = {}
    for d in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        rows = sample[sample["v"].map(len) == d]["v"].to_numpy()
        x = np.stack(rows) @ _projection(d, m) if len(rows) else np.zeros((1, m))
        trees[d] = Tree(x, min(MOST_CELLS, max(1, math.ceil(n / BLOCK * 2))))
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in matrices(batch.column(1)):
                cell = shared.value[d].place(x @ _projection(d, m)) + d * MOST_CELLS * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cell), as_binary(x)], names=["id", "cell", "v"])

    at = stage(classes.mapInArrow(place, "id long, cell long, v binary"), "at")
    sizes = stage(at.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "sizes")
    vectors = at.join(F.broadcast(sizes), "cell").select("cell", F.expr("cast(pmod(xxhash64(id), nb) as int)").alias("b"), F.lit(0).alias("side"), "id", "v", F.lit(float("inf")).alias("bound"))
    q = stage(at.join(owner.select(F.col("q").alias("id")).distinct(), "id", "left_semi"), "queries")
    search = lambda pdf: _search(pdf, k + 1, m, confidence)

    def run(queries_in: DataFrame) -> DataFrame:
        """queries_in: cell, id, v, bound."""
        dealt = queries_in.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.expr("sequence(0, nb - 1)")).alias("b"), F.lit(1).alias("side"), "id", "v", "bound")
        return vectors.unionByName(dealt).groupBy("cell", "b").applyInPandas(search, "q long, id long, score double")

    by = Window.partitionBy("q").orderBy("score", "id")
    top = stage(run(q.select("cell", "id", "v", F.lit(float("inf")).alias("bound"))), "found")
    for start, stop in PASSES:
        if all(len(t.lo) <= start for t in trees.values()):
            break
        best = top.withColumn("r", F.row_number().over(by)).where(F.col("r") == k + 1).select(F.col("q").alias("id"), F.col("score").alias("bound"))
        again = q.select("id", "v", F.col("cell").alias("own")).join(best, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

        def others(batches: Iterator[pa.RecordBatch], start: int = start, stop: int = stop) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for i, v, own, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(v)
                    gaps = shared.value[len(x)].gaps((x @ _projection(len(x), m))[None])[0]
                    gaps[own - len(x) * MOST_CELLS * 4] = -1  # the first in the order: it has been searched
                    turn = np.argsort(gaps, kind="stable")[start:stop]
                    if bound < np.inf:
                        ratio = gaps[turn] / max(bound, 1e-300) ** 2 if bound > 1e-150 else np.where(gaps[turn] > 0, np.inf, 0.0)
                        turn = turn[chi2_cdf(ratio, m) < confidence]
                    out += [(c, i, v, bound) for c in (turn + len(x) * MOST_CELLS * 4).tolist()]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "id", "v", "bound"])

        more = run(again.select("id", "v", "own", "bound").mapInArrow(others, "cell long, id long, v binary, bound double"))
        top = stage(top.unionByName(more).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("q", "id", "score"), "found")
    top = top.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("q", "id", "score")
    # classes to their ids, query classes to their queries
    members = low.join(classes.select(F.col("id").alias("c"), "v"), "v").select("c", F.col("id").alias("vec_id"))
    full = top.join(members, F.col("id") == F.col("c")).select("q", "vec_id", "score")
    full = full.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    full = stage(full.select("q", "vec_id", "score"), "full")
    owner, hot = owner.withColumnRenamed("id", "query_id"), F.broadcast(hot.select("q"))
    many = owner.join(hot, "q", "left_semi").join(F.broadcast(full.join(hot, "q", "left_semi")), "q")  # HOT * (k + 1) rows at most
    out = owner.join(hot, "q", "left_anti").join(full, "q").unionByName(many).where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")

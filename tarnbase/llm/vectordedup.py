"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Unit vectors are assigned to the nearest of k directions. Two vectors whose
cosine reaches the threshold lie within d = sqrt(2 - 2 threshold) of each
other; if they are in different cells, the plane between the two directions
passes between them, and one of them is within d/2 of it. So a vector is also
copied to every cell whose plane is that near, and then each linked pair
meets in the home cell of at least one of the two: nothing is lost at the
borders. Cells are compared in blocks of bounded size, so a crowded cell is
split over many tasks. A block finds candidates by products in single
precision, with a margin above their rounding, decides in double precision,
and reports link counts and a local spanning forest, never its pairs.

The number of cells is the one of least work, from the copies that rows of a
sample have which the directions were not fitted on: more cells mean smaller
blocks, but more copies near borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import connected_components, small_batches, stage

#: Vectors that the directions are fitted on, about, whatever the size of the table.
FIT_ROWS = 20_000
#: Directions, at most: bounds what is broadcast. Beyond, cells grow and are compared in more blocks.
MOST_CELLS = 4096
#: Rows of either side that are compared at once, and numbers of a side that are sent to one task, where that is more.
LEFT, RIGHT, SENT = 1024, 4096, 1 << 19
#: Seconds of a row of a cell and of a product, about; only their ratio counts.
ROW, PRODUCT = 1e-5, 2e-9


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that are not null, empty or zero and hold only finite numbers."""
    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    ok = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return t.where(ok).withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k directions of the unit rows of x; an empty cell gets the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        best, home = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ c.T
            home[i : i + 4096], best[i : i + 4096] = s.argmax(axis=1), s.max(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        norm = np.linalg.norm(new, axis=1)
        bad = np.flatnonzero(norm < 1e-12)
        new[bad] = x[np.argsort(best, kind="stable")[: len(bad)]]
        norm[bad] = np.linalg.norm(new[bad], axis=1)
        c = new / norm[:, None]
    return np.unique(c, axis=0)


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of the vectors in an array of lists, by dimension."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    dims = np.diff(ends)
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, flat[ends[rows][:, None] + np.arange(d)]


def as_binary(x: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    return pa.Array.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.float64).tobytes())]).cast(pa.binary())


def _near(u: np.ndarray, c: np.ndarray, gram: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest direction of unit rows, and a mask of the others whose plane is within reach."""
    s = u @ c.T
    own = s.argmax(axis=1)
    at = np.arange(len(own))
    near = (s[at, own][:, None] - s) / np.sqrt(np.maximum(2 - 2 * gram[own], 1e-18)) <= reach
    near[at, own] = False
    return own, near


def best_cells(u: np.ndarray, n: int, reach: float) -> int:
    """Of 1, 8, 64, 512 and MOST_CELLS the number of cells that costs least for n vectors like the unit rows of u."""
    fit, other = (x[:: -(-len(x) // 4096)] for x in (u[::2], u[1::2] if len(u) > 1 else u))  # rows that are directions themselves lie far from all borders
    d = u.shape[1]
    cost = {}
    for k in (1, 8, 64, 512, MOST_CELLS):
        if k > len(fit):
            break
        c = spherical_kmeans(fit, k, rounds=2)
        gram = c @ c.T
        copies = 1 + sum(_near(other[i : i + 256], c, gram, reach)[1].sum() for i in range(0, len(other), 256)) / len(other)
        home, cell = n / k, n * copies / k
        sent = math.ceil(cell / max(RIGHT, SENT // d)) + copies * (1 + math.ceil(home / max(LEFT, SENT // d)))
        cost[k] = n * (sent * ROW + cell * PRODUCT * d / 64)
    return min(cost, key=cost.get)


def _assign(reps: DataFrame, centres: dict[int, np.ndarray], reach: float) -> DataFrame:
    """(cell, home, id, m, v) rows: a vector's home cell (home: its cells, home first) and its copies near borders (home: empty). Cells are named dimension * MOST_CELLS * 4 + number."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ms = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, rows, raw in matrices(batch.column(2)):
                c = shared.value[d]
                own, near = _near(_unit(raw), c, c @ c.T, reach)
                i, cell = np.nonzero(near)
                base = d * MOST_CELLS * 4
                # the cells of row r: its own, then those near it
                n = 1 + near.sum(axis=1)
                ends = np.r_[0, np.cumsum(n)]
                cells = np.empty(ends[-1], np.int64)
                cells[ends[:-1]] = own
                rest = np.ones(len(cells), bool)
                rest[ends[:-1]] = False
                cells[rest] = cell
                which = np.r_[np.arange(len(rows)), i]
                home = pa.ListArray.from_arrays(pa.array(np.r_[ends, np.full(len(i), ends[-1])].astype(np.int32)), pa.array(cells + base))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, cell] + base), home, pa.array(ids[rows][which]), pa.array(ms[rows][which]), as_binary(raw[which])], names=["cell", "home", "id", "m", "v"])

    return reps.select("id", "m", "v").mapInArrow(run, "cell long, home array<long>, id long, m long, v binary")


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows whose product in double precision reaches the threshold."""
    slack = max(1e-5, 2e-7 * x.shape[1])
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= threshold - slack)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 65_536):
        a, b = x[i[k : k + 65_536]], y[j[k : k + 65_536]]
        s = np.einsum("ij,ij->i", a, b)
        ok = s >= threshold
        for t in np.flatnonzero(np.abs(s - threshold) < 1e-12):  # the order of sums could tip these
            ok[t] = math.fsum(a[t] * b[t]) >= threshold
        keep[k : k + 65_536] = ok
    return i[keep], j[keep]


def _block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Compare the left rows (home here) of a block with its right rows, LEFT and RIGHT of them at once; counts of linked vectors and spanning forests."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    found = [_compare(left[i : i + LEFT], right[j : j + RIGHT], threshold) for i in range(0, len(left), LEFT) for j in range(0, len(right), RIGHT)]
    return pd.concat(found) if found else pd.DataFrame({"id": [], "links": [], "to": []})


def _compare(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    none = pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
    x, y = (_unit(np.frombuffer(b"".join(t["v"])).reshape(len(t), -1)) for t in (left, right))
    xi, yi = left["id"].to_numpy(), right["id"].to_numpy()
    i, j = _linked(x, y, threshold)
    other = xi[i] != yi[j]
    i, j = i[other], j[other]
    if not len(i):
        return none
    xn = np.bincount(i, right["m"].to_numpy()[j], len(xi)).astype(np.int64)
    # a right row at home here is counted as a left row; a copy is counted here unless the left row has a copy in the other's home
    here, homes = right["home"].map(len).to_numpy() > 0, right["main"].to_numpy()
    back = ~here[j]
    names, at = np.unique(homes[j[back]], return_inverse=True)
    place = {int(h): k for k, h in enumerate(names)}
    meets = np.zeros((len(xi), len(names)), bool)
    for r in np.unique(i[back]).tolist():
        meets[r, [place[h] for h in left["home"].iat[r] if h in place]] = True
    back[back] = ~meets[i[back], at]
    yn = np.bincount(j[back], left["m"].to_numpy()[i[back]], len(yi)).astype(np.int64)
    # labels run along links until they rest: a spanning forest of the block
    lx, ly = xi.copy(), yi.copy()
    while True:
        ly2, lx2 = ly.copy(), lx.copy()
        np.minimum.at(ly2, j, lx[i])
        np.minimum.at(lx2, i, ly2[j])
        if (lx2 == lx).all() and (ly2 == ly).all():
            break
        lx, ly = lx2, ly2
    out = pd.DataFrame({"id": np.r_[xi, yi], "links": np.r_[xn, yn], "to": np.r_[lx, ly]})
    return out[(out["links"] > 0) | (out["id"] != out["to"])]


def near_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when the cosine in double precision reaches the threshold.
    Null, empty, zero and non-finite vectors link with nothing, and so do
    vectors of different lengths; they are kept. Equal vectors are one class
    whose members all link (counted, not expanded). Rows that repeat an id
    are one vector if their vectors are equal, and each get a row. An empty
    table gives no rows; extra columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    valid = valid_vectors(df, id_col, vec_col)
    classes = stage(valid.groupBy("v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("m")), "classes")
    n = classes.count()
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    keep = min(1.0, FIT_ROWS / n)
    sample = classes.where(F.abs(F.xxhash64("id") % 1_000_003) < int(keep * 1_000_003) + 1).select(F.size("v").alias("d"), "v", "id").orderBy("d", "id").toPandas()
    centres = {}
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9
    for d in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        rows = sample[sample["d"] == d]
        if rows.empty:
            rows = classes.where(F.size("v") == d).limit(1).toPandas()
        u = _unit(np.stack(rows["v"].to_numpy()))
        centres[d] = spherical_kmeans(u, min(cells or best_cells(u, n, reach), len(u)))
    at = stage(_assign(classes, centres, reach), "cells")
    per = at.groupBy("cell").agg(F.count("*").alias("c"), F.count_if(F.size("home") > 0).alias("h"))
    most = lambda rows: F.expr(f"greatest({rows}, {SENT} div greatest(cell div {MOST_CELLS * 4}, 1))")  # noqa: E731  cells are named by their dimension
    per = per.select("cell", F.ceil(F.col("h") / most(LEFT)).cast("int").alias("nl"), F.ceil(F.col("c") / most(RIGHT)).cast("int").alias("nr"))
    t = at.join(F.broadcast(per), "cell").where("nl > 0")  # one row for each of at most MOST_CELLS cells of a dimension
    # a copy carries the name of its own home
    main = t.join(at.where("size(home) > 0").select("id", F.col("cell").alias("main")), "id")
    mine = F.expr("cast(pmod(xxhash64(id), nl) as int)")
    other = F.expr("cast(pmod(xxhash64(id, 1), nr) as int)")
    left = main.where("size(home) > 0").withColumn("lb", mine).withColumn("rb", F.explode(F.expr("sequence(0, nr - 1)"))).withColumn("side", F.lit(0))
    right = main.withColumn("rb", other).withColumn("lb", F.explode(F.expr("sequence(0, nl - 1)"))).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("cell", "lb", "rb", "side", "id", "m", "home", "main", "v")
    found = both.groupBy("cell", "lb", "rb").applyInPandas(lambda pdf: _block(pdf, threshold), "id long, links long, to long")
    found = stage(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select("id", "to"))
    reps = classes.select("v", "id", "m").join(links, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    reps = reps.select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"), "m")
    # most classes have one member and join by id; the members of others find theirs by the vector itself
    single = reps.where("m = 1").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    many = reps.where("m > 1").select(F.col("v").alias("w"), "n_links", "component_id")
    many = stage(many, "many")
    copies = valid.join(many, F.col("v") == F.col("w")).select(F.col("id").alias("vec_id"), "n_links", "component_id").distinct()
    out = ids.join(single.unionByName(copies), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""MinHash near-duplicates verified through odd sketches.

Every text becomes the set of its distinct w-word shingles (64-bit hashes).
k MinHash samples are taken; runs of r samples form band keys, and all
samples are folded into an odd sketch: a parity bitmap in which two sets'
XOR has about n/2 (1 - exp(-4k(1-J)/n)) bits set, so its population count
estimates a high Jaccard similarity J precisely. Documents that share a band
key are candidates, the sketches drop the hopeless ones, and what remains is
confirmed on the full shingle sets.

Groups are never expanded into all pairs:

1. Documents with equal shingle sets are one class (a grouped minimum).
2. In each bucket every class is compared with the bucket's smallest id.
   Confirmed links are merged into components.
3. Buckets that now lie in one component are done. In the others, sketches of
   different components are compared inside the worker, in blocks of bounded
   size. From small buckets the pairs that pass leave to be confirmed. From
   large ones the rows leave that pass with some other; only they fetch their
   whole sets, and blocks of them intersect these themselves, so that one
   confirmed pair of any two components in a block leaves. A row is sent once
   for each block it meets, so blocks hold as many rows as their sets allow.

Texts are never shuffled: a bitmap of bounded size (a Bloom filter of the ids
that are wanted) goes to the text scan, and the few sets that come out of it
are joined exactly.

With k=128 and r=4 a pair at J=0.75 meets in some band with probability
1 - 6e-6, and more above; the sketch cut lies over five deviations above the
count expected at J=0.75.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import connected_components, forget, nested, release, remembered, small_batches, stage, tidied

SKETCH_BITS = 512
SAMPLES, ROWS = 128, 4
#: Buckets up to SMALL are compared by sketches alone. Whole sets of larger ones are compared in blocks of MOST rows if they hold no more than WHOLE shingles together, else of half or a quarter; sketches in blocks of twice MOST.
SMALL, MOST, WHOLE = 32, 1024, 1 << 20


class _Hashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_M1, _M2, _MUL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased, words end at ASCII white space. Fewer words than width: one shingle of all; no words or a null text: none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered(("shingles",), _Hashes).__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        used = min(width, len(h))
        out = np.full(n, used, np.uint64)
        for i in range(used):
            out = _mix(out * _MUL + h[i : i + n])
    return np.unique(out)


def _seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, samples, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """k MinHash samples (32 bits each) of a non-empty set, in chunks of bounded memory."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(best, ((a[:, None] * part + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=best)
    return best


def odd_sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the samples (position, value), as 64-bit words."""
    at = _mix((np.arange(len(sig), dtype=np.uint64) << np.uint64(32) | sig.astype(np.uint64)) + _MUL) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_cut(threshold: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = 5.2) -> int:
    """Largest XOR population count at which a pair of the threshold similarity is still tried."""
    gone = 4 * samples * (1 - threshold) / bits
    mean = bits / 2 * (1 - math.exp(-gone))
    spread = bits / 2 * math.exp(-gone) * 4 * math.sqrt(samples * threshold * (1 - threshold)) / bits
    return math.ceil(mean + deviations * math.hypot(spread, math.sqrt(mean * (1 - 2 * mean / bits) + 1)))


_META = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, 0 for an empty one."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        m = _mix(s + _MUL)
        return int(_signed(m.sum(dtype=np.uint64, keepdims=True))[0]), int(_signed(np.bitwise_xor.reduce(_mix(m ^ _M2), keepdims=True))[0])


def sketches(docs: DataFrame, width: int = 5, samples: int = SAMPLES, rows: int = ROWS) -> DataFrame:
    """One pass over the texts: shingle count, 128-bit fingerprint of the set, band keys and odd sketch of each document. Empty sets have no bands and no sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _seeds(samples)
        nb = samples // rows
        with np.errstate(over="ignore"):
            for batch in batches:
                ns, f1, f2, bands, sk = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_hashes(text, width)
                    x, y = fingerprint(s)
                    ns.append(len(s)), f1.append(x), f2.append(y)
                    if not len(s):
                        bands.append(None), sk.append(None)
                        continue
                    sig = signature(s, a, b)
                    key = np.arange(nb, dtype=np.uint64)
                    for i in range(rows):
                        key = _mix(key * _MUL + sig[i::rows].astype(np.uint64) + np.uint64(1))
                    bands.append(_signed(key))
                    sk.append(odd_sketch(sig).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sk, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _META)


#: Bits of the filter of wanted ids: 16 for each id, within these bounds. Where that leaves under FEWEST for each, the ids are joined instead.
FILTER_BITS, FEWEST = (1 << 16, 1 << 28), 8


def _wanted(ids: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of n ids, three bits each, as 64-bit words; at most 32 MB whatever their number."""
    bits = min(max(FILTER_BITS[0], 1 << (16 * n).bit_length()), FILTER_BITS[1])
    at = ids.select(F.explode(F.array(*[F.expr(f"pmod(xxhash64(id, {k}), {bits}L)") for k in range(3)])).alias("p"))
    words = at.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().view(np.uint64)
    return out


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, fp, s): the whole shingle sets of the named documents, and of a few more, and the first word of their fingerprints."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    n = ids.count()
    if n * FEWEST > FILTER_BITS[1]:
        own, bits = own.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), np.full(1, -1).view(np.uint64)
    else:
        bits = _wanted(ids, n)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        bits = np.uint64(64 * len(wanted))
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k in range(3):
                p = batch.column(2 + k).to_numpy().astype(np.uint64) % bits
                ok &= (wanted[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.filter(pa.array(ok))
            sets = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x)[0] for x in sets], pa.int64()), pa.array(list(map(_signed, sets)), pa.list_(pa.int64()))], names=["id", "fp", "s"])

    return own.select("doc_id", "text", *[F.expr(f"pmod(xxhash64(doc_id, {k}), {FILTER_BITS[1]}L)").alias(f"h{k}") for k in range(3)]).mapInArrow(run, "id long, fp long, s array<long>")


def _passing(pairs: DataFrame, reps: DataFrame, cut: int) -> DataFrame:
    """Pairs (a, b) whose sketches differ in at most cut bits."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("ka"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("kb"))
    apart = F.expr("aggregate(zip_with(ka, kb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs.join(right, "b").join(left, "a").where(apart <= cut).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


#: Products that take as long as one more step of finding the common members of two sets, about.
STEP = 200


#: Pairs of a block whose sizes, bands or common members are looked up at a time; bounds a worker's memory.
SLAB = 1 << 15


def _alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) of sorted sets reach the similarity: by matrix products over the members that several sets have where that is less work, one by one otherwise."""
    size = np.array([len(s) for s in sets])
    slabs = [slice(k, k + SLAB) for k in range(0, len(i), SLAB)]
    fits, steps = np.empty(len(i), bool), 0
    for k in slabs:
        a, b = size[i[k]], size[j[k]]
        fits[k] = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        steps += 1000 * int(fits[k].sum()) + int((a + b)[fits[k]].sum())
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), size), np.flatnonzero(times > 1)
    if len(common) * len(sets) ** 2 <= STEP * steps:
        number = np.full(len(times), -1)
        number[common] = np.arange(len(common))
        row, at = row[number[at] >= 0], number[at[number[at] >= 0]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        product, wide = np.zeros((len(sets), len(sets)), np.float32), max(1, (1 << 22) // len(sets))
        for k in range(0, len(common), wide):  # sums stay below 2^24, so they are exact
            here = slice(*np.searchsorted(at, [k, k + wide]))
            m = np.zeros((len(sets), min(wide, len(common) - k)), np.float32)
            m[row[here], at[here] - k] = 1
            product += m @ m.T
        for k in slabs:
            got = np.rint(product[i[k], j[k]]).astype(np.int64)
            fits[k] &= 100 * got >= percent * (size[i[k]] + size[j[k]] - got)
    else:
        for k in np.flatnonzero(fits):
            got = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
            fits[k] = 100 * got >= percent * (size[i[k]] + size[j[k]] - got)
    return fits


def _one_of_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each unordered pair of the labels a[k], b[k] stands first."""
    names = np.union1d(a, b)
    met, first = np.zeros((len(names), len(names)), bool), []
    for k in range(0, len(a), SLAB):
        x, y = np.searchsorted(names, a[k : k + SLAB]), np.searchsorted(names, b[k : k + SLAB])
        x, y = np.minimum(x, y), np.maximum(x, y)
        new = np.flatnonzero(~met[x, y])
        _, at = np.unique(x[new] * len(names) + y[new], return_index=True)
        met[x[new], y[new]] = True
        first.append(k + new[at])
    return np.concatenate(first)


def _compare_blocks(rows: DataFrame, cut: int, percent: int, whole: bool) -> DataFrame:
    """rows: (key, bi, bj, blk, doc, comp, sketch[, s]), sorted by (key, bi, bj). Pairs of different components whose sketches (and, if the rows hold them, whole sets) are alike enough, group by group; a group has two blocks at most."""

    def pairs_of(doc, comp, sk, blk, same, sets):
        ok = np.zeros((len(doc), len(doc)), bool)
        for k in range(0, len(doc), 64):
            part = slice(k, k + 64)
            ok[part] = np.bitwise_count(sk[part, None, :] ^ sk[None, :, :]).sum(axis=2, dtype=np.int64) <= cut
            ok[part] &= comp[part, None] != comp[None, :]
            if not same:
                ok[part] &= blk[part, None] != blk[None, :]
        for k in range(len(doc)):
            ok[k, : k + 1] = False
        i, j = (x.astype(np.int32) for x in np.nonzero(ok))
        if sets is not None and len(i):
            good = _alike(sets, i, j, percent)
            i, j = i[good], j[good]
            # one pair of any two components is all that merging them takes
            if len(i):
                k = _one_of_each(comp[i], comp[j])
                i, j = i[k], j[k]
        return np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(cols):
            key, bi, bj, blk, doc, comp, sk = cols[:7]
            edge = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            start, stop = np.r_[0, edge], np.r_[edge, len(key)]
            out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            if whole:
                rest = stop - start > 1
            else:  # pairs are the most common group
                rest = stop - start > 2
                two = start[stop - start == 2]
                ok = (np.bitwise_count(sk[two] ^ sk[two + 1]).sum(axis=1, dtype=np.int64) <= cut) & (comp[two] != comp[two + 1])
                two = two[ok]
                out.append((np.minimum(doc[two], doc[two + 1]), np.maximum(doc[two], doc[two + 1])))
            for s, t in zip(start[rest], stop[rest], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in cols[7][s:t]] if whole else None
                out.append(pairs_of(doc[s:t], comp[s:t], sk[s:t], blk[s:t], bi[s] == bj[s], sets))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            got = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        forget()
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            cols.append(batch.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1))
            if whole:
                cols.append(np.array([*batch.column(7).to_pylist(), None], object)[:-1])
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, bi, bj = cols[:3]
            last = np.flatnonzero((key != key[-1]) | (bi != bi[-1]) | (bj != bj[-1]))
            cutoff = int(last[-1]) + 1 if len(last) else 0
            held = [x[cutoff:] for x in cols]
            if cutoff:
                yield close([x[:cutoff] for x in cols])
        if held is not None:
            yield close(held)

    return rows.mapInArrow(run, "a long, b long")


def _promising(rows: DataFrame, cut: int) -> DataFrame:
    """rows: (key, wi, wj, blk, per, doc, comp, sketch, bands), `per` blocks in one of sketches. The rows that have one of another component within `cut` bits, once for each pair (bi, bj) of blocks in which they do. Two rows that share several bands meet in several buckets, all of which are compared, as both rows are in them; they count in the bucket of the first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        blk, doc, comp = (pdf[c].to_numpy() for c in ("blk", "doc", "comp"))
        sk = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        bands = np.stack(pdf["bands"].to_numpy())
        bands = bands[:, : int(np.flatnonzero(bands[0] == pdf["key"].iat[0])[0])]  # those before this bucket's
        found = []
        same, per = pdf["wi"].iat[0] == pdf["wj"].iat[0], pdf["per"].iat[0]
        for i in range(0, len(doc), 64):
            part = slice(i, i + 64)
            ok = np.bitwise_count(sk[part, None, :] ^ sk[None, :, :]).sum(axis=2, dtype=np.int64) <= cut
            ok &= comp[part, None] != comp[None, :]
            if not same:
                ok &= (blk[part, None] // per) != (blk[None, :] // per)
            x, y = np.nonzero(ok)
            first = np.concatenate([~(bands[x[k : k + SLAB] + i] == bands[y[k : k + SLAB]]).any(axis=1) for k in range(0, len(x), SLAB)] + [np.empty(0, bool)])
            x, y = x[first], y[first]
            found.append(np.unique(np.stack([x + i, blk[y]], axis=1), axis=0))
        at, other = np.concatenate(found).T
        return pd.DataFrame({"key": pdf["key"].iat[0], "bi": np.minimum(blk[at], other), "bj": np.maximum(blk[at], other), "blk": blk[at], "doc": doc[at], "comp": comp[at], "sketch": pdf["sketch"].to_numpy()[at]})

    return rows.groupBy("key", "wi", "wj").applyInPandas(run, "key long, bi int, bj int, blk int, doc long, comp long, sketch array<long>")


def _as_bytes(sets: DataFrame) -> DataFrame:
    """(id, s): sorted sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.asarray(x, np.int64).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "s"])

    return sets.select("id", "s").mapInArrow(run, "id long, s binary")


def _linked(docs: DataFrame, percent: int, width: int, samples: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Staged tables: the documents with their nodes and sketches, classes of equal sets, components of nodes, and which of these components further links merge."""
    cut = sketch_cut(percent / 100, samples)
    meta = stage(sketches(docs, width, samples, rows), "meta")
    fps = ["fp1", "fp2", "n_shingles"]
    # a document is a node of its own id; a repeated id's further texts are nodes beyond all ids, linked to it
    repeated = meta.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct(*fps)).alias("lo"), F.max(F.struct(*fps)).alias("hi"), F.count("*").alias("c")).where("c > 1")
    repeated = stage(repeated.select("doc_id", "lo", F.expr("lo <> hi").alias("differ")), "repeated")
    several = repeated.where("differ").select("doc_id", "lo")
    more = None
    if several.isEmpty():
        meta = meta.withColumn("node", F.col("doc_id"))
    else:
        top = meta.agg(F.max("doc_id")).first()[0] + 1
        more = meta.where("n_shingles > 0").join(several, "doc_id").where(F.struct(*fps) != F.col("lo")).select("doc_id", *fps).distinct()
        more = stage(more.withColumn("node", F.lit(top) + F.monotonically_increasing_id()), "more")
        meta = meta.join(more, ["doc_id", *fps], "left").withColumn("node", F.coalesce("node", "doc_id"))

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        if more is None:
            return stage(_sets(docs, ids, width), name)
        known = ids.join(more.select(F.col("node").alias("id"), "doc_id"), "id", "left").select(F.coalesce("doc_id", "id").alias("id")).distinct()
        got = _sets(docs, known, width).join(more.select(F.col("doc_id").alias("id"), F.col("fp1").alias("fp"), "node"), ["id", "fp"], "left")
        return stage(got.select(F.coalesce("node", "id").alias("id"), "fp", "s").dropDuplicates(["id"]), name)

    full = meta.where("n_shingles > 0")
    classes = full.groupBy(*fps).agg(F.min("node").alias("rep"), F.count("*").alias("c"))
    copies = stage(classes.where("c > 1").select(*fps, "rep"), "copies")
    # representatives: all but the copies that are not the smallest node of their class
    tagged = full.join(copies, fps, "left").where("rep is null or rep = node")
    reps = tagged.where("node is not null").select(F.col("node").alias("doc_id"), "n_shingles", "bands", "sketch")
    # only rows that repeat an id with its text can be of one node; without them the sketches need no shuffle for that
    reps = stage(reps if repeated.isEmpty() else reps.dropDuplicates(["doc_id"]), "reps")

    spread = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("doc").alias("lead"), F.count("*").alias("c")).where("c > 1")
    member = stage(spread.join(shared, "key").select("key", "doc", "n", "lead"), "members")

    star = member.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    star = stage(_passing(star, reps, cut), "star")
    sets = sets_of(_ends(star), "sets")
    links = confirm(star, sets, percent)
    if more is not None:
        of_one = meta.where("node <> doc_id").join(copies, fps, "left").select(F.coalesce("rep", "node").alias("a"), "doc_id", "node")
        first = meta.where("node = doc_id").join(copies, fps, "left").select("doc_id", F.coalesce("rep", "node").alias("b")).distinct()
        links = links.union(of_one.join(first, "doc_id").select("a", "b")).union(of_one.select("a", "doc_id")).distinct()
    comps = stage(connected_components(links), "comps")
    release(sets)

    at = member.join(comps, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    at = stage(at, "at")
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("n")).where("lo <> hi")
    # blocks in one of sketches: the fewer the shorter the texts
    mixed = mixed.withColumn("per", F.expr(f"case when n * {MOST} <= {WHOLE} * c then 2 when n * {MOST} <= {2 * WHOLE} * c then 4 else 8 end"))
    mixed = mixed.select("key", "c", "per", F.ceil(F.col("c") * F.col("per") / (2 * MOST)).cast("int").alias("nb"))
    rows = stage(at.drop("n").join(mixed, "key"), "mixed")
    each = reps.select(F.col("doc_id").alias("doc"), "sketch")
    small = rows.where(F.col("c") <= SMALL).join(each, "doc").select("key", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("blk"), "doc", "comp", "sketch")
    small = small.repartition("key").sortWithinPartitions("key")
    near = stage(_compare_blocks(small, cut, percent, whole=False).distinct(), "near")
    each = reps.select(F.col("doc_id").alias("doc"), "sketch", "bands")
    large = rows.where(F.col("c") > SMALL).join(each, "doc").withColumn("blk", F.expr("cast(pmod(xxhash64(doc), nb) as int)")).withColumn("w", F.expr("cast(blk div per as int)"))
    large = large.withColumn("j", F.explode(F.expr("sequence(0, cast((nb - 1) div per as int))")))
    large = stage(_promising(large.select("key", F.least("w", "j").alias("wi"), F.greatest("w", "j").alias("wj"), "blk", "per", "doc", "comp", "sketch", "bands"), cut), "large")
    release(reps)
    sets = sets_of(_ends(near).union(large.select(F.col("doc").alias("id"))).distinct(), "more_sets")
    large = large.join(_as_bytes(sets).withColumnRenamed("id", "doc"), "doc").select("key", "bi", "bj", "blk", "doc", "comp", "sketch", "s")
    large = large.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    far = _compare_blocks(large, cut, percent, whole=True)
    rest = confirm(near.union(far).distinct(), sets, percent)
    # merge the components that the further links join
    of = comps.select("node", "component")
    ends = rest.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = stage(connected_components(ends.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))), "merged")
    release(sets)
    return meta, copies, comps, merged


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, samples: int = SAMPLES, rows: int = ROWS) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word shingles.

    docs: doc_id (integer), text; other columns are ignored. Returns one row
    per row: doc_id, n_shingles, component_id, kept. A null, empty or blank
    text has no shingles, links with nothing and is kept. Equal texts are
    linked; ties go to the smallest doc_id. An empty table gives no rows. Rows
    that repeat a doc_id are one document that is linked by any of its texts;
    a row without words stays alone.
    """
    with tidied(docs.sparkSession):
        meta, copies, comps, merged = _linked(docs, percent, width, samples, rows)
    merged = merged.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    out = meta.join(copies, ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "node").alias("rep"))
    out = out.join(comps, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("c0"))
    out = out.join(merged, F.col("c0") == F.col("c1"), "left").select("doc_id", "n_shingles", F.coalesce("c2", "c0").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """Keep one document of each component, the one with the smallest doc_id; columns stay, whatever their names. Documents with a null doc_id are kept; of rows that repeat a doc_id all stay or go."""
    gone = near_duplicates(docs.where("doc_id is not null"), percent, width).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    whole = docs.select(nested(docs), F.col("doc_id").cast("long").alias("key"))
    return whole.join(gone, F.col("key") == F.col("gone"), "left_anti").select("d.*")

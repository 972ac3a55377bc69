"""Best-fit packing of token sequences, improved by swaps.

Documents are tokenised whole; only those longer than a sequence are cut.
Pieces are dealt into groups of bounded size by a hash. Inside a group they
are placed best-fit, largest first; then a local search empties bins: from
the emptiest bin on, pieces move into others, are exchanged one for one, two
for one or one for two, by whatever raises the sum of squared fills most, until
no exchange between any two underfull bins does, or there are as few bins as
the sizes allow, so that none can be emptied. The pieces of bins that stay
underfull are dealt again into fewer groups and packed as a second round, so
the loss does not grow with the number of groups.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.llm.common import remembered, small_batches, stage

CAPACITY = 4096
#: Pieces of a group, about.
GROUP = 1000
#: Parts of words a worker remembers the ids of.
REMEMBER = 700_000
#: Texts of these characters alone are stable under NFC, keep their code range when lower-cased, and have the same letters, numbers and spaces for Python as for the vocabulary's pattern; any other text takes the slower way.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027]*")
_L, _N = "a-zªµºß-öø-\u017f", "0-9²³¹¼½¾"
#: The pattern of the vocabulary file (a fixed value), for lower-cased plain texts.
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is printable, else as the next letter from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """ids of a text, as little-endian unsigned 32-bit words.

    A plain text is split by the vocabulary's own pattern and each part is
    given to the model once and remembered, up to a bound; parts do not
    influence each other. Other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = _Known(self)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4").tobytes()

    def part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not _PLAIN.fullmatch(text) or any(m in text for m in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        return b"".join(map(self.known.__getitem__, _PARTS.findall(text.lower()))) + self.end


class _Known(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, part: str) -> bytes:
        ids = self.codec.part(part)
        if len(self) < REMEMBER:
            self[part] = ids
        return ids


def _codec(path: str, end_id: int) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(("codec", path, end_id), lambda: Codec(path, end_id))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. A null text is empty: one piece that holds the end id alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, step = _codec(tokenizer, end_id), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = codec.encode(text)
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    out.append((doc, i // step, i // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin (from 0, gapless) of each size. Deterministic: ties go to the earlier piece."""
    sizes = np.asarray(sizes, np.int64)
    where, fill = np.zeros(len(sizes), np.int64), []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(room, (s, -1))
        if at == len(room):
            b = len(fill)
            fill.append(s)
        else:
            b = room.pop(at)[1]
            fill[b] += s
        where[i] = b
        if fill[b] < capacity:
            bisect.insort(room, (capacity - fill[b], b))
    improve(sizes, where, np.array(fill, np.int64), capacity)
    return np.unique(where, return_inverse=True)[1]


def improve(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int) -> None:
    """Exchange pieces between underfull bins, in place, until none raises the sum of squared fills or no bin can be emptied; emptiest bins first."""
    # when each bin was changed, and when it was last found to have no exchange: since then only with changed bins can it have one
    now, changed, seen = 1, np.ones(len(fill), np.int64), np.zeros(len(fill), np.int64)
    pairs: dict[int, np.ndarray] = {}  # pairs of pieces of a bin, as long as it does not change
    # no two pieces of more than half a bin share one
    fewest = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while np.count_nonzero(fill) > fewest:
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        for a in under[np.lexsort((under, fill[under]))].tolist():
            others = under[(under != a) & ((changed[under] > seen[a]) | (changed[a] > seen[a]))]
            act = _exchange(sizes, where, fill, capacity, a, others, pairs) if len(others) else None
            seen[a] = now
            if act is not None:
                break
        else:
            return
        b, out, back = act
        where[out], where[back] = b, a
        d = int(sizes[out].sum() - sizes[back].sum())
        fill[a] -= d
        fill[b] += d
        now += 1
        changed[a] = changed[b] = now
        pairs.pop(a, None), pairs.pop(b, None)


def _kinds(sizes: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows of every size: the others are as good. A bin has few different sizes, whatever the number of its pieces."""
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    new = np.r_[True, sizes[rows][1:] != sizes[rows][:-1]] if len(rows) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows[np.arange(len(rows)) - first < most]


def _exchange(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int, a: int, others: np.ndarray, pairs: dict[int, np.ndarray]) -> tuple[int, list[int], list[int]] | None:
    """One of the other bins, the pieces that a gives it and those it gives back: the move that raises the squared fills most; without moves the best exchange of one for one; then two for one; then one for two."""
    mine = _kinds(sizes, np.flatnonzero(where == a), 2)

    def best(give: np.ndarray, take: np.ndarray, bins: np.ndarray) -> tuple[int, int] | None:
        """Places of the sums to give and to take, for which a's loss is another bin's gain."""
        got, most = None, 0
        for i in range(0, len(give), max(1, 1_000_000 // len(take))):
            d = give[i : i + max(1, 1_000_000 // len(take)), None] - take
            gain = d * (fill[bins] - fill[a] + d)
            gain[(d <= 0) | (d > capacity - fill[bins])] = 0
            k = int(gain.argmax())
            if gain.flat[k] > most:
                got, most = (i + k // len(take), k % len(take)), int(gain.flat[k])
        return got

    one = mine[np.r_[True, sizes[mine][1:] != sizes[mine][:-1]]]
    if hit := best(sizes[one], np.zeros(len(others), np.int64), others):
        return int(others[hit[1]]), [int(one[hit[0]])], []
    among = np.zeros(len(fill), bool)
    among[others] = True
    theirs = np.flatnonzero(among[where])
    if hit := best(sizes[one], sizes[theirs], where[theirs]):
        return int(where[theirs[hit[1]]]), [int(one[hit[0]])], [int(theirs[hit[1]])]
    x, y = np.triu_indices(len(mine), 1)
    if len(x) and (hit := best(sizes[mine[x]] + sizes[mine[y]], sizes[theirs], where[theirs])):
        return int(where[theirs[hit[1]]]), [int(mine[x[hit[0]]]), int(mine[y[hit[0]]])], [int(theirs[hit[1]])]
    for o in others.tolist():
        if o not in pairs:
            rows = _kinds(sizes, np.flatnonzero(where == o), 2)
            x, y = np.triu_indices(len(rows), 1)
            pairs[o] = np.stack([rows[x], rows[y]])
    p = np.concatenate([pairs[o] for o in others.tolist()], axis=1)
    p = p[:, sizes[p].sum(axis=0) < sizes[one].max()]
    if p.shape[1] and (hit := best(sizes[one], sizes[p].sum(axis=0), where[p[0]])):
        return int(where[p[0, hit[1]]]), [int(one[hit[0]])], p[:, hit[1]].tolist()
    return None


def _pack_groups(items: DataFrame, capacity: int, groups: int, tag: str) -> DataFrame:
    """items: (item, size) to (item, size, bin, fill); bins are unique strings."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "size"], kind="stable")
        b = pack(pdf["size"].to_numpy(), capacity)
        fill = np.bincount(b, weights=pdf["size"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "bin": pdf["g"].astype(np.int64) * 10_000_000 + b, "fill": fill[b]})

    # groups are few bytes and much work, so each has a partition, which is not merged with others
    g = items.withColumn("g", F.expr(f"cast(pmod(xxhash64(item, '{tag}'), {groups}) as int)")).repartition(groups, "g")
    return g.groupBy("g").applyInPandas(run, "item long, size long, bin long, fill long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset per
    piece. Null and empty texts hold the end id alone; a row that repeats a
    document is packed again; ties go to the row that is read first; extra
    columns are ignored; an empty table gives no rows.
    """
    p = stage(pieces(docs, tokenizer, end_id, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    n = p.where(F.col("length") < capacity).count()
    small = p.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    first = stage(_pack_groups(small, capacity, max(1, -(-n // group)), "a"), "packed")
    # the pieces of bins with room left are dealt again, into fewer groups
    loose = stage(first.where(F.col("fill") < capacity - capacity // 64).select("item", "size", F.col("bin").alias("old")), "loose")
    m = loose.count()
    again = stage(_pack_groups(loose, capacity, max(1, -(-m // group)), "b").select("item", F.col("bin").alias("bin2")), "again")
    if again.select(F.count_distinct("bin2")).first()[0] > loose.select(F.count_distinct("old")).first()[0]:
        again = again.limit(0)
    placed = first.join(again, "item", "left").select("item", F.coalesce(2 * F.col("bin2") + 1, 2 * F.col("bin")).alias("s"))
    t = p.join(placed, "item", "left").withColumn("sequence_id", F.coalesce(2 * F.col("s"), 2 * F.col("item") + 1))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    return t.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))

"""Masked pseudo-likelihood of documents.

A small bidirectional window network predicts every word from the two words on
either side: log P(w_i | w_{i-2}, w_{i-1}, w_{i+1}, w_{i+2}), summed over all
positions. Its output is a softmax of two levels over words: first the class,
then the group within the class, both from the hidden layer. The most frequent
words are classes of their own; the other words of the table are dealt, by
falling count, into groups of equal mass, so that most groups of the corpus's
frequent words hold one word or a few. Within its group a word has its share of
the group's count. The same groups are what the network sees of the context.

Word counts come from all documents. The table that is with every task holds
the words that make up one token in TABLE and occur LEAST times, a rule that is
the same at every size. All other words are in four groups by length. Their
counts, of which there are as many as the corpus has words, stay distributed
and are joined to the words of the documents; a document's own occurrences are
left out of them, so words that other documents have too are told from words
that only it has. Those are spelled, by a character bigram model of all words.

The network is trained in numpy where the data is. Documents are dealt to parts
by a hash, PART tokens in each on average, and stand in a part by doc_id. In
round r a copy of the network is trained on the positions r, r + STRIDE, ... of
each document of a part, so that after STRIDE rounds every position has been a
target; the copies are averaged in the order of the parts, and the next round
starts from the average. So the result does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import small_batches, stage

#: The table has words of one token in TABLE that occur LEAST times; so it has TABLE words at most.
TABLE, LEAST = 1_000_000, 50
#: Words that are classes of their own; classes of GROUPS groups each; groups by length.
OWN, SHARED, GROUPS, REST = 40, 20, 64, 4
CLASSES = OWN + SHARED + REST
#: Groups of words there are; as a context, EDGE stands beyond the ends.
LEAVES = OWN + SHARED * GROUPS + REST
EDGE = LEAVES
#: The groups by length begin above these.
LENGTHS = 6, 10, 15
SIDE, HIDDEN = 2, 16
#: STRIDE is at most ROUNDS, so that every position is a target.
STRIDE, ROUNDS, BATCH = 2, 2, 2048
#: Tokens of a part, about.
PART = 2_000_000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Characters of the bigram table; bounds it. All others have their own share of what it gives to others.
CHARS = 400
#: Tokens that are scored together; bounds a worker's memory.
TOGETHER = 65_536
#: Rows whose exponentials are held at once when scoring; they fit a core's cache.
SCORED = 1024
#: Weights that are added up in one task.
ADDED = 32

_LEAF = np.arange(LEAVES)
#: Class of each group, and its number within a class of several.
CLASS_OF = np.where(_LEAF < OWN, _LEAF, np.where(_LEAF < LEAVES - REST, OWN + (_LEAF - OWN) // GROUPS, _LEAF - LEAVES + CLASSES))
GROUP_OF = np.where((_LEAF >= OWN) & (_LEAF < LEAVES - REST), (_LEAF - OWN) % GROUPS, 0)


def rest_group(n):
    """0 to REST - 1: which group by length a word outside the table is in, by its length."""
    return sum((n > least) * 1 for least in LENGTHS)


class Lexicon:
    """Group and log P(word | group) of every word there can be."""

    def __init__(self, words: list[str], counts: list[int], rest: list[int], chars: dict[str, int], bigrams: np.ndarray, others: dict[str, int], table: DataFrame | None):
        """words of the table by falling count; rest: tokens of all other words by length; bigrams: log P(next | char), 0 is the boundary, the last is any other character; others: the counts of those; table: (h, c), hash and count of the words that are not in `words`."""
        self.ids = {w: i for i, w in enumerate(words)}
        n = np.array(counts, np.float64)
        own = min(OWN, len(n))
        tail = n[own:]
        at = OWN + np.minimum(SHARED * GROUPS - 1, (np.cumsum(tail) - tail) / max(1.0, tail.sum()) * SHARED * GROUPS).astype(np.int64)
        #: Tokens of every group; of those by length, one more for words that the corpus does not have.
        self.mass = np.zeros(LEAVES)
        self.mass[:own] = n[:own]
        np.add.at(self.mass, at, tail)
        self.mass[LEAVES - REST :] = np.array(rest) + 1.0
        self.leaves = np.r_[np.arange(own), at].astype(np.int64)
        self.within = np.r_[np.zeros(own), np.log(tail / self.mass[at])]
        self.letters = np.full(0x110000, len(bigrams) - 1, np.int16)
        self.letters[32] = 0
        for c, k in chars.items():
            self.letters[ord(c)] = k
        self.bigrams = bigrams
        total = sum(others.values()) + 1
        self.others = {c: math.log(k / total) for c, k in others.items()}
        self.unknown = -math.log(total * 0x110000)
        self.table = table

    def __getstate__(self) -> dict:
        """What tasks get: all but the distributed table."""
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def tokens(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """Words of a whole text and their numbers, -1 for those outside the table."""
        words = text.lower().split() if text else []
        return words, np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def groups(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """The group of each word."""
        rare = np.flatnonzero(ids < 0)
        out = self.leaves[ids] if len(self.leaves) else np.empty(len(ids), np.int64)
        out[rare] = LEAVES - REST + rest_group(np.fromiter((len(words[k]) for k in rare.tolist()), np.int64, len(rare)))
        return out

    def spelled(self, words: list[str]) -> np.ndarray:
        """log P(word | group) of words that no other document has: letter by letter."""
        if not words:
            return np.empty(0)
        text = f" {' '.join(words)} "
        c = self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        start = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        out = np.add.reduceat(self.bigrams[c[:-1], c[1:]], start)
        odd = np.flatnonzero(c == len(self.bigrams) - 1)
        if len(odd):
            np.add.at(out, np.searchsorted(start, odd, "right") - 1, [self.others.get(text[i], self.unknown) for i in odd])
        n = np.fromiter(map(len, words), np.int64, len(words))
        return out - np.log(self.mass[LEAVES - REST + rest_group(n)])


Weights = list[np.ndarray]


def start_weights(lex: Lexicon | None = None, seed: int = 3) -> Weights:
    """Input tables by side, hidden bias; classes and their bias; groups of each class and their bias. The biases of the output begin at what is known without a context."""
    rng = np.random.default_rng(seed)
    share = np.zeros(LEAVES) if lex is None else np.log((lex.mass + 1e-3) / lex.mass.sum())
    group = share[OWN : LEAVES - REST].reshape(SHARED, GROUPS)
    most = np.r_[share[:OWN], np.logaddexp.reduce(group, axis=1), share[LEAVES - REST :]]
    return [
        (0.1 * rng.standard_normal((2 * SIDE, LEAVES + 1, HIDDEN))).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        (0.1 * rng.standard_normal((HIDDEN, CLASSES))).astype(np.float32),
        most.astype(np.float32),
        (0.1 * rng.standard_normal((SHARED, HIDDEN, GROUPS))).astype(np.float32),
        (group - np.logaddexp.reduce(group, axis=1, keepdims=True)).astype(np.float32),
    ]


def _lined(docs: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Documents one after the other, with edges between them, and where each begins."""
    edge = np.full(SIDE, EDGE)
    whole = np.concatenate([x for d in docs for x in (edge, d)] + [edge]).astype(np.int64)
    return whole, np.cumsum([SIDE] + [len(d) + SIDE for d in docs[:-1]]).tolist()


def _around(whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups around places of documents in a line, those of one side together, and the groups at them."""
    return np.stack([whole.take(at + k) for k in range(-SIDE, SIDE + 1) if k]).T, whole.take(at)


def _context(leaves: np.ndarray) -> np.ndarray:
    """The groups around every position."""
    return _around(_lined([leaves])[0], np.arange(len(leaves)) + SIDE)[0]


def _hidden(w: Weights, ctx: np.ndarray) -> np.ndarray:
    h = w[0][0].take(ctx[:, 0], axis=0)
    for i in range(1, 2 * SIDE):
        h += w[0][i].take(ctx[:, i], axis=0)
    h += w[1]
    # tanh as 1 - 2 / (1 + exp(2 x)), since numpy's exp is faster; from 40 on it is 1
    np.minimum(h, 40, out=h)
    h += h
    np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return h


def _exp(z: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of z and their sums by row. Where those might not be finite, each row's maximum is taken from z first, in place."""
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(axis=1, keepdims=True)
    e = np.exp(z, out=out)
    return e, e @ np.ones(z.shape[1], np.float32)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows whose class has groups, class by class; the classes that have rows, and where those begin and end."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(cls.take(order), np.arange(OWN, OWN + SHARED + 1)).tolist()
    return order[cuts[0] : cuts[-1]], [(c, a - cuts[0], b - cuts[0]) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def leaf_logprob(w: Weights, ctx: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log P(group | context) of every row."""
    n, cls = len(leaf), CLASS_OF.take(leaf)
    out, h = np.empty(n, np.float32), np.empty((n, HIDDEN), np.float32)
    for i in range(0, n, SCORED):
        h[i : i + SCORED] = _hidden(w, ctx[i : i + SCORED])
        z = h[i : i + SCORED] @ w[2]
        z += w[3]
        total = _exp(z)[1]
        out[i : i + SCORED] = z[np.arange(len(z)), cls[i : i + SCORED]] - np.log(total)
    rows, classes = _by_class(cls)
    for c, a, b in classes:
        for i in range(a, b, SCORED):
            r = rows[i : min(i + SCORED, b)]
            z = h.take(r, axis=0) @ w[4][c]
            z += w[5][c]
            total = _exp(z)[1]
            out[r] += z[np.arange(len(z)), GROUP_OF.take(leaf.take(r))] - np.log(total)
    return out


def document_sums(w: Weights, docs: list[np.ndarray]) -> np.ndarray:
    """Summed log-probabilities of the groups of several documents, scored together; each sees only its own words."""
    whole, start = _lined(docs)
    at = np.concatenate([np.arange(o, o + len(d)) for d, o in zip(docs, start, strict=True)])
    lp = np.zeros(len(at))
    for i in range(0, len(at), TOGETHER):
        lp[i : i + TOGETHER] = leaf_logprob(w, *_around(whole, at[i : i + TOGETHER]))
    return np.array([x.sum() for x in np.split(lp, np.cumsum([len(d) for d in docs])[:-1])])


def sgd(w: Weights, past: Weights, ctx: np.ndarray, leaf: np.ndarray, rate: float = 0.08) -> None:
    """One Adagrad step, in place; past holds the squared sums."""
    n, ones = len(leaf), np.ones(len(leaf), np.float32)
    cls, h = CLASS_OF.take(leaf), _hidden(w, ctx)
    z = h @ w[2]
    z += w[3]
    p, total = _exp(z, z)
    p *= (1 / (n * total))[:, None]
    p[np.arange(n), cls] -= 1 / n
    back = p @ w[2].T
    steps = [(w[2], past[2], h.T @ p), (w[3], past[3], ones @ p)]
    rows, classes = _by_class(cls)
    if classes:
        # each class has as many rows as it has, in one array
        own = h.take(rows, axis=0)
        z = np.empty((len(rows), GROUPS), np.float32)
        for c, a, b in classes:
            np.matmul(own[a:b], w[4][c], out=z[a:b])
            z[a:b] += w[5][c]
        q, total = _exp(z, z)
        q *= (1 / (n * total))[:, None]
        q[np.arange(len(rows)), GROUP_OF.take(leaf.take(rows))] -= 1 / n
        groups, bias = np.zeros_like(w[4]), np.zeros_like(w[5])
        for c, a, b in classes:
            np.matmul(own[a:b].T, q[a:b], out=groups[c])
            np.matmul(ones[a:b], q[a:b], out=bias[c])
            np.matmul(q[a:b], w[4][c].T, out=own[a:b])
        back[rows] += own
        steps += [(w[4], past[4], groups), (w[5], past[5], bias)]
    h *= h
    back *= 1 - h
    steps.append((w[1], past[1], ones @ back))
    # all sides at once: row i * (LEAVES + 1) + group of the tables that lie one after the other. Two columns are a complex number, so that half as many are added
    key = (ctx.T + np.arange(2 * SIDE)[:, None] * (LEAVES + 1)).ravel()
    table = np.zeros((HIDDEN // 2, w[0].size // HIDDEN), np.complex64)
    for column, values in zip(table, np.tile(back.view(np.complex64).T, (1, 2 * SIDE)), strict=True):
        np.add.at(column, key, values)
    steps.append((w[0], past[0], np.ascontiguousarray(table.T).view(np.float32).reshape(w[0].shape)))
    for a, sq, g in steps:
        x = g * g
        sq += x
        np.sqrt(np.add(sq, 1e-8, out=x), out=x)
        g *= rate
        g /= x
        a -= g


def _pack(w: Weights) -> bytes:
    return b"".join(x.astype(np.float64).tobytes() for x in w)


def _unpack(b: bytes) -> Weights:
    flat, out, at = np.frombuffer(b), [], 0
    for x in start_weights():
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c) over all documents, by the same rule that scoring splits words by. Tasks count in tables of bounded size before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["w", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(text.lower().split())
            if len(held) >= COUNTED:
                yield flush()
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def lexicon(docs: DataFrame, table: int = TABLE, least: int = LEAST) -> Lexicon:
    """Counts over all documents; the driver receives the words of the table (`table` at most) and a table of character pairs, all other words stay distributed."""
    t = stage(word_counts(docs), "words")
    total = t.agg(F.sum("c")).first()[0] or 0
    common = (F.col("c") * table >= total) & (F.col("c") >= least)
    top = t.where(common).toPandas().sort_values(["c", "w"], ascending=[False, True])
    rest = t.where(~common)
    length = sum(((F.length("w") > n).cast("int") for n in LENGTHS), F.lit(0))
    by_length = {r["k"]: r["n"] for r in rest.groupBy(length.alias("k")).agg(F.sum("c").alias("n")).collect()}
    # the spelling of all words
    ends = F.expr("transform(sequence(1, length(w) + 1), i -> concat(if(i = 1, ' ', substring(w, i - 1, 1)), if(i > length(w), ' ', substring(w, i, 1))))")
    pairs = stage(t.select(F.explode(ends).alias("p"), "c").groupBy("p").agg(F.sum("c").alias("c")), "pairs")
    chars = pairs.where("substring(p, 1, 1) <> ' '").groupBy(F.substring("p", 1, 1).alias("a")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "a").collect()  # as many as Unicode has at most
    known = {r["a"]: i + 1 for i, r in enumerate(chars[:CHARS])}
    n = len(known) + 2
    counts = np.full((n, n), 0.01)
    letter = lambda c: 0 if c == " " else known.get(c, n - 1)
    side = lambda c: F.when(c == " ", " ").when(c.isin(list(known)) if known else F.lit(False), c).otherwise("\x00")
    for r in pairs.groupBy(side(F.substring("p", 1, 1)).alias("a"), side(F.substring("p", 2, 1)).alias("b")).agg(F.sum("c").alias("c")).collect():
        counts[letter(r["a"]), letter(r["b"])] += r["c"]
    bigrams, others = np.log(counts / counts.sum(axis=1, keepdims=True)), {r["a"]: r["c"] for r in chars[CHARS:]}
    # two words of one hash would share a count: a few among 10^10 words
    hashed = rest.groupBy(F.xxhash64("w").alias("h")).agg(F.sum("c").alias("c"))
    return Lexicon(top["w"].tolist(), top["c"].tolist(), [by_length.get(k, 0) for k in range(REST)], known, bigrams, others, hashed)


_RARE = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("q", pa.int8()), ("lp", pa.float32())])


def encode(docs: DataFrame, lex: Lexicon, part: int = PART) -> DataFrame:
    """Documents as numbers, dealt to parts and ordered by part and doc_id in files of their own parts: part, row (unique), doc_id, n, base (summed log P(word | group) of the table's words), leaves (16-bit groups of all words), rare (other words: hash, occurrences, group by length, log-probability if no other document has it)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lex)
    names = ["part", "doc_id", "th", "n", "base", "leaves", "rare", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, base = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            leaves, rare, times, sizes = [], [], [], [0]
            for i, text in enumerate(batch.column(1).to_pylist()):
                words, ids = lex.tokens(text)
                n[i], base[i] = len(words), lex.within[ids[ids >= 0]].sum()
                leaves.append(lex.groups(words, ids).astype("<u2").tobytes())
                own = Counter([words[k] for k in np.flatnonzero(ids < 0).tolist()])
                rare.extend(own), times.extend(own.values()), sizes.append(len(rare))
            h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in rare), np.uint64, len(rare)).view(np.int64)
            q = rest_group(np.fromiter(map(len, rare), np.int64, len(rare))) if rare else np.empty(0)
            cols = [pa.array(h), pa.array(times, pa.int32()), pa.array(q.astype(np.int8)), pa.array(lex.spelled(rare).astype(np.float32))]
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(_RARE)))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(3), pa.array(n), pa.array(base), pa.array(leaves, pa.binary()), lists, pa.array(np.arange(first, first + len(n)))], names=names)
            first += len(n)

    tokens = float(lex.mass.sum())
    parts = max(1, math.ceil(tokens / part))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = t.select("doc_id", "text", F.expr(f"cast(pmod(xxhash64(doc_id, text), {parts}) as int)").alias("part"), F.xxhash64("text").alias("th"))
    t = t.mapInArrow(run, "part int, doc_id long, th long, n long, base double, leaves binary, rare array<struct<h:long,k:int,q:tinyint,lp:float>>, row long")
    # a part lies in one file, and a file in one row group, which one task reads
    return stage(t.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "th").drop("th"), "encoded")


def _sum_in_order(got: DataFrame) -> Weights | None:
    """(part, n, w) to the mean of the weights; added up by parts in their order, ADDED of them in a task."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        n = pdf["n"].sum()
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // ADDED], "n": [n], "w": [sum(k / n * np.frombuffer(w) for k, w in zip(pdf["n"], pdf["w"], strict=True)).tobytes()]})

    got = stage(got, "weights")
    while (got.agg(F.max("part")).first()[0] or 0) >= ADDED:
        got = stage(got.groupBy((F.col("part") / ADDED).cast("int").alias("g")).applyInPandas(add, "part int, n long, w binary"), "weights")
    rows = got.orderBy("part").collect()
    n = sum(r["n"] for r in rows)
    return _unpack(sum(r["n"] / n * np.frombuffer(r["w"]) for r in rows).tobytes()) if rows else None


def train(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS, stride: int = STRIDE) -> Weights:
    """Rounds of local training and averaging over all positions of all documents."""
    if stride > rounds:
        raise ValueError("with more strides than rounds some positions are never a target")
    spark = encoded.sparkSession
    small_batches(spark)
    weights = start_weights(lex)
    for turn in range(rounds):
        begin = spark.sparkContext.broadcast(_pack(weights))

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, begin=begin) -> Iterator[pa.RecordBatch]:
            part, w, past = None, [], []
            seen, docs, held = 0, [], 0
            ctx = goal = None

            def step(least: int) -> None:
                """Train on what is held, in batches, until fewer than `least` positions are left."""
                nonlocal docs, ctx, goal, held
                if docs:
                    whole, start = _lined(docs)
                    new = _around(whole, np.concatenate([np.arange(o + turn % stride, o + len(d), stride) for d, o in zip(docs, start, strict=True)]))
                    ctx, goal = new if goal is None else (np.concatenate([ctx.T, new[0].T], axis=1).T, np.concatenate([goal, new[1]]))
                while len(goal) >= least:
                    sgd(w, past, ctx[:BATCH], goal[:BATCH])
                    ctx, goal = ctx[BATCH:], goal[BATCH:]
                docs, held = [], len(goal)

            def close() -> Iterator[pa.RecordBatch]:
                if held:
                    step(1)
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen]), pa.array([_pack(w)], pa.binary())], names=["part", "n", "w"])

            for batch in batches:
                for p, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if p != part:
                        yield from close()
                        part, w, seen, docs, held = p, _unpack(begin.value), 0, [], 0
                        past, ctx, goal = [np.full_like(x, 1e-3) for x in w], None, None
                    leaf = np.frombuffer(leaves, "<u2")
                    targets = len(range(turn % stride, len(leaf), stride))
                    seen += len(leaf)
                    if targets:
                        docs.append(leaf)
                        held += targets
                    if held >= 8 * BATCH:
                        step(BATCH)
            yield from close()

        weights = _sum_in_order(encoded.select("part", "leaves").mapInArrow(learn, "part int, n long, w binary")) or weights
        begin.unpersist()
    return weights


def score(encoded: DataFrame, lex: Lexicon, weights: Weights) -> DataFrame:
    """doc_id, n_tokens, n_unseen (different words that no other document has), pll (summed log-probabilities), mean_logprob, pseudo_perplexity. A null or blank text has no tokens, pll 0 and null means."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sums = batch.column(3).to_numpy(zero_copy_only=False).copy()
            rows, held, size = [], [], 0
            for i, leaves in enumerate(batch.column(4).to_pylist()):
                if leaves:
                    rows.append(i), held.append(np.frombuffer(leaves, "<u2"))
                    size += len(held[-1])
                if held and (size >= TOGETHER or i + 1 == batch.num_rows):
                    sums[rows] += document_sums(w, held)
                    rows, held, size = [], [], 0
            if held:
                sums[rows] += document_sums(w, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums)], names=["row", "doc_id", "n_tokens", "sums"])

    scored = encoded.select("row", "doc_id", "n", "base", "leaves").mapInArrow(run, "row long, doc_id long, n_tokens long, sums double")
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.k").alias("k"), F.col("x.q").alias("q"), F.col("x.lp").alias("lp"))
    mass = F.array(*[F.lit(float(math.log(x))) for x in lex.mass[LEAVES - REST :]])
    others = F.col("c") - F.col("k")
    seen = F.coalesce(others > 0, F.lit(False))
    own = F.col("k") * F.when(seen, F.log(others) - F.element_at(mass, F.col("q") + 1)).otherwise(F.col("lp").cast("double"))
    per = rare.join(lex.table.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(own).alias("own"), F.count_if(~seen).alias("unseen"))
    t = scored.join(per, "row", "left")
    pll = F.round(F.col("sums") + F.coalesce("own", F.lit(0.0)), 4)
    t = t.select("doc_id", "n_tokens", F.coalesce("unseen", F.lit(0)).cast("long").alias("n_unseen"), pll.alias("pll"))
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return t.withColumn("mean_logprob", mean).withColumn("pseudo_perplexity", F.exp(-mean))


def pseudo_likelihood(docs: DataFrame, table: int = TABLE, least: int = LEAST, rounds: int = ROUNDS, stride: int = STRIDE, part: int = PART) -> DataFrame:
    """Fit on all documents and score them all. Extra columns are ignored; rows that repeat a document each get a row with the same score, and are other documents to each other; whole texts count however long; an empty table gives none."""
    lex = lexicon(docs, table, least)
    encoded = encode(docs, lex, part)
    return score(encoded, lex, train(encoded, lex, rounds, stride))

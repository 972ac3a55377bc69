"""Language identification by word-first backoff.

Known words score by their log relative frequency in each language. A word
that was not learned falls back to its character 4-grams, those that were not
learned to the 3-grams in them, and so on down to a floor; every step back
costs a fixed factor. A document's score for a language is the sum over all
its words; the answer is the language with the highest sum, and its score the
posterior at the mean word, so that long texts do not all score 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import small_batches, stage

#: Rows per language that the model is fitted on, about; which ones, a hash of doc_id says.
FIT_ROWS = 1500
#: Entries of the word table and of each n-gram table, at most: the most frequent, ties by code point.
TABLE = 60_000
#: Words and n-grams that occur less often than this are not learned; a word then backs off.
LEAST = 2
GRAMS = (4, 3, 2, 1)
BACKOFF, FLOOR = math.log(0.4), -14.0
UNKNOWN = "und"
#: A word is a run of letters, in fitting and in predicting.
LETTERS = r"\p{L}+"
_WORD = regex.compile(LETTERS)
#: Words that are scored together; bounds a worker's memory.
TOGETHER = 100_000


def _padded(w: str) -> str:
    """A word between its ends, four characters at least."""
    return f"\x02{w}\x03" if len(w) > 1 else f"\x02{w}\x03\x03"


def _codes(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[at + k] + np.uint64(0x632BE59BD9B4E019))
        out ^= out >> np.uint64(29)
    return out


class Model:
    """Per-language log frequencies of words and character n-grams."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]):
        self.langs = langs
        self.ids = {w: i for i, w in enumerate(words)}
        self.rows = np.array(list(words.values()), np.float64).reshape(len(words), len(langs))
        self.keys, self.gram_rows = {}, {}
        with np.errstate(over="ignore"):
            for n, table in grams.items():
                chars = np.frombuffer("".join(table).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                keys = _codes(chars, np.arange(len(table)) * n, n)
                order = np.argsort(keys, kind="stable")
                self.keys[n] = keys[order]
                self.gram_rows[n] = np.array(list(table.values()), np.float64).reshape(len(table), len(langs))[order]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that were not learned: the mean over their 4-grams, each backed off to the longest n-grams in it that were."""
        padded = [_padded(w) for w in words]
        n_of = np.fromiter(map(len, padded), np.int64, len(padded))
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.cumsum(n_of) - n_of
        count = n_of - 3
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        score = np.full((len(at), len(self.langs)), FLOOR)
        todo = np.arange(len(at))
        with np.errstate(over="ignore"):
            for depth, n in enumerate(GRAMS):
                keys = self.keys[n]
                if not len(todo) or not len(keys):
                    continue
                total, hits = np.zeros((len(todo), len(self.langs))), np.zeros(len(todo), np.int64)
                for k in range(GRAMS[0] - n + 1):
                    code = _codes(chars, at[todo] + k, n)
                    j = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                    hit = keys[j] == code
                    total[hit] += self.gram_rows[n][j[hit]]
                    hits += hit
                done = hits > 0
                score[todo[done]] = total[done] / hits[done, None] + depth * BACKOFF
                todo = todo[~done]
        return np.add.reduceat(score, np.cumsum(count) - count, axis=0) / count[:, None] + BACKOFF

    def sums(self, docs: list[list[str]]) -> np.ndarray:
        """Summed scores of documents; each has a word at least."""
        flat = [w for d in docs for w in d]
        at = np.fromiter(map(self.ids.get, flat, repeat(-1)), np.int64, len(flat))
        new: dict[str, int] = {}
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = len(self.rows) + new.setdefault(flat[i], len(new))
        rows = np.concatenate([self.rows, self.unseen(list(new))]) if new else self.rows
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        return np.add.reduceat(rows[at], np.cumsum(n) - n, axis=0)


def fit(labelled: DataFrame, rows: int = FIT_ROWS, table: int = TABLE) -> Model:
    """labelled: text, lang, key (a stable hash). Null langs and texts teach nothing. Rows are chosen where they are, by their hash and their language's number of rows, so no text is moved; counts are of whole texts."""
    t = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in t.groupBy("lang").agg(F.count("*")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {n: {} for n in GRAMS})
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, rows / sizes[x]))])
    chosen = t.where(F.pmod("key", F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")])
    words = stage(chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), 0)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c")), "words")
    ln, at = len(langs), {x: i for i, x in enumerate(langs)}

    def logs(counts: DataFrame) -> dict[str, np.ndarray]:
        sums = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("c")).collect()}
        base = np.array([sums.get(x, 0) + 1.0 for x in langs])
        keep = counts.groupBy("w").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("m")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "w").limit(table)
        out = {}
        for r in keep.collect():
            v = np.full(ln, 0.3)
            for k, c in r["m"].items():
                v[at[k]] += c
            out[r["w"]] = np.log(v / base)
        return out

    padded = words.select("lang", "c", F.expr("concat('\x02', w, '\x03', if(length(w) = 1, '\x03', ''))").alias("p"))
    grams = {}
    for n in GRAMS:
        g = padded.select("lang", "c", F.explode(F.expr(f"transform(sequence(1, length(p) - {n - 1}), i -> substring(p, i, {n}))")).alias("w"))
        grams[n] = logs(g.groupBy("lang", "w").agg(F.sum("c").alias("c")))
    return Model(langs, logs(words), grams)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score. A text that is null or has no letter, and any text if nothing was learned, is `und` with score 0."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model.langs, object)
        for batch in batches:
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            rows: list[int] = []
            held: list[list[str]] = []

            def close(rows=rows, held=held, pred=pred, score=score) -> None:
                if held:
                    mean = model.sums(held) / np.array([[len(d)] for d in held])
                    best = mean.argmax(axis=1)
                    pred[rows] = langs[best]
                    score[rows] = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
                rows.clear(), held.clear()

            n = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = _WORD.findall(text.lower()) if text and len(langs) else []
                if words:
                    rows.append(i), held.append(words)
                    n += len(words)
                    if n >= TOGETHER:
                        close()
                        n = 0
            close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows: int = FIT_ROWS, table: int = TABLE) -> DataFrame:
    """Fit on the rows that are not held out and predict every row: doc_id, held_out, lang_pred, score. Ties go to the language that is first by code point; whole texts count however long; extra columns are ignored; repeated rows each get a row, and count as often in fitting; an empty table gives none."""
    learn = docs.where(~held_out()).select("text", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("key"))
    out = predict(docs.select("doc_id", "text"), fit(learn, rows, table))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

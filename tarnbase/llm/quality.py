"""Quality classifier by co-training two views.

The text view sees what a text is made of: shares of character classes,
repetition of words and lines, layout. The metadata view sees what is known of
the page without its text: source, language and stated length. Both are
logistic models. In each round either
model labels the rows of an unlabelled pool it is most sure of, in the
proportion of the classes, and hands them to the other's training set. Then
both views are calibrated on labelled rows kept aside, and a model of the two
calibrated log-odds scores every document.

The models are fitted on a bounded sample of the labelled rows and one of the
others (FIT_ROWS each, chosen by a hash of doc_id); features and scores cover
all documents and whole texts.
"""

from __future__ import annotations

import operator
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import forget, small_batches

#: Labelled rows that the views are fitted on, and rows of the pool, about.
FIT_ROWS = 40_000
#: Rows of either class that the sample has at least, about, if there are so many.
CLASS_ROWS = 500
ROUNDS = 5
#: Rows a view may hand over in one round, as a share of the pool.
CONFIDENT = 0.05
_SOURCES, _LANGS = 16, 8
_GROUPS = [np.frombuffer(g, np.uint8) for g in (bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".,", b"!", b"|", b"*#$%&", b"?;:'\"()-", b"<>{}[]=/\\_~^@+", bytes(range(128, 256)))]
#: Stated lengths at which the metadata view tells pages apart.
_STEPS = 50, 200, 1000, 5000, 20_000
N_TEXT = 2 * (len(_GROUPS) + 5) + 7
N_META = _SOURCES + _LANGS + len(_STEPS) + 4


def text_features(text: str | None) -> list[float]:
    """What a text is made of; all zeros but the first for a null or blank one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_TEXT
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    shares = [float(count[g].sum()) / len(raw) for g in _GROUPS]
    n, kinds = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x]
    shares += [
        sum(map(operator.eq, words, words[1:])) / n,
        kinds.most_common(1)[0][1] / n,
        1 - len(kinds) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, words)) / n,
    ]
    lengths = [len(x) for x in text.split("\n")]
    layout = [np.log1p(len(lengths)), np.log1p(max(lengths)), np.log1p(sum(lengths) / len(lengths)), sum(x < 20 for x in lengths) / len(lengths)]
    return [1.0, *shares, *np.sqrt(shares).tolist(), np.log1p(n), len(raw) / n / 10, *layout]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """What is known about the page: source and language (hashed), its stated length, and what is not known."""
    out = [0.0] * (_SOURCES + _LANGS + len(_STEPS))
    out[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % _SOURCES] = 1.0
    out[_SOURCES + zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % _LANGS] = 1.0
    n = max(n_chars or 0, 0)
    for i, least in enumerate(_STEPS):
        out[_SOURCES + _LANGS + i] = float(n >= least)
    return [*out, np.log1p(n), float(source is None), float(lang is None), float(n_chars is None)]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n = (batch.column(i).to_pylist() for i in range(1, 5))
    t = np.array([text_features(x) for x in text], np.float64).reshape(-1, N_TEXT)
    m = np.array([meta_features(*x) for x in zip(source, lang, n, strict=True)], np.float64).reshape(-1, N_META)
    return t, m


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps over chunks of rows, so that nothing of the size of the rows is copied."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        n, sums, squares = len(x), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        first = x[:1].astype(np.float64).sum(axis=0)  # differences to a row keep the variance exact
        for part in self._chunks(x):
            part -= first
            sums += part.sum(axis=0)
            squares += (part * part).sum(axis=0)
        self.mean = first + sums / n
        self.scale = np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0))
        self.scale[self.scale < 1e-9] = 1.0
        w = np.zeros(x.shape[1] + 1)
        prior = np.r_[1e-6, np.full(x.shape[1], ridge)]
        for _ in range(steps):
            g, h, at = prior * w, np.diag(prior), 0
            for part in self._chunks(x):
                z = np.c_[np.ones(len(part)), (part - self.mean) / self.scale]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g = g + z.T @ (p - y[at : at + len(part)])
                h = h + (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
                at += len(part)
            d = np.linalg.solve(h, g)
            w = w - d * min(1.0, 5 / max(1e-12, np.abs(d).max()))
            if np.abs(d).max() < 1e-7:
                break
        self.w = w
        return self

    @staticmethod
    def _chunks(x: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(x), 4096):
            yield x[i : i + 4096].astype(np.float64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        # centred per row: the same whatever rows are scored together
        out = [((part - self.mean) / self.scale * self.w[1:]).sum(axis=1) for part in self._chunks(x)]
        return np.clip(np.concatenate([*out, np.empty(0)]) + self.w[0], -30, 30)


class Anchored:
    """Logistic regression on few columns that stays near given weights unless rows say otherwise; for calibration, which often has few rows of one class."""

    def fit(self, x: np.ndarray, y: np.ndarray, centre: list[float], strength: float = 2.0, steps: int = 50) -> Anchored:
        z = np.c_[np.ones(len(x)), x]
        c = np.array(centre)
        w, prior = c.copy(), np.full(len(c), strength)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + prior * (w - c)
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(prior)
            d = np.linalg.solve(h, g)
            w = w - d * min(1.0, 2 / max(1e-12, np.abs(d).max()))
            if np.abs(d).max() < 1e-8:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x * self.w[1:]).sum(axis=1) + self.w[0], -30, 30)


class CoTrained:
    def __init__(self, text: Logistic, meta: Logistic, cal_text: Anchored, cal_meta: Anchored, joint: Anchored):
        self.text, self.meta, self.cal_text, self.cal_meta, self.joint = text, meta, cal_text, cal_meta, joint
        #: Log-odds that the sample gives to good quality beyond those of all labelled rows.
        self.excess = 0.0

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by text, by metadata, by both."""
        a = self.cal_text.logit(self.text.logit(t)[:, None])
        b = self.cal_meta.logit(self.meta.logit(m)[:, None])
        c = self.joint.logit(np.c_[a, b])
        return tuple(1 / (1 + np.exp(self.excess - x)) for x in (a, b, c))


def _exchange(views: dict[str, tuple[np.ndarray, np.ndarray]], fit: np.ndarray, y: np.ndarray, rounds: int, confident: float) -> dict[str, Logistic]:
    """Both views trained on the rows of `fit`, handing each other pseudo-labels of the pool over rounds."""
    share = y[fit].mean()
    given: dict[str, dict[int, int]] = {v: {} for v in views}  # pseudo-labels that each view was handed

    def train(v: str) -> Logistic:
        own, pool = views[v]
        rows = np.fromiter(given[v].keys(), np.int64, len(given[v]))
        labels = np.fromiter(given[v].values(), np.float64, len(given[v]))
        return Logistic().fit(np.r_[own[fit], pool[rows]], np.r_[y[fit].astype(float), labels])

    for _ in range(rounds):
        models = {v: train(v) for v in views}
        for v, other in (("t", "m"), ("m", "t")):
            s = models[v].logit(views[v][1])
            most = int(confident * len(s))
            order = np.argsort(s, kind="stable")
            sure = 1 / (1 + np.exp(-np.abs(s)))
            for i in [*order[::-1][: int(most * share)].tolist(), *order[: int(most * (1 - share))].tolist()]:
                if sure[i] >= 0.95:
                    given[other].setdefault(i, int(s[i] > 0))
    return {v: train(v) for v in views}


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT, folds: int = 3) -> CoTrained | None:
    """Labelled rows (both views, y in 0, 1) and an unlabelled pool to a model; None without rows of both classes. Calibration uses log-odds that models of the other folds gave."""
    if len(y) < 8 or min(np.bincount(y, minlength=2)[:2]) < 2:
        return None
    views = {"t": (t, pool_t), "m": (m, pool_m)}
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        rows = np.flatnonzero(y == c)
        fold[rows] = np.arange(len(rows)) % folds
    out = {v: np.zeros(len(y)) for v in views}
    for k in range(folds):
        rest = fold != k
        if len(np.unique(y[rest])) < 2:
            continue
        models = _exchange(views, rest, y, rounds, confident)
        for v in views:
            out[v][~rest] = models[v].logit(views[v][0][~rest])
    whole = _exchange(views, np.ones(len(y), bool), y, rounds, confident)
    yf = y.astype(float)
    cal = {v: Anchored().fit(out[v][:, None], yf, [0.0, 1.0]) for v in views}
    prior = float(np.log((yf.sum() + 1) / (len(yf) - yf.sum() + 1)))
    both = np.c_[cal["t"].logit(out["t"][:, None]), cal["m"].logit(out["m"][:, None])]
    joint = Anchored().fit(both, yf, [-prior, 1.0, 1.0])
    return CoTrained(whole["t"], whole["m"], cal["t"], cal["m"], joint)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        v = np.concatenate(_views(batch), axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "v"])


def _stacked(t: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """Both views of the rows, and their column y if they have one; they come as Arrow, not as rows of Python objects."""
    got = t.toArrow()
    chunks = [np.frombuffer(c.buffers()[2], np.uint8)[_offset(c, 0) : _offset(c, len(c))] for c in got["v"].chunks if len(c)] if len(got) else []
    v = np.concatenate([*chunks, np.empty(0, np.uint8)]).view(np.float32).reshape(-1, N_TEXT + N_META)
    return v[:, :N_TEXT], v[:, N_TEXT:], got["y"].to_pylist() if "y" in got.column_names else []


def _offset(c: pa.Array, i: int) -> int:
    return int(np.frombuffer(c.buffers()[1], np.int32 if pa.types.is_binary(c.type) else np.int64)[c.offset + i])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> CoTrained | None:
    """labels: doc_id, quality (1 good, 0 bad, null unknown; the lowest counts where a document has several). None if documents of a class have no labels to speak of."""
    small_batches(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    cols += [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    docs = docs.select(*cols)
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id", "left").groupBy("y").count().collect()}
    n = {y: sizes.get(y, 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None
    # one rate for both classes, unless that leaves too few of one
    rate = {y: min(1.0, max(rows / (n[0] + n[1]), CLASS_ROWS / n[y])) for y in n}
    drawn = lambda rate, key=F.col("doc_id").cast("string"): F.abs(F.xxhash64(key) % 1_000_003) < F.lit(1_000_003) * rate
    views = lambda t: t.mapInArrow(_packed, "doc_id long, v binary")
    mine = known.where(drawn(F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))).join(docs.select("doc_id").distinct(), "doc_id")
    # as many as `rows` and CLASS_ROWS allow, so they can be with every task
    t, m, y = _stacked(views(docs.join(F.broadcast(mine), "doc_id", "left_semi")).join(F.broadcast(mine), "doc_id").select("doc_id", "y", "v").orderBy("doc_id", "v"))
    pool_t, pool_m = t[:0], m[:0]
    if sizes.get(None):
        pool = docs.where(drawn(F.lit(min(1.0, rows / sizes[None])), F.coalesce(F.col("doc_id").cast("string"), "text"))).join(known, "doc_id", "left_anti")
        pool_t, pool_m, _ = _stacked(views(pool).orderBy("doc_id", "v"))
    model = co_train(t, m, np.array(y, int), pool_t, pool_m)
    if model is not None:
        model.excess = float(np.log(rate[1] / rate[0]))
    return model


_SCORES = "text_score double, meta_score double, score double"


def scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep of every row.

    score is the probability of good quality; rows under `least` are not kept.
    A null or blank text has the features of an empty one, and columns that
    are null or missing those of unknown values; whole texts count however
    long. Where the labels lack a class, nothing can be fitted: scores and keep
    are null. An empty table gives no rows; rows that repeat a document each
    get the same score, and all teach if it is labelled; equal features score
    alike; extra columns are ignored.
    """
    model = fit(docs, labels, rows)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")), F.lit(None).cast("boolean").alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out = shared.value.score(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(x, 9)) for x in out)], names=["doc_id", "text_score", "meta_score", "score"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    cols += [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    small_batches(docs.sparkSession)
    return docs.select(*cols).mapInArrow(run, "doc_id long, " + _SCORES).withColumn("keep", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps; all columns stay, whatever their names. Rows are scored in place, so nothing is shuffled or joined. Where the labels lack a class, nothing can be fitted, so nothing is rejected, and a warning says so; else as scores."""
    model = fit(docs, labels, rows)
    if model is None:
        warnings.warn("the labels lack a class: no quality model was fitted and no document is rejected", stacklevel=2)
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nulls = pa.nulls(batch.num_rows)
            view = pa.RecordBatch.from_arrays([batch.column(names.index(c)) if c in names else nulls for c in ("doc_id", "text", "source", "lang", "n_chars")], names=["doc_id", "text", "source", "lang", "n_chars"])
            yield batch.filter(pa.array(shared.value.score(*_views(view))[2] >= least))

    return docs.mapInArrow(run, docs.schema)

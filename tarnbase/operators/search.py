"""Retrieval: BM25, vectors, both together, re-ranking.

Documents are tokenised in one pass over all fields. Only terms that a query
has leave that pass, as a document's counts of them; document frequencies and
lengths are aggregated from its rows, so nothing is computed while a query is
planned. Vectors meet their queries in blocks of bounded size, by matrix
products; keywords are found by one automaton over each text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.functions.lineage import cut
from tarnbase.functions.similarity import cosine
from tarnbase.functions.text import text

K1, B = 1.2, 0.75
#: Weights of the fields, and what the lesser fields add to the best.
FIELD_WEIGHTS = {"title": 2.0, "content": 1.5}
SYNONYM_WEIGHT, TIE = 1.8, 0.3
#: Fixed value: scores of pages are divided by this and cut at 1.
PAGE_SCALE = 5.0
TOKEN = r"[\p{L}\p{N}]+"
#: Vectors and queries of a block of products.
VECTORS, QUERIES = 16_384, 1_024
#: Keywords of an automaton; more are looked for in further passes.
KEYWORDS = 200_000
#: Query terms that are sent to every task; beyond, terms meet by a shuffle.
TERMS = 500_000


def tokens(x: Column | str) -> Column:
    """Lower-case runs of letters and digits; ideographs one by one."""
    return F.regexp_extract_all(F.lower(text(x)), F.lit(r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"), F.lit(0))


def postings(docs: DataFrame, key: str, field: Column | str, name: str) -> DataFrame:
    """(field, id, len, term, tf) of one field."""
    t = docs.select(F.col(key).alias("id"), tokens(field).alias("t")).where(F.size("t") > 0)
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf")).withColumn("field", F.lit(name))


def field_scores(docs: DataFrame, key: str, fields: dict[str, Column | str], queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, field, score): BM25 of every document that shares a term with a query. queries: qid, text; repeated terms of a query count once each time."""
    q = cut(queries.select("qid", F.explode(tokens("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    wanted = q.select("term").distinct()
    # one pass: a row for each field of a document, with its length and its terms
    t = docs.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), tokens(c).alias("t")) for n, c in fields.items()])).alias("f")).select("id", "f.field", "f.t").where(F.size("t") > 0)
    stats = F.broadcast(t.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg")))  # one row for each field
    few = wanted.limit(TERMS + 1).count() <= TERMS
    p = t.select("id", "field", F.size("t").alias("len"), F.explode("t").alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    p = cut(p.groupBy("id", "field", "len", "term").agg(F.count("*").alias("tf")))
    df = p.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg"))) * F.col("qtf")
    # a query's terms with their weights are few rows a term: they go to the postings, not the postings of a frequent term to one task
    terms = q.join(df, "term").join(stats, "field").select("field", "term", "qid", "qtf", "df", "n", "avg")
    s = p.join(F.broadcast(terms) if few and terms.count() <= TERMS else terms, ["field", "term"])
    return s.groupBy("qid", "id", "field").agg(F.sum(w).alias("score"))


def bm25(docs: DataFrame, key: str, fields: dict[str, tuple[Column | str, float]], queries: DataFrame, tie: float = TIE) -> DataFrame:
    """(qid, id, score): the best weighted field plus `tie` times the others. fields: name to (column, weight)."""
    s = field_scores(docs, key, {n: c for n, (c, _) in fields.items()}, queries)
    weight = F.lit(0.0)
    for n, (_, w) in fields.items():
        weight = F.when(F.col("field") == n, w).otherwise(weight)
    s = s.withColumn("w", F.col("score") * weight)
    return s.groupBy("qid", "id").agg((F.max("w") + tie * (F.sum("w") - F.max("w"))).alias("score"))


def top(hits: DataFrame, k: int, by: str = "score", per: str = "qid", tie: str = "id") -> DataFrame:
    """The best k of each query; ties to the smaller id."""
    w = Window.partitionBy(per).orderBy(F.desc(by), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosines(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, places: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """(qid, id, cosine) of every query with every vector (of the same values of `by`, columns of both), in blocks: the k best of each query in each block (so the best k of all are among them), or those from `least` up. vectors: id, vec; queries: qid, qvec. Cosines are rounded to `places`; a zero vector scores 0, missing vectors and those of other lengths are not compared."""
    if k is None and least is None:
        raise ValueError("either k or least must bound what a block returns")
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("v"), *by).where("size(v) > 0")
    q = queries.select("qid", F.col("qvec").cast("array<double>").alias("v"), *by).where("size(v) > 0")
    # as many blocks as the largest group needs
    nv, nq = (max(1, -(-(t.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) // n)) for t, n in ((v, VECTORS), (q, QUERIES)))
    dim = F.size("v").alias("dim")
    left = v.select(F.lit(0).alias("side"), F.col("id").cast("string").alias("key"), "v", dim, *by, F.expr(f"cast(pmod(xxhash64(id), {nv}) as int)").alias("bv"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"))
    right = q.select(F.lit(1).alias("side"), F.col("qid").cast("string").alias("key"), "v", dim, *by, F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("bv"), F.expr(f"cast(pmod(xxhash64(qid), {nq}) as int)").alias("bq"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"qid": [], "id": [], "cosine": []}).astype({"qid": str, "id": str})
        x, y = (np.stack(t["v"].to_numpy()).astype(np.float64) for t in (a, b))
        x, y = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m, n in ((m, np.linalg.norm(m, axis=1, keepdims=True)) for m in (x, y)))
        s = np.round(y @ x.T, places) + 0.0
        keep = np.ones(s.shape, bool) if least is None else s >= least
        if k is not None and s.shape[1] > k:  # ties of the k-th stay: which of them is last is decided by the id
            keep &= s >= np.partition(s, -k, axis=1)[:, -k][:, None]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"qid": b["key"].to_numpy()[i], "id": a["key"].to_numpy()[j], "cosine": s[i, j]})

    got = left.unionByName(right).groupBy(*by, "bv", "bq", "dim").applyInPandas(block, "qid string, id string, cosine double")
    return got.select(F.col("qid").cast(queries.schema["qid"].dataType), F.col("id").cast(vectors.schema["id"].dataType), "cosine")


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vec: str = "vec", least: float | None = None) -> DataFrame:
    """(qid, id, cosine, rank): exact nearest by cosine. queries: qid, qvec."""
    t = cosines(vectors.select(F.col(key).alias("id"), F.col(vec).alias("vec")), queries, k, least)
    return top(t, k, "cosine").select("qid", "id", "cosine", "rank")


def nested_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vecs: str = "vecs") -> DataFrame:
    """As knn, over documents with several vectors: the best counts. Of each query the k best documents are among its k * n best vectors, n being the most that a document has."""
    flat = vectors.select(F.col(key).alias("id"), F.explode(vecs).alias("vec"))
    n = vectors.agg(F.max(F.size(vecs))).first()[0] or 1
    t = cosines(flat, queries, k * n).groupBy("qid", "id").agg(F.max("cosine").alias("cosine"))
    return top(t, k, "cosine").select("qid", "id", "cosine", "rank")


def candidates(k: int) -> int:
    """How many candidates an engine looks at for k neighbours."""
    return max(k, 10 * k, 100)


def dual(bm25_hits: DataFrame, knn_hits: DataFrame, size: int, mode: str = "dual") -> DataFrame:
    """Hits of both routes: each fills half of the size; a document that both found counts for the first route and keeps both scores. mode: dual, bm25, vector, or single (scores summed)."""
    if mode == "single":
        t = bm25_hits.select("qid", "id", F.col("score").alias("bm25"), F.lit(None).cast("double").alias("cosine")).unionByName(knn_hits.select("qid", "id", F.lit(None).cast("double").alias("bm25"), "cosine"))
        t = t.groupBy("qid", "id").agg(F.max("bm25").alias("bm25"), F.max("cosine").alias("cosine"))
        return top(t.withColumn("score", F.coalesce("bm25", F.lit(0.0)) + F.coalesce((1 + F.col("cosine")) / 2, F.lit(0.0))), size)
    half = max(1, size // 2)
    a = top(bm25_hits, size if mode == "bm25" else half).select("qid", "id", F.col("score").alias("bm25"), F.lit(None).cast("double").alias("cosine"), F.lit(0).alias("route"), "rank")
    b = top(knn_hits.drop("rank"), size if mode == "vector" else half, "cosine").select("qid", "id", F.lit(None).cast("double").alias("bm25"), "cosine", F.lit(1).alias("route"), "rank")
    both = a if mode == "bm25" else b if mode == "vector" else a.unionByName(b)
    return both.groupBy("qid", "id").agg(F.max("bm25").alias("bm25"), F.max("cosine").alias("cosine"), F.min("route").alias("route"), F.min_by("rank", "route").alias("rank"))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Half of the places by keywords, then vectors, without repeats, cut at k. Both: qid, id, rank."""
    half = max(1, k // 2)
    both = keyword.where(F.col("rank") <= half).select("qid", "id", F.lit(0).alias("route"), "rank").unionByName(vector.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("route"), "rank"))
    first = both.groupBy("qid", "id").agg(F.min(F.struct("route", "rank")).alias("p"))
    w = Window.partitionBy("qid").orderBy("p.route", "p.rank", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("qid", "id", "place")


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, kw, titled): the different keywords that stand anywhere in a text, and whether in its title. texts: id, t (title), h (all); keywords: kw. Each text is read once for KEYWORDS keywords."""
    import ahocorasick

    kinds = f"id {texts.schema['id'].dataType.simpleString()}, kw string, titled boolean"
    kw = cut(keywords.select("kw").where("kw <> ''").distinct())
    passes = max(1, -(-kw.count() // KEYWORDS))
    out = None
    for i in range(passes):
        some = [r["kw"] for r in kw.where(F.expr(f"pmod(xxhash64(kw), {passes}) = {i}")).toLocalIterator()]  # about KEYWORDS of them

        def run(batches: Iterator[pa.RecordBatch], some: list[str] = some) -> Iterator[pa.RecordBatch]:
            find = ahocorasick.Automaton()
            for w in some:
                find.add_word(w, w)
            if some:
                find.make_automaton()
            for batch in batches:
                ids, hit, titled = [], [], []
                for n, (t, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found = {w for _, w in find.iter(h)} if some and h else set()
                    ids += [n] * len(found)
                    hit += sorted(found)
                    titled += [w in (t or "") for w in sorted(found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(hit, pa.string()), pa.array(titled, pa.bool_())], names=["id", "kw", "titled"])

        part = texts.select("id", "t", "h").mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def keyword_recall(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by keywords found in a chunk, twice more for those in its title. chunks: id, title, text; queries: qid, keywords (array)."""
    q = queries.select("qid", F.explode(F.array_distinct("keywords")).alias("kw"))
    t = chunks.select("id", F.lower(text("title")).alias("t"), F.lower(F.concat_ws(" ", "title", "text")).alias("h"))
    t = keyword_hits(t, q).join(q, "kw").groupBy("qid", "id").agg((F.count("*") + 2 * F.count_if("titled")).alias("score"))
    return top(t, k)


def expand_keywords(query: Column | str, terms: dict[str, list[str]]) -> Column:
    """Keywords of a query: translations of the terms in it, then its own words; distinct, in order."""
    low = F.lower(text(query))
    own = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9_\-]+"), F.lit(0))
    found = [F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in terms.items()]
    return F.array_distinct(F.concat(*found, own)) if found else F.array_distinct(own)


def best_over_queries(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Several queries as one: each document's best score, the best k."""
    t = hits.groupBy("id").agg(F.max(score).alias("score"), F.max_by("qid", F.struct(score, -F.col("qid"))).alias("best_qid"))
    return t.orderBy(F.desc("score"), "id").limit(k)


def page_score(score: Column | str) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.least(c / PAGE_SCALE, F.lit(1.0))


def rerank(hits: DataFrame, threshold: float, k: int, score: str = "similarity") -> DataFrame:
    """Hits above a threshold (-1 lets all pass), the best k of each query."""
    t = hits.where(F.col(score) > threshold) if threshold > -1 else hits
    return top(t, k, score)


def fill_vectors(target: Column, other: Column) -> Column:
    """Index entries (text, embedding) with missing vectors filled from another copy by text."""
    known = F.map_from_entries(F.transform(F.filter(other, lambda i: i["embedding"].isNotNull()), lambda i: F.struct(i["text"], i["embedding"])))
    return F.transform(target, lambda i: F.struct(i["text"].alias("text"), F.coalesce(i["embedding"], F.try_element_at(known, i["text"])).alias("embedding")))


def keyword_scores(df: DataFrame, key: str, col: Column | str) -> DataFrame:
    """(id, term, score): term frequency by inverse document frequency, scaled to 0..1 in each document (1 if all are equal)."""
    p = postings(df, key, col, "f")
    n = df.count()
    d = p.groupBy("term").agg(F.count("*").alias("df"))
    s = p.join(d, "term").withColumn("s", F.col("tf") / F.col("len") * F.log(F.lit(float(n + 1)) / F.col("df")))
    w = Window.partitionBy("id")
    lo, hi = F.min("s").over(w), F.max("s").over(w)
    return s.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("s") - lo) / (hi - lo))).select("id", "term", "score")


def merge_keywords(title: DataFrame, content: DataFrame, k: int = 5, title_weight: float = 0.7, content_weight: float = 0.3, strong: float = 0.8) -> DataFrame:
    """Keywords of a document: weighted sums over both fields; those from `strong` up first, then the next best, k in all."""
    both = title.withColumn("w", F.col("score") * title_weight).unionByName(content.withColumn("w", F.col("score") * content_weight)).groupBy("id", "term").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("id").orderBy((F.col("score") >= strong).desc(), F.desc("score"), "term")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""The operators over the driver's tables: one thin query each, with production parameters, over whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbase.llm import ann, langid, lmscore, mixing, neardup, packing, pii, quality, sharding, vectordedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sharding.kd_shards(_table(spark, sf_dir, "documents"), depth=3)
    return t.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_masked_pll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op6_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=75, width=5)


def op7_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("source", "start")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_sanitisation,
        op2_kd_sharding,
        op3_quality_cotraining,
        op4_embedding_dedup,
        op5_masked_pll,
        op6_minhash_odd_sketch,
        op7_projection_neighbours,
        op8_language_id,
        op9_best_fit_packing,
        op10_source_mixing,
        pipeline,
    )
}

#: The schedule's points mapped through the sources' shares, ranked by source; a slot takes the block of its rank, a second time around beyond the line's length.
_MIX = r"""WITH s AS (SELECT row_number() OVER () AS row, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
 w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM z),
 r AS (SELECT *, 2.0 * source_size AS cap, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest, 1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER o, 0) AS left_ FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT arg_min(left_ / rest, cap / weight) AS level FROM r WHERE cap >= left_ / rest * weight),
 g AS (SELECT source, source_size, CAST(least(cap, coalesce(level * weight, cap)) AS DOUBLE) AS target FROM r LEFT JOIN l ON true),
 g2 AS (SELECT *, CAST(round(target) AS BIGINT) AS words, (source_size + 4095) // 4096 AS nb, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS full_ FROM g),
 g3 AS (SELECT *, full_ * nb + (words - full_ * source_size + 4095) // 4096 AS slots FROM g2),
 total AS (SELECT CAST(sum(slots) AS BIGINT) AS total, count(*) AS n FROM g3 WHERE slots > 0),
 c AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source NULLS LAST) AS DOUBLE) / CAST(total AS DOUBLE) AS hi, CAST(floor(total * CAST(1.02 AS DOUBLE)) AS BIGINT) + 16 * n + 16 AS points FROM g3, total WHERE slots > 0),
 c2 AS (SELECT *, hi - CAST(slots AS DOUBLE) / CAST(total AS DOUBLE) AS lo FROM c),
 u AS (SELECT i, (CAST(i AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.6180339887498949 AS DOUBLE) AS x FROM (SELECT unnest(range((SELECT coalesce(max(points), 0) FROM c))) AS i)),
 hit AS (SELECT c2.source, c2.slots, c2.points, u.i, row_number() OVER (PARTITION BY c2.source ORDER BY u.i) - 1 AS rank FROM u JOIN c2 ON u.x - floor(u.x) >= c2.lo AND u.x - floor(u.x) < c2.hi),
 have AS (SELECT c.source, c.slots, c.points, count(hit.i) AS k FROM c LEFT JOIN hit ON hit.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
 slot AS (SELECT source, rank, i AS place FROM hit WHERE rank < slots UNION ALL SELECT source, unnest(range(k, slots)), unnest(range(k, slots)) + points FROM have WHERE k < slots),
 slot2 AS (SELECT slot.source, slot.place, g3.source_size, slot.rank % g3.nb AS block, least(least((slot.rank % g3.nb + 1) * 4096, g3.source_size), g3.words - slot.rank // g3.nb * g3.source_size) AS upto FROM slot JOIN g3 ON slot.source IS NOT DISTINCT FROM g3.source),
 p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s),
 held AS (SELECT row, source, start, size, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS block FROM p WHERE size > 0),
 part AS (SELECT held.row, slot2.place, least(held.start + held.size, slot2.upto) - greatest(held.start, held.block * 4096) AS words FROM held JOIN slot2 ON held.source IS NOT DISTINCT FROM slot2.source AND held.block = slot2.block),
 got AS (SELECT row, CAST(sum(words) AS BIGINT) AS taken, min(place) AS first_slot FROM part WHERE words > 0 GROUP BY 1)
 SELECT p.doc_id, p.size, g3.source_size, g3.target, coalesce(got.taken, 0) AS taken, got.first_slot FROM p JOIN g3 ON p.source IS NOT DISTINCT FROM g3.source LEFT JOIN got ON got.row = p.row"""
#: All pairs, and what they reach.
_VECTORS = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95), r AS (SELECT a AS n, b AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a), c AS (SELECT n, min(m) AS m FROM r GROUP BY 1)
 SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept FROM e LEFT JOIN c ON c.n = e.vec_id"""
#: All pairs that share a shingle, and what they reach.
_TEXTS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(10)) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT a AS n, b AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), c AS (SELECT n, min(m) AS m FROM r GROUP BY 1)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.n = w.doc_id"""

ORACLES: dict[str, str] = {"op4_embedding_dedup": _VECTORS, "op6_minhash_odd_sketch": _TEXTS, "op10_source_mixing": _MIX}

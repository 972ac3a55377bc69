"""Names that clash, nulls in any column, repeats, hot groups, empty tables: each has the result that the docstrings state."""

import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbase.llm import ann, common, langid, mixing, neardup, packing, pii, quality, sharding, vectordedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = "d row th rx told base spans x y at start turn words size sk bucket gone key node piece part item shard slot v id cell links hot s l w h n taken target m z p o c k a".split()


def wide(spark, rows):
    t = spark.createDataFrame(rows, DOCS)
    return t.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


def odd_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60))), "en", f"s{i % 3}", 9) for i in range(60)]
    rows += [(100, None, "en", "s0", 0), (101, "", None, None, None), (None, "null id mail x@y.zz", "de", "s1", 3), (102, "x" * 100_000 + " a@b.co", "en", "s2", 1), (103, "   \n", "fr", None, -1)]
    return rows + [rows[0], rows[0], rows[5]]


def stages(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    return {
        "quality": lambda t: quality.keep_good(t, labels, least=0.0),
        "neardup": neardup.drop_near_duplicates,
        "pii": pii.sanitise,
        "mixing": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["quality", "neardup", "pii", "mixing"])
def test_stage_keeps_all_columns(spark, name):
    t = wide(spark, odd_rows())
    out = stages(spark)[name](t)
    assert out.columns == t.columns and [f.dataType for f in out.schema] == [f.dataType for f in t.schema]
    got = out.collect()
    assert got and all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASH)
    assert stages(spark)[name](t.limit(0)).count() == 0
    ids = Counter(r["doc_id"] for r in got)
    if name in ("quality", "pii"):
        assert ids == Counter(r[0] for r in odd_rows())
    if name == "neardup":
        assert ids[0] == 3 and ids[5] == 2 and ids[None] == 1
    if name == "pii":
        by = {r["doc_id"]: r["text"] for r in got}
        assert by[100] is None and by[101] == "" and by[102] == "x" * 100_000 + " [EMAIL]" and by[None] == "null id mail [EMAIL]"
    if name == "mixing":
        assert not {100, 101, 103} & set(ids)


@pytest.mark.parametrize("column", ["doc_id", "text", "lang", "source", "n_chars"])
def test_operators_take_a_column_of_nulls(spark, column):
    t = wide(spark, odd_rows()).withColumn(column, F.lit(None).cast(dict(x.split() for x in DOCS.split(", "))[column]))
    n = t.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert pii.digest(t).count() == n and sharding.kd_shards(t).count() == n and mixing.mixture(t).count() == n
    assert langid.identify(t).count() == n and quality.scores(t, labels).count() == n and neardup.near_duplicates(t).count() == n
    for step in stages(spark).values():
        if column != "doc_id":
            step(t).count()


def test_sanitise_folds_long_arrays(spark):
    """More spans than are folded in one array, and overlapping ones."""
    text = " ".join(f"mail a{i}@b.co and 10.0.0.{i % 256}@c.de" for i in range(700))
    got = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    want = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    assert got == want
    spans = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert spans["n_email"] == 1400 and spans["n_ip"] == 700


def test_contexts_hold_whole_words(spark):
    """Long words around an entity are not cut: the eighth word still discloses, the ninth does not."""
    long = [f"{'y' * 60}{i}" for i in range(7)]
    texts = [f"ninthword{i} Eighthword " + " ".join(w + str(i) for w in long) + f" bob@x.org tail{i}" for i in range(6)]
    texts += [f"other{i} text{i} here{i}" for i in range(100)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i]["n_term"] == 1 and "term:11:21" in got[i]["spans"] for i in range(6))


def test_large_sets_at_the_threshold_link():
    """Sets of so many members that 32 bits of them would collide."""
    rng = np.random.default_rng(5)
    for _ in range(3):
        both = rng.integers(0, 2**63, 120_000, dtype=np.uint64)
        own = [rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, x])) for x in own]
        assert 100 * 120_000 == 75 * 160_000
        assert neardup._alike(sets, np.array([0]), np.array([1]), 75)[0]


def test_repeated_ids_keep_all_links(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choices([f"{p}{i}" for i in range(500)], k=50)) for p in "ab")
    rows = [(1, a), (2, a), (5, a), (5, b), (9, b), (9, None), (20, "one two three")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a row without words stays alone
    assert {k[0]: v for k, v in got.items() if k[1]} == {1: 1, 2: 1, 5: 1, 9: 1, 20: 20} and got[9, 0] == 9


def test_ids_beyond_the_filter_are_joined(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEWEST", 1 << 40)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(40)] + [" ".join(rng.choices(base, k=60)) for _ in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[i] for i in range(40)} == {0}


def shuffled(spark):
    """Names of the shuffle files that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if str(files.apply(i).getName()).startswith("shuffle_")}


def test_near_duplicates_leave_no_shuffle_files_and_sets(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:k], f"e{k}", *words[k + 1 :]]) for k in range(20)] + ["alone among the others, of other words"] * 2 + [None]
    # the last row repeats an id and its text
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    before, tables, was = shuffled(spark), Path(common.shared_folder(spark), "tarnbase"), spark.conf.get(common.CLEANUP)
    there = set(os.listdir(tables)) if tables.exists() else set()
    got = neardup.near_duplicates(docs)
    for _ in range(50):  # executors remove files in their own time
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    made = {x.rpartition("-")[0] for x in set(os.listdir(tables)) - there}
    assert "meta" in made and not made & {"reps", "sets", "more_sets"}
    assert spark.conf.get(common.CLEANUP) == was
    want = sorted([(k, 0) for k in range(20)] + [(20, 20), (21, 20), (22, 22), (0, 0)])
    for _ in range(2):
        assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == want


def test_repeated_vectors_are_one(spark):
    v, w = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    t = spark.createDataFrame([(1, v), (1, v), (2, w), (3, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = vectordedup.near_vectors(t).collect()
    assert len(got) == 4 and {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_numerals_are_no_letters(spark):
    t = spark.createDataFrame([(i, "the house and the garden", "en") for i in range(40)] + [(100, "½ ² Ⅷ ① 12", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(t).collect()}
    assert (got[100]["lang_pred"], got[100]["score"]) == ("und", 0.0) and got[1]["lang_pred"] == "en"


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 20)
    edges = [(5, 100 + i) for i in range(60)] + [(100 + i, 1000 + i) for i in range(60)] + [(3, 1000), (7, 8)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{x: 3 for e in edges[:-1] for x in e}, 7: 7, 8: 7}


def test_group_that_is_hot_by_rows_is_split(spark):
    rows = [(i, None if i % 3 else "", "en", "s", 0) for i in range(900)] + [(1000 + i, "t" * 400 + str(i), "de", "r", 0) for i in range(80)]
    got = sharding.kd_shards(spark.createDataFrame(rows, DOCS)).collect()
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert len(got) == 980 and len(size) == 8 and all(abs(s - mean) < 0.1 * mean for s in size.values())
    assert all(r["text_crc32"] == zlib.crc32(b"") for r in got if r["doc_id"] < 900)


def test_leaves_reach_the_target(spark):
    rows = [(i, "x" * (50 + i % 70), "en", f"s{i % 4}", 0) for i in range(300)]
    t = spark.createDataFrame(rows, DOCS)
    total = sum(len(r[1]) + 1 for r in rows)
    for target in (total, total // 3, total // 10):
        got = defaultdict(int)
        for r in sharding.kd_shards(t, target_bytes=target).collect():
            got[r["shard"]] += r["size"]
        assert max(got.values()) <= 1.1 * target


def test_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.standard_normal((2000, 32))
    x[7] = x[6]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(t, k=10, every=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hit = 0
    for q, ids in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(ids) & set(np.lexsort((np.arange(2000), d))[:10].tolist()))
    assert len(got) == 100 and hit >= 0.97 * 1000


def test_hot_vector_as_queries(spark):
    t = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(1, 4000)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(t, k=3, every=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert len(got) == 1999 and got[4] == [(1, 0.0), (2, 0.0), (5, 0.0)] and got[2] == [(1, 0.0), (4, 0.0), (5, 0.0)]


def test_quality_of_labels_held_out_of_the_fit(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    mine = lab.where("doc_id % 3 <> 0")
    kept = {r["doc_id"] for r in quality.keep_good(d, mine).collect()}
    rest = [(r["doc_id"], r["quality"]) for r in lab.where("doc_id % 3 = 0").collect()]
    assert len(rest) > 10 and sum((i in kept) == bool(q) for i, q in rest) >= 0.9 * len(rest)


def test_exchange_against_a_plain_version():
    """What each view is handed over the rounds, by sorting lists of rows."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    t, m = y[:, None] + 0.5 * rng.standard_normal((200, 3)), y[:, None] + 0.5 * rng.standard_normal((200, 2))
    z = rng.integers(0, 2, 400)
    pt, pm = z[:, None] + 0.5 * rng.standard_normal((400, 3)), z[:, None] + 0.5 * rng.standard_normal((400, 2))
    got = quality._exchange({"t": (t, pt), "m": (m, pm)}, np.ones(200, bool), y, 3, 0.1)
    given = {"t": {}, "m": {}}
    own, pool = {"t": t, "m": m}, {"t": pt, "m": pm}
    fit = lambda v: quality.Logistic().fit(np.array([*own[v], *[pool[v][i] for i in given[v]]]), np.array([*y.astype(float), *given[v].values()]))
    share = y.mean()
    for _ in range(3):
        models = {v: fit(v) for v in "tm"}
        for v, other in (("t", "m"), ("m", "t")):
            s = models[v].logit(pool[v])
            order = sorted(range(400), key=lambda i: s[i])
            best = [*order[::-1][: int(40 * share)], *order[: int(40 * (1 - share))]]
            for i in best:
                if abs(s[i]) >= np.log(19) and i not in given[other]:
                    given[other][i] = float(s[i] > 0)
    assert all(got[v].w == pytest.approx(fit(v).w) for v in "tm") and len(given["t"]) > 20


def test_scratch_removes_what_is_staged_inside(spark):
    with common.scratch(spark):
        gone = common.stage(spark.range(3), "a")
        kept = common.stage(spark.range(4), "b", keep=True)
    assert kept.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_packing_deals_loose_pieces_again(spark):
    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(0)
    texts = ["word " * rng.randint(1, 3000) for _ in range(120)] + [None, ""]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "size", "bin", "g")})
    bins = defaultdict(int)
    for r in packing.packed(t, tokenizer, group=20).collect():
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 4

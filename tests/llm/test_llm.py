"""Each operator against a brute-force version on small fixtures, with nulls, empty and odd texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbase.llm import ann, langid, mixing, neardup, packing, pii, quality, sharding, vectordedup
from tarnbase.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("x"), "shard": F.lit(9), "taken": F.lit(-1), "id": F.lit(0), "key": F.lit("k"), "base": F.lit(1), "spans": F.lit(2)})


def some_texts(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 80))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies of an earlier text
        w = out[i].split()
        w[len(w) // 2] = "edited"
        out.append(" ".join(w))
    return [*out, out[0], out[0].upper(), None, "", " \t\n", "a b", "A\vb", "é" * 10, "x " * 5000]


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- components ------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    f = Forest(range(2000))
    for a, b in edges:
        if a is not None and a != b:
            f.link(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: f.find(n) for n in {x for a, b in edges for x in (a, b) if a is not None and a != b}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 6: near-duplicates ------------------------------------------------------

def brute_components(texts, percent=75, width=5):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    f = Forest(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                f.link(i, j)
    return [len(s) for s in sets], [f.find(i) for i in range(len(sets))]


def test_near_duplicates(spark):
    texts = some_texts()
    n, comp = brute_components(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_in_large_buckets(spark):
    """More near copies than a block holds, some of which only others reach."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(330):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    _, comp = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_near_copies_are_sent_once_for_a_bucket(spark, monkeypatch):
    """Short texts of 10 groups that don't link with each other: a row of a large bucket is not sent for each 256 others."""
    sizes, plain = {}, neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, name: sizes.setdefault(name, plain(df, name)))
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[: 7 + 5 * (k % 10)], f"e{k}", *base[8 + 5 * (k % 10) :]]) for k in range(600)]
    _, comp = brute_components(texts)
    assert len(set(comp)) == 10
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    assert sizes["mixed"].agg(F.max("c")).first()[0] > 256
    assert 0 < sizes["large"].count() == sizes["large"].select("key", "doc").distinct().count()


def test_alike_by_products_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(np.r_[rng.choice(60, 50, replace=False), rng.integers(10**6, 10**9, rng.integers(0, 12))]).astype(np.uint64) for _ in range(90)]
    i, j = np.triu_indices(len(sets), 1)
    want = [100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert 0 < sum(want) < len(want)
    for step in (0, 10**9):
        monkeypatch.setattr(neardup, "STEP", step)
        assert neardup._alike(sets, i, j, 75).tolist() == want


def test_near_duplicates_empty_and_dropping(spark):
    assert neardup.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    texts = some_texts(1, 12)
    _, comp = brute_components(texts)
    d = docs_of(spark, texts)
    kept = neardup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp))


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a, b = neardup._seeds(neardup.SAMPLES)
    with np.errstate(over="ignore"):
        for j, near in ((0.75, True), (0.95, True), (0.1, False)):
            for _ in range(20):
                common = rng.integers(0, 2**63, int(1000 * j), dtype=np.uint64)
                own = [rng.integers(0, 2**63, (1000 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
                s = [neardup.odd_sketch(neardup.signature(np.unique(np.concatenate([common, o])), a, b)) for o in own]
                assert (int(np.bitwise_count(s[0] ^ s[1]).sum()) <= neardup.sketch_cut(0.75)) == near


# -- 1: sanitisation ---------------------------------------------------------

def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_personal_data(spark):
    rng = random.Random(5)
    texts = ["a@b.c_d@e.f x@y x@y..z", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 10.0.0.1", "4111 1111-1111 1111 4111111111111111 4111  1111 1111 1111", "+1 (415) 555-2671, +12 34 +5+441234567890", "é😀 me@x.io 😀 10.0.0.1", "1 " * 30000, "a" * 50000 + "@b.c", "x@" + "a." * 9000 + "b", None, ""]
    texts += ["".join(rng.choice("1+.@ -a(4é") for _ in range(60)) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.digest(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(brute_spans(t).encode()).hexdigest(), (i, (t or "")[:80])
        assert got[i]["spans"] == brute_spans(t)
    assert pii.digest(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_disclosing_terms(spark):
    texts = [f"u{i}a v{i}b then Jonquil wrote bob@x.org in z{i}c" for i in range(12)] + [f"u{i}d alpha wrote then" for i in range(100)] + ["Where is Jonquil? jonquils no"]
    d = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in pii.digest(d).collect()}
    assert got[112]["spans"] == "term:9:16" and got[12]["n_term"] == 0 and got[0]["n_term"] == 1 and got[0]["n_email"] == 1
    clean = {r["doc_id"]: r for r in pii.sanitise(d).collect()}
    assert clean[112]["text"] == "Where is [TERM]? jonquils no" and clean[12]["text"] == texts[12]
    assert clean[0]["text"] == "u0a v0b then [TERM] wrote [EMAIL] in z0c" and clean[0]["n_chars"] == len(clean[0]["text"])


def test_copies_disclose_nothing(spark):
    """A passage that is copied is one context, however often."""
    texts = ["only here quixotic bob@x.org stands"] * 20 + [f"other text {i}" for i in range(30)]
    assert {r["n_term"] for r in pii.digest(docs_of(spark, texts)).collect()} == {0}


# -- 2: sharding -------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "hot", "few"])
def test_shards(spark, kind):
    rng = random.Random(2)
    texts = ["x" * rng.randint(1, 400) + str(i) for i in range(400)]
    if kind == "hot":  # a third of all bytes are one text
        texts += ["hot" * 70] * 300
    if kind == "few":
        texts = [None, "", "a", "a"]
    got = sharding.kd_shards(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if kind != "few":
        mean = sum(size.values()) / 8
        assert len(size) == 8 and all(abs(s - mean) < 0.06 * mean for s in size.values())
    if kind == "plain":
        shard = defaultdict(set)
        for r in got:
            shard[texts[r["doc_id"]]].add(r["shard"])
        assert all(len(s) == 1 for s in shard.values())


def test_shards_empty_and_repeatable(spark):
    d = docs_of(spark, [str(i) * (i % 30) for i in range(90)])
    assert sharding.kd_shards(d.limit(0)).count() == 0
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(sharding.kd_shards(d)) == key(sharding.kd_shards(d.repartition(3)))


# -- 10: mixing --------------------------------------------------------------

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("kind", ["golden", "corput"])
def test_mixture(spark, kind):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 60) for _ in range(120)] + [None, " \n"]
    d = docs_of(spark, texts)
    got = mixing.mixture(d, block=64, kind=kind).collect()
    assert len(got) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(d.repartition(5), block=64, kind=kind).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mixture(d.limit(0)).count() == 0
    # every prefix of the schedule holds the sources near their shares
    slots = defaultdict(set)
    for r in got:
        if r["taken"]:
            slots[r["source"]].add(r["first_slot"])
    places = sorted((x, s) for s, xs in slots.items() for x in xs)
    for upto in (10, 20, 40):
        seen = [s for _, s in places[:upto]]
        for s, w in want.items():
            assert abs(seen.count(s) / upto - w / sum(want.values())) < 0.2


def test_mixed_texts(spark):
    texts = [" ".join(f"d{i}w{k}" for k in range(i % 9 + 1)) for i in range(40)]
    d = docs_of(spark, texts)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mixture(d, block=8).collect()}
    out = mixing.mixed_documents(d, block=8)
    assert out.columns == d.columns
    words = defaultdict(int)
    for r in out.collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {k: v for k, v in plan.items() if v}
    # in the order of the schedule, each document's first piece at its first slot
    at = {r["doc_id"]: r["first_slot"] for r in mixing.mixture(d, block=8).collect()}
    order = list(dict.fromkeys(r["doc_id"] for r in out.collect()))
    assert [at[i] for i in order] == sorted(at[i] for i in order)


def test_schedule_spreads_sources(spark):
    t = spark.createDataFrame([("a", 50), ("b", 30), (None, 20)], "source string, slots int")
    got = sorted(mixing.schedule(t).collect(), key=lambda r: r["at"])
    assert len(got) == 100 and sum(r["source"] == "a" for r in got[:20]) in range(8, 13)


# -- 9: packing --------------------------------------------------------------

def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tk = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["Thé İst ΣΑΣ\x1cfoo <|endoftext|>x  á it's we'LL ‘’ \x85z\xa0y a　b", None, "", "word " * 9000, "½²³ ñ!! DE!!"] + ["".join(rng.choice("ab 'stÉé12,.!-\n") for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    d = docs_of(spark, texts)
    d = d.unionByName(d.where("doc_id = 4"))  # a repeated row
    got = packing.packed(d, path).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = sorted((k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096))
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert mine == (want if i != 4 else sorted(want * 2))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.packed(d.limit(0), path).count() == 0


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 4, 4, 3, 3, 2, 2])
    b = packing.pack(sizes, 10)
    assert b.max() + 1 == 3 and np.bincount(b, weights=sizes).max() <= 10
    assert packing.pack(np.array([], np.int64), 10).size == 0


@pytest.mark.parametrize("low, high, n", [(1, 60, 900), (300, 700, 240), (1, 1000, 300)])
def test_local_search_rests_only_where_no_exchange_helps(low, high, n):
    rng = np.random.default_rng(low + n)
    sizes = rng.integers(low, high, n)
    b = packing.pack(sizes, 1000)
    fill = np.bincount(b, weights=sizes).astype(int)
    assert fill.max() <= 1000 and len(fill) >= -(-sizes.sum() // 1000)
    bins = [sizes[b == k].tolist() for k in range(len(fill))]
    fewest = max(-(-sizes.sum() // 1000), (2 * sizes > 1000).sum())
    under = [k for k in range(len(fill)) if fill[k] < 1000] if len(fill) > fewest else []  # else none can be emptied
    for x in under:
        for y in under:
            if x == y:
                continue
            give = [(s,) for s in set(bins[x])] + list({tuple(sorted(p)) for p in itertools.combinations(bins[x], 2)})
            take = [()] + [(s,) for s in set(bins[y])] + list({tuple(sorted(p)) for p in itertools.combinations(bins[y], 2)})
            for g in give:
                for t in take:
                    d = sum(g) - sum(t)
                    if (len(g), len(t)) in ((1, 0), (1, 1), (2, 1), (1, 2)) and 0 < d <= 1000 - fill[y]:
                        assert d * (fill[y] - fill[x] + d) <= 0


# -- vectors -----------------------------------------------------------------

def vectors(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[(i + 1) % n] + 0.08 * rng.standard_normal(dim)
    x[50:60] = x[49]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, [1.0, 2.0]), (n + 6, [float("inf")] + [0.0] * (dim - 1))]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "cell": F.lit(3), "label": F.lit(0)})


@pytest.mark.parametrize("cells", [1, 9, None])
def test_near_vectors(spark, cells):
    x, t = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    f = Forest(range(len(x)))
    for i, j in zip(*np.nonzero(link), strict=True):
        f.link(i, j)
    got = {r["vec_id"]: r for r in vectordedup.near_vectors(t, cells=cells).collect()}
    assert len(got) == len(x) + 7
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == [f.find(i) for i in range(len(x))]
    assert all(got[len(x) + k]["n_links"] == 0 and got[len(x) + k]["kept"] for k in range(7))
    assert vectordedup.near_vectors(t.limit(0)).count() == 0


def test_crowded_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "LEFT", 64)
    monkeypatch.setattr(vectordedup, "RIGHT", 100)
    rng = np.random.default_rng(1)
    x = np.ones((300, 8)) + 0.05 * rng.standard_normal((300, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.near_vectors(t, threshold=0.995, cells=4).collect()}
    assert [got[i] for i in range(300)] == ((u @ u.T >= 0.995).sum(axis=1) - 1).tolist()


def test_cell_of_several_tasks(spark, monkeypatch):
    for name, rows in (("LEFT", 20), ("RIGHT", 30), ("SENT", 8 * 70)):
        monkeypatch.setattr(vectordedup, name, rows)
    rng = np.random.default_rng(1)
    x = np.ones((300, 8)) + 0.05 * rng.standard_normal((300, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.near_vectors(t, threshold=0.995, cells=4).collect()}
    assert [got[i] for i in range(300)] == ((u @ u.T >= 0.995).sum(axis=1) - 1).tolist()


def test_cells_only_where_they_have_few_copies():
    rng = np.random.default_rng(1)
    u = vectordedup._unit(rng.standard_normal((8000, 64)))
    centres = vectordedup._unit(rng.standard_normal((500, 64)))
    near = vectordedup._unit(centres[rng.integers(0, 500, 8000)] + 0.03 * rng.standard_normal((8000, 64)))
    reach = np.sqrt(0.1) / 2
    assert vectordedup.best_cells(u, 50_000, reach) <= 8
    assert vectordedup.best_cells(near, 1_000_000, reach) >= 64


def test_nearest(spark):
    x, t = vectors(spark, 600)
    got = defaultdict(list)
    for r in ann.nearest(t, k=10, every=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if j != q][:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[j], abs=1e-12) for j, s in got[q])
        hit += len(set(want) & {j for j, _ in got[q]})
    assert hit >= 0.9 * 300 and set(got) == set(range(0, 600, 20))
    few = t.where("vec_id < 4")
    assert ann.nearest(few, k=10, every=2).groupBy("query_id").count().collect()[0]["count"] == 3
    assert ann.nearest(t.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    t = spark.createDataFrame([(i, [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.nearest(t, k=10, every=100).orderBy("rank").collect()]
    assert got == list(range(1, 11))


def test_chi_square():
    assert ann.chi2_cdf(np.array([2.0]), 2)[0] == pytest.approx(1 - np.exp(-1)) and ann.chi2_cdf(np.array([7.344]), 8)[0] == pytest.approx(0.5, abs=1e-3)


# -- 8, 3, 5: models ---------------------------------------------------------

def test_language(spark):
    rng = random.Random(7)
    vocab = {"en": ["the", "and", "house", "walk", "thing"], "de": ["der", "und", "haus", "gehen", "straße"], "fr": ["le", "et", "maison", "marcher", "été"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "er"]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "12 !! 3", "de"), (1002, "the house", None), (1003, "", "fr"), (1004, "straßen", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(5))
    got = {r["doc_id"]: r for r in langid.identify(t).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held if r[0] < 1000) >= 0.97 * sum(r[0] < 1000 for r in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1003)] == ["und"] * 3 and got[1004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(t.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(t.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_unseen_words_back_off():
    one = lambda a, b: np.log(np.array([a, b]))
    m = langid.Model(["a", "b"], {"yes": one(0.5, 0.1)}, {4: {"\x02abc": one(0.2, 0.01)}, 3: {"bcd": one(0.3, 0.02)}, 2: {}, 1: {"z": one(0.1, 0.4)}})
    s = m.unseen(["abcd", "zz", "z"])
    assert s[0][0] > s[0][1] and s[1][0] < s[1][1] and s[2][0] < s[2][1]
    want = np.mean([one(0.2, 0.01), one(0.3, 0.02) + langid.BACKOFF, one(0.3, 0.02) + langid.BACKOFF], axis=0) + langid.BACKOFF
    assert s[0] == pytest.approx(want)


def test_quality(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "x" * 200_000, "en", "s", 200_000)], DOCS)
    t = d.unionByName(odd).withColumn("quality", F.lit(7))
    got = {r["doc_id"]: r for r in quality.scores(t, lab).collect()}
    good = [(r["quality"], got[r["doc_id"]]["keep"]) for r in lab.collect() if r["quality"] is not None]
    assert sum(bool(q) == k for q, k in good) >= 0.95 * len(good)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == d.count() + 3
    kept = quality.keep_good(t, lab)
    assert kept.columns == t.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}
    assert quality.scores(t, lab.limit(0)).where("keep is not null or score is not null").count() == 0
    with pytest.warns(UserWarning, match="lack a class"):
        assert quality.keep_good(t, lab.where("quality = 1")).count() == t.count()
    assert quality.scores(t.limit(0), lab).count() == 0


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1500)
    t, m = y[:, None] + 0.4 * rng.standard_normal((1500, 3)), y[:, None] + 0.6 * rng.standard_normal((1500, 2))
    model = quality.co_train(t[:40], m[:40], y[:40], t[40:1000], m[40:1000])
    assert ((model.score(t[1000:], m[1000:])[2] >= 0.5) == y[1000:]).mean() > 0.95
    assert quality.co_train(t[:40], m[:40], np.ones(40, int), t, m) is None


def test_few_labels_among_many_documents(spark):
    good = lambda i: f"The river was calm that day, and {i} boats came home. Nobody spoke of the storm."
    bad = lambda i: f"BUY!!! BUY!!! {i} $$$ CLICK >>> CLICK >>> WIN {i} WIN"
    d = docs_of(spark, [(good if i % 2 else bad)(i) for i in range(4000)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(d, lab, rows=200).collect()}
    assert kept == set(range(1, 4000, 2))
    # a class that is rare among the labels is not lost either, and stays rare
    lab = spark.createDataFrame([(i, i % 2) for i in range(4000) if i % 2 or i < 20], "doc_id long, quality int")
    model = quality.fit(d, lab, rows=200)
    assert model is not None and model.excess < 0
    assert {r["doc_id"] for r in quality.keep_good(d, lab, rows=200).collect()} == set(range(1, 4000, 2))


# -- pipeline ----------------------------------------------------------------

def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    path = tokenizer_path()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at, seen = docs, []
    for i, (name, step) in enumerate(P.STAGES):
        out = step(spark, at, sf)
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, at.collect(), now.collect(), now.columns))
        at = now
    assert [s[0] for s in seen] == ["quality_classifier", "minhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert all(s[3] == docs.columns for s in seen[:-1])
    kept = {r["doc_id"] for r in seen[0][2]}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    before = sorted(seen[1][1], key=lambda r: r["doc_id"])
    _, comp = brute_components([r["text"] for r in before])
    assert {r["doc_id"] for r in seen[1][2]} == {before[c]["doc_id"] for c in set(comp)}
    assert len(seen[2][2]) == len(seen[2][1]) and all(not brute_spans(r["text"]) for r in seen[2][2])
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in seen[3][1]:
        sizes[r["source"]] += len(r["text"].split())
    for r in seen[3][2]:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - v) <= 1 for s, v in brute_targets(dict(sizes)).items())
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    assert sum(r["length"] for r in seen[4][2]) == sum(len(tk.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen[4][1])
    assert P.run(spark, sf).count() == len(seen[4][2])

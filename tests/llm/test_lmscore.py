"""The masked pseudo-likelihood against plain loops over the formula, and what training must and must not depend on."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbase.llm import lmscore as L


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "part", "n", "h", "w", "rare")})


def some(seed=4, n=120):
    rng = random.Random(seed)
    rare = [f"{a}{b}{'x' * rng.choice((0, 5, 9, 14))}" for a in "abcdefgh" for b in "stuvw"]
    texts = [" ".join(rng.choices(["the", "of", "and", rng.choice(rare), rng.choice(rare[:9])], k=rng.randint(1, 40))) for _ in range(n)]
    return [*texts, texts[0], "once pair twin twin", "the unique pair", None, " ", "", "一二 the"]


def brute(texts, weights, table, least):
    """pll of each text, by loops over dicts: nothing of the operator but its weights and its constants."""
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(w for ws in words for w in ws)
    total = sum(counts.values())
    common = sorted((w for w, c in counts.items() if c * table >= total and c >= least), key=lambda w: (-counts[w], w))
    length = lambda w: sum(len(w) > k for k in L.LENGTHS)
    rest, leaf, before = Counter(), {}, 0
    tail = sum(counts[w] for w in common[L.OWN :])
    for i, w in enumerate(common):
        leaf[w] = i if i < L.OWN else L.OWN + min(L.SHARED * L.GROUPS - 1, int(before / tail * L.SHARED * L.GROUPS))
        before += counts[w] if i >= L.OWN else 0
    mass = Counter()
    for w in common:
        mass[leaf[w]] += counts[w]
    for w, c in counts.items():
        if w not in leaf:
            rest[length(w)] += c
    pairs = Counter()
    for w, c in counts.items():
        for a, b in zip(" " + w, w + " "):
            pairs[a, b] += c
    letters = sorted({b for _, b in pairs} | {" "})
    row = {a: sum(pairs[a, b] + 0.01 for b in letters) + 0.01 for a in letters}

    def class_of(x):
        if x < L.OWN:
            return x, None
        if x < L.LEAVES - L.REST:
            return L.OWN + (x - L.OWN) // L.GROUPS, (x - L.OWN) % L.GROUPS
        return L.CLASSES - (L.LEAVES - x), None

    e, b1, w2, b2, w3, b3 = (x.astype(float) for x in weights)
    out = []
    for ws in words:
        own, lp = Counter(ws), 0.0
        ls = [leaf.get(w, L.LEAVES - L.REST + length(w)) for w in ws]
        for i, w in enumerate(ws):
            h = b1.copy()
            for side, k in enumerate((-2, -1, 1, 2)):
                h = h + e[side, ls[i + k] if 0 <= i + k < len(ls) else L.EDGE]
            h = np.tanh(h)
            c, g = class_of(ls[i])
            z = h @ w2 + b2
            lp += z[c] - math.log(sum(math.exp(x) for x in z))
            if g is not None:
                z = h @ w3[c - L.OWN] + b3[c - L.OWN]
                lp += z[g] - math.log(sum(math.exp(x) for x in z))
            if w in leaf:
                lp += math.log(counts[w] / mass[leaf[w]])
            elif counts[w] > own[w]:
                lp += math.log((counts[w] - own[w]) / (rest[length(w)] + 1))
            else:
                lp += sum(math.log((pairs[a, b] + 0.01) / row[a]) for a, b in zip(" " + w, w + " ")) - math.log(rest[length(w)] + 1)
        out.append(lp)
    return out


@pytest.mark.parametrize("least", [1, 4, 10**9])
def test_against_loops(spark, least):
    texts = some()
    d = docs_of(spark, texts)
    lex = L.lexicon(d, table=200, least=least)
    enc = L.encode(d, lex, part=500)
    w = L.train(enc, lex)
    got = {r["doc_id"]: r for r in L.score(enc, lex, w).collect()}
    want = brute(texts, w, 200, least)
    assert len(got) == len(texts)
    assert all(got[i]["pll"] == pytest.approx(x, abs=2e-3) for i, x in enumerate(want))
    assert all(got[i]["n_tokens"] == len((t or "").split()) for i, t in enumerate(texts))


def test_probabilities_of_the_table_sum_to_one(spark):
    d = docs_of(spark, some())
    lex = L.lexicon(d, table=200, least=4)
    w = L.train(L.encode(d, lex), lex)
    ctx = np.array([[0, 3, L.EDGE, 7]])
    every = np.arange(L.LEAVES)
    lp = L.leaf_logprob(w, np.repeat(ctx, L.LEAVES, axis=0), every)
    assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    words = list(lex.ids)
    share = np.zeros(L.LEAVES)
    np.add.at(share, lex.leaves, np.exp(lex.within))
    assert len(words) == len(lex.leaves) and share[np.unique(lex.leaves)] == pytest.approx(1)


def test_context_tells_words_of_one_class_apart(spark):
    """Frequent words get their own groups, predicted from both sides."""
    rng = random.Random(8)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    texts = [" ".join(f"the {(n := rng.choice(nouns))} {verbs[nouns.index(n)]} {n} ." for _ in range(60)) for _ in range(60)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    d = docs_of(spark, [*texts, " ".join(shuffled), "zq xj kv " * 20, None, "", " \n"])
    lex = L.lexicon(d, least=5)
    enc = L.encode(d, lex)
    got = {r["doc_id"]: r for r in L.score(enc, lex, L.train(enc, lex, rounds=6, stride=2)).collect()}
    assert got[0]["mean_logprob"] > got[60]["mean_logprob"] + 1 and got[0]["mean_logprob"] > got[61]["mean_logprob"]
    assert all((got[i]["n_tokens"], got[i]["pll"], got[i]["mean_logprob"]) == (0, 0.0, None) for i in (62, 63, 64))
    assert L.pseudo_likelihood(d.limit(0)).count() == 0


def test_same_scores_however_rows_are_dealt(spark):
    texts = some(1, 200)
    key = lambda t: sorted((r["doc_id"], r["pll"]) for r in t.collect())
    a, b = (key(L.pseudo_likelihood(docs_of(spark, texts).repartition(n), least=4, part=700)) for n in (2, 7))
    assert [x for x, _ in a] == [x for x, _ in b]
    assert [x for _, x in a] == pytest.approx([x for _, x in b], abs=2e-3)


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(2)
    new = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    texts = [" ".join(rng.choice(["the", "of", "in"]) if rng.random() < 0.7 else new() for _ in range(50)) for _ in range(200)]
    d = docs_of(spark, texts + texts[:10])
    got = {r["doc_id"]: r for r in L.pseudo_likelihood(d, least=5).collect()}
    twice = [got[i]["mean_logprob"] for i in [*range(10), *range(200, 210)]]
    assert min(twice) > max(got[i]["mean_logprob"] for i in range(10, 200))
    assert all((got[i]["n_unseen"] == 0) == (i < 10 or i >= 200) for i in got)


def test_every_position_is_a_target(spark):
    d = docs_of(spark, ["aa bb cc"])
    lex = L.lexicon(d, least=1)
    leaf = lex.groups(*lex.tokens("aa bb cc"))
    before, after = L.start_weights(lex)[3], L.train(L.encode(d, lex), lex)[3]
    assert len(set(leaf)) == 3 and (after[leaf] > before[leaf]).all() and (np.delete(after, leaf) <= np.delete(before, leaf)).all()
    assert L.STRIDE <= L.ROUNDS
    with pytest.raises(ValueError):
        L.train(L.encode(d, lex), lex, rounds=2, stride=16)


def test_hash_of_words_is_the_same_on_both_sides(spark):
    import xxhash

    words = ["", "a", "straße", "一二三", "x" * 100, "😀"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(w.encode(), 42) >> 63) for w in words]


def test_document_sums_are_each_documents_own():
    rng = np.random.default_rng(0)
    w = L.start_weights()
    ds = [rng.integers(0, L.LEAVES, n) for n in (1, 2, 300, 5000)]
    alone = [L.leaf_logprob(w, L._context(d), d).sum(dtype=np.float64) for d in ds]
    assert L.document_sums(w, ds) == pytest.approx(alone, rel=1e-5)


def test_weights_are_added_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "ADDED", 2)
    w = [[x + i for x in L.start_weights()] for i in range(7)]
    rows = [(i, i + 1, L._pack(x)) for i, x in enumerate(w)]
    got = L._sum_in_order(spark.createDataFrame(rows, "part int, n long, w binary"))
    want = [sum((i + 1) * x[k] for i, x in enumerate(w)) / 28 for k in range(6)]
    assert all(a == pytest.approx(b, abs=1e-4) for a, b in zip(got, want, strict=True))


def test_only_words_outside_the_table_are_measured():
    """Lengths of the table's words aren't taken: those are most words, and the table has their groups."""

    class Word(str):
        def __len__(self):
            raise AssertionError("a word of the table was measured")

    lex = L.Lexicon(["the", "of"], [60, 50], [1] * L.REST, {}, np.zeros((2, 2)), {}, None)
    words = [Word("of"), "seventh", Word("the")]
    assert lex.groups(words, np.array([1, -1, 0])).tolist() == [1, L.LEAVES - L.REST + 1, 0]
    none = L.Lexicon([], [], [1] * L.REST, {}, np.zeros((2, 2)), {}, None)
    assert none.groups(["x"], np.array([-1])).tolist() == [L.LEAVES - L.REST]
    assert none.groups([], np.array([], np.int64)).tolist() == []


def test_a_step_takes_each_row_once_however_words_are_spread(monkeypatch):
    """Exponentials of a step and of scoring: at most a row of classes and a row of groups for each word, also when all words are of one class."""
    taken, exp = [], np.exp
    monkeypatch.setattr(L.np, "exp", lambda x, **to: (taken.append(np.size(x)), exp(x, **to))[1])
    w = L.start_weights()
    leaf = np.random.default_rng(1).integers(L.OWN, L.OWN + L.GROUPS, 500)
    each = 500 * (L.HIDDEN + L.CLASSES + L.GROUPS)
    L.leaf_logprob(w, L._context(leaf), leaf)
    assert sum(taken) <= each
    taken.clear()
    L.sgd(w, [np.full_like(x, 1e-3) for x in w], L._context(leaf), leaf)
    assert sum(taken) <= each


@pytest.mark.parametrize("scale", [1, 400])
def test_a_step_follows_the_gradient(scale):
    """Against differences of the summed log-probabilities; with large weights, against a softmax in double precision."""
    rng = np.random.default_rng(6)
    w = [x * scale for x in L.start_weights()]
    leaf = rng.integers(0, L.LEAVES, 400)
    ctx = L._context(leaf)
    e, b1, w2, b2, w3, b3 = (x.astype(float) for x in w)
    h = np.tanh(sum(e[i, ctx[:, i]] for i in range(2 * L.SIDE)) + b1)
    log = lambda z: z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
    want, every = log(h @ w2 + b2)[np.arange(400), L.CLASS_OF[leaf]], np.arange(400)
    of = np.clip(L.CLASS_OF[leaf] - L.OWN, 0, L.SHARED - 1)
    inner = log(np.einsum("nh,nhg->ng", h, w3[of]) + b3[of])[every, L.GROUP_OF[leaf]]
    want += np.where((leaf >= L.OWN) & (leaf < L.LEAVES - L.REST), inner, 0)
    got = L.leaf_logprob(w, ctx, leaf)
    assert np.isfinite(got).all() and got == pytest.approx(want, rel=1e-4, abs=1e-3)
    past, before = [np.full_like(x, 1e6) for x in w], [x.copy() for x in w]
    L.sgd(w, past, ctx, leaf, rate=1e3)  # so much is in past that the step is the gradient
    assert all(np.isfinite(x).all() for x in w)
    if scale == 1:
        mean = lambda ws: L.leaf_logprob(ws, ctx, leaf).sum(dtype=float) / 400
        for k, (a, b) in enumerate(zip(before, w, strict=True)):
            step = (b - a).astype(float)
            along = lambda t: mean([x + np.float32(t) * step.astype(np.float32) if i == k else x for i, x in enumerate(before)])  # noqa: B023, E731
            t = 0.02 / max(1e-9, np.abs(step).max())
            assert (along(t) - along(-t)) / (2 * t) == pytest.approx((step**2).sum(), rel=0.05)

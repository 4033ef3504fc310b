"""Kneser-Ney scores, token counts and the mix, against plain versions."""

import collections
import math

import numpy as np
import public_tokenizers
import pytest

from strandline.llm import kneser_ney as N
from strandline.llm import mixing as M
from strandline.llm.shared import fold as fold_column
from strandline.llm.shared import fresh
from strandline.llm.token_counts import TokenCache

from .helpers import corpus, fold, frame, low, with_clashes, words


def _brute(rows, order=2):
    toks = [words(low(t or "")) + ["</>"] for _, t, *_ in rows]
    train = [w for (i, *_), w in zip(rows, toks, strict=True) if fold(i) != 1]
    c = collections.Counter(x for w in train for x in w)
    pad = ["<>"] * (order - 1)
    grams = lambda w: [tuple([*pad, *w][i : i + order]) for i in range(len(w))]
    own = {order: collections.Counter(g for w in train for g in grams(w))}
    for k in range(order - 1, 0, -1):  # how many words a sequence follows; what begins a text has its count
        own[k] = collections.Counter()
        for g, n in own[k + 1].items():
            own[k][g[1:]] += n if k > 1 and g[1] == "<>" else 1
    ctx = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in own}
    for k in range(2, order + 1):
        for g, n in own[k].items():
            ctx[k][g[:-1]][0] += n
            ctx[k][g[:-1]][min(n, 3)] += 1
    counts = lambda v: np.array([sum(1 for n in v if n == i) for i in (1, 2, 3, 4)], float)
    d = {k: N.discounts(counts(own[k].values())) for k in own}
    n, v = sum(c.values()), len(c)
    spread = sum(d[1][k] * sum(1 for x in own[1].values() if min(x, 3) == k + 1) for k in range(3)) / (v + 1)

    def p(g):
        if len(g) == 1:
            return ((own[1][g] - d[1][min(own[1][g], 3) - 1] if own[1][g] else 0) + spread) / sum(own[1].values())
        if g[:-1] not in ctx[len(g)]:
            return p(g[1:])
        x, a, e = ctx[len(g)][g[:-1]], own[len(g)].get(g, 0), d[len(g)]
        return ((a - e[min(a, 3) - 1] if a else 0) + (e[0] * x[1] + e[1] * x[2] + e[2] * x[3]) * p(g[1:])) / x[0]

    for before in (pad, [*pad, next(iter(c))][1:], ["??"] * (order - 1), [*pad, *toks[0]][-order + 1 :]):
        assert sum(p((*before, w)) for w in [*c, "??"]) == pytest.approx(1)
    out = []
    for (i, *_), w in zip(rows, toks, strict=True):
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, len(w), sum(x in c for x in w), round(base, 6), round(sum(math.log10(p(g)) for g in grams(w)), 6)))
    return sorted(out), n


def _scores(spark, df, order=2):
    from pyspark.sql import functions as F

    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = N.fit(texts.where(fold_column() != 1).select("text"), order)
    return sorted((r[0], r[1], r[2], round(r[3], 6), round(r[4], 6)) for r in N.scored(texts, model).collect()), model


@pytest.mark.parametrize(("parts", "order"), [(1, 2), (5, 2), (1, 3), (5, 3), (3, 4)])
def test_kneser_ney(spark, parts, order, monkeypatch):
    rows = corpus()
    if parts == 5:
        monkeypatch.setattr(N, "HELD", 300)
    got, model = _scores(spark, with_clashes(frame(spark, rows, parts)), order)
    want, n = _brute(rows, order)
    assert model.n_tokens == n and got == want


def test_kneser_ney_without_training_text(spark):
    assert _scores(spark, frame(spark, corpus()[:1]).limit(0))[0] == []
    alone = next(i for i in range(99) if fold(i) == 1)
    assert _scores(spark, frame(spark, [(alone, "a b", None, None, 3)]))[0] == [(alone, 3, 0, 0.0, 0.0)]


def test_large_counts(spark):
    rows = [(i, "a b " * 400, None, None, 0) for i in range(20)] + [(50, "a c b", None, None, 0)]
    for order in (2, 3):
        assert _scores(spark, frame(spark, rows), order)[0] == _brute(rows, order)[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_through_a_cache(spark, name):
    path = public_tokenizers.path(name)
    rows = corpus(40) + [(9001, "Hello <|endoftext|> <|ENDOFTEXT|> it's\x1cX\x85y", None, None, 1), (9002, "Hello   <|endoftext|>\n<|ENDOFTEXT|> it's\x1cX\x85y ", None, None, 1)]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    else:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(s.encode(x))
    want = sorted((i, len((x or "").encode()), count(x or "")) for i, x, *_ in rows)
    cache = TokenCache(spark, fresh(spark, "cache"), path)
    df = with_clashes(frame(spark, rows))
    first = cache.count(df.where("doc_id < 60"))
    assert first.count() == df.where("doc_id < 60").count()
    stored = cache.table().count()
    assert sorted(map(tuple, cache.count(df).collect())) == want
    after = cache.table().count()
    assert sorted(map(tuple, cache.count(df).collect())) == want and after == cache.table().count() > stored  # the third time all are hits
    assert cache.count(df.limit(0)).count() == 0


def test_quotas_of_few_long_documents():
    fit = lambda budget, *sizes: int((M.quotas(np.array(sizes), np.ones(len(sizes), np.int64), budget) * sizes).sum())
    assert fit(72_000, 80_000) == 80_000 and fit(201_000, 100_000, 100_500, 101_000) == 201_000 and fit(300_000, 120_000, 150_000, 180_000) == 300_000
    assert fit(200_000, 99_000, 101_000, 150_000) == 200_000 and fit(7 * 10**9, 3 * 10**9, 4 * 10**9 + 1, 5 * 10**9) == 7 * 10**9 + 1
    r = np.random.default_rng(3)
    for scale in (1, 1000, 20_000):
        for _ in range(40):
            sizes = np.unique(r.integers(1, 12, 5)) * scale + (scale > 1)
            counts = r.integers(1, 3, len(sizes))
            sums = {0}
            for x, n in zip(sizes.tolist(), counts.tolist(), strict=True):
                sums = {s + k * x for s in sums for k in range(n + 1)}
            budget = int(r.integers(1, int((sizes * counts).sum()) + 1))
            take = M.quotas(sizes, counts, budget)
            assert (take >= 0).all() and (take <= counts).all()
            assert abs(int((take * sizes).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_quotas_come_near_and_stay_within():
    r = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.unique(r.integers(0, 400, r.integers(1, 30)))
        counts = r.integers(1, 50, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(r.integers(0, total + 5))
        for reach in (32, 10_000):
            take = M.quotas(sizes, counts, budget, reach)
            assert (take >= 0).all() and (take <= counts).all()
            positive = sizes[sizes > 0]
            assert abs(int((take * sizes).sum()) - min(budget, total)) <= (positive.max() if len(positive) else 0)
    assert abs(int((M.quotas(np.array([1, 7, 50]), np.array([100, 40, 30]), 777) * [1, 7, 50]).sum()) - 777) == 0


def _targets(sizes: dict, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark):
    rows = corpus(200)
    df = with_clashes(frame(spark, rows))
    got = M.mix(df)
    a, b = sorted(map(str, got.collect())), sorted(map(str, M.mix(df.repartition(7)).collect()))
    assert a == b and len(a) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = _targets(dict(sizes))
    by_size = {v: k for k, v in sizes.items()}
    taken = collections.Counter()
    for r in got.collect():
        s = by_size[r["source_size"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    for s, t in want.items():
        own = [len(words(x)) for _, x, _, y, _ in rows if y == s]
        reach = {0}
        for n in own:
            reach |= {a + n for a in reach}
        whole = min(3, int(t // sizes[s])) if sizes[s] else 0
        best = min(abs(whole * sizes[s] + a - t) for a in reach) if whole < 3 else abs(3 * sizes[s] - t)
        assert abs(taken[s] - t) <= best + 1
    assert M.mix(df.limit(0)).count() == 0


def test_targets_that_stop(spark):
    rows = [(i, "w " * n, None, s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 500), ("d", 20), (None, 1), ("e", 0)])]
    got = {r["source_size"]: r["target"] for r in M.mix(frame(spark, rows)).collect()}
    want = _targets({"a": 10, "b": 1000, "c": 500, "d": 20, None: 1, "e": 0})
    assert got == pytest.approx({10: want["a"], 1000: want["b"], 500: want["c"], 20: want["d"], 1: want[None], 0: want["e"]})


def test_sequences_are_sent_and_received(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 5, n, np.uint64) << np.uint64(32) | rng.integers(0, 2**32, n, np.uint64, endpoint=True) % np.uint64(2**32))
        other, count = rng.integers(0, 2**64 - 1, n, np.uint64), rng.integers(0, 9, n).astype(np.uint64)
        for got, want in zip(N._received(N._sent([keys, other], [count]), 3), (keys, other, count), strict=True):
            assert np.array_equal(got, want)


def test_words_are_numbered_by_classes_of_counts(spark):
    rows = [(i, "often " * 300 + f"rare{i} now then", None, None, 0) for i in range(30)]
    texts = frame(spark, rows, 3).select("text")
    model = N.fit(texts)
    h = np.unique(N.tokens(*_bytes("often now then rare7 rare8 never"))[0])
    ids = model.words.numbers(h)
    count = dict(zip(h.tolist(), ids.tolist(), strict=True))
    often, now, rare, never = (count[int(N.tokens(*_bytes(w))[0][0])] for w in ("often", "now", "rare7", "never"))
    assert often == 0 and often < now < rare < model.n_words == 34 and never == N.UNKNOWN
    known = ids[ids != N.UNKNOWN]
    assert sorted(model.words.columns(known)[0].tolist()) == [1, 1, 30, 30, 30, 9000]


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])

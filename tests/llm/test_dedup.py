"""Exact, near and line dedup against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from strandline.llm import line_dedup as L
from strandline.llm import near_dedup as N
from strandline.llm.components import components
from strandline.llm.exact_dedup import OP5_SQL, DigestIndex
from strandline.llm.shared import fresh

from .helpers import Union, corpus, frame, low, with_clashes, words


def test_exact(spark):
    rows = list({r[0]: r for r in corpus(300)}.values())
    got = DigestIndex(spark, fresh(spark, "index"), 3).deduplicate(with_clashes(frame(spark, rows))).toPandas().sort_values("doc_id")
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(OP5_SQL).df().sort_values("doc_id")
    assert got[want.columns].values.tolist() == want.values.tolist()
    digest = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for i, t, *_ in rows}
    assert dict(zip(got.doc_id, got.text_sha256, strict=True)) == digest


def test_exact_index_goes_on_and_has_defined_ties(spark):
    path = fresh(spark, "index")
    first = DigestIndex(spark, path, 3)
    assert first.deduplicate(frame(spark, corpus(3)).limit(0)).count() == 0
    rows = [(5, "a b", None, None, 0), (4, "ab", None, None, 0), (3, "a  b", None, None, 0), (3, "a  b", None, None, 0), (None, None, None, None, None), (9, "", None, None, 0)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in first.deduplicate(frame(spark, rows)).collect()}
    assert got == {(5, 3, 4, False), (4, 3, 4, False), (3, 3, 4, True), (None, 9, 2, False), (9, 9, 2, True)}
    again = DigestIndex(spark, path, 3)
    later = again.deduplicate(frame(spark, [(1, "ab ", None, None, 0), (2, "new", None, None, 0)]))
    assert sorted(map(tuple, later.select("doc_id", "keep_id", "kept").collect())) == [(1, 3, False), (2, 2, True)]
    assert again.table().count() == 3 and again.table().select("digest").distinct().count() == 3


def _near(rows):
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = words(low(t or ""))
        sets[i].append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    u, flat = Union(), [(i, s) for i, x in sets.items() for s in x if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                u.join(i, j)
    return {i: u.find(i) for i in sets}


@pytest.mark.parametrize("small", [N.SMALL, 3])
def test_near(spark, small, monkeypatch):
    monkeypatch.setattr(N.candidates, "__defaults__", tuple(small if x == N.SMALL else x for x in N.candidates.__defaults__))
    rows = corpus(220, seed=5)
    # one large group around a base that its members are linked through
    r = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    for i in range(60):
        w = base.copy()
        for k in r.sample(range(120), 3):
            w[k] = f"x{i}{k}"
        rows.append((2000 + i, " ".join(w), None, None, 0))
    rows.append((3000, " ".join(base), None, None, 0))
    got = N.near_duplicates(with_clashes(frame(spark, rows))).collect()
    want = _near(rows)
    assert len(got) == len(rows)
    assert {(x["doc_id"], x["component_id"]) for x in got} == set(want.items())
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert N.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_in_large_buckets(spark, monkeypatch):
    """Links among a family of texts that are not near enough, all in buckets beyond `small`, which take several blocks."""
    monkeypatch.setattr(N.candidates, "__defaults__", tuple(3 if x == N.SMALL else x for x in N.candidates.__defaults__))
    monkeypatch.setattr(N, "BLOCK", 16, raising=False)
    r = random.Random(4)
    base, rows = [f"w{k}" for k in range(300)], []

    def changed(w, n, tag):
        w = w.copy()
        for k in r.sample(range(300), n):
            w[k] = f"{tag}{k}"
        return w

    for i in range(150):
        w = changed(base, 7, f"x{i}_")
        rows += [(2 * i, " ".join(w), None, None, 0), (2 * i + 1, " ".join(changed(w, 6, f"y{i}_")), None, None, 0)]
    got = {(x["doc_id"], x["component_id"]) for x in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(_near(rows).items())


def test_bayes_thresholds():
    for n in (16, 64, 180):
        m = N.least_matches(n, 0.75, 1e-5)
        assert 0 < m < 0.75 * n and N.least_matches(n, 0.75, 1e-2) > m
    r = np.random.default_rng(2)
    a, b = N._multipliers(180)
    x = r.integers(0, 1 << 63, 800, dtype=np.uint64)
    for share in (0.3, 0.6, 0.75, 0.9):
        y = x.copy()
        cut = int(800 * (1 - share) / (1 + share))
        y[:cut] = r.integers(0, 1 << 63, cut, dtype=np.uint64)
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((N.signature(x, a, b) == N.signature(y, a, b)).mean() - j) < 0.12


def test_components_of_awkward_graphs(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000 + r.randint(0, 400), 5000 + r.randint(0, 400)) for _ in range(250)] + [(7, 7), (7, 8), (8, 7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    want = {(x, u.find(x)) for x in list(u) if u.find(x) != x}
    for together in (1_000_000, 40):
        df = spark.createDataFrame(edges, "a long, b long").repartition(4)
        assert {tuple(x) for x in components(df, together).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _line_result(rows):
    norm = lambda x: " ".join(words(low(x)))
    shingles = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    occ = [(i, t, k, norm(x)) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if norm(x)]
    u, distinct = Union(), list({x for *_, x in occ})
    sets = [shingles(x) for x in distinct]
    for a in range(len(distinct)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u.join(distinct[a], distinct[b])
    first = {}
    for i, t, k, x in sorted(occ, key=lambda o: (o[0] is None, o[0] or 0, o[2])):
        first.setdefault(u.find(x), (i, t, k))
    gone = collections.defaultdict(set)
    for i, t, k, x in occ:
        if first[u.find(x)] != (i, t, k):
            gone[i, t].add(k)
    return sorted((str(i), str(t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])), len(gone[i, t])) for i, t, *_ in rows)


def test_lines(spark):
    rows = [*corpus(150, seed=8), (None, "a line of a document without an id\nfoo", None, None, 1), (90_000, "A  line of a document without an ID\nbar", None, None, 1)]
    df = with_clashes(frame(spark, rows))
    out = L.dedup_lines(df)
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_dropped"]) for r in got) == _line_result(rows)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in df.columns if c != "n_lines"] and all(r["label"] == "7" for r in got)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_lines_in_large_buckets(spark, monkeypatch):
    """Near copies among variants of a template that are not near enough, in buckets beyond `small`, which take several blocks."""
    monkeypatch.setattr(N.candidates, "__defaults__", tuple(3 if x == N.SMALL else x for x in N.candidates.__defaults__))
    monkeypatch.setattr(N, "BLOCK", 16, raising=False)
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = r.choices(letters, k=400)

    def changed(x, n):
        x = x.copy()
        for k in r.sample(range(400), n):
            x[k] = r.choice(letters)
        return x

    rows = []
    for i in range(120):
        x = changed(base, 6)
        rows += [(2 * i, "".join(x), None, None, 0), (2 * i + 1, "".join(changed(x, 5)), None, None, 0)]
    got = L.dedup_lines(frame(spark, rows)).collect()
    assert sorted((str(x["doc_id"]), str(x["text"]), x["n_dropped"]) for x in got) == _line_result(rows)


def test_line_signatures_estimate_similarity():
    r = random.Random(3)
    x = "".join(r.choices("abcdefghijklmnop ", k=400))
    for n in (30, 120, 400):
        y = x[: n - n // 12] + "#" * (n // 12)
        text = np.frombuffer((x[:n] + y).encode(), np.uint8)
        s = L.signatures(text, np.array([0, n]), np.array([n, 2 * n]))
        p, q = L._sets(pa.array([x[:n].encode(), y.encode()], pa.binary()))
        j = len(np.intersect1d(p, q)) / len(np.union1d(p, q))
        assert abs((s[0] == s[1]).mean() - j) < 0.25
        bits, size = L.parities([p, q], 256)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(p, q)) and size.tolist() == [len(p), len(q)]

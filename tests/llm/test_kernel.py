import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import blobs as B
from strandline.llm import kernel as K

from .helpers import corpus, low, words

TEXTS = [t for _, t, *_ in corpus()]


@pytest.mark.parametrize("size", [1, 100, 1 << 22])
def test_words_hashes_and_shingles(size):
    byword, seen = {}, 0
    for lo, hi, data, offs in K.chunks(pa.array(TEXTS, pa.string()), size):
        data = K.lowered(data)
        s, e, owner = K.words(data, offs)
        h = K.hashes(data, s, e)
        raw = data.tobytes()
        got = [[] for _ in range(hi - lo)]
        for a, b, o, x in zip(s, e, owner, h, strict=True):
            got[o].append(raw[a:b].decode())
            assert byword.setdefault(raw[a:b], x) == x
        assert got == [words(low(t or "")) for t in TEXTS[lo:hi]]
        sets, at = K.shingle_sets(data, offs)
        for i, t in enumerate(TEXTS[lo:hi]):
            w = words(low(t or ""))
            want = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
            own = sets[at[i] : at[i + 1]]
            assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()
        seen += hi - lo
    assert seen == len(TEXTS) and len(set(byword.values())) == len(byword)


def test_equal_texts_have_equal_sets_wherever_they_lie():
    one = ["a b c d e f", "x", "a b c d e f", "a b", "a b"]
    _, _, data, offs = next(K.chunks(pa.array(one)))
    s, at = K.shingle_sets(data, offs)
    assert (s[at[0] : at[1]] == s[at[2] : at[3]]).all() and (s[at[3] : at[4]] == s[at[4] : at[5]]).all()


def test_plain_words():
    text = "It's a-b, C3; naïve—x"
    _, _, data, offs = next(K.chunks(pa.array([text])))
    s, e, _ = K.plain_words(K.lowered(data), offs)
    raw = K.lowered(data).tobytes()
    assert [raw[a:b].decode() for a, b in zip(s, e, strict=True)] == re.findall(r"[0-9a-z\u0080-￿]+", low(text))


def test_blobs_come_back(tmp_path):
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        k = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        v = r.integers(0, 300, n).astype(np.uint64)
        a, b = B.unpack(B.pack(k, v), 2)
        assert (a == k).all() and (b == v).all()
    x = np.array([3, 1, 3, 2], np.uint64)
    assert [y.tolist() for y in B.summed(x, x)] == [[1, 2, 3], [1, 2, 6]] and [y.tolist() for y in B.counted(x)] == [[1, 2, 3], [1, 1, 2]]
    B.put(f"file://{tmp_path}/d/f", x, x.astype(np.uint8))
    assert bytes(B.mapped(f"file://{tmp_path}/d/f")) == x.tobytes() + bytes([3, 1, 3, 2])
    h = K.mix(np.arange(random.Random(1).randint(50, 99), dtype=np.uint64))
    assert len(set(h.tolist())) == len(h) and set(B.bucket_of(h, 4).tolist()) == {0, 1, 2, 3}

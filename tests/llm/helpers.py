"""Small documents with every odd case, and plain versions of the operators to hold them against."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = "id long, digest string, label string, sig string, size int, rank int, n_lines int, bucket int, blob string, score double, content string, order int, target string, hash string"


def fold(i: int | None, n: int = 5) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n: int = 160, seed: int = 3) -> list[tuple]:
    """n documents of invented words: copies, near copies, shared lines, nulls, empties, white space, one very long, non-ASCII."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(600)] + ["Straße", "été", "日本語", "naïve"]
    line = lambda k: " ".join(r.choices(vocabulary, k=k)).capitalize() + "."
    common = [line(12) for _ in range(3)]
    texts: list[str | None] = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15 and (base := r.choice(texts)):
            texts.append(base if r.random() < 0.5 else base.replace(" ", "  ").upper())
        elif texts and kind < 0.35 and (base := r.choice(texts)) and len(base) > 80:
            w = base.split(" ")
            for _ in range(max(1, len(w) // r.choice((12, 25, 40)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(r.choice(common) if r.random() < 0.1 else line(r.randint(1, 25)) for _ in range(r.randint(1, 8))))
    texts += [None, None, "", " \t\n", "\x0b\r ", "one", "One two three four", "one two three four five", "x" * 5000, " ".join(r.choices(vocabulary, k=6000)), "tie\nline that is repeated for a tie\n", " nbsp  sep"]
    rows = [(i * 3 + 1, t, "en", r.choice(["a", "b", "B", "é", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[7]]


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHING.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self.setdefault(self[x], self[x])
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def brute_base(text: str | None) -> tuple[list[str], str]:
    """The contract of the secret scan word for word: span strings and their digest."""
    kinds, t, found = ("assign", "access", "hex"), text or "", []
    rules = ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2), (r"AKIA[A-Z0-9]+", 0, 20, 0), (r"[0-9a-f]+", 0, 24, 0))
    for k, (pattern, flags, least, group) in enumerate(rules):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, t, flags) if len(m[group]) >= least]
    spans = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]
    return spans, hashlib.sha256(",".join(spans).encode()).hexdigest()

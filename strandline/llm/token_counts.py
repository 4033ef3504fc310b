"""Token counts through a digest cache.

The cache is a Parquet table bucketed and sorted by digest: of the tokenizer's version and the normalised content together, so another version never
meets the counts of this one. Digests of a batch are taken once and staged; only distinct ones that the cache lacks are encoded, and their counts are
appended. A join reads the cache as it lies. Texts move only to be encoded: where few are missing their digests (FEW at most) travel to the texts, and
else each task sends each of its distinct texts once.

Within a task, encoding works word by word: for a tokenizer that drops white space, the count of a text is the sum of the counts
of its words, and a bounded memo keeps the words already encoded. Other tokenizers encode whole texts.

Defined cases: a null text is empty and has 0 tokens; repeated rows give repeated rows; an empty table gives no rows.
Very long texts are encoded whole. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, fresh, staged, text_or_empty
from .store import DigestStore

#: Words that a worker remembers at most.
MEMO = 400_000
#: Missing digests that travel to the texts at most, some 150 bytes each in a broadcast: 15 MB.
FEW = 100_000


def _drops_space(path: str) -> bool:
    """True for a tokenizer file whose own normaliser folds white space and whose splitter never keeps it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    kinds = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
    split = next((x for x in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"), {})
    keeps = any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in said.get("added_tokens", []))
    return "Replace" in kinds and split.get("behavior") == "Removed" and bool(split.get("invert")) and not keeps


class _Memo(dict):
    """Counts by word; a missing word is encoded by the library."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = n = self.encode(word.decode("utf-8"))
        return n


_open: dict[tuple[str, bool], object] = {}


def counter(path: str, by_word: bool):
    """A function from UTF-8 bytes to the number of tokens, kept for the life of the worker."""
    if (path, by_word) not in _open:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            encode = lambda s: len(t.encode(s, add_special_tokens=False).ids)
        elif path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            encode = lambda s: len(p.encode(s))
        else:
            raise ValueError(f"no library is known for {path}")
        if by_word:
            memo = _Memo(encode)
            _open[path, by_word] = lambda b: sum(map(memo.__getitem__, b.split()))
        else:
            _open[path, by_word] = lambda b: encode(b.decode("utf-8"))
    return _open[path, by_word]


class TokenCache(DigestStore):
    """A cache of counts at `path`, for the tokenizer file `tokenizer` (present on every worker)."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str, buckets: int | None = None):
        super().__init__(spark, path, "tokenizer STRING, n_tokens BIGINT", buckets)
        self.tokenizer = tokenizer
        with open(tokenizer, "rb") as f:
            self.version = hashlib.sha256(f.read()).hexdigest()
        self.by_word = _drops_space(tokenizer)

    def digest(self):
        """A function from UTF-8 bytes to the digest of version and normalised content."""
        version, by_word = self.version.encode(), self.by_word
        return lambda raw: hashlib.sha256(version + (b" ".join(raw.split()) if by_word else raw)).digest()

    def count(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", few: int = FEW) -> DataFrame:
        """id, n_bytes, n_tokens of every row."""
        bounded_batches(self.spark)
        path, by_word, version, digest = self.tokenizer, self.by_word, self.version, self.digest()
        texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
        kind = dict(texts.dtypes)["doc_id"]

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = [t.as_buffer() for t in b.column("text").cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.size for t in raw], pa.int64()), pa.array([digest(t.to_pybytes()) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "digest"])

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for b in batches:
                own = [digest(t.as_buffer().to_pybytes()) for t in b.column("text").cast(pa.large_string())]
                new = [i for i, d in enumerate(own) if not (d in seen or seen.add(d))]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in new], pa.binary()), b.column("text").take(pa.array(new, pa.int64()))], names=["digest", "text"])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = counter(path, by_word)
            for b in batches:
                n = [count(t.as_buffer().to_pybytes()) for t in b.column("text").cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

        rows = staged(texts.mapInArrow(digests, f"doc_id {kind}, n_bytes long, digest binary"), "digests")
        once = staged(rows.select("digest").distinct(), "distinct_digests")  # staged, as Spark drops a distinct inside a semi join, and a hot digest would stay whole
        missing = staged(self.lacking(once), "missing")
        n = missing.count()
        if n:
            own = texts.select("text").mapInArrow(distinct, "digest binary, text string")
            own = own.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"]) if n <= few else own.dropDuplicates(["digest"]).hint("merge").join(missing, "digest", "left_semi")
            self.append(staged(own.mapInArrow(encode, "digest binary, tokenizer string, n_tokens long"), "encoded"))
        discard(self.spark, missing)
        known = self.table().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have stored the same text
        known = staged(known.join(once, "digest", "left_semi"), "token_counts")  # as a plain scan, so that a text with very many copies is split by the skew join
        return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents for word_bpe_49k.json, through a cache that starts empty; over_limit: more than 2048 tokens."""
    import public_tokenizers

    with TokenCache(spark, fresh(spark, "token_cache"), public_tokenizers.path("word_bpe_49k.json")) as cache:
        counts = cache.count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)

"""Secret scan: fixed patterns, and strings that a primed compressor finds novel.

The base spans are fixed patterns. Beyond them, every long enough string near a sensitive word is a candidate, and so are those on the
lines that follow it without anything else between, as in PEM blocks. Its novelty is the
marginal number of bytes that zstandard needs for it, given a dictionary of common identifiers and the text around it:
compressed(context + candidate) - compressed(context). Identifiers, words and repeats cost little; random keys cost nearly
their entropy and are reported as `novel` spans.

Defined cases: a null or empty text has no spans. Very long texts are scanned whole. Repeated rows give repeated rows, an empty
table none. Spans count code points, end exclusive. Only the id and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, text_or_empty

#: The base patterns, the length each match must reach and the group it is measured on.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Without one of these no assign match is possible; far cheaper to look for than the pattern.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Hexadecimal digits as 1, all else as 0: a run of 24 is then a plain search.
_HEX_MAP = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))

#: Words that make what follows sensitive, and literals of which any match has one.
SENSITIVE_WORDS = (b"pass", b"secret", b"token", b"api", b"auth", b"bearer", b"credential", b"private", b"access", b"client", b"signature", b"akia")
SENSITIVE = re.compile(rb"pass(?:word|wd|phrase)?|secret|token|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|client[_ -]?id|signature|akia")
#: A candidate ends at an equals sign that something follows, so that in name=value the value is one of its own; those at its end are padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:=++(?![A-Za-z0-9+/_-]))?")
#: What may lie between candidates on consecutive lines; an escaped line break counts. And the short last line of a PEM block.
_BREAK = r"""[\x20\t"',;#*>|]*+[\n\r\\][\s"',;#*>|\\]*+"""
GAP = re.compile(_BREAK)
LAST_LINE = re.compile(_BREAK + r"([A-Za-z0-9+/]{1,15}={0,2})" + _BREAK + "n?-----END ")
#: Identifiers that code is full of; they prime the compressor, so that names made of them are no news to it.
IDENTIFIERS = (
    "get set is has add remove update delete create insert select find list load save read write open close start stop init main test run "
    "user name email password passwd secret token api key access client server host port path file config settings environment variable "
    "string number integer boolean float double object array index value result response request error message exception handler "
    "public private protected static final const class function return import from package module export default async await "
    "example sample placeholder changeme your_api_key_here xxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "application/json content-type authorization bearer basic http https www com org net index html css javascript python java "
)
#: Characters of text on each side that prime the compressor, and in which a sensitive word is looked for before the first candidate.
CONTEXT, NEAR = 512, 64
#: Marginal bits a character from which a candidate is novel. Random base 64 takes 6 and more, identifiers made of words up to 4.
NOVEL_BITS = 4.5


class Novelty:
    """Marginal compressed bytes of a candidate, given the identifier dictionary and the text around it."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 9):
        import zstandard as z

        words = z.ZstdCompressionDict(dictionary.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        self._pack = z.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def bits(self, around: bytes, candidate: bytes) -> float:
        """Bits a byte that the candidate adds to its context."""
        added = len(self._pack.compress(around + candidate)) - len(self._pack.compress(around))
        return 8.0 * added / max(1, len(candidate))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind; by start, then kind as listed."""
    found = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in raw.translate(_HEX_MAP):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def novel_spans(text: str, raw: bytes, base: list[tuple[int, int, str]], novelty: Novelty, bits: float = NOVEL_BITS) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context, outside the base spans, that the primed compressor can't shorten."""
    low = raw.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    ascii_only = len(raw) == len(text)
    tails = [m.end() for m in SENSITIVE.finditer(low)]
    if not ascii_only:
        tails = [len(raw[:e].decode("utf-8")) for e in tails] if len(tails) < 64 else _points(raw, tails)
    found, block = [], -1  # end of the last candidate in a sensitive context
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_right(tails, a)
        if not (k and a < tails[k - 1] + NEAR) and not (block >= 0 and GAP.fullmatch(text, block, a)):
            block = -1
            continue
        block = b
        if any(x < b and a < y for x, y, _ in base) or not (re.search(r"[0-9]", m[0]) and re.search(r"[A-Za-z]", m[0])):
            continue
        around = (text[max(0, a - CONTEXT) : a] + text[b : b + CONTEXT]).encode()
        if novelty.bits(around, m[0].encode()) >= bits:
            found.append((a, b, KINDS[3]))
            if short := LAST_LINE.match(text, b):
                found.append((*short.span(1), KINDS[3]))
    return found


def _points(raw: bytes, at: list[int]) -> list[int]:
    """Code points before each of the rising byte offsets."""
    out, done, n = [], 0, 0
    for e in at:
        n += len(raw[done:e].decode("utf-8"))
        done = e
        out.append(n)
    return out


SPANS = "doc_id {id}, spans array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: float = NOVEL_BITS) -> DataFrame:
    """doc_id and all spans (base and novel, by start) of every row. No shuffle: each text is read where it lies."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            out = []
            for t in b.column("text").cast(pa.large_string()):
                raw = t.as_buffer().to_pybytes()
                text = raw.decode("utf-8")
                base = base_spans(text, raw)
                more = novel_spans(text, raw, base, novelty, bits)
                every = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base
                out.append([{"start": x, "end": y, "kind": k} for x, y, k in every])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, shape)], names=["doc_id", "spans"])

    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(find, SPANS.format(id=kind))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: counts of the base kinds, digest of the base spans, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

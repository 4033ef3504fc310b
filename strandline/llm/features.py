"""Numbers that describe a text, for the quality classifier, and hashed word features, for the toxicity classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernel as K

#: Byte classes whose share of a text is a feature.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:'\"-()", "!?", "|", "#$%&*+/<=>@[\\]^_`{}~")
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "blank", "stops", "shouts", "bars", "symbols", "wide",
    "log_line", "line_repeats", "distinct_words", "top_word", "same_as_last", "short_words", "upper_words", "marked_words", "distinct_pairs", "long_words", "ends_well",
)


def _per(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, for each stretch; sorts values in place."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    n = _per(new, bounds)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(values)))
    most = np.zeros(len(bounds) - 1)
    if len(at):
        np.maximum.at(most, np.searchsorted(bounds, at, "right") - 1, size)
    return n, most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(NAMES) numbers for each text; all are 0 for an empty one."""
    out = np.zeros((len(texts), len(NAMES)))
    table = np.zeros((len(CLASSES), 256), bool)
    for i, c in enumerate(CLASSES):
        table[i, list(c.encode())] = True
    for lo, hi, data, offs in K.chunks(texts, 1 << 20):
        x = out[lo:hi]
        size = np.diff(offs)
        some = np.maximum(size, 1)
        starts, ends, owner = K.words(data, offs)
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        n = np.diff(bounds)
        words = np.maximum(n, 1)
        x[:, 0], x[:, 1] = np.log1p(size), np.log1p(n)
        x[:, 2] = _per(K.not_space(data), offs) / words
        for i in range(len(CLASSES)):
            x[:, 3 + i] = _per(table[i][data], offs) / some
        x[:, 10] = _per(data >= 128, offs) / some
        ls, le, lo_ = K.runs(data != 10, offs)
        line_bounds = np.searchsorted(lo_, np.arange(hi - lo + 1))
        lines = np.maximum(np.diff(line_bounds), 1)
        x[:, 11] = np.log1p(size / lines)
        n_lines, _ = _distinct(K.hashes(data, ls, le), line_bounds)
        x[:, 12] = 1 - np.maximum(n_lines, 1) / lines
        if len(starts):
            h = K.hashes(data, starts, ends)
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
            x[:, 15] = _per(same, bounds) / words
            pairs = K.mix(h * K._STEP + np.append(h[1:], h[:1]))
            n_pairs, _ = _distinct(pairs, bounds)
            x[:, 19] = n_pairs / words
            n_words, top = _distinct(h, bounds)
            x[:, 13], x[:, 14] = n_words / words, top / words
            length = ends - starts
            x[:, 16], x[:, 20] = _per(length <= 3, bounds) / words, _per(length > 20, bounds) / words
            upper = np.concatenate([[0], np.cumsum(table[0][data], dtype=np.int64)])
            marks = np.concatenate([[0], np.cumsum(table[4][data] | table[5][data] | table[6][data], dtype=np.int64)])
            x[:, 17] = _per((upper[ends] - upper[starts] > 1), bounds) / words
            x[:, 18] = _per(marks[ends] > marks[starts], bounds) / words
        if len(ls):
            x[:, 21] = _per(np.isin(data[le - 1], list(b".!?")), line_bounds) / lines
    return out


#: Byte lengths of the word beginnings that are features beside the words themselves.
PREFIXES = (5, 6, 7)


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case, ASCII punctuation off) and of their beginnings, and the text index of each."""
    data = K.lowered(data)
    starts, ends, owner = K.plain_words(data, offs)
    h, whose = [K.hashes(data, starts, ends)], [owner]
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts > k)
        h.append(K.hashes(data, starts[at], starts[at] + k, seed=k))
        whose.append(owner[at])
    return np.concatenate(h), np.concatenate(whose)

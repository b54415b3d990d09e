"""Hashed character n-grams of words, and a small logistic regression for the classifiers here."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return WORD.findall((text or "").lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes spread over a power of two of buckets."""
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    return (h >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def word_grams(found: list[str], least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every character n-gram of the words; a word's ends are marked."""
    x = _codes("".join([f"<{w}>" for w in found]))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))  # characters to the word's end
    owner, h = np.repeat(np.arange(len(found)), sizes), np.zeros(len(x), np.uint32)
    who, where = [], []
    for n in range(1, most + 1):
        h = h[: len(x) - n + 1] * np.uint32(2654435761) + x[n - 1 :] if n <= len(x) else h[:0]
        if n >= least:
            whole = np.flatnonzero(left[: len(h)] >= n)
            who.append(owner[whole])
            where.append(_buckets(h[whole], buckets))
    return np.concatenate(who), np.concatenate(where)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def text_grams(texts: list[str | None], buckets: int) -> np.ndarray:
    """(texts, buckets): how often each bucket's one to three letters stand in a text, in lower case.

    Whatever is no letter ends a word; two and three letters may include a word's start or end."""
    low = [(t or "").lower() for t in texts]
    x = _codes("\n" + "\n".join(low) + "\n")
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    sizes[-1:] += 1
    letter = _letters()[x]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    owner, letter = np.repeat(np.arange(len(low)), sizes)[kept], letter[kept]
    x = np.where(letter, x[kept], np.uint32(1))
    two = x[:-1] * np.uint32(2654435761) + x[1:]
    three = two[:-1] * np.uint32(2654435761) + x[2:]
    middle = np.flatnonzero(letter[1:-1])
    key = np.concatenate((
        owner[letter] * buckets + _buckets(x[letter], buckets),
        np.where(letter[:-1], owner[:-1], owner[1:]) * buckets + _buckets(two, buckets),
        owner[middle + 1] * buckets + _buckets(three[middle], buckets),
    ))
    return np.bincount(key, minlength=len(low) * buckets).reshape(len(low), buckets)


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The uint16 numbers of a binary column, one row after the other, and how many each row has, chunk by chunk."""
    data, sizes = [np.empty(0, np.uint16)], []
    for c in column.cast(pa.large_binary()).chunks:
        ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        raw = np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        data.append(raw.copy().view(np.uint16))
        sizes.append(np.diff(ends) // 2)
    return np.concatenate(data), sizes


class Counts:
    """Rows of small counts, kept as columns and counts (binary columns of uint16) and made dense a slice at a time."""

    def __init__(self, cols: pa.ChunkedArray, counts: pa.ChunkedArray, width: int):
        self.shape = (len(cols), width)
        self.cols, sizes = _joined(cols)
        self.counts, _ = _joined(counts)
        self.at = np.concatenate(([0], *sizes)).cumsum(dtype=np.int64)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.at[rows + 1] - self.at[rows]
        take = np.repeat(self.at[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros((len(rows), self.shape[1]), np.float32)
        out[np.repeat(np.arange(len(rows)), sizes), self.cols[take]] = self.counts[take]
        return out


def fit_logistic(x: np.ndarray | Counts, y: np.ndarray, l2: float, rounds: int, rate: float, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, outputs) and biases by Adam on the mean log-loss, in slices of 1024 rows.

    x may hold small counts; `scale` multiplies its columns slice by slice.
    """
    y = y.reshape(len(y), -1).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    w[-1] = np.log((y.sum(0) + 0.5) / (len(y) - y.sum(0) + 0.5))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 1024)):
            a = x[part].astype(np.float32, copy=False)
            if scale is not None:
                a *= scale
            p = 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30)))
            g = np.empty_like(w)
            g[:-1] = a.T @ (p - y[part]) / len(part) + l2 * w[:-1]
            g[-1] = (p - y[part]).mean(0)
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]

"""Periodic runs of words, found by matching aligned blocks of power-of-two length."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .shared import SPACE, map_texts

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words of the smallest block. Blocks of b words look for periods from b to 2b-1, the smallest also for shorter
#: ones. A run of such a period q has L >= max(24, 3q) words, so L - q >= 2b - 1: it holds an aligned block
#: which recurs q words later in it.
FIRST = 8

WORD = re.compile(f"[^{SPACE}]+")
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _equal(u: np.ndarray, v: np.ndarray) -> int:
    """How many elements of u and v agree from the start, looked at in slices that grow."""
    n, at, size = min(len(u), len(v)), 0, 64
    while at < n:
        bad = np.flatnonzero(u[at : min(at + size, n)] != v[at : min(at + size, n)])
        if len(bad):
            return at + int(bad[0])
        at, size = at + size, size * 2
    return n


def _parts(d: int) -> list[int]:
    """d divided by each of its prime factors."""
    out, f, rest = [], 2, d
    while f * f <= rest:
        if rest % f == 0:
            out.append(d // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return [*out, d // rest] if rest > 1 else out


def _digits(names: np.ndarray) -> np.ndarray:
    """(names, digits): each name in as many digits of base 256 as the largest needs, each place with an alphabet of its own.
    A node of the automaton then has few children, which it searches one by one."""
    places = max(1, -(-int(names.max()).bit_length() // 8))
    return np.stack([(names >> (8 * k) & 255) + 256 * k for k in range(places)], axis=1)


def _places(names: np.ndarray, starts: Sequence[int], piece: int) -> dict[int, np.ndarray]:
    """start -> everywhere that the block which begins there occurs, for the blocks that recur.

    A block is a key of FIRST integers, the names of its pieces. The document is searched once, as the `piece`
    sequences of every piece-th name, one after the other; a name that no key has stands between them.
    """
    every = [np.append(np.arange(r, len(names), piece), -1) for r in range(piece)]
    at = np.concatenate(every)
    digits = _digits(np.append(names, names.max() + 1))
    wide = digits.shape[1]
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    first, key_of = {}, {}
    for s in starts:
        key = tuple(digits[s : s + FIRST * piece : piece].ravel().tolist())
        key_of[s] = first.setdefault(key, s)
        if key_of[s] == s:
            search.add_word(key, s)
    search.make_automaton()
    found = defaultdict(list)
    for end, s in search.iter(tuple(digits[at].ravel().tolist())):
        found[s].append(end // wide - FIRST + 1)
    arrays = {s: np.sort(at[p]) for s, p in found.items() if len(p) > 1}
    return {s: arrays[f] for s, f in key_of.items() if f in arrays}


def _longer(names: np.ndarray, piece: int) -> np.ndarray:
    """The names of pieces of twice the length: equal where both halves are."""
    pairs = names[:-piece] * (int(names.max()) + 1) + names[piece:]
    return np.unique(pairs, return_inverse=True)[1]


def find_runs(words: Sequence) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period.

    A run is a stretch with smallest period q (words q apart are equal) of at least max(24, 3q) words,
    which no neighbouring word extends. Blocks that do not recur at one size are left out at the
    next, since what holds them does not recur either; most texts end after the first.
    """
    numbers: dict = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n, block, piece, names = len(a), FIRST, 1, a
    starts: Sequence[int] = range(0, n - block + 1, block)
    found: set[tuple[int, int, int]] = set()
    while len(starts) and TIMES * block <= n:
        recur = _places(names, starts, piece)
        # How far a known run with a period of at most `block` reaches that begins at or before a word. A block and its
        # recurrence within one such run belong to that run's period.
        known = sorted((s, s + length) for s, length, q in found if q <= block)
        begins = np.array([s for s, _ in known], np.int64)
        reach = np.maximum.accumulate(np.array([0, *[e for _, e in known]], np.int64))
        ends: dict[int, int] = {}
        for s, places in recur.items():
            covered = int(reach[np.searchsorted(begins, s, "right")])
            low = 1 if block == FIRST else max(block, covered - s - block + 1)
            for d in (places[np.searchsorted(places, s + low) : np.searchsorted(places, s + 2 * block)] - s).tolist():
                if s + d < ends.get(d, 0):
                    continue  # within the last stretch of this distance
                start = s - _equal(a[:s][::-1], a[: s + d][::-1])
                end = s + d + block + _equal(a[s + block :], a[s + d + block :])
                ends[d] = end
                if end - start >= max(LEAST, TIMES * d) and not any(_equal(a[start : start + d], a[start + e :]) == d for e in _parts(d)):
                    found.add((start, end - start, d))
        block *= 2
        starts = [s for s in recur if s % block == 0 and s + block <= n]
        if starts:
            names, piece = _longer(names, piece), piece * 2
    return sorted(found)


def collapse(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> str:
    """The words, without those that a run holds after its first period, joined by a space."""
    stays = np.ones(len(words), bool)
    for start, length, q in runs:
        stays[start + q : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(stays)])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `runs` (array of start, length, period, by start, then period) and `collapsed` in the place of the text.

    Words are what ASCII white space separates, numbered from 0. A null or empty text has no runs and collapses
    to the empty text. Each row stands for itself, so repeated rows, null ids and ties give each row its own result and an
    empty table an empty one. A text is searched as a whole in the task that reads it, with memory in proportion to its
    words. Other columns are passed on; columns named runs or collapsed are replaced.
    """
    docs = docs.drop(*[c for c in ("runs", "collapsed") if c != text_col])

    def start():
        def make(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"runs": [], "collapsed": []}
            for t in texts:
                words = WORD.findall(t or "")
                runs = find_runs(words)
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out["collapsed"].append(collapse(words, runs))
            return out

        return make

    return map_texts(docs, text_col, start, {"runs": f"array<{RUN}>", "collapsed": "string"})

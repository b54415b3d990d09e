"""An adaptive context-mixing range coder for blocks of token ids.

Each block is coded on its own, from a fresh model. Every id has a probability that mixes four predictions:
order 2 (the id that last followed the same two ids), order 1 (the id that last followed the same one),
order 0 (the ids seen so far, by frequency) and any id alike. Their weights add to one in each context,
which is how often in a row orders 2 and 1 were right and whether they name the same id; they move to the share of
the probability of the ids met there that each prediction gave. Frequencies and weights move on at fixed places in a
block, so the intervals of an encoded block are computed at once; blocks are coded side by side, one
to a row of the arrays. All is in whole numbers, so that both sides agree.

A block is a sequence of 16-bit words of a range coder with a 48-bit window and carries.
"""

from __future__ import annotations

import numpy as np

#: Ids to a block, slots of the context tables, and the alphabet of an id of no order.
BLOCK, SLOTS, ALPHABET = 8192, 1 << 14, 1 << 16
#: A prediction's confidence is how often in a row it was right, up to SURE.
SURE = 3
CONTEXTS = 2 * (SURE + 2) ** 2
#: Weights are out of 2^SHARE_BITS, the uniform prediction gives each id 1 of ALPHABET, so intervals
#: are out of 2^TOTAL_BITS. No prediction that is there weighs less than LEAST_SHARE.
SHARE_BITS, LEAST_SHARE = 12, 16
TOTAL_BITS = SHARE_BITS + 16
LOW = np.uint64((1 << 48) - 1)
FULL, SMALL = np.uint64(1 << 48), np.uint64(1 << 32)
W16, W32 = np.uint64(16), np.uint64(32)


def epochs(n: int) -> list[tuple[int, int]]:
    """The stretches of a block within which frequencies and shares stand still."""
    out, at, step = [], 0, 64
    while at < n:
        out.append((at, min(at + step, n)))
        at, step = at + step, min(at + step, 1024)
    return out


def _slot1(p1):
    return (p1.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(18)


def _slot2(p2, p1):
    x = p2.astype(np.uint32) * np.uint32(2654435761) + p1.astype(np.uint32) * np.uint32(2246822519)
    return (x ^ (x >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(18)


def _context(c2, c1, same):
    """Confidences from 0 (no prediction) to SURE + 1, and whether both predict one id."""
    return (c2.astype(np.int64) * (SURE + 2) + c1) * 2 + same


class _Shares:
    """Per block and context the weights of order 2, order 1, order 0 and any id, out of 2^SHARE_BITS,
    from what they gave up to the last epoch. What has no prediction weighs nothing."""

    def __init__(self, blocks: int):
        c2 = np.arange(CONTEXTS) // 2 // (SURE + 2)
        c1 = np.arange(CONTEXTS) // 2 % (SURE + 2)
        first = np.stack((256 * c2 * c2, 256 * c1 * c1, np.full(CONTEXTS, 1024), np.full(CONTEXTS, 512)), 1)
        self.counts = np.tile(first, (blocks, 1, 1))
        self.there = np.stack((c2 > 0, c1 > 0, np.ones(CONTEXTS, bool), np.ones(CONTEXTS, bool)), 1)
        self.freeze(0)

    def freeze(self, seen: int) -> None:
        there = self.there & (np.arange(4) != 2) if not seen else self.there
        c, least = self.counts * there, LEAST_SHARE * there
        spare = (1 << SHARE_BITS) - least.sum(1)
        self.weights = least + c * spare[:, None] // c.sum(2, keepdims=True)
        self.weights[:, :, 3] += (1 << SHARE_BITS) - self.weights.sum(2)


def _gave(parts: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """The share, out of 256, that each part has of the whole."""
    return np.stack([(p << 8) // whole for p in parts], -1)


def _runs(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids by row, and where the run of each place starts and ends."""
    s = np.sort(seen, axis=1)
    n = s.shape[1]
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.arange(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = new[:, 1:]
    end = np.minimum.accumulate(np.where(last, at + 1, n)[:, ::-1], axis=1)[:, ::-1]
    return s, first, end


def _last_followers(slots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each row: the id at the row's last place with the same slot (0 if none) and
    its confidence."""
    order = np.argsort(slots.astype(np.uint16), axis=1, kind="stable")
    k, y = np.take_along_axis(slots, order, 1), np.take_along_axis(ids, order, 1)
    same = np.zeros(k.shape, bool)
    same[:, 1:] = k[:, 1:] == k[:, :-1]
    pred = np.zeros_like(y)
    pred[:, 1:] = np.where(same[:, 1:], y[:, :-1], 0)
    right = same & (pred == y)
    # Before a place: 1 with a prediction, and 1 more for each time in a row that it was just right.
    conf = same.astype(np.int8)
    streak = same
    for back in range(1, SURE + 1):
        hit = np.zeros(k.shape, bool)
        hit[:, back:] = right[:, :-back]
        streak = streak & hit
        conf += streak
    p, c = np.empty_like(pred), np.empty_like(conf)
    np.put_along_axis(p, order, pred, 1)
    np.put_along_axis(c, order, conf, 1)
    return p, c


def _by_length(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids below 65536."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = _by_length(lengths)
    size, rows = lengths[order], len(blocks)
    width = int(size[0])
    ids = np.zeros((rows, width), np.uint16)
    for r, b in enumerate(order):
        ids[r, : size[r]] = blocks[b]
    p1, p2 = np.zeros_like(ids), np.zeros_like(ids)
    p1[:, 1:], p2[:, 2:] = ids[:, :-1], ids[:, :-2]
    pred2, conf2 = _last_followers(_slot2(p2, p1), ids)
    pred1, conf1 = _last_followers(_slot1(p1), ids)
    ctx = _context(conf2, conf1, pred2 == pred1)
    shares = _Shares(rows)
    low, span = np.zeros(rows, np.uint64), np.full(rows, int(FULL) - 1, np.uint64)
    out, at = np.zeros((rows, width * 2 + 8), np.uint16), np.zeros(rows, np.int64)
    lane = np.arange(rows)
    for a, b in epochs(width):
        k = int((size > a).sum())
        x, c = ids[:k, a:b].astype(np.int64), ctx[:k, a:b]
        y2, y1 = pred2[:k, a:b], pred1[:k, a:b]
        w2, w1, w0, any_id = np.moveaxis(shares.weights[lane[:k, None], c], -1, 0)
        below = above = np.zeros_like(x)
        if a:
            s = np.sort(ids[:k, :a], axis=1)
            below, above = (np.stack([np.searchsorted(s[r], ids[r, a:b], side) for r in range(k)]) for side in ("left", "right"))
            below, above = (w0 << 16) * below // a, (w0 << 16) * above // a
        f0 = ((w2 * (y2 < x) + w1 * (y1 < x)) << 16) + below + any_id * x
        parts = [(w2 * (y2 == x)) << 16, (w1 * (y1 == x)) << 16, above - below, any_id]
        fw = parts[0] + parts[1] + parts[2] + parts[3]
        start, freq = f0.astype(np.uint64), fw.astype(np.uint64)
        for i in range(b - a):
            n = int((size > a + i).sum())
            r = span[:n] >> np.uint64(TOTAL_BITS)
            low[:n] += r * start[:n, i]
            span[:n] = r * freq[:n, i]
            over = np.flatnonzero(low[:n] > LOW)
            if len(over):
                low[over] &= LOW
                _carry(out, over, at[over])
            small = np.flatnonzero(span[:n] < SMALL)
            while len(small):
                out[small, at[small]] = low[small] >> W32
                at[small] += 1
                low[small] = (low[small] << W16) & LOW
                span[small] <<= W16
                small = small[span[small] < SMALL]
        # Rows that end within the epoch count only what they hold.
        real = np.arange(a, b) < size[:k, None]
        at_, gave = (lane[:k, None] * CONTEXTS + c)[real], _gave(parts, fw)[real]
        for j in range(4):
            shares.counts[:, :, j] += np.bincount(at_, gave[:, j], rows * CONTEXTS).astype(np.int64).reshape(rows, -1)
        shares.freeze(b)
    for shift in (32, 16, 0):
        out[lane, at] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        at += 1
    codes: list[bytes] = [b""] * rows
    for r, b in enumerate(order):
        codes[b] = out[r, : at[r]].astype("<u2").tobytes()
    return codes


def _carry(out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """Add one to the words written so far."""
    at = at - 1
    while len(rows):
        out[rows, at] += np.uint16(1)
        more = out[rows, at] == 0
        rows, at = rows[more], at[more] - 1


def decode(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, given their codes and lengths. A damaged code gives some ids."""
    if not codes:
        return []
    order = _by_length(np.array(lengths))
    size, rows = np.array(lengths)[order], len(codes)
    width = int(size[0])
    words = np.zeros((rows, max(len(c) for c in codes) // 2 + 8), np.uint64)
    for r, b in enumerate(order):
        w = np.frombuffer(codes[b], "<u2", len(codes[b]) // 2)
        words[r, : len(w)] = w
    code = (words[:, 0] << W32) | (words[:, 1] << W16) | words[:, 2]
    at, span = np.full(rows, 3, np.int64), np.full(rows, int(FULL) - 1, np.uint64)
    ids = np.zeros((rows, width), np.uint16)
    # By row and slot: the last follower, and its confidence above 16 bits.
    last2, last1 = np.zeros(rows * SLOTS, np.int32), np.zeros(rows * SLOTS, np.int32)
    shares, lane = _Shares(rows), np.arange(rows)
    p1, p2 = np.zeros(rows, np.uint16), np.zeros(rows, np.uint16)
    times, before = np.zeros((rows, ALPHABET), np.uint16), np.zeros((rows, ALPHABET + 1), np.uint16)
    flat = before.reshape(-1)
    top = np.int32((SURE + 1) << 16)
    for a, b in epochs(width):
        runs = _padded_runs(ids[: int((size > a).sum()), :a]) if a else None
        moved = np.zeros((rows * CONTEXTS, 4), np.int64)
        weights, n_seen = shares.weights.reshape(-1, 4), max(a, 1)
        for i in range(a, b):
            n = int((size > i).sum())
            e = lane[:n]
            s2, s1 = e * SLOTS + _slot2(p2[:n], p1[:n]), e * SLOTS + _slot1(p1[:n])
            l2, l1 = last2.take(s2), last1.take(s1)
            y2, y1 = l2 & 0xFFFF, l1 & 0xFFFF
            c = e * CONTEXTS + _context(l2 >> 16, l1 >> 16, y2 == y1)
            w2, w1, w0, any_id = np.ascontiguousarray(weights.take(c, 0).T)
            w2, w1, w0 = w2 << 16, w1 << 16, w0 << 16
            step = span[:n] >> np.uint64(TOTAL_BITS)
            t = np.minimum(code[:n] // step, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
            row = e * (ALPHABET + 1)

            def bounds(y):
                lo, hi = (w0 * flat.take(at_) // n_seen for at_ in (row + y, row + y + 1))
                return lo + any_id * y, hi - lo

            (f2, seen2), (f1, seen1) = bounds(y2), bounds(y1)
            same = y2 == y1
            f2, f1 = f2 + w1 * (y1 < y2), f1 + w2 * (y2 < y1)
            all2, all1 = seen2 + any_id + w2 + w1 * same, seen1 + any_id + w1 + w2 * same
            past2, past1 = t >= f2 + all2, t >= f1 + all1
            is2, is1 = (t >= f2) & ~past2, (t >= f1) & ~past1
            is1 |= is2 & same
            x, f0, seen0, whole = (np.where(is2, u, v) for u, v in ((y2, y1), (f2, f1), (seen2, seen1), (all2, all1)))
            other = np.flatnonzero(~(is2 | is1))
            if len(other):
                # Without what orders 2 and 1 put before it.
                put = (w2 * past2 + w1 * past1).take(other)
                x[other], f, seen = _place(t.take(other) - put, w0.take(other), any_id.take(other), other, runs, a)
                f0[other], seen0[other], whole[other] = f + put, seen, seen + any_id.take(other)
            code[:n] -= step * f0.astype(np.uint64)
            span[:n] = step * whole.astype(np.uint64)
            small = np.flatnonzero(span[:n] < SMALL)
            while len(small):
                code[small] = ((code[small] << W16) & LOW) | words[small, np.minimum(at[small], words.shape[1] - 1)]
                at[small] += 1
                span[small] <<= W16
                small = small[span[small] < SMALL]
            ids[:n, i] = x
            once = np.int32(1 << 16)
            last2[s2] = x | np.where((l2 >= once) & (y2 == x), np.minimum((l2 & ~0xFFFF) + once, top), once)
            last1[s1] = x | np.where((l1 >= once) & (y1 == x), np.minimum((l1 & ~0xFFFF) + once, top), once)
            moved[c] += _gave([w2 * (y2 == x), w1 * (y1 == x), seen0, any_id], whole)
            p2[:n] = p1[:n]
            p1[:n] = x
        shares.counts += moved.reshape(shares.counts.shape)
        shares.freeze(b)
        for r in range(int((size > b).sum())):
            times[r] += np.bincount(ids[r, a:b], minlength=ALPHABET).astype(np.uint16)
            np.cumsum(times[r], out=before[r, 1:])
    out = [np.empty(0, np.uint16)] * rows
    for r, b in enumerate(order):
        out[b] = ids[r, : size[r]].copy()
    return out


def _padded_runs(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted ids by row and their runs, widened to a power of two by what lies beyond all ids."""
    found, n = _runs(seen), seen.shape[1]
    wide = 1 << n.bit_length()
    fill = (ALPHABET, n, n)
    s, first, end = (np.pad(x.astype(np.int32), ((0, 0), (0, wide - n)), constant_values=v).reshape(-1) for x, v in zip(found, fill, strict=True))
    return s, first, end, wide


def _place(t: np.ndarray, w0: np.ndarray, any_id: np.ndarray, rows: np.ndarray, runs, seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids in whose interval t lies, of orders 0 and any id, its start and what order 0 gives it:
    the last run of seen ids that starts at t or before by bisection, and from its end the ids
    that were not seen."""
    if not seen:
        x = t // any_id
        return x, x * any_id, np.zeros_like(x)
    s, first, end, wide = runs
    at = rows * wide
    none, step = at - 1, wide >> 1
    at = none
    while step:
        next_ = at + step
        at = np.where(w0 * first.take(next_) // seen + any_id * s.take(next_) <= t, next_, at)
        step >>= 1
    none = at == none
    at = at + none
    held, lo, hi = s.take(at), w0 * first.take(at) // seen, w0 * end.take(at) // seen
    inside = ~none & (t < hi + any_id * (held + 1))
    before = np.where(none, 0, hi)
    x = np.where(inside, held, (t - before) // any_id)
    before = np.where(inside, lo, before)
    return x, before + any_id * x, np.where(inside, hi - lo, 0)

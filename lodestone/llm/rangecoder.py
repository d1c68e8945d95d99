"""An adaptive context-mixing range coder for token ids.

Each id is predicted at three orders. Order 0 counts every id of the alphabet. Orders 1 and 2 keep, for the id before
and for the two ids before, the ids that followed and how often. The distributions are mixed with weights that depend
on how much each context has seen and how sure it is, and that are learnt from what each order's share in the
probability of the coded ids was. The mixed distribution drives a range coder.

A block of up to BLOCK ids is reset at its start, so that any block decodes alone. Within a block the ids are dealt, as
runs, to up to LANES lanes that are coded side by side: all lanes share one model, which learns from all of them
after each step, and numpy works on one id of each lane at once. Everything is integer arithmetic, or sums of integers.

Bytes of a block: for each lane the number of its 16-bit words (u16), then the words, all little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 19
LANES = 2048
LEAST_WIDTH = 256  # ids of a lane, where a block has enough for several
U = np.uint64
TOTAL_BITS = 28
TOTAL = 1 << TOTAL_BITS
ORDER0 = 1 << 23  # the least share of order 0; its counts never exceed it
GAIN = 8  # what a sight of an id adds to its count, which starts at 1
FOLLOWERS = 2  # ids kept behind a context
SLOTS = (1 << 16, 1 << 17)  # contexts of orders 1 and 2
MOST_SEEN = 1023
TOP, LOW_RANGE = U(1 << 48), U(1 << 40)
STATES = 9
SCALE_BITS = 24
#: A context's state by twice its sights, up to 8, and whether they are all of one id.
STATE = np.array([0, 0, *(1 + 2 * (int(t).bit_length() - 1) + one for t in range(1, 9) for one in (0, 1))])
PART = (1 << SCALE_BITS) // np.maximum(np.arange(FOLLOWERS * MOST_SEEN + 1), 1)


class Model:
    """Predictions for n lanes; those that end first come last. Arrays of several values a lane have the lanes as their last axis."""

    def __init__(self, n: int, alphabet: int):
        if alphabet + GAIN * BLOCK > ORDER0:
            raise ValueError(f"ids must be below {ORDER0 - GAIN * BLOCK}")
        self.count = np.ones(alphabet, np.int64)
        self.exact = alphabet <= SLOTS[0]  # order 1 has a slot for every context
        self.ids = [np.full((FOLLOWERS, s), -1, np.int32) for s in SLOTS]
        self.seen = [np.zeros((FOLLOWERS, s), np.int32) for s in SLOTS]
        self.tag = [np.full(s, -1, np.int64) for s in SLOTS]  # which context a slot belongs to
        self.before = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        self.credit = np.tile(np.array([[64], [32], [32]], np.int64), (1, STATES * STATES))  # of orders 2, 1, 0
        self.step = 0

    def predict(self, k: int) -> None:
        """Of each lane: the ids that orders 2 and 1 expect, their shares of TOTAL, and the share of order 0."""
        if self.step < 16 or self.step % 8 == 0:
            below = np.append(0, np.cumsum(self.count))
            self.below = (below << SCALE_BITS) // int(below[-1])
        if self.step < 16 or self.step % 4 == 0:
            self.weight = self.credit[:2] * (TOTAL - ORDER0) // self.credit.sum(0)
        self.step += 1
        b1, b2 = self.before[0][:k], self.before[1][:k]
        pair = (b1 << 32) | b2
        self.key = [b1, pair]
        self.slot = [b1 if self.exact else (b1 * 0x9E3779B1 >> 7) & (SLOTS[0] - 1), ((b1 * 0x9E3779B1 ^ b2 * 0x85EBCA77) >> 13) & (SLOTS[1] - 1)]
        state, ids, shares, self.seen_now, self.own = 0, [], [], [], []
        for o in (1, 0):
            seen = self.seen[o].take(self.slot[o], 1)
            if o == 0 and self.exact:
                own = None
            else:
                own = self.tag[o][self.slot[o]] == self.key[o]
                seen *= own
            total = seen.sum(0)
            state = state * STATES + STATE[np.minimum(total, 8) * 2 + (seen.max(0) == total)]
            self.seen_now.append(seen)
            self.own.append(own)
            ids.append(self.ids[o].take(self.slot[o], 1))
            shares.append(total)
        self.state = state
        parts = [(self.weight[1 - o].take(state) * PART[shares[1 - o]]) * self.seen_now[1 - o] >> SCALE_BITS for o in (1, 0)]
        self.expected, self.share = np.concatenate(ids), np.concatenate(parts)
        self.rest = TOTAL - self.share.sum(0)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's id x in its mixed distribution."""
        self.right = self.expected == x
        low = self.below[x] * self.rest >> SCALE_BITS
        self.zero = (self.below[x + 1] * self.rest >> SCALE_BITS) - low
        self.given = self.share * self.right
        return low + (self.share * (self.expected < x)).sum(0), self.zero + self.given.sum(0)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id of each lane in whose part of the distribution `value` lies."""
        e, s = self.expected, self.share
        at = np.maximum(e, 0)
        low = self.below[at] * self.rest >> SCALE_BITS
        end = self.below[at + 1] * self.rest >> SCALE_BITS
        for j in range(len(e)):
            upto = e[j] <= e
            end += s[j] * upto
            low += s[j] * (upto & (e[j] != e))
        low, end = np.where(e < 0, TOTAL, low), np.where(e < 0, TOTAL, end)
        behind = value - (s * (end <= value)).sum(0)
        x = np.searchsorted(self.below, (((behind + 1) << SCALE_BITS) - 1) // self.rest, "right") - 1
        for j in range(len(e)):
            x = np.where((low[j] <= value) & (value < end[j]), e[j], x)
        return x

    def learn(self, k: int, x: np.ndarray) -> None:
        """Call after place(x)."""
        if self.step <= 16 or self.step % 4 == 0:
            parts = (self.given[:FOLLOWERS].sum(0), self.given[FOLLOWERS:].sum(0), self.zero)
            whole = parts[0] + parts[1] + parts[2]
            for i, p in enumerate(parts):
                self.credit[i] += np.bincount(self.state, (p << 8) // whole, STATES * STATES).astype(np.int64)
            self.credit[:, self.credit.sum(0) > 1 << 18] >>= 1
            self.credit += self.credit == 0
        np.add.at(self.count, x, GAIN)
        for o in (0, 1):
            seen, own, slot = self.seen_now[1 - o], self.own[1 - o], self.slot[o]
            right = self.right[FOLLOWERS:] if o == 0 else self.right[:FOLLOWERS]
            if own is not None and not own.all():
                new = slot[~own]
                self.ids[o][:, new], self.seen[o][:, new] = -1, 0
                self.tag[o][slot] = self.key[o]
            # the place of the id, or else of the follower seen least
            col, least, times = np.zeros(k, np.int64), seen[0], np.zeros(k, np.int32)
            for j in range(1, FOLLOWERS):
                fewer = seen[j] < least
                col, least = np.where(fewer, j, col), np.where(fewer, seen[j], least)
            for j in range(FOLLOWERS):
                known = right[j] & (seen[j] > 0)
                col, times = np.where(known, j, col), np.where(known, seen[j], times)
            at = col * SLOTS[o] + slot
            self.ids[o].ravel()[at] = x
            self.seen[o].ravel()[at] = np.minimum(times + 1, MOST_SEEN)
        self.before[1][:k] = self.before[0][:k]
        self.before[0][:k] = x


def _settle(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lanes that give out 16 bits: the top ones are settled, or the range is too small and gets cut."""
    go = np.flatnonzero(((low ^ (low + size)) < TOP) | (size < LOW_RANGE))
    lo, si = low[go], size[go]
    small = ((lo ^ (lo + si)) >= TOP) & (si < LOW_RANGE)
    if small.any():
        size[go[small]] = (U(0) - lo[small]) & (LOW_RANGE - U(1))
    return go


def _lanes(count: int) -> tuple[int, np.ndarray]:
    """Ids of a lane, and how many lanes run at each step."""
    lanes = min(LANES, max(1, count // LEAST_WIDTH))
    width = -(-count // lanes)
    last = count - (-(-count // width) - 1) * width
    return width, np.where(np.arange(width) < last, -(-count // width), -(-count // width) - 1)


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """The bytes of one block of ids below `alphabet`."""
    count = len(ids)
    if not count:
        return b""
    if count > BLOCK or ids.min() < 0 or ids.max() >= alphabet:
        raise ValueError(f"a block takes up to {BLOCK} ids below its alphabet")
    width, live = _lanes(count)
    n = int(live[0])
    rows = np.zeros(n * width, np.int64)
    rows[:count] = ids
    flat = np.ascontiguousarray(rows.reshape(n, width).T)
    m = Model(n, alphabet)
    low, size = np.zeros(n, U), np.full(n, ~U(0))
    out, used = np.zeros((n, width * 3 + 8), np.uint16), np.zeros(n, np.int64)
    for t in range(width):
        k = int(live[t])
        x = flat[t, :k]
        m.predict(k)
        start, part = m.place(x)
        r = size[:k] >> U(TOTAL_BITS)
        low[:k] += start.astype(U) * r
        size[:k] = part.astype(U) * r
        go = _settle(low[:k], size[:k])
        while len(go):
            out[go, used[go]] = (low[go] >> U(48)).astype(np.uint16)
            used[go] += 1
            lo, si = low[go] << U(16), size[go] << U(16)
            more = _settle(lo, si)
            low[go], size[go] = lo, si
            go = go[more]
        m.learn(k, x)
    # a lane's end: the word that stands for a value inside its range with nothing but zeros behind it, or else four words
    near = (low + (TOP - U(1))) & ~(TOP - U(1))
    short = (near >= low) & (near - low < size)
    end = np.where(short, near, low)
    for i in range(4):
        some = np.flatnonzero(~short) if i else np.arange(n)
        out[some, used[some]] = ((end[some] << U(16 * i)) >> U(48)).astype(np.uint16)
        used[some] += 1
    words = out[np.arange(out.shape[1])[None] < used[:, None]]
    return used.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decode(payload: bytes, count: int, alphabet: int) -> np.ndarray:
    """The ids of one block."""
    if not count:
        return np.zeros(0, np.int64)
    width, live = _lanes(count)
    n = int(live[0])
    used = np.frombuffer(payload, "<u2", n).astype(np.int64)
    words = np.zeros((n, int(used.max()) + 8), np.uint16)
    words[np.arange(words.shape[1])[None] < used[:, None]] = np.frombuffer(payload, "<u2", int(used.sum()), 2 * n)
    m = Model(n, alphabet)
    low, size, code = np.zeros(n, U), np.full(n, ~U(0)), np.zeros(n, U)
    at = np.full(n, 4)
    for i in range(4):
        code = code << U(16) | words[:, i].astype(U)
    flat = np.zeros((width, n), np.int64)
    for t in range(width):
        k = int(live[t])
        m.predict(k)
        r = size[:k] >> U(TOTAL_BITS)
        x = m.find(np.minimum((code[:k] - low[:k]) // r, U(TOTAL - 1)).astype(np.int64))
        start, part = m.place(x)
        low[:k] += start.astype(U) * r
        size[:k] = part.astype(U) * r
        go = _settle(low[:k], size[:k])
        while len(go):
            code[go] = code[go] << U(16) | words[go, np.minimum(at[go], words.shape[1] - 1)].astype(U)
            at[go] += 1
            lo, si = low[go] << U(16), size[go] << U(16)
            more = _settle(lo, si)
            low[go], size[go] = lo, si
            go = go[more]
        flat[t, :k] = x
        m.learn(k, x)
    return flat.T.ravel()[:count]

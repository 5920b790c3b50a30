"""Suffix order and common prefixes of a byte text by induced sorting with external queues.

Suffixes that start a left-most S run (LMS suffixes) are ordered first; all others
follow from them.  A scan from the smallest suffix upwards induces the L suffixes
and one downwards the S suffixes: when a suffix is taken, the one that starts a
byte earlier is put into a priority queue under its first byte.  Priorities only
grow during a scan, so the queue is one first-in-first-out run per byte, and runs
beyond a memory bound are written to a temporary file of the task and read back
when their byte is due.  A queue entry is a tuple of position and common prefix
with the entry before it, which is one more than the least common prefix scanned
between their sources.

The order of the LMS suffixes comes from the same induction applied to unsorted
LMS suffixes, which sorts the substrings between them; these get names, and the
sequence of names is ordered by names of pairs, pairs of pairs and so on, until
names are distinct or reach over ``cap`` bytes.  Prefixes are compared up to
``cap`` bytes only; suffixes that agree so far are in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

HELD_BYTES = 64 << 20


class Queue:
    """Runs of (position, common prefix) per byte; what exceeds ``held_bytes`` lies in a temporary file."""

    def __init__(self, held_bytes: int = HELD_BYTES):
        self.runs: list[list] = [[] for _ in range(256)]
        self.left, self.file, self.written = held_bytes, None, 0

    def push(self, byte: int, position: np.ndarray, prefix: np.ndarray) -> None:
        size = 12 * len(position)
        if size <= self.left:
            self.left -= size
            self.runs[byte].append((position, prefix))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.written)
        self.file.write(position.astype(np.int64).tobytes() + prefix.astype(np.int32).tobytes())
        self.runs[byte].append((self.written, len(position)))
        self.written += size

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a, b in self.runs[byte]:
            if isinstance(a, np.ndarray):
                self.left += 12 * len(a)
                parts.append((a, b))
            else:
                self.file.seek(a)
                parts.append((np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(4 * b), np.int32)))
        self.runs[byte] = []
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=bool)
    step = text[1:].astype(np.int16) - text[:-1]
    differs = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    until = np.minimum.accumulate(differs[::-1])[::-1]
    return np.append(step, -1)[until] > 0


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, at most cap; ``words[i]`` are the 8 bytes from i, big-endian."""
    out = np.full(len(a), cap, dtype=np.int32)
    alive = np.arange(len(a))
    for at in range(0, cap, 8):
        x = words[a[alive] + at] ^ words[b[alive] + at]
        other = x != 0
        if other.any():
            z = x[other]
            shared = sum((z < np.uint64(1 << (64 - 8 * j))).astype(np.int32) for j in range(1, 8))
            out[alive[other]] = np.minimum(at + shared, cap)
            alive = alive[~other]
        if not len(alive):
            break
    # the text ends there, whatever the padding holds
    return np.minimum(out, len(words) - cap - 8 - np.maximum(a, b)).astype(np.int32)


def _words(text: np.ndarray, cap: int) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(cap + 16, dtype=np.uint8)])
    return np.ndarray((len(text) + cap + 8,), dtype=">u8", buffer=padded.tobytes(), strides=(1,))


class _Scan:
    """One direction of the induction."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = Queue()
        self.carry = np.zeros(256, dtype=np.int32)
        self.begun = np.zeros(256, dtype=bool)

    def take(self, position: np.ndarray, prefix: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Induce from scanned suffixes; returns those that fall into the byte being scanned."""
        source = np.flatnonzero(position > 0)
        before = position[source] - 1
        right = self.wanted[before]
        source, before = source[right], before[right]
        byte = self.text[before]
        order = np.argsort(byte, kind="stable")
        cuts = np.flatnonzero(np.diff(byte[order])) + 1
        carry = np.minimum(self.carry, prefix.min())
        mine = np.empty(0, np.int64), np.empty(0, np.int32)
        for group in np.split(order, cuts) if len(order) else ():
            b, at = int(byte[group[0]]), source[group]
            least = np.minimum.reduceat(prefix[: at[-1] + 1], np.append(0, at[:-1] + 1))
            least[0] = min(least[0], self.carry[b])
            found = np.minimum(least + 1, self.cap).astype(np.int32)
            if not self.begun[b]:
                found[0], self.begun[b] = 0, True
            tail = prefix[at[-1] + 1 :]
            carry[b] = tail.min() if len(tail) else self.cap
            if b == own:
                mine = before[group], found
            else:
                self.queue.push(b, before[group], found)
        self.carry = carry
        return mine


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_prefix: np.ndarray, words: np.ndarray, cap: int):
    """(suffix order, common prefix of each with the one before) from LMS suffixes in order."""
    n = len(text)
    none = np.empty(0, np.int64), np.empty(0, np.int32)
    first = text[lms]
    bounds = np.searchsorted(first, np.arange(257))
    lower, upper = [none] * 256, [none] * 256
    scan = _Scan(text, ~small, cap)
    last = int(text[n - 1])
    scan.queue.push(last, np.array([n - 1]), np.zeros(1, np.int32))
    scan.begun[last] = True
    for b in range(256):
        position, prefix = scan.queue.pop(b)
        scan.carry[:] = 0
        parts = []
        while len(position):
            parts.append((position, prefix))
            position, prefix = scan.take(position, prefix, b)
        if parts:
            lower[b] = np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
        lo, hi = bounds[b], bounds[b + 1]
        if hi > lo:
            prefix = lms_prefix[lo:hi].copy()
            prefix[0] = common_prefix(words, lower[b][0][-1:], lms[lo : lo + 1], cap)[0] if parts else 0
            scan.take(lms[lo:hi], prefix, b)
    scan.queue.close()
    scan = _Scan(text, small, cap)
    orders, prefixes = [none[0]] * 256, [none[1]] * 256
    for b in range(255, -1, -1):
        position, prefix = scan.queue.pop(b)
        scan.carry[:] = 0
        parts = []
        while len(position):
            parts.append((position, prefix))
            position, prefix = scan.take(position, prefix, b)
        if parts:
            upper[b] = np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
        low, low_prefix = lower[b]
        high, high_prefix = upper[b]
        joint = 0
        if len(low):
            if len(high):
                joint = int(common_prefix(words, low[-1:], high[-1:], cap)[0])
            scan.take(low[::-1], np.append(low_prefix[1:], joint).astype(np.int32)[::-1], b)
        orders[b] = np.concatenate([low, high[::-1]])
        # of a queue entry the prefix is that with its right neighbour
        left = np.append(high_prefix[1:], joint)[::-1] if len(high) else none[1]
        prefixes[b] = np.concatenate([low_prefix, left]).astype(np.int32)
    scan.queue.close()
    return np.concatenate(orders), np.concatenate(prefixes)


def suffix_order(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, common prefix of each with the one before it, at most cap) of a byte text."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    small, words = s_types(text), _words(text, cap)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    if not len(lms):
        return induce(text, small, lms, np.empty(0, np.int32), words, cap)
    by_byte = lms[np.argsort(text[lms], kind="stable")]
    order, _ = induce(text, small, by_byte, np.zeros(len(lms), np.int32), words, cap)
    sorted_lms = order[is_lms[order]]
    # names of the substrings up to the next LMS position
    with np.errstate(over="ignore"):
        power = np.full(n + 1, np.uint64(0x100000001B3))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.append(np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(11)) * power[:-1], dtype=np.uint64))
        end = np.append(lms[1:] + 1, n)
        value = (sums[end] - sums[lms]) * power[n - lms]
    size = end - lms
    size[-1] = n + 1  # reaches the end: like no other
    at = np.searchsorted(lms, sorted_lms)
    new = np.append(True, (value[at[1:]] != value[at[:-1]]) | (size[at[1:]] != size[at[:-1]]))
    name = np.empty(len(lms), dtype=np.int64)
    name[at] = np.cumsum(new)
    reach = 1
    while name.max() < len(lms) and 2 * reach < cap + 2:
        later = np.append(name[reach:], np.zeros(min(reach, len(lms)), np.int64))[: len(lms)]
        pair = name * (len(lms) + 1) + later
        at = np.argsort(pair, kind="stable")
        name[at] = np.cumsum(np.append(True, np.diff(pair[at]) != 0))
        reach *= 2
    ranked = lms[np.argsort(name, kind="stable")]
    prefix = np.append(0, common_prefix(words, ranked[:-1], ranked[1:], cap)).astype(np.int32)
    return induce(text, small, ranked, prefix, words, cap)

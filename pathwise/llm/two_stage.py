"""Suffix array of many short strings by two-stage sorting, and the common prefixes of adjacent suffixes."""

from __future__ import annotations

import numpy as np

#: Bytes by which suffixes are compared before they are ordered in groups.
NEAR = 28


class Strings:
    """Byte strings laid out one after another, each closed by a mark below all bytes; marks rank by position."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.begins = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.raw = b"\0".join(strings) + b"\0"
        self.data = np.frombuffer(self.raw, np.uint8).astype(np.int16) + np.int16(1)
        self.marks = self.begins + self.lengths
        self.data[self.marks] = 0
        self.close = np.repeat(self.marks, self.lengths + 1)  # where the string of each position is closed


#: What is left of eight bytes, high ones first, of which the first 0 to 7 belong to a suffix.
_TOP = np.array([0, *(((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 8))], np.uint64)


def _sevens(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes' next seven bytes, or those up to their ends, as numbers in the order of the bytes."""
    padded = raw + bytes(16)
    eights = np.ndarray((len(padded) - 8,), ">u8", buffer=padded, strides=(1,))
    left = np.clip(ends - begins, 0, 7)
    return (eights[np.minimum(begins, ends)].astype(np.uint64) & _TOP[left]) | left.astype(np.uint64)


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    inorder = x[order]
    out[order] = np.cumsum(np.concatenate([[0], inorder[1:] != inorder[:-1]]))
    return out


def _in_order(group: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """np.lexsort((at, key, group)) for differing `at`; one sort of plain numbers where all three fit 21 bits."""
    if len(at) and max(int(group.max()), int(key.max()), int(at.max())) >= 1 << 21:
        return np.lexsort((at, key, group))
    return np.argsort(group << 42 | key << 21 | at)


def _by_shift(raw: bytes, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, shared: int) -> np.ndarray:
    """The order within groups of suffixes (lo to hi, by position within a group, groups from `starts` on) that share their
    first `shared` bytes, as indices. Where a group is another one moved on by no more than these bytes, its order is that
    one's; only groups that no other decides are compared, laid out whole."""
    sizes = np.diff(np.append(starts, len(lo)))
    within = lo - np.repeat(lo[starts], sizes)
    # any function of a group's distances serves here: groups that it brings together are compared member by member
    mixed = within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    together = np.lexsort((lo[starts], np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts), sizes))
    first, many = lo[starts][together], sizes[together]
    at = np.cumsum(many) - many
    place = np.arange(len(lo)) - np.repeat(at, many)
    flat = np.repeat(starts[together], many) + place
    apart = within[flat]
    ahead = np.minimum(np.arange(len(lo)) + np.repeat(many, many), len(lo) - 1)
    moved = np.logical_and.reduceat(apart == apart[ahead], at)
    moved[:-1] &= (many[1:] == many[:-1]) & (np.diff(first) > 0) & (np.diff(first) <= shared)
    moved[-1] = False
    k = np.arange(len(together))
    decided = np.minimum.accumulate(np.where(moved, len(k), k)[::-1])[::-1]  # the next group that no other decides
    order = place.copy()
    los, his = lo[flat].tolist(), hi[flat].tolist()
    for k in np.flatnonzero(~moved).tolist():
        i, m = int(at[k]), int(many[k])
        if m == 2:
            if raw[los[i] : his[i]] > raw[los[i + 1] : his[i + 1]]:
                order[i], order[i + 1] = 1, 0
        else:
            order[i : i + m] = sorted(range(m), key=lambda x, i=i: raw[los[i + x] : his[i + x]])
    out = np.empty(len(lo), np.int64)
    out[flat] = np.repeat(starts[together], many) + order[np.repeat(at[decided], many) + place]
    return out


def _compared(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of the suffixes from begins (ascending) to ends, equal ones by position. Their first `NEAR` bytes are
    compared seven at a time, where the ones before are the same; `_by_shift` orders those that share them all."""
    n, rounds = len(begins), -(-NEAR // 7)
    out, live, group = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    places = live  # where in `out` the live ones are
    for k in range(rounds):
        if not len(live):
            return out
        key = _sevens(raw, begins[live] + 7 * k, ends[live])
        order = _in_order(group, _dense(key), live)
        live, key, group = live[order], key[order], group[order]
        out[places] = live
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(fresh)
        tied = ~(fresh & np.append(fresh[1:], True)) & ((key & np.uint64(7)) == 7)
        live, places, group = live[tied], places[tied], group[tied]
    if len(live):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[places] = live[_by_shift(raw, begins[live], ends[live], starts, 7 * rounds)]
    return out


def suffix_array(strings: Strings) -> np.ndarray:
    """All suffixes in order, marks first.

    A suffix is direct if it is smaller than its successor, the suffix one further on. Only those are sorted by
    comparison. The others are larger than their successors, so one scan of the
    buckets in order finds each right after the suffix that it precedes has its place: it is put at the front of the
    bucket of its own first byte. The scan takes whole buckets at a time; suffixes that begin with a run of the
    bucket's own byte are induced from the bucket's front, one run length after another."""
    data, n = strings.data, len(strings.data)
    step = np.sign(data[:-1] - data[1:])
    # the sign of the first difference to the right decides; a mark is never compared beyond itself
    last = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(last[::-1])[::-1]
    direct = np.ones(n, bool)
    known = nearest < n
    direct[:-1][known] = step[nearest[known]] < 0
    direct[strings.marks] = False
    sizes = np.bincount(data, minlength=258)
    heads = np.cumsum(sizes) - sizes
    out = np.empty(n, np.int64)
    out[: len(strings.marks)] = strings.marks
    front, free = heads.copy(), np.zeros(258, np.int64)
    own = np.flatnonzero(direct)
    counts = np.bincount(data[own], minlength=258)
    own = own[_compared(strings.raw, own, strings.close[own])]
    of = data[own].astype(np.int64)
    out[np.arange(len(own)) - (np.cumsum(counts) - counts)[of] + (heads + sizes - counts)[of]] = own

    def induce(found: np.ndarray, least: int) -> None:
        """Places what precedes the suffixes `found`, in order, where it is no direct one and begins with `least` at least."""
        before = found[found > 0] - 1
        before = before[~direct[before] & (data[before] >= max(least, 1))]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        many = np.bincount(first, minlength=258)
        rank = np.arange(len(before)) - np.repeat(np.cumsum(many) - many, many)
        out[front[first] + free[first] + rank] = before
        free[:] += many

    induce(out[: len(strings.marks)], 1)
    for byte in range(1, 257):
        if not sizes[byte]:
            continue
        done = 0
        while done < free[byte]:  # runs of this byte lengthen by one each time
            part = out[heads[byte] + done : heads[byte] + free[byte]].copy()
            done = int(free[byte])
            induce(part, byte)
        induce(out[heads[byte] + sizes[byte] - counts[byte] : heads[byte] + sizes[byte]].copy(), byte + 1)
    return out


def common_prefixes(strings: Strings, order: np.ndarray) -> np.ndarray:
    """For each suffix in `order` the length of the prefix that it shares with the one before it.

    A suffix that follows, one further on, a suffix whose predecessor has the same byte in front shares one byte less
    than that one does; only the others are compared, eight bytes at a time."""
    data, n = strings.data, len(strings.data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (position > 0) & (before > 0)
    at = position[inner]
    reducible[at] = (data[at - 1] == data[before[at] - 1]) & (data[at - 1] != 0)
    todo = np.flatnonzero(~reducible & (before >= 0) & (data != 0))
    shared = np.zeros(n, np.int64)
    other = before[todo]
    limit = np.minimum(strings.close[todo] - todo, strings.close[other] - other)
    padded = np.frombuffer(strings.raw + bytes(16), np.uint8)
    done = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    eights = np.ndarray((len(padded) - 8,), "<u8", buffer=padded, strides=(1,))
    while len(live):
        a, b = todo[live] + done[live], other[live] + done[live]
        differ = eights[a] ^ eights[b]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))
        bytes_same = np.where(same, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) // 8)
        done[live] = np.minimum(done[live] + bytes_same, limit[live])
        live = live[same & (done[live] < limit[live])]
    shared[todo] = done
    # a reducible suffix has what the last compared one before it has, less the distance
    base = np.where(reducible, -1, position)
    source = np.maximum.accumulate(base)
    ok = reducible & (source >= 0)
    shared[ok] = np.maximum(0, shared[source[ok]] - (position[ok] - source[ok]))
    return shared[order]

"""Bin completion on a histogram: how many bins of one capacity, filled with which lengths.

Items of one length are alike, so a corpus is a histogram of at most `capacity` lengths, and a packing is a list of
fillings with multiplicities. Around the largest length left, all undominated fillings are enumerated, least waste first;
the search takes each as often as it can, prunes where the waste so far rules out fewer bins than the best packing known,
and starts from best-fit decreasing as that packing. A search that ends by itself is exact. One that meets its budget of
decisions goes on with parts of the best packing: bins with waste and some without are taken apart and completed anew.
The budget bounds the search, never the packing, which always covers the histogram.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

Filling = tuple[int, ...]
#: Decisions of the first search, in multiples of the distinct lengths, and beside that; of the search in a part of the best
#: packing beside one a bin; how many parts in a row may bring nothing, and how many there are. Looking at LOOKS fillings
#: counts as a decision.
DECISIONS, MORE_DECISIONS, PART_DECISIONS, IDLE, PARTS, LOOKS = 2, 1000, 150, 120, 400, 10


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each length into the fullest bins that still take it, all bins of a kind at once."""
    bins: dict[int, dict[Filling, int]] = {}
    rooms: list[int] = []  # the free room of open bins, ascending

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in bins:
            bins[room] = {}
            insort(rooms, room)
        bins[room][filling] = bins[room].get(filling, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                whole, rest = divmod(left, per)
                for n, k in ((whole, per), (1 if rest else 0, rest)):
                    if n:
                        put(capacity - k * length, (length,) * k, n)
                break
            room = rooms[at]
            filling, have = bins[room].popitem()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            n = min(have, left)
            put(room - length, (*filling, length), n)
            if have > n:
                put(room, filling, have - n)
            left -= n
    return [(f, n) for kinds in bins.values() for f, n in kinds.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound by waste that large items force (over all thresholds)."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    big = sum(n for k, n in counts.items() if 2 * k > capacity)
    lengths = sorted(counts)
    for t in [k for k in lengths if 2 * k <= capacity]:
        large = sum(n for k, n in counts.items() if k > capacity - t)
        mid = {k: n for k, n in counts.items() if capacity - t >= k and 2 * k > capacity}
        small = sum(k * n for k, n in counts.items() if t <= k and 2 * k <= capacity)
        room = sum(n for n in mid.values()) * capacity - sum(k * n for k, n in mid.items())
        best = max(best, large + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return max(best, big)


def sums(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Per place in the falling lengths the sums up to `room` of the items from there on, as the bits of a number."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for k in reversed(lengths):
        bits, left, step = out[-1], min(counts[k], room // k), 1
        while left > 0:
            n = min(step, left)
            bits |= (bits << (k * n)) & mask
            left, step = left - n, 2 * step
        out.append(bits)
    return out[::-1]


def dominated(filling: Counter, first: int, counts: dict[int, int], lengths: list[int], room: int) -> bool:
    """Whether one item at hand could join the filling, or replace some of its items beside `first` that are as large
    together at most: then what is left is no harder to pack with that filling. lengths: rising, of what is at hand."""

    def at_hand(low: int, high: int, but: int = 0) -> bool:
        i = bisect_left(lengths, low)
        while i < len(lengths) and lengths[i] <= high:
            k = lengths[i]
            if k != but and counts[k] - filling[k] - (k == first) > 0:
                return True
            i += 1
        return False

    if at_hand(1, room) or any(at_hand(k + 1, k + room, k) for k in filling):
        return True
    one, more = 0, 0  # sums of exactly one item and of several
    for k, n in filling.items():
        for c in range(n):
            more |= (more << k) | (one << k)
            one |= 1 << k
    top = max(filling, default=0)
    while more:
        s = (more & -more).bit_length() - 1
        if s > lengths[-1]:
            return False
        if at_hand(s, s + room):
            return True
        more &= more - 1
    return top > lengths[-1]


def fillings(counts: dict[int, int], capacity: int, allowed: Callable[[], int], look: Callable[[], bool] = lambda: True) -> Iterator[Filling]:
    """Undominated fillings of a bin around the largest length, least waste first, then larger items first; none with more
    waste than allowed(). Lengths are taken with their multiplicities at once, and only where the sum can still be met.
    look() is asked before each filling that is looked at, and ends the enumeration when it is false."""
    first, room = max(counts), capacity - max(counts)
    at_hand = sorted(k for k in counts if k <= room)
    lengths = at_hand[::-1]
    left = {k: counts[k] - (k == first) for k in lengths}
    reach = sums(left, lengths, room)

    def grow(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        i = max(i, len(lengths) - bisect_right(at_hand, rest))
        while i < len(lengths):
            if not reach[i] >> rest & 1:
                return
            k = lengths[i]
            for n in range(min(left[k], rest // k), 0, -1):
                if reach[i + 1] >> (rest - n * k) & 1:
                    for more in grow(i + 1, rest - n * k):
                        yield (k,) * n + more
            i += 1

    for waste in range(room + 1):
        if waste > allowed():
            return
        if reach[0] >> (room - waste) & 1:
            for f in grow(0, room - waste):
                if not look():
                    return
                if not at_hand or not dominated(Counter(f), first, counts, at_hand, waste):
                    yield (first, *f)


def search(counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], bound: int, decisions: int, rng: random.Random | None = None) -> tuple[list[tuple[Filling, int]], bool]:
    """Depth first over fillings with multiplicities: a packing of fewer bins than `best`, or best itself; and whether that is
    proven to be the least. With rng, some fillings are passed over on the way down."""
    best_bins, total = sum(n for _, n in best), sum(k * n for k, n in counts.items())
    left, done, used, waste = dict(counts), [], 0, 0
    looks = decisions * LOOKS  # what is left of the budget

    def look() -> bool:
        nonlocal looks
        looks -= 1
        return looks > 0

    def allowed() -> int:
        return (best_bins - 1) * capacity - total - waste

    def options() -> Iterator[tuple[Filling, int]]:
        seen = []
        for f in fillings(left, capacity, allowed, look):
            c = Counter(f)
            n = min(left[k] // m for k, m in c.items())
            if rng is None or rng.random() < 0.85:
                yield f, n
            else:
                seen.append((f, n + 1))
            seen.append((f, n))
        for f, n in seen:
            for m in range(n - 1, 0, -1):
                yield f, m

    def take(f: Filling, n: int) -> None:
        for k, m in Counter(f).items():
            left[k] = left.get(k, 0) - n * m
            if not left[k]:
                del left[k]

    stack = [options()]
    while stack and best_bins > bound:
        got = next(stack[-1], None)
        if looks <= 0:
            return best, False
        if got is None:
            stack.pop()
            if done:
                f, n, waste = done.pop()
                used -= n
                take(f, -n)
            continue
        f, n = got
        lost = n * (capacity - sum(f))
        if lost > allowed():
            continue
        looks -= LOOKS
        if looks <= 0:
            return best, False
        take(f, n)
        done.append((f, n, waste))
        used, waste = used + n, waste + lost
        if left:
            stack.append(options())
            continue
        if used < best_bins:
            best, best_bins = [(g, m) for g, m, _ in done], used
        f, n, waste = done.pop()
        used -= n
        take(f, -n)
    return best, looks > 0 or best_bins <= bound


def histogram(packing: list[tuple[Filling, int]]) -> Counter:
    out: Counter = Counter()
    for f, n in packing:
        for k in f:
            out[k] += n
    return out


def pack(counts: dict[int, int], capacity: int, decisions: int | None = None, parts: int = PARTS) -> list[tuple[Filling, int]]:
    """(filling, multiplicity) covering the histogram exactly, with as few bins as the search finds.

    An empty histogram gives none; lengths outside 1 to capacity are an error.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must lie between 1 and the capacity")
    decisions = DECISIONS * len(counts) + MORE_DECISIONS if decisions is None else decisions
    bound = lower_bound(counts, capacity)
    found, proven = search(counts, capacity, best_fit(counts, capacity), bound, decisions)
    best = Counter()
    for f, n in found:
        best[tuple(sorted(f, reverse=True))] += n
    rng, idle = random.Random(1), 0
    for _ in range(0 if proven else parts):
        if best.total() <= bound or idle >= IDLE:
            break
        idle += 1
        # bins with waste and some without, a few copies of each, are completed anew; the others stay
        poor = [f for f, n in best.items() if sum(f) < capacity for _ in range(min(n, 3))]
        full = [f for f, n in best.items() if sum(f) == capacity for _ in range(min(n, 2))]
        part = Counter(rng.sample(poor, min(len(poor), rng.choice((8, 20, 80)))) + rng.sample(full, min(len(full), rng.choice((8, 20, 60, 200)))))
        again = dict(histogram(list(part.items())))
        least = lower_bound(again, capacity)
        if least >= part.total():
            continue
        found, _ = search(again, capacity, list(part.items()), least, part.total() + PART_DECISIONS, rng)
        if sum(n for _, n in found) < part.total():
            idle, times = 0, min(best[f] // n for f, n in part.items())  # the same again wherever these fillings occur together
            best -= Counter({f: n * times for f, n in part.items()})
            for f, n in found:
                best[tuple(sorted(f, reverse=True))] += n * times
    return list(best.items())

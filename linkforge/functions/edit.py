"""Edit measures of many pairs of strings at once, in numpy.

A call gets two lists of distinct strings and the pairs' positions in them. Longest common subsequences run over all pairs in
step, one character of the second strings at a time, on bit vectors (Hyyro 2004) of as many 64-bit words as the first
strings need; the bit masks of a tile's first strings are a table by string and character, bounded by MASKS words.
Pairs are worked off in tiles, so memory doesn't grow with the batch.

Windows of two strings that have fewer than 256 characters together are compared by semi-local sequences (Tiskin 2008): one pass over all pairs,
in bytes, tells the common subsequences of all windows.
"""

from __future__ import annotations

import numpy as np

#: Pairs of a tile, windows of a tile, and words of its table of masks.
PAIRS, WINDOWS, MASKS = 8192, 1 << 17, 1 << 22
#: Characters below it are looked up in a table, others searched for.
LOOKUP = 1 << 14
#: Pairs of a tile of strands, and characters of both strings whose strands have numbers of a byte.
STRANDS, BYTE = 1 << 14, 255
#: Distinct tokens of a side that are bits of a number.
TOKENS = 16


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of code points, filled up with -1, and the lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full((len(strings), int(lengths.max(initial=0))), -1, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


class _Masks:
    """Bit masks of strings by character: where each of its characters stands."""

    def __init__(self, own: np.ndarray, lengths: np.ndarray) -> None:
        self.words = max(1, -(-own.shape[1] // 64))
        self.letters = np.unique(own[own >= 0])
        if len(self.letters) and self.letters[-1] < LOOKUP:
            # The last one is for what no string has, and for what fills rows up (-1).
            self.lookup = np.zeros(self.letters[-1] + 2, dtype=np.int64)
            self.lookup[self.letters] = np.arange(1, len(self.letters) + 1)
        self.table = np.zeros((self.words, len(own), len(self.letters) + 1), dtype=np.uint64)
        codes, row = self.code(own), np.arange(len(own))
        for at in range(own.shape[1]):
            self.table[at // 64, row, codes[:, at]] |= np.uint64(1) << np.uint64(at % 64)
        self.table[:, :, 0] = 0
        self.lengths = lengths

    def code(self, points: np.ndarray) -> np.ndarray:
        """Columns of the table: 0 for what no string has."""
        if not len(self.letters):
            return np.zeros(points.shape, dtype=np.int64)
        if self.letters[-1] < LOOKUP:
            return self.lookup[np.where(points < len(self.lookup), points, -1)]
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0)


def _common(masks: _Masks, of: np.ndarray, column, steps: int) -> np.ndarray:
    """Longest common subsequences of strings `of` with sequences whose characters of step t are column(t)."""
    state = np.full((masks.words, len(of)), np.iinfo(np.uint64).max, dtype=np.uint64)
    for t in range(steps):
        codes, carry = column(t), None
        for w in range(masks.words):
            s = state[w]
            hit = s & masks.table[w, of, codes]
            total = s + hit
            if masks.words > 1:
                over = total < s
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            state[w] = total | (s - hit)
    out = np.zeros(len(of), dtype=np.int64)
    for w in range(masks.words):
        bits = np.clip(masks.lengths[of] - 64 * w, 0, 64).astype(np.uint64)
        inside = np.where(bits == 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        out += np.bitwise_count(~state[w] & inside)
    return out


def _tiles(codes: np.ndarray, lengths: np.ndarray, of: np.ndarray, weight: np.ndarray, most: int):
    """Pairs in tiles of like lengths: positions, and the masks and numbers of their first strings."""
    order = np.lexsort((of, (lengths[of] + 63) // 64))
    begin = 0
    while begin < len(order):
        words = -(-int(lengths[of[order[begin]]]) // 64) or 1
        size = min(PAIRS, len(order) - begin)
        while True:
            at = order[begin : begin + size]
            at = at[(lengths[of[at]] + 63) // 64 <= max(words, 1)]
            own, number = np.unique(of[at], return_inverse=True)
            wide = int(lengths[own].max(initial=0))
            letters = len(np.unique(codes[own, :wide])) + 1
            if len(at) <= 1 or (len(own) * letters * words <= MASKS and int(weight[at].sum()) <= most):
                break
            size = len(at) // 2
        yield at, _Masks(codes[own, :wide], lengths[own]), number
        begin += len(at)


def common_subsequence(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of first[i] and second[j]."""
    (x, n), (y, m) = _codes(first), _codes(second)
    out = np.zeros(len(i), dtype=np.int64)
    for at, masks, number in _tiles(x, n, i, np.ones(len(i), np.int64), PAIRS):
        own = masks.code(y[j[at]])
        out[at] = _common(masks, number, lambda t, own=own: own[:, t], int(m[j[at]].max(initial=0)))
    return out


def ratio(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """200 * LCS / (sum of lengths); 100 for two empty strings."""
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second))
    total = n[i] + m[j]
    return np.where(total == 0, 100.0, 200.0 * common_subsequence(first, second, i, j) / np.maximum(total, 1))


def _renamed(strings: list[str], rule) -> tuple[list[str], np.ndarray]:
    """The distinct results of a rule, and which each string has."""
    seen: dict[str, int] = {}
    at = np.fromiter((seen.setdefault(rule(s), len(seen)) for s in strings), np.int64, len(strings))
    return list(seen), at


def token_sort_ratio(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    rule = lambda s: " ".join(sorted(s.split()))
    (a, x), (b, y) = _renamed(first, rule), _renamed(second, rule)
    return ratio(a, b, x[i], y[j])


def token_set_ratio(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Ratio of the shared tokens with each side's others; 100 if they are one side's all, 0 if a side has none."""
    x, y = ([sorted(set(s.split())) for s in side] for side in (first, second))
    out = np.zeros(len(i))
    many = [np.fromiter(map(len, side), np.int64, len(side)) for side in (x, y)]
    few = (many[0][i] <= TOKENS) & (many[1][j] <= TOKENS)
    for at, of in ((np.flatnonzero(few), _token_sets), (np.flatnonzero(~few), _token_sets_singly)):
        if len(at):
            out[at] = of(x, y, i[at], j[at])
    return out


def _token_sets(x: list[list[str]], y: list[list[str]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of sets of TOKENS tokens at most: what both have are bits of either side, and equal beginnings of texts are their common subsequence."""
    known: dict[str, int] = {}

    def coded(side: list[list[str]], of: np.ndarray, fill: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        used, at = np.unique(of, return_inverse=True)
        sets = [side[k] for k in used]
        codes = np.full((len(sets), max(map(len, sets))), fill, dtype=np.int64)
        for row, tokens in zip(codes, sets, strict=True):
            row[: len(tokens)] = [known.setdefault(t, len(known)) for t in tokens]
        return sets, codes, np.fromiter(map(len, sets), np.int64, len(sets)), at

    (xs, a, n, i), (ys, b, m, j) = coded(x, i, -1), coded(y, j, -2)
    length = np.array([*map(len, known), 0], dtype=np.int64)
    in_a, in_b, both, shared = (np.zeros(len(i), np.int64) for _ in range(4))
    for k in range(a.shape[1]):
        own = a[i, k]
        for t in range(b.shape[1]):
            hit = own == b[j, t]
            in_a |= hit.astype(np.int64) << k
            in_b |= hit.astype(np.int64) << t
            both += np.where(hit, length[own] + 1, 0)
            shared += hit
    both = np.maximum(both - 1, 0)
    some = (n[i] > 0) & (m[j] > 0)
    whole = some & (shared > 0) & ((shared == n[i]) | (shared == m[j]))
    out = np.where(whole, 100.0, 0.0)
    at = np.flatnonzero(some & ~whole)
    if not len(at):
        return out

    def others(sets: list[list[str]], of: np.ndarray, taken: np.ndarray) -> tuple[list[str], np.ndarray]:
        cases, which = np.unique(of << TOKENS | taken, return_inverse=True)
        return [" ".join(t for k, t in enumerate(sets[c >> TOKENS]) if not c >> k & 1) for c in cases.tolist()], which

    (left, p), (right, q) = others(xs, i[at], in_a[at]), others(ys, j[at], in_b[at])
    (pairs, of), both = np.unique(p * len(right) + q, return_inverse=True), both[at]
    rest = common_subsequence(left, right, *np.divmod(pairs, len(right)))[of]
    start = both + (both > 0)
    one, two = (start + np.fromiter(map(len, side), np.int64, len(side))[k] for side, k in ((left, p), (right, q)))
    out[at] = np.maximum(200.0 * both / np.maximum(both + np.minimum(one, two), 1), 200.0 * (start + rest) / (one + two))
    return out


def _token_sets_singly(x: list[list[str]], y: list[list[str]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = ([set(s) for s in side] for side in (x, y))
    out = np.zeros(len(i))
    ones: dict[str, int] = {}
    twos: dict[str, int] = {}
    at, a, b = [], [], []
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        s, t = x[p], y[q]
        if not s or not t:
            continue
        both, left, right = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
        if both and not (left and right):
            out[k] = 100.0
            continue
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        if both:  # it begins both, so that it is their common subsequence
            out[k] = 200.0 * len(both) / (len(both) + min(len(one), len(two)))
        at.append(k)
        a.append(ones.setdefault(one, len(ones)))
        b.append(twos.setdefault(two, len(twos)))
    if at:
        out[at] = np.maximum(out[at], ratio(list(ones), list(twos), np.array(a), np.array(b)))
    return out


def _best_window(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs with first[i] no longer than second[j], both not empty: the best ratio with a window of second[j].

    Windows are as long as first[i], or cut off at either end.
    """
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second))
    few = n[i] + m[j] <= BYTE
    out = np.zeros(len(i))
    for at, of in ((np.flatnonzero(few), _best_by_strands), (np.flatnonzero(~few), _best_by_window)):
        if len(at):
            # Only strings that these pairs have: a long one widens all others' rows.
            (x, a), (y, b) = (np.unique(k[at], return_inverse=True) for k in (i, j))
            out[at] = of([first[k] for k in x], [second[k] for k in y], a, b)
    return out


def _best_by_strands(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_best_window of strings of at most BYTE characters together.

    Strands enter the grid of both strings from the left, upwards, and from above, and cross once at most, never where characters are equal. The longest
    common subsequence with second[b:e] is e - b less the strands that enter from above at b or later and leave below before e.
    """
    (x, n), (y, m) = _codes(first), _codes(second)
    letters, codes = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    kind = np.uint8 if len(letters) <= BYTE else np.int32
    a, b = codes[: x.size].reshape(x.shape).astype(kind), codes[x.size :].reshape(y.shape).astype(kind)
    out = np.zeros(len(i))
    order = np.lexsort((m[j], n[i]))
    begin = 0
    while begin < len(order):
        at = order[begin : begin + STRANDS]
        # What fills up the shorter rows equals nothing: rows of a tile are as wide as its longest, so numbers of strands may need it cut.
        short, long_ = n[i[at]], m[j[at]]
        fits = np.maximum.accumulate(short) + np.maximum.accumulate(long_) <= BYTE
        size = len(at) if fits.all() else int(np.argmin(fits))
        at, short, long_ = at[:size], short[:size], long_[:size]
        begin += size
        high, wide = int(short.max()), int(long_.max())
        left, above = np.ascontiguousarray(a[i[at], :high].T), np.ascontiguousarray(b[j[at], :wide].T)
        filled = np.arange(wide)[:, None] >= long_
        strand = np.empty((wide, size), np.uint8)
        strand[:] = high + np.arange(wide, dtype=np.uint8)[:, None]
        h, total, equal = np.empty((3, size), np.uint8)
        fits = equal.view(bool)
        for r in range(high):
            h[:] = high - 1 - r
            own = left[r]
            for c in range(wide):
                v = strand[c]
                np.equal(own, above[c], out=fits)
                np.negative(equal, out=equal)
                np.add(h, v, out=total)
                np.bitwise_or(h, equal, out=h)
                np.minimum(h, v, out=h)
                np.subtract(total, h, out=v)
        strand[filled] = 0
        # Pairs are in the order of the first strings' lengths: windows of one length are told together.
        heads = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        for lo, hi in zip(heads, np.r_[heads[1:], size], strict=True):
            out[at[lo:hi]] = _best_of_strands(strand[:, lo:hi], high, int(short[lo]), long_[lo:hi])
    return out


def _best_of_strands(strand: np.ndarray, high: int, short: int, long_: np.ndarray) -> np.ndarray:
    """The best ratio of strings of `short` characters with windows of strings of long_, by the strands that leave below (0: beyond the end)."""
    wide, size = strand.shape
    best, full = np.zeros(size), np.zeros(size, np.uint8)
    later = np.empty(size, bool)
    for begin in range(wide):
        through = np.zeros(size, np.uint8)
        for c in range(begin, min(begin + short, wide)):
            np.greater_equal(strand[c], high + begin, out=later)
            np.add(through, later.view(np.uint8), out=through)
            if not begin and c < short - 1:
                np.maximum(best, 200.0 * (c + 1 - through) / (short + c + 1), out=best)
        inside = np.clip(long_ - begin, 0, short)
        whole = inside == short
        np.maximum(full, np.where(whole, short - through, 0).astype(np.uint8), out=full)
        if not whole.all():
            np.maximum(best, np.where(whole, 0.0, 200.0 * (inside - through) / (short + inside)), out=best)
    return np.maximum(best, 200.0 * full / (short + short))


def _best_by_window(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_best_window of strings of any length, a window at a time.

    A window that ends (cut off in front) or else begins with a
    character that first[i] lacks isn't looked at: without that character, or one further, it is no worse.
    """
    (x, n), (y, m) = _codes(first), _codes(second)
    out = np.zeros(len(i))
    for at, masks, number in _tiles(x, n, i, n[i] + m[j], WINDOWS):
        short, long_ = n[i[at]], m[j[at]]
        own = masks.code(y[j[at]])
        wide = own.shape[1]
        each = short + long_ - 1
        pair = np.repeat(np.arange(len(at)), each)
        begin = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each) - short[pair] + 1
        end = np.minimum(begin + short[pair], long_[pair])
        decisive = np.where(begin < 0, end - 1, begin)
        begin = np.maximum(begin, 0)
        code = own[pair, decisive]
        found = np.zeros(len(pair), dtype=bool)
        for w in range(masks.words):
            found |= masks.table[w, number[pair], code] != 0
        pair, begin, end = pair[found], begin[found], end[found]

        def column(t: int, own=own, pair=pair, begin=begin, end=end, wide=wide) -> np.ndarray:
            return np.where(begin + t < end, own[pair, np.minimum(begin + t, wide - 1)], 0)

        common = _common(masks, number[pair], column, int((end - begin).max(initial=0)))
        best = np.zeros(len(at))
        np.maximum.at(best, pair, 200.0 * common / (short[pair] + end - begin))
        out[at] = best
    return out


def partial_ratio(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter string with a window of the longer; of equally long ones, both ways."""
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second))
    short, long_ = n[i], m[j]
    out = np.where((short == 0) & (long_ == 0), 100.0, 0.0)
    some = (short > 0) & (long_ > 0)
    for at, swap in ((np.flatnonzero(some & (short <= long_)), False), (np.flatnonzero(some & (long_ <= short)), True)):
        if len(at):
            found = _best_window(second, first, j[at], i[at]) if swap else _best_window(first, second, i[at], j[at])
            out[at] = np.maximum(out[at], found)
    return out


def jaro_winkler(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Prefix scale 0.1 over 4 characters at most, added above a Jaro of 0.7. Strings of more than 64 characters go one by one."""
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second))
    out = np.zeros(len(i))
    long_ = (n[i] > 64) | (m[j] > 64)
    for k in np.flatnonzero(long_).tolist():
        out[k] = jaro_winkler_of(first[i[k]], second[j[k]])
    rest = np.flatnonzero(~long_)
    x = _codes([s[:64] for s in first])[0]
    y = _codes([s[:64] for s in second])[0]
    for at, masks, number in _tiles(y, np.minimum(m, 64), j[rest], np.ones(len(rest), np.int64), PAIRS):
        at = rest[at]
        out[at] = _jaro_winkler(masks, number, masks.code(x)[i[at]], x[i[at]], y[j[at]], n[i[at]], m[j[at]])
    return out


def _jaro_winkler(masks: _Masks, number: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    one, zero = np.uint64(1), np.uint64(0)
    below = np.concatenate([(one << np.arange(64, dtype=np.uint64)) - one, [np.iinfo(np.uint64).max]])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    taken, left = np.zeros(len(n), np.uint64), np.zeros((own.shape[1], len(n)), dtype=bool)
    for t in range(own.shape[1]):
        near = below[np.clip(t + reach + 1, 0, m)] & ~below[np.clip(t - reach, 0, 64)]
        free = np.where(t < n, masks.table[0, number, own[:, t]] & near & ~taken, zero)
        bit = free & (~free + one)
        taken |= bit
        left[t] = bit != 0
    common = np.bitwise_count(taken).astype(np.int64)
    swaps = np.zeros(len(n), np.int64)
    for t in range(own.shape[1]):
        bit = np.where(left[t], taken & (~taken + one), zero)
        swaps += left[t] & ((masks.table[0, number, own[:, t]] & bit) == 0)
        taken ^= bit
    swaps //= 2
    some = np.maximum(common, 1)
    jaro = np.where(common > 0, (common / np.maximum(n, 1) + common / np.maximum(m, 1) + (common - swaps) / some) / 3, 0.0)
    wide = min(4, x.shape[1], y.shape[1])
    same = np.cumprod((x[:, :wide] == y[:, :wide]) & (x[:, :wide] >= 0), axis=1).sum(axis=1) if wide else np.zeros(len(n), np.int64)
    out = np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)
    equal = (n == m) & ((n == 0) | (same >= np.minimum(n, 4)) & (common == n) & (swaps == 0))
    return np.where(equal, 1.0, out)


def jaro_winkler_of(a: str, b: str) -> float:
    """One pair of strings of any length."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)

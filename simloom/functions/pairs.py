"""Vectorised kernels over many pairs of strings (no Spark).

Pairs are handled in groups of similar length; every step of the dynamic
programs below works on all pairs of a group at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Cells of padded characters that a group may have.
GROUP_CELLS = 4_000_000
#: Bonus of a common prefix: least Jaro score, longest prefix, greatest scale.
BONUS_FROM, BONUS_PREFIX, BONUS_SCALE = 0.7, 4, 0.25


def _codes(strings: Sequence[str], sizes: np.ndarray, width: int) -> np.ndarray:
    """A row of code points for each string, zeros after its end; as small as they fit."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint16 if flat.max() < 65536 else np.uint32
    out = np.zeros((len(strings), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _grouped(a: Sequence[str | None], b: Sequence[str | None], work: Callable, kind, missing) -> np.ndarray:
    """``work`` on groups of pairs; null pairs give ``missing``."""
    out = np.full(len(a), missing, kind)
    lengths = np.stack([np.fromiter((-1 if x is None else len(x) for x in side), np.int64, len(side)) for side in (a, b)], axis=1)
    lengths[(lengths < 0).any(axis=1)] = -1
    order = np.lexsort((lengths[:, 1], lengths[:, 0]))
    order = order[lengths[order, 0] >= 0]
    start = 0
    while start < len(order):
        # rows are in order of the first length; a group takes those that aren't much longer and fit with their padding
        rest = lengths[order[start:]]
        wide_a, wide_b = rest[:, 0], np.maximum.accumulate(rest[:, 1])
        grown = (wide_a > 2 * rest[0, 0] + 8) | (np.arange(1, len(rest) + 1) * (wide_a + 1) * (wide_b + 1) > GROUP_CELLS)
        grown[0] = False
        end = start + (int(grown.argmax()) if grown.any() else len(rest))
        some = order[start:end]
        sizes = lengths[some]
        x, y = (_codes([side[k] for k in some.tolist()], sizes[:, i], int(sizes[:, i].max())) for i, side in enumerate((a, b)))
        out[some] = work(x, y, sizes[:, 0], sizes[:, 1])
        start = end
    return out


def _osa(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, swaps: bool = True) -> np.ndarray:
    """The table of distances row by row, each of its columns over all pairs.

    What comes from the row above is found for a whole row at once; what comes
    from the left is a running minimum of value minus column, plus the column.
    """
    rows, width = len(a), b.shape[1]
    kind = np.int16 if max(a.shape[1], width) < 16_000 else np.int64
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # a character of all pairs is one run of memory
    result = np.where(la == 0, lb, 0)
    steps = np.arange(width + 1, dtype=kind)[:, None]
    two_up, up = None, np.repeat(steps, rows, axis=1)
    before = None
    for i in range(1, len(a) + 1):
        same = b == a[i - 1]
        row = np.empty((width + 1, rows), kind)
        row[0] = i
        np.minimum(up[1:] + kind(1), up[:-1] + ~same, out=row[1:])
        if swaps and i > 1 and width > 1:
            swapped = same[:-1] & before[1:]
            row[2:] = np.where(swapped, np.minimum(row[2:], two_up[:-2] + kind(1)), row[2:])
        row -= steps
        np.minimum.accumulate(row, axis=0, out=row)
        row += steps
        two_up, up, before = up, row, same
        done = np.flatnonzero(la == i)
        result[done] = row[lb[done], done]
    return result


def osa_distances(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """Edits with swaps of neighbours, no part edited twice; -1 for null pairs."""
    return _grouped(a, b, _osa, np.int64, -1)


def levenshtein_distances(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """Plain edits; -1 for null pairs."""
    return _grouped(a, b, lambda *x: _osa(*x, swaps=False), np.int64, -1)


def _jaro(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Greedy matches from the left, a character of all first strings at a time.

    Up to 63 characters the free places of the second string are bits of a word.
    """
    rows = len(a)
    if not a.shape[1] or not b.shape[1]:
        return np.where((la == 0) & (lb == 0), 1.0, 0.0)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a, used_b = (_by_words if b.shape[1] <= 63 else _by_cells)(a, b, la, lb, reach)
    m = used_a.sum(axis=1)
    # the k-th matched character of each side, padded: those that differ are half the transpositions
    nth = lambda used: np.cumsum(used, axis=1) - 1
    longest = int(m.max(initial=0))
    front = []
    for x, used in ((a, used_a), (b, used_b)):
        r, c = np.nonzero(used)
        f = np.zeros((rows, longest), np.uint32)
        f[r, nth(used)[r, c]] = x[r, c]
        front.append(f)
    swaps = (front[0] != front[1]).sum(axis=1) // 2
    width = min(a.shape[1], b.shape[1])
    equal = (la == lb) & (a[:, :width] == b[:, :width]).all(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mf = m.astype(np.float64)
        score = (mf / la + mf / lb + (mf - swaps) / mf) / 3.0
    score = np.where((m == 0) | (la == 0) | (lb == 0), 0.0, score)
    return np.where(equal, 1.0, score)


def _by_words(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = np.ascontiguousarray(b.T)
    one = np.uint64(1)
    below = lambda n: (one << n.clip(0, 63).astype(np.uint64)) - one
    free = below(lb)
    used_a = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        place = np.zeros(len(a), np.uint64)
        for j in range(max(0, i - int(reach.max())), min(len(columns), i + int(reach.max()) + 1)):
            place |= (columns[j] == a[:, i]).astype(np.uint64) << np.uint64(j)
        place &= free & ~below(i - reach) & below(i + reach + 1)
        place[i >= la] = 0
        used_a[:, i] = place != 0
        free &= ~(place & (~place + one))  # the first place
    taken = below(lb) & ~free
    used_b = ((taken[:, None] >> np.arange(b.shape[1], dtype=np.uint64)) & one).astype(bool)
    return used_a, used_b


def _by_cells(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used_a, used_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    columns = np.arange(b.shape[1])
    for i in range(a.shape[1]):
        window = (columns >= (i - reach)[:, None]) & (columns <= (i + reach)[:, None]) & (columns < lb[:, None])
        fits = window & ~used_b & (a[:, i : i + 1] == b) & (i < la)[:, None]
        hit = np.flatnonzero(fits.any(axis=1))
        used_a[hit, i] = True
        used_b[hit, fits.argmax(axis=1)[hit]] = True
    return used_a, used_b


def jaro_scores(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """Jaro similarity, matched greedily from the left; NaN for null pairs."""
    return _grouped(a, b, _jaro, np.float64, np.nan)


def prefix_bonus(jaro: np.ndarray, a: Sequence[str | None], b: Sequence[str | None], scale: float) -> np.ndarray:
    """Winkler's bonus for a common prefix of up to four characters."""
    prefix = np.zeros(len(jaro))
    near = np.flatnonzero(jaro >= BONUS_FROM)
    for k, x, y in zip(near.tolist(), [a[k] for k in near.tolist()], [b[k] for k in near.tolist()], strict=True):
        if x[:BONUS_PREFIX] == y[:BONUS_PREFIX]:
            prefix[k] = min(len(x), BONUS_PREFIX)
        else:
            n = 0
            while n < len(x) and n < len(y) and x[n] == y[n]:
                n += 1
            prefix[k] = n
    return np.where(jaro >= BONUS_FROM, jaro + prefix * min(scale, BONUS_SCALE) * (1.0 - jaro), jaro)

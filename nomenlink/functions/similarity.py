"""String and vector similarity.

Levenshtein, token handling and cosine are Spark expressions. Only the
measures Spark lacks cross into Python; Spark sends all those of one select
in the same Arrow batches, and each batch computes every distinct pair of
strings once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from nomenlink.functions.names import company_name_norm

# --- fixed values of the Jaro-Winkler measure ---------------------------------
PREFIX_LENGTH = 4
PREFIX_WEIGHT = 0.1
BOOST_ABOVE = 0.7
# --- fixed value of block matching: texts from this length have popular places
POPULAR_FROM = 200
# --- fixed value of the cosine measure
NORM_FLOOR = 1e-12

# Cells of the largest matrix, and characters of the windows held; bounds memory only.
_CELLS = 1 << 21

# ---------------------------------------------------------------------------
# Kernels on arrays


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as a zero-padded matrix, and their lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int32, count=len(texts))
    width = max(1, int(lengths.max(initial=0)))
    matrix = np.zeros((len(texts), width), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    matrix[np.arange(width) < lengths[:, None]] = flat
    return matrix, lengths


def jaro_winkler_to(text: str, matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Jaro-Winkler similarity of one text to every row of an encoded matrix."""
    la = len(text)
    out = np.zeros(len(lengths))
    if la == 0 or len(lengths) == 0:
        return out
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    width = matrix.shape[1]
    reach = np.maximum(np.maximum(lengths, la) // 2 - 1, 0)
    columns = np.arange(width)
    free = columns < lengths[:, None]
    matched_a = np.zeros((len(lengths), la), dtype=bool)
    rows = np.arange(len(lengths))
    for i in range(la):
        hit = (matrix == code[i]) & free
        if not hit.any():
            continue
        hit &= np.abs(columns - i) <= reach[:, None]
        first = hit.argmax(axis=1)
        found = hit[rows, first]
        matched_a[found, i] = True
        free[rows[found], first[found]] = False
    common = matched_a.sum(axis=1)
    some = np.flatnonzero(common)
    if len(some) == 0:
        return out
    m = common[some].astype(float)
    matched_b = (columns < lengths[some, None]) & ~free[some]
    # Matched characters of both sides, moved to the front in their order.
    order_a = np.argsort(~matched_a[some], axis=1, kind="stable")
    order_b = np.argsort(~matched_b, axis=1, kind="stable")
    depth = int(common[some].max())
    side_a = code[order_a[:, :depth]]
    side_b = np.take_along_axis(matrix[some], order_b[:, :depth], axis=1)
    moved = ((side_a != side_b) & (np.arange(depth) < common[some, None])).sum(axis=1) // 2
    jaro = (m / la + m / lengths[some] + (m - moved) / m) / 3
    head = min(PREFIX_LENGTH, la, width)
    same = (matrix[some, :head] == code[:head]) & (np.arange(head) < lengths[some, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    out[some] = np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)
    return out


def _groups(widths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in the order of their widths, as many at a time as fit one matrix of ``_CELLS``."""
    order = np.argsort(widths, kind="stable")
    begin = 0
    while begin < len(order):
        fits = np.arange(1, len(order) - begin + 1) * (widths[order[begin:]] + 1) <= _CELLS
        end = begin + max(1, int(fits.sum()))
        yield order[begin:end]
        begin = end


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair; one step takes the next letter of every left text."""
    out = np.zeros(len(a))
    for chosen in _groups(np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)):
        left, la = encode([a[i] for i in chosen])
        right, lb = encode([b[i] for i in chosen])
        rows, columns = np.arange(len(chosen)), np.arange(right.shape[1])
        inside = columns < lb[:, None]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
        free, taken = inside.copy(), np.zeros(left.shape, dtype=bool)
        for i in range(left.shape[1]):
            hit = (right == left[:, i : i + 1]) & free & (np.abs(columns - i) <= reach) & (i < la)[:, None]
            first = hit.argmax(axis=1)
            found = hit[rows, first]
            taken[found, i] = True
            free[rows[found], first[found]] = False
        m = taken.sum(axis=1)
        # Matched letters of both sides, moved to the front in their order.
        depth = max(1, int(m.max(initial=0)))
        side_a = np.take_along_axis(left, np.argsort(~taken, axis=1, kind="stable")[:, :depth], axis=1)
        side_b = np.take_along_axis(right, np.argsort(~(inside & ~free), axis=1, kind="stable")[:, :depth], axis=1)
        moved = ((side_a != side_b) & (np.arange(depth) < m[:, None])).sum(axis=1) // 2
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / some) / 3, 0.0)
        head = min(PREFIX_LENGTH, left.shape[1], right.shape[1])
        same = (right[:, :head] == left[:, :head]) & inside[:, :head] & (np.arange(head) < la[:, None])
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        out[chosen] = np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)
    return out


def levenshtein_sims(a: list[str], b: list[str]) -> np.ndarray:
    """One minus the edits of each pair over its longer length; two empty texts are equal."""
    out = np.ones(len(a))
    for chosen in _groups(np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)):
        left, la = encode([a[i] for i in chosen])
        right, lb = encode([b[i] for i in chosen])
        steps = np.arange(right.shape[1] + 1)
        table = np.broadcast_to(steps, (len(chosen), len(steps))).astype(np.int32)
        for i in range(left.shape[1]):
            changed = table[:, :-1] + (right != left[:, i : i + 1])
            following = np.empty_like(table)
            following[:, 0] = i + 1
            following[:, 1:] = np.minimum(table[:, 1:] + 1, changed)
            following = np.minimum.accumulate(following - steps, axis=1) + steps  # insertions
            table = np.where((i < la)[:, None], following, table)
        edits = table[np.arange(len(chosen)), lb]
        longer = np.maximum(la, lb)
        out[chosen] = np.where(longer == 0, 1.0, 1 - edits / np.maximum(longer, 1))
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair.

    The rows of all tables advance together: one step takes the next code point
    of every left text. Pairs are taken in the order of their lengths, so that a
    long text does not widen the matrix of the short ones.
    """
    out = np.zeros(len(a), dtype=np.int64)
    for chosen in _groups(np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)):
        left, left_sizes = encode([a[i] for i in chosen])
        right, right_sizes = encode([b[i] for i in chosen])
        inside = np.arange(right.shape[1]) < right_sizes[:, None]
        table = np.zeros((len(chosen), right.shape[1] + 1), dtype=np.int32)
        for i in range(int(left_sizes.max(initial=0))):
            hit = (right == left[:, i : i + 1]) & inside & (i < left_sizes)[:, None]
            reached = np.maximum(table[:, 1:], np.where(hit, table[:, :-1] + 1, 0))
            np.maximum.accumulate(reached, axis=1, out=table[:, 1:])
        out[chosen] = table[:, -1]
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the common subsequence over both lengths; two empty texts are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    return np.where(total == 0, 1.0, 2.0 * lcs_lengths(a, b) / np.maximum(total, 1))


def _windows(short: str, long: str) -> Iterator[str]:
    n = len(short)
    return (long[max(0, start) : start + n] for start in range(1 - n, len(long)) if n)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text against windows of the longer one.

    Windows as long as the shorter text, and shorter ones at both ends; of texts
    of one length either may be the shorter. The windows of many pairs are
    measured together.
    """
    out = np.array([0.0 if x or y else 1.0 for x, y in zip(a, b, strict=True)])
    owners, shorts, windows = [], [], []
    held = 0

    def flush() -> None:
        if owners:
            np.maximum.at(out, owners, indel_ratios(shorts, windows))
        owners.clear(), shorts.clear(), windows.clear()

    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        sides = [(x, y), (y, x)] if len(x) == len(y) else [(x, y) if len(x) < len(y) else (y, x)]
        for short, long in sides:
            for window in _windows(short, long):
                owners.append(i), shorts.append(short), windows.append(window)
                held += len(window) + 1
                if held >= _CELLS:
                    flush()
                    held = 0
    flush()
    return out


def _popular(code: np.ndarray) -> np.ndarray:
    """Places of code points too frequent to start a block; only in long texts."""
    if len(code) < POPULAR_FROM:
        return np.zeros(len(code), dtype=bool)
    _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    return (counts > len(code) // 100 + 1)[place]


def _longest_blocks(a, b, seed, size_a, size_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in both texts and length of the longest common block of each row.

    The first in the left text, then in the right one, wins among equal ones.
    ``seed`` marks the right places that can be part of a block before it is
    extended on both sides.
    """
    rows = np.arange(len(a))
    length, start_a, start_b = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    run = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)
    for i in range(int(size_a.max(initial=0))):
        hit = (b == a[:, i : i + 1]) & seed & (i < size_a)[:, None]
        run[:, 1:] = np.where(hit, run[:, :-1] + 1, 0)
        end = run.argmax(axis=1)
        top = run[rows, end]
        better = top > length
        length = np.where(better, top, length)
        start_a = np.where(better, i + 1 - top, start_a)
        start_b = np.where(better, end - top, start_b)
    for back in (True, False):
        while True:
            at_a = start_a - 1 if back else start_a + length
            at_b = start_b - 1 if back else start_b + length
            able = (at_a >= 0) & (at_b >= 0) & (at_a < size_a) & (at_b < size_b)
            clip_a, clip_b = np.clip(at_a, 0, a.shape[1] - 1), np.clip(at_b, 0, b.shape[1] - 1)
            grows = able & (a[rows, clip_a] == b[rows, clip_b]) & ((length > 0) | (not back))
            if not grows.any():
                break
            length = length + grows
            if back:
                start_a, start_b = start_a - grows, start_b - grows
    return start_a, start_b, length


def block_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the matching blocks over both lengths.

    The longest common block splits both texts; what lies before and behind it
    is matched in the same way. Each round takes all open pieces of all pairs.
    """
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    matched = np.zeros(len(a), dtype=np.int64)
    codes = [[np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in side] for side in (a, b)]
    common = [_popular(code) for code in codes[1]]
    pieces = [(i, 0, len(x), 0, len(y)) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    while pieces:
        following = []
        for chosen in _groups(np.array([max(p[2] - p[1], p[4] - p[3]) for p in pieces], dtype=np.int64)):
            part = [pieces[k] for k in chosen]
            size_a = np.array([p[2] - p[1] for p in part])
            size_b = np.array([p[4] - p[3] for p in part])
            left = np.zeros((len(part), int(size_a.max())), dtype=np.uint32)
            right = np.zeros((len(part), int(size_b.max())), dtype=np.uint32)
            seed = np.zeros(right.shape, dtype=bool)
            for row, (i, a0, a1, b0, b1) in enumerate(part):
                left[row, : a1 - a0], right[row, : b1 - b0] = codes[0][i][a0:a1], codes[1][i][b0:b1]
                seed[row, : b1 - b0] = ~common[i][b0:b1]
            found = zip(part, *_longest_blocks(left, right, seed, size_a, size_b), strict=True)
            for (i, a0, a1, b0, b1), x, y, n in found:
                if n:
                    matched[i] += n
                    following.append((i, a0, a0 + x, b0, b0 + y))
                    following.append((i, a0 + x + n, a1, b0 + y + n, b1))
        pieces = [p for p in following if p[1] < p[2] and p[3] < p[4]]
    return np.where(total == 0, 1.0, 2.0 * matched / np.maximum(total, 1))


def _on_distinct(pair_measure, a: pd.Series, b: pd.Series) -> pd.Series:
    """Apply a measure to each distinct pair of a batch and spread the results."""
    a, b = a.fillna(""), b.fillna("")
    codes, _ = pd.factorize(a + "\0" + b)
    first = np.unique(codes, return_index=True)[1]
    values = pair_measure(a.iloc[first].reset_index(drop=True), b.iloc[first].reset_index(drop=True))
    return pd.Series(np.asarray(values, dtype=float)[codes])


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _on_distinct(lambda x, y: jaro_winkler_pairs(x.tolist(), y.tolist()), a, b)


@F.pandas_udf(DoubleType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return _on_distinct(lambda x, y: lcs_lengths(x.tolist(), y.tolist()), a, b)


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return _on_distinct(lambda x, y: partial_ratios(x.tolist(), y.tolist()), a, b)


@F.pandas_udf(DoubleType())
def _sequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return _on_distinct(lambda x, y: block_ratios(x.tolist(), y.tolist()), a, b)


# ---------------------------------------------------------------------------
# Columns


def levenshtein_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def greatest_name_sim(name: Column, official: Column, trade: Column, acronym: Column) -> Column:
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (official, trade, acronym)]
    return F.greatest(*[jaro_winkler(F.lower(name), c) for c in low])


def _ratio_of(lcs: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * lcs / total)


def ratio(a: Column, b: Column) -> Column:
    return _ratio_of(_lcs(a, b), a, b)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda token: token != "")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_sort(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set(a: Column, b: Column) -> Column:
    """Best ratio among shared words, and shared words with either remainder."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.array_join(F.array_intersect(ta, tb), " ")
    rest_a = F.array_join(F.array_sort(F.array_except(ta, tb)), " ")
    rest_b = F.array_join(F.array_sort(F.array_except(tb, ta)), " ")
    ls, la, lb = F.length(shared), F.length(rest_a), F.length(rest_b)
    gap = F.when(ls > 0, 1).otherwise(0)
    with_a, with_b = ls + gap + la, ls + gap + lb
    # Shared words in front add equally to both texts.
    both = 2.0 * (ls + gap + _lcs(rest_a, rest_b)) / (with_a + with_b)
    to_a, to_b = 2.0 * ls / (ls + with_a), 2.0 * ls / (ls + with_b)
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
        .when((ls > 0) & ((la == 0) | (lb == 0)), F.lit(1.0))
        .when(ls > 0, F.greatest(both, to_a, to_b))
        .otherwise(both)
    )


def partial(a: Column, b: Column) -> Column:
    return _partial(a, b)


def blocks(a: Column, b: Column) -> Column:
    """Longest-matching-block ratio of two texts as they are."""
    return _sequence(a, b)


def sequence_sim(a: Column, b: Column) -> Column:
    """Longest-matching-block ratio of two normalised company names."""
    return blocks(company_name_norm(a), company_name_norm(b))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + NORM_FLOOR)

"""Token similarities on the Indel ratio, 200 * LCS / (len a + len b). The longest common subsequence is a loop over
characters that no built-in has, so it runs as an Arrow-batched function: bit-parallel, for all pairs of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Bit-parallel: a bit for each character of a, one step for each of b."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = at.get(c, 0) & s
        s = ((s + m) | (s - m)) & full
    return len(a) - s.bit_count()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of many pairs: a machine word a pair for texts of up to 64 characters on one side, one step for each character
    of the longest other side; longer pairs go one by one."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    out = np.zeros(len(a), np.int64)
    sizes = np.array([len(x) for x in short], np.int64)
    plain = np.array([n <= 64 and "\0" not in x and "\0" not in y for n, x, y in zip(sizes.tolist(), short, long)], bool)
    for i in np.flatnonzero(~plain).tolist():
        out[i] = lcs(short[i], long[i])
    at = np.flatnonzero(plain & (sizes > 0))
    at = at[np.argsort([len(long[i]) for i in at.tolist()], kind="stable")] if len(at) else at
    for part in np.array_split(at, max(1, len(at) // 2048)):
        if not len(part):
            continue
        codes = lambda texts: (lambda u: u.view(np.uint32).reshape(len(texts), -1))(np.array(texts))
        x, y = codes([short[i] for i in part.tolist()]), codes([long[i] for i in part.tolist()])
        wide = np.zeros((len(part), 64), np.uint32)
        wide[:, : x.shape[1]] = x
        full = np.uint64(2**64 - 1) >> (np.uint64(64) - sizes[part].astype(np.uint64))
        s = full.copy()
        for c in y.T:
            m = np.packbits(wide == c[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0] & s
            s = ((s + m) | (s - m)) & full
        out[part] = sizes[part] - np.bitwise_count(s)
    return out


def sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    x, y = ([" ".join(sorted(t.split())) for t in side] for side in (a, b))
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.float64)
    return np.where(total > 0, 200.0 * lcs_many(x, y) / np.maximum(total, 1), 100.0)


def set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    x, y = ([set(t.split()) for t in side] for side in (a, b))
    left, right = [" ".join(sorted(p - q)) for p, q in zip(x, y)], [" ".join(sorted(q - p)) for p, q in zip(x, y)]
    n, nl, nr = (np.array([len(t) for t in side], np.float64) for side in ([" ".join(sorted(p & q)) for p, q in zip(x, y)], left, right))
    gap = (n > 0).astype(float)
    apart = nl + nr - 2 * lcs_many(left, right)
    both = np.maximum(2 * (n + gap) + nl + nr, 1)
    best = 100.0 - 100.0 * apart / both
    one = lambda k: np.where(n > 0, 100.0 - 100.0 * (gap + k) / np.maximum(2 * n + gap + k, 1), 0.0)
    best = np.maximum(best, np.maximum(one(nl), one(nr)))
    best = np.where((n > 0) & ((nl == 0) | (nr == 0)), 100.0, best)
    return np.where([bool(p) and bool(q) for p, q in zip(x, y)], best, 0.0)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def sort_ratio(a: str, b: str) -> float:
    return float(sort_ratios([a], [b])[0])


def set_ratio(a: str, b: str) -> float:
    return float(set_ratios([a], [b])[0])


def _udf(scores):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[ok] = scores(a[ok].tolist(), b[ok].tolist())
        return pd.Series(out).astype(object).where(ok, None)

    return run


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Of processed texts; null if either is."""
    return _udf(sort_ratios)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _udf(set_ratios)(a, b)


def reachable(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone allow a ratio of ``least``: keeps most pairs from the costly score."""
    n, m = F.length(a), F.length(b)
    return F.least(n, m) * 200.0 >= (n + m) * least

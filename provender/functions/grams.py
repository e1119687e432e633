"""An inverted index of character grams: which texts can be similar enough, by counts of common grams alone."""

from __future__ import annotations

import numpy as np

from provender.functions.similarity import lcs_many

GRAM = 3


def grams(text: str) -> set[str]:
    """The strings of three characters of a text with two marks before and behind it."""
    line = f"\x01\x01{text}\x02\x02"
    return {line[i : i + GRAM] for i in range(len(text) + GRAM - 1)}


def common_at_least(n, m, size, other, score):
    """How many grams texts of n and m characters with ``size`` and ``other`` different grams share if 200 * LCS / (n + m) is at least
    ``score``. Of the at most d characters that aren't common, one of the first text breaks three of its grams, one of the second
    two; the rest of its grams are the other's as well, and the other way round."""
    d = np.floor((n + m) * (100.0 - score) / 100.0 + 1e-9)
    return np.maximum(size - (5 * d + n - m) / 2, other - (5 * d + m - n) / 2)


class GramIndex:
    """Postings of the texts that ask, by gram."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        sets = [grams(t) for t in texts]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ids: dict[str, int] = {}
        at = np.array([self.ids.setdefault(g, len(self.ids)) for s in sets for g in s], np.int64)
        who = np.repeat(np.arange(len(texts)), self.size)
        order = np.argsort(at, kind="stable")
        self.postings = who[order]
        self.ends = np.searchsorted(at[order], np.arange(len(self.ids)), side="right")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ids) else np.zeros(0, np.int64)

    def counts(self, sets: list[set[str]]) -> np.ndarray:
        """[other text][asking text]: how many grams they share."""
        hits = [(i, g) for i, s in enumerate(sets) for g in map(self.ids.get, s) if g is not None]
        if not hits:
            return np.zeros((len(sets), len(self.texts)), np.int64)
        row, gram = np.array(hits, np.int64).T
        n = self.ends[gram] - self.starts[gram]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.starts[gram], n)
        cell = np.repeat(row, n) * len(self.texts) + self.postings[place]
        return np.bincount(cell, minlength=len(sets) * len(self.texts)).reshape(len(sets), -1)

    def best(self, k: int, least: float, cells: int = 1_000_000):
        """A coroutine: send() it lists of texts, at last None; it then gives (asking text, place, other text, score) of the k best of each
        asking text, and all that tie with the last of them."""
        bound = np.full(len(self.texts), float(least))
        who, place, score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        others: list[str] = []
        seen, rows = 0, max(1, cells // max(1, len(self.texts)))
        given = yield
        while given is not None:
            for lo in range(0, len(given) if self.texts else 0, rows):
                part = given[lo : lo + rows]
                sets = [grams(t) for t in part]
                length, size = (np.array([len(t) for t in x], np.int64)[:, None] for x in (part, sets))
                may = self.counts(sets) >= common_at_least(self.length, length, self.size, size, bound)
                total = self.length + length
                may &= np.minimum(self.length, length) * 200.0 >= total * bound
                y, x = np.nonzero(may)
                if not len(x):
                    continue
                sums = total[y, x]
                ratio = np.where(sums > 0, 200.0 * lcs_many([self.texts[i] for i in x.tolist()], [part[i] for i in y.tolist()]) / np.maximum(sums, 1), 100.0)
                ok = ratio >= bound[x]
                who, place, score = np.concatenate([who, x[ok]]), np.concatenate([place, seen + lo + y[ok]]), np.concatenate([score, ratio[ok]])
                others += [part[i] for i in y[ok].tolist()]
                if len(who) > 2 * k * len(self.texts) + 10_000:
                    who, place, score, others = self._cut(k, bound, who, place, score, others)
            seen += len(given)
            given = yield
        who, place, score, others = self._cut(k, bound, who, place, score, others)
        yield [self.texts[i] for i in who.tolist()], place, others, score

    def _cut(self, k, bound, who, place, score, others):
        """Keeps what may still be among the k best, and raises the bounds."""
        order = np.lexsort((place, -score, who))
        start = np.searchsorted(who[order], np.arange(len(self.texts)))
        end = np.searchsorted(who[order], np.arange(len(self.texts)), side="right")
        full = np.flatnonzero(end - start >= k)
        bound[full] = np.maximum(bound[full], score[order][start[full] + k - 1])
        kept = np.flatnonzero(score >= bound[who])
        return who[kept], place[kept], score[kept], [others[i] for i in kept.tolist()]

"""Quality classifier: a sparse rule ensemble. Paths of boosted trees become rules over text statistics, a lasso logistic
regression weighs them, and the rules that keep a weight are compiled into one Spark column expression."""

from __future__ import annotations

import collections
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import whole_row

#: What the rules may look at; see stats_of.
STATS = ["words", "mean_word", "upper", "digits", "symbols", "marked_words", "lone_marks", "distinct_words", "repeats", "top_word", "lines_per_word", "repeated_lines", "exclaims", "commas", "short_words", "longest_word"]
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(65, 91)]] = 1
_KIND[[c for c in range(48, 58)]] = 2
_KIND[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = 3
_KIND[ord("!")] = 4
_KIND[ord(",")] = 5
_MARKS = frozenset(b"#$%&*!|~^=<>")


def stats_of(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text; all ratios, so that they mean the same at any length. No words: zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    size = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    counts = collections.Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        float(n),
        (size - n + 1) / n,
        kinds[1] / size,
        kinds[2] / size,
        kinds[3] / size,
        sum(w[-1] in _MARKS for w in words) / n,
        sum(c for w, c in counts.items() if len(w) == 1 and w[0] in _MARKS) / n,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        kinds[4] / size,
        kinds[5] / size,
        sum(len(w) <= 3 for w in words) / n,
        float(max(map(len, counts))),
    )


def stats(text: str = "text") -> Column:
    """The statistics of a text column as a struct. Only the text goes to Python; no shuffle."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def run(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats_of(x) for x in t], columns=STATS, dtype=float)

    return run(F.col(text).cast("string"))


@dataclass(frozen=True)
class Rule:
    """A conjunction: each (statistic, above, cut) asks for > cut or for <= cut."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, above, cut in self.terms:
            v = x[:, STATS.index(s)]
            out &= v > cut if above else v <= cut
        return out

    def column(self, stats: str = "_stats") -> Column:
        out = F.lit(True)
        for s, above, cut in self.terms:
            v = F.col(f"{stats}.{s}")
            out = out & ((v > cut) if above else (v <= cut))
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as one expression over ``_stats``, for whole-stage code."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def _tree(x, cuts, gradient, curve, depth, terms, out, leaf, least=20):
    """A regression tree on the gradient by exact gains at the cut points; its inner and outer paths go to out."""
    here = np.arange(len(gradient)) if leaf is None else leaf
    best = (1e-9, None)
    if depth:
        g, h = gradient[here], curve[here]
        base = g.sum() ** 2 / (h.sum() + 1)
        for j, points in enumerate(cuts):
            if not len(points):
                continue
            place = np.searchsorted(points, x[here, j])  # how many cut points lie below the value
            gl = np.bincount(place, g, len(points) + 1)[:-1].cumsum()
            hl = np.bincount(place, h, len(points) + 1)[:-1].cumsum()
            nl = np.bincount(place, minlength=len(points) + 1)[:-1].cumsum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[(nl < least) | (len(here) - nl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, points[k]))
    if best[1] is None:
        return np.array([(terms, here)], dtype=object).reshape(1, 2)
    j, cut = best[1]
    leaves = []
    for above in (False, True):
        side = here[(x[here, j] > cut) == above]
        path = (*terms, (STATS[j], above, float(cut)))
        out.append(path)
        leaves += list(_tree(x, cuts, gradient, curve, depth - 1, path, out, side, least))
    return leaves


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, penalty: float = 2e-3, steps: int = 600) -> Model:
    """Fits the ensemble; deterministic. One class only, or no rows: a constant score of (ones + 1) / (rows + 2)."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(bias, ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.005, 0.995, 100))) for c in x.T]
    paths: list[tuple] = []
    z = np.full(len(y), bias)
    for _ in range(trees):  # boosting makes each tree look at what the ones before have missed
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        for _, leaf in _tree(x, cuts, g, h, depth, (), paths, None):
            z[leaf] += 0.5 * g[leaf].sum() / (h[leaf].sum() + 1)
    seen: dict[bytes, Rule] = {}
    for path in dict.fromkeys(paths):
        rule = Rule(path)
        held = rule.holds(x)
        if 0 < held.sum() < len(y):
            key, other = np.packbits(held).tobytes(), np.packbits(~held).tobytes()
            if key not in seen and other not in seen:  # a rule and its opposite say the same
                seen[key] = rule
    rules = list(seen.values())
    if not rules:
        return Model(bias, ())
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    w, b = np.zeros(len(rules)), bias
    top = np.linalg.norm(np.column_stack([a, np.ones(len(y))]), 2) ** 2 / (4 * len(y))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # FISTA
        r = 1 / (1 + np.exp(-(a @ vw + vb))) - y
        nw = vw - a.T @ r / len(y) / top
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / top, 0)
        nb = vb - r.mean() / top
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model(float(b), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no fitting sees: crc32 of the id as text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 20_000, **how) -> Model:
    """Fits on at most ``max_rows`` labelled rows, those of the smallest hash of id and text; held-out ids are never among them.

    The bound is on rows after labels and documents have met, so neither repeated ids nor repeated labels widen it. Only
    the chosen rows' statistics (16 doubles each) come to the driver.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", F.xxhash64("doc_id", "text").alias("_h"), stats().alias("_stats")).select("doc_id", "_y", "_h", "_stats.*")
    rows = rows.orderBy("_h", "doc_id", "_y").limit(max_rows).toPandas().sort_values(["doc_id", "_y", *STATS], kind="stable")
    return fit(rows[STATS].to_numpy(float), rows["_y"].to_numpy(float), **how)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, model: Model | None = None, max_rows: int = 20_000) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 is likelier) and predicted (1 if score >= threshold).

    Two passes over the texts, no shuffle of documents. Null and empty texts get the score of a text without words; a text of
    any length is read whole. Columns of these three names in docs are replaced, all others stay. Repeated rows stay; an
    empty table gives none; no labels give a constant score of 0.5.
    """
    model = model or train(docs, labels, max_rows=max_rows)
    own = docs.drop("held_out", "score", "predicted")
    scored = own.select(whole_row(own).alias("_row"), F.col("doc_id"), stats().alias("_stats")).select("_row", held_out().alias("held_out"), model.column().alias("score"))
    return scored.select("_row.*", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that the classifier doesn't reject, with their columns. Nulls, repeats and empty tables as in score()."""
    judged = docs.select(whole_row(docs).alias("_row"), stats().alias("_stats"))
    return judged.where(train(docs, labels).column() >= 0.3).select("_row.*")

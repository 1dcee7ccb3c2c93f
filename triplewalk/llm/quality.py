"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - w . x)`` with one weight vector for all thresholds and rising thresholds. ``x`` has the
distinct words of a text, hashed, and its style (shares of capitals, punctuation, repeated words and the like, in steps). The
fit uses a bounded sample of rated rows; scoring gives the expected grade and the probability of the top grade for selection.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .sampling import per_label

BITS = 20
STYLES, STEPS = 6, 12
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~tc._WORD


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Steps of a share on a log scale: 0 for none, STEPS - 1 for all."""
    x = part / np.maximum(whole, 1)
    return np.where(x > 0, np.clip(STEPS - 1 + np.ceil(np.log2(np.maximum(x, 1e-9)) * 1.5), 1, STEPS - 1), 0).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all rows, first of each row): distinct word buckets below 2**BITS, then STYLES style features above."""
    raw, at = tc.flat(texts, lower=False)
    low, low_at = tc.flat(texts)
    h, first, starts, ends = tc.tokens_of_bytes(low, low_at, with_ends=True)
    row, size = tc.rows_of(first), np.diff(first)
    n = len(size)
    key = np.unique(row.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    words, word_first = key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << BITS)
    per = lambda flags, edges: np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    distinct = np.diff(word_first)
    length = per(ends - starts, first)
    style = np.stack(
        [
            _share(per(_UPPER[raw], at), np.diff(at)),
            _share(per(_PUNCT[raw], at), np.diff(at)),
            _share(per(again, first), size),
            _share(size - distinct, size),
            np.clip(length / np.maximum(size, 1), 0, STEPS - 1).astype(np.int64),
            np.clip(np.log2(size + 1), 0, STEPS - 1).astype(np.int64),
        ],
        axis=1,
    )
    style = (1 << BITS) + np.arange(STYLES) * STEPS + style
    out = np.empty(len(words) + STYLES * n, np.int64)
    edges = word_first + STYLES * np.arange(n + 1)
    out[np.arange(len(words)) + STYLES * (tc.rows_of(word_first) + 1 - 1)] = words
    out[(edges[1:, None] - STYLES + np.arange(STYLES)).ravel()] = style.ravel()
    return out, edges


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    #: The probability of the top grade from which documents are selected.
    least: float = 0.5

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[x], first[:-1]) if len(first) > 1 else np.zeros(0)

    def grades(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade) of each row."""
        above = self.above(self.score(*features(texts)))
        return above.sum(axis=1), above[:, -1]

    def above(self, s: np.ndarray) -> np.ndarray:
        """Probabilities of a grade above each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def distinct_texts(x: np.ndarray, first: np.ndarray, bins: int = 32, alike: float = 0.6) -> np.ndarray:
    """Rows that aren't near copies of an earlier one: copies would pass for evidence. Of each row the least word hash in each of
    ``bins``; a row that shares two neighbouring ones with an earlier row, and ``alike`` of all, is a copy of it."""
    n, word = len(first) - 1, x < 1 << BITS
    h, cell = tc.mix(x[word].astype(np.uint64)), tc.rows_of(first)[word] * bins
    cell += (h & np.uint64(bins - 1)).astype(np.int64)
    order = np.lexsort((h, cell))
    h, cell = h[order], cell[order]
    least = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)
    sketch = np.zeros(n * bins, np.uint64)
    sketch[cell[least]] = h[least]
    sketch = sketch.reshape(n, bins)
    seen: dict[tuple, int] = {}
    kept = []
    for r in range(n):
        keys = [(k, a, b) for k, (a, b) in enumerate(sketch[r].reshape(-1, 2).tolist()) if a and b]
        near = {seen[k] for k in keys if k in seen}
        if near and max((sketch[r] == sketch[o]).mean() for o in near) >= alike:
            continue
        for k in keys:
            seen.setdefault(k, r)
        kept.append(r)
    return np.array(kept, np.int64)


def _telling(x: np.ndarray, row: np.ndarray, y: np.ndarray, top: int, width: int, least: int) -> np.ndarray:
    """Which features occur in at least ``least`` rows and, in some grade, more often or less than chance by as many deviations
    as the largest of so many features would show without any association."""
    seen = np.bincount(x, minlength=width)
    best = np.zeros(width)
    for k in range(top + 1):
        share = (y == k).mean()
        if 0 < share < 1:
            expected = seen * share
            spread = np.sqrt(expected * (1 - share) * (1 - np.minimum(seen / len(y), 1 - 1e-9)) + 0.25)
            best = np.maximum(best, np.abs(np.bincount(x, y[row] == k, width) - expected) / spread)
    often = seen >= least
    return np.flatnonzero(often & (best >= np.sqrt(2 * np.log(max(2, often.sum())))))


def gradient(w: np.ndarray, t: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(penalised negative log likelihood, its gradient by w and by t); t are the first threshold and the logs of the steps above it."""
    top = len(t)
    theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    s = np.bincount(row, w[x], len(y))
    bound = np.concatenate([[-60.0], theta, [60.0]])
    hi, lo = _sigmoid(bound[y + 1] - s), _sigmoid(bound[y] - s)
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    ds = weight * (dhi - dlo) / p
    g_theta = -np.array([(weight * ((y == k) * dhi - (y == k + 1) * dlo) / p).sum() for k in range(top)])
    tail = np.cumsum(g_theta[::-1])[::-1]
    value = -(weight * np.log(p)).sum() + ridge / 2 * (w * w).sum()
    return value, np.concatenate([np.bincount(x, ds[row], len(w)) + ridge * w, np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])])


def _solve(x: np.ndarray, row: np.ndarray, y: np.ndarray, top: int, epochs: int, rate: float, ridge: float, least: int) -> Model:
    width = (1 << BITS) + STYLES * STEPS
    used = _telling(x, row, y, top, width, least)
    index = np.full(width, -1, np.int64)
    index[used] = np.arange(len(used))
    keep = index[x] >= 0
    x, row = index[x[keep]], row[keep]
    share = np.bincount(y, minlength=top + 1) / len(y)
    weight = np.maximum(share[y], 1e-9) ** -0.5
    weight /= weight.sum()
    w, t = np.zeros(len(used)), np.zeros(top)
    t[0] = -1.0
    state = [np.zeros(len(w) + top), np.zeros(len(w) + top)]
    for step in range(1, epochs + 1):
        _, g = gradient(w, t, x, row, y, weight, ridge)
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8) * (1 - step / (epochs + 1))
        w -= move[: len(w)]
        t -= move[len(w) :]
    weights = np.zeros(width)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def calibrate(p: np.ndarray, y: np.ndarray, top: int, most_lowest: float, least_top: float) -> float:
    """The probability that tells the top grade from the others best (most of the one less most of the other, mid-way where that is alike),
    raised until at most ``most_lowest`` of the lowest grade are selected, but no higher than keeps ``least_top`` of the top grade."""
    good, rest, bad = np.sort(p[y == top]), np.sort(p[y < top]), np.sort(p[y == 0])
    if not len(good) or not len(rest):
        return 0.5
    edges = np.unique(np.concatenate([good, rest]))
    between = np.concatenate([edges[:1], (edges[1:] + edges[:-1]) / 2])
    gain = np.searchsorted(rest, between) / len(rest) - np.searchsorted(good, between) / len(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    cut = between[best[len(best) // 2]]
    if len(bad):
        at = int(np.ceil((1 - most_lowest) * len(bad))) - 1
        cut = max(cut, np.nextafter(bad[at], 1) if at >= 0 else 0.0)
    return float(min(cut, good[int((1 - least_top) * len(good))]))


def train(texts: list[str], grades: list[int], *, top: int, epochs: int = 200, rate: float = 0.15, ridge: float = 1e-4, least: int = 3, folds: int = 8, most_lowest: float = 0.02, least_top: float = 0.95) -> Model:
    """Full-batch Adam on the ridge-penalised likelihood, over texts that aren't copies of one another. Words keep weight 0
    if they're in fewer than ``least`` of them or not associated with a grade beyond chance. Thresholds are
    the first and the logs of the steps above it, so they rise. Grades are weighted by the
    inverse root of their share.

    The probability to select from (see ``calibrate``) is found on texts that the model hasn't seen, each by a model of the other ``folds`` - 1
    parts; the model itself is of all."""
    y = np.asarray(grades, np.int64)
    parts, edges = [], [np.zeros(1, np.int64)]
    array = pa.array(texts, pa.string())
    for lo, hi in tc.chunks(array):
        x, first = features(array.slice(lo, hi - lo))
        parts.append(x)
        edges.append(first[1:] + edges[-1][-1])
    x, first = np.concatenate(parts), np.concatenate(edges)
    kept = distinct_texts(x, first)
    size = np.diff(first)[kept]
    x = np.concatenate([x[first[r] : first[r + 1]] for r in kept])
    row, y = np.repeat(np.arange(len(kept)), size), y[kept]

    def of(rows: np.ndarray):
        number = np.cumsum(rows) - 1
        return x[rows[row]], number[row[rows[row]]], y[rows]

    solve = lambda rows: _solve(*of(rows), top, epochs, rate, ridge, least)
    # Each fold has every folds-th text of each grade.
    fold = np.zeros(len(y), np.int64)
    for k in range(top + 1):
        at = np.flatnonzero(y == k)
        fold[at] = np.arange(len(at)) % folds
    unseen = np.full(len(y), np.nan)
    for k in range(folds):
        held = fold == k
        if held.any() and not held.all():
            hx, hrow, hy = of(held)
            model = solve(~held)
            unseen[held] = model.above(np.bincount(hrow, model.weights[hx], len(hy)))[:, -1]
    some = ~np.isnan(unseen)
    return solve(np.ones(len(y), bool))._replace(least=calibrate(unseen[some], y[some], top, most_lowest, least_top))


#: Grades of the ``labels`` table: toxic 0, poor 1, good 2.
TOP = 2


def rating(quality="quality", toxic="toxic"):
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_grade: int = 4000, seed: int = 5) -> Model | None:
    """A model from at most ``sample_per_grade`` rated rows of each grade, whole texts; None without a rated text.

    A doc_id with several ratings counts with its lowest; ratings with a null are ignored, and so are null texts."""
    rated = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), rating().alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = per_label(rated, "grade", "doc_id", sample_per_grade, seed)
    if not chosen:
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "grade int, doc_id bigint"))  # bounded
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).filter("text is not null").join(picked, "doc_id").select("doc_id", "grade", "text").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.grade for r in rows], top=TOP)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, expected_grade, top_probability) of every row; null texts are scored as empty ones. Without a model both are
    null. Only doc_id and text are read; repeated rows are scored each, long texts by all their words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi in tc.chunks(batch.column(1)):
                grade, p = model.grades(batch.column(1).slice(lo, hi - lo)) if model else ([None] * (hi - lo),) * 2
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(grade, pa.float64()), pa.array(p, pa.float64())], names=["doc_id", "expected_grade", "top_probability"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tc.trimmed(run), "doc_id bigint, expected_grade double, top_probability double")


def select(docs: DataFrame, model: Model | None, least: float | None = None) -> DataFrame:
    """The rows of ``scores`` whose probability of the top grade is at least ``least``, by default what the model found on ratings
    that it held out. Ties are of one score and go together; repeated rows, too. Without a model nothing is selected."""
    return scores(docs, model).filter(F.col("top_probability") >= (least if least is not None else model.least if model else 1.0))

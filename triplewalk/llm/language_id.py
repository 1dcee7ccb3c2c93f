"""Language identification by interpolated Kneser-Ney character models.

One model per language is trained on a bounded sample of rows with a known language. All models lie in one sorted array of
n-gram hashes per order, with a row of interpolated log probabilities, a column for each language; a second array holds the
back-off weights of contexts. A text's language is the one with the lowest cross-entropy per character; it is rejected if that
entropy is higher than held-out texts of the language, of such a length, make plausible.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .sampling import per_label

_R = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Letters and the marks that belong to them, over all of Unicode.
_LETTER = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
_TOP = 18


def symbols(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all rows, each preceded by ``pad`` spaces; first place of each row; number of letters of each row).

    Lower case; whatever isn't a letter is a space, and runs of spaces are one."""
    raw, at = tc.flat(texts)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = lead[at]
    cp = np.where(_LETTER[cp], cp, np.uint32(32))
    space = cp == 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[first[:-1][np.diff(first) > 0]] = True
    letters = np.concatenate([[0], np.cumsum(~space)])[first]
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    cp = cp[keep]
    out = np.full(len(cp) + pad * (len(first) - 1), 32, np.uint32)
    out[np.arange(len(cp)) + pad * (tc.rows_of(first) + 1)] = cp
    return out, first + pad * np.arange(len(first)), np.diff(letters)


def keys(seq: np.ndarray, pos: np.ndarray, n: int, lag: int = 0) -> np.ndarray:
    """Hash of the ``n`` symbols that end ``lag`` before each of ``pos`` (with lag 0: at it)."""
    x = np.full(len(pos), n, np.uint64)
    for k in range(n):
        x += seq[pos - lag - k].astype(np.uint64) * _R[k]
    return tc.mix(x)


class Table(NamedTuple):
    """Rows of values under sorted hashes; ``directory`` has where each prefix of the hash begins."""

    key: np.ndarray
    value: np.ndarray
    directory: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, value: np.ndarray) -> "Table":
        order = np.argsort(key)
        key = key[order]
        return cls(key, value[order], np.searchsorted(key, np.arange((1 << _TOP) + 1, dtype=np.uint64) << np.uint64(64 - _TOP)).astype(np.int32) if len(key) else np.zeros((1 << _TOP) + 1, np.int32))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(key), -1, np.int32)
        if not len(self.key):
            return out
        top = (key >> np.uint64(64 - _TOP)).astype(np.int32)
        at, end, todo = self.directory[top], self.directory[top + 1], None
        while True:
            inside = at < end
            same = inside & (self.key[np.minimum(at, len(self.key) - 1)] == key)
            if todo is None:
                out[same] = at[same]
            else:
                out[todo[same]] = at[same]
            more = np.flatnonzero(inside & ~same)
            if not len(more):
                return out
            todo = more if todo is None else todo[more]
            at, end, key = at[more] + 1, end[more], key[more]


class Model(NamedTuple):
    languages: list
    order: int
    floor: float
    grams: list  # Table of log probabilities for n-grams, by n - 1
    contexts: list  # Table of log back-off weights for contexts, by their length - 1
    centre: np.ndarray
    between: np.ndarray  # variance of the entropy between long texts
    within: np.ndarray  # variance of one character's log probability
    z: float

    def entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character [rows, languages], number of characters scored, number of letters)."""
        pad = self.order - 1
        seq, first, letters = symbols(texts, pad)
        row = tc.rows_of(first)
        pos = np.flatnonzero(np.arange(len(seq)) - first[:-1][row] >= pad) if len(seq) else np.zeros(0, np.int64)
        logp = np.zeros((len(pos), len(self.languages)), np.float32)
        left = np.arange(len(pos))
        for n in range(self.order, 0, -1):
            at = self.grams[n - 1].find(keys(seq, pos[left], n))
            hit = at >= 0
            logp[left[hit]] += self.grams[n - 1].value[at[hit]]
            left = left[~hit]
            if n > 1 and len(left):
                at = self.contexts[n - 2].find(keys(seq, pos[left], n - 1, 1))
                hit = at >= 0
                logp[left[hit]] += self.contexts[n - 2].value[at[hit]]
        logp[left] += self.floor
        size = np.diff(first) - pad
        total = np.zeros((len(size), len(self.languages)))
        full = np.flatnonzero(size > 0)
        if len(full):
            total[full] = np.add.reduceat(logp, (first - pad * np.arange(len(first)))[:-1][full], axis=0, dtype=np.float64)
        return -total / np.maximum(size, 1)[:, None], size, letters

    def classify(self, texts: pa.Array):
        """(index of the language, its entropy, or 0 without a letter, accepted) of each row. Entropies that tie go to the first language by name."""
        h, size, letters = self.entropy(texts)
        best = np.argmin(h, axis=1) if len(h) else np.zeros(0, np.int64)
        low = h[np.arange(len(h)), best]
        limit = self.centre[best] + self.z * np.sqrt(self.between[best] + self.within[best] / np.maximum(size, 1))
        return best, np.where(letters > 0, low, 0.0), (letters > 0) & (low <= limit)


def train(samples: dict[str, list[str]], order: int = 4, held_out: int = 5, z: float = 6.0, reject_share: float = 0.005) -> Model:
    """Kneser-Ney models of {language: texts}; every ``held_out``-th text only calibrates the rejection.

    A text is rejected if its entropy is more standard deviations above its language's usual one than 1.5 times what all but
    ``reject_share`` of the held-out texts show, and more than ``z``."""
    languages = sorted(samples)
    tables: list[list[dict]] = []  # by language, by n: of (key -> probability) as sorted arrays
    data, alphabet = [], 1
    for language in languages:
        fit = [t for k, t in enumerate(samples[language]) if k % held_out] or samples[language]
        seq, first, _ = symbols(pa.array(fit, pa.string()), order - 1)
        row = tc.rows_of(first)
        pos = np.flatnonzero(np.arange(len(seq)) - first[:-1][row] >= order - 1) if len(seq) else np.zeros(0, np.int64)
        data.append((seq, pos))
        alphabet = max(alphabet, len(np.unique(seq)))
    floor = -np.log(2.0 * alphabet)
    per = []
    for seq, pos in data:
        grams, contexts = [], []
        # Distinct n-grams, with for each its context, its shorter n-gram and a count: occurrences for the highest order,
        # the number of different predecessors below.
        levels = {}
        for n in range(order, 0, -1):
            key, at, count = np.unique(keys(seq, pos, n), return_index=True, return_counts=True)
            ctx = keys(seq, pos[at], n - 1, 1) if n > 1 else np.zeros(len(key), np.uint64)
            low = keys(seq, pos[at], n - 1) if n > 1 else np.zeros(len(key), np.uint64)
            if n < order and len(key):
                longer = levels[n + 1]
                count = np.bincount(np.searchsorted(key, longer["low"]), minlength=len(key))
            levels[n] = {"key": key, "ctx": ctx, "low": low, "count": np.maximum(count, 1)}
        prob = {}
        for n in range(1, order + 1):
            g = levels[n]
            ones, twos = int((g["count"] == 1).sum()), int((g["count"] == 2).sum())
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            if n == 1:
                total = max(1, g["count"].sum())
                prob[1] = np.maximum(g["count"] - discount, 0) / total + discount * len(g["key"]) / total * np.exp(floor)
                contexts.append(None)
            else:
                names, inverse = np.unique(g["ctx"], return_inverse=True)
                total = np.bincount(inverse, g["count"], len(names))
                gamma = discount * np.bincount(inverse, minlength=len(names)) / total if len(names) else np.zeros(0)
                below = prob[n - 1][np.searchsorted(levels[n - 1]["key"], g["low"])]
                prob[n] = (g["count"] - discount) / total[inverse] + gamma[inverse] * below if len(names) else np.zeros(0)
                contexts.append((names, np.log(gamma)))
            grams.append((g["key"], np.log(prob[n])))
        per.append((grams, contexts, levels))

    def one(parts, fill):
        """A Table of the union of the languages' keys."""
        every = np.unique(np.concatenate([k for k, _ in parts]))
        value = np.full((len(every), len(parts)), np.nan)
        for c, (k, v) in enumerate(parts):
            value[np.searchsorted(every, k), c] = v
        return every, np.where(np.isnan(value), fill, value) if fill is not None else value

    contexts = [Table.of(*(lambda k, v: (k, v.astype(np.float32)))(*one([p[1][n] for p in per], 0.0))) for n in range(1, order)]
    grams: list[Table] = []
    for n in range(1, order + 1):
        every, value = one([p[0][n - 1] for p in per], None)
        for c in range(len(per)):
            miss = np.isnan(value[:, c])
            if n == 1:
                value[miss, c] = floor
                continue
            # What this language says of an n-gram that only others have: back off, as in scoring.
            links = {}
            for p in per:
                g = p[2][n]
                links.update(zip(g["key"].tolist(), zip(g["ctx"].tolist(), g["low"].tolist()))) if c == 0 else None
            if c == 0:
                all_ctx, all_low = (np.array(x, np.uint64) for x in zip(*[links[k] for k in every.tolist()])) if len(every) else (np.zeros(0, np.uint64),) * 2
            ctx = contexts[n - 2].find(all_ctx[miss])
            low = grams[n - 2].find(all_low[miss])
            value[miss, c] = np.where(ctx >= 0, contexts[n - 2].value[ctx, c], 0) + grams[n - 2].value[low, c]
        grams.append(Table.of(every, value.astype(np.float32)))
    model = Model(languages, order, float(floor), grams, contexts, *(np.zeros(len(languages)) for _ in range(3)), z)
    excess = [np.zeros(1)]
    for c, language in enumerate(languages):
        held = [t for k, t in enumerate(samples[language]) if not k % held_out]
        h, size, letters = model.entropy(pa.array(held, pa.string()))
        h, size = h[letters > 0, c], size[letters > 0]
        if not len(h):
            model.centre[c], model.between[c], model.within[c] = floor * -1, 1, 1
            continue
        model.centre[c] = np.median(h)
        # Spread of the entropy by length, robustly: that of long texts, and what short ones have in excess.
        off = np.abs(h - model.centre[c])
        long_ = size >= np.median(size)
        model.between[c] = max(0.02, 1.4826 * np.median(off[long_])) ** 2
        model.within[c] = max(1.0, np.median((off * 1.4826) ** 2 * size))
        excess.append((h - model.centre[c]) / np.sqrt(model.between[c] + model.within[c] / size))
    return model._replace(z=float(max(z, 1.5 * np.quantile(np.concatenate(excess), 1 - reject_share))))


def fit(docs: DataFrame, *, sample_per_language: int = 400, order: int = 4, seed: int = 3, z: float = 6.0) -> Model | None:
    """A model from at most ``sample_per_language`` rows of each ``lang``, whole texts; None if no row has both.

    Rows are chosen by a seeded hash of doc_id; a doc_id under several languages counts for each, and rows that repeat doc_id and lang all
    count once the pair is chosen. Rows with a null are ignored; texts without a letter teach nothing but spaces."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).filter("text is not null and lang is not null and doc_id is not null")
    chosen = per_label(labelled.select("lang", "doc_id"), "lang", "doc_id", sample_per_language, seed)
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id bigint")  # bounded, so broadcast
    samples: dict[str, list] = {}
    for r in sorted(labelled.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").collect(), key=lambda r: (r.doc_id, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples, order, z=z)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, cross_entropy, accepted) of every row; only doc_id and text are read. A text without a letter, empty or null, is
    rejected, with a null cross-entropy; a rejected row's lang is ``und``. Languages that tie: the first by name. Repeated rows are
    identified each, long texts by all their characters. Without a model every row is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi in tc.chunks(batch.column(1)):
                n = hi - lo
                if model is None:
                    lang, low, ok = ["und"] * n, [None] * n, [False] * n
                else:
                    best, low, ok = model.classify(batch.column(1).slice(lo, n))
                    lang = np.where(ok, np.array(model.languages, object)[best], "und")
                    low = [x if x > 0 else None for x in low.tolist()]
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(lang, pa.string()), pa.array(low, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang", "cross_entropy", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tc.trimmed(run), "doc_id bigint, lang string, cross_entropy double, accepted boolean")


def drop_rejected(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``, all columns, without the rows that ``identify`` rejects, null and empty texts among them."""
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        if shared.value is not None:
            for lo, hi in tc.chunks(texts):
                out[lo:hi] = shared.value.classify(texts.slice(lo, hi - lo))[2]
        tc.trim()
        return pa.array(out)

    return docs.filter(accepted(docs["text"]))

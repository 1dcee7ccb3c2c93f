"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some tokens of a window and ignore the others, so a hash of the chosen tokens survives a substitution at an
ignored place. The hashes of all windows of all benchmark items and of all documents are joined; round each hit, document and
item are laid on each other along the hit's diagonal, and the best stretch that tolerates substitutions is scored.

The join is made where the documents are scanned: the benchmark's hashes, sorted, go to every task, in slices of at most
``slice_tokens`` tokens, a scan of the documents for each slice, so what a task holds is bounded whatever the benchmark's size;
the documents themselves aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import fresh

#: 1: the token counts; 0: it is ignored. Weight 5 in 9.
MASKS = ("110100101", "101001011", "110010011")
SPAN = len(MASKS[0])
_SALT = np.random.default_rng(5).integers(1, 2**63, (len(MASKS), SPAN), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(h: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Hash of mask ``k`` at each of ``pos``."""
    out = np.full(len(pos), k + 1, np.uint64)
    for j, bit in enumerate(MASKS[k]):
        if bit == "1":
            out += h[pos + j] * _SALT[k, j]
    return tc.mix(out)


#: Hits, or cells of diagonals, that are held at once.
_AT_ONCE = 1 << 20


def _continues(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which places have the same seed as the place before: a hit there lies on the diagonal of one before it, or before its partner."""
    out = np.zeros(len(key), bool)
    out[1:] = (key[1:] == key[:-1]) & (pos[1:] == pos[:-1] + 1)
    return out


def best_stretches(h: np.ndarray, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray):
    """(start, end, matched) of each diagonal: of the places [lo, hi) of ``hashes`` against those ``d`` further in ``h``, the stretch with the
    largest sum of +1 a match and -2 a substitution; of several, the one that ends first, then the longest."""
    out = []
    size = hi - lo
    ends = np.cumsum(size + 1)
    k = 0
    while k < len(lo):
        m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _AT_ONCE, "right")))
        n = size[k:m]
        first = np.cumsum(n + 1) - n - 1
        seg = np.repeat(np.arange(m - k), n + 1)
        step = np.arange(len(seg)) - first[seg]  # 0: before the first place
        at = lo[k:m][seg] + step - 1
        some = step > 0
        equal = np.zeros(len(seg), bool)
        equal[some] = h[at[some] + d[k:m][seg[some]]] == hashes[at[some]]
        value = np.where(equal, 1, -2)
        value[~some] = 0
        total = np.cumsum(value)
        # Later diagonals lie wholly below earlier ones, so that running minima start anew with each.
        total = total - total[first][seg] - seg * (3 * int(n.max()) + 1)
        least = np.minimum.accumulate(total)
        gain = total - least
        end = np.flatnonzero(gain == np.maximum.reduceat(gain, first)[seg])
        end = end[np.searchsorted(seg[end], np.arange(m - k))]
        start = np.flatnonzero(total == least[end][seg])
        start = start[np.searchsorted(seg[start], np.arange(m - k))]
        matches = np.cumsum(equal)
        out.append((lo[k:m] + step[start], lo[k:m] + step[end], matches[end] - matches[start]))
        k = m
    return tuple(np.concatenate(c) for c in zip(*out))


class Index:
    """Seeds of some benchmark items, sorted; items shorter than a window have one hash of all their tokens."""

    def __init__(self, ids: list, texts: list, min_tokens: int):
        self.ids = ids
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(len(ids) + 1, np.int64)
        parts = []
        for lo, hi, h, first in tc.tokens(pa.array(texts, pa.string())):
            self.first[lo : hi + 1] = first + len(self.hashes)
            self.hashes = np.concatenate([self.hashes, h])
        size = np.diff(self.first)
        pos = tc.row_starts(self.first, SPAN)
        for k in range(len(MASKS)):
            key = seeds(self.hashes, pos, k)
            parts.append((key, pos, _continues(key, pos)))
        short = np.flatnonzero((size >= min_tokens) & (size < SPAN))
        self.short = sorted(set(size[short].tolist()))
        parts.append((tc.Windows(self.hashes).at(self.first[short], size[short]) ^ size[short].astype(np.uint64), self.first[short], np.zeros(len(short), bool)))
        key, at, continues = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((continues, key))
        key, self.at = key[order], at[order]
        # Of each seed: its places, those that don't continue a run of it first.
        self.key, self.lo = np.unique(key, return_index=True)
        self.hi = np.append(self.lo[1:], len(key))
        self.runs = self.lo + (np.add.reduceat(~continues[order], self.lo, dtype=np.int64) if len(key) else 0)
        self.item = np.repeat(np.arange(len(ids)), size)
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[n, 3]: the distinct (row, item, place in h - place in the items' tokens) on which both have a seed. Runs of one seed,
        as of a repeated word, meet only at their ends, and hits are made and reduced to diagonals piece by piece."""
        found = [np.zeros((0, 3), np.int64)]

        def look(key, pos):
            maybe = self.bloom[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
            continues = _continues(key, pos)[maybe]
            key, pos = key[maybe], pos[maybe]
            slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[slot] == key
            slot, pos, continues = slot[hit], pos[hit], continues[hit]
            lo, n = self.lo[slot], np.where(continues, self.runs[slot], self.hi[slot]) - self.lo[slot]
            ends, k = np.cumsum(n), 0
            while k < len(pos):
                m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _AT_ONCE, "right")))
                at = self.at[np.repeat(lo[k:m] - ends[k:m] + n[k:m], n[k:m]) + np.arange(ends[k] - n[k], ends[m - 1])]
                p = np.repeat(pos[k:m], n[k:m])
                found.append(np.unique(np.stack([np.searchsorted(first, p, "right") - 1, self.item[at], p - at], axis=1), axis=0))
                k = m

        if len(self.key):
            pos = tc.row_starts(first, SPAN)
            for k in range(len(MASKS)):
                look(seeds(h, pos, k), pos)
            windows = tc.Windows(h) if self.short else None
            for n in self.short:
                pos = tc.row_starts(first, n)
                look(windows.at(pos, n) ^ np.uint64(n), pos)
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, h: np.ndarray, first: np.ndarray, min_match: int, min_share: float) -> list[np.ndarray]:
        """(row, item, start in row, start in item, length, matched) of verified overlaps: the best of each diagonal."""
        row, item, d = self.diagonals(h, first).T
        if not len(row):
            return [np.zeros(0, np.int64)] * 6
        begin, stop = self.first[item], self.first[item + 1]
        start, end, matched = best_stretches(h, self.hashes, np.maximum(begin, first[row] - d), np.minimum(stop, first[row + 1] - d), d)
        good = matched >= np.minimum(min_match, np.maximum(1, np.ceil(min_share * (stop - begin))))
        return [c[good] for c in (row, item, start + d - first[row], start - begin, end - start, matched)]


def _slices(benchmark: DataFrame, slice_tokens: int, min_tokens: int) -> list[Index]:
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # no text has more tokens
    n = int(size // slice_tokens) + 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        part.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Index([r.item_id for r in part], [r.text for r in part], min_tokens)


def overlaps(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 12, min_share: float = 0.8, min_tokens: int = 6, slice_tokens: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, item_start, length, matched) of every verified overlap, in tokens.

    An overlap counts if it has ``min_match`` equal tokens, or ``min_share`` of an item's if those are fewer, in one alignment
    in which each substitution is outweighed by two matches; of an alignment's best stretches the one that ends first counts, then the
    longest. Items of fewer than ``min_tokens`` tokens are ignored: they are words, and in most documents; those
    shorter than a window have to occur whole. Texts, long ones too, are compared whole. Null and empty texts, of either table, have no overlap; null ids are kept as they are; a
    repeated row gives its rows again, a repeated item doesn't. Only doc_id, text and item_id are read of the tables.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    found = None
    for index in _slices(benchmark, slice_tokens, min_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                items = pa.array(index.ids, pa.int64())
                for lo, _, h, first in tc.tokens(batch.column(1)):
                    row, item, *rest = index.overlaps(h, first, min_match, min_share)
                    if len(row):
                        yield pa.record_batch([batch.column(0).take(pa.array(lo + row)), items.take(pa.array(item)), *[pa.array(c) for c in rest]], names=["doc_id", "item_id", "start", "item_start", "length", "matched"])

        part = base.mapInArrow(tc.trimmed(run), "doc_id bigint, item_id bigint, start bigint, item_start bigint, length bigint, matched bigint")
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 12, min_share: float = 0.8, min_tokens: int = 6, slice_tokens: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose text has an overlap (see ``overlaps``); rows of null or empty text stay, repeated rows
    stay or go together. An empty table, of either kind, changes nothing."""
    from pyspark.sql.functions import arrow_udf

    def leak_test(shared):
        @arrow_udf("boolean")
        def leaks(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for lo, _, h, first in tc.tokens(texts):
                out[lo + shared.value.overlaps(h, first, min_match, min_share)[0]] = True
            tc.trim()
            return pa.array(out)

        return leaks

    for index in _slices(benchmark, slice_tokens, min_tokens):
        leaks = leak_test(docs.sparkSession.sparkContext.broadcast(index))
        flag = fresh(docs, "_leaks")
        docs = docs.withColumn(flag, leaks(docs["text"])).filter(~F.col(flag)).drop(flag)
    return docs

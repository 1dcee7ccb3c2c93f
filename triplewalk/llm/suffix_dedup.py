"""Passages that repeat across documents, by a difference-cover suffix sort, a bucket at a time.

A difference cover mod v holds two members at any distance: wherever two suffixes stand, at one shift below v both are *cover
samples*. With that, suffixes that tie for long are told apart by the ranks of samples, computed once, and no comparison reads on.

1. Cover samples are named by their first v tokens and go to buckets by name. Names of one document alone are dropped: nothing
   long is shared there. What stays are groups of samples that tie for v tokens.
2. The windows of the groups, one for each, and those at which ties end, are sorted by their tokens.
3. Within a group samples are ranked by prefix doubling: by the sample v tokens on, then 2v, 4v, ..., which belongs to the same
   document and so to the same task; only what still ties goes round again.
4. Suffixes of ``min_tokens`` near tied samples go to buckets by those tokens. A bucket is one run of the suffix array; it is sorted on its own, by
   the ranks of samples at the shift that two suffixes have in common, so memory is bounded by a bucket and no text is in it.
5. Neighbours of a bucket share ``min_tokens``; they return to their documents and are merged into passages.

Tokens are in the order of their 32-bit codes, and a text's end is below all. Equal names are equal 64-bit hashes.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blobs
from . import textcore as tc
from .cluster import cut, parallelism

COVERS = {13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
LEAST = 32
MESSAGES = "part int, kind string, blob binary"


class Cover:
    """The largest cover of which ``min_tokens`` hold a whole window after any shift."""

    def __init__(self, min_tokens: int):
        self.v = max(v for v in COVERS if 2 * v - 1 <= min_tokens)
        self.members = np.array(COVERS[self.v])
        #: Of a residue, its number among the members, or -1.
        self.number = np.full(self.v, -1)
        self.number[self.members] = np.arange(len(self.members))
        #: Of two residues, the least shift at which both are members.
        self.shift = np.array([[min(k for k in range(self.v) if self.number[(a + k) % self.v] >= 0 <= self.number[(b + k) % self.v]) for b in range(self.v)] for a in range(self.v)])


def codes(h: np.ndarray) -> np.ndarray:
    """By which tokens are in order; 0 is left for the end of a text."""
    return np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)


# Messages: packed integers, a row for each sender and target; those whose kind begins with = stay in their partition.


def _row(part: int, kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind]), pa.array([blobs.pack(*columns)], pa.binary())], names=["part", "kind", "blob"])


def _send(kind: str, part: np.ndarray, parts: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    rows = blobs.scatter(part.astype(np.int64), parts, np.ascontiguousarray(key).view(np.uint64), *columns)
    return pa.record_batch([rows.column(0), pa.array([kind] * rows.num_rows, pa.string()), rows.column(1)], names=["part", "kind", "blob"])


def _by(key: np.ndarray, parts: int) -> np.ndarray:
    return tc.mix(np.ascontiguousarray(key).view(np.uint64)) % np.uint64(parts)


class _Out:
    """Gathers records (part, key, columns) of a kind and sends them together."""

    def __init__(self, kind: str, parts: int, at_once: int):
        self.kind, self.parts, self.at_once, self.rows, self.n = kind, parts, at_once, [], 0

    def add(self, *columns: np.ndarray):
        self.rows.append(columns)
        self.n += len(columns[0])
        if self.n >= self.at_once:
            yield from self.flush()

    def flush(self):
        if self.n:
            part, *rest = (np.concatenate(c) for c in zip(*self.rows))
            yield _send(self.kind, part, self.parts, *rest)
        self.rows, self.n = [], 0


def _superstep(df: DataFrame, parts: int, step) -> DataFrame:
    """Exchanges the messages and runs ``step(part, {kind: columns})``."""

    def run(batches):
        box: dict[str, list] = {}
        part = None
        for batch in batches:
            for part_, kind, blob in zip(*(batch.column(k) for k in range(3))):
                part, kind = part_.as_py(), kind.as_py()
                columns = blobs.unpack(blob.as_py())
                if kind[0] != "=":
                    columns[0] = np.cumsum(columns[0])
                box.setdefault(kind, []).append(columns)
        if box:
            merged = {}
            for kind in list(box):
                merged[kind] = [np.concatenate(c) for c in zip(*box.pop(kind))]
            yield from step(part, merged)

    return df.repartitionById(parts, "part").mapInArrow(tc.trimmed(run), MESSAGES)


def _forget(spark: SparkSession) -> None:
    """Lets the driver forget, and so delete, the shuffles and checkpoints that no frame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _groups(key: np.ndarray, doc: np.ndarray, which: np.ndarray):
    """Of records sorted by key and document: (head of each key's run, number of the run of each record, whether two documents have it)."""
    new = _new(key)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(key)) - 1
    run = np.cumsum(new) - 1
    return head, run, (doc[head] != doc[last]) | (which[head] != which[last])


def _sampler(cover: Cover, min_tokens: int, parts: int):
    def run(batches):
        out = _Out("sample", parts, 600_000)
        for batch in batches:
            doc, which = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, h, first in tc.tokens(batch.column(2)):
                pos = tc.row_starts(first, cover.v)
                row = np.searchsorted(first, pos, "right") - 1
                place = pos - first[row]
                use = (cover.number[place % cover.v] >= 0) & (np.diff(first)[row] >= min_tokens)
                pos, row, place = pos[use], row[use], place[use]
                name = tc.Windows(h).at(pos, cover.v)
                yield from out.add(_by(name, parts), name, doc[lo + row], which[lo + row].astype(np.int32), place.astype(np.int32))
        yield from out.flush()

    return run


def _tie(parts: int):
    """The groups of a bucket: to the documents, and, as members, to be kept. One member stands for its group."""

    def step(part, box):
        name, doc, which, place = box["sample"]
        order = np.lexsort((place, which, doc, name))
        name, doc, which, place = name[order], doc[order], which[order], place[order]
        once = _new(name, doc, which, place)
        name, doc, which, place = name[once], doc[once], which[once], place[once]
        head, run, tied = _groups(name, doc, which)
        stands = np.zeros(len(name), bool)
        stands[head] = True
        keep = tied[run]
        name, doc, which, place, stands = name[keep], doc[keep], which[keep], place[keep], stands[keep]
        if len(name):
            yield _row(part, "=members", name, doc, which, place)
            yield _send("tied", _by(doc, parts), parts, doc, which, place, stands.astype(np.int16), name)

    return step


def _candidates(batches):
    """A row for each document: its tied samples."""
    found = [blobs.unpack(x.as_py()) for batch in batches for x in batch.column(2)]
    if not found:
        return
    for f in found:
        f[0] = np.cumsum(f[0])
    doc, which, place, stands, name = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((place, which, doc))
    doc, which, place, stands, name = (c[order] for c in (doc, which, place, stands, name))
    head = np.flatnonzero(_new(doc, which))
    edges = np.append(head, len(doc))
    slices = lambda c: pa.array([c[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
    yield pa.record_batch([pa.array(doc[head]), pa.array(which[head].astype(np.int64)), slices(place), slices(stands), slices(name)], names=["doc", "which", "places", "stands", "names"])


def _contents(cover: Cover, min_tokens: int, parts: int):
    """From texts: the tokens of windows that stand for a group, or at which a tie ends, to be sorted; the suffixes near tied samples."""
    v = cover.v

    def run(batches):
        content, suffix = _Out("content", parts, 60_000), _Out("suffix", parts, 400_000)
        for batch in batches:
            doc, which = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, h, first in tc.tokens(batch.column(2)):
                of = lambda k, kind: [np.frombuffer(batch.column(k)[r].as_buffer(), kind) for r in range(lo, hi)]
                places = of(3, np.int32)
                row = np.repeat(np.arange(hi - lo), [len(p) for p in places])
                at = np.concatenate(places).astype(np.int64) + first[row]
                stands, name = np.concatenate(of(4, np.int16)).astype(bool), np.concatenate(of(5, np.int64))
                stop = first[row + 1]
                # A tie ends where the next sample of its residue isn't tied, or the text has ended.
                tied = np.zeros(len(h) + v + 1, bool)
                tied[at] = True
                after = at + v
                ends = (after <= stop) & ~(tied[after] & (after < stop))
                start = np.concatenate([at[stands], after[ends]])
                of_row, stop = np.concatenate([row[stands], row[ends]]), np.concatenate([stop[stands], stop[ends]])
                to = start[:, None] + np.arange(v)
                window = np.where(to < stop[:, None], codes(h)[np.minimum(to, len(h) - 1)], np.uint32(0))
                part = (window[:, 0].astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
                key = np.concatenate([name[stands], np.zeros(int(ends.sum()), np.int64)])
                yield from content.add(part, key, doc[lo + of_row], which[lo + of_row].astype(np.int32), (start - first[of_row]).astype(np.int32), *np.ascontiguousarray(window.T).view(np.int32))
                near = np.zeros(len(h) + 1, np.int32)
                np.add.at(near, np.maximum(at - v + 1, first[row]), 1)
                np.add.at(near, at + 1, -1)
                pos = tc.row_starts(first, min_tokens)
                pos = pos[np.cumsum(near)[pos] > 0]
                of_row = np.searchsorted(first, pos, "right") - 1
                owner = doc[lo + of_row]
                yield from suffix.add(_by(owner, parts), owner, which[lo + of_row].astype(np.int32), (pos - first[of_row]).astype(np.int32), tc.signed(tc.Windows(h).at(pos, min_tokens)))
        yield from content.flush()
        yield from suffix.flush()

    return run


def _sort_windows(parts: int):
    """Ranks of windows by their tokens: of groups, to their members; of ends, to their documents."""

    def step(part, box):
        name, doc, which, place, *window = box["content"]
        order = np.lexsort((place, which, doc, *(c.view(np.uint32) for c in window[::-1])))
        name, doc, which, place = name[order], doc[order], which[order], place[order]
        rank = (np.int64(part) << np.int64(40)) + np.arange(len(name))
        # An end has no group; the hash 0 is as good as never a name.
        group = name != 0
        if group.any():
            yield _send("rank of group", _by(name[group], parts), parts, name[group], rank[group])
        end = ~group
        if end.any():
            yield _send("rank", _by(doc[end], parts), parts, doc[end], which[end], place[end], rank[end], np.zeros(int(end.sum()), np.int16))

    return step


def _to_members(parts: int):
    def step(part, box):
        if "=members" not in box:
            return
        name, doc, which, place = box["=members"]
        known, rank = box["rank of group"]
        order = np.argsort(known, kind="stable")
        name = name.view(np.int64)
        at = order[np.searchsorted(known, name, sorter=order)]
        yield _send("rank", _by(doc, parts), parts, doc, which, place, rank[at], np.ones(len(doc), np.int16))

    return step


class _Samples:
    """Of the documents of a part, sorted: place, rank of the window, rank within the group, whether that ties."""

    def __init__(self, box: dict):
        if "=state" in box:
            self.doc, self.which, self.place, self.rank, self.sub, self.open = box["=state"]
        else:
            doc, which, place, rank, open_ = box["rank"]
            order = np.lexsort((place, which, doc))
            order = order[_new(doc[order], which[order], place[order])]
            self.doc, self.which, self.place, self.rank, self.open = (c[order] for c in (doc, which, place, rank, open_))
            self.sub = np.zeros(len(order), np.int64)
        self.head = np.flatnonzero(_new(self.doc, self.which))
        self.number = np.cumsum(_new(self.doc, self.which)) - 1
        self.key = (self.number << 32) | self.place
        if "update" in box:
            doc, which, place, sub, open_ = box["update"]
            at, _ = self.find(self.numbers(doc, which), place)
            self.sub[at], self.open[at] = sub, open_

    def numbers(self, doc: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Numbers of documents here, -1 for others."""
        n = len(self.head)
        names = np.concatenate([self.doc[self.head], doc])
        texts = np.concatenate([self.which[self.head], which])
        order = np.lexsort((np.arange(len(names)), texts, names))
        run = np.cumsum(_new(names[order], texts[order])) - 1
        of = np.full(run[-1] + 1 if len(run) else 0, -1)
        mine = order < n
        of[run[mine]] = order[mine]
        out = np.empty(len(names), np.int64)
        out[order] = of[run]
        return out[n:]

    def find(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the sample is, whether there is one)."""
        want = (number << 32) | place
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return at, (number >= 0) & (self.key[at] == want)


def _ask(reach: int, parts: int):
    """Samples that tie ask for their group, with the rank of the sample ``reach`` tokens on."""

    def step(part, box):
        s = _Samples(box)
        yield _row(part, "=state", s.doc, s.which, s.place, s.rank, s.sub, s.open)
        i = np.flatnonzero(s.open)
        if len(i):
            at, there = s.find(s.number[i], s.place[i].astype(np.int64) + reach)
            alone = tc.signed(tc.mix(tc.mix(s.doc[i].view(np.uint64)) + (s.which[i].astype(np.uint64) << np.uint64(32)) + s.place[i].astype(np.uint64)))
            yield _send("ask", _by(s.rank[i], parts), parts, s.rank[i], s.sub[i], np.where(there, s.rank[at], -1), np.where(there, s.sub[at], alone), s.doc[i], s.which[i], s.place[i])

    return step


def _refine(parts: int):
    def step(part, box):
        if "=state" in box:
            yield _row(part, "=state", *box["=state"])
        if "ask" not in box:
            return
        rank, sub, rank2, sub2, doc, which, place = box["ask"]
        order = np.lexsort((sub2, rank2, sub, rank))
        rank, sub, rank2, sub2, doc, which, place = (c[order] for c in (rank, sub, rank2, sub2, doc, which, place))
        group = np.flatnonzero(_new(rank, sub))
        run = np.cumsum(_new(rank, sub)) - 1
        apart = _new(rank, sub, rank2, sub2)
        head = np.flatnonzero(apart)
        size = np.diff(np.append(head, len(rank)))
        at = np.repeat(head, size)
        open_ = np.repeat(size > 1, size)
        yield _send("update", _by(doc, parts), parts, doc, which, place, sub + at - group[run], open_.astype(np.int16))
        yield _row(part, "=open", np.array([int(open_.sum())]))

    return step


def _to_buckets(cover: Cover, parts: int):
    """Suffixes, with the ranks within their groups of the samples that follow, to the bucket of their first tokens."""

    def step(part, box):
        if "suffix" not in box or not ("=state" in box or "rank" in box):
            return
        s = _Samples(box)
        doc, which, place, name = box["suffix"]
        number = s.numbers(doc, which)
        subs = []
        for d in cover.members:
            at, there = s.find(number, place.astype(np.int64) + (d - place) % cover.v)
            subs.append(np.where(there, s.sub[at], -1))
        yield _send("suffix", _by(name, parts), parts, name, doc, which, place, *subs)

    return step


def sorted_places(cover: Cover, group: np.ndarray, place: np.ndarray, subs: list[np.ndarray]) -> np.ndarray:
    """The place of each suffix in its group. Suffixes of two residues compare at the shift that both have in common: each counts
    how many of every residue are below it."""
    residue = place % cover.v
    below = np.zeros(len(group), np.int64)
    wide = int(max((s.max(initial=0) for s in subs), default=0)) + 2
    mixed = np.zeros(int(group.max(initial=-1)) + 1, bool)
    if len(group):
        least, most = np.full(len(mixed), cover.v), np.full(len(mixed), -1)
        np.minimum.at(least, group, residue)
        np.maximum.at(most, group, residue)
        mixed = least != most
    of = [np.flatnonzero(residue == a) for a in range(cover.v)]
    of_mixed = [x[mixed[group[x]]] for x in of]
    for a in range(cover.v):
        for b in range(cover.v):
            x, y = (of[a], of[b]) if a == b else (of_mixed[a], of_mixed[b])
            if len(x) and len(y):
                k = cover.shift[a, b]
                mine = group[x] * wide + subs[cover.number[(a + k) % cover.v]][x] + 1
                theirs = np.sort(group[y] * wide + subs[cover.number[(b + k) % cover.v]][y] + 1)
                below[x] += np.searchsorted(theirs, mine) - np.searchsorted(theirs, group[x] * wide)
    return below


def _order(cover: Cover, parts: int):
    """Sorts a bucket. Of suffixes that another document has, too: whether this is the least document, and which documents stand
    beside it in the order of suffixes."""

    def step(part, box):
        name, doc, which, place, *subs = box["suffix"]
        order = np.lexsort((place, which, doc, name))
        order = order[_new(name[order], doc[order], which[order], place[order])]
        name, doc, which, place, subs = name[order], doc[order], which[order], place[order], [s[order] for s in subs]
        head, run, tied = _groups(name, doc, which)
        first = (doc == doc[head][run]) & (which == which[head][run])
        keep = tied[run]
        if not keep.any():
            return
        doc, which, place, first, group, subs = doc[keep], which[keep], place[keep], first[keep], run[keep], [s[keep] for s in subs]
        order = np.lexsort((sorted_places(cover, group, place, subs), group))
        doc, which, place, first, group = doc[order], which[order], place[order], first[order], group[order]
        # Beside a run of one document's suffixes stand the last of the run before and the first of the next, within the group.
        begins = _new(group, doc, which)
        start = np.flatnonzero(begins)
        nth = np.cumsum(begins) - 1
        before, after = start - 1, np.append(start[1:], len(doc))
        has_before = (before >= 0) & (group[np.maximum(before, 0)] == group[start])
        has_after = (after < len(doc)) & (group[np.minimum(after, len(doc) - 1)] == group[start])
        flags = first + 2 * has_before[nth] + 4 * has_after[nth]
        yield _send("found", _by(doc, parts), parts, doc, which, place, flags.astype(np.int16), np.where(has_before, doc[np.maximum(before, 0)], 0)[nth], np.where(has_after, doc[np.minimum(after, len(doc) - 1)], 0)[nth])

    return step


FOUND = "doc bigint, which bigint, start bigint, end bigint, is_first boolean, before_id bigint, after_id bigint"


def _passages(min_tokens: int):
    def run(batches):
        found = [blobs.unpack(x.as_py()) for batch in batches for x in batch.column(2)]
        if not found:
            return
        for f in found:
            f[0] = np.cumsum(f[0])
        doc, which, place, flags, before, after = (np.concatenate(c) for c in zip(*found))
        first = flags & 1
        order = np.lexsort((place, first, which, doc))
        doc, which, place, flags, first, before, after = (c[order] for c in (doc, which, place, flags, first, before, after))
        new = _new(doc, which, first)
        new[1:] |= place[1:] > place[:-1].astype(np.int64) + min_tokens
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(doc)) - 1
        beside = [pa.array(c[head], mask=flags[head] & bit == 0) for c, bit in ((before, 2), (after, 4))]
        yield pa.record_batch([pa.array(doc[head]), pa.array(which[head].astype(np.int64)), pa.array(place[head].astype(np.int64)), pa.array(place[last].astype(np.int64) + min_tokens), pa.array(first[head] > 0), *beside], names=["doc", "which", "start", "end", "is_first", "before_id", "after_id"])

    return run


def _texts(docs: DataFrame, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """(rows doc, which, text; doc, which, sum of each document). ``which`` numbers the texts of a doc_id that has several, by their
    64-bit sums, so that a document is exact without a sum in every record."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("sum"), F.col("text").alias("text")).filter("doc is not null and text is not null")
    documents = cut(rows.select("doc", "sum").distinct())
    several = documents.groupBy("doc").count().filter("count > 1").select("doc")
    numbered = cut(documents.join(several, "doc").withColumn("which", F.row_number().over(Window.partitionBy("doc").orderBy("sum"))))
    one = documents.join(several, "doc", "left_anti").withColumn("which", F.lit(0))
    names = numbered.select("doc", "sum", "which").unionByName(one.select("doc", "sum", "which"))
    marks = F.broadcast(numbered) if numbered.count() <= most_broadcast else numbered
    return rows.join(marks, ["doc", "sum"], "left").select("doc", F.coalesce("which", F.lit(0)).cast("bigint").alias("which"), "text"), names


def repeated_passages(docs: DataFrame, *, min_tokens: int = 50, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, text_sum, start, end, is_first, before_id, after_id): passages, as token ranges, all of whose runs of ``min_tokens`` tokens
    stand in another document, too; not all of them need to stand in the same one. ``is_first``: the occurrence in the least document,
    which deduplication keeps; the others are to go. Overlapping and adjoining runs are merged, first and other ones apart. ``before_id`` and
    ``after_id`` are the other documents that stand next to the passage's start in the order of suffixes, null if none does: no document has
    a longer match from there on than one of the two.

    A document is its doc_id and the 64-bit hash of its text, ``text_sum``; rows that repeat both are one document, repeats within a
    document don't count. Documents are in order of doc_id, then text_sum; so are suffixes that are alike up to the ends of their texts. Rows
    with a null doc_id or text, and texts shorter than ``min_tokens``, have no passages. Long texts are taken whole, at about 100 bytes a
    token for one text at a time; n tokens that repeat take log(n) rounds. Only doc_id and text are read. ``min_tokens`` is at least 32.
    Up to ``most_broadcast`` documents that share their doc_id with another are broadcast; more are joined.
    """
    if min_tokens < LEAST:
        raise ValueError(f"min_tokens must be {LEAST} or more")
    spark = docs.sparkSession
    parts = parallelism(spark)
    cover = Cover(min_tokens)
    base, names = _texts(docs, most_broadcast)
    tied = cut(_superstep(base.mapInArrow(tc.trimmed(_sampler(cover, min_tokens, parts)), MESSAGES), parts, _tie(parts)))
    _forget(spark)
    of_documents = tied.filter("kind = 'tied'").repartitionById(parts, "part").mapInArrow(_candidates, "doc bigint, which bigint, places binary, stands binary, names binary")
    texts = base.join(of_documents, ["doc", "which"]).select("doc", "which", "text", "places", "stands", "names")
    near = cut(texts.mapInArrow(tc.trimmed(_contents(cover, min_tokens, parts)), MESSAGES))
    del texts, of_documents
    _forget(spark)
    windows = cut(_superstep(near.filter("kind = 'content'"), parts, _sort_windows(parts)))
    members = _superstep(tied.filter("kind = '=members'").union(windows.filter("kind = 'rank of group'")), parts, _to_members(parts))
    samples, reach = windows.filter("kind = 'rank'").union(members), cover.v
    del tied, windows, members
    while True:
        samples = cut(_superstep(_superstep(samples.filter("kind <> '=open'"), parts, _ask(reach, parts)), parts, _refine(parts)))
        _forget(spark)
        reach *= 2
        left = [blobs.unpack(r.blob)[0][0] for r in samples.filter("kind = '=open'").select("blob").collect()]
        if not sum(left):
            break
    buckets = _superstep(samples.filter("kind <> '=open'").union(near.filter("kind = 'suffix'")), parts, _to_buckets(cover, parts))
    found = cut(_superstep(buckets, parts, _order(cover, parts)))
    del samples, near, buckets
    _forget(spark)
    passages = found.repartitionById(parts, "part").mapInArrow(_passages(min_tokens), FOUND)
    return passages.join(names, ["doc", "which"]).select(F.col("doc").alias("doc_id"), F.col("sum").alias("text_sum"), "start", "end", "is_first", "before_id", "after_id")

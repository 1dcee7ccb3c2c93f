"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Lists begin within blocks that random hyperplanes cut out. Vectors are spread over parts by hash. All work is supersteps: messages, packed into one row for each pair of parts, are exchanged by part, and
each part handles its own. A descent round joins neighbours with neighbours: nodes tell those they list (reverse lists), send
their vector, once to each part that needs it, and every node compares the nodes of its own and its reverse list with one another; pairs that
improve a list go back to the list's part. Search keeps a beam for each query, asks the parts of its best unexpanded nodes for
their neighbours and the parts of unseen neighbours for similarities. Rounds are cut in the shared folder.
"""

from __future__ import annotations

import gc
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from . import textcore as tc
from .cluster import cut, parallelism

SCHEMA = "part int, kind string, blob binary"
_WORST = np.float32(-2)


def _hash(ids: np.ndarray, parts: int, salt: int = 0) -> np.ndarray:
    return (tc.mix(ids.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(parts)).astype(np.int64)


def _rows(out) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([pickle.dumps(x[2], 5) for x in out], pa.binary())], names=["part", "kind", "blob"])


def superstep(df: DataFrame, parts: int, step) -> DataFrame:
    """Exchanges the messages and runs ``step(part, {kind: [payload]})``, which yields (part, kind, payload)."""

    def run(batches):
        box: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            for part, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                box[part][kind].append(pickle.loads(blob))
        for part in sorted(box):
            yield _rows(list(step(part, box.pop(part))))

    return df.repartitionById(parts, "part").mapInArrow(run, SCHEMA)


def _join(chunks: list[dict]) -> dict:
    out = {k: np.concatenate([c[k] for c in chunks]) for k in chunks[0]}
    order = np.argsort(out["nid"], kind="stable")
    return {k: v[order] for k, v in out.items()}


def _split(target: np.ndarray, *columns: np.ndarray):
    """(target, columns of its records)."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    at = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else []
    for a, b in zip(at, [*at[1:], len(target)]):
        yield int(target[a]), tuple(c[order[a:b]] for c in columns)


def _top(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int, *more: np.ndarray):
    """Of each owner the ``most`` best distinct others, by falling similarity, then rising id; with their rank."""
    order = np.lexsort((-sim, other, owner))
    owner, other, sim, more = owner[order], other[order], sim[order], [m[order] for m in more]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim, more = owner[keep], other[keep], sim[keep], [m[keep] for m in more]
    order = np.lexsort((other, -sim, owner))
    owner = owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank < most
    order = order[keep]
    return owner[keep], other[order], sim[order], rank[keep], *[m[order] for m in more]


def _block_lists(nid: np.ndarray, vec: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact neighbours within a block, padded with -1."""
    n = len(nid)
    ids, sims = np.full((n, most), -1, np.int64), np.full((n, most), _WORST, np.float32)
    k = min(most, n - 1)
    for lo in range(0, n if k > 0 else 0, 512):
        x = vec[lo : lo + 512] @ vec.T
        x[np.arange(len(x)), np.arange(lo, lo + len(x))] = -9
        top = np.argpartition(-x, k - 1, axis=1)[:, :k]
        ids[lo : lo + 512, :k], sims[lo : lo + 512, :k] = nid[top], np.take_along_axis(x, top, 1)
    return ids, sims


def _reverse(parts: int, s: dict):
    n, k = s["ids"].shape
    v, u, f = s["ids"].ravel(), np.repeat(s["nid"], k), s["new"].ravel()
    ok = v >= 0
    for q, (a, b, c) in _split(_hash(v[ok], parts), v[ok], u[ok], f[ok]):
        yield q, "reverse", blobs.pack(a, b, c.astype(np.int32))


#: Nodes of a block at most; a part's nodes, beyond what the session's parallelism takes.
BLOCK, PART_NODES = 1000, 50_000


def _codes(vec: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """On which sides of ``bits`` random hyperplanes vectors lie, as a number."""
    planes = np.random.default_rng([salt, 977]).normal(size=(vec.shape[1], bits)).astype(np.float32)
    return (vec @ planes > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vec), np.int64)


def _to_blocks(s: dict, parts: int, bits: int, salt: int):
    names = list(s)
    for q, cols in _split(_hash(_codes(s["vec"], bits, salt), parts, salt), *s.values()):
        yield q, "block", dict(zip(names, cols))


def _spread(parts: int, bits: int, k: int):
    def step(part, box):
        s = _join(box["load"])
        s["ids"], s["sims"] = np.full((len(s["nid"]), k), -1, np.int64), np.full((len(s["nid"]), k), _WORST, np.float32)
        yield from _to_blocks(s, parts, bits, 0)

    return step


def _blocks(parts: int, bits: int, salt: int, last: bool):
    """Exact neighbours within blocks of BLOCK nodes at most, which lie on one side of the hyperplanes, are merged into the lists."""

    def step(part, box):
        s = _join(box["block"])
        n, k = s["ids"].shape
        code = _codes(s["vec"], bits, salt)
        order = np.lexsort((tc.mix(s["nid"].view(np.uint64)), code))
        edges = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        own, other, sim = [np.repeat(np.arange(n), k)], [s["ids"].ravel()], [s["sims"].ravel()]
        for of in np.split(order, edges[1:]):
            for block in np.array_split(of, -(-len(of) // BLOCK)):
                ids, sims = _block_lists(s["nid"][block], s["vec"][block], k)
                own.append(np.repeat(block, k))
                other.append(ids.ravel())
                sim.append(sims.ravel())
        own, other, sim = np.concatenate(own), np.concatenate(other), np.concatenate(sim)
        ok = other >= 0
        a, b, c, r = _top(own[ok], other[ok], sim[ok], k)
        s["ids"][:], s["sims"][:] = -1, _WORST
        s["ids"][a, r], s["sims"][a, r] = b, c
        if not last:
            yield from _to_blocks(s, parts, bits, salt + 1)
            return
        s["new"] = np.ones((n, k), bool)
        yield from _reverse(parts, s)
        names = list(s)
        for q, cols in _split(_hash(s["nid"], parts), *s.values()):
            yield q, "state", dict(zip(names, cols))

    return step


def _meet(parts: int, reverse: int):
    """Own and reverse lists of each node, and the vectors to where they're needed."""

    def step(part, box):
        s = _join(box["state"])
        n, k = s["ids"].shape
        found = [blobs.unpack(b) for b in box["reverse"]]
        v, u, f = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(s["nid"], v)
        # Of long reverse lists, new ones first, then by hash: a sample, as the method has it.
        order = np.lexsort((tc.mix(u.view(np.uint64) ^ v.view(np.uint64)), -f, at))
        at, u, f = at[order], u[order], f[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        some = rank < reverse
        members, fresh_ = np.full((n, k + reverse), -1, np.int64), np.zeros((n, k + reverse), bool)
        members[:, :k], fresh_[:, :k] = s["ids"], s["new"]
        members[at[some], k + rank[some]], fresh_[at[some], k + rank[some]] = u[some], f[some] > 0
        yield part, "sets", (members, fresh_)
        ok = s["ids"].ravel() >= 0
        owner, other = np.concatenate([np.repeat(np.arange(n), k)[ok], at, np.arange(n)]), np.concatenate([s["ids"].ravel()[ok], u, s["nid"]])
        pair = np.unique(owner * parts + _hash(other, parts))
        for q, (own,) in _split(pair % parts, pair // parts):
            yield q, "vectors", {"nid": s["nid"][own], "vec": s["vec"][own].astype(np.float16), "limit": s["sims"][own].min(axis=1)}
        yield part, "state", s

    return step


def _compare(parts: int, most: int):
    def step(part, box):
        s, known = _join(box["state"]), _join(box["vectors"])
        (members, fresh_), out = box["sets"][0], []
        vec, nid, limit = known["vec"].astype(np.float32), known["nid"], known["limit"]
        upper = np.triu(np.ones((members.shape[1],) * 2, bool), 1)
        for lo in range(0, len(members), 128):
            m, f = members[lo : lo + 128], fresh_[lo : lo + 128]
            at = np.minimum(np.searchsorted(nid, m), len(nid) - 1)
            x = vec[at]
            x = x @ x.transpose(0, 2, 1)
            ok = upper & (m >= 0)[:, :, None] & (m >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :]) & (m[:, :, None] != m[:, None, :])
            for flip in (False, True):
                good = ok & (x > (limit[at][:, None, :] if flip else limit[at][:, :, None]))
                r, a, b = np.nonzero(good)
                a_, b_ = (m[r, b], m[r, a]) if flip else (m[r, a], m[r, b])
                out.append((a_, b_, x[r, a, b]))
            if sum(len(o[0]) for o in out) > 6_000_000:
                out = [_top(*(np.concatenate(c) for c in zip(*out)), most)[:3]]
        a, b, c, _ = _top(*(np.concatenate(x) for x in zip(*out)), most)
        for q, (a, b, c) in _split(_hash(a, parts), a, b, c):
            yield q, "updates", blobs.pack(a, b, c.astype(np.float32).view(np.int32))
        s["new"][:] = False
        yield part, "state", s

    return step


def _merge(parts: int):
    def step(part, box):
        s = _join(box["state"])
        n, k = s["ids"].shape
        ups = [blobs.unpack(b) for b in box["updates"]]
        changed = 0
        if ups:
            a, b, c = (np.concatenate(x) for x in zip(*ups))
            ok = s["ids"].ravel() >= 0
            own = np.concatenate([np.repeat(np.arange(n), k)[ok], np.searchsorted(s["nid"], a)])
            other = np.concatenate([s["ids"].ravel()[ok], b])
            sim = np.concatenate([s["sims"].ravel()[ok], c.view(np.float32)])
            fresh_ = np.concatenate([np.zeros(ok.sum(), bool), np.ones(len(a), bool)])
            # A pair that is listed already is no news, whatever rounding its similarity has.
            key = np.lexsort((fresh_, other, own))
            o2, t2 = own[key], other[key]
            once = np.append(True, (o2[1:] != o2[:-1]) | (t2[1:] != t2[:-1]))
            key = key[once]
            own, other, sim, rank, fresh_ = _top(own[key], other[key], sim[key], k, fresh_[key])
            s["ids"][:], s["sims"][:], s["new"][:] = -1, _WORST, False
            s["ids"][own, rank], s["sims"][own, rank], s["new"][own, rank] = other, sim, fresh_
            changed = int(s["new"].sum())
        yield part, "changed", (changed, n * k)
        yield from _reverse(parts, s)
        yield part, "state", s

    return step


def _settle(df: DataFrame) -> DataFrame:
    """Cuts, then lets the driver forget, and so delete, the shuffles behind."""
    done = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def vectors_of(df: DataFrame, key: str, column: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """(numbered rows nid, key; messages "load" with unit vectors). Rows whose vector is null or empty, has a null or a number that is not finite, or
    another length than most, are left out; zero vectors stay and are like nothing (similarity 0)."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{column}`").cast("array<float>").alias("vec")).filter(F.size("vec") > 0).filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = cut(rows.filter(F.size("vec") == (sizes[0].d if sizes else 1))).withColumn("nid", F.monotonically_increasing_id())

    def load(batches):
        for batch in batches:
            if batch.num_rows:
                nid = batch.column(0).to_numpy(zero_copy_only=False)
                vec = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(nid), -1).astype(np.float32)
                vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-30)
                yield _rows([(q, "load", {"nid": a, "vec": b}) for q, (a, b) in _split(_hash(nid, parts), nid, vec)])

    return rows.select("nid", "key"), rows.select("nid", "vec").mapInArrow(load, SCHEMA)


def _final(part, box):
    """The graph as search needs it."""
    s = _join(box["state"])
    yield part, "state", {k: s[k] for k in ("nid", "vec", "ids", "sims")}


def build(loads: DataFrame, parts: int, *, n: int, k: int = 60, reverse: int = 30, passes: int = 4, stop: float = 0.02) -> DataFrame:
    """Messages "state" with the neighbour lists of each part: ``k`` neighbours of each of the ``n`` nodes.

    Lists begin with the neighbours within blocks of BLOCK nodes, which random hyperplanes cut out, ``passes`` times; descent rounds follow
    until fewer than ``stop`` of the entries are new. A node meets all of its own list and ``reverse`` of those that list it, new ones
    first: the sample of the method."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / BLOCK))))
    graph = superstep(loads, parts, _spread(parts, bits, k))
    for salt in range(passes):
        graph = superstep(graph, parts, _blocks(parts, bits, salt, salt == passes - 1))
    graph = _settle(graph)
    while True:
        met = superstep(graph.filter("kind in ('state', 'reverse')"), parts, _meet(parts, reverse))
        graph = _settle(superstep(superstep(met, parts, _compare(parts, k // 2)), parts, _merge(parts)))
        news = [pickle.loads(r.blob) for r in graph.filter("kind = 'changed'").select("blob").collect()]
        if sum(c for c, _ in news) <= stop * sum(n for _, n in news):
            break
    return _settle(superstep(graph.filter("kind = 'state'"), parts, _final))


# Search. A beam is a part's queries with, for each, its best nodes so far and which of them are still to be expanded.


def _beam(q: dict, ef: int, own: np.ndarray, other: np.ndarray, sim: np.ndarray, open_: np.ndarray) -> None:
    """Merges (query's place, node, similarity, to be expanded) into the beam."""
    held = q["ids"].ravel() >= 0
    slots = np.repeat(np.arange(len(q["nid"])), ef)[held]
    own, other, sim, rank, open_ = _top(np.concatenate([slots, own]), np.concatenate([q["ids"].ravel()[held], other]), np.concatenate([q["sims"].ravel()[held], sim]), ef, np.concatenate([q["open"].ravel()[held], open_]))
    q["ids"][:], q["sims"][:], q["open"][:] = -1, _WORST, False
    q["ids"][own, rank], q["sims"][own, rank], q["open"][own, rank] = other, sim, open_


def _next(part: int, parts: int, q: dict, at_once: int):
    """The beam, and the best nodes in it that are still to be expanded."""
    take = q["open"] & (np.cumsum(q["open"], axis=1) <= at_once)
    q["open"] &= ~take
    ask, slot = np.nonzero(take)
    node = q["ids"][ask, slot]
    yield part, "beam", q
    yield part, "asked", len(ask)
    for p, (a, b) in _split(_hash(node, parts), q["nid"][ask], node):
        yield p, "expand", (part, a, b)


def _start(parts: int, ef: int, seeds: np.ndarray | None):
    """Without seeds the queries are the nodes, each of which starts from its own list; with seeds, from those, unscored yet."""

    def step(part, box):
        if not box["load"]:
            return
        q = _join(box["load"])
        n = len(q["nid"])
        q |= {"ids": np.full((n, ef), -1, np.int64), "sims": np.full((n, ef), _WORST, np.float32), "open": np.zeros((n, ef), bool)}
        if seeds is None:
            s = _join(box["state"])
            best = s["ids"][:, :ef]
            ok = best.ravel() >= 0
            yield part, "lists", blobs.pack(np.append(np.repeat(s["nid"], best.shape[1])[ok], s["nid"]), np.append(best.ravel()[ok], s["nid"]))
            yield part, "beam", q
            yield part, "asked", n
            return
        yield part, "beam", q
        yield part, "asked", n * len(seeds)
        for p, (node,) in _split(_hash(seeds, parts), seeds):
            yield p, "expand", (part, np.repeat(q["nid"], len(node)), np.tile(node, n))

    return step


def _expand(parts: int, ef: int, at_once: int):
    def step(part, box):
        if not box["beam"]:
            return
        q = box["beam"][0]
        found = [blobs.unpack(b) for b in box["answers"]]
        if found:
            i, c, x = (np.concatenate(y) for y in zip(*found))
            _beam(q, ef, np.searchsorted(q["nid"], i), c, x.view(np.float32), np.ones(len(i), bool))
        yield from _next(part, parts, q, at_once)

    return step


def _neighbours(degree: int):
    """The best of the lists of expanded nodes, and the nodes themselves, to the queries that asked."""

    def step(part, box):
        if box["state"]:
            s = _join(box["state"])
            for home, query, node in box["expand"]:
                at = np.minimum(np.searchsorted(s["nid"], node), len(s["nid"]) - 1)
                lists = np.concatenate([s["nid"][at][:, None], s["ids"][at, :degree]], axis=1)
                owner, flat = np.repeat(query, lists.shape[1]), lists.ravel()
                yield home, "lists", blobs.pack(owner[flat >= 0], flat[flat >= 0])
        for kind in ("beam", "lists"):
            for payload in box[kind]:
                yield part, kind, payload

    return step


def _ask(parts: int):
    """Which of the nodes that came aren't in the beam, to where their vectors are."""

    def step(part, box):
        if not box["beam"]:
            return
        q = box["beam"][0]
        found = [blobs.unpack(b) for b in box["lists"]]
        if found:
            n, ef = q["ids"].shape
            i, c = (np.concatenate(y) for y in zip(*found))
            i = np.searchsorted(q["nid"], i)
            held = q["ids"].ravel() >= 0
            fresh_ = np.append(np.zeros(held.sum(), bool), np.ones(len(i), bool))
            i, c = np.append(np.repeat(np.arange(n), ef)[held], i), np.append(q["ids"].ravel()[held], c)
            order = np.lexsort((fresh_, c, i))
            i, c, fresh_ = i[order], c[order], fresh_[order]
            once = np.append(True, (i[1:] != i[:-1]) | (c[1:] != c[:-1])) & fresh_
            for p, (a, b) in _split(_hash(c[once], parts), i[once], c[once]):
                rows, local = np.unique(a, return_inverse=True)
                yield p, "ask", (part, q["nid"][rows], q["vec"][rows], q["sims"][rows].min(axis=1), blobs.pack(local.astype(np.int32), b))
        yield part, "beam", q

    return step


def _answer(part, box):
    if box["state"]:
        s = _join(box["state"])
        for home, query, vec, limit, pairs in box["ask"]:
            local, cand = blobs.unpack(pairs)
            at = np.searchsorted(s["nid"], cand)
            for lo in range(0, len(at), 1 << 18):
                i, a = local[lo : lo + (1 << 18)], at[lo : lo + (1 << 18)]
                sim = np.einsum("ij,ij->i", vec[i], s["vec"][a])
                good = sim > limit[i]
                yield home, "answers", blobs.pack(query[i[good]], s["nid"][a[good]], sim[good].astype(np.float32).view(np.int32))
    if box["beam"]:
        yield part, "beam", box["beam"][0]


def search(graph: DataFrame, loads: DataFrame, parts: int, *, ef: int = 24, at_once: int = 6, degree: int = 20, seeds: np.ndarray | None = None) -> DataFrame:
    """(query nid, node nid, similarity): the best ``ef`` nodes of each query, greedily: the ``at_once`` best unexpanded nodes
    of the beam are expanded in each round, by the ``degree`` nearest of their lists, until none is left. Without ``seeds`` the queries
    are the graph's own nodes, and start from their lists; others start at the seeds. A query that is a node finds itself, too."""
    beams = superstep(loads.unionByName(graph) if seeds is None else loads, parts, _start(parts, ef, seeds))
    while True:
        lists = superstep(beams.filter("kind in ('beam', 'expand', 'lists')").unionByName(graph), parts, _neighbours(degree))
        answers = superstep(superstep(lists, parts, _ask(parts)).unionByName(graph), parts, _answer)
        beams = _settle(superstep(answers, parts, _expand(parts, ef, at_once)))
        if not sum(pickle.loads(r.blob) for r in beams.filter("kind = 'asked'").select("blob").collect()):
            break

    def pairs(batches):
        for batch in batches:
            for blob in batch.column(0):
                q = pickle.loads(blob.as_py())
                r, c = np.nonzero(q["ids"] >= 0)
                yield pa.record_batch([pa.array(q["nid"][r]), pa.array(q["ids"][r, c]), pa.array(q["sims"][r, c])], names=["query", "node", "similarity"])

    return beams.filter("kind = 'beam'").select("blob").mapInArrow(pairs, "query bigint, node bigint, similarity float")


def neighbours(df: DataFrame, *, key: str = "vec_id", column: str = "embedding", most: int = 10, k: int = 60, reverse: int = 30, ef: int = 24, at_once: int = 6, degree: int = 20) -> DataFrame:
    """(``key``, neighbor_id, rank, similarity): the ``most`` rows most like each row by cosine, itself left out.

    Every row with a usable vector is a node and a query (see ``vectors_of``). Rows that repeat are rows of their own, and neighbours of
    one another; null keys are kept. Similarities that tie are ranked by the neighbour's key (null first). Fewer rows than
    ``most`` + 1 give fewer neighbours; an empty table none. Only the two columns are read.

    ``k`` and ``reverse`` shape the graph (see ``build``), ``ef``, ``at_once`` and ``degree`` the search (see ``search``); both go on until
    they have converged. What a worker holds is bounded by PART_NODES, whatever the table's size."""
    n = df.count()
    parts = int(max(min(parallelism(df.sparkSession), 1 + n // BLOCK), 1 + n // PART_NODES))
    names, loads = vectors_of(df, key, column, parts)
    names, loads = cut(names), cut(loads)
    graph = build(loads, parts, n=n, k=k, reverse=reverse)
    found = search(graph, loads, parts, ef=max(ef, most + 1), at_once=at_once, degree=degree).filter("query <> node")
    out = found.join(names.select(F.col("nid").alias("query"), F.col("key").alias("a")), "query").join(names.select(F.col("nid").alias("node"), F.col("key").alias("b")), "node")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "b", "node"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("a").alias(key), F.col("b").alias("neighbor_id"), "rank", "similarity")

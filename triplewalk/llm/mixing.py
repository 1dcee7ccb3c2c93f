"""Mixing sources to target weights by subset sums.

1. Documents are counted by (source, exact token length); nothing else of the corpus reaches the planning.
2. The token budget is shared out by weight; what a source lacks goes to the others, by weight again.
3. For each source, lengths are taken in proportion until what is left of its budget is small; a bounded-knapsack dynamic
   programme over the documents that are left hits the rest exactly, or as closely from below as those documents can.
4. For each (source, length) that many documents are selected by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import cut, fresh, is_empty


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for lo, hi in tc.chunks(texts):
        raw, at = tc.flat(texts.slice(lo, hi - lo), lower=False)
        if len(raw):
            word = ~_SPACE[raw]
            start = word.copy()
            start[1:] &= ~word[:-1]
            inner = at[:-1][np.diff(at) > 0]
            start[inner] = word[inner]
            out[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(start)])[at])
    return out


def word_count(text: Column) -> Column:
    """Number of maximal runs without (ASCII) white space; 0 for null. Counted in one vectorised pass over the bytes."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        out = pa.array(count_words(texts))
        tc.trim()
        return out

    return count(text)


def tokenizer_count(path: str):
    """Column -> number of tokens by the public tokenizer file at ``path`` (of the tokenizers library); 0 for null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return pa.array([len(x.ids) for k in range(0, len(texts), 256) for x in tokenizer.encode_batch([t.as_py() or "" for t in texts[k : k + 256]], add_special_tokens=False)], pa.int64())

    return count


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take: their tokens sum up to the most that is not above ``budget`` and that the
    programme can reach: exact where the remainder after the proportional part can be made of the documents left, which all
    are open to it if the budget is below eight of the longest documents."""
    take = np.zeros(len(lengths), np.int64)
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return take
    order = np.random.default_rng(seed).permutation(len(lengths))
    window = 8 * int(lengths.max())
    if budget > window:
        take = np.floor(counts * ((budget - window) / total)).astype(np.int64)
        # One more of each length, in seeded order, as long as the window is left over.
        spare = budget - window - int((take * lengths).sum())
        for k in order.tolist():
            more = min(int(counts[k] - take[k]), 1, spare // int(lengths[k]))
            take[k] += more
            spare -= more * int(lengths[k])
    rest = budget - int((take * lengths).sum())
    parts: list[tuple[int, int]] = []  # (index of the length, number of documents), in binary portions
    for k in order.tolist():
        n, m = min(int(counts[k] - take[k]), rest // int(lengths[k])), 1
        while n > 0:
            parts.append((k, min(m, n)))
            n, m = n - m, 2 * m
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    by = np.full(rest + 1, -1, np.int32)  # the portion by which a sum was first reached
    for p, (k, m) in enumerate(parts):
        w = int(lengths[k]) * m
        new = reach[: rest + 1 - w] & ~reach[w:]
        by[w:][new] = p
        reach[w:] |= new
        if reach[rest]:
            break
    s = int(np.flatnonzero(reach)[-1])
    while s:
        k, m = parts[by[s]]
        take[k] += m
        s -= int(lengths[k]) * m
    return take


def budgets(available: dict, weights: dict, default_weight: float, total: int) -> dict:
    """Whole-token budgets by weight; a source that has less gives all, and the others share what it lacks by weight."""
    left, open_, out = total, {s for s in available if weights.get(s, default_weight) > 0}, {s: 0 for s in available}
    while open_ and left > 0:
        scale = left / sum(weights.get(s, default_weight) for s in open_)
        short = {s for s in open_ if available[s] <= scale * weights.get(s, default_weight)}
        if not short:
            share = {s: int(scale * weights.get(s, default_weight)) for s in open_}
            for s in sorted(open_, key=str)[: left - sum(share.values())]:
                share[s] += 1
            return out | share
        for s in short:
            out[s] = available[s]
            left -= available[s]
        open_ -= short
    return out


def limits(keys: DataFrame, plans: DataFrame) -> DataFrame:
    """limits(source, length, cut, ties) of ``keys(source, length, hash)`` and ``plans(source, length, take, count)``: taken are the
    rows of a lower hash than ``cut`` and ``ties`` of those of that hash (null: all of them).

    Hashes are counted in 4096 bins, and only those of the bin in which a plan ends are ranked, so no task sorts a whole length."""
    whole = plans.filter("take >= count").select("source", "length", F.lit((1 << 63) - 1).cast("bigint").alias("cut"), F.lit(None).cast("bigint").alias("ties"))
    some = plans.filter("take < count").select(F.col("source").alias("s"), F.col("length").alias("l"), "take")
    same = lambda a, b: F.col("source").eqNullSafe(F.col(a)) & (F.col("length") == F.col(b))

    def end(counted: DataFrame, by: str, need: str) -> DataFrame:
        """The ``by`` at which the running count reaches ``need``, and how many of it are needed."""
        so_far = F.sum("n").over(Window.partitionBy("source", "length").orderBy(by))
        return counted.withColumn("_to", so_far).filter((F.col("_to") >= F.col(need)) & (F.col("_to") - F.col("n") < F.col(need))).withColumn("need", F.col(need) - F.col("_to") + F.col("n")).drop("_to")

    binned = keys.withColumn("bin", F.shiftright("hash", 52))
    bins = end(binned.groupBy("source", "length", "bin").agg(F.count("*").alias("n")).join(some, same("s", "l")), "bin", "take")
    last = bins.select(F.col("source").alias("s"), F.col("length").alias("l"), F.col("bin").alias("b"), F.col("need").alias("most"))
    ends = end(binned.join(last, same("s", "l") & (F.col("bin") == F.col("b"))).groupBy("source", "length", "hash", "most").agg(F.count("*").alias("n")), "hash", "most")
    return whole.unionByName(ends.select("source", "length", F.col("hash").alias("cut"), F.when(F.col("need") < F.col("n"), F.col("need")).alias("ties")))


def mix(docs: DataFrame, *, weights: dict | None = None, default_weight: float = 1.0, budget_tokens: int | None = None, budget_share: float = 0.5, seed: int = 7, count=word_count, length: str | None = None, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs``, all columns, only the selected rows (and the token count as column ``length``, if that is named).

    The budget is ``budget_tokens``, or ``budget_share`` of all tokens. ``weights`` maps a source to its weight, None is the
    null source; others have ``default_weight``. Rows of null, empty or token-less texts cost nothing and aren't selected; a long text is
    counted whole. A repeated row is a further document. Rows whose seeded hash of doc_id and text ties are taken in any order, being
    alike. An empty table stays empty.

    Only (source, length, hash) is shuffled; the limits, a row for each source and length, are broadcast up to ``most_broadcast`` rows and
    joined by a shuffle beyond. Texts are counted twice, once for the counts and once as they are selected.
    """
    n, h, at = (fresh(docs, c) for c in ("_length", "_hash", "_source"))
    # Never null, and filtered behind the checkpoint: a filter of the count would be pushed below it, and count every text once more.
    counted = docs.withColumn(n, F.coalesce(count(docs["text"]), F.lit(0).cast("bigint"))).withColumn(at, docs["source"].cast("string")).withColumn(h, F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]))
    keys = cut(counted.select(F.col(at).alias("source"), F.col(n).alias("length"), F.col(h).alias("hash"))).filter("length > 0")
    counts = cut(keys.groupBy("source", "length").agg(F.count("*").alias("count")))
    sums = {r[0]: int(r[1]) for r in counts.groupBy("source").agg(F.sum(F.col("length") * F.col("count"))).collect()}
    share = budgets(sums, weights or {}, default_weight, int(sum(sums.values()) * budget_share) if budget_tokens is None else budget_tokens)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("length")
        source = group["source"].iloc[0]
        chosen = fit(group["length"].to_numpy(), group["count"].to_numpy(), share[None if pd.isna(source) else source], seed)
        return group.assign(take=chosen)[["source", "length", "take", "count"]]

    plans = cut(counts.groupBy("source").applyInPandas(plan, "source string, length bigint, take bigint, count bigint").filter("take > 0"))
    found = cut(limits(keys, plans))
    s, l, c, t = (fresh(docs, x) for x in ("_of", "_long", "_cut", "_ties"))
    ends = found.select(F.col("source").alias(s), F.col("length").alias(l), F.col("cut").alias(c), F.col("ties").alias(t))
    if plans.count() <= most_broadcast:
        ends = F.broadcast(ends)
    joined = counted.join(ends, F.col(at).eqNullSafe(F.col(s)) & (F.col(n) == F.col(l)))
    shown = [F.col(f"`{x}`") for x in docs.columns] + ([F.col(n).alias(length)] if length else [])
    out = joined.filter((F.col(h) < F.col(c)) | ((F.col(h) == F.col(c)) & F.col(t).isNull())).select(*shown)
    if not is_empty(found.filter("ties is not null")):
        rank = fresh(docs, "_rank")
        tied = joined.filter((F.col(h) == F.col(c)) & F.col(t).isNotNull()).withColumn(rank, F.row_number().over(Window.partitionBy(at, n).orderBy(h)))
        out = out.unionByName(tied.filter(F.col(rank) <= F.col(t)).select(*shown))
    return out

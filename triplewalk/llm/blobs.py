"""Compact batches of integers for shuffles: one binary row for each (task, target partition) in place of a row a record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "part int, blob binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; 64-, 32- or 16-bit integers, byte planes apart so that zeros and near-equal bytes compress."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(bytes([c.dtype.itemsize]) + c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        width = data[at]
        planes = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view({2: np.int16, 4: np.int32, 8: np.int64}[width]))
        at += 1 + n * width
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    """Differences mod 2**64; ``np.cumsum`` undoes it."""
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def scatter(part: np.ndarray, parts: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each target partition that occurs: the records of it, by rising ``key`` (uint64), which is stored as deltas."""
    order = np.lexsort((key, part))
    part, key, columns = part[order], key[order], [c[order] for c in columns]
    edges = np.searchsorted(part, np.arange(parts + 1))
    targets = np.flatnonzero(np.diff(edges))
    blobs = [pack(deltas(key[edges[t] : edges[t + 1]]), *[c[edges[t] : edges[t + 1]] for c in columns]) for t in targets]
    return pa.record_batch([pa.array(targets.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def gather(batches) -> list[np.ndarray] | None:
    """The records of one partition: key (uint64, unsorted across blobs) and columns; None if there are none."""
    found = [unpack(b.as_py()) for batch in batches for b in batch.column(1)]
    if not found:
        return None
    for f in found:
        f[0] = np.cumsum(f[0].view(np.uint64), dtype=np.uint64)
    return [np.concatenate(c) for c in zip(*found)]


def exchange(df: DataFrame, parts: int) -> DataFrame:
    """``df`` of SCHEMA, each row in the partition that its ``part`` names."""
    return df.repartitionById(parts, "part")

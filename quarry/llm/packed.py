"""An exchange by hash range whose rows are compressed arrays, many entries in each.

A map task sorts its entries by hash, cuts them into one part for each bucket (an equal range of hashes) and sends
each part as one compressed row. As rows of their own the entries would be several times as large and as slow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
SCHEMA = "bucket int, blob binary"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any integer type; sorted unsigned 64-bit ones come first and are stored as differences."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for x in arrays:
        planes = x.dtype.itemsize
        if x.dtype == np.uint64 and len(x) > 1 and (x[1:] >= x[:-1]).all():
            kind, x = b"d", np.diff(x, prepend=U(0))
        else:
            kind = b"p"
        # bytes of equal significance side by side compress better; zero planes vanish
        body = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), planes).T).tobytes() if len(x) else b""
        parts += [kind, x.dtype.str.encode().ljust(4), struct.pack("<Q", len(x)), body]
    return zstandard.compress(b"".join(parts), 1)


def load(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        kind, dtype = data[at : at + 1], np.dtype(data[at + 1 : at + 5].decode().strip())
        (n,) = struct.unpack_from("<Q", data, at + 5)
        at += 13
        size = n * dtype.itemsize
        x = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, n).T
        x = np.ascontiguousarray(x).reshape(-1).view(dtype)
        out.append(np.cumsum(x, dtype=dtype) if kind == b"d" else x)
        at += size
    return out


def send(hashes: np.ndarray, others: list[np.ndarray], buckets: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) of entries, in batches of bounded size."""
    order = np.argsort(hashes, kind="stable")
    hashes, others = hashes[order], [x[order] for x in others]
    edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    names, blobs, held = [], [], 0
    for b in np.flatnonzero(np.diff(edges)).tolist():
        for s in range(edges[b], edges[b + 1], 1 << 18):
            e = min(s + (1 << 18), edges[b + 1])
            blob = dump([hashes[s:e], *(x[s:e] for x in others)])
            names.append(b)
            blobs.append(blob)
            held += len(blob)
            if held > most:
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
                names, blobs, held = [], [], 0
    if names:
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def exchange(sent: DataFrame, buckets: int) -> DataFrame:
    """One task a bucket."""
    return sent.repartitionById(buckets, F.col("bucket"))


def receive(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All entries of a bucket, one array a column; empty if none came."""
    found = [load(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
    return [np.concatenate(x) for x in zip(*found)]

"""Minimal perfect hashing of a distributed set of 64-bit keys.

Keys are dealt to buckets by a hash; a task builds a bucket's function by itself, a cascade of
bit arrays: a key takes the first array in which no other remaining key of the bucket hashes
to its bit. The set bits, counted over all buckets in order, number the keys without a gap.
The keys are kept in that order, so a look-up is verified. Per key that is about four bits of
function and eight bytes of key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caselog.llm.common import in_workers

#: Keys of a bucket on average, bits of an array for each remaining key.
BUCKET, ROOM = 4000, 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """63-bit hashes of 64-bit keys, the same in every process."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(keys, -1) % buckets


def cascade(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes of the bit arrays (whole bytes), the arrays, and the keys in the order of their bits."""
    sizes, arrays, order = [], [], []
    while len(keys):
        size = -(-ROOM * len(keys) // 8) * 8
        at = mixed(keys, len(sizes)) % size
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        arrays.append(np.packbits(bits, bitorder="little").tobytes())
        order.append(keys[alone][np.argsort(at[alone])])
        sizes.append(size)
        keys = keys[~alone]
    return sizes, b"".join(arrays), np.concatenate(order) if order else keys


class PerfectHash:
    """Numbers of the keys, 0 to n - 1, or -1 for what is no key."""

    def __init__(self, parts: list[tuple[int, list[int], bytes, np.ndarray]], buckets: int):
        self.buckets = buckets
        levels = max((len(sizes) for _, sizes, _, _ in parts), default=0)
        self.sizes, self.starts = np.zeros((levels, buckets), np.int64), np.zeros((levels, buckets), np.int64)
        arrays, order, at = [], [], 0
        for bucket, sizes, bits, keys in sorted(parts, key=lambda p: p[0]):
            self.sizes[:len(sizes), bucket] = sizes
            self.starts[:len(sizes), bucket] = at + np.cumsum(sizes) - sizes
            at += 8 * len(bits)
            arrays.append(bits)
            order.append(keys)
        self.bits = np.frombuffer(b"".join(arrays), np.uint8)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate(order) if order else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, bucket = np.arange(len(keys)), bucket_of(keys, self.buckets)
        for level, (sizes, starts) in enumerate(zip(self.sizes, self.starts, strict=True)):
            size = sizes[bucket[left]]
            left, size = left[size > 0], size[size > 0]
            bit = starts[bucket[left]] + mixed(keys[left], level) % size
            byte = self.bits[bit >> 3].astype(np.int64)
            hit = (byte >> (bit & 7)) & 1 == 1
            below = np.bitwise_count(byte[hit] & ((1 << (bit[hit] & 7)) - 1))
            out[left[hit]] = self.before[bit[hit] >> 3] + below
            left = left[~hit]
        found = out >= 0
        found[found] = self.keys[out[found]] == keys[found]
        return np.where(found, out, -1)


def build(keys: DataFrame, n: int) -> PerfectHash:
    """The function of the ``n`` distinct values of the one column. Buckets are built in tasks;
    the finished function, of about nine bytes a key, comes to the driver: callers bound n."""
    name, buckets = keys.columns[0], max(1, -(-n // BUCKET))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column(0))
            yield pa.record_batch({"bucket": pa.array(bucket_of(found, buckets)), "key": pa.array(found)})

    def made(table: pa.Table) -> pa.Table:
        sizes, bits, order = cascade(np.sort(np.asarray(table.column("key"))))
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits], pa.binary()), "keys": pa.array([order.astype(np.int64).tobytes()], pa.binary())})

    parts = in_workers(keys).select(name).mapInArrow(dealt, "bucket long, key long").groupBy("bucket").applyInArrow(
        made, "bucket long, sizes array<long>, bits binary, keys binary").collect()
    return PerfectHash([(r["bucket"], r["sizes"], bytes(r["bits"]), np.frombuffer(bytes(r["keys"]), np.int64)) for r in parts], buckets)

"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A window is a set of word shingles that a document has to contain whole, so of the shingles
ordered by rarity a prefix of one is necessary. One pass over the documents keeps the runs of
words whose shingles all may be benchmark shingles, by a bitmap of fixed size; runs shorter
than the shortest window are dropped (length bound). Shingle counts over the runs give the
rarity, the rarest shingle of every window is joined with the runs, its place gives the one
possible start (positional bound), and the words of the run are compared with the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, internal, sliced, stored
from caselog.llm.shingles import run_hashes, word_hashes

WINDOW, SHINGLE = 13, 5
#: Bits of the bitmap of benchmark shingles: 2 MB however large the benchmark is. A fuller
#: bitmap lets more runs through, which the join then drops.
BITS = 1 << 24
#: Bytes that are no part of a word become spaces and A-Z become a-z.
TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Found(NamedTuple):
    documents: DataFrame
    """key, doc_id, text_hash, n_words, one row a document."""
    hits: DataFrame
    """key, window, start, n: every occurrence of a window in a document, in words."""
    window_items: DataFrame
    """window, item_id."""


def windows(items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every window of every item: item_id, window (its words), n, k, shingles in order.
    An item of fewer words than a window is one window, an item without words none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, uses="word hashes"):
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                n = min(size, len(found))
                if not n:
                    continue
                k, hashes = min(shingle, n), word_hashes(found)
                runs = run_hashes(hashes, k).view(np.int64)
                starts = range(len(found) - n + 1)
                yield pa.record_batch({
                    "item_id": pa.array([item] * len(starts), pa.string()),
                    "window": pa.array([b" ".join(found[s:s + n]).decode() for s in starts]),
                    "n": pa.array([n] * len(starts), pa.int32()), "k": pa.array([k] * len(starts), pa.int32()),
                    "shingles": pa.array([runs[s:s + n - k + 1] for s in starts], pa.list_(pa.int64()))})

    slim = in_workers(items).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "item_id string, window string, n int, k int, shingles array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes, gathered as at most BITS / 32,768 pieces of 4 KB."""
    bit = F.pmod(F.col("hash"), F.lit(BITS)) + 1
    pieces = hashes.select(F.bitmap_bucket_number(bit).alias("no"), F.bitmap_bit_position(bit).alias("at")).groupBy(
        "no").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for p in pieces:
        out[(p["no"] - 1) * 4096:p["no"] * 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)
    return out


def _scan(docs: DataFrame, bitmap: np.ndarray, shortest: dict[int, int]) -> DataFrame:
    """doc_id, n_words and the runs of possible benchmark shingles, one row a document.
    ``shortest`` has for each shingle length the words of the shortest window."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def runs_of(found: list[bytes], bits: np.ndarray) -> list[dict]:
        out = []
        hashes = word_hashes(found)
        for k, least in shortest.items():
            h = run_hashes(hashes, k)
            at = (h & np.uint64(BITS - 1)).astype(np.int64)
            may = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            if not may.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], may.view(np.int8), [0]))))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if hi - lo + k - 1 >= least:
                    out.append({"start": lo, "k": k, "words": [w.decode() for w in found[lo:hi + k - 1]], "hashes": h[lo:hi].view(np.int64).tolist()})
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(batches, 1024, uses="word hashes"):
            counts, runs = [], []
            for text in batch.column("text"):
                found = words(text.as_py())
                counts.append(len(found))
                runs.append(runs_of(found, bits))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, kind)})

    slim = in_workers(docs).select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(
        run, "doc_id long, text_hash long, n_words long, runs array<struct<start: int, k: int, words: array<string>, hashes: array<long>>>")


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> Found:
    """All occurrences of benchmark windows in documents.

    Null texts have no words. Each row of ``docs`` is a document of its own, also where ids
    or whole rows repeat or the id is null; ``key`` tells them apart. An empty table on
    either side gives no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    all_windows = stored(windows(items, size, shingle), "windows")
    window_items = all_windows.select("window", "item_id").distinct()
    unique = all_windows.select("window", "n", "k", "shingles").dropDuplicates(["window"])
    shortest = {r["k"]: r["n"] for r in unique.groupBy("k").agg(F.min("n").alias("n")).collect()}  # at most ``shingle`` rows
    bitmap = _bitmap(all_windows.select(F.explode("shingles").alias("hash")))
    seen = stored(_scan(docs, bitmap, shortest).withColumn("key", F.monotonically_increasing_id()), "decontaminate")

    runs = seen.select("key", F.posexplode("runs").alias("run", "r"))
    posts = runs.select("key", "run", F.posexplode("r.hashes").alias("at", "hash"))
    rarity = posts.groupBy("hash").agg(F.count("*").alias("n_runs"))
    offsets = unique.select("window", "n", F.posexplode("shingles").alias("offset", "hash"))
    prefix = offsets.join(rarity, "hash", "left").groupBy("window", "n").agg(
        F.min(F.struct("n_runs", "offset", "hash")).alias("rarest"), F.count(F.when(F.col("n_runs").isNull(), 1)).alias("unseen"))
    prefix = prefix.filter("unseen = 0").select("window", "n", "rarest.offset", "rarest.hash")
    starts = posts.join(prefix, "hash").select("key", "run", "window", "n", (F.col("at") - F.col("offset")).alias("begin")).filter("begin >= 0")
    held = runs.select("key", "run", F.col("r.start").alias("run_start"), F.col("r.words").alias("words"))
    same = F.array_join(F.slice("words", F.col("begin") + 1, F.col("n")), " ") == F.col("window")
    hits = starts.join(held, ["key", "run"]).filter(F.col("begin") + F.col("n") <= F.size("words")).filter(same).select(
        "key", "window", (F.col("run_start") + F.col("begin")).alias("start"), "n")
    return Found(seen.select("key", "doc_id", "text_hash", "n_words"), stored(hits, "benchmark-hits"), window_items)


def report(found: Found) -> DataFrame:
    """One row a document: n_words, n_hit (words inside any hit), n_items, items_sha256 of the
    sorted item ids, and ``contaminated``: a twentieth of the words or more are hit."""
    order = Window.partitionBy("key").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = found.hits.select("key", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)).alias("new"))
    n_hit = new.groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = found.hits.select("key", "window").distinct().join(found.window_items, "window").groupBy("key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit_or_0 = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = found.documents.join(n_hit, "key", "left").join(items, "key", "left").withColumn("n_hit", n_hit_or_0)
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "key", "doc_id", "text_hash", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all their columns, whatever their names."""
    found_id, found_hash = internal(docs, "doc_id", "text_hash")
    bad = report(find(docs, items)).filter("contaminated").select(
        F.col("doc_id").alias(found_id), F.col("text_hash").alias(found_hash)).distinct()
    same = (F.xxhash64("text") == F.col(found_hash)) & F.col("doc_id").eqNullSafe(F.col(found_id))
    return docs.join(bad, same, "left_anti")

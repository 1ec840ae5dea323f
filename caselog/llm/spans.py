"""Substring dedup by sliding spans of sentences.

A span begins at every sentence and is the shortest run of consecutive sentences that has at
least two of them and twelve words. A sentence of ``LONG`` words is a span by itself as well,
so it meets its copies between other neighbours. Equal spans are found over the whole table by a 128-bit
hash; the first, by doc_id and place, is kept, and sentences covered by any other go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from caselog.llm.common import in_workers, stored

SENTENCES, WORDS, LONG = 2, 12, 25
#: A sentence ends at a line feed, or after ``.``, ``!`` or ``?`` that white space follows.
_END = re.compile(r"(?<=[.!?])[^\S\n]+|\n+")


def sentences(text: str | None) -> list[tuple[int, int, bytes, int]]:
    """Begin, end (with the white space behind it), normal form and words of every sentence
    with a word. Case and white space don't matter to the normal form."""
    out, begin, text = [], 0, text or ""
    for end in _ends(text):
        words = text[begin:end].lower().split()
        if words:
            out.append((begin, end, " ".join(words).encode(errors="replace"), len(words)))
        elif out:
            out[-1] = (out[-1][0], end, *out[-1][2:])
        begin = end
    return out


def _ends(text: str) -> Iterator[int]:
    for m in _END.finditer(text):
        yield m.end()
    if text:
        yield len(text)


def runs(found: list[tuple[int, int, bytes, int]], least: int, words: int) -> Iterator[tuple[int, int, bytes]]:
    """First sentence, number of sentences and hash of every span. A text with too few
    sentences or words for any span is one span as a whole. A long sentence begins a longer
    span too, for a short one behind it repeats with it alone."""
    n = len(found)
    counts = [s[3] for s in found]
    if n and (n < least or sum(counts) < words):
        yield 0, n, xxh3_128_digest(b"\0".join(s[2] for s in found))
        return
    for begin in range(n if least > 1 else 0):
        if counts[begin] >= LONG:
            yield begin, 1, xxh3_128_digest(found[begin][2])
    end = total = 0
    for begin in range(n):
        while end < n and (end - begin < least or total < words):
            total += counts[end]
            end += 1
        if end - begin < least or total < words:
            return
        yield begin, end - begin, xxh3_128_digest(b"\0".join(s[2] for s in found[begin:end]))
        total -= counts[begin]


def spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, at, n, hi, lo: every span of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, found, hashes = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for begin, n, digest in runs(sentences(text), least, words):
                        rows.append(i)
                        found.append((begin, n))
                        hashes.append(digest)
                where = np.array(found, np.int32).reshape(-1, 2)
                digest = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at_row = pa.array(rows, pa.int32())
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(at_row), "text_hash": batch.column("text_hash").take(at_row),
                    "at": pa.array(np.ascontiguousarray(where[:, 0])), "n": pa.array(np.ascontiguousarray(where[:, 1])),
                    "hi": pa.array(np.ascontiguousarray(digest[:, 0])), "lo": pa.array(np.ascontiguousarray(digest[:, 1]))})

    slim = in_workers(docs).select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, at int, n int, hi long, lo long")


def repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash and ``gone``: the places of the spans that aren't the first.

    The first of equal spans is the minimum of an aggregate, so a span that a third of all
    documents share is one row a task before it is moved. The firsts are stored: both sides of
    the join that finds the other copies are then plain shuffles, of which adaptive execution
    splits a key that is too large for a task.
    """
    every = spans(docs, least, words)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "at")
    first = every.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select(
        F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "first")
    first = stored(first, "first-spans")
    other = every.join(first, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).filter(place != F.col("first"))
    return other.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("gone"))


def cleaned(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, text without the repeated sentences, n_sentences, n_removed, removed_words and
    ``removed``, the begin and end of each removed stretch in the characters of the old text.

    A null text stays null. Rows that repeat id and text are one document and fare alike; a
    null id comes last. The text keeps its other characters, white space included. An empty
    table gives no rows; other columns are not read.
    """
    gone = repeated(docs, least, words)
    gone = stored(gone.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"), "spans")
    rows = in_workers(docs).select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    joined = rows.join(gone, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = [_without(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id"), "text": pa.array([o[0] for o in out], pa.string()),
                    "n_sentences": pa.array([o[1] for o in out], pa.int64()), "n_removed": pa.array([o[2] for o in out], pa.int64()),
                    "removed_words": pa.array([o[3] for o in out], pa.int64()),
                    "removed": pa.array([o[4] for o in out], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})

    return joined.select("doc_id", "text", "gone").mapInArrow(
        run, "doc_id long, text string, n_sentences long, n_removed long, removed_words long, removed array<struct<begin: int, end: int>>")


def _without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int, int, list[dict]]:
    found = sentences(text)
    if not gone:
        return text, len(found), 0, 0, []
    covered = np.zeros(len(found) + 1, np.int64)
    for g in gone:
        covered[g["at"]] += 1
        covered[g["at"] + g["n"]] -= 1
    out = np.cumsum(covered)[:-1] > 0
    kept, removed, last = [], [], 0
    for (begin, end, _, _), bad in zip(found, out, strict=True):
        if bad:
            kept.append(text[last:begin])
            if removed and removed[-1]["end"] == begin:
                removed[-1]["end"] = end
            else:
                removed.append({"begin": begin, "end": end})
            last = end
    return "".join(kept) + text[last:], len(found), int(out.sum()), sum(s[3] for s, bad in zip(found, out, strict=True) if bad), removed

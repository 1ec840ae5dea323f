"""Removal of repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``size`` bytes covers it that also starts earlier. Which strings
have to be compared is found first: of the ``GRAM``-byte strings in each window of ``size``
bytes, the one with the least hash is its anchor, so equal windows have equal anchors at equal
places. Neighbouring windows with one anchor are one stretch of at most ``2 * size - GRAM``
bytes. Only stretches whose anchor occurs twice can hold a repeat; equal stretches are one
with the place of the first, and anchors are dealt to buckets with their stretches, cut down
to the windows that have a part in common with another stretch.

In a bucket, the stretches are cut into shards. Each shard's suffixes are sorted once, by
``size`` symbols, which gives its transform. Shards are then merged in pairs by refining the
interleave of their transforms: a stable sort of the interleave by the symbols before each
suffix makes an interleave that is right for that many more symbols. Boundaries that appear
on the way tell common prefixes; what has none after ``size`` symbols is a repeated interval.
The suffixes are not sorted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from caselog.llm.common import in_workers, sliced, stored

SIZE, GRAM = 100, 32
#: Bytes of a shard and of a bucket of shards (mostly two, so one merge); distinct stretches
#: with which an anchor is hot.
SHARD, BUCKET, HOT = 160_000, 200_000, 3_000
#: Places of the anchor in its window that are looked at together.
PLACES = 17
#: Symbols by which an interleave grows in one step, if there are few enough of them, or else.
STEPS = (4, 2)
#: Least and most bits of the filter of repeated anchors: 16 a repeated anchor, at most 64 MB.
#: Beyond that it lets more anchors pass, which costs work and changes nothing.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Stretches that a task remembers to have sent; hot anchors that may be broadcast.
SENT, BROADCAST = 100_000, 100_000

_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes."""
    room = 1 << max(16, (len(raw)).bit_length())
    powers, inverse = _powers(_FACTOR, room), _powers(pow(_FACTOR, -1, 1 << 64), room)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:len(raw)])]
    h = (sums[gram:] - sums[:-gram]) * inverse[:len(raw) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, m, k = len(h) - width + 1, h, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:n], m[width - k:width - k + n])


def stretches(raw: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each stretch. Of equal grams the
    first in the window is its anchor, so a stretch has one place of its anchor."""
    if len(raw) < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h, width = gram_hashes(raw, gram), size - gram + 1
    m = least(h, width)
    begin = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    end = np.r_[begin[1:], len(m)]
    # the anchor of a run's first window serves those that begin up to it
    look = begin[:, None] + np.arange(width)
    anchor = begin + (h[np.minimum(look, len(h) - 1)] == m[begin][:, None]).argmax(axis=1)
    tied = np.flatnonzero(end > anchor + 1)
    if len(tied):
        extra = []
        for i in tied.tolist():
            at = begin[i] + np.flatnonzero(h[begin[i]:end[i] + width - 1] == m[begin[i]])
            extra.append(at[(at >= begin[i]) & (at + 1 < end[i])] + 1)
        begin = np.sort(np.concatenate([begin, *extra]))
        end = np.r_[begin[1:], len(m)]
    return begin, end - begin, m[begin]


def _keyed(docs: DataFrame) -> DataFrame:
    return in_workers(docs).select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """anchor: the hashes that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            found = [stretches(np.frombuffer(t.as_buffer(), np.uint8), size, gram)[2] for t in batch.column("text")]
            anchor, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch({"anchor": pa.array(anchor.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return _keyed(docs).select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(
        "n > 1").select("anchor")


def _filter(anchors: DataFrame) -> np.ndarray:
    """A bitmap of anchors; its size is known before it is made and bounded."""
    n, bits = anchors.count(), LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    bit = F.pmod(F.col("anchor"), F.lit(bits)) + 1
    pieces = anchors.select(F.bitmap_bucket_number(bit).alias("no"), F.bitmap_bit_position(bit).alias("at")).groupBy("no").agg(
        F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for p in pieces.toLocalIterator():
        out[(p["no"] - 1) * 4096:p["no"] * 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)
    return out


_PLACE = "none boolean, doc_id long, text_hash long, at long"


def _occurrences(docs: DataFrame, shared, size: int, gram: int, with_text: bool) -> DataFrame:
    """anchor, hi, lo (hash of the stretch), its place (a null doc_id is ``none`` and 0), n of
    every stretch with an anchor that may repeat. With text: the distinct ones of each task, with their earliest places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        mask, sent = np.uint64(8 * len(bitmap) - 1), {}
        for batch in sliced(batches):
            rows = {name: [] for name in ("anchor", "at", "n")}
            of, digests, texts = [], [], []
            hashes = batch.column("text_hash").to_pylist()
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                whole = text.as_buffer()
                begin, n, anchor = stretches(np.frombuffer(whole, np.uint8), size, gram)
                bit = anchor & mask
                some = np.flatnonzero(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                view, begin, n, anchor = memoryview(whole), begin[some], n[some], anchor[some].view(np.int64)
                found = [xxh3_128_digest(view[b:b + k + size - 1]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                if with_text:
                    new = []
                    for j, (digest, b) in enumerate(zip(found, begin.tolist(), strict=True)):
                        place = (doc is None, doc or 0, hashes[i], b)
                        known = sent.get(digest)
                        if known is None or place < known:
                            sent[digest] = place
                            new.append(j)
                            texts.append(bytes(view[b:b + int(n[j]) + size - 1]) if known is None else None)
                    found = [found[j] for j in new]
                    begin, n, anchor = begin[new], n[new], anchor[new]
                of += [i] * len(found)
                digests += found
                rows["anchor"].append(anchor)
                rows["at"].append(begin)
                rows["n"].append(n)
            if len(sent) > SENT:
                sent = {}
            if not of:
                continue
            of = pa.array(of, pa.int32())
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            doc = batch.column("doc_id").take(of)
            out = {
                **{name: pa.array(np.concatenate(values)) for name, values in rows.items()}, "hi": pa.array(digest[:, 0].copy()),
                "lo": pa.array(digest[:, 1].copy()), "none": doc.is_null(), "doc_id": doc.fill_null(0), "text_hash": batch.column("text_hash").take(of)}
            if with_text:
                out["text"] = pa.array(texts, pa.binary())
            yield pa.record_batch(out)

    schema = "anchor long, at long, n long, hi long, lo long, none boolean, doc_id long, text_hash long" + ", text binary" * with_text
    return _keyed(docs).mapInArrow(run, schema)


class Transform:
    """Suffixes in the order of their first ``size`` symbols, and the ``step`` symbols before each."""

    def __init__(self, elements: np.ndarray, before: np.ndarray):
        self.elements, self.before = elements, before


def _following(ends: np.ndarray, n: int) -> np.ndarray:
    """The next place of each; behind the end of a string comes its beginning."""
    out = np.arange(1, n + 1)
    out[ends] = np.r_[0, ends[:-1] + 1]
    return out


def transform(symbols: np.ndarray, ends: np.ndarray, first: int, size: int, step: int) -> Transform:
    """The transform of one shard, whose suffixes are numbered from ``first``. Strings end
    with symbol 0 at ``ends`` and are read in a circle."""
    n = len(symbols)
    one = _following(ends, n)
    key, after, known = np.zeros(n, np.int64), np.arange(n), 0
    while known < min(7, size):
        key, after, known = (key << 9) | symbols[after], one[after], known + 1
    rank = np.unique(key, return_inverse=True)[1]
    jumps = {known: after}
    while known < size:
        more = min(known, size - known)
        jump, left = np.arange(n), more
        for k in sorted(jumps, reverse=True):  # the longest jumps that fit, then single steps
            while left >= k:
                jump, left = jumps[k][jump], left - k
        for _ in range(left):
            jump = one[jump]
        rank = np.unique(rank * n + rank[jump], return_inverse=True)[1]
        known += more
        jumps[known] = jump[after] if known == 2 * more else jump
        after = jumps[known]
    order = np.argsort(rank, kind="stable")
    back = np.empty(n, np.int64)
    back[one] = np.arange(n)
    before, place = np.zeros(n, np.int64), np.arange(n)
    for i in range(step):
        place = back[place]
        before |= symbols[place].astype(np.int64) << (9 * i)
    return Transform(first + order, before[order])


def merged(x: Transform, y: Transform, size: int, step: int) -> tuple[Transform, np.ndarray]:
    """Both transforms as one, and where a new prefix of ``size`` symbols begins in it."""
    n_x, n = len(x.before), len(x.before) + len(y.before)
    names, codes = np.unique(np.r_[x.before, y.before], return_inverse=True)
    codes = codes.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
    from_y = np.zeros(n, bool)
    from_y[n_x:] = True
    new = np.zeros(n, bool)
    new[:1] = True
    symbol = np.empty(n, codes.dtype)
    for _ in range(size // step):
        symbol[~from_y], symbol[from_y] = codes[:n_x], codes[n_x:]
        order = np.argsort(symbol, kind="stable")
        block, sorted_ = np.cumsum(new, dtype=np.int32)[order], symbol[order]
        finer = np.r_[True, (block[1:] != block[:-1]) | (sorted_[1:] != sorted_[:-1])][:n]
        next_ = from_y[order]
        same = np.array_equal(next_, from_y) and np.array_equal(finer, new)
        from_y, new = next_, finer
        if same:
            break
    out = Transform(np.empty(n, np.int64), np.empty(n, np.int64))
    for of, rows in ((x, ~from_y), (y, from_y)):
        out.elements[rows], out.before[rows] = of.elements, of.before
    return out, new


def repeats(strings: list[bytes], documents: np.ndarray, at: np.ndarray, size: int, shard: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each window of ``size`` bytes that is equal to an earlier one.

    A window's place is its document's number and ``at`` plus its offset."""
    shard = shard or SHARD
    lengths = np.array([len(s) for s in strings], np.int64) + 1
    ends = np.cumsum(lengths) - 1
    symbols = np.zeros(int(lengths.sum()), np.int64)
    text = np.ones(len(symbols), bool)
    text[ends] = False
    symbols[text] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    step = next((s for s in STEPS if size % s == 0), 1)
    if step == STEPS[0] and len(symbols) > 4096:
        four = (symbols[:-3] << 27) | (symbols[1:-2] << 18) | (symbols[2:-1] << 9) | symbols[3:]
        step = step if len(np.unique(four)) <= 60_000 or size % STEPS[1] else STEPS[1]
    cuts = [0, *(np.flatnonzero(np.diff((ends - lengths + 1) // shard)) + 1).tolist(), len(strings)]
    level = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = int(ends[a] - lengths[a] + 1)
        level.append(transform(symbols[first:int(ends[b - 1]) + 1], ends[a:b] - first, first, size, step))
    if len(level) == 1:
        level.append(Transform(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    new = None
    while len(level) > 1:
        pairs = [merged(*level[i:i + 2], size, step) for i in range(0, len(level) - 1, 2)]
        level, new = [p[0] for p in pairs] + level[len(level) // 2 * 2:], pairs[-1][1]
    elements, block = level[0].elements, np.cumsum(new)
    string = np.searchsorted(ends, elements)
    offset = elements - (ends - lengths + 1)[string]
    window = offset + size < lengths[string]
    string, offset, block = string[window], offset[window], block[window]
    place = (documents[string] << 32) | (at[string] + offset)
    begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    earliest = np.repeat(np.minimum.reduceat(place, begin), np.diff(np.r_[begin, len(block)])) if len(block) else place
    late = place != earliest
    return string[late], offset[late]


def _runs(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows: string, first offset, number of windows."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    begin = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(string) else np.zeros(0, np.int64)
    return string[begin], offset[begin], np.diff(np.r_[begin, len(string)])


def candidates(texts: list[bytes], anchors: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first window and number of windows of the parts of stretches that may hold a
    repeat. Equal windows have equal anchors at equal places; windows whose places lie in one
    group of ``PLACES`` have a part in common, so if no other stretch of the anchor has this
    part (by a 64-bit hash), none of them repeats."""
    lengths, places = np.array([len(t) for t in texts], np.int64), min(PLACES, size - gram + 1)
    starts = np.cumsum(lengths) - lengths
    whole = np.frombuffer(b"".join(texts), np.uint8)
    equal = np.flatnonzero(gram_hashes(whole, gram) == np.repeat(anchors.view(np.uint64), lengths)[:len(whole) - gram + 1])
    place = equal[np.searchsorted(equal, starts)] - starts
    rows = []
    for i, (text, p, n) in enumerate(zip(texts, place.tolist(), (lengths - size + 1).tolist(), strict=True)):
        for k in range(max(p - n + 1, 0) // places, p // places + 1):  # the anchor of window j is at p - j
            begin = p - places * k
            rows.append((i, k, xxh3_64_intdigest(text[max(begin, 0):begin + size - places + 1], k)))
    string, group, part = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (np.int64, np.int64, np.uint64), strict=True))
    key = part ^ (anchors.view(np.uint64)[string] * np.uint64(_FACTOR))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    live = count[back] > 1
    string, group = string[live], group[live]
    if not len(string):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
    least_group, most_group = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
    string = string[first]
    begin = np.maximum(place[string] - places * (most_group + 1) + 1, 0)
    end = np.minimum(place[string] - places * least_group + 1, lengths[string] - size + 1)
    return string, begin, end - begin


def _merged_buckets(distinct: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """hi, lo, offset, n: windows of stretches that are not the first of their kind."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("hi", "ascending"), ("lo", "ascending")])
        texts = table.column("text").to_pylist()
        string, begin, n = candidates(texts, np.asarray(table.column("anchor")), size, gram)
        table = table.take(string)
        columns = {c: np.asarray(table.column(c)) for c in ("none", "doc_id", "text_hash", "at", "hi", "lo")}
        parts = [texts[i][b:b + k + size - 1] for i, b, k in zip(string.tolist(), begin.tolist(), n.tolist(), strict=True)]
        keys = [columns[c] for c in ("text_hash", "doc_id", "none")]
        order = np.lexsort(keys)
        changed = np.zeros(len(order), bool)
        for key in keys:
            changed[1:] |= key[order][1:] != key[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(changed)
        string, offset, n = _runs(*repeats(parts, number, columns["at"] + begin, size)) if parts else (string, begin, n)
        return pa.table({"hi": pa.array(columns["hi"][string]), "lo": pa.array(columns["lo"][string]),
                         "offset": pa.array((offset + begin[string]).astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    dealt = distinct.select("anchor", "hi", "lo", "place.*", "text", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"))
    return in_workers(dealt).groupBy("bucket").applyInArrow(run, "hi long, lo long, offset long, n long")


def _hot_windows(distinct: DataFrame, size: int) -> DataFrame:
    """The same for anchors with too many stretches for one task: single windows meet by their
    hash; the first is an aggregate, and the join with it may be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            of, offsets, digests = [], [], []
            for i, text in enumerate(batch.column("text")):
                view = memoryview(text.as_buffer())
                for b in range(len(view) - size + 1):
                    of.append(i)
                    offsets.append(b)
                    digests.append(xxh3_128_digest(view[b:b + size]))
            rows = pa.array(of, pa.int32())
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch({
                **{c: batch.column(c).take(rows) for c in ("hi", "lo", "none", "doc_id", "text_hash")},
                "at": pa.array(np.asarray(batch.column("at").take(rows)) + np.array(offsets, np.int64)), "offset": pa.array(offsets, pa.int64()),
                "w_hi": pa.array(digest[:, 0].copy()), "w_lo": pa.array(digest[:, 1].copy())})

    windows = in_workers(distinct).select("hi", "lo", "place.*", "text").mapInArrow(
        run, f"hi long, lo long, {_PLACE}, offset long, w_hi long, w_lo long")
    windows = stored(windows.select("hi", "lo", "offset", "w_hi", "w_lo", F.struct("none", "doc_id", "text_hash", "at").alias("place")), "hot-windows")
    firsts = stored(windows.groupBy("w_hi", "w_lo").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "hot-firsts")
    return windows.join(firsts, ["w_hi", "w_lo"]).filter("place != first").select("hi", "lo", "offset", F.lit(1).cast("long").alias("n"))


def repeated(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash and ``runs`` (at, n): windows of ``size`` bytes that also start earlier."""
    spark = docs.sparkSession
    anchors = stored(_anchors(docs, size, gram), "repeated-anchors")
    shared = spark.sparkContext.broadcast(_filter(anchors))
    sent = _occurrences(docs, shared, size, gram, True)
    place = F.struct("none", "doc_id", "text_hash", "at")
    distinct = stored(sent.groupBy("anchor", "hi", "lo").agg(
        F.min(place).alias("place"), F.max("text").alias("text")), "stretches")
    kinds = stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("text")).alias("bytes")).filter("kinds > 1"), "anchors")
    buckets = max(1, (kinds.agg(F.sum("bytes")).first()[0] or 0) // BUCKET)
    crowded = kinds.filter(F.col("kinds") > hot).select("anchor")
    n_crowded = crowded.count()
    crowded = F.broadcast(crowded) if n_crowded <= BROADCAST else crowded
    if not n_crowded:
        late = _merged_buckets(distinct, size, gram, buckets)
    else:
        late = _merged_buckets(distinct.join(crowded, "anchor", "left_anti"), size, gram, buckets).union(
            _hot_windows(distinct.join(crowded, "anchor"), size))
    late = late.groupBy("hi", "lo").agg(F.collect_list(F.struct("offset", "n")).alias("late"))
    firsts = stored(distinct.select("hi", "lo", F.col("place").alias("first")).join(late, ["hi", "lo"], "left"), "first-stretches")
    every = _occurrences(docs, shared, size, gram, False).select("hi", "lo", place.alias("place"), F.col("n").alias("windows"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.col("windows").alias("n")))
    found = every.join(firsts, ["hi", "lo"]).select(
        "place", F.when(F.col("place") == F.col("first"), F.col("late")).otherwise(whole).alias("late")).filter("late is not null")
    runs = found.select(F.when(~F.col("place.none"), F.col("place.doc_id")).alias("doc_id"), F.col("place.text_hash"), F.transform(
        "late", lambda x: F.struct((F.col("place.at") + x["offset"]).alias("at"), x["n"].alias("n"))).alias("runs"))
    return runs.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def cleaned(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, ``kept`` (the bytes that stay, as binary), n_bytes, n_removed, n_spans and
    kept_sha256 of every document.

    A null text is empty. A null doc_id comes after all others; of rows with one doc_id and
    different texts that with the smaller hash of its text is earlier, and rows that repeat
    both are one document and fare alike. Texts shorter than ``size`` lose nothing. Bytes are
    those of the text in UTF-8, so a removal may cut a character. An empty table gives no
    rows; other columns are not read.
    """
    found_id, found_hash = "_found_id", "_found_hash"
    gone = stored(repeated(docs, size, gram, hot).withColumnsRenamed({"doc_id": found_id, "text_hash": found_hash}), "repeated-runs")
    joined = _keyed(docs).join(gone, (F.col("text_hash") == F.col(found_hash)) & F.col("doc_id").eqNullSafe(F.col(found_id)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            lists = batch.column("runs")
            for i, text in enumerate(batch.column("text")):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                if not lists[i].is_valid or not len(lists[i].values):
                    rows.append((raw.tobytes(), len(raw), 0, 0))
                    continue
                at, n = (np.asarray(lists[i].values.field(c)) for c in ("at", "n"))
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + n + size - 1, 1)
                bad = np.cumsum(cover)[:-1] > 0
                rows.append((raw[~bad].tobytes(), len(raw), int(bad.sum()), int((bad & ~np.r_[False, bad[:-1]]).sum())))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "kept": pa.array([r[0] for r in rows], pa.binary()),
                **{name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("n_bytes", "n_removed", "n_spans"), 1)},
                "kept_sha256": pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())})

    return joined.select("doc_id", "text", "runs").mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

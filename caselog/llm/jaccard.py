"""Jaccard join of documents over word shingles by partitions of the shingle universe.

Two sets X and Y with |X| <= |Y| and a Jaccard similarity of 0.8 or more differ in at most
``|X| / 4`` elements. Sizes fall into bands [2^b, 2^(b+1)). Each band cuts the universe, by
hash, into more segments than its sets may differ in elements, so two similar sets agree on
whole segments (pigeonhole):

* index: a set hands out the hash of each of its non-empty segments, in its own band and, if
  a smaller partner may lie there, in the band below;
* probe: a set X has ``|X| // 4 + 1`` units to allocate, each on one of its segments, and a
  similar set must agree on one of those. The cost of a segment is the number of sets that
  share its subset, counted exactly over all sets: subsets that no other set has are free
  and are taken first, then the rarest. A set that has units enough for free subsets alone
  has no partner, which holds for most sets. Where a set has too few non-empty segments, a
  second unit on a large one buys its one-deletion neighbourhood (subsets one element smaller
  or larger), and the last resort are empty segments. Other sets index such neighbourhoods
  only for the (band, segment) pairs that some set has bought.

Candidates share a key. They are first verified against one member of each key (a star), the
one with the fewest subsets of its own, so that a large group of near copies costs its size
and not its square; sets that end up in one component need no further comparison. Sets of
different components that still share a key are compared by parity sketches, which bound the
difference of two sets from below: a block of sets with a block of sets inside one row, of
which only survivors leave. These are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, internal, sliced, stored
from caselog.llm.components import components
from caselog.llm.shingles import run_hashes, word_hashes

SHINGLE = 5
DELETED, VOID = 1, 2
#: How a set holds a key: to be found by, to probe with if allocation wants it, to probe with.
INDEX, OWN, FORCED = 0, 1, 2
#: Members of a component that are compared with others in one block.
BLOCK = 256
#: Bits of the bitmap of texts that have a candidate (2 MB at any size of the corpus).
BITS = 1 << 24


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word runs; of a shorter text, of all its words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    runs = np.sort(run_hashes(word_hashes(found), min(SHINGLE, len(found))))  # faster than np.unique
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_hash(elements: np.ndarray) -> int:
    """One number for a set; never 0 but for the empty set."""
    if not len(elements):
        return 0
    return int((_mixed(elements, 0x51ED270B).sum(dtype=np.uint64) ^ np.uint64(len(elements))).view(np.int64)) or 1


def sketch(elements: np.ndarray) -> bytes:
    """The parity of the elements in each of 2^j cells, at least as many as elements. Two
    sets differ in at least as many elements as their sketches in bits."""
    bits = max(64, 1 << int(len(elements) - 1).bit_length() if len(elements) else 64)
    cells = np.bincount((_mixed(elements, 0x2545F491) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch (bytes) made as short as another: halves are added up without carry."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def linked(n_x: np.ndarray, n_y: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union, in terms of the elements in one set only."""
    return 9 * differing <= n_x + n_y


def band_of(n: int) -> int:
    return n.bit_length() - 1


def n_segments(band: int) -> int:
    """Segments of a band: one more than its largest sets may differ in, and spare ones, so
    that subsets which are empty or shared by chance need not be bought."""
    largest = (2 << band) - 1
    return largest // 4 + 1 + 4 + largest // 32


def _segment(elements: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment number of each element, and the hashes that decide it."""
    mixed = _mixed(elements, 0x9D8A7F31 + band)
    return ((mixed >> np.uint64(40)) * np.uint64(n_segments(band)) >> np.uint64(24)).astype(np.int64), mixed


def _subsets(elements: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment numbers, subset sums and sizes of the non-empty segments, and the elements'
    segment numbers and hashes in segment order."""
    segment, mixed = _segment(elements, band)
    # numbers of 16 bits are sorted by radix
    order = np.argsort(segment.astype(np.uint16) if n_segments(band) <= 1 << 16 else segment, kind="stable")
    segment, mixed = segment[order], mixed[order]
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return segment[starts], np.add.reduceat(mixed, starts), np.diff(np.append(starts, len(segment))), segment, mixed


def _keys(sums: np.ndarray, segments: np.ndarray, band: int) -> np.ndarray:
    return _mixed(sums + _mixed(segments.astype(np.uint64), 0xA5A5 + band), 0x1234567)


def bought(n: int, segments: np.ndarray, sizes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set of n elements buys beyond its non-empty segments, where these are too few:
    the segments with a one-deletion neighbourhood, and empty segments."""
    units = n // 4 + 1 - len(segments)
    if units <= 0:
        return segments[:0], segments[:0]
    large = np.argsort(-sizes, kind="stable")[:units]
    deleted = segments[large[sizes[large] >= 2]]
    return deleted, np.setdiff1d(np.arange(n_segments(band)), segments)[:units - len(deleted)]


def profile(elements: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """Non-empty segments of a set in its own band, and the (band, segment, kind) of the
    neighbourhoods that it buys; for most sets none."""
    n = len(elements)
    if n < 4:  # a set so small is similar to none but itself
        return 0, []
    band = band_of(n)
    counts = np.bincount(_segment(elements, band)[0])
    segments = np.flatnonzero(counts)
    sizes = counts[segments]
    deleted, void = bought(n, segments, sizes, band)
    return len(segments), [(band, int(i), DELETED) for i in deleted] + [(band, int(i), VOID) for i in void]


def signatures(elements: np.ndarray, asked: dict[int, dict[int, set[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and how it holds each; ``asked``: band to kind to segments."""
    n = len(elements)
    keys, holds = [], []
    if n < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def put(sums: np.ndarray, segments: np.ndarray, band: int, forced: np.ndarray | bool, hold: int = INDEX) -> None:
        keys.append(_keys(sums, segments, band))
        holds.append(np.where(np.broadcast_to(np.asarray(forced), len(segments)), FORCED, hold).astype(np.int8))

    top = band_of(n)
    bands = [top] + [top - 1] * (top > 2 and 4 * n <= 5 * ((1 << top) - 1))
    for band in bands:
        segments, sums, sizes, of, mixed = _subsets(elements, band)
        own_deleted, own_void = bought(n, segments, sizes, band) if band == top else (segments[:0], segments[:0])
        put(sums, segments, band, bool(len(own_deleted) or len(own_void)), OWN if band == top else INDEX)
        around = asked.get(band)
        if not around:
            continue
        near = np.isin(of, list(around[DELETED]))
        if near.any():
            at = np.searchsorted(segments, of[near])
            put(sums[at] - mixed[near], of[near], band, np.isin(of[near], own_deleted))
        empty = np.setdiff1d(np.array(sorted(around[VOID]), np.int64), segments)
        if len(empty):
            put(np.zeros(len(empty), np.uint64), empty, band, np.isin(empty, own_void))
    return np.concatenate(keys), np.concatenate(holds)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (the set's hash), sketch, segments (not empty, in
    its own band), wanted; one row a document."""
    kind = pa.list_(pa.struct([("band", pa.int32()), ("segment", pa.int32()), ("kind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, uses="word hashes"):
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            profiles = [profile(s) for s in sets]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_shingles": pa.array(map(len, sets), pa.int64()), "node": pa.array(map(set_hash, sets), pa.int64()),
                "sketch": pa.array(map(sketch, sets), pa.binary()), "segments": pa.array([p[0] for p in profiles], pa.int64()),
                "wanted": pa.array([[dict(zip(("band", "segment", "kind"), w, strict=True)) for w in p[1]] for p in profiles], kind)})

    return keyed(docs).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node long, sketch binary, segments long, "
        "wanted array<struct<band: int, segment: int, kind: int>>")


def keyed(docs: DataFrame) -> DataFrame:
    return in_workers(docs).select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))


def _signatures(docs: DataFrame, asked: dict[int, dict[int, set[int]]]) -> DataFrame:
    """key, node, hold: 17 bytes a signature. A task sends a set once, however many of its
    rows have it, so a key has at most a row for each task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in sliced(batches, 128, uses="word hashes"):
            keys, nodes, holds = [], [], []
            for text in batch.column("text"):
                elements = shingle_set(text.as_py())
                node = set_hash(elements)
                if node in sent:
                    continue
                sent.add(node)
                key, hold = signatures(elements, asked)
                keys.append(key)
                holds.append(hold)
                nodes.append(np.full(len(key), node, np.int64))
            if not keys:
                continue
            yield pa.record_batch({
                "key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(np.concatenate(nodes)),
                "hold": pa.array(np.concatenate(holds))})

    return keyed(docs).select("text").mapInArrow(run, "key long, node long, hold byte")


def _allocated(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, probe, free of the keys with which some set probes, out of those (key, node,
    hold, shared_by) that several sets hold.

    Of its own keys a set holds ``segments``, of which those not here are free; it probes
    with as many of the rarest others as it has units left."""
    own = F.col("hold") == OWN
    per_node = Window.partitionBy("node", "hold")
    free = F.col("segments") - F.count("*").over(per_node)
    rank = F.row_number().over(per_node.orderBy("shared_by", "key"))
    probing = keys.join(nodes.select("node", "n_shingles", "segments"), "node").withColumn("free", free).withColumn(
        "probe", (F.col("hold") == FORCED) | own & (rank <= F.floor(F.col("n_shingles") / 4) + 1 - F.col("free")))
    # a key is held by few once chance is gone; what follows reads its rows again by a join
    chosen = probing.filter("probe").select("key").distinct()
    return probing.select("key", "node", "probe", F.when(own, F.col("free")).alias("free")).join(chosen, "key", "left_semi")


def _asked(described: DataFrame) -> dict[int, dict[int, set[int]]]:
    """The neighbourhoods bought by any set. There are at most as many as segments of all
    bands, half the shingles of the longest text, whatever the number of documents."""
    out: dict[int, dict[int, set[int]]] = {}
    for r in described.select(F.explode("wanted").alias("w")).select("w.*").distinct().collect():
        out.setdefault(r["band"], {DELETED: set(), VOID: set()})[r["kind"]].add(r["segment"])
    return out


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, elements (8 bytes each, sorted) of the chosen nodes (doc_id, text_hash, node).

    A bitmap of the chosen texts keeps the texts of all others out of the shuffle."""
    bit = F.pmod(F.col("text_hash"), F.lit(BITS)) + 1
    pieces = chosen.select(F.bitmap_bucket_number(bit).alias("no"), F.bitmap_bit_position(bit).alias("at")).groupBy(
        "no").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for p in pieces:
        bitmap[(p["no"] - 1) * 4096:p["no"] * 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("text_hash").to_numpy().astype(np.int64) & (BITS - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, uses="word hashes"):
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.record_batch({"node": batch.column("node"), "elements": pa.array(sets, pa.binary())})

    texts = keyed(docs).mapInArrow(run, "doc_id long, text_hash long, text string")
    key = chosen.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # rows that repeat id and text give one node; either row will do
    return texts.join(key, same).select("node", "text").mapInArrow(elements, "node long, elements binary").dropDuplicates(["node"])


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b with n_a, n_b, s_a, s_b) whose sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.array(batch.column(c)) for c in ("n_a", "n_b"))
            bits = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(x), len(y))
                bits[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(linked(n_a, n_b, bits)))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links, compared element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("e_a"), batch.column("e_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = linked(len(x), len(y), len(x) + len(y) - 2 * both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    a, b = (sets.select(F.col("node").alias(c), F.col("elements").alias(f"e_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _with_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds sizes and sketches to pairs (a, b), dropping those whose sizes forbid a link."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    fits = F.least("n_a", "n_b") * 5 >= F.greatest("n_a", "n_b") * 4
    return pairs.join(a, "a").join(b, "b").filter(fits)


def _across(keys: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a key, as far as the sketches
    allow.

    The rows of a key are dealt to blocks of about ``BLOCK``: a component with more rows has
    blocks of its own, the others share blocks. Blocks are joined with blocks, except those of
    one component with each other, and compared inside the row."""
    rows = keys.join(labels, "node", "left").select("key", "node", "probe", F.coalesce("component", "node").alias("label"))
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("probe").alias("probe"))
    per_key = counts.groupBy("key").agg(
        F.count("*").alias("labels"), F.max("probe").alias("any_probe"),
        F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0)).alias("small"))
    counts = counts.join(per_key.filter("labels > 1 and any_probe"), "key").select(
        "key", "label", F.when(F.col("n") >= BLOCK, F.col("label")).alias("alone"),
        F.ceil(F.when(F.col("n") >= BLOCK, F.col("n")).otherwise(F.col("small")) / BLOCK).alias("blocks"))
    dealt = rows.join(counts, ["key", "label"]).join(nodes.select("node", "n_shingles", "sketch"), "node")
    number = F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("blocks"))
    blocks = dealt.groupBy("key", "alone", number.alias("number")).agg(
        F.max("probe").alias("probe"), F.collect_list(F.struct("node", "label", "n_shingles", "sketch")).alias("rows"))
    blocks = stored(blocks.withColumn("block", F.struct(F.coalesce("alone", F.lit(0)).alias("alone"), "number")), "blocks")
    x, y = (blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("alone", "block", "probe", "rows"))) for side in "xy")
    paired = x.join(y, "key").filter("block_x <= block_y and (probe_x or probe_y) and not (alone_x <=> alone_y and alone_x is not null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_x, rows_y in zip(batch.column("rows_x"), batch.column("rows_y"), strict=True):
                for a, b in _compared(rows_x.as_py(), rows_y.as_py()):
                    yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return paired.select("rows_x", "rows_y").mapInArrow(run, "a long, b long").distinct()


def _compared(rows_x: list[dict], rows_y: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two blocks that differ in component and may be linked. The sketches of a
    block are stacked by length and folded to the shorter length of both sides."""
    def stacks(rows: list[dict]) -> dict[int, tuple[np.ndarray, ...]]:
        by_length: dict[int, list[dict]] = {}
        for r in rows:
            by_length.setdefault(len(r["sketch"]), []).append(r)
        return {size: (
            np.array([r["node"] for r in few]), np.array([r["label"] for r in few]), np.array([r["n_shingles"] for r in few]),
            np.frombuffer(b"".join(r["sketch"] for r in few), np.uint8).reshape(len(few), size),
        ) for size, few in by_length.items()}

    for size_x, (node_x, label_x, n_x, bits_x) in stacks(rows_x).items():
        for size_y, (node_y, label_y, n_y, bits_y) in stacks(rows_y).items():
            size = min(size_x, size_y)
            left, right = folded(bits_x.T, size).T.copy().view(np.uint64), folded(bits_y.T, size).T.copy().view(np.uint64)
            for i in range(len(node_x)):
                near = (label_y != label_x[i]) & (5 * np.minimum(n_y, n_x[i]) >= 4 * np.maximum(n_y, n_x[i]))
                at = np.flatnonzero(near)
                if len(at):
                    differing = np.bitwise_count(right[at] ^ left[i]).sum(axis=1)
                    at = at[linked(n_y[at], n_x[i], differing)]
                    if len(at):
                        yield np.minimum(node_y[at], node_x[i]), np.maximum(node_y[at], node_x[i])


def links(docs: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that connect all similar sets (a link, or a set and the smallest of a
    component that links made), and the components."""
    nodes = described.filter("n_shingles > 0").groupBy("node").agg(
        F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("segments").alias("segments"),
        F.min(F.struct("doc_id", "text_hash")).alias("row"))
    per_key = Window.partitionBy("key")
    # one row per key and set: the partitioning by key serves the aggregate and the window
    distinct = _signatures(docs, _asked(described)).repartition("key").groupBy("key", "node").agg(F.max("hold").alias("hold"))
    keys = distinct.select(
        "key", "node", "hold", F.count("*").over(per_key).alias("shared_by")).filter("shared_by > 1")
    keys = stored(_allocated(stored(keys, "shared-keys"), nodes), "keys")
    chosen = keys.select("node").distinct()
    nodes = stored(nodes.join(chosen, "node"), "nodes")
    sets = stored(_sets(docs, nodes.select("node", "row.*")), "sets")
    centers = keys.groupBy("key").agg(F.min(F.struct(F.coalesce("free", F.lit(1 << 40)), "node")).alias("c")).select("key", F.col("c.node").alias("center"))
    star = keys.join(centers, "key").filter("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    found = stored(_verified(_near(_with_sketches(star, nodes)), sets), "star-links")
    labels = components(found, "star-components")
    rest = _verified(_across(keys.select("key", "node", "probe"), labels, nodes), sets)
    found = stored(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), "links")
    return found, components(found, "components")


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, label (its component; null without words) of each row."""
    described = stored(describe(docs), "shingle-sets")
    # stored, so that the join on the set may be split where copies of one text are many
    labels = stored(links(docs, described)[1], "labels")
    member = described.select("doc_id", "text_hash", "n_shingles", "node").join(labels, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    return member.select("doc_id", "text_hash", "n_shingles", own.alias("label"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents without words (null, empty or blank texts) have no shingles and are linked with
    nothing; a text of fewer than five words has one shingle, the whole. The component is the
    smallest doc_id of all rows reachable by links; null where these have no id. Rows that
    repeat are members like others. An empty table gives no rows.
    """
    member = _labelled(docs)
    # stored, so that the join may be split where a component is a large share of all rows
    smallest = stored(member.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest")), "smallest-members")
    out = member.join(smallest, "label", "left")
    return out.select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns, whatever their names.

    That of the smallest doc_id stays, a null id only where no other is; of rows with one id
    that of the smallest hash of the text. Documents without words stay. Rows that repeat id
    and text are one document."""
    kept_id, kept_hash, text_hash = internal(docs, "doc_id", "kept_hash", "text_hash")
    member = _labelled(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    keep = member.filter("label is not null").groupBy("label").agg(first).select("first.doc_id", "first.text_hash").union(
        member.filter("label is null").select("doc_id", "text_hash"))
    keep = keep.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    same = (F.col(text_hash) == F.col(kept_hash)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    return hashed.join(keep, same, "left_semi").dropDuplicates(["doc_id", text_hash]).drop(text_hash)

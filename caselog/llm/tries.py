"""Prefix trie of conversations, rolled up along a centroid decomposition.

A node is a distinct sequence of first turns. Its identity is 128 bits: turn hashes that
include their place are combined by exclusive or, so the prefixes of a conversation are a
running aggregate and no sequence is ever gathered in one value.

The parent edges form a forest. Sums over subtrees come from splitting it: every component is
cut at its centroid, the total of what the centroid has below it in the component is added
to each node on the path from the centroid up to the component's top, and the parts go on by
themselves. A node gets at most one addition a level, and parts halve, so chains of any depth
take a logarithmic number of levels. Components of at most ``SMALL`` occurrences are finished
by the same steps in arrays, many of them in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.common import PART, ROW, in_workers, ordered, stored
from caselog.session import scratch_path

#: Turns of a conversation whose prefixes one task makes; ids that one string of ends holds.
CHUNK = 4096
#: Occurrences of turns of a component that one task may hold (at most 8 MB in arrays).
SMALL = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes and ``bytes`` of each turn, in the order of ``turn``.

    Null turns come first, turns that tie in the order of a hash of role and text. A null
    role or text is empty. Rows without a conv_id belong to no conversation. Rows are
    range-partitioned, so a conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.md5(F.concat(role, F.lit("\0"), text)).alias("_tie"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes")).withColumn("_row_id", F.monotonically_increasing_id())
    placed = ordered(rows, [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_tie"), F.col("_row_id")], "turns")
    before = Window.partitionBy("conv_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(PART, "conv_id").agg(F.count("*").alias("_n")).select(
        PART, "conv_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(PART, "conv_id").orderBy(ROW))
    numbered = placed.withColumn("_local", local).join(counts, [PART, "conv_id"])
    return numbered.select("conv_id", (F.col("_before") + F.col("_local")).alias("pos"), "h1", "h2", "bytes")


def members(rows: DataFrame) -> DataFrame:
    """conv_id and its number of turns, ``len``."""
    return rows.groupBy("conv_id").agg(F.count("*").alias("len"))


def head(conv_id: Column, most: int) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def spliced(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first ``head`` turns of the conversation that begins
    their group of ids, then their own after as many: turns with ``len``, and members."""
    own = stored(members(rows), "conversation-lengths")
    first = own.select(F.col("conv_id").alias("first_id"), F.col("len").alias("first_len"))
    convs = own.withColumn("head", head(F.col("conv_id"), most)).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.join(first, "first_id", "left").withColumn("taken", F.least("head", F.coalesce("first_len", F.lit(0))))
    convs = stored(convs.select(
        "conv_id", "first_id", "head", "taken", (F.col("taken") + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("len")), "conversations")
    values = ["h1", "h2", "bytes"]
    given = rows.filter(F.col("pos") < most).withColumnRenamed("conv_id", "first_id").join(convs, "first_id").filter("pos <= taken")
    kept = rows.join(convs, "conv_id").filter(F.col("pos") > F.col("head")).withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    return (given.select("conv_id", "pos", "len", *values).union(kept.select("conv_id", "pos", "len", *values)),
            convs.select("conv_id", "len"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, id, up (the id one turn shorter), bytes, len of each occurrence of a node."""
    keyed = rows.withColumns({
        "h1": F.xxhash64("h1", "h2", "pos"), "h2": F.xxhash64("pos", "h2", "h1", F.lit(1)),
        "chunk": F.floor((F.col("pos") - 1) / CHUNK)})
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = keyed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2")).select(
        "conv_id", "chunk", *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(t) for t in ("t1", "t2")))
    local = keyed.withColumns({"x1": F.bit_xor("h1").over(within), "x2": F.bit_xor("h2").over(within)}).join(chunks, ["conv_id", "chunk"])
    hi, lo = F.col("x1").bitwiseXOR(F.col("t1")), F.col("x2").bitwiseXOR(F.col("t2"))
    return local.select(
        "conv_id", F.col("pos").alias("depth"), F.struct(hi.alias("hi"), lo.alias("lo")).alias("id"),
        F.struct(hi.bitwiseXOR(F.col("h1")).alias("hi"), lo.bitwiseXOR(F.col("h2")).alias("lo")).alias("up"), "bytes", "len")


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))


def nodes(occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """id, up, conv_id (smallest member), depth, n_convs, bytes, and ``rows``, the occurrences
    of turns in the subtree, which members' lengths give without a rollup."""
    inner = occurrences.groupBy("id").agg(
        F.min("up").alias("up"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
        F.min("bytes").alias("bytes"), F.sum("len").alias("lens"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("len").alias("lens")).filter("n_convs > 0")
    root = root.select(
        _root().alias("id"), F.lit(None).cast("struct<hi: bigint, lo: bigint>").alias("up"), "conv_id", F.lit(0).cast("long").alias("depth"),
        "n_convs", F.lit(0).cast("long").alias("bytes"), "lens")
    every = inner.select(root.columns).union(root)
    return every.withColumn("rows", F.col("lens") - F.col("n_convs") * (F.col("depth") - 1)).drop("lens")


def end_hashes(occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """id and ends_sha256 of the nodes at which conversations end.

    Ids are sorted by ranges and joined to strings of up to ``CHUNK``; SHA-256 is sequential,
    so the strings of one node pass through one task, as a stream in constant memory."""
    ends = occurrences.filter("depth = len").select("id", "conv_id").union(
        members.filter("len = 0").select(_root().alias("id"), "conv_id"))
    placed = ordered(ends, [F.col("id"), F.col("conv_id")], "ends")
    chunk = F.floor(F.col(ROW) / CHUNK)
    strings = placed.groupBy("id", PART, chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select(
        "id", PART, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo = [], []
        out: list[str] = []
        last, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                key = (key["hi"], key["lo"])
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    hi.append(last[0])
                    lo.append(last[1])
                    out.append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.record_batch({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "ends_sha256": pa.array(out, pa.string())})
            hi, lo, out = [], [], []
        if last is not None:
            yield pa.record_batch({"hi": pa.array([last[0]]), "lo": pa.array([last[1]]), "ends_sha256": pa.array([state.hexdigest()])})

    streams = in_workers(strings).repartition("id").sortWithinPartitions("id", PART, "chunk").select("id", "ids")
    hashes = streams.mapInArrow(run, "hi long, lo long, ends_sha256 string")
    return hashes.select(F.struct("hi", "lo").alias("id"), "ends_sha256")


def rolled_up(forest: DataFrame, occurrences: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """The rows of ``forest`` with each value replaced by its sum over the subtree.

    ``forest`` has id, up (null at a top), conv_id, depth, rows and the values; other columns
    are carried along. ``occurrences`` (conv_id, depth, id, up) tell which child of a centroid
    a node's conversation passes through.
    """
    spark = forest.sparkSession
    state = forest.withColumns({"comp": _root(), **{f"sum_{v}": F.lit(0).cast("long") for v in values}})
    done: list[DataFrame] = []
    while True:
        sizes = stored(state.groupBy("comp").agg(F.max("rows").alias("size")), "component-sizes")
        path = scratch_path(spark, "components")
        sized = state.join(sizes, "comp").withColumn("big", F.col("size") > small)
        sized.write.partitionBy("big").parquet(path)
        sized = spark.read.schema(sized.schema).parquet(path)
        done.append(_finished(sized.filter("not big").drop("big"), values))
        big = sized.filter("big").drop("big")
        if big.isEmpty():
            break
        cut = stored(_cut(big, occurrences, values), "cut")
        own = [c for c in state.columns]
        done.append(cut.filter("center").select(own))
        state = cut.filter("not center").select(own)
    out = done[0].select(forest.columns + [f"sum_{v}" for v in values])
    for part in done[1:]:
        out = out.union(part.select(out.columns))
    return out.drop(*values).withColumnsRenamed({f"sum_{v}": v for v in values})


def _cut(big: DataFrame, occurrences: DataFrame, values: list[str]) -> DataFrame:
    """One level: every component cut at its centroid, the deepest node with half of the
    component's occurrences below it. Nodes with half or more are the path up to the top."""
    on_path = F.col("rows") * 2 >= F.col("size")
    center = F.max_by(F.struct("id", "depth", "rows"), "depth").alias("c")
    centers = stored(big.filter(on_path).groupBy("comp").agg(center).select(
        "comp", F.col("c.id").alias("c_id"), F.col("c.depth").alias("c_depth"), F.col("c.rows").alias("c_rows")), "centroids")
    # one row for each conversation that names nodes of a component, not one for each node
    names = big.join(centers, "comp").filter(F.col("depth") > F.col("c_depth")).select("comp", "conv_id", "c_id", "c_depth").distinct()
    through = occurrences.select(F.col("conv_id").alias("o_conv"), F.col("depth").alias("o_depth"), F.col("up").alias("o_up"), F.col("id").alias("child"))
    below = stored(names.join(through, (F.col("conv_id") == F.col("o_conv")) & (F.col("o_depth") == F.col("c_depth") + 1)).filter(
        F.col("o_up") == F.col("c_id")).select("comp", "conv_id", "child"), "below-centroids")
    is_center = F.col("id") == F.col("c_id")
    inside = is_center | ((F.col("depth") > F.col("c_depth")) & F.col("child").isNotNull())
    flagged = stored(big.join(centers, "comp").join(below, ["comp", "conv_id"], "left").withColumns(
        {"center": is_center, "inside": inside}), "around-centroids")
    totals = stored(flagged.filter("inside").groupBy("comp").agg(*(F.sum(v).alias(f"total_{v}") for v in values)), "component-totals")
    return flagged.join(totals, "comp").withColumns({
        **{f"sum_{v}": F.col(f"sum_{v}") + F.when(on_path, F.col(f"total_{v}")).otherwise(0) for v in values},
        "rows": F.when(on_path & ~F.col("center"), F.col("rows") - F.col("c_rows")).otherwise(F.col("rows")),
        "comp": F.when(F.col("inside") & ~F.col("center"), F.col("child")).otherwise(F.col("comp"))})


def _finished(comps: DataFrame, values: list[str]) -> DataFrame:
    """Small components, decomposed to the end; a task holds the arrays of a few at a time."""
    columns = [c for c in comps.columns if c != "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SMALL:
                table = pa.Table.from_batches(held).combine_chunks()
                tops = table.column("comp").combine_chunks()
                hi, lo = (np.asarray(tops.field(i)) for i in (0, 1))
                new = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
                whole = int(new[-1]) if len(new) else 0
                if whole:
                    yield from _decomposed(table.slice(0, whole), values)
                held, n = table.slice(whole).to_batches(), table.num_rows - whole
        if n:
            yield from _decomposed(pa.Table.from_batches(held), values)

    sorted_ = in_workers(comps).select(columns).repartition("comp").sortWithinPartitions("comp")
    return sorted_.mapInArrow(run, sorted_.schema)


def _decomposed(table: pa.Table, values: list[str]) -> Iterator[pa.RecordBatch]:
    table = table.take(np.argsort(np.asarray(table.column("depth")), kind="stable")).combine_chunks()
    ids, ups = (table.column(c).to_pylist() for c in ("id", "up"))
    number = {(x["hi"], x["lo"]): i for i, x in enumerate(ids)}
    parent = np.array([-1 if x is None else number.get((x["hi"], x["lo"]), -1) for x in ups], np.int64)
    sums = centroid_sums(parent, np.asarray(table.column("depth")), np.asarray(table.column("rows")),
                         np.stack([np.asarray(table.column(v)) for v in values]))
    for v, sum_ in zip(values, sums, strict=True):
        at = table.column_names.index(f"sum_{v}")
        table = table.set_column(at, table.schema.field(at), pa.array(np.asarray(table.column(at)) + sum_))
    yield from table.to_batches()


def preorder(parent: np.ndarray, depth: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places so that the subtree of v is [place, place + rows). Nodes come by depth."""
    own = rows.copy()
    np.subtract.at(own, parent[parent >= 0], rows[parent >= 0])
    place = np.zeros(len(rows), np.int64)
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(rows[tops]) - rows[tops]
    below = np.flatnonzero(parent >= 0)
    below = below[np.lexsort((parent[below], depth[below]))]
    cuts = np.flatnonzero(np.diff(depth[below])) + 1
    for level in np.split(below, cuts):
        if len(level):
            up, sizes = parent[level], rows[level]
            before = np.cumsum(sizes) - sizes
            first = np.r_[True, up[1:] != up[:-1]]
            before -= np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(level)]))
            place[level] = place[up] + own[up] + before
    return place


def centroid_sums(parent: np.ndarray, depth: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values over subtrees of a forest whose nodes come by depth (parent -1 at a
    top; ``rows`` weighs subtrees, each node at least 1), by centroid decomposition."""
    n = len(parent)
    place, whole, rows = preorder(parent, depth, rows), rows.copy(), rows.copy()
    rank = np.empty(n, np.int64)
    rank[np.argsort(place, kind="stable")] = np.arange(n)
    label = np.arange(n)
    for i in np.flatnonzero(parent >= 0):  # parents come first
        label[i] = label[parent[i]]
    alive, sums = np.arange(n), np.zeros_like(values)
    center_of = np.zeros(n, np.int64)
    while len(alive):
        top = label[alive]
        on_path = alive[2 * rows[alive] >= rows[top]]
        center_of[label[on_path]] = on_path  # the deepest comes last
        center = center_of[top]
        inside = (place[alive] >= place[center]) & (place[alive] < place[center] + whole[center])
        total = np.zeros_like(values)
        for t, v in zip(total, values, strict=True):
            np.add.at(t, center[inside], v[alive[inside]])
        centers = center_of[label[on_path]]
        sums[:, on_path] += total[:, centers]
        rest = on_path != centers
        rows[on_path[rest]] -= rows[centers[rest]]
        tops = alive[parent[alive] == center]
        tops = tops[np.lexsort((rank[tops], label[tops]))]
        keys = (label[tops] << 32) | rank[tops]
        moved = alive[inside & (alive != center)]
        label[moved] = tops[np.searchsorted(keys, (label[moved] << 32) | rank[moved], "right") - 1]
        alive = alive[alive != center]
    return sums


def trie(rows: DataFrame, members: DataFrame, small: int = SMALL) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (see the query). ``rows`` are conv_id, pos, len, h1, h2 and
    bytes of turns. Conversations without turns are members of the root; no conversation, no
    node. Equal conversations share all their nodes."""
    occurrences = stored(prefixes(rows), "occurrences")
    members = stored(members, "members")
    every = stored(nodes(occurrences, members), "nodes")
    children = every.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    parents = every.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    forest = every.join(children, "id", "left").join(end_hashes(occurrences, members), "id", "left").join(parents, "up", "left").select(
        "id", "up", "conv_id", "depth", "rows", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    return rolled_up(forest, occurrences, ["n_leaves", "saved_tokens"], small).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

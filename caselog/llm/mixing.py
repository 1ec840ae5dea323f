"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream: its documents in hash order, one after the other, cut into blocks
of equally many words. The mix is a sequence of slots. Slot i has the point
``frac(i * golden ratio)`` (in whole numbers modulo 2^31), which the cumulative targets map
to a source; the k-th slot of a source takes block ``k mod blocks`` of its stream, so that
every pass over a source takes each block once. All steps are DataFrame operations.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.common import PLACE, WORD, internal, ordered, running, stored

#: The points: i * STEP mod PERIOD, STEP being the odd number next to PERIOD / golden ratio.
PERIOD, STEP = 1 << 31, 1327217885
#: Equal cells of [0, 1) by which points and source intervals are joined.
CELLS = 4096


class Mix(NamedTuple):
    documents: DataFrame
    """Each document with ``size``, ``source_no``, ``start`` in its source's stream, and a key."""
    sources: DataFrame
    """One row a source: ``source_no``, ``source_size``, ``weight``, ``target``."""
    rows: DataFrame
    """The mix: slot, source_no, epoch, block, document key, words from (kept) to (left out)."""


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Sources by code point, null last, with their targets.

    A target is ``min(repeats * source_size, level * weight)`` with the one level at which
    all targets add up to ``share`` of all words: sorted by cap / weight, the sources whose
    cap lies below the level of what is left after those before them are capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.select(
        "source", "source_size", F.row_number().over(by_name).alias("source_no"), weight.cast("long").alias("weight"),
        (F.sum("source_size").over(by_name) - F.col("source_size")).alias("source_base"),
        (F.col("source_size") * repeats).alias("cap"),
    )
    total = F.sum("source_size").over(everything) * share
    left, weight_left = (
        total - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    )
    capped = sources.withColumn("total", total).withColumn(
        "is_capped", F.col("cap") * weight_left <= left * F.col("weight"))
    open_weight = F.sum(F.when(~F.col("is_capped"), F.col("weight"))).over(everything)
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("is_capped"), F.col("cap"))).over(everything), F.lit(0))
    target = F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(open_words / open_weight * F.col("weight"))
    return capped.withColumn("target", target).drop("cap", "total", "is_capped")


def _slots(sources: DataFrame, n_slots: int, block: int, repeats: int) -> DataFrame:
    """One row a slot: slot, source_no, epoch, block."""
    spark = sources.sparkSession
    by_no = Window.orderBy("source_no")
    total = F.sum("target").over(Window.partitionBy())
    bounds = sources.withColumn("upto", F.sum("target").over(by_no) / total).withColumn(
        "lo", F.coalesce(F.lag("upto").over(by_no), F.lit(0.0))
    ).filter("target > 0").withColumn(
        # the last interval reaches beyond 1, so rounding leaves no point without a source
        "hi", F.coalesce(F.lead("lo").over(by_no), F.lit(2.0)))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    bounds = bounds.select("source_no", "source_size", "lo", "hi", F.explode(cells).alias("cell"))
    chunk = min(100_000, -(-n_slots // 1024)) or 1
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"),
        ((F.col("id") % PERIOD * STEP) % PERIOD / PERIOD).alias("x"),
    ).withColumn("cell", F.floor(F.col("x") * CELLS))
    slots = slots.join(bounds, "cell").filter("lo <= x and x < hi")
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_chunk = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("in_chunk", in_chunk).join(counts, ["source_no", "chunk"]).withColumn(
        "rank", F.col("before") + F.col("in_chunk")).withColumn(
        "blocks", F.floor((F.col("source_size") + (block - 1)) / block))
    return ranked.filter(F.col("rank") < F.col("blocks") * repeats).select(
        "slot", "source_no", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
    seed: int = 0, block: int | None = None,
) -> Mix:
    """Mix all documents so that each source gives about its target of words.

    ``weights`` repeat over the sources in code-point order (a null source is one source,
    the last). ``block`` is the number of words of a slot; by default a thousandth of the
    smallest target, at least 16 and at most 2048, so a source misses its target by a few
    thousandths (a few times 16 words for sources below 16,000 words). No block, and so no
    document, is taken more than ``repeats`` times.

    Null and empty texts have no words and are in ``documents`` but not in the mix; a table
    without words gives an empty mix. Null ids, repeated rows and repeated ids are rows of
    their own. Columns other than doc_id, text and source are not read.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), order.alias("_order"))
    # the row number tells equal ids apart and lets the ranges cut between them
    sized = sized.withColumn("_tie", F.monotonically_increasing_id())
    placed = ordered(sized, [F.col("source").asc_nulls_last(), F.col("_order"), F.col("_tie")], "mix-order")
    sources = stored(source_targets(placed, weights, share, repeats), "mix-sources")
    smallest, words_wanted = sources.agg(
        F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("target")).first()
    block = block or max(16, min(2048, int(smallest or 0) // 1000))
    n_slots = -(-int(words_wanted or 0) // block)
    streams = running(placed, _start=F.col("size")).join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select(
        "doc_id", "text_hash", "source", "size", "source_no", "source_size", "target", F.col(PLACE).alias("key"),
        (F.col("_start") - F.col("source_base")).alias("start"))
    streams = stored(streams, "mix-streams")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = streams.filter("size > 0").select(
        "source_no", "key", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.select(
        "source_no", "block", "key", "doc_id",
        F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_word"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("to_word"))
    rows = _slots(sources, n_slots, block, repeats).join(pieces, ["source_no", "block"])
    return Mix(streams, sources, rows)


def taken(mixed: Mix) -> DataFrame:
    """Each document with its source's size and target and the words that the mix takes."""
    sums = mixed.rows.groupBy("key").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return mixed.documents.join(sums, "key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: Splits a text before every word but the first, keeping all its characters.
_BEFORE_WORDS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def applied(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as documents: a row for each pass over a document, all columns of ``docs``.

    A pass takes a source's blocks in order, so a document is taken whole, or not at all, but
    for the one at which the last pass over its source ends: that keeps the words taken.
    Rows equal in id, source and text take their other columns from one of them.
    """
    taken_words = mixed.rows.groupBy("key", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_words"))
    found_id, found_hash, found_source, size, words, text_hash = internal(
        docs, "doc_id", "found_hash", "source", "size", "words", "text_hash")
    passes = taken_words.join(mixed.documents, "key").select(
        F.col("doc_id").alias(found_id), F.col("text_hash").alias(found_hash), F.col("source").alias(found_source),
        F.col("size").alias(size), F.col("_words").alias(words))
    hashed = docs.withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash, "source"])
    same = (F.col(text_hash) == F.col(found_hash)) & F.col("doc_id").eqNullSafe(F.col(found_id)) & F.col("source").eqNullSafe(F.col(found_source))
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    rest = F.split(F.substring("text", F.length(head) + 1, F.length("text")), _BEFORE_WORDS)
    cut = F.concat(head, F.array_join(F.slice(rest, 1, F.col(words)), ""))
    out = hashed.join(passes, same).withColumn("text", F.when(F.col(words) == F.col(size), F.col("text")).otherwise(cut))
    return out.select(*docs.columns)

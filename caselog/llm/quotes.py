"""Quotation linking: reply-ordered conversations without quotes.

Quoted passages of a message (lines behind ``>`` marks, nested to any level) are normalised
and hashed, and so are the own words of every message: the whole, its paragraphs, its lines
and its sentences. A passage is joined to the message whose own words it repeats, the nearest
earlier one of the same conversation if there is one, else the first of all; a quote of one
or two words stays within its conversation. The message of the best
passage of the outermost level is the parent; messages and parents form threads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from caselog.llm.common import PART, PLACE, ROW, in_workers, ordered, running, stored

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)
_BLANK = re.compile(r"\n\s*\n")
#: A sentence may go on over line feeds, as quotes are wrapped anew.
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words from which a passage may be linked to other conversations; shorter ones ("thanks")
#: say nothing there.
LEAST_WORDS = 3


def levels(text: str | None) -> list[tuple[int, str]]:
    """Runs of lines of one quote level (0: own words) in order, without the marks."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level = marks[1].count(">") if marks else 0
        body = line[marks.end():] if marks else line
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(body)
    return [(level, "\n".join(lines)) for level, lines in out]


def own_words(text: str | None) -> str | None:
    """The text without quotes and without the lines that announce them; a text that quotes
    nothing is returned as it is."""
    found = levels(text)
    if text is None or all(level == 0 for level, _ in found):
        return text
    kept = []
    for i, (level, body) in enumerate(found):
        if level:
            continue
        lines = body.split("\n")
        if i + 1 < len(found):
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and _INTRO.match(lines[-1]):
                lines.pop()
        kept.append("\n".join(lines).strip("\n"))
    return "\n\n".join(k for k in kept if k.strip()).strip()


def passages(body: str, quoted: bool = False) -> Iterator[tuple[int, bool, bytes]]:
    """Rank (0 the whole, 1 a paragraph, 2 a line, 3 a sentence), whether it is short, and
    hash of the passages of a body. Of a quote only the whole may be short."""
    seen = set()
    paragraphs = _BLANK.split(body)
    sentences = [piece for p in paragraphs for piece in _SENTENCE.split(p)]
    for rank, pieces in enumerate(([body], paragraphs, body.split("\n"), sentences)):
        for piece in pieces:
            words = piece.lower().split()
            short = len(words) < LEAST_WORDS
            if not words or short and quoted and rank:
                continue
            digest = xxh3_128_digest(" ".join(words).encode(errors="replace"))
            if digest not in seen:
                seen.add(digest)
                yield rank, short, digest


def _parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), and hashes: quoted and own passages."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("rank", pa.int32()), ("short", pa.bool_()), ("hi", pa.int64()), ("lo", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, hashes = [], []
                for text in batch.column("text").to_pylist():
                    own = own_words(text)
                    texts.append(own)
                    bodies = [(0, own or ""), *((level, body) for level, body in levels(text) if level)]
                    found = []
                    for level, body in bodies:
                        for rank, short, digest in passages(body, level > 0):
                            hi, lo = np.frombuffer(digest, np.int64).tolist()
                            found.append({"level": level, "rank": rank, "short": short, "hi": hi, "lo": lo})
                    hashes.append(found)
                yield pa.record_batch({
                    "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"),
                    "text": pa.array(texts, pa.string()), "hashes": pa.array(hashes, kind)})

    slim = in_workers(messages).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "conv_id long, turn long, role string, text string, "
                                "hashes array<struct<level: int, rank: int, short: boolean, hi: long, lo: long>>")


def reply_links(parsed: DataFrame) -> DataFrame:
    """key, parent, level, rank: the message each message replies to, by its best passage.

    ``key`` numbers the messages in the order of (conv_id, turn). Own passages that nobody
    quotes are dropped before they move; of equal ones each conversation and the whole table
    keep what a quote can reach, as minimum or running maximum, so that a passage which many
    messages share is never paired with all of them.
    """
    every = parsed.select("key", "conv_id", F.explode("hashes").alias("h")).select("key", "conv_id", "h.*").withColumn("within", F.when(F.col("short"), F.col("conv_id")))
    quoted = every.filter("level > 0")
    wanted = quoted.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("within").alias("_within")).distinct()
    same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & F.col("within").eqNullSafe(F.col("_within"))
    own = every.filter("level = 0").select("key", "conv_id", "short", "hi", "lo", "within").join(wanted, same, "left_semi")
    first = own.filter("not short").groupBy("hi", "lo").agg(F.min("key").alias("first"))
    both = own.withColumn("source", F.col("key")).select("hi", "lo", "conv_id", "key", "source", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("rank")).unionByName(
        quoted.select("hi", "lo", "conv_id", "key", F.lit(None).cast("long").alias("source"), "level", "rank"))
    before = Window.partitionBy("conv_id", "hi", "lo").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("source").over(before)).filter("level is not null")
    found = near.join(first, ["hi", "lo"], "left").withColumn(
        "parent", F.coalesce("near", F.when(F.col("first") < F.col("key"), F.col("first")))).filter("parent is not null")
    # the outermost level, then the longest passage, then the nearest message
    best = F.min(F.struct("level", "rank", (-F.col("parent")).alias("late"))).alias("best")
    return found.groupBy("key").agg(best).select(
        "key", (-F.col("best.late")).alias("parent"), F.col("best.level").alias("level"), F.col("best.rank").alias("rank"))


def _roots(links: DataFrame, name: str) -> DataFrame:
    """key, root, depth for linked messages, by doubling: after r rounds every message knows
    its ancestor 2^r steps up. A parent has a smaller key, so there are no circles."""
    state = stored(links.select("key", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), name)
    while True:
        up = state.select(F.col("key").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        step = state.join(up, "root", "left")
        if not step.filter("_next is not null").limit(1).count():
            return state
        state = stored(step.select(
            "key", F.coalesce("_next", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), name)


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text without quotes, the message it replies to
    (reply_conv, reply_turn), n_quotes, thread, depth, and position, gapless from 0 in the
    thread, in which every message comes after the one it replies to.

    A thread is a conversation with all conversations that quote it: one whose messages quote
    another conversation joins the thread of the first so quoted, one level deeper (depth).
    Messages of a thread are in the order of conv_id and turn, and a parent is always earlier
    in that order. A conversation without quotes is one thread in the order of turns.

    Null texts stay null and quote nothing; rows with null conv_id are one conversation, the
    first; rows that repeat are messages of their own, in the order of the input. Other
    columns are not read. An empty table gives no rows.
    """
    rows = _parsed(messages).withColumn("_tie", F.monotonically_increasing_id())
    placed = ordered(rows, [F.col("conv_id"), F.col("turn"), F.col("_tie")], "messages")
    parsed = stored(running(placed, key=F.lit(1)).drop(PART, ROW, PLACE, "_tie"), "parsed")
    linked = stored(reply_links(parsed), "reply-links")
    slim = parsed.select("key", "conv_id").join(linked.select("key", "parent"), "key", "left")
    heads = slim.groupBy("conv_id").agg(F.min("key").alias("head"))
    base = slim.join(heads.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    roots = _roots(_head_links(base), "roots")
    at = base.withColumn("own_head", F.col("head")).join(
        roots.select(F.col("key").alias("own_head"), "root", F.col("depth").alias("_up")), "own_head", "left")
    at = at.select("key", F.coalesce("root", "own_head").alias("thread"), F.coalesce("_up", F.lit(0)).alias("up"), "parent")
    placed = ordered(at, [F.col("thread"), F.col("key")], "threads")
    ranked = running(placed, rank=F.lit(1))
    firsts = ranked.groupBy("thread").agg(F.min("rank").alias("first_rank"))
    ranked = ranked.join(firsts, "thread").select(
        "key", "thread", F.col("up").alias("depth"), "parent", (F.col("rank") - F.col("first_rank")).alias("position"))
    source = parsed.select(F.col("key").alias("parent"), F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    n_quotes = F.size(F.array_distinct(F.transform(F.filter("hashes", lambda h: (h["level"] > 0) & (h["rank"] == 0)), lambda h: h["lo"])))
    out = parsed.withColumn("n_quotes", n_quotes).drop("hashes").join(ranked, "key").join(source, "parent", "left")
    return out.select("conv_id", "turn", "role", "text", "reply_conv", "reply_turn", "n_quotes", "thread", "depth", "position")


def _head_links(base: DataFrame) -> DataFrame:
    """key, parent between first messages of conversations: a conversation whose first linked
    message replies to another conversation joins that one's thread."""
    heads = base.select(F.col("key").alias("parent"), F.col("head").alias("parent_head"))
    across = base.filter("parent is not null").select("key", "head", "parent").join(heads, "parent").filter("head != parent_head")
    return across.groupBy("head").agg(F.min(F.struct("key", "parent_head")).alias("m")).select(
        F.col("head").alias("key"), F.col("m.parent_head").alias("parent"))

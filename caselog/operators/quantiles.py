"""Exact quantiles by radix selection: counts of key prefixes, a few bits a pass."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.session import staged

#: Counters of a pass, which is also the most rows that it sends to the driver per wanted rank.
COUNTERS = 1 << 16


def order_key(x: Column) -> Column:
    """The bits of a double as a long that sorts like it; both zeros are 0, NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.abs(x)).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when((x < 0) & ~F.isnan(x), -bits).otherwise(bits)


def of_key(key: int) -> float:
    """The double of an ``order_key``."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def select_keys(rows: DataFrame, ranks, counters: int = COUNTERS) -> list[int] | None:
    """The keys at some ranks (from 0) of ``rows``, a frame of ``key`` (long) and ``n``, how
    often it occurs. ``ranks`` is a function of the number of all; None when there is none.

    Each pass counts the next bits of the keys that share their bits so far with a wanted
    one: with 65,536 counters at most four passes, whatever the data. A prefix that holds one
    key is known at once, so few values take fewer passes.
    """
    bits = max(8, min(16, counters.bit_length() - 1))
    shift, open_, found = 64, {}, {}
    while shift:
        before, shift = shift, max(0, shift - bits)
        some = rows if not open_ else rows.where(F.shiftright("key", before).isin(*open_))
        counted = some.groupBy(F.shiftright("key", shift).alias("p")).agg(
            F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        counted.sort(key=lambda r: r["p"])
        if before == 64:
            total = sum(r["n"] for r in counted)
            if not total:
                return None
            wanted = list(ranks(total))
            open_ = {None: (0, sorted(set(wanted)))}
        next_: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, inside) in open_.items():
            upto, left = below, list(inside)
            for r in counted:
                if prefix is not None and r["p"] >> (before - shift) != prefix:
                    continue
                here = [k for k in left if k < upto + r["n"]]
                if here and r["lo"] == r["hi"]:
                    found.update(dict.fromkeys(here, r["lo"]))
                elif here:
                    next_[r["p"]] = (upto, here)
                left, upto = left[len(here):], upto + r["n"]
                if not left:
                    break
        open_ = next_
        if not open_:
            break
    return [found[k] for k in wanted]


def exact_quantiles(
    df: DataFrame, column: str, qs: Sequence[float], weight: str | None = None, counters: int = COUNTERS
) -> list[float | None]:
    """Interpolated quantiles, as ``percentile_cont``: NULLs ignored, None when there is no
    value. ``weight`` names a column that says how many rows a row stands for. The frame is
    read once a pass, so a costly plan should be stored, or reduced to values and weights."""
    x = F.col(column).cast("double")
    slim = df.where(x.isNotNull()).select(x.alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    rows = slim.select(order_key(F.col("x")).alias("key"), "n")
    ends = lambda total: [f(q * (total - 1)) for q in qs for f in (math.floor, math.ceil)]
    sizes: list[int] = []

    def ranks(total: int) -> list[int]:
        sizes.append(total)
        return ends(total)

    keys = select_keys(rows, ranks, counters)
    if keys is None:
        return [None] * len(qs)
    out = []
    for i, q in enumerate(qs):
        low, high = of_key(keys[2 * i]), of_key(keys[2 * i + 1])
        at = q * (sizes[0] - 1)
        out.append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out


#: Bits of a pass of ``select_per_group``, so the counters of one group in one task.
GROUP_BITS = 15


def select_per_group(rows: DataFrame, group: str, ranks: DataFrame, key_bits: int = 60) -> DataFrame:
    """group, key, below, ties: the ``rank``-th smallest (from 1) non-negative ``key`` of each
    group, how many are smaller, and how often it occurs. ``ranks`` has a row per group.

    Everything stays in tables, so there may be any number of groups; each pass counts the
    next bits of the keys that share a prefix with the one wanted in their group."""
    state = ranks.select(
        F.col(group).alias("_g"), "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("ties"))
    running = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(key_bits - GROUP_BITS, -1, -GROUP_BITS):
        open_ = rows.join(state, rows[group].eqNullSafe(state["_g"])).where(F.shiftright("key", shift + GROUP_BITS) == F.col("prefix"))
        counted = open_.groupBy("_g", "rank", "below", F.shiftright("key", shift).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        upto = counted.withColumn("_upto", F.col("below") + F.sum("_n").over(running))
        state = staged(upto.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_n") < F.col("rank"))).select(
            "_g", "rank", F.col("_p").alias("prefix"), (F.col("_upto") - F.col("_n")).alias("below"), F.col("_n").alias("ties")), "selection")
    return state.select(F.col("_g").alias(group), "rank", F.col("prefix").alias("key"), "below", "ties")


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, exact_values: int = COUNTERS) -> float | None:
    """One quantile of unweighted rows; ``exact_values`` bounds the counters of a pass."""
    return exact_quantiles(df, column, [q], counters=exact_values)[0]

"""Running computations over long keys without putting a whole key into one task.

A window ``PARTITION BY key ORDER BY t`` sends every row of a key to one task.  Here each
key is cut into bounded, ordered *blocks*.  The window runs per (key, block); one summary row
per block is scanned per key and joined back.  The big side is shuffled once, on (key, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_MS = 600_000


@dataclass(frozen=True)
class Scan:
    """One running value. ``kind``: sum, max, last (latest non-null) or next (following non-null)."""

    out: str
    value: Column
    kind: str
    inclusive: bool = True


def time_block(column: str | Column = "start_ms", width: int = BLOCK_MS) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width)).cast("long")


def running(df: DataFrame, keys: list[str], block: Column, order: list[str], scans: list[Scan],
            partitions: int | None = None, keep: str | None = None) -> DataFrame:
    """Append every scan's running value; ``block`` must be non-decreasing in ``order``.

    With ``partitions`` the big side is dealt over that many; ``keep`` names a column that holds the block, so that a grouping
    by keys and block needs no other shuffle.
    """
    src = df.withColumn("__block", block)
    for i, scan in enumerate(scans):
        src = src.withColumn(f"__v{i}", scan.value)
    rank = F.struct(*[F.col(c) for c in order])
    local = W.partitionBy(*keys, "__block").orderBy(*order)
    # following values come from the reversed order: a frame that ends at the last row is evaluated anew for every row
    back = W.partitionBy(*keys, "__block").orderBy(*[F.desc_nulls_last(c) for c in order])
    blocks = W.partitionBy(*keys).orderBy("__block")
    blocks_back = W.partitionBy(*keys).orderBy(F.desc_nulls_last("__block"))
    summaries, out = [], src if partitions is None else src.repartition(partitions, *keys, "__block")
    for i, scan in enumerate(scans):
        v = F.col(f"__v{i}")
        if scan.kind == "next":
            here = F.last(v, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0 if scan.inclusive else -1))
            summary = F.min_by(v, F.when(v.isNotNull(), rank))
        else:
            frame = local.rowsBetween(W.unboundedPreceding, 0 if scan.inclusive else -1)
            if scan.kind == "sum":
                here, summary = F.sum(v).over(frame), F.sum(v)
            elif scan.kind == "max":
                here, summary = F.max(v).over(frame), F.max(v)
            else:
                here = F.last(v, ignorenulls=True).over(frame)
                summary = F.max_by(v, F.when(v.isNotNull(), rank))
        out = out.withColumn(f"__h{i}", here)
        summaries.append(summary.alias(f"__s{i}"))
    carry = src.groupBy(*keys, "__block").agg(*summaries)
    picks = []
    for i, scan in enumerate(scans):
        s = F.col(f"__s{i}")
        before = blocks.rowsBetween(W.unboundedPreceding, -1)
        if scan.kind == "sum":
            c = F.sum(s).over(before)
        elif scan.kind == "max":
            c = F.max(s).over(before)
        elif scan.kind == "last":
            c = F.last(s, ignorenulls=True).over(before)
        else:
            c = F.last(s, ignorenulls=True).over(blocks_back.rowsBetween(W.unboundedPreceding, -1))
        picks.append(c.alias(f"__c{i}"))
    carry = carry.select(*keys, "__block", *picks)
    joined = out.join(carry, [*keys, "__block"], "left")
    for i, scan in enumerate(scans):
        h, c = F.col(f"__h{i}"), F.col(f"__c{i}")
        if scan.kind == "sum":
            value = F.when(h.isNull() & c.isNull(), F.lit(None)).otherwise(
                F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0)))
        elif scan.kind == "max":
            value = F.greatest(h, c)
        else:
            value = F.coalesce(h, c)
        joined = joined.withColumn(scan.out, value)
    drop = [f"__{k}{i}" for i in range(len(scans)) for k in "vhc"]
    joined = joined.drop(*drop)
    return joined.drop("__block") if keep is None else joined.withColumnRenamed("__block", keep)


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[str], out: str = "rn") -> DataFrame:
    """1-based row number per key in ``order``."""
    return running(df, keys, block, order, [Scan(out, F.lit(1).cast("long"), "sum")])

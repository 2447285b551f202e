"""Sharding by sampled splitters: near equal bytes per shard, built-in functions only.

The key of a record is a hash of its text, so equal texts lie together. A size-weighted sample of keys gives the quantile boundaries
of many more ranges than shards; ranges that turn out overfull (one text may make up a third of everything) are divided further by a
hash of the id, and rows equal in id and text that still outweigh a range by their number in a written table. The exact sizes of all pieces are then laid on one line, and each shard takes the pieces whose middle falls into its
part of the line, so shards hold consecutive key ranges of near equal bytes. Slots number the records of a shard without gaps: a
row number inside each piece plus the number of records in the shard's earlier pieces, so no shard is ever one task.

The number of ranges grows with the bytes (``RANGE_BYTES``) and is at least ``RANGES`` per shard; that table is what is broadcast and
scanned in one task (14 million records of 256 MB ranges are 3.5 PB). Sizes are UTF-8 bytes plus 8.

Defined results: a null text has size 8, a null checksum, and forms a group of its own; rows equal in id and text may get either of
their slots; columns named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from confab.llm.texts import fresh
from confab.session import cut

OVERHEAD = 8
RANGES = 64  # ranges per shard, at least
RANGE_BYTES = 256 << 20
SAMPLES = 32  # sampled keys per range
PARTS = 8  # blocks of equal rows per mean range
BUCKETS = 4096  # equal parts of the key space by which a record finds its range


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _key() -> Column:
    return F.xxhash64("text")


def _second() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.lit(1 << 30))


def splitters(slim: DataFrame, total: int, ranges: int) -> list[int]:
    """Range boundaries from a sample in which a record of s bytes is expected s * ranges * SAMPLES / total times."""
    share = F.col("size") * (ranges * SAMPLES / total)
    chance = F.pmod(F.xxhash64("key", "second", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)).cast("int")
    drawn = slim.select("key", F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    at = [k / ranges for k in range(1, ranges)]
    got = drawn.agg(F.percentile_approx("key", at, 20 * ranges).alias("at")).first()["at"]
    return sorted(set(got or []))


def _bucket(key: Column) -> Column:
    return F.shiftright(key, 64 - BUCKETS.bit_length() + 1)


def _range_table(slim: DataFrame, bounds: list[int]) -> DataFrame:
    """(bucket, base, inner): a key's range is ``base`` plus how many ``inner`` boundaries it has reached."""
    rows, width = [], 1 << 64 - BUCKETS.bit_length() + 1
    for b in range(-BUCKETS // 2, BUCKETS // 2):
        lo, hi = bisect_left(bounds, b * width), bisect_right(bounds, (b + 1) * width - 1)
        rows.append((b, lo, bounds[lo:hi]))
    return slim.sparkSession.createDataFrame(rows, "bucket long, base long, inner array<long>")


def _ranged(df: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    keep = df.columns
    own = [fresh(keep, c) for c in ("bucket", "base", "inner")]
    table = table.toDF(*own)
    joined = df.join(F.broadcast(table), _bucket(key) == table[own[0]])  # BUCKETS rows and one number per range
    return joined.select(*[F.col(f"`{c}`") for c in keep], (F.col(own[1]) + F.size(F.filter(own[2], lambda x: x <= key))).alias(name))


def placement(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(range table, heavy, pieces): sizes of all pieces but for the ``heavy`` classes of equal rows, None where there are none."""
    slim = cut(docs.select(size_of(F.col("text")).alias("size"), _key().alias("key"), _second().alias("second")), "shard_keys")
    total = slim.agg(F.sum("size")).first()[0] or 1
    ranges = max(shards * RANGES, -(-total // RANGE_BYTES))
    table = _range_table(slim, splitters(slim, total, ranges))
    ranged = _ranged(slim, table, F.col("key"), "range")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("size"))
    mean = total / ranges
    many = F.when(F.col("size") > 2 * mean, F.ceil(F.col("size") * float(ranges) / total)).otherwise(1).cast("long")
    divided = cut(sums.select("range", many.alias("pieces")), "shard_ranges")
    rows = ranged.join(F.broadcast(divided), "range").withColumn("piece", _piece(F.col("second"), F.col("pieces")))

    def sized(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("range", "pieces", "piece").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "shard_pieces")

    found = sized(rows)
    over = found.where((F.col("size") > 2 * mean) & (F.col("rows") > 1)).select("range", "piece")  # at most half as many as ranges
    classes = rows.join(F.broadcast(over), ["range", "piece"], "left_semi").groupBy("range", "piece", "key", "second").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    width = F.greatest(F.lit(1.0), F.floor(mean / PARTS * F.col("rows") / F.col("size"))).cast("long")
    heavy = cut(classes.where((F.col("size") > mean) & (F.col("rows") > 1)).select("range", "piece", "key", "second", width.alias("width")), "shard_heavy")
    if heavy.isEmpty():
        return table, None, found
    return table, heavy, sized(rows.join(F.broadcast(heavy), ["key", "second"], "left_anti"))  # fewer heavy classes than ranges


def _line(pieces: DataFrame, shards: int) -> DataFrame:
    """``pieces`` (range, piece, key, second, block, size, rows) with the shard in whose part of the line they lie, and their first slot."""
    order = ["range", "piece", F.col("key").asc_nulls_first(), "second", "block"]
    up_to = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(up_to(Window.partitionBy())), F.lit(0))
    total = F.sum("size").over(Window.partitionBy())
    shard = F.least(F.lit(shards - 1), F.floor((before + F.col("size") / 2) * float(shards) / total)).cast("int")
    return pieces.withColumn("shard", shard).withColumn("first", F.coalesce(F.sum("rows").over(up_to(Window.partitionBy("shard"))), F.lit(0)))


def _piece(second: Column, pieces: Column) -> Column:
    return F.shiftright(second * pieces, 30)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with columns ``shard`` and ``slot``."""
    return _sharded(docs, [c for c in docs.columns if c.lower() not in ("shard", "slot")], shards)


def _sharded(docs: DataFrame, keep: list[str], shards: int) -> DataFrame:
    table, heavy, pieces = placement(docs, shards)
    key, second = fresh(docs.columns, "key_of_text"), fresh(docs.columns, "second_key")
    docs = docs.withColumns({key: _key(), second: _second()})
    whole, none = docs, F.lit(None).cast("long")
    line = pieces.select("range", "piece", none.alias("key"), none.alias("second"), none.alias("block"), "size", "rows")
    if heavy is not None:
        on = heavy.toDF(*(names := [fresh(docs.columns, f"heavy_{c}") for c in heavy.columns]))
        same = (F.col(key) == on[names[2]]) & (F.col(second) == on[names[3]])
        whole = docs.join(F.broadcast(on), same, "left_anti")
        uid, size = fresh(docs.columns + names, "row_uid"), fresh(docs.columns + names, "row_size")
        torn = docs.withColumn(size, size_of(F.col("text"))).join(F.broadcast(on), same)
        torn = cut(torn.select(*[F.col(f"`{c}`") for c in keep], size, *names).withColumn(uid, F.monotonically_increasing_id()), "shard_torn")
        block = fresh(torn.columns, "row_block")  # rows are told apart by their written number alone
        torn = torn.withColumn(block, F.floor(F.col(uid) / F.col(names[4])))
        blocks = torn.groupBy(*[F.col(n).alias(c) for n, c in zip(names[:4], heavy.columns)], F.col(block).alias("block")).agg(
            F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
        line = line.unionByName(blocks)
    placed = cut(_line(line, shards), "shard_places")
    places = placed.where("block IS NULL").join(pieces.select("range", "piece", "pieces"), ["range", "piece"]).groupBy("range", "pieces").agg(
        F.map_from_entries(F.collect_list(F.struct("piece", F.struct("shard", "first")))).alias("places"))
    rng = fresh(docs.columns, "key_range")
    rows = _ranged(whole, table, F.col(key), rng)
    own = [fresh(rows.columns, c) for c in ("place_range", "place_pieces", "place_list")]
    places = cut(places.toDF(*own), "shard_lists")
    rows = rows.join(F.broadcast(places), F.col(rng) == F.col(own[0]))  # one row per range
    part, at = fresh(rows.columns, "piece"), fresh(rows.columns, "place")
    rows = rows.withColumn(part, _piece(F.col(second), F.col(own[1]))).withColumn(at, F.col(own[2])[F.col(part)])
    nth = F.row_number().over(Window.partitionBy(rng, part).orderBy(key, "doc_id"))
    kept = [F.col(f"`{c}`") for c in keep]
    rows = rows.select(*kept, F.col(at)["shard"].alias("shard"), (F.col(at)["first"] + nth - 1).alias("slot"))
    if heavy is None:
        return rows
    spot = placed.where("block IS NOT NULL").select("key", "second", "block", "shard", "first")
    spot = spot.toDF(*(own := [fresh(torn.columns, f"spot_{c}") for c in spot.columns]))
    torn = torn.join(spot, (F.col(names[2]) == F.col(own[0])) & (F.col(names[3]) == F.col(own[1])) & (F.col(block) == F.col(own[2])))
    nth = F.row_number().over(Window.partitionBy(own[0], own[1], own[2]).orderBy(uid))
    return rows.unionByName(torn.select(*kept, F.col(own[3]).alias("shard"), (F.col(own[4]) + nth - 1).alias("slot")))


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Digest of ``shard``: sizes, checksums and places."""
    slim = docs.select("doc_id", "text", size_of(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"))
    return _sharded(slim, ["doc_id", "size", "text_crc32"], shards).select(  # the text itself is not moved
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

A vector is projected to ``DIMENSIONS`` Gaussian directions; the squared projected distance of a pair over its squared distance is
chi-square distributed with that many degrees of freedom. So a search goes through projected neighbours in order of distance, computes
true distances, and stops when a pair as close as the present last neighbour would have been met with probability ``SURE``. Every
unseen true neighbour is missed with probability below 1 - SURE; no other limit ends a search.

The kd-tree has two levels. Its upper part comes from a bounded sample (``SAMPLE`` vectors) and cuts the projected space into cells;
every vector is indexed, and a cell above ``CELL_ROWS`` vectors is divided by a hash into shards. A shard is one written row: its
vectors and their projections in leaf order and the boxes of its leaves. Leaves are opened by the gap to their box, and a point is
verified only when no unopened leaf can hold a nearer projection, so points come in projected order whatever leaf they lie in. A query
searches its own shard first; the distance found there decides which cells it visits at all, and goes on as the bound there. A shard
meets its visitors in chunks of ``CHUNK`` queries.

Equal vectors are indexed once with their smallest ids (one more than are asked for), which is all that a result can hold of them, so
a vector that makes up a third of the table is one point.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no part; only vectors of one width
are compared; rows that repeat an id with an equal vector count once, one that repeats an id with another vector is a candidate of its
own; rows with a null id take no part; fewer candidates than asked for are all returned; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from confab.session import cut

DIMENSIONS = 12  # even, for the closed form below
SURE = 0.98
SAMPLE = 20_000
CELL_ROWS = 16_384
LEAF_ROWS = 48
VERIFIED = 32  # projected neighbours verified before the first test; later groups double up to 16 times as many
CHUNK = 4_096
SEED = 20_231


def chi_square_quantile(p: float, degrees: int) -> float:
    """x at which the chi-square distribution (even degrees) reaches p."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))

    lo, hi = 0.0, 40.0 * degrees
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, DIMENSIONS))


def matrix(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def halves(points: np.ndarray, most: int) -> tuple[list, list[np.ndarray]]:
    """kd-tree by medians of the widest side: (splits as nested (side, value, left, right) or leaf number, leaf rows)."""
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray):
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        if len(rows) <= most or not spread.max() > 0:
            leaves.append(rows)
            return len(leaves) - 1
        side = int(spread.argmax())
        half = len(rows) // 2
        order = np.argpartition(own[:, side], half)
        value = float(own[order[half], side])
        left = own[:, side] < value
        if not left.any():  # the median is the least value
            left = own[:, side] <= value
            value = math.nextafter(value, math.inf)
        return side, value, grow(rows[left]), grow(rows[~left])

    return grow(np.arange(len(points))), leaves


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def go(node, rows):
        if isinstance(node, tuple):
            left = points[rows, node[0]] < node[1]
            go(node[2], rows[left])
            go(node[3], rows[~left])
        else:
            out[rows] = node

    go(tree, np.arange(len(points)))
    return out


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Leaves:
    """A shard: points and their projections in leaf order with the boxes of the leaves in the projected space."""

    def __init__(self, ids, points, flat, starts, low, high):
        self.ids, self.points, self.flat, self.starts, self.low, self.high = ids, points, flat, starts, low, high
        self.verified = 0  # true distances computed so far

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> "Leaves":
        flat = points @ directions(points.shape[1])
        _, leaves = halves(flat, LEAF_ROWS)
        order = np.concatenate(leaves)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int64)
        low, high = (np.array([f(flat[x], axis=0) for x in leaves]) for f in (np.min, np.max))
        return cls(ids[order], points[order], flat[order], starts, low, high)

    def nearest(self, query: np.ndarray, flat: np.ndarray, most: int, bound: float, stop: float):
        """(ids, squared distances) of at most ``most`` verified neighbours. ``bound``: a squared distance that is known to hold so many."""
        gap = np.maximum(0, np.maximum(self.low - flat, flat - self.high))
        gap = (gap * gap).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        waiting, reach = np.zeros(0, np.int64), np.zeros(0)  # points of opened leaves, and their projected distances
        at, step = 0, 4
        while True:
            take = order[at:at + step]
            take = take[gap[take] <= stop * bound]
            at, step = at + len(take), min(2 * step, 64)
            if len(take):
                rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in take])
                diff = self.flat[rows] - flat
                waiting, reach = np.concatenate([waiting, rows]), np.concatenate([reach, np.einsum("ij,ij->i", diff, diff)])
            horizon = gap[order[at]] if at < len(order) else np.inf
            ready = np.flatnonzero(reach <= horizon)
            ready = ready[np.argsort(reach[ready], kind="stable")]
            done, group = 0, VERIFIED
            while done < len(ready) and reach[ready[done]] <= stop * bound:
                some = ready[done:done + group]
                some = waiting[some[reach[some] <= stop * bound]]
                diff = self.points[some] - query
                best = np.concatenate([best, (diff * diff).sum(axis=1)])
                best_id = np.concatenate([best_id, self.ids[some]])
                by = np.lexsort((best_id, best))[:most]
                best, best_id = best[by], best_id[by]
                if len(best) == most:
                    bound = min(bound, best[-1])
                self.verified += len(some)
                done, group = done + len(some), min(2 * group, 16 * VERIFIED)
            if not len(take):  # no unopened leaf, and no opened point, is near enough
                return best_id, best
            left = (reach > horizon) & (reach <= stop * bound)
            waiting, reach = waiting[left], reach[left]


SHARD = "width int, cell long, part long, ids binary, points binary, flat binary, starts binary, low binary, high binary"


def _shard_row(key, table):
    width, cell, part = (k.as_py() for k in key)
    s = Leaves.build(table.column("id").to_numpy(), matrix(table.column("vector"), width))
    row = {"width": pa.array([width], pa.int32()), "cell": [cell], "part": [part]}
    row |= {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in
            (("ids", s.ids), ("points", s.points), ("flat", s.flat), ("starts", s.starts), ("low", s.low), ("high", s.high))}
    return pa.table(row)


def _open(shard: pa.Table) -> Leaves:
    raw = lambda c, kind: np.frombuffer(shard.column(c)[0].as_py(), kind)
    ids, width = raw("ids", np.int64), shard.column("width")[0].as_py()
    return Leaves(ids, raw("points", np.float64).reshape(-1, width), raw("flat", np.float64).reshape(-1, DIMENSIONS), raw("starts", np.int64), raw("low", np.float64).reshape(-1, DIMENSIONS),
                  raw("high", np.float64).reshape(-1, DIMENSIONS))


FOUND = "query long, id long, d2 double"


def _visit(most: int, stop: float):
    def run(key, visitors, shard):
        query, found, d2 = [], [], []
        if visitors.num_rows and shard.num_rows:
            s = _open(shard)
            points = matrix(visitors.column("vector"), s.points.shape[1])
            flat = points @ directions(points.shape[1])
            for k, (q, bound) in enumerate(zip(visitors.column("query").to_pylist(), visitors.column("bound").to_pylist())):
                i, d = s.nearest(points[k], flat[k], most, bound, stop)
                query.append(np.full(len(i), q)), found.append(i), d2.append(d)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query": join(query, pa.int64()), "id": join(found, pa.int64()), "d2": join(d2, pa.float64())})

    return run


class Index:
    """Classes of equal vectors, the cells' trees by width, the written shards and the table of cells."""

    def __init__(self, rows: DataFrame, classes: DataFrame, trees: dict, placed: DataFrame, shards: DataFrame):
        self.rows, self.classes, self.trees, self.placed, self.shards = rows, classes, trees, placed, shards


def build(vectors: DataFrame, most: int, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    """Index all usable rows of ``vectors`` for searches of up to ``most`` neighbours."""
    spark = vectors.sparkSession
    vector = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("hash", F.xxhash64("vector"))
    nth = F.dense_rank().over(Window.partitionBy("hash", "vector").orderBy("id"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    classes = kept.groupBy("hash", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = classes.select(F.col("ids")[0].alias("id"), "ids", "vector", "hash", F.size("vector").alias("width"))
    # a class is named by its smallest id; an id given to several vectors would name several classes
    number = F.row_number().over(Window.partitionBy("id").orderBy("hash"))
    classes = cut(classes.withColumn("nth", number).withColumn("id", F.when(F.col("nth") == 1, F.col("id")).otherwise(F.xxhash64("id", "hash"))).drop("nth"), "ann_classes")
    counts = {r["width"]: r["count"] for r in classes.groupBy("width").count().collect()}
    trees = {}
    for width, n in counts.items():
        order = F.xxhash64("id", F.lit(SEED))
        some = classes.where((F.col("width") == width) & (F.pmod(order, F.lit(1 << 20)) * n <= SAMPLE * (1 << 20))).select("vector").limit(2 * SAMPLE)
        points = matrix(pa.array(some.toPandas()["vector"].tolist(), pa.list_(pa.float64())), width) @ directions(width)
        cells = max(1, min(-(-n // CELL_ROWS), max(1, len(points) // 8)))
        trees[width] = halves(points, max(1, -(-len(points) // cells)))[0]
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("long")
    def cell(width: pa.Array, vector: pa.Array) -> pa.Array:
        widths, out = width.to_numpy(), np.zeros(len(width), np.int64)
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            out[at] = cell_of(shared.value[int(w)], matrix(vector.take(pa.array(at)), int(w)) @ directions(int(w)))
        return pa.array(out)

    celled = cut(classes.select("id", "width", "vector", cell("width", "vector").alias("cell")), "ann_cells")
    parts = celled.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("long").alias("parts"))
    placed = celled.join(F.broadcast(parts), ["width", "cell"]).withColumn(  # cells come from the bounded sample
        "part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")))
    shards = cut(placed.select("id", "vector", "width", "cell", "part").groupBy("width", "cell", "part").applyInArrow(_shard_row, SHARD), "ann_shards")
    return Index(rows, classes, trees, placed, shards)


def _meet(visits: DataFrame, shards: DataFrame, run) -> DataFrame:
    """Search shards for visits (width, cell, part, query, vector, bound), a shard once for every chunk of its visitors."""
    visits = cut(visits, "ann_visits")
    chunks = visits.groupBy("width", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    chunks = cut(chunks, "ann_chunks")
    left = visits.join(chunks, ["width", "cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks"))).drop("chunks")
    numbers = chunks.select("width", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    right = shards.join(numbers, ["width", "cell", "part"])
    key = ["width", "cell", "part", "chunk"]
    return cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND), "ann_found")


def search(index: Index, queries: Column, most: int, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``most`` nearest others of every indexed row for which ``queries`` (over ``id``) holds."""
    stop = chi_square_quantile(sure, DIMENSIONS)
    spark = index.rows.sparkSession
    run = _visit(most + 1, stop)
    asked = index.rows.where(queries).select("hash", "vector", F.col("id").alias("query_id")).distinct()
    asked = cut(asked.join(index.classes.select("hash", "vector", F.col("id").alias("query")), ["hash", "vector"]).select("query_id", "query"), "ann_queries")
    points = index.placed.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select(
        "width", "cell", "part", F.col("id").alias("query"), "vector")
    points = cut(points, "ann_points")
    home = _meet(points.withColumn("bound", F.lit(float("inf"))), index.shards, run)

    bounds = home.groupBy("query").agg(F.when(F.count(F.lit(1)) > most, F.max("d2")).otherwise(float("inf")).alias("bound"))
    boxes: dict[int, list] = {}

    def box(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                low, high = (np.frombuffer(batch.column(c)[k].as_py(), np.float64).reshape(-1, DIMENSIONS) for c in ("low", "high"))
                yield pa.RecordBatch.from_arrays([batch.column("width").slice(k, 1), batch.column("cell").slice(k, 1), batch.column("part").slice(k, 1),
                                                  pa.array([low.min(axis=0).tolist()]), pa.array([high.max(axis=0).tolist()])], ["width", "cell", "part", "low", "high"])

    sides = index.shards.select("width", "cell", "part", "low", "high").mapInArrow(box, "width int, cell long, part long, low array<double>, high array<double>")
    sides = cut(sides, "ann_boxes")
    cells = sides.groupBy("width", "cell").agg(
        F.max("part").alias("last"), *[f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(DIMENSIONS)])
    for r in cells.collect():  # as many as the sample's tree has leaves
        boxes.setdefault(r["width"], []).append((r["cell"], r["last"], [r[f"low{k}"] for k in range(DIMENSIONS)], [r[f"high{k}"] for k in range(DIMENSIONS)]))
    boxes_shared = spark.sparkContext.broadcast({w: tuple(np.array(x) for x in zip(*sorted(b))) for w, b in boxes.items()})

    @F.arrow_udf("array<struct<cell:bigint,last:bigint>>")
    def near(width: pa.Array, vector: pa.Array, bound: pa.Array) -> pa.Array:
        out = []
        for w, v, b in zip(width.to_pylist(), vector, bound.to_pylist()):
            cell, last, low, high = boxes_shared.value[w]
            flat = np.asarray(v.values) @ directions(w)
            gap = np.maximum(0, np.maximum(low - flat, flat - high))
            hit = np.flatnonzero((gap * gap).sum(axis=1) <= stop * b)
            out.append([{"cell": int(cell[i]), "last": int(last[i])} for i in hit])
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("last", pa.int64())])))

    far = points.select("width", F.col("cell").alias("own_cell"), F.col("part").alias("own_part"), "query", "vector").join(bounds, "query")
    far = far.withColumn("c", F.explode(near("width", "vector", "bound"))).select(
        "width", "own_cell", "own_part", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.last"))).alias("part"), "query", "vector", "bound")
    far = far.where((F.col("cell") != F.col("own_cell")) | (F.col("part") != F.col("own_part"))).drop("own_cell", "own_part")
    found = home.union(_meet(far, index.shards, run))

    by_class = Window.partitionBy("query").orderBy("d2", "id")
    found = found.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= most + 1)
    ids = found.join(index.classes.select("id", "ids"), "id").select("query", "d2", F.explode("ids").alias("vec_id")).distinct()
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("d2", "vec_id"))).where(F.col("nth") <= most + 1)
    pairs = asked.join(ids, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", F.sqrt("d2").alias("score"))


def neighbours(vectors: DataFrame, every: int = 100, most: int = 10) -> DataFrame:
    """Nearest others of the rows whose vec_id is divisible by ``every``, among all rows."""
    return search(build(vectors, most), F.col("id") % every == 0, most)

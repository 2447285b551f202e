"""Set similarity self-join on word shingles, size-aware: light sets by their subsets, heavy sets by inverted lists.

Each text becomes the set of its distinct shingles of four words (64-bit hashes; equality of shingles is equality of hashes). Two
sets are linked when ``100 * intersection >= percent * union``. Equal sets are one class and take part once.

* **Light sets** enumerate their subsets of every size that a partner may share with them (from ceil(percent * n) to n elements);
  two light sets are linked only if they share such a subset.
* **Heavy sets** meet through inverted lists of their prefixes in one global order (rarest first), with the size and position
  bounds of prefix filtering. A light set that is large enough to have a heavy partner appears in these lists as well.
* The **boundary** is the largest size at which enumerating subsets costs no more rows than scanning lists; the mean length of a
  list is measured on a sample of the texts, and a list longer than its heads costs its heads. Any boundary, and any global order,
  gives the same links.

Shingles that are frequent in the sample go to the end of the order (at most ``FREQUENT`` of them are named; the order only moves
cost). A list is not expanded into all its pairs: for ``ROUNDS`` rounds every member outside the list's largest component is held against
``MAIN_HEADS`` members of that component and ``OTHER_HEADS`` outside it, and links become components, whole ones after every round; only members of
different components of one list are compared after that, all of them but the largest component's among themselves. Every other head is drawn by a hash of shingle,
id and round, the others by the earliest position of the shingle first: such a member has few rare shingles of its own, so of a group of near copies it is the one
most others are similar to. So a group of copies costs about as many pairs as it has members, and no link between components is lost; members of
a group that are linked to nothing are still held against the whole group. Candidate pairs pass a count of their elements in ``BINS`` bins (the sum of the smaller counts
is at least the intersection) before their whole sets are moved and intersected.

A class of equal sets is a node, named by the hash of one of its texts, so rows that share an id but not a text stay apart while
links are searched. ``linked_pairs`` gives verified links; pairs that already share a component are not compared, so these
connect every component but are not all links within it.

Defined results: null or wordless texts have an empty set and are their own component; fewer words than a shingle count as one
shingle; rows with a null id take part, and a component of such rows only has a null id; in ``jaccard_components`` rows that share an
id are one document, reached by the links of any of its texts, while ``keep_one`` looks at each row for itself; other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from confab.llm.components import components
from confab.llm.texts import byte_table, flat, fresh, giving_back, mix, slices, word_hashes
from confab.session import cut

WORDS = 4
PERCENT = 85
FREQUENT = 1 << 17  # shingles named in the order hint: 2 MB for every task, whatever the input
SAMPLE = 16  # one text in so many measures frequencies
LIGHT_MOST = 24  # the boundary is never above this size
ROUNDS = 2
MAIN_HEADS, OTHER_HEADS = 8, 3
BINS = 128
BROADCAST_IDS = 1 << 21  # at most 16 MB of ids go to every task
NO_ID = 1 << 62  # ids from here on stand for rows without one

_FACTORS = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def required(n: int, percent: int) -> int:
    """Least intersection of a set of n elements with any similar set."""
    return -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(n - required(n, percent) + 1))


def boundary(mean_list: float, percent: int) -> int:
    """Largest size whose subsets are no more rows than its prefix meets in lists: a list is met through its heads, however long it is."""
    best, mean_list = 0, min(mean_list, MAIN_HEADS + OTHER_HEADS)
    for n in range(1, LIGHT_MOST + 1):
        if subset_count(n, percent) <= (n - required(n, percent) + 1) * max(1.0, mean_list):
            best = n
        else:
            break
    return best


def shingles(arr, words: int = WORDS):
    """Sorted distinct shingle hashes of every text."""
    table = byte_table("black")
    for part in slices(arr):
        off, data = flat(part)
        h, counts = word_hashes(off, data, table)
        whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            whole += h[k:k + len(whole)] * _FACTORS[k]
        whole = mix(whole)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
            if b - a >= words:
                yield np.unique(whole[a:b - words + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _FACTORS[:b - a]).sum() + _FACTORS[words + b - a]], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a, b = mix(u + _FACTORS[20]), mix(u * _FACTORS[21])
    return int(a.sum().view(np.int64)), int(b.sum().view(np.int64))


class Order:
    """Global order of shingles: by hash, the named frequent ones last (the more frequent, the later)."""

    def __init__(self, frequent: np.ndarray):
        """``frequent``: hashes, the least frequent first."""
        self.hashes = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[frequent >> np.uint64(42)] = True

    def first(self, u: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` elements of a sorted set in this order."""
        if not len(self.hashes):
            return u[:most]
        doubt = np.flatnonzero(self.maybe[u >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.hashes, u[doubt]), len(self.hashes) - 1)
        hit = self.hashes[at] == u[doubt]
        late, at = doubt[hit], at[hit]
        if not len(late):
            return u[:most]
        early = np.delete(u, late)
        return early[:most] if len(early) >= most else np.concatenate([early, u[late][np.argsort(self.rank[at])]])[:most]


def subset_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """Hash of every subset that a similar set may share."""
    n, each = len(u), mix(u ^ _FACTORS[22])
    total = each.sum()
    keys = []
    for d in range(n - required(n, percent) + 1):
        gone = np.array([each[list(c)].sum() for c in combinations(range(n), d)], np.uint64) if d else np.zeros(1, np.uint64)
        keys.append(mix(total - gone + _FACTORS[23:24] * np.uint64(n - d)))
    return np.concatenate(keys)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("id"), F.xxhash64("text").alias("node"), "text")


def _lists(arrays, kind=pa.int64()):
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64), kind))


def measured(rows: DataFrame, words: int, percent: int) -> tuple[np.ndarray, int]:
    """(frequent shingles, boundary) from one text in SAMPLE; both steer cost only."""
    spark = rows.sparkSession

    def tokens(batches):
        for batch in batches:
            sets = list(shingles(batch.column("text"), words))
            signs = [signature(u) for u in sets]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), _lists(sets)], ["hi", "lo", "set"])

    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SAMPLE)) == 0).select("text")
    sets = sample.mapInArrow(giving_back(tokens), "hi long, lo long, set array<long>").dropDuplicates(["hi", "lo"])
    counted = cut(sets.select(F.explode("set").alias("token"), (F.size("set") <= LIGHT_MOST).cast("long").alias("light"))
                  .groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("light").alias("light")).where("n > 1 or light > 0"), "shingle_counts")
    light = counted.agg(F.sum("light").alias("all"), F.sum(F.col("light") * (SAMPLE * (F.col("n") - 1) + 1)).alias("entries")).first()
    frequent = counted.where("n >= 2").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    return frequent.view(np.uint64)[::-1].copy(), boundary((light["entries"] or 0) / max(1, light["all"] or 0), percent)


def document_sets(rows: DataFrame, words: int, percent: int, frequent: np.ndarray, light: int) -> DataFrame:
    """(id, node, n, hi, lo, prefix, subsets, bins) of every row: set size, signature, prefix in the global order, subset hashes,
    elements per bin (NULL if one has more than a byte holds)."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        order = Order(shared.value)
        for batch in batches:
            n, hi, lo, prefix, subsets, bins = [], [], [], [], [], []
            none = np.zeros(0, np.uint64)
            for u in shingles(batch.column("text"), words):
                size = len(u)
                a, b = signature(u)
                n.append(size), hi.append(a), lo.append(b)
                listed = size > light or 100 * size >= percent * (light + 1)
                prefix.append(order.first(u, size - required(size, percent) + 1) if size and listed else none)
                subsets.append(subset_keys(u, percent) if 0 < size <= light else none)
                counts = np.bincount((u >> np.uint64(57)).astype(np.int64), minlength=BINS)
                bins.append(counts.astype(np.int8) if counts.max() < 128 else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                              _lists(prefix), _lists(subsets), pa.array(bins, pa.list_(pa.int8()))],
                                             ["id", "node", "n", "hi", "lo", "prefix", "subsets", "bins"])

    return rows.mapInArrow(giving_back(run), "id long, node long, n long, hi long, lo long, prefix array<long>, subsets array<long>, bins array<byte>")


def _similar(small, n1, n2, percent: int):
    """Whether an intersection reaches the threshold for sets of these sizes."""
    return 100 * small >= percent * (n1 + n2 - small)


def _small(table: DataFrame) -> DataFrame:
    """A written table of one or two longs a row, sent to every task if its counted rows allow."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column of either side as ``x`` and ``y``."""
    left, right = table.select(F.col("node").alias("a"), F.col(column).alias("x")), table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(right, "b").join(left, "a")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones among candidate pairs (a, b), by the whole sets of the texts that name them."""

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(list(shingles(batch.column("text"), words)))], ["node", "set"])

    bins = cut(classes.select("node", "id", F.struct("n", "bins").alias("bins")).join(_small(cut(_ends(pairs), "pair_nodes")), "node", "left_semi"), "pair_bins")
    most = F.aggregate(F.zip_with("x.bins", "y.bins", lambda p, q: F.least(p, q).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    close = F.coalesce(_similar(most, F.col("x.n"), F.col("y.n"), percent), F.lit(True))
    pairs = cut(_both(pairs, bins, "bins").where(close).select("a", "b"), "close_pairs")
    named = cut(bins.select("id", "node").join(_ends(pairs), "node", "left_semi"), "pair_rows")
    texts = rows.join(_small(named), ["id", "node"], "left_semi")
    sets = texts.mapInArrow(giving_back(whole), "node long, set array<long>").dropDuplicates(["node"])  # not written: both sides read one shuffle
    inside = F.size(F.array_intersect("x", "y"))
    return _both(pairs, sets, "set").where(_similar(inside, F.size("x"), F.size("y"), percent)).select("a", "b")


def linked_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): sets (id, node, n, hi, lo, ...) of every row, classes (hi, lo, id, node, ...) of equal sets, links (a, b) between nodes."""
    rows = _rows(docs)
    frequent, light = measured(rows, words, percent)
    sets = cut(document_sets(rows, words, percent, frequent, light), "shingle_sets")
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(
        F.min(F.struct("id", "node")).alias("first"), F.first("n").alias("n"), F.min_by(F.struct("prefix", "subsets", "bins"), "id").alias("lists"))
    classes = cut(classes.select("hi", "lo", "first.*", "n", "lists.*"), "shingle_classes")

    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).union(
        classes.select("node", "n", F.lit(-1), F.explode("subsets")))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = cut(entries.join(shared, "token").select("token", "node", "n", "pos"), "list_entries")

    def near(n1, p1, n2, p2):
        bound = F.least(n1 - F.greatest(p1, F.lit(0)), n2 - F.greatest(p2, F.lit(0)))
        return _similar(F.least(n1, n2), n1, n2, percent) & _similar(bound, n1, n2, percent)

    # members of one list that are still apart; ``main`` is the largest component among them
    def apart(found: DataFrame | None, label: str) -> DataFrame:
        if found is None:
            return entries.withColumn("component", F.col("node")).withColumn("main", F.lit(None).cast("long"))
        labelled = entries.join(found, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
        split = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(
            F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        return cut(labelled.join(split.select("token", "main"), "token"), label)

    def unseen(pairs: DataFrame, seen: DataFrame | None, label: str) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return cut(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), label)

    seen = links = found = None
    for turn in range(ROUNDS):
        here = apart(found, "apart")
        member, outside = F.struct("node", "n", "pos", "component"), F.coalesce(F.col("component") != F.col("main"), F.lit(True))
        place = lambda k: F.struct(F.lit(0) if k % 2 else F.col("pos"), F.xxhash64("token", "node", F.lit(f"{turn} {k}")))
        drawn = [F.min_by(F.when(where, member), F.when(where, place(k))).alias(f"h{k}") for k, where in enumerate([~outside] * (MAIN_HEADS if turn else 0) + [outside] * OTHER_HEADS)]
        heads = here.groupBy("token").agg(*drawn).select("token", F.explode(F.array([f"h{k}" for k in range(len(drawn))])).alias("head"))
        met = here.where(outside).join(heads, "token").where(
            (F.col("component") != F.col("head.component")) & near(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
        pairs = unseen(met.select(F.col("head.node").alias("a"), F.col("node").alias("b")), seen, "head_pairs")
        more = cut(_verified(pairs, classes, rows, words, percent), "head_links")
        seen, links = (pairs, more) if seen is None else (seen.union(pairs), links.union(more))
        found = cut(components(links.toDF("src", "dst")), "head_components")

    left = apart(found, "still_apart")
    one, other = left.where("component <> main").alias("x"), left.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    rest = one.join(other, (x("token") == y("token")) & (x("component") != y("component"))
                    & ((y("component") == y("main")) | (x("component") < y("component"))) & near(x("n"), x("pos"), y("n"), y("pos")))
    rest = unseen(rest.select(x("node").alias("a"), y("node").alias("b")), seen, "other_pairs")
    if rest.isEmpty():
        return sets, classes, links
    return sets, classes, cut(links.union(_verified(rest, classes, rows, words, percent)), "set_links")


def _labels(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hi, lo, component, id) of every class: its component's smallest node, and the smallest id in the component."""
    found = classes.select("hi", "lo", "node", "id").join(components(edges.toDF("src", "dst")), "node", "left")
    found = cut(found.select("hi", "lo", "id", F.coalesce("component", "node").alias("component")), "class_components")
    least = found.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "least")
    return found.join(least, "component", "left").select("hi", "lo", "component", F.coalesce("least", "id").alias("id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row."""
    sets, classes, links = linked_pairs(docs, words, percent)
    solid = sets.where("n > 0")
    # the texts of one id are one document: its other classes are linked to its smallest
    signed = F.struct("hi", "lo")
    spread = solid.groupBy("id").agg(F.min(signed).alias("low"), F.max(signed).alias("high")).where("low <> high").select("id", "low")
    same = solid.join(spread, "id").where(signed != F.col("low")).select("hi", "lo", "low").distinct()
    same = cut(same.select("hi", "lo", F.col("low.hi").alias("low_hi"), F.col("low.lo").alias("low_lo")), "texts_of_one_id")
    if not same.isEmpty():
        at = classes.select("hi", "lo", "node")
        links = links.union(same.join(at.toDF("low_hi", "low_lo", "src"), ["low_hi", "low_lo"]).join(at, ["hi", "lo"]).select("src", "node"))
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    named = _labels(classes, links).select("hi", "lo", F.col("id").alias("component"))
    return sets.select("id", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select(
        real("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, real("component")), real("id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the smallest id (rows without one last), then the smallest text hash. Rows without words stay.

    Rows are looked at one by one, so a row goes only if it is similar to (or chained to) the row that stays, whatever ids they have.
    Of rows equal in id and text, the one with the smallest hash over all columns stays, so reruns agree.
    """
    sets, classes, links = linked_pairs(docs, words, percent)
    rows = sets.where("n > 0").select("id", "node", "hi", "lo").join(_labels(classes, links).select("hi", "lo", "component"), ["hi", "lo"])
    rows = cut(rows.select("id", "node", "component"), "row_components")
    best = rows.groupBy("component").agg(F.min(F.struct("id", "node")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = cut(best.select("component", "best.*"), "kept_rows")
    lost = rows.join(best.select("component", F.col("id").alias("best_id"), F.col("node").alias("best_node")), "component").where(
        "id <> best_id or node <> best_node").select("id", "node").distinct()
    lost = cut(lost, "lost_rows")
    own, key = fresh(docs.columns, "row_id"), fresh(docs.columns, "row_text")
    named = docs.withColumn(own, _id()).withColumn(key, F.xxhash64("text"))
    kept = named.join(_small(lost.toDF(own, key)), [own, key], "left_anti").select(named.columns)
    often = rows.join(best, ["component", "id", "node"], "left_semi").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = cut(often.select("id", "node").toDF(own, key), "repeated_rows")
    if often.isEmpty():
        return kept.select(docs.columns)
    few = _small(often)
    one = kept.join(few, [own, key], "left_semi").groupBy(own, key).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))).alias(own + "_row"))
    return kept.join(few, [own, key], "left_anti").select(docs.columns).union(one.select(f"{own}_row.*"))

"""Exact substring dedup of words: suffix automata of reference shards, matching statistics, removal of maximal spans.

A window is ``window`` consecutive words of one text. A window that starts at another place as well, in any text, is repeated; every word
that a repeated window covers is removed, at all its places.

One automaton over everything cannot be sent to every task, and sending all shards to all texts would be quadratic. So texts are cut in
such a way that all places of a window meet in one shard:

* **Pieces.** Every window chooses an anchor: its word n-gram with the least hash (the leftmost such), n-grams that are frequent in a sample last.
  Neighbouring windows with one anchor form a piece of at most ``2 * window - n`` words and some. Equal windows choose equal anchors,
  so a window can only be repeated if its anchor is, and pieces of one anchor go to one shard. Putting frequent n-grams last keeps the
  surroundings of a common passage out of its anchors' pieces, which is what makes those equal. The sample and the named n-grams
  (at most ``FREQUENT``) steer cost only.
* **Reference shards.** Of the pieces whose anchor occurs twice or more, each different one goes to its anchor's shard once, with its number of places.
  A shard holds about ``SHARD_WORDS`` words, and its suffix automaton counts the places of every substring.
* **Matching statistics.** Every piece is streamed through its shard's automaton; at each word the match is cut back to ``window`` words, and the state tells
  how many places that window has. Repeated windows become spans of the piece, the spans return to all places of the piece, and
  the union of a text's spans is removed.

An anchor with more than ``CROWDED`` different pieces is not given to one shard: the windows of its pieces are counted one by one, which is the same
answer without an automaton.

Words and pieces are known by 64-bit hashes (a piece by those of its anchor and its content).

Defined results: null and wordless texts have no words and nothing is removed; texts with fewer words than a window keep all; repeated rows
are separate places, so a repeated text of a window or more loses everything, in every row; null ids take part like others; other
columns are not looked at; ``remove_repeated`` leaves texts without a repeated window unchanged and joins the words that stay in the
others by one space; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from confab.llm.texts import black_words, byte_table, flat, fresh, giving_back, joined_digests, mix, slices, word_hashes
from confab.session import cut

WINDOW = 35
GRAM = 8  # words of an anchor
SAMPLE = 16  # one text in so many measures frequencies
FREQUENT = 1 << 17  # n-grams named as frequent: 1 MB for every task, whatever the input
SHARD_WORDS = 40_000
PLACE = 1 << 16  # more than the windows of any piece
BROADCAST_TEXTS = 1 << 19  # texts, of two numbers each, that may be named to every task
CROWDED = 512  # different pieces of one anchor that meet in one automaton

_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def hashed_words(arr) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words up to the start of every text)."""
    return word_hashes(*flat(arr), _TABLE)


_TABLE = byte_table("black", fold=False)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A 63-bit hash of every ``size`` consecutive words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out += h[k:k + len(out)] * _FACTORS[k]
    return mix(out) >> np.uint64(1)


class Frequent:
    """Moves named n-grams behind all others."""

    def __init__(self, named: np.ndarray):
        self.named = np.sort(named)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(named >> np.uint64(43)).astype(np.int64)] = True

    def order(self, v: np.ndarray) -> np.ndarray:
        if not len(self.named):
            return v
        doubt = np.flatnonzero(self.maybe[(v >> np.uint64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.named, v[doubt]), len(self.named) - 1)
        v = v.copy()
        v[doubt[self.named[at] == v[doubt]]] |= np.uint64(1 << 63)
        return v


def leftmost_least(v: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of every ``w`` consecutive ones."""
    at, width = np.arange(len(v)), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[:-step], at[step:]
        at, width = np.where(v[left] <= v[right], left, right), width + step
    return at


def pieces(h: np.ndarray, first: np.ndarray, window: int, frequent: Frequent):
    """(text, start in the text, number of windows, anchor, content) of every piece, in order."""
    none = np.zeros(0, np.int64)
    gram = min(GRAM, window)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    v = grams(h, gram)
    chosen = leftmost_least(frequent.order(v), window - gram + 1)
    counts = np.diff(first)
    able = np.maximum(counts - window + 1, 0)
    begins = np.flatnonzero(able)
    start = np.repeat(first[begins] - np.cumsum(able[begins]) + able[begins], able[begins]) + np.arange(able.sum())  # first words of all windows
    text = np.repeat(begins, able[begins])
    chosen = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(start)))
    a = start[head]
    b = a + many + window - 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _BACK)]), dtype=np.uint64)
    running = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
    content = mix((running[b] - running[a]) * back[a] + many.astype(np.uint64) * _FACTORS[40])
    return text[head], a - first[text[head]], many, v[chosen[head]], content


def frequent_grams(docs: DataFrame, window: int) -> np.ndarray:
    """The most frequent n-grams of a sample of the different texts; they steer cost only."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                h, first = hashed_words(part)
                v = grams(h, min(GRAM, window))
                inside = np.repeat(first[1:], np.diff(first))[:len(v)] - np.arange(len(v)) >= min(GRAM, window)
                yield pa.RecordBatch.from_arrays([pa.array(v[inside].view(np.int64))], ["gram"])

    sample = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = sample.mapInArrow(giving_back(run), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return counted.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)


def text_pieces(rows: DataFrame, window: int, named: np.ndarray) -> DataFrame:
    """(doc_id, high, pieces) of every row of (doc_id, high, text); pieces are structs (anchor, content, place), a place is start * PLACE + windows."""
    shared = rows.sparkSession.sparkContext.broadcast(named)

    def run(batches):
        frequent = Frequent(shared.value)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                h, first = hashed_words(part)
                text, start, many, anchor, content = pieces(h, first, window, frequent)
                off = np.searchsorted(text, np.arange(len(part) + 1))
                values = pa.StructArray.from_arrays([pa.array(v) for v in (anchor.view(np.int64), content.view(np.int64), start * PLACE + many)], ["anchor", "content", "place"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in ("doc_id", "high")), pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)],
                                                 ["doc_id", "high", "pieces"])
                at += len(part)

    return rows.mapInArrow(giving_back(run), "doc_id long, high long, pieces array<struct<anchor: long, content: long, place: long>>")


class Automaton:
    """Suffix automaton of several strings of whole numbers, with the number of places of each state's strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings of ``q`` that are no longer than those of ``p`` and ``word``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, string: list[int], times: int) -> None:
        """Add a string that has ``times`` places."""
        last = 0
        for word in string:
            p, q = last, self.next[last].get(word)
            if q is not None:  # another string begins in the same way
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            self.places[last] += times

    def count(self) -> "Automaton":
        """Pass the places of longer strings on to their suffixes; call once, after all strings."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]
        return self

    def statistics(self, string: list[int], window: int):
        """(matched words, places of the match) at every word, matches cut back to ``window`` words."""
        s, n = 0, 0
        for word in string:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s, n = self.next[s][word], n + 1
            while s and self.length[self.link[s]] >= window:
                s = self.link[s]
            n = min(n, window)
            yield n, self.places[s]


def repeated_windows(automaton: Automaton, string: list[int], window: int) -> list[tuple[int, int]]:
    """[first, end) stretches of starts of the windows of ``string`` that have two places or more."""
    spans: list[list[int]] = []
    for i, (n, places) in enumerate(automaton.statistics(string, window)):
        if n >= window and places >= 2:
            start = i - window + 1
            if spans and spans[-1][1] == start:
                spans[-1][1] += 1
            else:
                spans.append([start, start + 1])
    return [(a, b) for a, b in spans]


def _near(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose text is in ``keys``, the others): split without moving texts while the keys are few; otherwise (all rows, None)."""
    if keys.count() > BROADCAST_TEXTS:
        return rows, None
    keys = F.broadcast(keys.toDF("of_doc", "of_high"))
    same = rows["doc_id"].eqNullSafe(F.col("of_doc")) & (rows["high"] == F.col("of_high"))
    return rows.join(keys, same, "left_semi"), rows.join(keys, same, "left_anti")


def _wanted_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, content, times, crowded, words) of every wanted piece, cut from the text that holds its first place; rows equal in id and text repeat it."""
    lists = wanted.groupBy("doc_id", "high").agg(F.collect_list(F.struct("anchor", "content", "place", "times", "crowded")).alias("wanted"))
    lists = cut(lists.toDF("of_doc", "of_high", "wanted"), "wanted_pieces")  # at most the pieces of one text

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one text each
                h, _ = hashed_words(batch.column("text").slice(k, 1))
                w = batch.column("wanted").slice(k, 1).flatten()
                start, length = np.divmod(w.field("place").to_numpy(), PLACE)
                off = np.concatenate([[0], np.cumsum(length + batch.column("window")[k].as_py() - 1)])
                at = np.repeat(start - off[:-1], np.diff(off)) + np.arange(off[-1])
                words = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(w.field(c) for c in ("anchor", "content", "times", "crowded")), words], ["anchor", "content", "times", "crowded", "words"])

    some, _ = _near(docs, lists.select("of_doc", "of_high"))
    joined = some.join(lists, some["doc_id"].eqNullSafe(lists["of_doc"]) & (some["high"] == lists["of_high"])).select("text", "window", "wanted")
    return joined.mapInArrow(giving_back(run), "anchor long, content long, times long, crowded boolean, words array<long>")


def _by_automata(strings: DataFrame, words: int, window: int) -> DataFrame:
    """(anchor, content, spans): the repeated windows of every piece, by the automaton of its shard."""
    shards = max(1, -(-words // SHARD_WORDS))

    def run(table: pa.Table) -> pa.Table:
        automaton = Automaton()
        rows = list({r[:2]: r for r in zip(*(table.column(c).to_pylist() for c in ("anchor", "content", "times", "words")))}.values())
        for _, _, times, string in rows:
            automaton.add(string, times)
        automaton.count()
        found = [(a, c, spans) for a, c, _, string in rows if (spans := repeated_windows(automaton, string, window))]
        anchor, content, spans = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in own] for own in spans], _SPANS)], names=["anchor", "content", "spans"])

    dealt = strings.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "content", "times", "words")
    return dealt.groupBy("shard").applyInArrow(run, "anchor long, content long, spans array<struct<a: int, b: int>>")


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _by_counts(strings: DataFrame, window: int) -> DataFrame:
    """The same as ``_by_automata`` for the pieces of crowded anchors: every window is counted by its content."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                h = batch.column("words").slice(k, 1).flatten().to_numpy().view(np.uint64)
                v = np.zeros(len(h) - window + 1, np.uint64)
                u = np.zeros_like(v)
                for j in range(window):
                    v += h[j:j + len(v)] * _FACTORS[j % 64] * np.uint64(2 * (j // 64) + 1)
                    u += mix(h[j:j + len(v)] + np.uint64(j))
                n = len(v)
                same = lambda c: pa.array(np.full(n, batch.column(c)[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([same("anchor"), same("content"), same("times"), pa.array(np.arange(n), pa.int32()), pa.array(mix(v).view(np.int64)), pa.array(mix(u).view(np.int64))],
                                                 ["anchor", "content", "times", "a", "high", "low"])

    windows = cut(strings.dropDuplicates(["anchor", "content"]).mapInArrow(giving_back(run), "anchor long, content long, times long, a int, high long, low long"), "crowded_windows")
    often = windows.groupBy("high", "low").agg(F.sum("times").alias("n")).where("n >= 2").select("high", "low")
    hit = windows.join(often, ["high", "low"]).groupBy("anchor", "content").agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).alias("spans"))
    return hit  # at most the windows of one piece


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("high"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, high, spans) of every text with repeated windows: unordered [a, b) stretches of words; ``high`` is the hash of the text."""
    named = _named(docs)
    cut_up = cut(text_pieces(named, window, frequent_grams(named, window)), "text_pieces")
    places = cut_up.select("doc_id", "high", F.explode("pieces").alias("p")).select("doc_id", "high", "p.*")
    anchors = cut(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeated_anchors")
    places = cut(places.join(anchors, "anchor", "left_semi"), "repeated_pieces")
    kinds = cut(places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "high", "place")).alias("first")), "piece_kinds")
    crowded = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).select("anchor", (F.col("kinds") > CROWDED).alias("crowded"))
    wanted = kinds.join(crowded, "anchor").select("anchor", "content", "times", "crowded", "first.*")
    strings = cut(_wanted_words(named.withColumn("window", F.lit(window)), wanted), "piece_words")
    some = strings.agg(F.sum(F.when(~F.col("crowded"), F.size("words"))).alias("words"), F.max(F.col("crowded").cast("int")).alias("crowded")).first()
    hits = _by_automata(strings.where(~F.col("crowded")), some["words"] or 0, window)
    if some["crowded"]:
        hits = hits.unionByName(_by_counts(strings.where("crowded"), window))
    hits = cut(hits, "repeated_windows")
    each = places.join(hits, ["anchor", "content"]).select("doc_id", "high", F.floor(F.col("place") / PLACE).alias("start"), F.explode("spans").alias("s"))
    spans = each.select("doc_id", "high", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + window - 1).alias("b")).alias("span"))
    return spans.groupBy("doc_id", "high").agg(F.collect_set("span").alias("spans"))


def _kept(counts: np.ndarray, lists) -> np.ndarray:
    """Which words of consecutive texts stay, from a list of spans a text."""
    first = np.concatenate([[0], np.cumsum(counts)])
    gone = np.zeros(int(first[-1]) + 1, np.int64)
    at = np.repeat(first[:-1], pc.list_value_length(lists).to_numpy())
    flat_spans = lists.flatten()
    np.add.at(gone, at + flat_spans.field("a").to_numpy(), 1)
    np.add.at(gone, at + flat_spans.field("b").to_numpy(), -1)
    return np.cumsum(gone)[:-1] == 0


def _with_spans(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each row's text in a further column (empty if it has none), and that column's name."""
    own = fresh(docs.columns, "word_spans")
    spans = cut(repeated_spans(docs.select("doc_id", "text"), window).toDF("of_doc", "of_high", own), "text_spans")
    none = F.array().cast(spans.schema[own].dataType)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("high"), whole)
    some, others = _near(rows, spans.select("of_doc", "of_high"))
    both = some.join(spans, some["doc_id"].eqNullSafe(spans["of_doc"]) & (some["high"] == spans["of_high"]), "left").select("row.*", F.coalesce(own, none).alias(own))
    return (both if others is None else both.unionAll(others.select("row.*", none.alias(own)))), own


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of repeated windows; columns as before."""
    both, own = _with_spans(docs, window)

    @F.arrow_udf("string")
    def shorter(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for k in range(len(text)):
            words, counts = black_words(text.slice(k, 1))
            out.append(" ".join(words.filter(pa.array(_kept(counts, spans.slice(k, 1)))).to_pylist()))
        return pa.array(out, pa.string())

    some = both.where(F.size(own) > 0).withColumn("text", shorter("text", own))
    return some.unionAll(both.where(F.size(own) == 0)).select(docs.columns)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and a hash of the words that stay, of every row."""
    both, own = _with_spans(docs.select("doc_id", "text"), window)

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                words, counts = black_words(part)
                keep = _kept(counts, batch.column("spans").slice(at, len(part)))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[bounds])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined_digests(words, counts, keep))],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256"])
                at += len(part)

    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(own).alias("spans")).mapInArrow(
        giving_back(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")

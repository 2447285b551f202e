"""Benchmark decontamination by an FM-index per shard of the corpus.

``build_index`` turns the texts into shards of about ``SHARD_WORDS`` words and writes one row per shard: the word alphabet, the
wavelet matrix of the Burrows-Wheeler transform over words, and the suffix positions sampled at every ``STEP``-th word of a text.
``find_spans`` searches the windows of the benchmark items backwards through wavelet ranks, all windows of a block of items at once,
walks every hit to the next sampled position, and merges the hit words of a document and item into spans. Items are searched in
blocks of bounded bytes, one pass over the index per block; a block is what every task receives.

The index is exact: words are compared as words, suffixes are fully sorted, and every occurrence is located. Nothing in it depends
on the benchmark. It is a written table, so a lost executor costs the tasks at hand only.

A window is ``window`` consecutive words of an item (the whole item if it has fewer, but not none). A document word inside any
occurrence of a window is hit. A document is contaminated if at least one in ``1 / share`` of its words is hit.

Defined results: null and wordless texts have no words and no hits; an item without words has no window; items that share an id
count as one; a null item_id counts as the empty id; rows of a document table are told apart by their place in the index, so null
or repeated doc_ids keep a row each; other columns are not looked at; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from confab.llm.texts import byte_table, flat, fresh, give_back, giving_back, slices
from confab.session import cut

WINDOW = 13
SHARE = 20  # a document is contaminated when SHARE times its hit words are at least its words
SHARD_WORDS = 300_000
STEP = 16
BROADCAST_ROWS = 1 << 20  # contaminated documents that may be named to every task
BLOCK_BYTES = 4 << 20  # bytes of benchmark text searched in one pass
SEARCHED = 1 << 16  # windows searched at once
SPANS = 1 << 17  # spans merged at once
#: A row of the index has megabytes. Parquet otherwise looks at sizes every hundred rows: pages and row groups, which writers and readers hold
#: whole, would then have as many shards as a task has, up to a hundred.
GROUP_BYTES = 16 << 20
WRITER = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

INDEX = ("shard long, doc_id array<long>, text_key array<long>, starts binary, alphabet array<string>, bounds binary, bits binary, "
         "ranks binary, zeros binary, marks binary, mark_ranks binary, samples binary")


def words_of(arr) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words of each text)."""
    off, data = flat(arr)
    clean = byte_table("alnum")[data]
    texts = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(clean)])
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat_words = split.flatten()
    solid = pc.not_equal(flat_words, "")
    counts = np.diff(split.offsets.to_numpy())
    if not pc.all(solid).as_py():  # empty pieces before a first or after a last space
        mask = solid.to_numpy(zero_copy_only=False)
        counts = np.diff(np.concatenate([[0], np.cumsum(mask)])[split.offsets.to_numpy() - split.offsets[0].as_py()])
        flat_words = flat_words.filter(solid)
    return flat_words, counts


def suffix_order(text: np.ndarray, separators: int) -> np.ndarray:
    """Suffix array of ``text``; its values below ``separators`` occur once each, at the ends of the documents."""
    n, base = len(text), int(text.max()) + 1 if len(text) else 1
    width, key = 1, text.astype(np.int64)
    while (width + 1) * base.bit_length() <= 62 and width < 4:
        shifted = np.zeros(n, np.int64)
        shifted[:max(0, n - width)] = text[width:]
        key = (key << base.bit_length()) | shifted
        width += 1
    order = np.argsort(key).astype(np.int32)  # a shard is far below 2^31 words
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # keys that reach past a separator are distinct already, since separators are
    del key
    rank = np.empty(n, np.int32)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    single = new & np.append(new[1:], True)
    slots = np.flatnonzero(~single)
    while len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[np.minimum(at + width, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank[at] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        slots = slots[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector as 64-bit words, and the number of ones before each word."""
    room = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
    room[:len(bits)] = bits
    words = np.packbits(room, bitorder="little").view(np.uint64)
    ones = np.zeros(len(words), np.uint32)
    np.cumsum(np.bitwise_count(words)[:-1], out=ones[1:])
    return words, ones


def ones_before(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    block = at >> 6
    part = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return ranks[block].astype(np.int64) + np.bitwise_count(part)


class Shard:
    """One FM-index over words. Symbol 0 is the end of a document; word k of the alphabet is symbol k + 1."""

    def __init__(self, starts, alphabet, bounds, levels, zeros, marks, samples):
        self.starts, self.alphabet, self.bounds = starts, alphabet, bounds
        self.levels, self.zeros, self.marks, self.samples = levels, zeros, marks, samples

    @classmethod
    def build(cls, words: pa.Array, counts: np.ndarray) -> "Shard":
        coded = pc.dictionary_encode(words) if not isinstance(words, pa.DictionaryArray) else words
        codes = coded.indices.to_numpy(zero_copy_only=False)
        docs, n = len(counts), len(codes) + len(counts)
        starts = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
        ends = starts[1:] - 1
        text = np.empty(n, np.int32)
        solid = np.ones(n, bool)
        solid[ends] = False
        text[ends], text[solid] = np.arange(docs), codes + docs
        order = suffix_order(text, docs)
        symbols = np.where(text < docs, 0, text - docs + 1)
        del text
        last = symbols[order - 1]
        sigma = len(coded.dictionary) + 1
        bounds = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=bounds[1:])
        levels, zeros = [], []
        for level in reversed(range(max(1, (sigma - 1).bit_length()))):
            bit = (last >> level) & 1
            levels.append(packed(bit.astype(np.uint8)))
            bit = bit.astype(bool)
            zeros.append(int((~bit).sum()))
            last = np.concatenate([last[~bit], last[bit]])
        offset = np.arange(n) - np.repeat(starts[:-1], counts + 1)
        sampled = (offset % STEP == 0)[order]
        return cls(starts, coded.dictionary, bounds, levels, zeros, packed(sampled.astype(np.uint8)), order[sampled].astype(np.int32))

    def walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place of position ``at`` after the last level, following the bits of ``symbol``."""
        top = len(self.levels) - 1
        for k, (words, ranks) in enumerate(self.levels):
            ones = ones_before(words, ranks, at)
            at = np.where((symbol >> (top - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def previous(self, at: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that start one word earlier (none of ``at`` may be at a document's start)."""
        symbol = np.zeros(len(at), np.int64)
        for k, (words, ranks) in enumerate(self.levels):
            bit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = ones_before(words, ranks, at)
            symbol = (symbol << 1) | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return self.bounds[symbol] + at - self.walk(np.zeros(len(at), np.int64), symbol)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, text position) of every occurrence of the rows of ``windows``, symbols of one length."""
        which = np.arange(len(windows))
        lo, hi = self.bounds[windows[:, -1]], self.bounds[windows[:, -1] + 1]
        used, inverse = np.unique(windows, return_inverse=True)
        base = self.walk(np.zeros(len(used), np.int64), used)
        inverse = inverse.reshape(windows.shape)
        for k in reversed(range(windows.shape[1] - 1)):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            if not len(which):
                break
            symbol, first = windows[which, k], base[inverse[which, k]]
            lo = self.bounds[symbol] + self.walk(lo, symbol) - first
            hi = self.bounds[symbol] + self.walk(hi, symbol) - first
        live = lo < hi
        which, lo, hi = which[live], lo[live], hi[live]
        size = hi - lo
        return np.repeat(which, size), self.locate(np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to the sampled ones."""
        words, ranks = self.marks
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        at = rows.astype(np.int64)
        while len(todo):
            hit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            found[todo[hit]] = self.samples[ones_before(words, ranks, at[hit])] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                at = self.previous(at)
                steps[todo] += 1
        return found


def build_index(docs: DataFrame, label: str = "fm_index") -> DataFrame:
    """The written index of columns doc_id, text (and text_key, a hash of the text, for later joins)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    def row(number: int, ids, keys, words, counts) -> pa.RecordBatch:
        s = Shard.build(pa.chunked_array(words, pa.large_string()).combine_chunks(), np.concatenate(counts))
        raw = lambda parts: pa.array([b"".join(np.ascontiguousarray(p).tobytes() for p in parts)], pa.binary())
        listed = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(kind))
        shard = pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64())
        return pa.RecordBatch.from_arrays(
            [shard, listed(pa.chunked_array(ids, pa.int64()).combine_chunks(), pa.int64()), listed(pa.chunked_array(keys, pa.int64()).combine_chunks(), pa.int64()),
             raw([s.starts]), listed(s.alphabet, pa.string()), raw([s.bounds]), raw([w for w, _ in s.levels]), raw([r for _, r in s.levels]),
             raw([np.array(s.zeros, np.int64)]), raw([s.marks[0]]), raw([s.marks[1]]), raw([s.samples])],
            [f.split()[0] for f in INDEX.split(", ")])

    def run(batches):
        number, size, ids, keys, words, counts = 0, 0, [], [], [], []
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                w, c = words_of(part)
                ids.append(batch.column("doc_id").slice(at, len(part)))
                keys.append(batch.column("text_key").slice(at, len(part)))
                words.append(w), counts.append(c)
                at, size = at + len(part), size + len(w)
                if size >= SHARD_WORDS:
                    yield row(number, ids, keys, words, counts)
                    number, size, ids, keys, words, counts = number + 1, 0, [], [], [], []
                    give_back()
        if ids:
            yield row(number, ids, keys, words, counts)

    return cut(rows.mapInArrow(giving_back(run), INDEX), label, WRITER)


def _shard(row: dict) -> Shard:
    n = int(np.frombuffer(row["starts"], np.int64)[-1])
    blocks = n // 64 + 1
    whole, ranks = np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["ranks"], np.uint32)
    zeros = np.frombuffer(row["zeros"], np.int64)
    levels = [(whole[k * blocks:(k + 1) * blocks], ranks[k * blocks:(k + 1) * blocks]) for k in range(len(zeros))]
    return Shard(np.frombuffer(row["starts"], np.int64), row["alphabet"], np.frombuffer(row["bounds"], np.int64), levels, zeros,
                 (np.frombuffer(row["marks"], np.uint64), np.frombuffer(row["mark_ranks"], np.uint32)), np.frombuffer(row["samples"], np.int32))


def windows_of(items: list[tuple[str, str]], window: int) -> tuple[pa.Array, pa.Array, np.ndarray, dict[int, tuple], np.ndarray]:
    """(item ids, vocabulary, all words as numbers of the vocabulary, length -> windows, holders).

    Windows are (place of their first word, bounds of their holders): a distinct window ``k`` stands in the items ``holders[bounds[k]:bounds[k + 1]]``.
    """
    ids = pa.array([i for i, _ in items], pa.string())
    words, counts = words_of(pa.array([t for _, t in items], pa.string()))
    coded = pc.dictionary_encode(words)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    begins, sizes, base = np.cumsum(counts) - counts, np.minimum(counts, window), len(coded.dictionary)
    found, holders, held = {}, [], 0
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        many = counts[own] - size + 1
        at = np.repeat(begins[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        number = np.zeros(len(at), np.int64)
        for k in range(size):  # equal numbers are equal words so far
            number = np.unique(number * base + codes[at + k], return_inverse=True)[1]
        first = np.unique(number, return_index=True)[1]
        pairs = np.unique(number * len(counts) + np.repeat(own, many))
        holders.append((pairs % len(counts)).astype(np.int32))
        found[size] = at[first].astype(np.int32), held + np.searchsorted(pairs, np.arange(len(first) + 1) * len(counts))
        held += len(pairs)
    return ids, coded.dictionary.cast(pa.string()), codes, found, np.concatenate([np.zeros(0, np.int32), *holders])


def blocks_of(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """Blocks of (item_id, text) with bounded bytes; a longer item is alone. One block is on the driver at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").toLocalIterator():
        if rows and size + len(r.text) > most:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += len(r.text)
    if rows:
        yield rows


def merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of the spans of each (doc, item), as sorted arrays."""
    if not len(doc):
        return doc, item, start, end
    by = np.lexsort((start, item, doc))
    doc, item, start, end = doc[by], item[by], start[by], end[by]
    group = np.zeros(len(doc), np.int64)
    group[1:] = np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    far = 1 << 40  # groups are far apart on one line, so that a running maximum stays inside its group
    top = np.maximum.accumulate(end + group * far)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + group[1:] * far > top[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], item[head], start[head], top[last] - group[last] * far


def occurrences(s: Shard, symbols: np.ndarray, windows: dict[int, tuple]) -> list[np.ndarray]:
    """[document, first word, end word, bounds of the holders] of every occurrence, in the order of documents; ``symbols`` are a block's words in the shard."""
    found = [np.zeros((5, 0), np.int64)]
    for size, (at, bounds) in windows.items():
        for k in range(0, len(at), SEARCHED):
            some = symbols[at[k:k + SEARCHED, None] + np.arange(size)]
            able = np.flatnonzero((some > 0).all(axis=1))
            if not len(able):
                continue
            which, position = s.search(some[able])
            doc, which = np.searchsorted(s.starts, position, side="right") - 1, k + able[which]
            start = position - s.starts[doc]
            found.append(np.stack([doc, start, start + size, bounds[which], bounds[which + 1]]))
    hits = np.concatenate(found, axis=1)
    return list(hits[:, np.argsort(hits[0], kind="stable")])


def spans_of(hits: list[np.ndarray], holders: np.ndarray):
    """Parts of the merged (doc, item, start, end); some ``SPANS`` of them and one document's are there at a time."""
    doc, start, end, low, high = hits
    many = high - low
    total = np.cumsum(many)
    rest, a = [np.zeros(0, np.int64)] * 4, 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(total, total[a] - many[a] + SPANS, side="right")))
        n = many[a:b]
        item = holders[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        got = merged(*(np.concatenate(x) for x in zip(rest, (np.repeat(doc[a:b], n), item, np.repeat(start[a:b], n), np.repeat(end[a:b], n)))))
        done = got[0] < (doc[b] if b < len(doc) else doc[-1] + 1)  # later hits are in later documents
        yield [x[done] for x in got]
        rest, a = [x[~done] for x in got], b


def find_spans(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, doc, item_id, first_word, end_word): merged occurrences; ``doc`` numbers the documents of a shard."""
    spark, found = index.sparkSession, None
    schema = "shard long, doc long, item_id string, first_word long, end_word long"
    for items in blocks_of(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(windows_of(items, window))

        def run(batches, block=block):
            ids, vocabulary, codes, windows, holders = block.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "alphabet"}
                    row["alphabet"] = batch.column("alphabet")[k].values
                    s = _shard(row)
                    known = pc.fill_null(pc.index_in(vocabulary.cast(s.alphabet.type), s.alphabet), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                    for d, i, a, b in spans_of(occurrences(s, known[codes], windows), holders):
                        if len(d):  # known words do not make an occurrence
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), row["shard"]), pa.int64()), pa.array(d, pa.int64()), ids.take(pa.array(i)),
                                                              pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["shard", "doc", "item_id", "first_word", "end_word"])

        part = index.mapInArrow(giving_back(run), schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def document_rows(index: DataFrame) -> DataFrame:
    """(shard, doc, doc_id, text_key, n_words) of every indexed document."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                starts = np.frombuffer(batch.column("starts")[k].as_py(), np.int64)
                n = len(starts) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("shard")[k].as_py()), pa.int64()), pa.array(np.arange(n), pa.int64()), batch.column("doc_id")[k].values,
                                                  batch.column("text_key")[k].values, pa.array(np.diff(starts) - 1, pa.int64())], ["shard", "doc", "doc_id", "text_key", "n_words"])

    return index.select("shard", "doc_id", "text_key", "starts").mapInArrow(run, "shard long, doc long, doc_id long, text_key long, n_words long")


def removal_spans(spans: DataFrame) -> DataFrame:
    """(shard, doc, spans, items): the hit words of a document over all items as disjoint ordered spans, and its item ids."""
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(acc, F.array(s)))
    some = F.array_sort(F.collect_set(F.struct(F.col("first_word").alias("start"), F.col("end_word").alias("end"))))
    got = spans.groupBy("shard", "doc").agg(some.alias("s"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return got.select("shard", "doc", F.aggregate("s", F.slice("s", 1, 0), step).alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Of every document row: doc_id, text_key, n_words, n_hit, spans, items and contaminated."""
    index = build_index(docs)
    hits = removal_spans(find_spans(index, benchmark, window))
    rows = document_rows(index).join(hits, ["shard", "doc"], "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    return rows.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the given word spans (and what stands between them)."""
    if text is None or not spans:
        return text
    import re

    lower = text.translate({c: c + 32 for c in range(65, 91)})  # words are those of the lower-cased text, at the same places
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join(keep) + text[at:]


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts; columns as before."""
    hit = found.where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    own, key, spans = (fresh(docs.columns, c) for c in ("span_doc", "span_key", "span_list"))
    hit = hit.toDF(own, key, spans)
    cutter = F.udf(lambda t, s: cut_spans(t, [(x["start"], x["end"]) for x in s or []]), "string")
    both = docs.join(hit, docs["doc_id"].eqNullSafe(hit[own]) & (F.xxhash64(docs["text"]) == hit[key]), "left")
    return both.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cutter("text", spans))).select(docs.columns)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    bad = contamination(docs, benchmark, window, share).where("contaminated").select("doc_id", "text_key").distinct()
    own, key = fresh(docs.columns, "bad_doc"), fresh(docs.columns, "bad_key")
    bad = cut(bad.toDF(own, key), "contaminated")
    few = bad.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad[own]) & (F.xxhash64(docs["text"]) == bad[key]), "left_anti").select(docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``contamination``: counts, and a hash of the sorted item ids."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

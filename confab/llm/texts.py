"""Shared by the operators: session settings, and Arrow text columns seen as one numpy byte array."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from confab import session

BATCH_ROWS = 128  # rows per Arrow batch: long texts must not meet in batches of ten thousand
BATCH_BYTES = 4 << 20  # bytes after which an Arrow batch ends (a longer row is alone)
SLICE_BYTES = 1 << 18  # bytes of text that one vectorised step looks at; its arrays take up to a hundred times as much


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, and small Arrow batches for text columns."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def giving_back(run):
    """``run`` over batches; when a task ends, its worker returns freed memory to the system instead of holding it until the next stage."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed Arrow and heap pages of this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (column names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: a name inside nested lambdas, where the optimizer would repeat an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def id_in_slot(column: str, modulus: int, slot: int) -> Column:
    """Whether crc32 of the id as text leaves ``slot``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == slot, F.lit(False))


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


def slices(arr, most: int = SLICE_BYTES):
    """Consecutive slices of a string array with at most ``most`` bytes each (a longer text is alone)."""
    lengths = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield arr.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield arr.slice(start)


def byte_table(word: str, fold: bool = True) -> np.ndarray:
    """Byte map for splitting: A-Z fall to a-z unless ``fold`` is false, bytes outside the word class become a space.

    ``word`` is ``"alnum"`` (digits, letters, everything from byte 128) or ``"black"`` (all but ASCII white space).
    """
    t = np.arange(256, dtype=np.uint8)
    if fold:
        t[65:91] += 32
    for b in range(128):
        c = chr(b)
        keep = c.isalnum() if word == "alnum" else not (b == 32 or 9 <= b <= 13)
        if not keep:
            t[b] = 32
    return t


def black_words(arr) -> tuple[pa.Array, np.ndarray]:
    """(all words between ASCII white space in order, number of words of each text); words are unchanged, nulls have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(arr.cast(pa.large_string()), ""))
    words, at = split.flatten(), split.offsets.to_numpy()
    solid = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # pieces before a first or after a last space are empty
    total = np.concatenate([[0], np.cumsum(solid)])
    return words.filter(pa.array(solid)), np.diff(total[at - at[0]])


def joined_digests(words: pa.Array, counts: np.ndarray, keep: np.ndarray) -> list[str]:
    """SHA-256 of the kept words of every text, joined by one space."""
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])]
    lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep)))
    off, data = flat(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


_POWERS = np.cumprod(np.full(256, np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64), dtype=np.uint64)
_BYTES = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    global _BYTES
    if _BYTES is None:
        _BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _BYTES


def word_hashes(off: np.ndarray, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words up to the start of every text (n + 1 values)."""
    x = table[data]
    solid = x != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(x)]
    first[inner] = solid[inner]  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(first)
    counts = np.concatenate([[0], np.cumsum(first)])[off]
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) if starts[0] == 0 else None
    if nth is None:
        nth = np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        x, solid = x[starts[0]:], solid[starts[0]:]
    power = _POWERS[nth & 255]
    if len(nth) and nth.max() > 255:  # words longer than the table go on with other powers
        far = (nth >> 8).astype(np.uint64)
        power = power * np.where(far > 0, mix(far) | np.uint64(1), np.uint64(1))  # other words keep their hash whatever stands beside them
    values = np.where(solid, _byte_values()[x] * power, np.uint64(0))
    return mix(np.add.reduceat(values, starts - starts[0])), counts

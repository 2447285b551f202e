import numpy as np
import pyarrow as pa

from confab.llm.texts import black_words, byte_table, flat, joined_digests, word_hashes


def test_word_hashes_do_not_depend_on_neighbours():
    table = byte_table("black")
    alone, _ = word_hashes(*flat(pa.array(["one two"])), table)
    beside, _ = word_hashes(*flat(pa.array(["one two", "x" * 1000, "x" * 999 + "y", "y" + "x" * 999])), table)
    assert (alone == beside[:2]).all() and len(np.unique(beside)) == 5


def test_black_words_and_digests():
    words, counts = black_words(pa.array([None, "", " a  b\tc\x0b ", "\u00e9\x85x  y"]))
    assert words.to_pylist() == ["a", "b", "c", "\u00e9\x85x", "y"] and counts.tolist() == [0, 0, 3, 2]
    digests = joined_digests(words, counts, np.array([True, False, True, True, True]))
    assert digests[0] == digests[1] and len(set(digests)) == 3

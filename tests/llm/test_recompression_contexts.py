"""A symbol whose context lies inside a word sequence stands in every text that holds the sequence."""

import numpy as np
import pytest

from tallygrid.llm import words as W
from tallygrid.llm.recompression import recompress, remove_repeats


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 60])
def test_symbols_follow_from_their_context(letters):
    random = np.random.RandomState(letters)
    alphabet = W.mix(np.arange(letters, dtype=np.uint64), 99)
    for _ in range(400):
        inner = alphabet[random.randint(0, letters, random.randint(5, 80))]
        if random.rand() < 0.3:  # periodic
            inner = np.tile(inner[: random.randint(1, 6)], 30)[: len(inner)]
        inside, everywhere = [], []
        for _ in range(2):
            before, after = (alphabet[random.randint(0, letters, random.randint(0, 30))] for _ in range(2))
            text = np.concatenate((before, inner, after))
            both = np.concatenate((alphabet[random.randint(0, letters, 7)], text))
            rows = np.repeat([0, 1], [7, len(text)])
            symbols, row, low, high = recompress(both, rows, 4)
            begin = 7 + len(before)
            own = (row == 1) & (low >= begin) & (high <= begin + len(inner))
            inside.append(set(symbols[own].tolist()))
            everywhere.append(set(symbols[row == 1].tolist()))
        assert inside[0] <= everywhere[1] and inside[1] <= everywhere[0]


def test_a_repeated_row_that_is_a_copy_of_an_earlier_document(spark):
    text = " ".join(f"word{k}" for k in range(70))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs, 50).collect())
    assert got == [(1, 70, 0)] + [(2, 70, 70)] * 3

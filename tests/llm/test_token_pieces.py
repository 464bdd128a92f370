"""Token ids of words that are kept once for all their capitals and marks at the end."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import words as W
from tallygrid.llm.q_tokens import vocabulary
from tallygrid.llm.token_tables import MARKS_BACK, _HeldWords

PIECES = ["H", "h", "W", "a", "re", "S", "'s", "'", "'RE", "’", "1", "²", ".", ",", "\"", "…", "é", "É", "̱", "̊", "İ", "K", "Σ", "ß", "中", "-", "_",
          "\x1c", "\x7f", " ", "‍", " ", "\n", "." * (MARKS_BACK + 2), "<|", "|>", "startoftext"]


@pytest.fixture()
def held():
    return _HeldWords(vocabulary())


def encoded(held, texts):
    out = []
    for part in W.words(pa.array(texts), cut=held.cut, limit=1 << 10):
        ids, sizes = held.encode(part)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[part.at]
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


def test_capitals_and_marks_at_the_end_cost_no_other_encoding(held):
    texts = ["Word word, WORD. (word word; wOrd", None, "", "word"]
    assert encoded(held, texts) == [held.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(held.names) == 5  # word ( , . ; and (word beside word


def test_ids_of_odd_words_are_those_of_the_whole_text(held):
    random.seed(3)
    texts = ["".join(random.choices(PIECES, k=random.randint(0, 40))) for _ in range(20_000)]
    texts += ["<|startoftext|>.", "a<|ENDOFTEXT|>, b<|endoftext|>", "H̱ ẖ T̈,", "'" * 30, "x" + "." * 30, "."]
    assert encoded(held, texts) == [held.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_keep_words_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    file = str(tmp_path / "words.json")
    made = Tokenizer(models.WordLevel({"A": 0, "a": 1, "a,": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(file)
    assert encoded(_HeldWords(file), ["A a a, A,"]) == [[0, 1, 2, 3]]

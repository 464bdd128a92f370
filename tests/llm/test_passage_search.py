"""The search of passages for items: its scores against plain sums, and its work."""

import random
from types import SimpleNamespace

import numpy as np

from tallygrid.llm import decontamination as D


def _index_and_words(n_items, n_words):
    r = random.Random(8)
    name = lambda: int(r.expovariate(1 / 60)) + 1
    items = [SimpleNamespace(item_id=k, question=[name() for _ in range(r.randint(1, 20))], answer=[name() for _ in range(r.randint(0, 9))])
             for k in range(n_items)]
    known = {}
    for row in items:
        for word in {*row.question, *row.answer}:
            known[word] = known.get(word, 0) + 1
    mean = sum(len(x.question) + len(x.answer) for x in items) / n_items
    words = np.array([name() for _ in range(n_words)], np.uint64)
    chunks = np.arange(n_words) // D.STRIDE
    ends = np.zeros(int(chunks[-1]) + 1, bool)
    ends[[3, 9, -1]] = True
    return D._built(items, known, n_items, mean), words, chunks, ends, items, known, mean


def _plain(index, words, chunks, ends, items, known, mean):
    """Scores of all passages and items by the formula."""
    out = {}
    for c in range(len(ends)):
        here = set(words[(chunks == c) | (~ends[c] & (chunks == c + 1))].tolist())
        for k, row in enumerate(items):
            both = row.question + row.answer
            part = {w: np.log(1 + (len(items) - known[w] + 0.5) / (known[w] + 0.5)) * both.count(w) * (D.K1 + 1)
                    / (both.count(w) + D.K1 * (1 - D.B + D.B * len(both) / mean)) for w in set(both)}
            score = sum(v for w, v in part.items() if w in here) / sum(part.values())  # items are shorter than a stretch
            if score >= D.THRESHOLD:
                out[c, k] = score
    return out


def test_scores_in_groups_of_passages(monkeypatch):
    found = _index_and_words(50, 2000)
    index, words, chunks, ends = found[:4]
    want = _plain(*found)
    assert len(want) > 20
    for cells in (1, 20, 1 << 18):
        monkeypatch.setattr(D, "CELLS", cells)
        got = {(int(c), index.ids[i]): s for c, i, s in zip(*D.retrieve(index, words, chunks, ends, D.THRESHOLD))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_work_of_the_search(monkeypatch):
    """One search in sorted numbers for a word; none for the pairs of a passage's terms with blocks and items."""
    index, words, chunks, ends, *_ = _index_and_words(200, 5000)
    searched, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: searched.append(np.size(v)) or plain(a, v, *rest))
    D.retrieve(index, words, chunks, ends, D.THRESHOLD)
    assert sum(searched) <= len(words) + len(ends) + 1


def test_no_words():
    index = _index_and_words(9, 700)[0]
    none = D.retrieve(index, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), D.THRESHOLD)
    assert [len(x) for x in none] == [0, 0, 0]

"""Benchmark decontamination: BM25 with block-max pruning, then question and answer overlap.

The test items are the indexed side: per term its postings (item, impact), with items in
order of their norm and cut into blocks of `BLOCK_ITEMS`, and per term and block the
largest impact. Every passage of every text is a query. Impacts are BM25 scores over the
item's norm, the least score of a passage that holds a whole stretch of the item; so one
threshold serves all items.

For a passage, terms in order of their largest impact are passed over while their sum
stays below the threshold; an item needs one of the other terms. The blocks of those
terms are bounded by their block maxima, and only in blocks that can reach the threshold
are items scored. All of it runs on arrays of many passages at once, and drops nothing
that reaches the threshold. Items beyond `SHARD_WORDS` words are indexed and searched in
several rounds, so what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow, written

#: A passage has twice so many words, and the next one begins so many words later.
STRIDE = 64
THRESHOLD = 0.5
#: Part of the word triples of the question, and of the answer, that must stand near the passage.
OVERLAP = 0.6
GRAM = 3
#: A part of fewer triples may be judged by its words, of which one may be missing.
FEW_GRAMS = 3
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: Words of the items indexed at once; some 100 MB of postings.
SHARD_WORDS = 2_000_000
#: Pairs of a passage and a block scored at once, or the blocks of one passage.
CELLS = 1 << 18


@dataclass
class Index:
    """Terms are numbered by their largest impact, items by their norm."""
    names: np.ndarray        # sorted word numbers
    terms: np.ndarray        # the term of each
    most: np.ndarray         # per term its largest impact
    block_at: np.ndarray     # postings of term t in blocks: block_at[t] to block_at[t + 1]
    block_of: np.ndarray     # the block of each, ascending
    block_most: np.ndarray
    item_at: np.ndarray      # item postings of block posting b: item_at[b] to item_at[b + 1]
    items: np.ndarray        # by term, then item
    impacts: np.ndarray
    ids: list                # item ids
    sizes: np.ndarray        # words per item
    parts: list              # per item, for question and answer, width and numbers of the word triples, and numbers of the words
    wholes: list             # per item, width and numbers of the word triples of both
    blocks: int


def _sequences(items: DataFrame) -> DataFrame:
    """`(item_id, question, answer)` as word numbers, distinct."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in (1, 2):
                out.append([p.hashes[p.at[r] : p.at[r + 1]] for p in W.words(batch.column(c), lower=True, plain=True)
                            for r in range(p.last - p.first)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(W.lists(x, pa.int64()) for x in out)], ["item_id", "question", "answer"])

    rows = items.select(F.col("item_id").cast("bigint"), "question", "answer")
    return map_arrow(rows, parse, "item_id bigint, question array<bigint>, answer array<bigint>").where(
        "size(question) + size(answer) > 0").distinct()


def _grams(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The word triples of a part, or the whole of a shorter one, and their width."""
    width = max(1, min(GRAM, len(words)))
    return width, np.unique(W.grams(words, width))


def _built(rows: list, known: dict[int, int], n_items: int, mean_words: float) -> Index:
    """The index of some items; `known` has the number of items of each of their terms."""
    scored = []
    for row in rows:
        question, answer = (np.array(x, np.int64).view(np.uint64) for x in (row.question, row.answer))
        both = np.concatenate((question, answer))
        names, times = np.unique(both, return_counts=True)
        held = np.array([known[int(x)] for x in names.view(np.int64)])
        idf = np.log(1 + (n_items - held + 0.5) / (held + 0.5))
        score = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(both) / mean_words))
        windows = [both[k : k + STRIDE] for k in range(max(1, len(both) - STRIDE + 1))]
        norm = min(score[np.isin(names, w)].sum() for w in windows)
        scored.append((norm, row.item_id, names, score / norm, len(both), 
                       [(*_grams(x), np.unique(x)) for x in (question, answer)], _grams(both)))
    scored.sort(key=lambda x: x[0])
    names = np.unique(np.concatenate([x[2] for x in scored]))
    term = np.concatenate([np.searchsorted(names, x[2]) for x in scored])
    item = np.repeat(np.arange(len(scored)), [len(x[2]) for x in scored])
    impact = np.concatenate([x[3] for x in scored])
    most = np.zeros(len(names))
    np.maximum.at(most, term, impact)
    order = np.argsort(most, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    term, blocks = rank[term], -(-len(scored) // BLOCK_ITEMS)
    keys = term * len(scored) + item
    by = np.argsort(keys)
    block_keys, inverse = np.unique(term * blocks + item // BLOCK_ITEMS, return_inverse=True)
    block_most = np.zeros(len(block_keys))
    np.maximum.at(block_most, inverse, impact)
    return Index(
        names, rank, most[order], np.searchsorted(block_keys, np.arange(len(names) + 1) * blocks), block_keys % blocks, block_most,
        np.concatenate(([0], np.cumsum(np.bincount(inverse)))), item[by], impact[by], [x[1] for x in scored],
        np.array([x[4] for x in scored]), [x[5] for x in scored], [x[6] for x in scored], blocks)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges, the number of the range and the place, for every place in them."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def retrieve(index: Index, words: np.ndarray, chunks: np.ndarray, ends: np.ndarray, threshold: float):
    """`(passage, item, score)` of all pairs that reach the threshold.

    `chunks` numbers each word's stretch of `STRIDE` words; passage c is the stretches c and
    c + 1. `ends[c]` tells that stretch c is the last of its text, so passage c has no second one.
    """
    at = np.minimum(np.searchsorted(index.names, words), len(index.names) - 1)
    real = index.names[at] == words
    term, chunk = index.terms[at[real]], chunks[real]
    # a word is in the passage of its own stretch, and in the one before if that is of the same text
    earlier = chunk - 1
    also = (chunk > 0) & ~ends[np.maximum(earlier, 0)]
    n_terms = len(index.most)
    pairs = np.unique(np.concatenate((chunk, earlier[also])) * n_terms + np.concatenate((term, term[also])))
    passage, terms = pairs // n_terms, pairs % n_terms   # terms ascend by their largest impact
    at = np.searchsorted(passage, np.arange(len(ends) + 1))
    total = np.concatenate(([0.0], np.cumsum(index.most[terms])))
    needed = total[1:] - total[at[passage]] >= threshold
    out, step = [], max(1, CELLS // index.blocks)
    for first in range(0, max(1, len(ends)), step):
        n = min(step, len(ends) - first)
        own = slice(at[first], at[first + n])
        owner, item, score = _reached(index, passage[own] - first, terms[own], needed[own], n, threshold)
        out.append((owner + first, item, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _reached(index: Index, passage: np.ndarray, terms: np.ndarray, needed: np.ndarray, n: int, threshold: float):
    """`retrieve` for `n` passages, given as pairs with a term in their order; terms that are not `needed` are passed over.

    Postings are added to cells, one for each passage and block, so no pair of a term and a block is searched for.
    """

    def postings(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some pairs, for each posting the cell of its passage and block, and its place."""
        pair, place = _spread(index.block_at[terms[which]], index.block_at[terms[which] + 1])
        return passage[which][pair] * index.blocks + index.block_of[place], place

    cells, places = postings(np.flatnonzero(needed))
    bound = np.bincount(cells, index.block_most[places], n * index.blocks).reshape(n, index.blocks)
    # what the passed-over terms can add at most: their sum is below the threshold
    passed = np.bincount(passage, np.where(needed, 0.0, index.most[terms]), n)
    keep = (bound > 0) & (bound + passed[:, None] >= threshold - 1e-9)
    # their true sums, where a block may reach the threshold
    more, at = postings(np.flatnonzero(~needed & keep.any(axis=1)[passage]))
    held = keep.ravel()[more]
    more, at = more[held], at[held]
    keep &= bound + np.bincount(more, index.block_most[at], n * index.blocks).reshape(keep.shape) >= threshold - 1e-9
    # a passage's terms ascend, the passed-over ones come first; so do their items
    cells, places = np.concatenate((more, cells)), np.concatenate((at, places))
    held = keep.ravel()[cells]
    cells, places = cells[held], places[held]
    number = np.cumsum(keep.ravel()) - 1
    which, item = _spread(index.item_at[places], index.item_at[places + 1])
    score = np.bincount(number[cells[which]] * BLOCK_ITEMS + index.items[item] % BLOCK_ITEMS, index.impacts[item])
    found = np.flatnonzero(score >= threshold)
    cell = np.flatnonzero(keep)[found // BLOCK_ITEMS]
    return cell // index.blocks, cell % index.blocks * BLOCK_ITEMS + found % BLOCK_ITEMS, score[found]


def _held(index: Index, item: int, near: np.ndarray, shares: list[float], overlap: float) -> bool:
    """Whether words hold an item: by both of its parts, short ones by their words, or by all its triples."""
    if min(shares) >= overlap:
        return True
    width, grams = index.wholes[item]
    if np.isin(grams, W.grams(near, width)).mean() >= overlap:
        return True
    # the other part has to vouch for a part of few triples
    if max(shares) < overlap or not all(len(g) for _, g, _ in index.parts[item]):
        return False
    return all(
        share >= overlap or len(g) < FEW_GRAMS and np.isin(own, near).sum() >= min(len(own) - 1, overlap * len(own))
        for share, (_, g, own) in zip(shares, index.parts[item]))


_HITS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def _searched(docs: DataFrame, index: Index, threshold: float, overlap: float) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SHARD_WORDS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            for part in W.words(batch.column(1), lower=True, plain=True, limit=W.SLICE_BYTES // 4):
                place = np.arange(len(part.hashes)) - part.at[part.rows]
                stretches = -(-np.diff(part.at) // STRIDE)
                before = np.concatenate(([0], np.cumsum(stretches)))
                chunks = before[part.rows] + place // STRIDE
                ends = np.zeros(int(before[-1]), bool)
                ends[before[1:][stretches > 0] - 1] = True
                found = []
                for c, item, score in zip(*retrieve(index, part.hashes, chunks, ends, threshold)):
                    row = int(np.searchsorted(before, c, "right")) - 1
                    own = part.hashes[part.at[row] : part.at[row + 1]]
                    begin, margin = (c - before[row]) * STRIDE, int(index.sizes[item])
                    near = own[max(0, begin - margin) : begin + 2 * STRIDE + margin]
                    shares = [np.isin(g, W.grams(near, width)).mean() if len(g) else 1.0 for width, g, _ in index.parts[item]]
                    if _held(index, item, near, shares, overlap):
                        found.append((part.first + row, index.ids[item], score, *shares))
                rows, ids, *numbers = list(zip(*found)) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()),
                     *(pa.array(x, pa.float64()) for x in numbers)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), search, _HITS)


def split_item(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item's text: the answer is the last sentence, or the last third of a single one."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    sentence = F.regexp_extract(clean, r"(?s)^.*[.?!]\s+(\S.*)$", 1)
    words = F.split(clean, r"\s+")
    third = F.array_join(F.slice(words, F.size(words) - F.floor(F.size(words) / 3).cast("int") + 1, F.size(words)), " ")
    answer = F.when(sentence != "", sentence).otherwise(third)
    return F.substr(clean, F.lit(1), F.length(clean) - F.length(answer)), answer


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """`(doc_id, item_id, score, question_overlap, answer_overlap)` for the texts of `docs (doc_id, text)` that hold an
    item of `items (item_id, question, answer)`.

    A pair is reported where a passage reaches `threshold` and both the question's and the
    answer's word triples stand near it to the part `overlap`, or the item's triples all together
    do; a part of one or two triples may instead miss one of its words, or as many as `overlap` lets.
    One row per pair, with the best score and the shares of the triples. Words are runs of letters and digits, A-Z in lower case.

    Null and empty texts hold nothing; an item without words is left out, one without an
    answer (or question) is judged by the other part. Null ids are reported as null.
    Repeated rows and items give one row per pair of ids. Without items or documents the
    result is empty. Other columns are ignored.
    """
    sequences = written(_sequences(items), "items")
    size = F.size("question") + F.size("answer")
    n_items, n_words = sequences.agg(F.count(F.lit(1)), F.sum(size)).first()
    if not n_items:
        return docs.sparkSession.createDataFrame([], _HITS)
    term = F.explode(F.array_union("question", "answer"))
    held = sequences.select(F.xxhash64("question", "answer").alias("at"), term.alias("term")).distinct()
    shards = -(-n_words // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("question", "answer"), F.lit(shards))
    numbers = held.groupBy("term").agg(F.count("at").alias("n"))
    parts = []
    for k in range(shards):
        own = sequences.where(shard == k)
        known = own.select(term.alias("term")).distinct().join(numbers, "term").collect()
        rows = own.collect()
        if rows:
            index = _built(rows, {r.term: r.n for r in known}, n_items, n_words / n_items)
            parts.append(_searched(docs, index, threshold, overlap))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    return found.groupBy("doc_id", "item_id").agg(
        *(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))

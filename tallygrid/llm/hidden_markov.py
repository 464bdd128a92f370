"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled forward scores.

Latent states follow each other by a transition matrix, and a state emits a word in two
steps: a *class* with the state's own chances, then the word by its smoothed share of
the class. The commonest words are classes of their own, the others share one by their
ending. So the model has a fixed size, while the word counts grow with the corpus and
stay in a table: a bounded part, the commonest words, goes to the tasks; what a text
holds beyond it meets the counts in a join.

Each Baum-Welch round reads the class sequences of all training texts; tasks run scaled
forward and backward passes over many texts side by side and add up expected starts,
transitions and emissions; one matrix per task meets per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow, written

STATES = 6
ROUNDS = 4
#: Words that are classes of their own, at most.
OWN_CLASSES = 2048
#: Classes of all other words, by their last two bytes.
ENDINGS = 1024
#: Commonest words whose counts go to the tasks, at most (16 bytes each).
FREQUENT = 1 << 18
SMOOTHED = 0.1
#: The end of a text, counted as a token.
END = np.uint64(0x5EED0E2D)
#: Longer texts are learnt from in pieces of so many tokens; they are scored whole.
PIECE = 4096
#: Tokens side by side in one pass.
SIDE_BY_SIDE = 1 << 19
_COUNTS_HELD = 1 << 21


def _endings(part: W.Words) -> np.ndarray:
    """A class number for each word by its last two bytes."""
    last = part.data[part.ends - 1].astype(np.uint64)
    before = np.where(part.ends - part.starts > 1, part.data[np.maximum(part.ends - 2, 0)], 0).astype(np.uint64)
    return (W.mix(last * np.uint64(256) + before, 61) % np.uint64(ENDINGS)).astype(np.int64)


def _counted(train: DataFrame) -> DataFrame:
    """`(name, ending, c)` of every token of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names, endings, times = (np.concatenate(x) for x in zip(*held))
            held.clear()
            found, first, inverse = np.unique(names, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [W.longs(found), pa.array(endings[first].astype(np.int32)),
                 pa.array(np.bincount(inverse, times).astype(np.int64))], ["name", "ending", "c"])

        for batch in batches:
            for part in W.words(batch.column(0), lower=True):
                found, first, times = np.unique(part.hashes, return_index=True, return_counts=True)
                held.append((found, _endings(part)[first], times))
                held.append((np.array([END]), np.array([-1]), np.array([part.last - part.first])))
            if sum(len(x[0]) for x in held) > _COUNTS_HELD:
                yield flush()
        if held:
            yield flush()

    return map_arrow(train.select("text"), count, "name bigint, ending int, c bigint").groupBy("name").agg(
        F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words from the least count on that leaves no more than `most`, to an eighth of a power of two."""
    power = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(power.alias("power")).agg(F.count("c").alias("n")).collect()  # some 500 rows at most
    total, cut = 0, None
    for power_, n in sorted(((r.power, r.n) for r in sizes), reverse=True):
        total += n
        if total > most:
            break
        cut = power_
    return counts.where(power >= F.lit(1 << 30 if cut is None else cut))


def _found(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in sorted `names`, and whether they are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


_TEXTS = ("doc_id bigint, held_out boolean, n_tokens bigint, log_count double, log_class double, n_known bigint, "
          "rare array<bigint>, times array<int>, classes binary")


def _encoded(docs: DataFrame, frequent: tuple, own: np.ndarray, class_log: np.ndarray) -> DataFrame:
    """Every text's sums over its frequent tokens, its other tokens, and its class sequence.

    `frequent` holds sorted names and counts, `own` the sorted names with classes of their own.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((*frequent, own, class_log))  # bounded by FREQUENT

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, own, class_log = shipped.value
        logs = np.log10(counts + SMOOTHED)
        at_end, end_found = _found(names, np.array([END]))
        end_class, end_own = _found(own, np.array([END]))
        end_class = int(end_class[0]) if end_own[0] else len(own)  # no training text at all: any class
        for batch in batches:
            for part in W.words(batch.column(2), lower=True):
                at, known = _found(names, part.hashes)
                value = np.concatenate(([0.0], np.cumsum(np.where(known, logs[at] if len(logs) else 0.0, 0.0))))
                cls, has_own = _found(own, part.hashes)
                cls = np.where(has_own, cls, len(own) + _endings(part)).astype(np.uint16)
                by_class = np.concatenate(([0.0], np.cumsum(class_log[cls])))
                hits = np.concatenate(([0], np.cumsum(known)))
                n = part.last - part.first
                log_count = value[part.at[1:]] - value[part.at[:-1]]
                n_known = hits[part.at[1:]] - hits[part.at[:-1]]
                log_class = by_class[part.at[1:]] - by_class[part.at[:-1]] + class_log[end_class]
                if end_found[0]:
                    log_count, n_known = log_count + logs[at_end[0]], n_known + 1
                rare, times, sequences = [], [], []
                for r in range(n):
                    s, e = part.at[r], part.at[r + 1]
                    name, time = np.unique(part.hashes[s:e][~known[s:e]], return_counts=True)
                    if not end_found[0]:
                        name, time = np.append(name, END), np.append(time, 1)
                    rare.append(name)
                    times.append(time)
                    sequences.append(cls[s:e].tobytes() + np.uint16(end_class).tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, n), batch.column(1).slice(part.first, n),
                    pa.array(np.diff(part.at).astype(np.int64) + 1), pa.array(log_count), pa.array(log_class),
                    pa.array(n_known.astype(np.int64)), W.lists(rare, pa.int64()), W.lists(times, pa.int32()),
                    pa.array(sequences, pa.binary()),
                ], [c.split()[0] for c in _TEXTS.split(", ")])

    return map_arrow(docs.select("doc_id", "held_out", "text"), encode, _TEXTS)


class Model:
    """Starts, transitions and emissions by state."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """States that hold on, with the classes' shares varied by a fixed random sequence."""
    varied = shares * np.exp(np.random.RandomState(6).standard_normal((states, len(shares))))
    moves = np.full((states, states), 0.06 / max(1, states - 1))
    np.fill_diagonal(moves, 0.94 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, varied / varied.sum(axis=1, keepdims=True))


def _groups(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length side by side: their numbers, lengths and a table with a row per step."""
    order = np.argsort([len(s) for s in sequences], kind="stable")[::-1]
    i = 0
    while i < len(order):
        n = max(1, min(512, SIDE_BY_SIDE // max(1, len(sequences[order[i]]))))
        ids = order[i : i + n]
        lengths = np.array([len(sequences[k]) for k in ids])
        steps = np.zeros((lengths[0], len(ids)), np.uint16)
        for column, k in enumerate(ids):
            steps[: len(sequences[k]), column] = sequences[k]
        yield ids, lengths, steps
        i += n


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each whole class sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    emits = np.ascontiguousarray(model.emits.T)
    for ids, lengths, steps in _groups(sequences):
        alive = np.searchsorted(-lengths, -np.arange(len(steps)), "left")  # lengths descend
        state = np.tile(model.start, (len(ids), 1))
        total = np.zeros(len(ids))
        for t, row in enumerate(steps):
            n = alive[t]
            state = (state[:n] @ model.moves if t else state[:n]) * emits[row[:n]]
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        out[ids] = total
    return out


def expected(model: Model, sequences: list[np.ndarray], classes: int) -> np.ndarray:
    """Expected counts: a row per state with its start, its moves, and its emissions."""
    k = len(model.start)
    out = np.zeros((k, 1 + k + classes))
    emits = np.ascontiguousarray(model.emits.T)
    for ids, lengths, steps in _groups(sequences):
        alive = np.searchsorted(-lengths, -np.arange(len(steps)), "left")
        ahead = np.zeros((len(steps), len(ids), k), np.float32)
        scales = np.ones((len(steps), len(ids)))
        state = np.tile(model.start, (len(ids), 1))
        for t, row in enumerate(steps):
            n = alive[t]
            state = (state[:n] @ model.moves if t else state[:n]) * emits[row[:n]]
            scales[t, :n] = state.sum(axis=1)
            state /= scales[t, :n, None]
            ahead[t, :n] = state
        back = np.ones((len(ids), k))
        moved = np.zeros((k, k))
        for t in range(len(steps) - 1, 0, -1):
            n = alive[t]
            seen = emits[steps[t, :n]] * back[:n] / scales[t, :n, None]
            moved += ahead[t - 1, :n].T @ seen
            back[:n] = seen @ model.moves.T
            ahead[t - 1, :n] *= back[:n]       # what each state holds of this step
        out[:, 1 : 1 + k] += moved * model.moves
        real = np.arange(len(steps))[:, None] < lengths[None, :]
        seen, held = steps[real], ahead[real]
        out[:, 0] += ahead[0, : alive[0]].sum(axis=0)
        for s in range(k):
            out[s, 1 + k :] += np.bincount(seen, held[:, s], classes)
    return out


def _rounds(texts: DataFrame, shares: np.ndarray, states: int, rounds: int) -> Model:
    model, classes = first_model(shares, states), len(shares)

    def part_of(model: Model):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, 1 + states + classes))
            for batch in batches:
                sequences = []
                for value in batch.column(0):
                    whole = np.frombuffer(value.as_buffer(), np.uint16)
                    sequences += [whole[k : k + PIECE] for k in range(0, len(whole), PIECE)]
                total += expected(model, sequences, classes)
            width = total.shape[1]
            at = pa.array(np.arange(0, total.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(states)), pa.ListArray.from_arrays(at, pa.array(total.ravel()))], ["state", "sums"])
        return part

    def add(rows: pa.Table) -> pa.Table:
        sums = np.sum(rows.column("sums").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), axis=0)
        return pa.table({"state": rows.column("state").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "state bigint, sums array<double>"
    for _ in range(rounds):
        sums = map_arrow(texts.where("NOT held_out").select("classes"), part_of(model), schema)
        rows = sorted(sums.groupBy("state").applyInArrow(add, schema).collect(), key=lambda r: r.state)  # one per state
        if not rows:
            break
        total = np.array([r.sums for r in rows])
        start, moves, emits = total[:, 0] + 0.01, total[:, 1 : 1 + states] + 0.01, total[:, 1 + states :] + 5 * shares
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
    return model


def hidden_markov_scores(docs: DataFrame, folds: int = 10, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` of every row of `docs (doc_id, text)`.

    Learns from the rows with crc32(doc_id as text) mod `folds` other than 0. Tokens are the
    words, A-Z in lower case, and one end. `base_score` sums log10 of the smoothed shares of
    the tokens, `score` is log10 of the model's probability of the whole text. Words that no
    training text has are smoothed alike in both.

    Null and empty texts are the end alone. A null doc_id counts as an empty text there and is
    held out. Repeated rows are scored each and learnt from as often as they come. Without
    training texts the counts are 0 and both scores rest on smoothing only. An empty table
    gives an empty result. Other columns are ignored.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select("doc_id", (fold == 0).alias("held_out"), "text")
    counts = written(_counted(rows.where("NOT held_out")), "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    whole = tokens + SMOOTHED * (kinds + 1)

    frequent = _commonest(counts, FREQUENT).select("name", "c").toPandas().sort_values("name", key=lambda x: x.astype("uint64"))
    frequent = (frequent["name"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(float))
    own = _commonest(counts, OWN_CLASSES).unionAll(counts.where(F.col("ending") < 0)).select("name").distinct().toPandas()
    own = np.sort(own["name"].to_numpy(np.int64).view(np.uint64))
    classes = len(own) + ENDINGS
    sums = np.zeros((classes, 2))
    # classes of endings: all their words but those with classes of their own
    by_ending = counts.where("ending >= 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count("c").alias("n")).collect()
    for r in by_ending:
        sums[len(own) + r.ending] = r.c, r.n
    own_rows = counts.join(F.broadcast(_names(docs, own)), "name").collect()  # OWN_CLASSES + 1 rows at most
    for r in own_rows:
        at = int(np.searchsorted(own, np.int64(r.name).view(np.uint64)))
        sums[at] = r.c, 1
        if r.ending >= 0:
            sums[len(own) + r.ending] -= r.c, 1
    masses = sums[:, 0] + SMOOTHED * (sums[:, 1] + 1)
    texts = written(
        _encoded(rows, frequent, own, np.log10(masses)).withColumn("uid", F.monotonically_increasing_id()), "texts")
    model = _rounds(texts, masses / masses.sum(), states, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(v.as_buffer(), np.uint16) for v in batch.column("classes")]
            kept = [c for c in batch.schema.names if c != "classes"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(forward(model, sequences), pa.float64())], [*kept, "log_states"])

    fields = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, log_count double, log_class double, n_known bigint"
    scored = map_arrow(texts.select(*[f.split()[0] for f in fields.split(", ")], "classes"), score, fields + ", log_states double")
    rare = texts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("name"), "x.times")
    c = F.coalesce("c", F.lit(0))
    beyond = rare.join(counts.select("name", "c"), "name", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(c + SMOOTHED)).alias("rare_log"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).cast("bigint").alias("rare_known"))
    words = F.col("log_count") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(beyond, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (words - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        (words - F.col("log_class") + F.col("log_states")).alias("score"))


def _names(docs: DataFrame, names: np.ndarray) -> DataFrame:
    import pandas as pd

    return docs.sparkSession.createDataFrame(pd.DataFrame({"name": names.view(np.int64)}), "name bigint")

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (hashed, by their share of the text), the shapes of its blank-separated tokens
(``Aa``, ``a#``, ``A!``; hashed), a few statistics of its structure (symbols, capitals, digits, repeated tokens and
lines, lengths) and its metadata: what ``n_chars`` says. With a weight w and a vector v of ``RANK`` numbers for each
feature, the logit is w0 + sum(w x) + the sum over all pairs of features of <v, v'> x x'. That sum is half of
(sum v x)^2 - sum (v x)^2, so scoring takes time linear in the number of features.

Training takes at most ``TRAIN_DOCS`` labelled documents, chosen by a hash of the id and cut into ``SHARDS`` groups.
In each of ``ROUNDS`` rounds every group starts from the same parameters and goes through its documents in its own
task; the driver averages ``SHARDS`` parameter vectors of fixed size. The documents themselves are not shuffled and
never reach the driver. Random numbers are seeded by round and group, so a task that runs again finds the same.

Defined results: a null text scores like an empty one; a null n_chars is a feature of its own; rows without an id are
scored, never learnt from; a document with several labels is of quality 1 if most say so (a tie: 1), labels other than
0 and 1 count for nothing; of several documents with one id one is learnt from, and equal rows get equal scores; texts
of any length count whole; without labels every score is 0.5; an empty table gives no rows. Only doc_id, text and
n_chars, and of the labels doc_id and quality, are read, whatever other columns there are.
"""

from __future__ import annotations

import pickle
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices

TRAIN_DOCS = 24_000
SHARDS, ROUNDS, EPOCHS, BATCH = 8, 4, 2, 64
RANK = 8
RATE, DECAY = 0.15, 1e-5
WORDS, SHAPES = 1 << 14, 1 << 10
STATISTICS = 14
WIDTH = WORDS + SHAPES + STATISTICS
THRESHOLD = 0.3
#: Tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
ROWS = "idx array<int>, x array<float>"

_RUNS = re.compile(r"(.)\1+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Tokens(dict):
    """Token -> its number; what a token looks like stands at that number."""

    def __init__(self):
        super().__init__()
        self.facts = np.zeros((6, 1 << 12), np.int32)

    def __missing__(self, token: str) -> int:
        number = len(self)
        if number == self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        word = "".join(c for c in token if c.isalnum()).lower()
        shape = "".join(
            "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token
        )
        letters = [c for c in token if c.isalpha()]
        self.facts[:, number] = (
            crc32(word.encode("utf-8", "surrogatepass")) % WORDS,
            crc32(_RUNS.sub(r"\1", shape).encode("utf-8", "surrogatepass")) % SHAPES,
            len(token),
            len(letters),
            sum(c.isupper() for c in letters),
            sum(c.isdigit() for c in token),
        )
        self[token] = number
        return number


def features(texts: list[str | None], n_chars: np.ndarray, known: Tokens):
    """(rows' ends, feature numbers, values) of some documents; ``n_chars`` is NaN where null."""
    if len(known) > REMEMBERED:
        known.clear()
    count, docs = [], len(texts)
    numbers, lines, distinct_lines = [], np.zeros(docs), np.zeros(docs)
    for i, text in enumerate(texts):
        tokens = (text or "").split()
        count.append(len(tokens))
        numbers.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
        parts = (text or "").split("\n")
        lines[i], distinct_lines[i] = len(parts), len(set(parts))
    n = np.array(count, np.int64)
    token = np.concatenate([np.zeros(0, np.int64), *numbers])
    doc = np.repeat(np.arange(docs), n)
    word, shape, length, letters, upper, digits = known.facts
    least_one = np.maximum(n, 1)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, docs) / of

    pair, times = np.unique(doc * max(len(known), 1) + token, return_counts=True)
    of, own = np.divmod(pair, max(len(known), 1))
    cell, at = np.unique(of * WIDTH + word[own], return_inverse=True)
    amount = np.sqrt(np.bincount(at, times, len(cell)))
    norm = np.sqrt(np.bincount(cell // WIDTH, amount**2, docs))
    amount = amount / norm[cell // WIDTH]
    shapes = np.bincount(doc * SHAPES + shape[token], minlength=docs * SHAPES)
    some = np.flatnonzero(shapes)
    shape_cell = some // SHAPES * WIDTH + WORDS + some % SHAPES
    shape_share = shapes[some] / least_one[some // SHAPES]

    chars = np.maximum(np.bincount(doc, length[token], docs), 1)
    letter = np.bincount(doc, letters[token], docs)
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.bincount(of, minlength=docs)
    known_chars = ~np.isnan(n_chars)
    statistics = np.stack(
        [
            1 - letter / chars - share(digits[token], chars),  # symbols
            np.bincount(doc, upper[token], docs) / np.maximum(letter, 1),
            share(digits[token], chars),
            share(again, least_one),  # a token after itself
            1 - kinds / least_one,  # tokens seen before
            1 - distinct_lines / lines,
            np.log1p(n) / 10,
            np.log1p(lines) / 10,
            chars / least_one / 20,
            share(letters[token] == 0, least_one),
            share((upper[token] > 1) & (upper[token] == letters[token]), least_one),
            (n == 0).astype(float),
            np.log1p(np.where(known_chars, np.maximum(n_chars, 0), 0)) / 10,
            (~known_chars).astype(float),
        ],
        axis=1,
    )
    fixed = np.arange(docs)[:, None] * WIDTH + WORDS + SHAPES + np.arange(STATISTICS)
    cells = np.concatenate([cell, shape_cell, fixed.ravel()])
    values = np.concatenate([amount, shape_share, statistics.ravel()])
    order = np.argsort(cells, kind="stable")
    cells, values = cells[order], values[order]
    ends = np.searchsorted(cells, np.arange(1, docs + 1) * WIDTH)
    return ends, cells % WIDTH, values


class Machine:
    """Weights and factors; all sums are over the features that a document has."""

    def __init__(self, seed: int = 0):
        self.w0, self.w = 0.0, np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (WIDTH, RANK))

    def _sums(self, ends, idx, x):
        starts = np.concatenate([[0], ends[:-1]])  # every document has its statistics, so no row is empty
        vx = self.v[idx] * x[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return starts, vx, total, self.w0 + np.add.reduceat(self.w[idx] * x, starts) + pairs

    def logits(self, ends, idx, x) -> np.ndarray:
        return self._sums(ends, idx, x)[3] if len(ends) else np.zeros(0)

    def learn(self, ends, idx, x, y, rng) -> None:
        """``EPOCHS`` passes in random order with steps scaled for each parameter (Adagrad)."""
        rows = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        seen0, seen, seen_v = 1.0, np.ones(WIDTH), np.ones((WIDTH, RANK))
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(rows), -(-rows // BATCH)):
                size = ends[batch] - starts[batch]
                stop = np.cumsum(size)
                at = np.repeat(starts[batch] - stop + size, size) + np.arange(stop[-1])
                i, value = idx[at], x[at]
                _, vx, total, logit = self._sums(stop, i, value)
                wrong = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[batch]
                each = np.repeat(wrong, size)
                own, where = np.unique(i, return_inverse=True)
                step = np.bincount(where, each * value, len(own)) + DECAY * self.w[own]
                slope = each[:, None] * value[:, None] * (np.repeat(total, size, axis=0) - vx)
                step_v = np.stack([np.bincount(where, slope[:, f], len(own)) for f in range(RANK)], axis=1) + DECAY * self.v[own]
                seen0 += wrong.sum() ** 2
                seen[own] += step**2
                seen_v[own] += step_v**2
                self.w0 -= RATE * wrong.sum() / np.sqrt(seen0)
                self.w[own] -= RATE * step / np.sqrt(seen[own])
                self.v[own] -= RATE * step_v / np.sqrt(seen_v[own])


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The feature lists of Arrow rows, one after the other, with the rows' ends."""
    ends = np.cumsum(batch.column("idx").combine_chunks().value_lengths().to_numpy())
    idx, x = (batch.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("idx", "x"))
    return ends, idx.astype(np.int64), x.astype(float)


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` (its columns ``text`` and ``n_chars`` and any others) with ``idx`` and ``x`` in place of the text."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def make(batches):
        known = Tokens()
        for batch in slices(batches):
            n_chars = pa.compute.cast(batch.column("n_chars"), pa.float64()).to_numpy(zero_copy_only=False)
            ends, idx, x = features(batch.column("text").to_pylist(), n_chars, known)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (idx.astype(np.int32), x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + lists, [*others, "idx", "x"])

    return docs.select(*others, "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(make, f"{fields}, {ROWS}")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(shard, turn, y, idx, x) of at most about ``most`` labelled documents, stored.

    The chosen ids, bounded by ``most``, are sent to the documents, so no text is shuffled that is not learnt from.
    """
    said = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((2 * F.sum("quality") >= F.count("*")).cast("int").alias("y"))
    )
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    said = cut_lineage(said, "labels")
    chosen = said.where(spin < min(1.0, most / max(said.count(), 1)))
    texts = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    own = texts.join(F.broadcast(chosen), "doc_id")
    one = own.groupBy("doc_id", "y").agg(
        F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("d")
    )
    turn = F.xxhash64("doc_id", F.lit("turn"))
    rows = one.select(F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn"), "y", "d.*")
    return cut_lineage(with_features(rows), "quality-features")


def _learner(sent, turn: int):
    """What a shard does in a round: from the common parameters through its own documents."""

    def learn(table):
        table = table.sort_by("turn")
        own = pickle.loads(pickle.dumps(sent.value))  # a worker may serve several shards
        rng = np.random.default_rng([turn, table.column("shard")[0].as_py()])
        own.learn(*_flat(table), table.column("y").to_numpy().astype(float), rng)
        return pa.table({"n": pa.array([table.num_rows], pa.int64()), "machine": pa.array([pickle.dumps(own)], pa.binary())})

    return learn


def train(rows: DataFrame) -> Machine:
    """Rounds of learning in each shard and averaging over the shards."""
    machine = Machine()
    for turn in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(machine)
        learnt = rows.groupBy("shard").applyInArrow(_learner(sent, turn), "n long, machine binary").collect()
        sent.unpersist()
        whole = sum(r["n"] for r in learnt)
        if not whole:
            machine.v[:] = 0
            return machine
        # in a fixed order, so that the sums do not depend on which task ended first
        parts = [(r["n"] / whole, pickle.loads(r["machine"])) for r in sorted(learnt, key=lambda r: bytes(r["machine"]))]
        machine = Machine()
        machine.w0 = sum(share * m.w0 for share, m in parts)
        machine.w = sum(share * m.w for share, m in parts)
        machine.v = sum(share * m.v for share, m in parts)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the text is read once, features are not stored."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches):
        known = Tokens()
        for batch in slices(batches):
            n_chars = pa.compute.cast(batch.column("n_chars"), pa.float64()).to_numpy(zero_copy_only=False)
            logit = sent.value.logits(*features(batch.column("text").to_pylist(), n_chars, known))
            value = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), value], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    return columns.mapInArrow(judge, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from the labels of documents that are not held out."""
    machine = train(training_rows(docs, labels, most))
    return score(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

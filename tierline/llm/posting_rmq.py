"""Ranked lexical search: best-first document intervals under range-maximum bounds.

The documents' words are counted where they are read and stored as a small index: id, length, and for each asked term
its occurrences. The corpus statistics (documents, words, documents of each term) are aggregates over that index.

The search runs in each task over shards of the index. A shard numbers its documents so that like ones are neighbours
(by their rarest asked term, then length), sorts its postings by term and document, and lays a sparse table over each
posting list, so that the greatest impact in any range of a list, and where it stands, is two look-ups. For an interval
of documents the sum of an item's range maxima bounds every score in it. The search takes the intervals with the
greatest bounds, splits each at the document of greatest impact, whose own interval of one has its exact score as its
bound, and drops what cannot reach the item's ``k`` best. All items advance together, so one step is a few array
operations. Nothing is dropped that could rank: ties go to the smaller id, and an interval whose bound equals the k-th
score stays while it holds a smaller id.

Shares of the documents (by a hash of the row) are searched one after the other, ``SHARES`` of them: the k-th score of
what was searched is a floor for the rest, so the bulk of the tasks returns little. What a task returns is at most k
rows an item. Items go to the workers in blocks of ``BLOCK_BYTES`` of text, one index for each block.

Defined results: null and empty texts have no terms and never rank; an item without terms has no rows; the rows of one
item_id are one item with the terms of all its texts (a null item_id is an item); each document row ranks for itself,
also one that repeats another or has a null id (null ids after all others); texts of any length count whole; with no
document or no item there are no rows. Only doc_id, text and item_id are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices
from .suffix_match import split_words

K = 50
BLOCK_BYTES = 8 << 20
#: Postings of a shard; its tables take about 100 bytes for each.
SHARD_POSTINGS = 1 << 20
#: Cumulated shares of the documents after each search.
SHARES = (1 / 1024, 1 / 32, 1.0)
#: Intervals of an item that one step splits.
BEAM = 128
LAST = np.iinfo(np.int64).max

INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


class Items:
    """A block of items as lists of term numbers."""

    def __init__(self, ids: list[str | None], texts: list[list[str | None]]):
        self.ids, self.vocabulary = ids, {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        terms = [sorted({number(w) for text in own for w in split_words(text)}) for own in texts]
        self.size = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.terms = np.array([t for own in terms for t in own], np.int64)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i").toLocalIterator()
    ids, texts, size = [], [], 0
    for r in rows:
        if not ids or ids[-1] != r.i:
            if size > block_bytes:
                yield Items(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(r.i)
            texts.append([])
        texts[-1].append(r.text)
        size += len(r.text or "")
    if ids:
        yield Items(ids, texts)


def index(docs: DataFrame, items: Items) -> DataFrame:
    """``INDEX`` rows: every document that has words, with the occurrences of the terms that are asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches):
        known = sent.value
        get, width = known.get, len(known) + 1
        for batch in slices(batches):
            lengths, codes = [], []
            for text in batch.column("text").to_pylist():
                words = split_words(text)
                lengths.append(len(words))
                codes.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            n = np.array(lengths, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            code = np.concatenate([np.zeros(0, np.int64), *codes])
            pair, tf = np.unique((row * width + code)[code >= 0], return_counts=True)
            kept = np.flatnonzero(n)
            ends = np.searchsorted(pair, np.append(kept, len(n)) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % width, tf)]
            ids = batch.column("doc_id").take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[kept]), *lists], ["doc_id", "n", "terms", "tfs"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(count, INDEX)


class Corpus:
    """What the scores take from the whole corpus: its size and the weight of each term."""

    def __init__(self, documents: int, words: int, df: np.ndarray):
        self.documents, self.words = documents, words
        self.weights = np.array(
            [math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * n + 1))) for n in df.tolist()], np.int64
        )

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        # n * documents may exceed a long: whole numbers of any size, one for each length
        lengths, at = np.unique(n, return_inverse=True)
        m = np.array([100 - 50 + (50 * x * self.documents) // self.words for x in lengths.tolist()], np.int64)[at]
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def corpus(stored: DataFrame, terms: int) -> Corpus:
    """Statistics of a stored index; one number for each asked term comes to the driver."""
    total = stored.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    df = np.zeros(terms, np.int64)
    for r in stored.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    return Corpus(total["documents"], total["words"] or 0, df)


class _Range:
    """Sparse table: where the greatest of ``values`` stands in any range. A range never leaves its list."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.table = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            below = self.table[-1]
            here = below.copy()
            a, b = below[:-width], below[width:]
            here[:-width] = np.where(values[a] >= values[b], a, b)
            self.table.append(here)
            width *= 2
        self.flat = np.concatenate(self.table) if len(values) else np.zeros(0, np.int32)

    def best(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the maximum of each non-empty range [first, end)."""
        level = np.frexp((end - first).astype(float))[1] - 1
        base = level * len(self.values)
        a, b = self.flat[base + first], self.flat[base + end - (1 << level)]
        return np.where(self.values[a] >= self.values[b], a, b)


def _keep_best(item, score, doc, k):
    """The ``k`` best of each item, ordered."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return item[place < k], score[place < k], doc[place < k]


class Shard:
    """Documents with their posting lists and range-maximum tables."""

    def __init__(self, known: Corpus, ids, n, sizes, terms, tfs):
        row = np.repeat(np.arange(len(ids)), sizes)
        rarest = np.full(len(ids), len(known.weights), np.int64)
        by_weight = np.empty(len(known.weights), np.int64)
        by_weight[np.argsort(-known.weights, kind="stable")] = np.arange(len(known.weights))
        np.minimum.at(rarest, row, by_weight[terms])
        order = np.lexsort((ids, n, rarest))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.docs = ids[order], len(ids)
        key = terms * self.docs + place[row]
        by_key = np.argsort(key, kind="stable")
        self.key = key[by_key]
        impacts = known.impacts(terms, tfs, n[row])[by_key]
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        self.lists = _Range(impacts, longest)
        self.smallest = _Range(-self.ids, self.docs)

    def bound(self, lo, size, a, b):
        """For intervals of documents, given the filled ranges [a, b) of their terms' lists (``size`` of them each): the
        sum of the ranges' maxima, and the document where the greatest of them stands."""
        first = np.cumsum(size) - size
        at = self.lists.best(a, b)
        value = self.lists.values[at]
        total, top, split = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), lo.copy()
        filled = np.flatnonzero(size)
        if len(filled):
            total[filled] = np.add.reduceat(value, first[filled])
            top[filled] = np.maximum.reduceat(value, first[filled])
        of = np.repeat(np.arange(len(size)), size)
        is_top = np.flatnonzero(value == top[of])[::-1]
        split[of[is_top]] = self.key[at[is_top]] % self.docs
        return total, split

    def search(self, items: Items, floor: np.ndarray, best, k: int):
        """``best`` (item, score, doc; ordered) with this shard's documents: the ``k`` best with a score of ``floor`` or more."""
        item = np.arange(len(items.size))
        a = np.searchsorted(self.key, items.terms * self.docs)
        b = np.searchsorted(self.key, (items.terms + 1) * self.docs)
        of = np.repeat(item, items.size)[b > a]
        a, b = a[b > a], b[b > a]
        pool = _Pool(a, b)
        size = np.bincount(of, minlength=len(item))
        start = np.cumsum(size) - size
        lo, hi = np.zeros(len(item), np.int64), np.full(len(item), self.docs)
        bound, split = self.bound(lo, size, a, b)
        while True:
            least, last = self._threshold(floor, best, k)
            open_ = bound >= least[item]
            level = np.flatnonzero(open_ & (bound == least[item]) & (last[item] < LAST))
            open_[level] = -self.smallest.values[self.smallest.best(lo[level], hi[level])] < last[item[level]]
            item, lo, hi, bound, split, start, size = (x[open_] for x in (item, lo, hi, bound, split, start, size))
            if not len(item):
                return best
            order = np.lexsort((-bound, item))
            place = np.empty(len(item), np.int64)
            place[order] = np.arange(len(item)) - np.searchsorted(item[order], item[order])
            now, later = place < BEAM, place >= BEAM
            # where the splitting document stands in each list: before it, itself, after it
            a, b = pool.take(start[now], size[now])
            of = np.repeat(np.arange(now.sum()), size[now])
            want = self.key[a] // self.docs * self.docs + split[now][of]
            c = np.searchsorted(self.key, want)
            d = c + (self.key[np.minimum(c, len(self.key) - 1)] == want)
            # the document itself: the sum of its impacts is its score
            own = np.flatnonzero(d > c)
            score = np.zeros(now.sum(), np.int64)
            np.add.at(score, of[own], self.lists.values[c[own]])
            hit = np.flatnonzero((score > 0) & (score >= least[item[now]]))
            found = (item[now][hit], score[hit], self.ids[split[now][hit]])
            best = _keep_best(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
            parts = []
            for low, high, from_, to in ((lo[now], split[now], a, c), (split[now] + 1, hi[now], d, b)):
                some = to > from_
                width = np.bincount(of[some], minlength=len(low))
                sums, at = self.bound(low, width, from_[some], to[some])
                # an interval without a posting scores nothing
                kept = (width > 0) & (sums >= least[item[now]])
                flat = some.nonzero()[0][kept[of[some]]]
                begin = pool.put(from_[flat], to[flat])
                parts.append([x[kept] for x in (item[now], low, high, sums, at)] + [begin + np.cumsum(width[kept]) - width[kept], width[kept]])
            rest = [x[later] for x in (item, lo, hi, bound, split, start, size)]
            item, lo, hi, bound, split, start, size = (np.concatenate(x) for x in zip(rest, *parts, strict=True))

    @staticmethod
    def _threshold(floor, best, k):
        """Of each item the score that is needed to rank, and below which id it is enough to reach it."""
        least, last = floor.copy(), np.full(len(floor), LAST)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) >= k)
        kth = np.searchsorted(best[0], full) + k - 1
        higher = best[1][kth] >= floor[full]
        least[full[higher]], last[full[higher]] = best[1][kth[higher]], best[2][kth[higher]]
        return least, last


class _Pool:
    """List ranges of all intervals of a search, one after the other."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.ranges, self.used = np.empty((2, max(1024, 4 * len(a))), np.int32), 0
        self.put(a, b)

    def put(self, a: np.ndarray, b: np.ndarray) -> int:
        begin, self.used = self.used, self.used + len(a)
        if self.used > self.ranges.shape[1]:
            grown = np.empty((2, 2 * self.used), np.int32)
            grown[:, :begin] = self.ranges[:, :begin]
            self.ranges = grown
        self.ranges[:, begin : self.used] = a, b
        return begin

    def take(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        flat = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.ranges[:, flat].astype(np.int64)


def shards(batches, known: Corpus, postings: int) -> Iterator[Shard]:
    held, size = [], 0

    def made():
        ids = np.concatenate([b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False) for b in held])
        n = np.concatenate([b.column(1).to_numpy() for b in held])
        sizes = np.concatenate([b.column(2).value_lengths().to_numpy() for b in held])
        terms, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]).astype(np.int64) for c in (2, 3))
        return Shard(known, ids, n, sizes, terms, tfs)

    for batch in slices(batches, 2048):
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= postings:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _search(stored: DataFrame, items: Items, known: Corpus, floor: np.ndarray, k: int, postings: int) -> DataFrame:
    sent = stored.sparkSession.sparkContext.broadcast((items, known, floor))

    def look(batches):
        items, known, floor = sent.value
        best = (np.zeros(0, np.int64),) * 3
        for shard in shards(batches, known, postings):
            best = shard.search(items, floor, best, k)
        item, score, doc = best
        ids = pa.array(doc, mask=doc == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(score)], ["item", "doc_id", "score"])

    return stored.select("doc_id", "n", "terms", "tfs").mapInArrow(look, FOUND)


def _ranks(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item; first among the rows of each of many parts, so that no task ranks what all returned."""
    order = "ORDER BY score DESC, doc_id ASC NULLS LAST"
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = parts.withColumn("r", F.expr(f"row_number() OVER (PARTITION BY item, part {order})")).where(f"r <= {k}")
    return few.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY item {order})")).where(f"rank <= {k}").drop("part", "r")


def top_documents(
    docs: DataFrame, benchmark: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, postings: int = SHARD_POSTINGS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above 0."""
    spark = docs.sparkSession
    id_type, doc_type = benchmark.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    out = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    for items in item_blocks(benchmark, block_bytes):
        stored = cut_lineage(index(docs, items), "postings")
        known = corpus(stored, len(items.vocabulary))
        floor = np.ones(len(items.ids), np.int64)
        turn = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        best, before = None, 0.0
        for share in SHARES:
            part = stored.where((turn >= before) & (turn < share))
            found = _search(part, items, known, floor, k, postings)
            best = cut_lineage(_ranks(found if best is None else best.drop("rank").unionByName(found), k), "ranked-documents")
            for r in best.where(f"rank = {k}").toLocalIterator():
                floor[r["item"]] = r["score"]
            before = share
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id string")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out.select(F.col("item_id").cast(id_type).alias("item_id"), "rank", F.col("doc_id").cast(doc_type).alias("doc_id"), "score")

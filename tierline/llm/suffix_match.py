"""Benchmark decontamination by suffix arrays over the training documents.

The documents are cut into shards, each a run of whole documents of one task with about ``SHARD_WORDS`` words. A
shard's words become numbers (words that no test item has are all 0, which matches nothing) and its suffix array is
sorted by prefix doubling. Every suffix of every test item is then searched in the array: the interval of training
suffixes that begin with its first d words is narrowed by binary search, for all suffixes at once, until it is empty.
The interval at the window's length holds all verbatim occurrences and their places; where a place leaves its interval,
its longest match ends. Documents stay where they were
read; nothing is shuffled.

Test items go to the workers in blocks of at most ``BLOCK_BYTES``; with more than one block the documents pass through
once per block and carry their hits along.

Defined results: a null text has no words; a null or empty item matches nothing; an item whose id is null contaminates
but is not counted or named; repeated items count once by id; repeated documents are judged each for itself; texts of
any length count whole, and one word repeated in both costs no more than other text; empty tables give no rows or no
hits. Only doc_id, text and item_id are read; a column ``__hits`` of the documents is taken for the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20
#: Lower-cases A to Z and turns every byte that is not of a word into a blank.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class TestItems:
    """The words of all items as one array of numbers, with a window at each place where one begins."""

    __test__ = False

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        codes, start_item, lengths, left = [], [], [], []
        for item, text in rows:
            words = split_words(text)
            codes += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            start_item += [item] * len(words)
            n = len(words)
            left += range(n, 0, -1)
            lengths += [min(window, n) if n - i >= min(window, n) else 0 for i in range(n)]
        self.codes = np.array(codes, np.int64)
        self.items = np.array(start_item, object)
        self.window = np.array(lengths, np.int64)  # 0: no window begins here
        self.left = np.array(left, np.int64)  # words up to the item's end
        #: Whether one word, repeated, fills the item from here on.
        self.level = self.left == 1
        for i in range(len(codes) - 2, -1, -1):
            if left[i] > 1:
                self.level[i] = codes[i] == codes[i + 1] and self.level[i + 1]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of the words that are not 0, sorted by the words that follow, up to ``depth``; 0 ends a comparison."""
    places = np.flatnonzero(codes)
    if not len(places):
        return places
    bits = int(codes.max()).bit_length()
    known = max(1, min(62 // bits, depth))
    padded = np.concatenate([codes, np.zeros(known, codes.dtype)])
    key = padded[: len(codes)].copy()
    for k in range(1, known):
        key = (key << bits) | padded[k : k + len(codes)]
    rank = np.zeros(len(codes), np.int64)
    while True:
        order = np.argsort(key[places], kind="stable")
        array = places[order]
        steps = np.concatenate([[1], key[array][1:] != key[array][:-1]])
        rank[array] = np.cumsum(steps)
        if known >= depth or int(rank[array[-1]]) == len(array):
            return array
        later = np.concatenate([rank, np.zeros(known, np.int64)])[known : known + len(codes)]
        key = rank * (len(array) + 1) + later
        known *= 2


def _flat(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    size = hi - lo
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Search:
    """Which suffixes of the test items occur in a shard, and where.

    All suffixes go forward one word at a time. At one depth the intervals of different words are apart, so equal
    questions (one interval, one next word) are asked once, each place is marked once for each depth at which a window
    ends, and a place's longest match is set when its interval is left, once for each interval it was in.
    """

    def __init__(self, codes: np.ndarray, array: np.ndarray, tests: TestItems):
        self.padded, self.array = np.concatenate([codes, np.zeros(1, codes.dtype)]), array
        #: Windows that begin less those that end at each place; words of the longest match from each place on.
        self.edges, self.reach = np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes) + 1, np.int64)
        #: (places, items) of each interval that a window reaches.
        self.windows: list[tuple[np.ndarray, set]] = []
        self.asked = 0
        self._run(tests)

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, d: int, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            at = self.padded[np.minimum(self.array[mid] + d, len(self.padded) - 1)]
            up = at <= word[open_] if right else at < word[open_]
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        return low

    def _run(self, tests: TestItems) -> None:
        alive = np.flatnonzero(tests.window)
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.array))
        words, d = int(tests.codes.max(initial=0)) + 1, 0
        while len(alive):
            _, one, group = np.unique(lo * words + tests.codes[alive + d], return_index=True, return_inverse=True)
            self.asked += len(one)
            word = tests.codes[alive[one] + d]
            first = self._bound(lo[one], hi[one], word, d, False)
            end = self._bound(first, hi[one], word, d, True)
            # places whose match ends here, of suffixes past their window; d only grows, so the last value is the longest
            done = np.unique(group[tests.window[alive] <= d])
            behind = one[done]
            self.reach[self.array[_flat(lo[behind], first[done])]] = d
            self.reach[self.array[_flat(end[done], hi[behind])]] = d
            d += 1
            lo, hi = first[group], end[group]
            alive, lo, hi = (x[hi > lo] for x in (alive, lo, hi))
            self._mark(alive, lo, hi, d, tests)
            ends = tests.left[alive] == d
            own, at = np.unique(lo[ends], return_index=True)
            self.reach[self.array[_flat(own, hi[ends][at])]] = d
            alive, lo, hi = (x[~ends] for x in (alive, lo, hi))
            # of suffixes that go on with one word up to their items' ends, in one interval, the longest tells of all
            same = np.zeros(len(alive), bool)
            same[1:] = (np.diff(alive) == 1) & (np.diff(lo) == 0) & tests.level[alive[:-1]] & (tests.window[alive[1:]] <= d)
            alive, lo, hi = (x[~same] for x in (alive, lo, hi))

    def _mark(self, alive: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, tests: TestItems) -> None:
        whole = np.flatnonzero(tests.window[alive] == d)
        if not len(whole):
            return
        own, at, group = np.unique(lo[whole], return_index=True, return_inverse=True)
        items: list[set] = [set() for _ in own]
        for g, s in zip(group.tolist(), alive[whole].tolist(), strict=True):
            items[g].add(tests.items[s])
        for a, b, named in zip(own.tolist(), hi[whole][at].tolist(), items, strict=True):
            places = self.array[a:b]
            self.edges[places] += 1
            self.edges[places + d] -= 1
            self.windows.append((places, named))


def match_shard(texts: list[str | None], tests: TestItems) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set], list[tuple[int, int]]]:
    """For each text: its number of words, the [from, to) that windows cover, their items, and (words, place) of the
    longest verbatim match."""
    split = [split_words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    codes = np.zeros(int(starts[-1]), np.int64)
    get = tests.vocabulary.get
    for words, at in zip(split, starts, strict=False):
        codes[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    longest = [(0, -1) for _ in texts]
    if not len(tests.codes):
        return counts, spans, items, longest
    found = Search(codes, suffix_array(codes, int(tests.left.max())), tests)
    for places, named in found.windows:
        for doc in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
            items[doc] |= named
    covered = np.concatenate([[0], np.cumsum(found.edges) > 0, [0]])
    begins, ends = (np.flatnonzero(np.diff(covered) == x) for x in (1, -1))
    docs = np.searchsorted(starts, begins, side="right") - 1
    for doc, a, b in zip(docs.tolist(), begins.tolist(), ends.tolist(), strict=True):
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    for doc in np.unique(docs).tolist():
        own = found.reach[starts[doc] : starts[doc] + counts[doc]]
        longest[doc] = int(own.max()), int(own.argmax())
    return counts, spans, items, longest


def _shards(batches, column: str, words: int):
    """Lists of batches with about ``words`` words' worth of text."""
    held, size = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            n = sum(map(len, filter(None, batch.column(column).to_pylist()))) // 5
            if held and size + n > words:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestItems]:
    rows, size = [], 0
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), "text")
    for r in items.toLocalIterator():
        if rows and size + len(r.text) > block_bytes:
            yield TestItems(rows, window)
            rows, size = [], 0
        rows.append((r.i, r.text))
        size += len(r.text)
    yield TestItems(rows, window)


test_blocks.__test__ = False


def with_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with ``__hits``, one struct for each row.

    words: number of words; spans: flat [from, to) word places that windows cover, in order and apart; items: ids whose
    windows occur; longest, longest_at: the longest verbatim match in words, and the word where it begins (-1: none).
    """
    out = docs.withColumn(
        "__hits",
        F.expr("named_struct('words', 0L, 'spans', array_repeat(0L, 0), 'items', array_repeat('', 0), 'longest', 0L, 'longest_at', -1L)"),
    )
    for number, tests in enumerate(test_blocks(benchmark, window, block_bytes)):
        if number:
            from .common import cut_lineage

            out = cut_lineage(out, "hits")
        out = _one_block(out, tests, shard_words)
    return out


def _one_block(docs: DataFrame, tests: TestItems, shard_words: int) -> DataFrame:
    sent, schema = docs.sparkSession.sparkContext.broadcast(tests), docs.schema

    def find(batches):
        known = sent.value
        for shard in _shards(batches, "text", shard_words):
            matched = match_shard(shard.column("text").to_pylist(), known)
            hits = []
            for old, n, found, ids, (longest, at) in zip(shard.column("__hits").to_pylist(), *matched, strict=True):
                spans: list[int] = []
                before = list(zip(old["spans"][::2], old["spans"][1::2], strict=True))
                for a, b in sorted(before + found):
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b)
                    else:
                        spans += [a, b]
                if old["longest"] >= longest:
                    longest, at = old["longest"], old["longest_at"]
                hits.append(
                    {"words": int(n), "spans": spans, "items": sorted((ids - {None}) | set(old["items"])), "longest": longest, "longest_at": at}
                )
            at = shard.schema.get_field_index("__hits")
            column = pa.array(hits, shard.schema.field(at).type)
            yield from shard.set_column(at, shard.schema.field(at), column).to_batches()

    return docs.mapInArrow(find, schema)


def score(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at) for each row of ``docs``."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.expr("aggregate(sequence(0, size(__hits.spans) div 2), 0L, (a, i) -> a + coalesce(get(__hits.spans, 2 * i + 1) - get(__hits.spans, 2 * i), 0L))")
    return found.withColumn("n_hit", hit).select(
        "doc_id",
        F.col("__hits.words").alias("n_words"),
        "n_hit",
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("__hits.longest").alias("longest"),
        F.col("__hits.longest_at").alias("longest_at"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    return with_hits(docs, benchmark, **options).where("size(__hits.spans) = 0").drop("__hits")


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()

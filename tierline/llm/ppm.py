"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3. In a context seen n times with t different next bytes, a byte
seen c times has probability c / (n + t), and the escape to the next shorter context t / (n + t); a context that a
language never saw costs nothing to leave, and below order 0 every byte has 1/256. The trees are frozen after
training, so the exact code length of a byte after a context is a constant, and a text's code length is a sum of such
constants over its distinct grams. The language with the shortest code wins.

Training learns from a bounded sample: about ``TRAIN_DOCS`` documents of each language, chosen by a hash of the text,
whole. Every gram of the sample counts, also one seen once, in every language. Orders 0 and 1 are one dense table
(byte before, byte) -> bits of each language; orders 2 and 3 hold only what each language saw, so what is sent to the
workers grows with the distinct grams of the sample and not with contexts x bytes x languages.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when nothing was learned; ties go
to the smaller language name. Repeated documents get the same answer. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

ORDER = 3
TRAIN_DOCS = 2000
PAD = 256  # stands before the first byte
BASE = 257
#: Bytes of a text scored at once.
PIECE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Remainder 2 of crc32 of the id as text by 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    b = np.concatenate([np.full(ORDER, PAD, np.int64), np.frombuffer(data, np.uint8)])
    return ((b[:-3] * BASE + b[1:-2]) * BASE + b[2:-1]) * BASE + b[3:]


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text): counted in each task first, then summed."""

    def count(batches):
        held: dict[str, list] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                gram, n = np.unique(_grams(text.encode("utf-8", "surrogatepass")), return_counts=True)
                held.setdefault(lang, []).append((gram, n))
                if len(held[lang]) >= 256:
                    held[lang] = [_add(held[lang])]
        for lang, parts in held.items():
            gram, n = _add(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n})

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts]).astype(float), len(gram)).astype(np.int64)


class _Sparse:
    """key -> (language, bits) entries, for the keys and languages that have one."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, bits: np.ndarray):
        order = np.lexsort((lang, key))
        self.keys, starts = np.unique(key[order], return_index=True)
        self.starts = np.append(starts, len(key))
        self.lang, self.bits = lang[order].astype(np.int32), bits[order].astype(np.float32)

    def add(self, asked: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Adds to each language's ``total`` its bits of the ``asked`` keys, ``n`` times each."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        known = self.keys[at] == asked
        at, n = at[known], n[known]
        size = self.starts[at + 1] - self.starts[at]
        place = np.repeat(self.starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total += np.bincount(self.lang[place], self.bits[place] * np.repeat(n, size).astype(float), len(total))


class ContextTrees:
    """The frozen code lengths of all languages."""

    def __init__(self, counts: pd.DataFrame, max_contexts: int | None = None):
        """``counts``: (lang, gram, n). ``max_contexts``: only so many contexts of order 3, the most frequent; default all."""
        self.langs = sorted(counts["lang"].unique())
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(float)
        lang = np.searchsorted(np.array(self.langs, object), counts["lang"].to_numpy(object)) if len(counts) else np.zeros(0, int)
        seen = np.unique(gram % BASE)
        #: Code of each byte: its place among the bytes seen; the last two codes are the pad and all other bytes.
        self.m = m = len(seen) + 2
        self.code = np.full(BASE, m - 1, np.int64)
        self.code[seen] = np.arange(len(seen))
        self.code[PAD] = m - 2
        width = len(self.langs)
        #: Bits of (byte before, byte) in each language by orders 0 and 1.
        self.bits = np.full((m * m, width), 8, np.float32)
        #: For orders 2 and 3: what leaving a context costs, and what a byte seen there costs less than leaving it.
        self.leave: list[_Sparse] = []
        self.gain: list[_Sparse] = []
        if not width:
            return
        key = np.zeros(len(gram), np.int64)
        for back in range(ORDER, -1, -1):
            key = key * m + self.code[gram // BASE**back % BASE]
        by_lang = np.argsort(lang, kind="stable")
        ends = np.cumsum(np.bincount(lang, minlength=width))
        parts = [self._tree(key[own], n[own]) for own in np.split(by_lang, ends[:-1])]
        for x, orders in enumerate(parts):
            (_, _, cell, own, leave), (context, out, cell1, own1, _) = orders[:2]
            by_byte = np.full(m, 8 + leave[0])
            by_byte[cell] = own
            table = np.tile(by_byte, (m, 1))
            table[context] += out[:, None]
            table.reshape(-1)[cell1] = own1
            self.bits[:, x] = table.reshape(-1)
        stays = None
        if max_contexts is not None:
            names, at = np.unique(key // m, return_inverse=True)
            stays = names[np.argsort(-np.bincount(at, n), kind="stable")[:max_contexts]]
        for order in range(2, ORDER + 1):
            rows = [([], [], []), ([], [], [])]
            for x, orders in enumerate(parts):
                context, out, cell, own, leave = orders[order]
                _, _, short, own_short, _ = orders[order - 1]
                gain = own - own_short[np.searchsorted(short, cell % m**order)] - leave
                if stays is not None and order == ORDER:
                    kept = np.isin(context, stays)
                    context, out = context[kept], out[kept]
                    kept = np.isin(cell // m, stays)
                    cell, gain = cell[kept], gain[kept]
                for to, (names, bits) in zip(rows, ((context, out), (cell, gain)), strict=True):
                    to[0].append(names)
                    to[1].append(np.full(len(names), x, np.int32))
                    to[2].append(bits)
            self.leave.append(_Sparse(*map(np.concatenate, rows[0])))
            self.gain.append(_Sparse(*map(np.concatenate, rows[1])))

    def _tree(self, key: np.ndarray, n: np.ndarray) -> list[tuple]:
        """One language's orders: contexts, bits to leave each, (context, byte) cells, bits of each, bits to leave its context."""
        out, m = [], self.m
        for order in range(ORDER + 1):
            cell, at = np.unique(key % m ** (order + 1), return_inverse=True)
            times = np.bincount(at, n, len(cell))
            context, of = np.unique(cell // m, return_inverse=True)
            kinds = np.bincount(of, minlength=len(context))
            whole = np.bincount(of, times, len(context)) + kinds
            leave = np.log2(whole) - np.log2(kinds)
            out.append((context, leave, cell, np.log2(whole)[of] - np.log2(times), leave[of]))
        return out

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of ``data`` in each language."""
        total, m = np.zeros(len(self.langs)), self.m
        for at in range(0, len(data), PIECE):
            head = data[max(0, at - ORDER) : at]
            c = self.code[np.frombuffer(head + data[at : at + PIECE], np.uint8)]
            c = np.concatenate([np.full(ORDER - len(head), m - 2), c])
            cells, n = np.unique(((c[:-3] * m + c[1:-2]) * m + c[2:-1]) * m + c[3:], return_counts=True)
            total += n.astype(float) @ self.bits[cells % m**2]
            for order, leave, gain in zip(range(2, ORDER + 1), self.leave, self.gain, strict=True):
                cell = cells % m ** (order + 1)
                leave.add(cell // m, n, total)
                gain.add(cell, n, total)
        return total


def sample(training: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of id and text, without a shuffle of texts."""
    counts = training.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return training
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))))
    spin = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return training.where(spin < share[F.col("lang")])


def learn(training: DataFrame, per_lang: int = TRAIN_DOCS, max_contexts: int | None = None) -> ContextTrees:
    """Trees over (doc_id, text, lang) rows; what comes to the driver is bounded by the sample."""
    rows = training.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    return ContextTrees(count_grams(sample(rows, per_lang)).toPandas(), max_contexts)


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with ``__lang``: lang_pred, score, bits_per_byte.

    The score is the winner's share if each language is weighed by 2 to the minus its code length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def look(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        known, out = sent.value, []
        for text, has_letter in zip(texts, letters, strict=True):
            if not has_letter or not known.langs:
                out.append(("und", 0.0, None))
                continue
            data = text.encode("utf-8", "surrogatepass")
            bits = known.code_lengths(data)
            best = int(np.argmin(bits))
            share = 1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()
            out.append((known.langs[best], float(share), float(bits[best] / len(data))))
        return pd.DataFrame(out, columns=["lang_pred", "score", "bits_per_byte"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("__lang", look("text", letters))


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte): learnt from the rows that are not held out, for all rows."""
    trees = learn(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "__lang.lang_pred", "__lang.score", "__lang.bits_per_byte"
    )


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those in no learned language: ``und``, or no language's code is shorter than the plain bytes."""
    trees = learn(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, trees).where("__lang.lang_pred != 'und' AND __lang.bits_per_byte < 8").drop("__lang")

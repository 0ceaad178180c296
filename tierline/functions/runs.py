"""Token runs of normalised texts (lower-case words with single blanks between), asked for among many keys at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Hash functions of the filter, and its bits for each key (the next power of two is taken).
PROBES, BITS = 4, 12
#: Tokens of the beginning that a longer key is first asked for by.
BEGIN = 3
#: Characters of text that are hashed at once.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BEGINS = np.uint64(0x5851F42D4C957F2D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    """The first ``2**bits`` powers of ``base`` modulo 2**64."""
    out = np.ones(1 << bits, np.uint64)
    for i in range(bits):
        out[1 << i : 2 << i] = out[: 1 << i] * np.uint64(pow(base, 1 << i, 1 << 64))
    return out


class Tokens:
    """The tokens of some texts, and the hash of any run of them.

    A run's hash is that of its characters, wherever it stands: sums of powers
    over all characters are made once, and a run is the difference of two.
    """

    def __init__(self, texts: Sequence[str | None]):
        self.raw = "\n".join(t or "" for t in texts).encode()
        data = np.frombuffer(self.raw, np.uint8)
        gap = data <= 32
        self.start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        self.end = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
        self.text = np.searchsorted(np.flatnonzero(data == 10), self.start)
        bits = max(16, len(data).bit_length())
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(bits, _BASE)[: len(data)])))
        self._back = _powers(bits, pow(_BASE, -1, 1 << 64))

    def runs(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the runs of ``n`` tokens, of all or of those that begin at the tokens ``at``."""
        at = np.arange(len(self.start)) if at is None else at
        at = at[at + n <= len(self.start)]
        at = at[self.text[at] == self.text[at + n - 1]]
        begin = self.start[at]
        return at, _mix((self._sums[self.end[at + n - 1]] - self._sums[begin]) * self._back[begin])

    def run(self, at: int, n: int) -> bytes:
        return self.raw[self.start[at] : self.end[at + n - 1]]


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, Tokens]]:
    """(place of the first text, tokens) for about ``CHUNK`` characters at a time."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK or i == len(texts) - 1:
            yield first, Tokens(texts[first : i + 1])
            first, size = i + 1, 0


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


def key_bits(keys: Sequence[str], bits: int) -> np.ndarray:
    """The bits that stand for keys in a filter; one that is longer than ``BEGIN`` tokens has its beginning there too."""
    out = [np.zeros(0, np.uint64)]
    for _, tokens in chunks(keys):
        lengths = np.bincount(tokens.text)
        first = np.cumsum(lengths) - lengths
        for n in np.unique(lengths[lengths > 0]):
            at = first[lengths == n]
            out += _places(tokens.runs(int(n), at)[1], bits)
            if n > BEGIN:
                out += _places(tokens.runs(BEGIN, at)[1] ^ _BEGINS, bits)
    return np.unique(np.concatenate(out)).astype(np.int64)


@dataclass
class RunFilter:
    """Tells which runs of a text may be keys, and knows the ``first`` keys of an order for sure.

    ``bits`` is a bitmap of all keys (:func:`key_bits`), ``lengths`` holds the
    numbers of tokens that keys have. What it gives must still be compared with
    the keys: some runs are none.
    """

    bits: np.ndarray
    lengths: list[int]
    first: list[bytes]

    def __post_init__(self):
        self._hash = np.zeros(len(self.first), np.uint64)
        for at, tokens in chunks([k.decode() for k in self.first]):
            lengths = np.bincount(tokens.text)
            start = np.cumsum(lengths) - lengths
            for n in np.unique(lengths):
                of = np.flatnonzero(lengths == n)
                self._hash[at + of] = tokens.runs(int(n), start[of])[1]
        self._order = np.argsort(self._hash, kind="stable")
        self._hash = self._hash[self._order]

    def _may(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for place in _places(h, 8 * len(self.bits)):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def _candidates(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, tokens, hash) of the runs that may be keys."""
        found, begun = [], None
        for n in self.lengths:
            if n > BEGIN and begun is None:
                begun, h = tokens.runs(BEGIN)
                begun = begun[self._may(h ^ _BEGINS)]
            at, h = tokens.runs(n, begun if n > BEGIN else None)
            keep = self._may(h)
            found.append((at[keep], np.full(keep.sum(), n), h[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def named(self, texts: Sequence[str | None], enough: int | None = None) -> Iterable[tuple[int, bytes]]:
        """(place of the text, run) for the runs that may be keys, each once for a text.

        Of a text that holds ``enough`` of the ``first`` keys only the first ones are given.
        """
        for place, tokens in chunks(texts):
            at, n, h = self._candidates(tokens)
            text = tokens.text[at]
            settled = set()
            if enough and len(self._hash):
                i = np.minimum(np.searchsorted(self._hash, h), len(self._hash) - 1)
                sure = np.flatnonzero(self._hash[i] == h)
                rank = self._order[i[sure]]
                order = np.lexsort((rank, text[sure]))
                sure, rank = sure[order], rank[order]
                once = np.concatenate(([True], (np.diff(rank) != 0) | (np.diff(text[sure]) != 0)))[: len(sure)]
                sure, rank = sure[once], rank[once]
                owner, begin, count = np.unique(text[sure], return_index=True, return_counts=True)
                for t, b in zip(owner[count >= enough].tolist(), begin[count >= enough].tolist(), strict=True):
                    runs = [tokens.run(at[j], n[j]) for j in sure[b : b + enough]]
                    if runs == [self.first[r] for r in rank[b : b + enough]]:
                        settled.add(t)
                        yield from ((place + t, run) for run in runs)
            open_ = np.flatnonzero(~np.isin(text, list(settled))) if settled else np.arange(len(at))
            seen = {(int(text[j]), tokens.run(at[j], n[j])) for j in open_}
            yield from ((place + t, run) for t, run in seen)

"""License scans by patience alignment of texts against license templates.

A text and a template are aligned as follows: words at both ends that agree are matched; then the words that occur
once in both are anchors, the longest increasing subsequence of their places is kept, and the gaps between kept
anchors are aligned in the same way. A template's coverage is the share of its words that are matched.

An alignment of a long text with scattered words says little, so a template counts as found where one run of the text,
at most ``SLACK`` times as long as the template, holds ``COVERAGE`` of its words; the alignment is made anew inside each
such run. Runs are found with exact counts: only a run with enough of the template's words, each counted at most as
often as the template has it, can reach the coverage.

Templates of one license differ from its neighbours' by few words, so coverage alone does not tell them apart: a run that
holds a word of ``license_forms.NAMES`` (Affero, Lesser, ND, ...) more often than the template is no place of it, and of a
short form (up to ``SHORT`` words) the naming words and all numbers must be matched.

Defined results: a null or empty text has no license; equal texts get equal results; templates without words match
nothing. Ties between templates at one place go to the higher coverage, then the longer template, then the name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_forms import IDENTITY, LONGER, NAMES, forms

COVERAGE = 0.8
SLACK = 1.5
#: Words by which the first stretch is longer than a run that failed, and widths of a run up to which stretches grow.
FIRST_STEP, MOST_WIDTHS = 16, 4
SHORT = 64
#: Short forms in which works name their license; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction'
    ),
}
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tails, at, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [p]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), in order."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        if not once:
            continue
        pairs = [(i, once[w]) for i, w in enumerate(a[a0:a1], a0) if w in once]
        anchors = [pairs[i] for i in increasing([p for _, p in pairs])]
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def word_masks(template: list) -> dict:
    """For each word the bits of its places in the template."""
    masks: dict = {}
    for j, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << j
    return masks


def longest_common(words: list, masks: dict, size: int) -> int:
    """Length of a longest common subsequence with a template of ``size`` words, all its places at once (Hyyrö, 2004)."""
    full = (1 << size) - 1
    open_ = full
    for w in words:
        if mask := masks.get(w, 0):
            hit = open_ & mask
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return size - open_.bit_count()


class Templates:
    """Templates as word numbers; 0 is any word that no template has. ``more``: further (license, text) forms."""

    def __init__(self, templates: dict[str, str], more: list[tuple[str, str]] = ()):
        pairs = sorted({(name, *split_words(text)) for name, text in [*templates.items(), *more]})
        self.names = [name for name, *_ in pairs]
        self.number: dict[bytes, int] = {}
        name_words = {self.number.setdefault(w.encode(), len(self.number) + 1) for w in sorted(NAMES)}
        self.library, self.general, self.of_library = (
            self.number.setdefault(w, len(self.number) + 1) for w in (b"library", b"general", b"library general")
        )
        naming = name_words | {self.of_library}
        #: Of each template: the words that its runs hold no more often than it does.
        self.naming = [naming | {self.number_of(w.encode()) for w in LONGER.get(name, ())} for name in self.names]
        self.codes = [self.numbers(words, self.number_of).tolist() for _, *words in pairs]
        self.counts = [Counter(c) for c in self.codes]
        self.distinct = [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for c in self.counts]
        must = naming | {i for w, i in self.number.items() if w.decode("utf-8", "replace") in IDENTITY or w.lstrip(b"v").isdigit()}
        self.required = [Counter({w: n for w, n in c.items() if w in must}) if len(t) <= SHORT else Counter() for c, t in zip(self.counts, self.codes, strict=True)]
        #: Templates by one word that they require: the one that fewest templates have; 0: by none.
        share = Counter(w for r in self.required for w in r)
        self.by_gate: dict[int, list[int]] = {}
        for t, r in enumerate(self.required):
            self.by_gate.setdefault(min(r, key=lambda w: (share[w], w)) if r else 0, []).append(t)
        self.gates = np.array([g for g in self.by_gate if g], np.int64)
        self._masks: dict[int, dict] = {}

    def masks(self, t: int) -> dict:
        if t not in self._masks:
            self._masks[t] = word_masks(self.codes[t])
        return self._masks[t]

    def number_of(self, word: bytes) -> int:
        return self.number.setdefault(word, len(self.number) + 1)

    def numbers(self, words: list[bytes], number) -> np.ndarray:
        codes = np.fromiter(map(number, words), np.int64, len(words))
        codes[:-1][(codes[:-1] == self.library) & (codes[1:] == self.general)] = self.of_library
        return codes


def found_in(words: list[bytes], known: Templates, coverage: float = COVERAGE, slack: float = SLACK) -> list[tuple]:
    """(template's number, coverage, first word, end) for each place where a template is found, best first at each place."""
    if not words:
        return []
    codes = known.numbers(words, lambda w: known.number.get(w, 0))
    counts = np.bincount(codes, minlength=len(known.number) + 1)
    hits = len(codes) - int(counts[0])
    tried = [*known.by_gate.get(0, ()), *(t for g in known.gates[counts[known.gates] > 0].tolist() for t in known.by_gate[g])]
    tried.sort(key=lambda t: (-len(known.codes[t]), t))
    out = _tried(codes, counts, hits, tried, known, coverage, slack, True)
    kept = _best_apart(out, known)
    if any(len(known.codes[x[0]]) > SHORT and x not in kept for x in out):
        # what was left out for a place that is not kept itself may be a place
        kept = _best_apart(_tried(codes, counts, hits, tried, known, coverage, slack, False), known)
    return kept


def _tried(codes, counts, hits, tried, known, coverage, slack, leave_out) -> list[tuple]:
    """Places of all templates; with ``leave_out`` without those that a long template's better place would displace."""
    out = []
    for t in tried:
        template = known.codes[t]
        need = int(-(-len(template) * coverage // 1))
        if not template or hits < need:
            continue
        own_words, times = known.distinct[t]
        if np.minimum(counts[own_words], times).sum() < need or any(counts[w] < n for w, n in known.required[t].items()):
            continue
        own = np.flatnonzero(np.isin(codes, own_words))
        width = max(len(template), int(len(template) * slack))
        # a run of ``width`` words can only reach the coverage if it holds ``need`` of the template's words
        ends = np.searchsorted(own, own + width)
        better = [x for x in out if leave_out and SHORT < len(known.codes[x[0]]) > len(template)]
        out += _runs(codes, own, ends, need, t, known, width, better)
    return out


def _runs(codes, own, ends, need, t, known, width, better) -> list[tuple]:
    template, counts, required = known.codes[t], known.counts[t], known.required[t]
    out, free, held, common, filled = [], 0, Counter(), 0, 0
    at, last = codes[own].tolist(), ends.tolist()
    for i, first in enumerate(own.tolist()):
        # ``common``: how many of the template's words the run holds, each counted at most as often as the template has it
        for w in at[filled : last[i]]:
            common += held[w] < counts[w]
            held[w] += 1
        filled = last[i]
        enough = common >= need
        if enough and any(x[2] <= first < x[3] and common <= x[1] * len(template) for x in better):
            enough = False
        held[at[i]] -= 1
        common -= held[at[i]] < counts[at[i]]
        if not enough or first < free:
            continue
        pairs = align(codes[first : int(own[last[i] - 1]) + 1].tolist(), template)
        if len(pairs) < need:
            free = first + _hopeless(own, at, i, need, t, known, width)
            continue
        if pairs[0][0]:
            # the run began before the place and may end inside it
            moved = first + pairs[0][0]
            again = align(codes[moved : moved + width].tolist(), template)
            if len(again) > len(pairs):
                first, pairs = moved, again
        begin, end = first + pairs[0][0], first + pairs[-1][0] + 1
        run = codes[begin:end].tolist()
        in_run = Counter(run)
        foreign = [w for w in known.naming[t] if in_run[w] > counts[w]]
        if foreign:
            # a run from before the first such word to the same end or beyond holds it as often
            free = begin + min(map(run.index, foreign)) + 1
        elif not required - Counter(template[j] for _, j in pairs):
            out.append((t, len(pairs) / len(template), begin, end))
            free = end
    return out


def _hopeless(own, at, i, need, t, known, width) -> int:
    """By how many words the next run may begin later than the ``i``-th, which failed.

    No run inside a stretch of text can match more words than the stretch has in common with the template in order, so
    all runs inside a stretch with too few are passed over at once; stretches grow while that holds.
    """
    step, ahead, size = 1, FIRST_STEP, len(known.codes[t])
    while ahead <= MOST_WIDTHS * width:
        stop = int(np.searchsorted(own, own[i] + width + ahead))
        if longest_common(at[i:stop], known.masks(t), size) >= need:
            break
        step = ahead + 1
        if stop == len(own):
            return int(own[-1] - own[i]) + 1
        ahead *= 2
    return step


def _best_apart(found: list[tuple], known: Templates) -> list[tuple]:
    """Found places that do not overlap: the best first, as the module's docstring orders them."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[1], -len(known.codes[x[0]]), known.names[x[0]], x[2])):
        if all(x[3] <= y[2] or y[3] <= x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, slack: float = SLACK) -> DataFrame:
    """(doc_id, n_words, licenses) for each row of ``docs`` (doc_id, text).

    ``licenses``: array of (license, coverage, first, end) in order of place; places count words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates) if templates else Templates(TEMPLATES, forms()))  # the templates' own size
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])
    )

    def run(batches):
        known = sent.value
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                words = split_words(text)
                counts.append(len(words))
                found.append(
                    [
                        {"license": known.names[t], "coverage": c, "first": a, "end": b}
                        for t, c, a, b in found_in(words, known, coverage, slack)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "licenses"])

    schema = "doc_id long, n_words long, licenses array<struct<license:string,coverage:double,first:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

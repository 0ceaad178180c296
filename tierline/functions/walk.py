"""All matches of many patterns in one walk over a text.

An Aho-Corasick automaton holds a literal for each pattern: the whole pattern if it is a literal, else the longest
text that each of its matches must contain. One pass over a text finds all literals, however many there are; only
regexes whose literal occurs, and the few that have none, are then run, each once. Case counts for nothing in A to Z
and for everything else, as in the column functions, and offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick

from .text import portable, required_text

#: Line edges as the web-script rules have them, spelled out.
_LINE_START, _LINE_END = "(?:(?<![\\s\\S])|(?<=[\n\r\u2028\u2029]))", "(?:(?![\\s\\S])|(?=[\n\r\u2028\u2029]))"
_FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}


def lower(text: str) -> str:
    """A to Z in lower case, all other characters as they are: bytes know no other letters, and a table costs ten times as much."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def compiled(source: str, edges: bool = True) -> re.Pattern:
    """A portable source, its flags in front, as a regex that matches what the column functions match.

    Without ``edges`` only a line feed ends a line: the same matches, faster, in a text without other line ends.
    """
    flags = re.ASCII
    if head := re.match(r"\(\?([ims]+)\)", source):
        source = source[head.end() :]
        for letter in head[1]:
            flags |= _FLAGS[letter]
    if edges and flags & re.MULTILINE:
        tokens = re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", source, re.S)
        source = "".join(_LINE_START if t == "^" else _LINE_END if t == "$" else t for t in tokens)
    return re.compile(source, flags)


class Walk:
    """``patterns``: (source, is a regex). Literals match in any case of A to Z; a regex says so itself by ``(?i)``."""

    def __init__(self, patterns: Sequence[tuple[str, bool]]):
        self.literals: list[str | None] = []
        self.regexes: list[re.Pattern | None] = []
        self.line_feeds: list[re.Pattern | None] = []
        #: Regexes without a required literal, run on every text.
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for i, (source, regex) in enumerate(patterns):
            literal = required_text(source) if regex else lower(source)
            self.literals.append(literal)
            self.regexes.append(compiled(portable(source)) if regex else None)
            self.line_feeds.append(compiled(portable(source), edges=False) if regex else None)
            if literal:
                by_literal.setdefault(literal, []).append(i)
            elif regex:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, owners in by_literal.items():
            self.automaton.add_word(literal, (len(literal), tuple(owners)))
        if by_literal:
            self.automaton.make_automaton()
        self.empty = not by_literal

    def _literals(self, text: str) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Matches of the literal patterns, and the regexes whose literal occurs."""
        found, regexes = [], set(self.always)
        if self.empty:
            return found, regexes
        end_of: dict[int, int] = {}
        for last, (size, owners) in self.automaton.iter(lower(text)):
            end = last + 1
            for i in owners:
                if self.regexes[i] is not None:
                    regexes.add(i)
                elif end - size >= end_of.get(i, 0):  # matches of one pattern do not overlap
                    end_of[i] = end
                    found.append((i, end - size, end))
        return found, regexes

    def _regexes(self, text: str) -> list[re.Pattern | None]:
        return self.regexes if any(end in text for end in "\r\u2028\u2029") else self.line_feeds

    def all(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, from, to) of every match, those of one pattern in order and apart."""
        found, regexes = self._literals(text)
        yield from found
        run = self._regexes(text)
        for i in sorted(regexes):
            for m in run[i].finditer(text):
                yield i, m.start(), m.end()

    def first(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, from, to) of each pattern's first match."""
        found, regexes = self._literals(text)
        seen: set[int] = set()
        for i, at, end in found:
            if i not in seen:
                seen.add(i)
                yield i, at, end
        run = self._regexes(text)
        for i in sorted(regexes):
            if m := run[i].search(text):
                yield i, m.start(), m.end()

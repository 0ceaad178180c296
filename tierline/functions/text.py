"""Text helpers shared by the column functions.

Blanks and word edges follow the web-script definition the source rules were
written against: blanks include U+00A0 and U+FEFF, word characters are ASCII.
Java's ``\\s`` and ``\\b`` differ on both counts, hence the explicit classes.
Positions are code points throughout (``length``/``substring`` units).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{A0}\x{FEFF}\p{Z}]"


def word(pattern: str) -> str:
    """``pattern`` as a whole ASCII word."""
    return rf"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


# Every blank of the web-script "\\s", usable inside a character class.
_BLANKS = " \\t\\n\\x0b\\f\\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same blanks, and every separator, as characters to strip.
BLANKS = "".join(
    chr(c) for c in [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def portable(source: str) -> str:
    """Make blanks and word edges mean the same in Java and Python regexes."""
    out, in_class = [], False
    for token in re.findall(r"\\.|.", source, re.S):
        if token == "[" and not in_class:
            in_class = True
        elif token == "]":
            in_class = False
        elif token == r"\s":
            token = _BLANKS if in_class else f"[{_BLANKS}]"
        elif token == r"\b" and not in_class:
            token = _EDGE
        elif token == "." and not in_class:
            token = "[^\n\r\u2028\u2029]"
        out.append(token)
    return "".join(out)


def required_text(source: str) -> str | None:
    """The longest literal that every match of a pattern must contain, lower case.

    Only text outside groups counts, and a pattern with a top-level
    alternation has none.
    """
    bare = re.sub(r"^\(\?[a-z]+\)", "", source)
    bare = re.sub(r"\\[^a-zA-Z0-9]", "\0", bare)  # escaped punctuation ends a run
    while "(" in bare and (cut := re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", "\0", bare)) != bare:
        bare = cut
    if "|" in bare:
        return None
    bare = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?|\\[a-zA-Z](?:[?*+]|\{[^}]*\})?", "\0", bare)
    bare = re.sub(r".(?:[?*]|\{[^}]*\})", "\0", bare)
    runs = re.findall(r"[A-Za-z0-9' :/]+", bare)
    best = max(runs, key=len, default="")
    return best.lower() if len(best) >= 4 else None


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only U+0020."""
    return F.regexp_replace(col, rf"^{WS}+|{WS}+\z", "")


def squeeze(col: Column) -> Column:
    """Runs of blanks become one space; ends trimmed."""
    return strip(F.regexp_replace(col, rf"{WS}+", " "))


def clean_report_text(col: Column) -> Column:
    """Extracted report text: no CR, hyphenated breaks joined, blanks collapsed."""
    out = F.replace(col, F.lit("\r"), F.lit(""))
    out = F.regexp_replace(out, r"-\n(?=[a-z])", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def non_blank(col: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.when(col != "", col)


def present(col: Column) -> Column:
    """True for a value that is neither null nor empty (never null)."""
    return F.coalesce(col != "", F.lit(False))


def half_up(col: Column) -> Column:
    """floor(x + 0.5): the rounding used by every score."""
    return F.floor(col + F.lit(0.5))


#: Code points that no text should hold: the mark, and what stands in for it if one does.
_MARK, _STAND_IN = "\uffff", "\ufffe"


def all_indexes(text: Column, pattern: str | Column) -> Column:
    """Offsets of all non-overlapping matches as array<int>, in linear time.

    Each match gets a mark before it; the k-th mark's place among the
    characters, less the k marks before it, is its offset.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    clean = F.replace(text, F.lit(_MARK), F.lit(_STAND_IN))
    chars = F.regexp_extract_all(F.regexp_replace(clean, pattern, F.lit(_MARK + "$0")), F.lit("(?s)."), F.lit(0))
    marks = F.filter(F.transform(chars, lambda c, i: F.when(c == _MARK, i)), lambda i: i.isNotNull())
    return F.when(F.regexp_like(text, pattern), F.transform(marks, lambda at, k: at - k)).otherwise(
        F.array().cast("array<int>")
    )


def capitalise(col: Column) -> Column:
    """Upper-case the first character, leave the rest."""
    return F.concat(F.upper(F.substring(col, 1, 1)), col.substr(F.lit(2), F.length(col)))


def replace_first(col: Column, pattern: str) -> Column:
    """Delete the first match only."""
    return F.array_join(F.split(col, pattern, 2), "")


def sql_literal(value: object) -> str:
    """A Python constant as SQL text."""
    if value is None or isinstance(value, bool):
        return str(value).upper() if value is not None else "NULL"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(mapping: dict[str, object]) -> str:
    return "map(" + ", ".join(sql_literal(x) for pair in mapping.items() for x in pair) + ")"


def lookup(col: Column, mapping: dict[str, object], default: Column | None = None) -> Column:
    """Constant-table lookup; the literal map folds to one constant of the plan."""
    found = F.try_element_at(F.expr(sql_map(mapping)), col)
    return found if default is None else F.coalesce(found, default)

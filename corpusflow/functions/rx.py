"""Regular expressions with Unicode whitespace and digits, in Java's dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What counts as white space: Unicode's, which Java's \s doesn't cover.
WS = f"[{_SPACES}]"
NOT_WS = f"[^{_SPACES}]"


def wide(pattern: str) -> str:
    r"""pattern with \s, \S and \d standing for all of Unicode, also within classes."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(_SPACES if inside else WS)
        elif two == r"\S":
            out.append(NOT_WS)
        elif two == r"\d":
            out.append(r"\p{Nd}")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


def java(pattern: str, icase: bool = False, lines: bool = False) -> str:
    """Only a line feed ends a line, as in most dialects but Java's own."""
    return f"(?{'iu' if icase else ''}{'m' if lines else ''}d)" + wide(pattern)


def found(text: Column | str, pattern: str, icase: bool = False, lines: bool = False) -> Column:
    return F.rlike(text, F.lit(java(pattern, icase, lines)))


def count(text: Column | str, pattern: str, icase: bool = False, lines: bool = False) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, icase, lines)))


def replace(text: Column | str, pattern: str, by: str, icase: bool = False, lines: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, icase, lines), by)


def shorter_gaps(text: Column | str) -> Column:
    """Four line ends or more become three."""
    gap = "\n" * 3
    return F.regexp_replace(text, gap + "\n+", gap)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def either(words: list[str]) -> str:
    """A pattern for any of the literal words."""
    return "|".join("".join("\\" + c if c in r"\.^$|?*+()[]{}-#&~" else c for c in w) for w in words)

"""Search a text for regular expressions that are alternatives of plain words.

Looking for a plain word in the bytes of a text is many times faster than running an expression with dozens of
alternatives over it, and most texts hold none of the words. So the words an expression cannot match
without are derived from it, and the expression runs only on texts that contain one of them.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\^$.?*+()[]{}|")
_QUANTIFIER = set("?*+{")
_MOST = 16


def _split(pattern: str) -> list[str]:
    """Alternatives of the outermost level."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char == "[":
            i = pattern.index("]", i + 2)
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _openings(alternative: str) -> list[str]:
    """Plain texts one of which every match starts with; groups of plain options are multiplied out."""
    found, rest = [""], alternative
    while rest:
        if rest[0] not in _SPECIAL:
            if rest[1:2] and rest[1] in _QUANTIFIER:
                break
            found, rest = [f + rest[0] for f in found], rest[1:]
            continue
        end = rest.find(")")
        options = rest[1:end].split("|")
        plain = rest[0] == "(" and end > 0 and all(o and not _SPECIAL & set(o) for o in options)
        if not plain or rest[end + 1:end + 2] in _QUANTIFIER or len(found) * len(options) > _MOST:
            break
        found, rest = [f + o for f, o in product(found, options)], rest[end + 1:]
    return found


def needles(pattern: str) -> list[str]:
    """Texts one of which every match of ``pattern`` contains; empty when that cannot be told."""
    found = [n for alternative in _split(pattern) for n in _openings(alternative)]
    if any(len(n) < 2 for n in found):
        return []
    return [n for n in dict.fromkeys(found) if not any(other != n and other in n for other in found)]


def _may_match(text: Column, pattern: str) -> Column:
    words = needles(pattern)
    if not words:
        return F.lit(True)
    return reduce(Column.__or__, (F.contains(text, F.lit(word)) for word in words))


# Digits and word edges are those of Unicode, not only of ASCII.
_UNICODE = "(?U)"


def found(text: Column, pattern: str) -> Column:
    return _may_match(text, pattern) & text.rlike(_UNICODE + pattern)


def hits(text: Column, pattern: str) -> Column:
    """Number of matches that do not overlap."""
    return F.when(_may_match(text, pattern), F.regexp_count(text, F.lit(_UNICODE + pattern))).otherwise(F.lit(0))

"""Text cleaning and folding as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a text.
WHITESPACE = "".join(
    chr(cp) for cp in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                       *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Strip; an empty text becomes null."""
    return F.nullif(strip(text), F.lit(""))


def _base(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, tuple[str, ...]]:
    """Derive the folding tables from the Unicode database.

    Characters that fold to one character (followed by the marks that are dropped) with their targets, and characters
    that fold to several with theirs. Composed Hangul syllables are left out: their parts follow from their number.
    """
    single, target, dropped, several, parts = [], [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        char = chr(cp)
        base = _base(char)
        if base == char:
            continue
        if not base:
            dropped.append(char)
        elif len(base) == 1:
            single.append(char)
            target.append(base)
        else:
            several.append(char)
            parts.append(base)
    return "".join(single + dropped), "".join(target), "".join(several), tuple(parts)


# Hangul syllables are numbered by leading consonant, vowel and trailing consonant (or none).
_HANGUL, _LEAD, _VOWEL, _TRAIL, _VOWELS, _TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28


def _char(point: Column) -> Column:
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _hangul(char: Column) -> Column:
    """The parts of a composed syllable."""
    n = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - _HANGUL
    per_lead = _VOWELS * _TRAILS
    trail = n % _TRAILS
    return F.concat(_char(F.floor(n / per_lead) + _LEAD), _char(F.floor(n % per_lead / _TRAILS) + _VOWEL),
                    F.when(trail > 0, _char(trail + _TRAIL)).otherwise(""))


def normalise(text: Column) -> Column:
    """Lower case without accents: compatibility decomposition minus combining marks, for every script.

    ``translate`` handles one-to-one folds and the dropped marks in one pass and is skipped for plain ASCII. Rows with
    a character that folds to several go character by character.
    """
    low = F.lower(text)
    source, target, several, parts = _folding()
    listed = F.split(F.lit("\x00".join(parts)), "\x00")

    def spread(char: Column) -> Column:
        at = F.instr(F.lit(several), char)
        return (F.when(char.between(chr(_HANGUL), "\ud7a3"), _hangul(char))
                .when(at > 0, F.element_at(listed, at)).otherwise(char))

    apart = F.translate(F.array_join(F.transform(F.split(low, ""), spread), ""), source, target)
    # Both tests look a character up or compare it with two bounds; a class of all these characters would be walked.
    has_several = (F.char_length(F.translate(low, several, "")) < F.char_length(low)) | low.rlike("[\uac00-\ud7a3]")
    return (F.when(F.octet_length(low) == F.char_length(low), low)
            .when(has_several, apart)
            .otherwise(F.translate(low, source, target)))

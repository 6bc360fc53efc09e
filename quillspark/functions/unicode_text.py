"""Unicode text helpers that run inside Arrow batches (Spark has no ``normalize()`` function).

All functions take and give plain ``str``; the Column wrappers are in :mod:`quillspark.functions.columns`.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# Tags that stand inside a word or sentence; any other tag separates text.
INLINE_TAGS = "a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split()
# Letters whose stroke or missing dot is an accent to the reader, but has no decomposition.
STROKE_LETTERS = {"đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ø": "o", "ŧ": "t", "ƀ": "b", "ɨ": "i"}

TAG = re.compile(r"<(?:!--.*?--|/?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?)>", re.S)
_INLINE = frozenset(INLINE_TAGS)
WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")


def _ranges(keep) -> str:
    """The body of a regex character class of all code points that ``keep`` accepts."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in code_ranges(keep))


def code_ranges(keep) -> list[tuple[int, int]]:
    """Closed ranges of code points that ``keep`` accepts; planes that hold only ideographs or nothing are left out, but for the compatibility ideographs, which have decompositions."""
    out, start, last = [], None, 0
    for cp in (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        inside = not 0xD800 <= cp <= 0xDFFF and keep(cp)
        if start is not None and (not inside or cp != last + 1):
            out.append((start, last))
            start = None
        if inside and start is None:
            start = cp
        last = cp
    return out + ([(start, last)] if start is not None else [])


def is_invisible(cp: int) -> bool:
    """Format characters, variation selectors and fillers: no ink and no width."""
    return unicodedata.category(chr(cp)) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


@lru_cache(None)
def marks() -> re.Pattern:
    """Combining marks of any kind and invisible characters."""
    return re.compile("[" + _ranges(lambda cp: unicodedata.category(chr(cp))[0] == "M" or is_invisible(cp)) + "]+")


@lru_cache(None)
def invisible() -> re.Pattern:
    return re.compile("[" + _ranges(is_invisible) + "]+")


@lru_cache(None)
def _folds() -> dict[int, str | None]:
    """What each code point folds to, by rule: its compatibility decomposition without marks and strokes; None: nothing."""

    def folded(c: str) -> str:
        return "".join(STROKE_LETTERS.get(x, x) for x in marks().sub("", unicodedata.normalize("NFKD", c)))

    changed = code_ranges(lambda cp: cp > 127 and folded(chr(cp)) != chr(cp))
    return {cp: folded(chr(cp)) or None for a, b in changed for cp in range(a, b + 1)}


def _blank_tag(m: re.Match) -> str:
    return "" if (m[1] or "").lower() in _INLINE else " "


def strip_markup(text: str) -> str:
    """Tags out (inline ones leave nothing, others a blank), entities resolved."""
    if "<" in text:
        text = TAG.sub(_blank_tag, text)
    if "&" in text:
        text = html.unescape(text)
    return text


def fold(text: str) -> str:
    """Markup, case, accents, width and invisible characters removed; everything else kept."""
    text = strip_markup(text)
    if text.isascii():
        return text.lower()
    return text.casefold().translate(_folds())


@lru_cache(1 << 16)
def _folded_words(token: str) -> tuple[str, ...]:
    return tuple(WORD.findall(token.lower() if token.isascii() else token.casefold().translate(_folds())))


def fold_words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text, in order.

    Folding goes character by character, so that the stretches between blanks, most of which come again and again, can be folded one by one.
    """
    out: list[str] = []
    for token in strip_markup(text).split() if text else ():
        out += _folded_words(token) if len(token) <= 64 else _folded_words.__wrapped__(token)
    return out


def casefold_key(text: str | None) -> str | None:
    """NFC, full case folding, blanks of any kind squeezed and trimmed."""
    return None if text is None else " ".join(unicodedata.normalize("NFC", text).casefold().split())


@lru_cache(None)
def nonspacing() -> re.Pattern:
    return re.compile("[" + _ranges(lambda cp: unicodedata.category(chr(cp)) == "Mn") + "]+")


@lru_cache(1 << 16)
def _bare(token: str) -> str:
    return nonspacing().sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFC", token).casefold().replace("đ", "d")))


def fold_accents(text: str | None) -> str | None:
    """NFC, case folding, d for đ, no combining marks, blanks squeezed. No step reaches across a blank, so stretches between blanks are folded one by one, most from the cache."""
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(filter(None, (_bare(t) if len(t) <= 64 else _bare.__wrapped__(t) for t in text.split())))

"""One form for texts that look alike but are coded differently (problem 5).

A quick check finds the code points that can be part of an unstable segment; only such segments,
with the character before them as boundary context, are normalised and spliced back. Texts without
one are passed on as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode_text import code_ranges, is_invisible
from quillspark.session import cut_lineage

# Letters of other scripts drawn like a Latin letter, and the Latin letter, pair by pair.
CYRILLIC_LOOKALIKES = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ҮY ХX ԚQ ԜW аa сc ԁd еe һh іi јj оo рp ԛq ѕs уy үy ԝw хx ӏl ӀI"
GREEK_LOOKALIKES = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϳj αa ιi κк νv οo ρp υu χx ϲc"
LATIN_LOOKALIKES = "ÐĐ ƉĐ ıi ɑa ɡg ſf ǀl"
HYPHENS = "‐‑"


@lru_cache(None)
def lookalikes() -> dict[int, str]:
    pairs = f"{CYRILLIC_LOOKALIKES} {GREEK_LOOKALIKES} {LATIN_LOOKALIKES}".split()
    return {ord(p[0]): p[1] for p in pairs} | {ord(h): "-" for h in HYPHENS}


def _to_plain(cp: int) -> str | None:
    """What a code point becomes regardless of its neighbours: nothing, a plain blank, or the letter or digit of ordinary width."""
    c = chr(cp)
    if is_invisible(cp):
        return ""
    if c == "\t" or (unicodedata.category(c) == "Zs" and c != " "):
        return " "
    if 0xFF00 <= cp <= 0xFFEF and unicodedata.category(c)[0] in "LN" and (k := unicodedata.normalize("NFKC", c)) != c:
        return k
    return None


@lru_cache(None)
def plain_forms() -> dict[int, str]:
    return {cp: _to_plain(cp) for a, b in code_ranges(lambda cp: _to_plain(cp) is not None) for cp in range(a, b + 1)}


def _unstable(cp: int) -> bool:
    c = chr(cp)
    return cp in plain_forms() or c == "\r" or unicodedata.combining(c) != 0 or unicodedata.normalize("NFC", c) != c or 0x1161 <= cp <= 0x11FF or (unicodedata.category(c) in ("Mc", "Mn") and any(unicodedata.decomposition(chr(x)).endswith(f"{cp:04X}") for x in range(cp - 0x80, cp + 0x80)))


@lru_cache(None)
def _classes() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges that coding alone makes unstable, and those together with the look-alike letters."""
    like = lookalikes()
    return code_ranges(_unstable), code_ranges(lambda cp: ord(unicodedata.normalize("NFD", chr(cp))[0]) in like or _unstable(cp))


@lru_cache(None)
def _segments(visual: bool) -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _classes()[visual]) + "]+")


def _spliced(text: str, visual: bool, form) -> str:
    """Unstable segments, each with the character before it, replaced by their form; the rest as it is."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at = [], 0
    for m in _segments(visual).finditer(text):
        start = max(at, m.start() - 1)
        out += (text[at:start], form(text[start : m.end()]))
        at = m.end()
    return "".join(out) + text[at:] if at else text


@lru_cache(1 << 16)
def _coded(segment: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment).translate(plain_forms()))


@lru_cache(1 << 16)
def _seen(segment: str) -> str:
    bare = unicodedata.normalize("NFD", segment).translate(plain_forms())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", bare).translate(lookalikes()))


def skeleton(text: str) -> str:
    """Equal for two texts exactly if they look the same. Not meant to be read: Cyrillic becomes partly Latin."""
    return _spliced(text, True, _seen)


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@lru_cache(None)
def _words() -> re.Pattern:
    """Letters and digits with their combining marks."""
    return re.compile("[\\w" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in code_ranges(lambda cp: unicodedata.category(chr(cp))[0] == "M")) + "]+")


def _settle(m: re.Match) -> str:
    """A word of mixed scripts takes the script most of its unmistakable letters have; without any, Latin."""
    word = m[0]
    if word.isascii():
        return word
    like = lookalikes()
    scripts = [_script(c) for c in word if c.isalpha()]
    if len(set(scripts)) < 2 or not any(ord(c) in like for c in unicodedata.normalize("NFD", word)):
        return word
    certain = [s for c, s in zip((c for c in word if c.isalpha()), scripts, strict=True) if ord(unicodedata.normalize("NFD", c)[0]) not in like and not (c.isascii() and c in "".join(like.values()))]
    for script in ("CYRILLIC", "GREEK"):
        if certain.count(script) > certain.count("LATIN"):
            back = {ord(v): chr(k) for k, v in sorted(like.items(), reverse=True) if _script(chr(k)) == script}
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(back))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(like))


def one_form(text: str) -> str:
    """The readable canonical form: NFC, plain blanks, ordinary width, nothing invisible, no word of mixed look-alike scripts."""
    coded = _spliced(text, False, _coded)
    return coded if coded.isascii() else _words().sub(_settle, coded)


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unstable = _segments(True).search
    for b in batches:
        raw, seen = [], []
        for t in b.column("text").to_pylist():
            h = _hash(t)
            raw.append(h)
            seen.append(h if t.isascii() or not unstable(t) else _hash(skeleton(t)))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(raw, pa.binary()), pa.array(seen, pa.binary())], names=["key", "raw", "class_id"])


def visual_classes(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, raw, class_id``: 128-bit hashes of the text as coded and of its skeleton. Rows with null text are left out."""
    src = df.select(key.cast("string").alias("key"), text.alias("text")).where("text is not null")
    return src.mapInArrow(_classes_of, "key string, raw binary, class_id binary")


def _mixed_rows(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, raw, class_id``, once each, of the classes that hold more than one coding; written, as both operators below read it more than once."""
    rows = cut_lineage(visual_classes(df, key, text).where("key is not null"))  # read twice
    mixed = rows.groupBy("class_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("class_id")
    return cut_lineage(rows.join(mixed, "class_id", "left_semi").select("key", "raw", "class_id").distinct())


def lookalike_pairs(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """Pairs ``key_a < key_b`` (code points) of rows with different keys whose texts look the same but differ in characters.

    Rows with null keys or texts have no pair; rows repeated with the same key and text count once;
    empty texts look like texts of invisible characters only; an empty table gives none. Extra columns
    are ignored. Hashes only are shuffled; classes in which all texts are coded alike are dropped
    by an aggregate before rows meet. The codings of a class are paired, one row for each coding, and the
    pairs of codings expanded to rows last: exact copies never meet, as candidates neither.
    """
    rows = _mixed_rows(df, key, text)
    codings = rows.select("class_id", "raw").distinct()
    a, b = codings.withColumnRenamed("raw", "raw_a"), codings.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, "class_id").where("raw_a < raw_b")
    left, right = rows.toDF("a", "raw_a", "class_id"), rows.toDF("b", "raw_b", "class_id")
    out = pairs.join(left, ["class_id", "raw_a"]).join(right, ["class_id", "raw_b"]).where("a <> b")
    return out.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def lookalike_links(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, class_id, n_links`` of every row that looks like one coded otherwise: how many such rows its class holds.

    The form for groups of any size, as nothing is expanded: counts per coding are taken from counts per class. A key
    that stands with several codings gives a row for each. What has no link has no row; nulls and repetitions as in :func:`lookalike_pairs`.
    """
    rows = _mixed_rows(df, key, text)
    per_coding = rows.groupBy("class_id", "raw").agg(F.count("*").alias("own"))
    per_class = per_coding.groupBy("class_id").agg(F.sum("own").alias("all"))
    counts = per_coding.join(per_class, "class_id").select("class_id", "raw", (F.col("all") - F.col("own")).alias("n_links"))
    return rows.join(counts, ["class_id", "raw"]).select("key", "class_id", "n_links")


def _forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unstable = _segments(True).search
    for b in batches:
        texts = b.column("text").to_pylist()
        forms = [t if t is None or t.isascii() or not unstable(t) else one_form(t) for t in texts]
        changed = [f != t for f, t in zip(forms, texts, strict=True)]
        classes = [None if t is None else _hash(skeleton(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(forms, pa.string()), pa.array(changed, pa.bool_()), pa.array(classes, pa.binary())], names=["key", "form", "changed", "class_id"])


def canonical_texts(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, form, changed, class_id`` for every row; null texts stay null, unchanged and without a class.

    Rows with equal ``class_id`` look the same; ``form`` is what each reads as.
    """
    return df.select(key.cast("string").alias("key"), text.alias("text")).mapInArrow(_forms_of, "key string, form string, changed boolean, class_id binary")

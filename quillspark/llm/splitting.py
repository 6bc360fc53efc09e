"""Splitting oversized items at natural boundaries (problem 3).

Word starts give prefix sums of words over character offsets; candidate cuts of each kind stand in
sorted arrays. A piece takes the last boundary under both limits by binary search, the next piece
steps back to the first boundary inside the overlap, and a hard cut is the fallback.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.chunking import relocate

#: Blanks of any kind, as Unicode defines white space; the same class serves the JVM and Python.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{BLANKS}]+")
_BLANK = re.compile(f"[{BLANKS}]+")
_LINE = re.compile(r"\n+|\r\n?|[\x85\u2028\u2029]")
#: A line that opens a clause: a heading word with a number, or a numbered or lettered item.
_CLAUSE = re.compile(rf"[{BLANKS}]*(?:[^\W\d_]+[{BLANKS}]+\d+\w?[.:]|\d+(?:\.\d+)*[.)]|\w[)])")
_SENTENCE = re.compile(rf"(?:[.!?…।]+[\"”’»)\]]*(?=[{BLANKS}]))|(?:[。！？]+[”’」』）]*)")
#: A boundary of a better kind is taken only if it fills the piece to this share, else the next kind is tried.
LEAST_FILL = 0.5


def _boundaries(text: str, words: list[int]) -> list[list[int]]:
    """Sorted cut positions by kind, best first: clause, paragraph, sentence, word. A cut stands before the text that follows."""
    lines = [m.end() for m in _LINE.finditer(text)]
    clauses = [p for p in lines if _CLAUSE.match(text, p)]
    return [clauses, lines, [m.end() for m in _SENTENCE.finditer(text)], words]


def split_spans(text: str, max_chars: int = 1200, max_words: int = 250, overlap: int = 150) -> list[tuple[int, int]]:
    """Spans of ``text`` within both limits that cover all its words; a text within them is one span, untrimmed.

    Consecutive spans overlap by at most ``overlap`` characters. Pieces carry no outer blanks, so a text that is
    beyond a limit by its outer blanks alone is one span.
    """
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(text) <= max_chars and len(starts) <= max_words:
        return [(0, len(text))]
    if not starts:
        # nothing but blanks: hard cuts without overlap
        return [(p, min(p + max_chars, len(text))) for p in range(0, len(text), max_chars)]
    kinds = _boundaries(text, starts)
    end_of_text = len(text.rstrip())
    spans: list[tuple[int, int]] = []
    start = fresh = starts[0]  # fresh: where text begins that no piece holds yet
    while True:
        at = bisect_right(starts, start) - 1  # the word that holds start; a part of a word counts as one
        limit = min(start + max_chars, starts[at + max_words] if at + max_words < len(starts) else len(text))
        if limit >= end_of_text:
            spans.append((start, end_of_text))
            return spans
        cut = 0
        for kind in kinds:
            p = kind[i - 1] if (i := bisect_right(kind, limit)) else 0
            if p > fresh and p >= start + (LEAST_FILL * (limit - start) if kind is not starts else 0):
                cut = p
                break
        if not cut and start < fresh:  # the overlap leaves no room for the next word: do without it
            start = fresh
            continue
        if not cut:
            cut = limit
            while cut > start + 1 and unicodedata.combining(text[cut]):
                cut -= 1
        end = start + len(text[start:cut].rstrip())
        spans.append((start, end))
        fresh = cut
        if text[cut].isspace():
            fresh = starts[bisect_left(starts, cut)]
        # the next piece begins at the first sentence, else word, inside the overlap; else where this one was cut
        start, back = fresh, max(end - overlap, start + 1)
        for kind in (kinds[2], starts):
            i = bisect_left(kind, back)
            p = starts[j] if i < len(kind) and (j := bisect_left(starts, kind[i])) < len(starts) else end
            if p < end:
                start = p
                break


_OUT = "row struct<key:string,article_number:string,document_id:string,source_start:int>, piece_no int, n_pieces int, text string, piece_start int, piece_end int"


def _split_batches(max_chars: int, max_words: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            take, no, of, out, s, e = [], [], [], [], [], []
            for i, t in enumerate(texts):
                spans = split_spans(t, max_chars, max_words, overlap)
                for k, (x, y) in enumerate(spans):
                    take.append(i)
                    no.append(k)
                    of.append(len(spans))
                    out.append(t[x:y])
                    s.append(x)
                    e.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pa.array(take, pa.int64())), pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(out, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())],
                names=["row", "piece_no", "n_pieces", "text", "piece_start", "piece_end"],
            )

    return run


def is_oversized(text: Column, max_chars: int, max_words: int) -> Column:
    """More characters or more words than allowed; words are counted only where there may be too many."""
    words = F.regexp_count(text, F.lit(f"[^{BLANKS}]+"))
    return F.coalesce((F.length(text) > max_chars) | ((F.length(text) >= 2 * max_words + 1) & (words > max_words)), F.lit(False))


def split_oversized(
    df: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    article_number: str = "article_number",
    document_id: str = "document_id",
    start_char: str = "start_char",
    end_char: str = "end_char",
    max_chars: int = 1200,
    max_words: int = 250,
    overlap: int = 150,
    whole: bool = True,
) -> DataFrame:
    """Cut items beyond a limit into overlapping pieces; with ``whole`` the others come out as one piece each.

    Gives ``key, document_id, article_number, piece_no, n_pieces, text, piece_start, piece_end`` (into
    the item's text) ``, start_char, end_char`` (into the document). Document offsets are given where the
    item's own offsets fit its text (end - start = length), else null: stale offsets are not passed on.
    Null texts give one piece with null text and offsets, empty ones an empty piece; rows repeated word
    for word (key and text) come out once per copy, so callers that want one drop duplicates by key and piece;
    texts of blanks only are cut hard; a text too long by its outer blanks alone gives one piece without them, so what is
    oversized shows in ``whole=False``, not in ``n_pieces``; an empty table gives none. Other columns are ignored.
    Only oversized texts travel through Python; the rest stays in the JVM.
    """
    if max_chars < 1 or max_words < 1 or not 0 <= overlap < max_chars:
        raise ValueError("limits must be positive and the overlap smaller than max_chars")
    fits = F.col(end_char) - F.col(start_char) == F.length(text)
    row = F.struct(F.col(key).cast("string").alias("key"), F.col(article_number).cast("string").alias("article_number"), F.col(document_id).cast("string").alias("document_id"), F.when(fits, F.col(start_char)).cast("int").alias("source_start"))
    over = is_oversized(F.col(text), max_chars, max_words)
    pieces = df.where(over).select(row.alias("row"), F.col(text).alias("text")).mapInArrow(_split_batches(max_chars, max_words, overlap), _OUT)
    if whole:
        pieces = pieces.unionByName(df.where(~over).select(row.alias("row"), F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.col(text).alias("text"), F.when(F.col(text).isNotNull(), 0).alias("piece_start"), F.length(text).alias("piece_end")))
    return pieces.select(F.col("row.key").alias(key), "row.document_id", "row.article_number", "piece_no", "n_pieces", "text", "piece_start", "piece_end", (F.col("row.source_start") + F.col("piece_start")).alias("start_char"), (F.col("row.source_start") + F.col("piece_end")).alias("end_char"))


__all__ = ["is_oversized", "relocate", "split_oversized", "split_spans"]

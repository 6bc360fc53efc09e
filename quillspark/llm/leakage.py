"""Evaluation passages inside corpus documents, by Wu-Manber multi-pattern search (problem 6).

Patterns are all windows of ``min_words`` words of the items (of ``min_chars`` letters and digits for
languages without blanks). All windows of one length share one shift table over blocks: a block that
stands nowhere in an item lets the search skip a whole window less a block. A block that ends a
window is looked up in the suffix buckets and confirmed by direct comparison in both directions.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode_text import fold_words
from quillspark.session import cut_lineage

# Languages written without blanks between words.
UNSPACED = ("zh", "ja", "th", "lo", "km", "my")
#: Characters of the scripts of those languages.
_UNSPACED_LETTERS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")

#: Text of items that one pass over the corpus carries along; more items take further passes.
ITEM_CHARS_PER_PASS = 4_000_000


class WuManber:
    """Finds which of many sequences share a run of at least ``window`` units with a text.

    Works on any sliceable sequence: a list of words or a string.
    """

    def __init__(self, items: Sequence[tuple[int, Sequence]], window: int, block: int) -> None:
        self.window, self.block, self.items = window, block, [x for x in items if len(x[1]) >= window]
        self.ends: dict = {}  # block -> where it ends a window of an item
        self.shift: dict = {}  # block -> how far the window may move on; blocks in no item: all the way
        most = window - block + 1
        for k, (_, units) in enumerate(self.items):
            for end in range(block, len(units) + 1):
                key = self.key(units[end - block : end])
                if end >= window:
                    self.ends.setdefault(key, []).append((k, end))
                    self.shift[key] = 0
                elif self.shift.get(key, most) > window - end:
                    self.shift[key] = window - end
        self.most = most

    @staticmethod
    def key(units: Sequence):
        return units if isinstance(units, str) else tuple(units)

    def search(self, text: Sequence) -> set[int]:
        """Ids of the items with a run of ``window`` units in ``text``."""
        found: set[int] = set()
        window, block, shift, most, as_str = self.window, self.block, self.shift, self.most, isinstance(text, str)
        n, pos = len(text), window
        while pos <= n:
            key = text[pos - block : pos] if as_str else tuple(text[pos - block : pos])
            step = shift.get(key, most)
            if step:
                pos += step
                continue
            for k, end in self.ends[key]:
                item_id, units = self.items[k]
                if item_id in found or text[pos - window : pos - block] != units[end - window : end - block]:
                    continue
                found.add(item_id)
            pos += 1
        return found


@lru_cache(4)
def _searchers(packed: bytes) -> tuple[WuManber, WuManber]:
    items, min_words, min_chars = pickle.loads(packed)
    spaced = [(i, fold_words(t)) for i, lang, t in items if not _unspaced(lang, t)]
    solid = [(i, "".join(fold_words(t))) for i, lang, t in items if _unspaced(lang, t)]
    return WuManber(spaced, min_words, max(1, min(4, min_words))), WuManber(solid, min_chars, max(1, min(10, min_chars)))


def _unspaced(lang: str | None, text: str) -> bool:
    lang = (lang or "").strip().lower()
    return lang.split("-")[0] in UNSPACED if lang and lang != "und" else 2 * len(_UNSPACED_LETTERS.findall(text)) > len(re.sub(r"\s", "", text))


def _search_batches(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, solid = _searchers(packed)
        for b in batches:
            ids, docs = [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = fold_words(text)
                hits = spaced.search(words) if spaced.items else set()
                if solid.items and _UNSPACED_LETTERS.search(text):
                    hits = hits | solid.search("".join(words))
                ids += sorted(hits)
                docs += [doc] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(ids, pa.int64())], names=["doc", "item_id"])

    return run


def _passes(items: DataFrame, item_id: Column, lang: Column, text: Column) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, each streamed to the driver and shipped with one pass."""
    held, size = [], 0
    for row in items.select(item_id.cast("long").alias("i"), lang.cast("string").alias("l"), text.alias("t")).where("i is not null and t is not null").toLocalIterator():
        held.append((row.i, row.l, row.t))
        size += len(row.t)
        if size >= ITEM_CHARS_PER_PASS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaked_items(documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_lang: Column, item_text: Column, min_words: int = 20, min_chars: int = 50) -> DataFrame:
    """``doc_id STRING, item_id BIGINT``: each document with each item of which it holds a passage.

    A passage is ``min_words`` consecutive words of the item, or ``min_chars`` letters and digits if the
    item's language is written without blanks (told by its script where the language is not given);
    case, accents, punctuation, markup, line breaks, blanks and invisible characters don't count.
    Null ids and texts match nothing; shorter items can't match; repeated rows give their pairs once;
    an item text held twice under two ids gives both; empty tables give no rows. Extra columns are ignored.
    Documents are read once per pass and never shuffled; only found pairs are. The driver holds the items of
    one pass; where there are more, what a pass found is written before the next one begins.
    """
    docs = documents.select(doc_id.cast("string").alias("doc"), text.alias("text")).where("doc is not null and length(text) > 0")
    out, blocks = None, _passes(items, item_id, item_lang, item_text)
    block = next(blocks, None)
    while block is not None:
        part = docs.mapInArrow(_search_batches(pickle.dumps((block, min_words, min_chars))), "doc string, item_id long")
        block = next(blocks, None)
        if out is not None or block is not None:
            part = cut_lineage(part.distinct())
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id string, item_id long")
    return out.distinct().withColumnRenamed("doc", "doc_id")


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item how many documents hold it; items without a leak stand with 0."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "split", "lang").join(n, "item_id", "left").select("item_id", "split", "lang", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))

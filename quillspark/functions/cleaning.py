"""Conservative cleaning of passages: presentation noise goes, visible content stays."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

# What counts as markup, and the notice of a web portal that is no content.
HINT_TAGS = "br|p|div|span|table|thead|tbody|tr|td|th|strong|em|b|i|img|script|style"
BLOCK_TAGS = "br|p|div|li|table|thead|tbody|tr|h[1-6]"
INLINE_TAGS = "span|td|th|strong|em|b|i|u|font|a"
NOTICE = (
    r"Bạn\s+phải\s+đăng\s+nhập\s+hoặc\s+đăng\s+ký\s+Thành\s+Viên\s+TVPL\s+Pro\s+để\s+sử\s+dụng\s+được\s+đầy\s+đủ\s+các\s+tiện\s+ích\s+gia\s+tăng\s+liên\s+quan\s+đến\s+nội\s+dung\s+TCVN\."
    r"\s*Mọi\s+chi\s+tiết\s+xin\s+liên\s+hệ:\s*ĐT:\s*\(028\)\s*3930\s*3279\s*DĐ:\s*0906\s*22\s*99\s*66"
)


def _tag(names: str, rest: str = "[^>]*>") -> re.Pattern:
    return re.compile(rf"<\s*/?\s*(?:{names})\b{rest}", re.I)


_HINT, _BLOCK, _INLINE = _tag(HINT_TAGS, ""), _tag(BLOCK_TAGS), _tag(INLINE_TAGS)
_CODE = re.compile(r"<\s*(script|style)\b[^>]*>.*?<\s*/\s*\1\s*>", re.I | re.S)
_IMAGE = re.compile(r"<\s*img\b([^>]*)/?>", re.I)
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NOTICE = re.compile(NOTICE, re.I)
_DROPPED = re.compile("[\ufeff\u200b-\u200d\u2060]")
_TO_BLANK = re.compile("[\xa0\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def clean_passage(text: str) -> tuple[str, int, int, bool, bool]:
    """The clean text; how many pieces of markup and notices went; whether the input wasn't NFC and had carriage returns."""
    was_nfc, had_cr = unicodedata.is_normalized("NFC", text), "\r" in text
    text = unicodedata.normalize("NFC", re.sub("\r\n?", "\n", text))
    text = _TO_BLANK.sub(" ", _DROPPED.sub("", text))
    markup = 0
    if _HINT.search(text):
        for pattern, by in ((_CODE, ""), (_IMAGE, lambda m: next(filter(None, a.groups()), "") if (a := _ALT.search(m[1])) else ""), (_BLOCK, "\n"), (_INLINE, "")):
            text, n = pattern.subn(by, text)
            markup += n
    text, notices = _NOTICE.subn("\n", text)
    lines = (re.sub("[ \t]+", " ", x).strip() for x in text.split("\n"))
    text = re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()
    # entities last: markup that was escaped is content
    return html.unescape(text), markup, notices, not was_nfc, had_cr


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(None,) * 5 if t is None else clean_passage(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "cleaned_text", "markup_removed", "notices_removed", "was_not_nfc", "had_cr"])


def clean_passages(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``id, cleaned_text`` and the counters of :func:`clean_passage`; null texts give nulls."""
    src = df.select(key.alias("id"), text.alias("text"))
    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(_batches, f"id {kind}, cleaned_text string, markup_removed int, notices_removed int, was_not_nfc boolean, had_cr boolean")

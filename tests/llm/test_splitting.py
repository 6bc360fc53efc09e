import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import splitting

LIMITS = {"max_chars": 120, "max_words": 20, "overlap": 30}


def check(text, spans, max_chars, max_words, overlap):
    covered = [False] * len(text)
    for i, (a, b) in enumerate(spans):
        assert 0 <= a < b <= len(text) and b - a <= max_chars and len(text[a:b].split()) <= max_words
        covered[a:b] = [True] * (b - a)
        if i:
            assert a > spans[i - 1][0] and b > spans[i - 1][1] and spans[i - 1][1] - a <= overlap
    assert all(c or text[i].isspace() for i, c in enumerate(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\xa0\u3000。é\u2028", max_size=900))
def test_pieces_hold_limits_and_cover_all_words(text):
    spans = splitting.split_spans(text, **LIMITS)
    if len(text) <= 120 and len(text.split()) <= 20:
        assert spans == [(0, len(text))]
    else:
        check(text, spans, **LIMITS)


def test_natural_boundaries_come_first():
    clause = "Điều 1. " + "một hai ba bốn. " * 4
    text = clause + "\n" + clause.replace("Điều 1", "Điều 2") + "\n" + clause.replace("Điều 1", "Điều 3")
    spans = splitting.split_spans(text, 100, 100, 0)
    assert [text[a:b].startswith("Điều") for a, b in spans] == [True] * 3
    spans = splitting.split_spans("Một câu dài vừa phải ở đây. " * 20, 130, 100, 40)
    assert all(("Một câu dài vừa phải ở đây. " * 20)[a:b].endswith(".") for a, b in spans) and len(spans) > 3


def test_hard_cut_and_long_texts():
    check("x" * 5000, splitting.split_spans("x" * 5000, **LIMITS), **LIMITS)
    text = " ".join("w" * random.Random(i).randrange(1, 9) for i in range(60_000))
    check(text, splitting.split_spans(text, 1200, 250, 150), 1200, 250, 150)


SCHEMA = "chunk_id string, document_id string, article_number string, text string, start_char int, end_char int, piece_no int, row string"


def test_operator_cases(spark):
    long = "một hai ba. " * 200
    rows = [
        ("long", "d1", "7", long, 100, 100 + len(long), 9, "clash"), ("long", "d1", "7", long, 100, 100 + len(long), 9, "clash"), ("stale", "d1", None, long, 5, 10, 9, "c"),
        ("null", "d1", None, None, None, None, 9, "c"), ("empty", "d1", None, "", 0, 0, 9, "c"), ("short", None, None, "ab", 3, 5, None, None), (None, "d", None, "x", None, None, 0, ""),
    ]
    out = splitting.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    pieces = sorted({(r.piece_no, r.text, r.start_char, r.end_char) for r in by["long"]})
    assert len(by["long"]) == 2 * len(pieces) and len(pieces) == by["long"][0].n_pieces > 1
    assert all(long[s - 100 : e - 100] == t for _, t, s, e in pieces) and {r.article_number for r in by["long"]} == {"7"}
    assert all(r.start_char is None for r in by["stale"]) and long[by["stale"][0].piece_start : by["stale"][0].piece_end] == by["stale"][0].text
    assert [(r.text, r.n_pieces, r.start_char) for r in by["null"]] == [(None, 1, None)]
    assert [(r.text, r.piece_end) for r in by["empty"]] == [("", 0)] and [(r.start_char, r.end_char) for r in by["short"]] == [(3, 5)] and len(by[None]) == 1
    assert splitting.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oversized_counts_blanks_of_any_kind(spark):
    rows = [("nbsp", "\xa0".join(["w"] * 251)), ("cjk", "\u3000".join(["w"] * 251)), ("fit", " ".join(["w"] * 250)), ("chars", "x" * 1201), ("at", "x" * 1200), ("null", None), ("ogham", "\u1680".join(["w"] * 251)), ("zw", "\u200b".join(["w"] * 251))]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {r.k for r in df.where(splitting.is_oversized(F.col("t"), 1200, 250)).collect()}
    assert got == {"nbsp", "cjk", "chars", "ogham"}


def test_relocate(spark):
    docs = spark.createDataFrame([("d", "abc điều một. điều hai."), ("e", None)], "document_id string, cleaned_text string")
    rows = [("ok", "d", None, "điều một.", 4, 13), ("stale", "d", None, "điều hai.", 0, 9), ("gone", "d", None, "không có", 0, 8), ("none", "e", None, "x", 1, 2)]
    out = splitting.relocate(spark.createDataFrame(rows, "chunk_id string, document_id string, article_number string, text string, start_char int, end_char int"), docs)
    assert {r.chunk_id: (r.start_char, r.end_char) for r in out.collect()} == {"ok": (4, 13), "stale": (14, 23), "gone": (None, None), "none": (None, None)}


def test_relocate_takes_the_nearest_place(spark):
    docs = spark.createDataFrame([("d", "điều A. điều A. điều B điều A.")], "document_id string, cleaned_text string")
    rows = [("near", 9), ("front", -5), ("far", 90), ("tie", 4), ("back", 20), ("none", None)]
    c = spark.createDataFrame([(k, "d", None, "điều A.", s, None if s is None else s + 3) for k, s in rows], "chunk_id string, document_id string, article_number string, text string, start_char int, end_char int")
    assert {r.chunk_id: r.start_char for r in splitting.relocate(c, docs).collect()} == {"near": 8, "front": 0, "far": 23, "tie": 0, "back": 23, "none": None}
    only = c.withColumn("text", F.lit("điều B"))
    assert {r.start_char for r in splitting.relocate(only, docs).collect()} == {16}


def test_found_holds_texts_oversized_by_outer_blanks(spark, tmp_path):
    from quillspark.llm import queries

    inner = "x" * 1195
    rows = [("after", inner + " " * 10), ("before", "\n" * 10 + inner), ("both", "\xa0" * 3 + inner + "\n" * 3), ("at", inner + " " * 5), ("blank", " " * 1201), ("long", "một hai. " * 200), ("null", None)]
    df = spark.createDataFrame([(k, "d", "1", t, None, None) for k, t in rows], "chunk_id string, document_id string, article_number string, text string, start_char int, end_char int")
    df.write.parquet(str(tmp_path / "legal_chunks.parquet"))
    assert {r.chunk_id for r in queries.p3_found(spark, str(tmp_path)).collect()} == {"after", "before", "both", "blank", "long"}
    pieces = {r.chunk_id: r for r in splitting.split_oversized(df).where("chunk_id in ('after', 'before', 'both')").collect()}
    assert all(r.text == inner and r.n_pieces == 1 and r.piece_end - r.piece_start == 1195 for r in pieces.values()) and len(pieces) == 3

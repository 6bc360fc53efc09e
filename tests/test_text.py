import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import answers as a
from quillspark.functions import columns as c
from quillspark.functions import unicode_text as u
from quillspark.functions.cleaning import clean_passage, clean_passages
from quillspark.operators import lexical


def one(spark, column, **values):
    return spark.range(1).select(column(*(F.lit(v) for v in values.values())).alias("x")).first().x


def test_normalisation(spark):
    assert one(spark, c.normalize_question, x="  Điều  KIỆN\n nào? Straße ") == "điều kiện nào? strasse"
    assert one(spark, c.fold_accents, x="  Đường  phố ") == "duong pho" and u.casefold_key(" Điều  Ki") == "điều ki"
    assert one(spark, c.distinct_tokens, x="Một hai MỘT, ba_bốn ½") == ["một", "hai", "ba", "bốn", "½"]
    assert one(spark, c.tokens, x=None) == [] and u.fold_words("<b>Đ</b>iều&nbsp;１２") == ["dieu", "12"]
    assert one(spark, lambda t: c.longest_terms(c.distinct_tokens(t), 3, 2), x="aaaa bb ccccc dddd eee") == ["aaaa", "ccccc"]


def test_hash_bucket_is_the_first_eight_bytes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256("s\0câu".encode()).digest()[:8], "big") % 97
    assert one(spark, lambda t: c.hash_bucket("s", t, 97), x="câu") == want


def test_small_functions(spark):
    assert one(spark, c.rouge_tokens, x="Việt Nam, ĐIỀU 12-A!") == ["vi", "t", "nam", "i", "u", "12", "a"]
    row = spark.range(1).select(
        c.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), c.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("e"),
        c.label_mask(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7))).alias("m"), c.search_text(F.lit("T"), F.lit(""), F.lit(None), F.lit("T"), F.lit("x")).alias("s"),
        c.is_upper_heading(F.lit("QUYẾT ĐỊNH CHUNG")).alias("h"), c.is_https(F.lit("https://a.b/c")).alias("u"), c.is_https(F.lit("http://a")).alias("v"),
        c.chunk_id(F.lit("9"), F.lit(3), F.lit("x")).alias("id"), c.finish_reason(F.lit(2), F.lit(9), 2, 10).alias("f"), c.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"),
        c.section_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.array(F.lit("a"))).alias("sc"),
        c.source_number(F.lit("QUẾ\nSố: 12/2020/QĐ-ABC\nĐiều 1. A\nSố: 3/2021/X")).alias("n"), c.source_number(F.lit("1/2020/A và 2/2020/B")).alias("n2"),
    ).first()
    assert (row.j, row.e, row.m, row.s, row.h, row.u, row.v) == (0.5, 1.0, [-100, -100, 7], "T\nx", True, True, False)
    assert row.id.startswith("ctx-9::00003::") and len(row.id) == 14 + 12 and row.f == "eos" and row.d is None
    assert row.sc == 2 + 1.5 * 0.5 + 0.5 * 0.25 + 0.8 and row.n == "12/2020/QĐ-ABC" and row.n2 is None


def test_answer_diagnostics(spark):
    d = one(spark, c.answer_diagnostics, x="Một dòng dài.\nMột dòng dài.\nxong")
    assert d.duplicate_line and d.non_sentence_ending and not d.abbreviation_loop
    assert one(spark, c.answer_diagnostics, x="QĐ" + "-AB" * 12 + ".").abbreviation_loop


def test_cleaning(spark):
    assert clean_passage("a\r\nb \tc\x00d<li>x")[0] == "a\nb c d<li>x"
    text, markup, notices, not_nfc, cr = clean_passage("<p>A<script>x()</script> <img src=x alt='chữ'/><b>B</b> &lt;p&gt;</p>\r\n\r\n\r\n\r\nC")
    assert (text, notices, not_nfc, cr) == ("A chữB <p>\n\nC", 0, False, True) and markup == 6
    df = spark.createDataFrame([(1, None), (2, ""), (3, "e\u0302")], "id long, text string")
    assert {r.id: (r.cleaned_text, r.was_not_nfc) for r in clean_passages(df, F.col("id"), F.col("text")).collect()} == {1: (None, None), 2: ("", False), 3: ("ê", True)}


S = "Người lao động có quyền đơn phương chấm dứt hợp đồng theo quy định của bộ luật này."


def test_suffix_cleanup():
    assert a.clean_answer(f"{S} {S} {S} Người lao động có quyền đơn phương chấm dứt hợp") == S
    assert a.trim_repeated_tail("a\nb\na\nb") == "a\nb" and a.trim_repeated_tail("Một. Một. Một.") == "Một."
    block = " ".join(f"w{i}" for i in range(40))
    assert a.trim_long_suffix(f"x {block} {block} {block}") == f"x {block}"
    assert a.trim_numbered_copies("Đầu:\n1. như nhau\n2. như nhau\n3. như nhau\n4.") == "Đầu:\n1. như nhau"
    assert a.trim_short_list_item("- nộp hồ sơ đầy đủ\n- nộp hồ sơ đầy đủ\n- nộp hồ") == "- nộp hồ sơ đầy đủ\n- nộp hồ sơ đầy đủ"
    assert a.trim_partial_suffix("Một câu thôi") == "Một câu thôi" and a.clean_answer("  ") == "  "
    long, tail = S + " Thêm vài chữ nữa cho đủ dài và rõ ràng hơn một chút.", "Phần sau cùng vẫn còn nội dung riêng đủ dài để giữ lại."
    assert a.trim_interior(f"{long}\n{long}\n{tail}") == f"{long} \n{tail}".replace(" \n", " ") or a.trim_interior(f"{long}\n{long}\n{tail}").count("đơn phương") == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a. ", "b. ", "1. x\n", "2. x\n", "3. x\n", "- ab c\n", "- ab", "\n", "dài hơn một chút "]), max_size=14))
def test_cleanup_gives_a_prefix_and_is_stable(parts):
    text = "".join(parts)
    once = a.clean_answer(text)
    assert text.startswith(once) and a.clean_answer(once) == once


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for p in x:
        last = 0
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_bit_vector_lcs(x, y):
    assert a._lcs(x, y) == lcs(x, y)


def test_scores():
    assert a.rouge_l("ABC 12", "abc---12") == 1.0 and a.rouge_l("", "x") == a.rouge_l("x", None) == 0.0 and a.rouge_l("a b c d", "a c") == pytest.approx(2 * 2 / 6)
    assert a.meteor_exact("a b c", "a b c") == pytest.approx(1 - 0.5 / 27) and a.meteor_exact("a", "b") == 0.0


def test_bm25_equals_fts5(spark):
    rng = random.Random(1)
    words = ["luật", "điều", "khoản", "thuê", "đất", "nhà", "x1", "y2", "z3", "quyền"]
    docs = [(f"d{i:03}", " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(1, 25)))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 0')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(docs)])
    index = lexical.build_index(spark.createDataFrame(docs, "id string, t string"), F.col("id"), lexical.word_tokens(F.col("t")))
    queries = [(1, "luật thuê đất"), (2, "x1 y2"), (3, "quyền quyền"), (4, "không có"), (5, None), (None, "luật")]
    out = {}
    for r in lexical.bm25_search(index, spark.createDataFrame(queries, "q int, t string"), F.col("q"), lexical.word_tokens(F.col("t")), 1000).collect():
        out.setdefault(r.query, {})[r.id] = r.score
    assert set(out) == {1, 2, 3}
    for q, text in queries[:3]:
        match = " OR ".join(f'"{w}"' for w in dict.fromkeys(text.split()))
        want = {docs[i][0]: -s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert out[q].keys() == want.keys() and all(out[q][k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


def test_index_round_trip_and_folded_and_substring(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Đường phố Huế"), ("b", "duong ray"), ("c", None), ("d", "phố cổ")], "id string, t string")
    index = lexical.build_index(docs, F.col("id"), lexical.folded_tokens(F.col("t")))
    index.write(str(tmp_path), 2)
    q = spark.createDataFrame([(1, "ĐƯỜNG phố")], "q int, t string")
    for i in (index, lexical.LexicalIndex.read(spark, str(tmp_path))):
        assert [r.id for r in lexical.bm25_search(i, q, F.col("q"), lexical.folded_tokens(F.col("t")), 5).collect()] == ["a", "b", "d"]
    hits = lexical.substring_search(docs, F.col("id"), F.col("t"), q, F.col("q"), F.col("t"), 5).collect()
    assert [(r.id, r.rank) for r in hits] == [("a", 1)]
    assert lexical.substring_search(docs, F.col("id"), F.col("t"), q.limit(0), F.col("q"), F.col("t"), 5).count() == 0


def test_interior_repetitions_differ_by_case():
    long, tail = S + " Thêm vài chữ nữa cho đủ dài và rõ ràng hơn một chút.", "Phần sau cùng vẫn còn nội dung riêng đủ dài để giữ lại."
    assert a.trim_interior(f"{long}\n{long.upper()}\n{tail}") == f"{long}\n{long.upper()}\n{tail}"
    assert a.trim_interior(f"{long}\n{long.replace(' ', '  ')}\n{tail}") == f"{long} {tail}"


def test_notice_without_blanks_goes():
    notice = "Bạn phải đăng nhập hoặc đăng ký Thành Viên TVPL Pro để sử dụng được đầy đủ các tiện ích gia tăng liên quan đến nội dung TCVN.Mọi chi tiết xin liên hệ:ĐT:(028)3930 3279DĐ:0906 22 99 66"
    assert clean_passage(f"Đầu\n{notice}\nCuối")[0] == "Đầu\n\n\nCuối".replace("\n\n\n", "\n\n") and clean_passage(notice)[2] == 1


def test_questions_are_normalised_as_unicode_has_it(spark):
    import unicodedata

    texts = ["  Điều  5\x1f?", unicodedata.normalize("NFD", "Điều khoản ẾỆ"), "STRASSE ß ẞ", "ΣΊΣΥΦΟΣ ς", "İstanbul ŉ ﬁ ǰ", "ſ µ", "a 　b", "İ", "plain", "", None, "K Å", "q̣̇"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(c.normalize_question(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()) for t in texts]

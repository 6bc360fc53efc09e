import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import broken_pairs as b
from quillspark.llm.langid import language

VI = "Bên bảo lãnh ở Hạ Đường được quyền nộp hồ sơ xin lịch trực ban theo khoản 2 Điều 19; vậy có cần họp toàn thể thành viên không?"
EN = "The market committee in Trucdam must withdraw the lease annex before noon; so who bears the extra cost under section 12?"
OK = "Bên bảo lãnh phải nộp lại hồ sơ trong 5 ngày."


@pytest.mark.parametrize("answer", [None, "", "  ", "\xa0\u200b", "<p></p>", "<br/>\n<br/>", "&nbsp;", "N/A", "null", "-", "[]", "???", "…", "(Đang cập nhật)"])
def test_empty(answer):
    assert b.defect(VI, answer, "vi") == "empty"


@pytest.mark.parametrize(
    "answer",
    ["Xin lỗi, tôi không thể trả lời câu hỏi này.", "Là một trợ lý tự động, tôi không đưa ra kết luận pháp lý. Mong bạn thông cảm.", "Cảm ơn bạn đã hỏi, nội dung này nằm ngoài phạm vi của tôi. Bạn hãy hỏi luật sư.", "Toi khong du thong tin de tra loi."],
)
def test_refusal(answer):
    assert b.defect(VI, answer, "vi") == "refusal"


def test_refusal_in_english_and_what_is_none():
    assert b.defect(EN, "I'm sorry, but I cannot answer this question. Please consult a lawyer.", "en") == "refusal"
    assert b.defect(EN, "I am not a lawyer, but the text is clear. The leaseholder must pay within 5 days.", "en") is None
    assert b.defect(VI, OK + " Cơ quan không thể từ chối trả lời đơn hợp lệ; xin lỗi công khai khi từ chối sai.", "vi") is None
    assert b.defect(VI, "Không.", "vi") is None and b.defect(VI, "Không bắt buộc.", "vi") is None


@pytest.mark.parametrize(
    "answer",
    ["I'm afraid this question cannot be dealt with here.", "As this concerns a legal matter, no reply is possible.", "I am not able to give legal advice. Try the competent office.", "Unfortunately we are unable to help with that request.", "This topic is outside my remit.", "Từ chối trả lời.", "Câu hỏi này không được giải đáp."],
)
def test_refusals_in_other_words(answer):
    assert b.defect(EN, answer, None) == "refusal"


@pytest.mark.parametrize(
    "answer",
    ["The agency cannot provide a permit without the form.", "You cannot give the deposit back late.", "The registry may refuse the request.", "This request cannot be processed without the tender file.", "The land lies outside the scope of the plan.", "We cannot refuse to answer."],
)
def test_what_others_may_not_do_is_no_refusal(answer):
    assert b.defect(EN, answer, "en") is None


def test_no_length_turns_a_refusal_into_an_answer():
    long = "I'm sorry, but I, as an automated assistant, cannot answer this question or any other question about this matter, as it concerns the law, and the law is for lawyers, so please do consult a lawyer about it or try the competent office again."
    assert len(long.split()) > 40 and b.defect(EN, long, "en") == "refusal"


def slow_align(question, answer):
    n, m = len(question), len(answer)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if question[i] == answer[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if question[i] == answer[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_alignment_by_bit_vectors_is_that_of_the_table(question, answer):
    assert b.align(question, answer) == slow_align(question, answer)


def test_alignment_of_long_texts():
    words = [f"w{i % 977}" for i in range(20_000)]
    assert len(b.align(words, words[:9_000] + ["x"] + words[9_000:])) == 20_000


def test_copied():
    plain = "ben bao lanh o ha duong duoc quyen nop ho so xin lich truc ban theo khoan 2 dieu 19; vay co can hop toan the thanh vien khong"
    typo = VI.replace("Đường", "Đưỡng").replace("quyền", "quyềm").replace("hồ sơ", "hồ")
    for answer in (VI, VI[:-1] + ".", "Câu hỏi: " + VI, "“" + VI + "”", VI + " " + VI, plain, typo, "<p>" + VI + "</p>"):
        assert b.defect(VI, answer, "vi") == "copied", answer
    assert b.defect(VI, VI[:-1] + ": " + OK, "vi") is None
    assert b.defect(VI, OK, "vi") is None


def test_language():
    assert b.defect(VI, "The market committee must withdraw the lease annex.", "vi") == "language"
    assert b.defect(EN, OK, "en") == "language" and b.defect(VI, "清算人不得登记施工日志。", None) == "language"
    assert b.defect(VI, "Le liquidateur doit publier la caution versée pour les tiers sous 12 jours.", "vi") == "language"
    assert b.defect(EN, "Penyewa wajib menyerahkan lampiran perjanjian sewa kepada kantor sebelum pukul dua belas.", "en") == "language"
    assert b.defect(EN, "El arrendatario debe entregar el anexo antes del mediodía.", "en") == "language" and b.defect(EN, "Der Mieter muss den Anhang vor Mittag abgeben.", "en") == "language"
    assert b.defect(EN, "60 days.", "en") is None and b.defect(EN, "Yes.", "en") is None
    assert b.defect(VI, "Ben bao lanh phai nop lai ho so trong 5 ngay khi co quyet dinh.", "vi") is None
    assert b.defect(VI, "Hợp đồng ghi “free on board” và “force majeure” vẫn dùng được.", "vi") is None


@pytest.mark.parametrize("answer", ["Bên bảo lãnh phải", OK + " Chủ phương tiện nộp,", OK + " Gồm các giấy tờ sau:", OK[:-1] + " và ghi rõ “cơ", OK + " Nộp tại TP.", OK + " Theo Quyết định số 7/2015/QĐ-", OK[:-1] + " (tại khoản"])
def test_truncated(answer):
    assert b.defect(VI, answer, "vi") == "truncated"


@pytest.mark.parametrize("answer", [OK, OK + " (Điều 48, khoản 4)", "Ghi rằng: “" + OK + "”", OK[:-1] + ", v.v.", "60 ngày.", OK + "</p>", OK + "\u200b"])
def test_finished(answer):
    assert b.defect(VI, answer, "vi") is None


def test_one_word_answers_are_finished():
    assert b.defect(EN, "No.", "en") is None and b.defect(EN, "60 days. No.", "en") is None and b.is_truncated("as stated in No.") and not b.is_truncated("han che rui ro chay no.")


def test_language_detection():
    assert [language(t)[0] for t in ("第57条 作業員名簿を変更する", "测绘队有权登记", "ภายใน 48 วัน", "Землемерная служба", "करेगा।", "", None, "123")] == ["ja", "zh", "th", "ru", "hi", None, None, None]


def test_operator(spark):
    rows = [(1, VI, None, "vi"), (2, VI, OK, "vi"), (None, VI, None, "vi"), (3, None, None, None), (4, None, OK, None), (5, VI, OK[:-1] * 5000, "vi"), (1, VI, None, "vi"), (6, "", OK, "en")]
    df = spark.createDataFrame([(i, q, a, lang, "x") for i, q, a, lang in rows], "record_id long, question string, answer string, lang string, defect string")
    out = b.broken_pairs(df, F.col("record_id"), F.col("question"), F.col("answer"), F.col("lang"))
    assert sorted((r.id, r.defect) for r in out.collect()) == [(1, "empty"), (1, "empty"), (3, "empty"), (5, "truncated"), (6, "language")]
    assert b.broken_pairs(df.limit(0), F.col("record_id"), F.col("question"), F.col("answer"), F.col("lang")).count() == 0


def test_copies_of_short_questions():
    from quillspark.functions.unicode_text import fold_words
    from quillspark.llm.broken_pairs import is_copy

    copied = lambda q, a: is_copy(fold_words(q), fold_words(a))
    assert copied("Mức phí?", "Mức phí.") and copied("Mức phí?", "Câu hỏi: muc phi? Mức phí?") and copied("可以登记吗？", "可以登记吗？可以登记吗") and copied("可以登记吗？", "可以登记吗可以登记吗。")
    assert not copied("Mức phí?", "Mức phí 50.000 đồng.") and not copied("可以登记吗？", "可以登记。") and not copied("Có không?", "Có.") and not copied("?", "Có.") and not copied("Mức phí?", "")

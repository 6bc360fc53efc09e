from pyspark.sql import functions as F

from quillspark.llm import sentences as s

MODEL = s.Model([("vi", "name", "TP", ""), ("vi", "name", "PGS", ""), ("vi", "digit", "tr", ""), ("vi", "starter", "nếu", ""), ("en", "name", "Dr", ""), ("hi", "caseless", "डॉ", ""), ("ru", "digit", "п", "")])


def cut(text, lang="vi", model=MODEL):
    out, at = [], 0
    for e in s.unit_ends(text, lang, model):
        out.append(text[at:e].strip())
        at = e
    return out


def test_periods_and_quotes():
    assert cut("Tại TP. Huế, xem tr. 5. Nếu không thì thôi. iBến 3.4 ghi nhận.") == ["Tại TP. Huế, xem tr. 5.", "Nếu không thì thôi.", "iBến 3.4 ghi nhận."]
    assert cut("Ông trả lời: “Được. Không sao.” Rồi đi. “Sao?” bà hỏi. Hết…") == ["Ông trả lời: “Được. Không sao.”", "Rồi đi.", "“Sao?” bà hỏi.", "Hết…"]
    assert cut("Phí… nếu có… thì nộp 1.234.000 đồng. (Lưu ý: nộp sớm.) Xong?! Rồi.") == ["Phí… nếu có… thì nộp 1.234.000 đồng.", "(Lưu ý: nộp sớm.)", "Xong?!", "Rồi."]
    assert cut("Theo Điều 51. Nếu vậy. Gồm: 1. Lô hàng; 2. Kho.") == ["Theo Điều 51.", "Nếu vậy.", "Gồm: 1. Lô hàng; 2. Kho."]


def test_layout():
    assert cut("TIÊU ĐỀ\nĐiều 27. Giấy tờ\n1. Một câu. Hai câu.\na) Mục; \n") == ["TIÊU ĐỀ", "Điều 27. Giấy tờ", "1. Một câu.", "Hai câu.", "a) Mục;"]
    assert cut("Đầu đề\n\n1. Câu bị ngắt\ndòng ở đây. Câu\nhai.\r\n\r\nHết.") == ["Đầu đề", "1. Câu bị ngắt\ndòng ở đây.", "Câu\nhai.", "Hết."]
    text = "<p>Một <b>câu.</b></p>\n<p>Hai<br/>ba.</p>"
    ends = s.unit_ends(text, "vi", MODEL)
    assert [text[e - 4 : e] for e in ends] == ["câu.", "/>ba."[1:]] or len(ends) == 2
    table = "<table><tr><td>Một</td><td>hai</td></tr><tr><td>Ba</td></tr></table>"
    assert [table[e - 3 : e] for e in s.unit_ends(table, "vi", MODEL)] == ["hai", ">Ba"]
    wrapped = "Nếu tài sản thuộc sở hữu chung, trạm kiểm soát được quyền bàn giao\nbản vẽ hoàn công để bảo đảm quyền lợi của bên thứ ba với mức cao\nnhất. Xong rồi."
    assert len(cut(wrapped)) == 2


def test_scripts():
    assert cut("甲不得登记。委员问：“可以？”乙没有回答。费率为6.62%……丙。", "zh") == ["甲不得登记。", "委员问：“可以？”", "乙没有回答。", "费率为6.62%……", "丙。"]
    assert cut("係員は「できる。例外はない。」と述べた。「できるか？」と尋ねた。", "ja") == ["係員は「できる。例外はない。」と述べた。", "「できるか？」と尋ねた。"]
    assert cut("ถ้าอีกฝ่าย เมื่อต้น ภายใน 48 วัน หลังการ", "th") == ["ถ้าอีกฝ่าย", "เมื่อต้น", "ภายใน 48 วัน", "หลังการ"]
    assert cut("डॉ. पट्टाधारी करेगा। अधिकृत करेगा? हाँ।", "hi") == ["डॉ. पट्टाधारी करेगा।", "अधिकृत करेगा?", "हाँ।"]
    assert cut("См. п. 7. Затем. «Нет!» — ответил он. Да.", "ru") == ["См. п. 7.", "Затем.", "«Нет!» — ответил он.", "Да."]
    assert cut("M. est là ! Il dit : « Oui ! » Un autre.", "fr") == ["M. est là !", "Il dit : « Oui ! »", "Un autre."]


def test_offsets_with_invisible_characters_and_width():
    text = "Mộ\u200bt câu.\ufeff Ｈai câu.\u2060"
    assert s.unit_ends(text, "vi", MODEL) == [text.index(".") + 1, text.rindex(".") + 1]
    assert s.unit_ends("", "vi", MODEL) == s.unit_ends(None, "vi", MODEL) == s.unit_ends(" \n \u200b<p></p>", "vi", MODEL) == []


def corpus(spark):
    places, starts = ["Huế", "Vinh", "Kon", "Hội", "Tum", "Lai"], ["Nếu cần", "Người mua", "Bên bán", "Khi đó", "Theo luật"]
    rows = [(i, f"{starts[i % 5]} thì đến TP. {places[i % 6]} xem tr. {i} của sách. {starts[(i + 1) % 5]} không đến thì thôi! {starts[(i + 2) % 5]} phải nộp đủ, v.v. {starts[(i + 3) % 5]} về {places[(i + 1) % 6]}.", "VI " if i % 2 else "vi") for i in range(300)]
    return spark.createDataFrame([(*r, "clash", 1) for r in [*rows, (900, None, "vi"), (901, "", None), (902, "Một dòng", None), (0, rows[0][1], "vi"), (None, "x", "vi")]], "doc_id long, text string, lang string, id string, unit_no int")


def test_learning_and_both_ways_of_applying(spark, monkeypatch):
    df = corpus(spark)
    model = s.learn(df, F.col("text"), F.col("lang"))
    got = {(r.kind, r.a) for r in model.collect()}
    assert ("name", "TP") in got and ("digit", "tr") in got and not {("name", "v.v"), ("name", "sách"), ("digit", "sách")} & got
    args = (df, F.col("doc_id"), F.col("text"), F.col("lang"), model)
    units = sorted((r.id, r.unit_no, r.end_char) for r in s.sentence_units(*args).collect())
    assert sum(u[0] == 5 for u in units) == 4 and sum(u[0] == 0 for u in units) == 8 and sum(u[0] == 902 for u in units) == 1 and not {900, 901, None} & {u[0] for u in units}
    monkeypatch.setattr(s, "MODEL_ROWS", 1)
    assert sorted((r.id, r.unit_no, r.end_char) for r in s.sentence_units(*args).collect()) == units


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert s.sentence_units(df, F.col("doc_id"), F.col("text"), F.col("lang")).count() == 0
    assert len(s.unit_ends("Một câu. " * 50_000, "vi", MODEL)) == 50_000


def test_long_lines_of_tables_and_lists_are_units():
    rows = ["|".join(f"{k * 7919 % 99991:05}" for k in range(i, i + 12)) for i in range(1, 5)]
    index = ["." * 70 + str(n) for n in (9, 63, 96)]
    assert cut("\n".join(rows)) == rows and cut("\n".join(index), "ja") == index and cut("\n".join(rows), "hi") == rows
    first = "Cơ quan thu phí có nghĩa vụ lưu giữ mức bồi thường, xem thêm tr. 248, bản in 2."
    assert cut("\n".join([first, *rows])) == [first, *rows]
    items = [f"{c}) bản sao có chứng thực của giấy phép khai thác nước ngầm số {i};" for i, c in enumerate("abcd")]
    headings = [f"Điều {i}. Quyền và nghĩa vụ của tổ chức kiểm định và của người lao động" for i in range(5)]
    assert cut("\n".join(items)) == items and cut("\n".join(headings)) == headings
    wrapped = ["Nếu tài sản thuộc sở hữu chung, trạm kiểm soát được quyền bàn giao", "bản vẽ hoàn công để bảo đảm quyền lợi của bên thứ ba với mức phí cao nhất."]
    assert cut("\n".join([*wrapped, *rows])) == ["\n".join(wrapped), *rows]
    assert len(cut("बाजार समिति तीसरे पक्ष की रक्षा के लिए दोहरी वसूली से बचने के लिए पारगमन\nरसीद वापस लेगा। दूसरी सूचना के बाद जाँच।", "hi")) == 2


def test_languages_with_few_periods_are_counted_too(spark):
    rows = [(i, f"ตาม พ.ศ. {2500 + i} ให้คืนเงิน ใน พ.ศ. {2400 + i} จบ. เมื่อนั้น{i} แล้ว. ถ้า จบ", "th") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = s.learn(df, F.col("text"), F.col("lang"))
    learned = s.Model([tuple(r) for r in model.select("lang", "kind", "a", "b").collect()])
    assert cut("ใน พ.ศ. 2562 จบ", "th", learned) == ["ใน", "พ.ศ. 2562 จบ"]

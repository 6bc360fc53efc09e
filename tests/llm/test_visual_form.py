import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import visual_form as v

BASE = "Điều 12. Quyền sử dụng ổn định"


def variants():
    full = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in BASE)
    return [BASE, unicodedata.normalize("NFD", BASE), full, BASE.replace(" ", "\xa0"), BASE.replace("u", "u\u200b"), BASE.replace("Q", "Q\xad"), BASE.replace("n", "n\u2060").replace(" ", "\u3000"), BASE.replace("e", "е").replace("s", "ѕ"), BASE.replace("ề", "ề")]


def test_all_variants_share_a_skeleton_and_read_as_one():
    assert {v.skeleton(x) for x in variants()} == {v.skeleton(BASE)}
    assert {v.one_form(x) for x in variants()} == {BASE}


def test_visible_differences_stay():
    others = [BASE.lower(), BASE.replace(" ", "  "), BASE + ".", BASE.replace("Điều", "Diều"), BASE.replace("12", "13"), BASE.replace(" ", "\n"), BASE.replace("ề", "ê")]
    assert len({v.skeleton(x) for x in [BASE, *others]}) == len(others) + 1


def test_readable_form_keeps_scripts():
    assert v.one_form("Статья 5. Договор") == "Статья 5. Договор"
    assert v.one_form("догoвор") == "договор"
    assert v.one_form("ＡＢＣ１２、東京") == "ABC12、東京"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeẹ̣́́\u200b\xa0ａＡаеο \nĐｶ゙\r", max_size=40))
def test_forms_are_stable_and_splicing_equals_the_whole(text):
    assert v.skeleton(v.skeleton(text)) == v.skeleton(text)
    assert v.one_form(v.one_form(text)) == v.one_form(text)
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(v.plain_forms()))
    assert v._spliced(text, False, v._coded) == whole


def brute(rows):
    found = set()
    for (k, t), (m, u) in combinations(sorted({(k, t) for k, t in rows if k is not None and t is not None}), 2):
        if k != m and t != u and v.skeleton(t) == v.skeleton(u):
            found.add((min(k, m), max(k, m)))
    return found


def test_pairs(spark):
    rows = [(f"k{i}", t) for i, t in enumerate(variants())] + [(f"copy{i}", BASE) for i in range(30)] + [("k0", BASE), ("n1", None), (None, BASE), ("e1", ""), ("e2", "\u200b"), ("long1", "a" * 200_000), ("long2", "\u0430" * 200_000), ("same", BASE.lower())]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "key string, text string, raw string, class_id string").repartition(3)
    got = [(r.key_a, r.key_b) for r in v.lookalike_pairs(df, F.col("key"), F.col("text")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert v.lookalike_pairs(df.limit(0), F.col("key"), F.col("text")).count() == 0


def test_links_and_a_class_of_many_copies(spark):
    df = spark.range(100_000).select(F.concat(F.lit("c"), F.col("id")).alias("key"), F.lit(BASE).alias("text"))
    one = spark.createDataFrame([("v", BASE.replace(" ", "\xa0")), ("v", BASE.replace(" ", "\xa0")), ("w", "alone"), (None, BASE)], "key string, text string")
    df = df.unionByName(one)
    assert v.lookalike_pairs(df, F.col("key"), F.col("text")).agg(F.count("*"), F.min("key_b"), F.max("key_b")).first() == (100_000, "v", "v")
    links = v.lookalike_links(df, F.col("key"), F.col("text")).groupBy("n_links").agg(F.count("*").alias("n"), F.max("key").alias("k"))
    assert sorted(map(tuple, links.collect())) == [(1, 100_000, "c99999"), (100_000, 1, "v")]
    plan = v.lookalike_pairs(df, F.col("key"), F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_a" in plan and "key_a < key_b" not in plan
    assert v.lookalike_links(df.limit(0), F.col("key"), F.col("text")).count() == 0


def test_canonical_texts(spark):
    df = spark.createDataFrame([("a", "ｘ\xa0y"), ("b", None), ("c", ""), ("a", "ｘ\xa0y")], "k string, t string")
    out = sorted((r.key, r.form, r.changed) for r in v.canonical_texts(df, F.col("k"), F.col("t")).collect() if r.key != "b")
    assert out == [("a", "x y", True), ("a", "x y", True), ("c", "", False)]
    assert v.canonical_texts(df.where("k = 'b'"), F.col("k"), F.col("t")).first() == ("b", None, False, None)


def test_compatibility_ideographs_beyond_the_first_planes():
    from quillspark.llm import visual_form

    for old, new in (("\U0002f800", "\u4e3d"), ("\U0002fa1d", "\U0002a600")):
        assert visual_form.skeleton(f"甲{old}乙") == visual_form.skeleton(f"甲{new}乙") and visual_form.one_form(f"甲{old}乙") == f"甲{new}乙"

import random

from pyspark.sql import functions as F

from quillspark.functions.unicode_text import fold_words
from quillspark.llm import leakage as k

RNG = random.Random(9)
VOCABULARY = [a + b for a in "bcdghk" for b in ("a", "e", "i", "o", "u", "an", "on")]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(text, item, window):
    grams = {tuple(item[i : i + window]) for i in range(len(item) - window + 1)}
    return any(tuple(text[i : i + window]) in grams for i in range(len(text) - window + 1))


def test_wu_manber_against_brute_force():
    rng = random.Random(3)
    for window, block in ((5, 2), (6, 4), (4, 4), (3, 1)):
        items = [(i, words(rng.randrange(1, 30), rng)) for i in range(25)]
        search = k.WuManber(items, window, block)
        for _ in range(150):
            text = words(rng.randrange(0, 60), rng)
            if rng.random() < 0.7:
                _, item = rng.choice(items)
                a = rng.randrange(len(item))
                at = rng.randrange(len(text) + 1)
                text[at:at] = item[a : a + rng.randrange(window - 1, window + 3)]
            assert search.search(text) == {i for i, item in items if brute(text, item, window)}


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, doc string, item_id int").repartition(3)
    e = spark.createDataFrame([(i, lang, t, 3) for i, lang, t in items], "item_id long, lang string, text string, doc_id int")
    out = [(int(r.doc_id), r.item_id) for r in k.leaked_items(d, F.col("doc_id"), F.col("text"), e, F.col("item_id"), F.col("lang"), F.col("text")).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_operator(spark):
    item = [f"từ{i}" for i in range(40)]
    text = " ".join(item)
    zh = "".join(chr(0x4E00 + i) for i in range(80))
    docs = [
        (1, "x " + " ".join(item[5:25]) + " y"), (2, "x " + " ".join(item[5:24]) + " y"), (3, "<p>" + "\n".join(x.upper() for x in item[10:32]) + "</p>"), (4, " , ".join(item[0:20]).replace("từ", "tu\u200b")),
        (5, "前" + "，".join(zh[10:60]) + "后"), (6, zh[10:59]), (7, None), (8, ""), (1, "x " + " ".join(item[5:25]) + " y"), (9, "z " * 300_000 + text), (None, text), (10, " ".join(item[0:10] + ["x"] + item[10:20])),
    ]
    items = [(1, "vi", text), (2, "zh", zh), (3, None, zh), (4, "vi", " ".join(item[:19])), (5, "vi", None), (None, "vi", text), (6, "en", text)]
    assert leaks(spark, docs, items) == {(d, i) for d in (1, 3, 4, 9) for i in (1, 6)} | {(5, 2), (5, 3)}
    assert leaks(spark, docs, []) == leaks(spark, [], items) == set()


def test_many_passes_equal_one(spark, monkeypatch):
    items = [(i, "vi", " ".join(words(30))) for i in range(12)]
    docs = [(i, " ".join(words(20) + fold_words(items[i % 12][2])[3:25] + words(9))) for i in range(40)]
    one = leaks(spark, docs, items)
    monkeypatch.setattr(k, "ITEM_CHARS_PER_PASS", 200)
    assert leaks(spark, docs, items) == one and len(one) >= 40


def test_report(spark):
    items = spark.createDataFrame([(1, "dev", "vi"), (2, "dev", "en")], "item_id long, split string, lang string")
    pairs = spark.createDataFrame([("5", 1), ("6", 1)], "doc_id string, item_id long")
    assert {(r.item_id, r.n_documents) for r in k.leak_report(pairs, items).collect()} == {(1, 2), (2, 0)}

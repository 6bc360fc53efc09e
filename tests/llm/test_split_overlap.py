import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import split_overlap as o

SCHEMA = "record_id long, question string, split string, words string, class_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, q, s, "clash", 1) for i, q, s in rows], SCHEMA).repartition(3)


def brute(rows, t=0.8):
    parts = [(i, s == "train", set(w), d) for i, q, s in set(rows) if i is not None and s is not None for w, d in [o.question_parts(q)] if w]
    return {(i, j) for i, a, x, d in parts if a for j, b, y, e in parts if not b and d == e and len(x & y) >= t * len(x | y) - 1e-9}


def run(spark, rows, t=0.8):
    out = o.question_overlaps(frame(spark, rows), F.col("record_id"), F.col("question"), F.col("split"), threshold=t)
    got = [(r.train_id, r.other_id) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def noisy(rng, words):
    words = list(words)
    for _ in range(rng.randrange(0, max(1, len(words) // 6) + 1)):
        k = rng.randrange(len(words))
        words[k] = f"x{rng.choice('abcdefgh')}" if rng.random() < 0.6 else words[k]
    if rng.random() < 0.5:
        rng.shuffle(words)
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [a + b for a in "bcdghklmn" for b in ("a", "an", "e", "i", "o", "oi", "u")]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 6, 9, 13, 15, 16, 17, 20, 30, 50]))] for _ in range(60)]
    for i in range(700):
        rows.append((i, noisy(rng, rng.choice(base)) + rng.choice(["", "", " 12", " 1 2"]), rng.choice(["train", "train", "dev", "public"])))
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows) == want
    assert run(spark, rows, 0.9) == brute(rows, 0.9) and run(spark, rows, 1.0) == brute(rows, 1.0)


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([0.75, 0.8, 0.9, 1.0]))
def test_similar_texts_share_a_key(seed, t):
    rng = random.Random(seed)
    universe = [f"w{i}" for i in range(90)]
    a = set(rng.sample(universe, rng.randrange(1, 80)))
    b = set(a)
    while True:
        c = set(b)
        c.symmetric_difference_update({rng.choice(universe)})
        if not c or len(a & c) < t * len(a | c) - 1e-9 or rng.random() < 0.05:
            break
        b = c
    ranks = {w: i for i, w in enumerate(rng.sample(universe, 30))}
    row, position, lead, n, signature = o.suffix_rows([" ".join(sorted(a)), " ".join(sorted(b))], ["", ""], ranks, t)
    order = np.argsort(lead, kind="stable")
    rows = np.stack([row, signature[row], n[row] << 32 | position << 2 | (1 << row)])[:, order]
    pairs, wide = o.interval_pairs(lead[order], rows, t, 1 << 40)
    assert not wide.any() and (a == b or (0, 1) in {(x, y) for p in pairs for x, y in zip(*(c.tolist() for c in p), strict=True)})
    assert sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in [signature]) <= len(a ^ b)


def test_wide_intervals_are_spread_over_a_grid(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(["aa", "ab", *rng.sample(["zc", "zd", "ze", "zf", "zg", "zh", "zi", "zj"], 4)]), rng.choice(["train", "dev"])) for i in range(300)]
    parts = o.question_texts(frame(spark, rows), F.col("record_id"), F.col("question"), F.col("split"))
    want = {(r.class_a, r.class_b) for r in o.class_pairs(parts).collect()}
    monkeypatch.setattr(o, "INTERVAL_PAIRS", 9)
    monkeypatch.setattr(o.candidates, "__defaults__", (9,))
    assert {(r.class_a, r.class_b) for r in o.class_pairs(parts).collect()} == want and len(want) > 20
    assert run(spark, rows) == brute(rows)


def test_spelling_digits_nulls_and_copies(spark):
    q = "Bên bảo lãnh ở Hạ Đường được quyền nộp hồ sơ theo khoản 2 Điều 19 không"
    rows = [
        (1, q, "train"), (2, q.upper() + "?!", "dev"), (3, "<p>" + q.replace("được", "duoc") + "</p>", "holdout"), (4, q.replace("19", "91"), "dev"), (5, q, "train"), (6, q.replace(" ", " "), "public"),
        (7, None, "train"), (8, "", "dev"), (9, "?!", "train"), (10, "?!", "dev"), (11, q, None), (None, q, "dev"), (1, q, "train"), (12, q.replace("19", "19 19"), "dev"), (13, "từ " * 50_000, "train"), (14, "từ", "dev"),
    ]
    assert run(spark, rows) == brute(rows) == {(i, j) for i in (1, 5) for j in (2, 3, 6)} | {(13, 14)}
    assert run(spark, []) == set()


def test_links_count_what_pairs_would_show(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.choice([2, 5, 12, 30]))] for _ in range(12)]
    rows = [(i, noisy(rng, rng.choice(base)), rng.choice(["train", "dev", "public"])) for i in range(200)] + [(0, None, "train"), (None, "w1 w2", "dev")]
    pairs = brute(rows)
    want = {}
    for i, j in pairs:
        want[i, True] = want.get((i, True), 0) + 1
        want[j, False] = want.get((j, False), 0) + 1
    out = o.overlap_links(frame(spark, rows), F.col("record_id"), F.col("question"), F.col("split")).collect()
    assert {(r.id, r.is_train): r.n_links for r in out} == want and len(out) == len(want) > 50
    assert o.overlap_links(frame(spark, []), F.col("record_id"), F.col("question"), F.col("split")).count() == 0


def report(df):
    out = o.overlap_report(df, F.col("record_id"), F.col("question"), F.col("split"), F.col("source")).collect()
    return sorted((r.split, r.source, r.n_records, r.n_overlapping, r.n_pairs, r.mean_coverage) for r in out)


def test_report(spark):
    ten = "alpha beta gamma delta eps zeta eta theta iota kappa"
    rows = [(1, ten, "train"), (2, ten.upper(), "dev"), (3, "khác hẳn rồi", "dev"), (4, ten, "train"), (4, ten, "train"), (None, ten, "dev"), (9, None, "dev"), (9, None, "public")]
    assert report(frame(spark, rows).withColumn("source", F.lit("s"))) == [("dev", "s", 3, 1, 2, 1.0), ("public", "s", 1, 0, 0, None)]
    assert report(frame(spark, []).withColumn("source", F.lit("s"))) == []


def test_coverage_is_of_each_records_own_word_order(spark):
    ten = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rows = [(1, " ".join(ten), "train"), (2, " ".join(reversed(ten)), "dev"), (3, " ".join(ten[5:] + ten[:5]), "public"), (4, " ".join([*ten[:3], *ten[2::-1], *ten[3:]]), "holdout"), (5, "một hai", "train"), (6, "một hai", "x")]
    assert report(frame(spark, rows).withColumn("source", F.lit(None).cast("string"))) == [("dev", None, 1, 1, 1, 0.0), ("holdout", None, 1, 1, 1, 10 / 13), ("public", None, 1, 1, 1, 1.0), ("x", None, 1, 1, 1, 1.0)]


def test_coverage_merges_the_spans_of_all_training_texts(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words[:10] + words[:9:-1]), "train"), (2, " ".join(words[9::-1] + words[10:]), "train"), (3, " ".join(words), "dev")]
    assert report(frame(spark, rows).withColumn("source", F.lit("s"))) == [("dev", "s", 1, 1, 2, 1.0)]

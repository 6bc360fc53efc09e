import math
import random

from pyspark.sql import functions as F

from quillspark.llm import top_items

SCHEMA = "question_id string, fused array<struct<chunk_id:string, rrf_score:double, branch_ranks:map<string,int>>>, score string, item int"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(q, None if f is None else [(c, s, None) for c, s in f], "x", 1) for q, f in rows], SCHEMA).repartition(parts)


def brute(rows, n):
    best = {}
    for q, f in rows:
        for c, s in f or ():
            if q is not None and c is not None and s is not None and not math.isnan(s):
                best.setdefault(q, {})[c] = max(s, best.get(q, {}).get(c, -math.inf))
    return {(q, k + 1, c) for q, b in best.items() for k, (c, _) in enumerate(sorted(b.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


def run(spark, rows, n=5, parts=3):
    return {(r.question_id, r.rank_no, r.chunk_id) for r in top_items.best_chunks(rows_of(spark, rows, parts), n).collect()}


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"q{rng.randrange(40)}", [(f"c{rng.randrange(60)}", rng.choice([0.1, 0.2, 0.25, 0.3])) for _ in range(rng.randrange(8))]) for _ in range(2000)]
    assert run(spark, rows, parts=7) == brute(rows, 5)


def test_nulls_nan_ties_repeats_and_infinity(spark):
    rows = [
        (None, [("a", 1.0)]), ("n", None), ("e", []), ("x", [("a", None), ("b", float("nan")), (None, 9.0)]),
        ("t", [("b", 0.5), ("a", 0.5), ("é", 0.5), ("Z", 0.5)]), ("t", [("b", 0.5), ("a", 0.5)]),
        ("d", [("a", 0.1), ("a", 0.7), ("b", 0.5)]), ("d", [("a", 0.1), ("a", 0.7), ("b", 0.5)]),
        ("i", [("a", math.inf), ("b", -math.inf), ("c", -0.0), ("d", 0.0)]),
    ]
    assert run(spark, rows) == brute(rows, 5)
    assert ("t", 1, "Z") in run(spark, rows) and ("i", 2, "c") in run(spark, rows)


def test_flush_keeps_the_result(spark, monkeypatch):
    rows = [(f"q{i % 50}", [(f"c{j}", (i * j) % 17 / 7) for j in range(9)]) for i in range(600)]
    monkeypatch.setattr(top_items, "FLUSH_ROWS", 10)
    assert run(spark, rows) == brute(rows, 5)


def test_arrays_of_different_length(spark):
    df = spark.createDataFrame([("q", ["a", "b"], [1.0]), ("q", ["c"], [2.0, 3.0]), ("p", ["a"], None)], "g string, i array<string>, s array<double>")
    out = top_items.top_n_per_group(df, F.col("g"), F.col("i"), F.col("s"), 5).collect()
    assert {(r.group, r.item, r.score) for r in out} == {("q", "a", 1.0), ("q", "c", 2.0)}


def test_empty_table_and_long_ids(spark):
    assert run(spark, []) == set()
    long = "x" * 200_000
    assert run(spark, [("q", [(long, 1.0)])]) == {("q", 1, long)}


def test_contexts(spark):
    schema = "question_id string, fused array<struct<chunk_id:string, rrf_score:double>>, contexts array<struct<chunk_id:string, document_id:string, article_number:string, text:string>>, run_at timestamp"
    import datetime as dt

    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    rows = [("q", [("c1", 1.0), ("c2", 0.5)], [("c1", "d", None, "old")], a), ("q", [("c1", 0.9)], [("c1", "d", "3", "new"), (None, "d", "1", "t")], b), ("q", None, None, None)]
    out = top_items.best_chunks_with_context(spark.createDataFrame(rows, schema)).collect()
    assert {(r.chunk_id, r.context_text, r.article_number) for r in out} == {("c1", "new", "3"), ("c2", None, None)}

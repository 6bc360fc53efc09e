import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing as m

TARGETS = "source string, target_share double, max_repeats int, doc string"


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def sizes(spark, rows, parts=4):
    return spark.createDataFrame([(d, s, n, "x") for d, s, n in rows], "doc string, source string, n_tokens long, rate string").repartition(parts)


def test_plan():
    t = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2), "none": (0.1, 3)}
    give = m.plan_shares({"a": 1000, "b": 100, "c": 1000}, t)
    assert give["b"] == pytest.approx(400) and give["a"] / give["b"] == pytest.approx(5 / 3) and give["c"] / give["b"] == pytest.approx(2 / 3)
    give = m.plan_shares({"a": 1000, "b": 100, "c": 1000}, t, total=2000)
    assert give["b"] == pytest.approx(400) and sum(give.values()) == pytest.approx(2000) and give["a"] <= 1000
    assert m.plan_shares({"a": 10}, {"a": (1.0, 2)}, total=1000) == {"a": 20} and m.plan_shares({}, t) == {}


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(2)
    for _ in range(300):
        p, q, a, b = rng.random(), rng.random(), rng.randrange(1, 500), rng.randrange(1, 500)
        x, y = m.pivot(p, a, q, b, rng.random())
        assert (x in (0.0, 1.0) or y in (0.0, 1.0)) and a * x + b * y == pytest.approx(a * p + b * q)
    mean = sum(m.pivot(0.3, 10, 0.6, 40, u / 20_000)[0] for u in range(20_000)) / 20_000
    assert mean == pytest.approx(0.3, abs=0.002)


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_mix_meets_shares(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(m, "FAN_IN", 5)
    rng = random.Random(4)
    rows = [(str(i), rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"]), rng.randrange(0, 300)) for i in range(3000)]
    goal = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 2)]
    copies, report = m.mix_sources(sizes(spark, rows), targets(spark, goal))
    got = {r.doc: r for r in copies.collect()}
    assert len(got) == 3000 and all(0 <= r.copies <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in got.values()) and all(r.copies == 0 for r in got.values() if r.n_tokens == 0)
    tokens = {s: sum(r.copies * r.n_tokens for r in got.values() if r.source == s) for s in ("big", "mid", "small")}
    out = {r.source: r for r in report.collect()}
    assert all(abs(tokens[s] - out[s].planned_tokens) <= 300 and out[s].mixed_tokens == tokens[s] for s in tokens)
    assert out["absent"].reached_share == 0 and out["big"].reached_share == pytest.approx(0.5, abs=0.01) and out["small"].highest_copies <= 4
    again, _ = m.mix_sources(sizes(spark, rows, 7), targets(spark, goal))
    assert {r.doc: r.copies for r in again.collect()} == {d: r.copies for d, r in got.items()}


def test_each_level_of_the_tree_is_rounded_once(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 2)
    monkeypatch.setattr(m, "FAN_IN", 2)
    rows = [(str(i), "a", 10 + i) for i in range(64)]
    copies, _ = m.mix_sources(sizes(spark, rows), targets(spark, [("a", 1.0, 1)]), total=900)
    assert copies._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert copies.agg(F.count("*"), F.countDistinct("doc")).first() == (64, 64) and abs(copies.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] - 900) <= 80


def test_edge_cases(spark):
    rows = [("1", "a", 10), ("2", None, 10), ("3", "other", 10), ("4", "a", 0), ("1", "a", 10)]
    copies, report = m.mix_sources(sizes(spark, rows), targets(spark, [("a", None, None), ("b", 0.5, 1)]))
    assert {r.source: (r.mixed_tokens, r.n_documents) for r in report.collect()} == {"a": (0, 3), "b": (0, 0), None: (0, 1), "other": (0, 1)}
    copies, report = m.mix_sources(sizes(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert copies.count() == 0 and [(r.source, r.reached_share) for r in report.collect()] == [("a", 0.0)]
    copies, report = m.mix_sources(sizes(spark, rows), targets(spark, []))
    assert copies.count() == 0 and report.count() == 3
    copies, _ = m.mix_sources(sizes(spark, [("1", "a", 7)]), targets(spark, [(" A ", 1.0, 3)]))
    assert [(r.doc, r.copies) for r in copies.collect()] == [("1", 3)]
    with pytest.raises(ValueError):
        m.mix_sources(sizes(spark, rows), targets(spark, [("a", 0.5, 1), ("A ", 0.5, 1)]))


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "  Forum ", "xin chào " * 20_000), (2, " RADIO\u3000", ""), (3, None, None), (4, "  ", "a")], "id long, source string, text string")
    out = {r.doc: (r.source, r.n_tokens) for r in m.token_sizes(df, F.col("id"), F.col("source"), F.col("text")).collect()}
    assert out["1"][0] == "forum" and out["1"][1] > 10_000 and out["2"] == ("radio", 0) and out["3"] == (None, 0) and out["4"][0] is None and out["4"][1] == 1

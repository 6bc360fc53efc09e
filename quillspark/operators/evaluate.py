"""Scores of predictions, paired comparisons with bootstrap intervals, gates, failure audits."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.answers import meteor_exact_udf, rouge_l_udf
from quillspark.operators.audit import require_same_ids, require_unique
from quillspark.session import cut_lineage


def score_predictions(references: DataFrame, predictions: DataFrame, key: str = "question_id") -> DataFrame:
    """``key, rouge_l, meteor_exact`` for tables of ``key, answer`` with equal, unique ids (else an error); a null prediction scores 0."""
    for t in (references, predictions):
        require_unique(t, key)
    require_same_ids(references, predictions, key)
    j = references.select(key, F.col("answer").alias("r")).join(predictions.select(key, F.col("answer").alias("p")), key)
    return score_columns(j, key)


def score_columns(pairs: DataFrame, key: str) -> DataFrame:
    """Scores of ``key, r, p`` rows."""
    return pairs.select(key, rouge_l_udf(F.col("r"), F.col("p")).alias("rouge_l"), meteor_exact_udf(F.col("r"), F.col("p")).alias("meteor_exact"))


def paired_deltas(candidate: DataFrame, control: DataFrame, key: str, metric: str) -> DataFrame:
    """``key, delta``: candidate minus control for ids that both have."""
    return candidate.select(key, F.col(metric).alias("a")).join(control.select(key, F.col(metric).alias("b")), key).select(key, (F.col("a") - F.col("b")).alias("delta"))


def delta_summary(deltas: DataFrame, tie: float = 0.0) -> DataFrame:
    """One row: rows, mean, least, largest, and how many are better, worse and tied within ``tie``."""
    d = F.col("delta")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return deltas.agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), count(d > tie)("improved"), count(d < -tie)("worsened"), count(F.abs(d) <= tie)("tied"))


def bootstrap_numpy(values: list[float], seed: int = 20260830, resamples: int = 10_000) -> tuple[float, float]:
    """95 % interval of the mean by resampling with numpy's generator; linear quantiles."""
    v, rng = np.asarray(values, dtype=np.float64), np.random.default_rng(seed)
    step = max(1, 4_000_000 // max(1, len(v)))
    means = np.concatenate([v[rng.integers(0, len(v), size=(min(step, resamples - i), len(v)))].mean(axis=1) for i in range(0, resamples, step)])
    low, high = np.quantile(means, [0.025, 0.975])
    return float(low), float(high)


def bootstrap_seeded(values: list[float], seed: str, resamples: int = 2_000) -> tuple[float, float]:
    """The same with the standard library's generator, seeded by a string; the interval's ends are ranks ``int(p * (n - 1))``."""
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]


def bootstrap(deltas: DataFrame, key: str, by: str | None = None, seed: int = 20260830, resamples: int = 10_000) -> DataFrame:
    """``by, n, mean_delta, low, high``. An evaluation sample (thousands of rows) meets in one task per group, in order of its key; see :func:`poisson_bootstrap` for large ones."""
    src = deltas.select(F.col(by).cast("string").alias("by") if by else F.lit("all").alias("by"), F.col(key).alias("key"), F.col("delta").cast("double").alias("delta")).where("delta is not null")

    def run(table: pa.Table) -> pa.Table:
        v = table.sort_by("key")["delta"].to_pylist()
        low, high = bootstrap_numpy(v, seed, resamples)
        return pa.table({"by": pa.array([table["by"][0].as_py()], pa.string()), "n": pa.array([len(v)], pa.int64()), "mean_delta": [sum(v) / len(v)], "low": [low], "high": [high]})

    return src.groupBy("by").applyInArrow(run, "by string, n long, mean_delta double, low double, high double")


def poisson_bootstrap(deltas: DataFrame, key: str, resamples: int = 200) -> DataFrame:
    """An interval for samples of any size: every row draws its Poisson(1) weight per resample from the hash of its key; sums are merged by the aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for h, d in zip(b.column("h").to_pylist(), b.column("delta").to_pylist(), strict=True):
                w = np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF).poisson(1.0, resamples)
                sums += w * d
                counts += w
        yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), pa.array(sums), pa.array(counts)], names=["r", "s", "c"])

    src = deltas.where("delta is not null").select(F.xxhash64(key).alias("h"), F.col("delta").cast("double").alias("delta"))
    means = src.mapInArrow(run, "r int, s double, c double").groupBy("r").agg((F.sum("s") / F.sum("c")).alias("m")).where("m is not null")
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def bootstrap_by_rank(deltas: DataFrame, key: str, seed: str, resamples: int = 2_000) -> DataFrame:
    """``n, mean_delta, low, high`` by :func:`bootstrap_seeded`: the sample in order of its key meets in one task, as the generator's sequence is one."""
    src = deltas.select(F.lit("all").alias("by"), F.col(key).cast("string").alias("key"), F.col("delta").cast("double").alias("delta")).where("delta is not null")

    def run(table: pa.Table) -> pa.Table:
        v = table.sort_by("key")["delta"].to_pylist()
        low, high = bootstrap_seeded(v, seed, resamples)
        return pa.table({"n": pa.array([len(v)], pa.int64()), "mean_delta": [sum(v) / len(v)], "low": [low], "high": [high]})

    return src.groupBy("by").applyInArrow(run, "n long, mean_delta double, low double, high double")


def paired_gate(candidate: DataFrame, control: DataFrame, key: str, main: str, second: str, flag: str, least: float = 0.010, seed: int = 20260830, resamples: int = 10_000) -> DataFrame:
    """One row of a paired comparison and its gate, over ids that both have.

    Accepted if the mean difference of ``main`` is ``least`` or more, its 95 % interval lies above 0, the mean difference of
    ``second`` isn't negative and ``flag`` (a boolean, such as an answer cut for length) is rarer than with the control.
    """
    a, b = (t.select(key, *(F.col(c).alias(f"{p}{i}") for i, c in enumerate((main, second, flag)))) for t, p in ((candidate, "a"), (control, "b")))
    j = a.join(b, key).select(key, (F.col("a0") - F.col("b0")).alias("delta"), (F.col("a1") - F.col("b1")).alias("d1"), F.col("a2").cast("double").alias("fa"), F.col("b2").cast("double").alias("fb"))
    j = cut_lineage(j)  # read by the summary and by the resampling
    rest = j.agg(F.avg("d1").alias("mean_second"), F.avg("fa").alias("candidate_rate"), F.avg("fb").alias("control_rate"))
    row = delta_summary(j, 1e-6).join(F.broadcast(rest)).join(F.broadcast(bootstrap(j, key, seed=seed, resamples=resamples).select("low", "high")), how="left")
    c = F.col
    return acceptance(row, {"mean_ok": c("mean_delta") >= least, "interval_ok": c("low") > 0, "second_ok": c("mean_second") >= 0, "rate_ok": c("candidate_rate") < c("control_rate")})


def compare_rankings(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``system, n_queries, hit_rate, recall, reciprocal_rank`` of ``system, query, id, rank`` against ``query, id``, over queries with a relevant id.

    All systems in one pass: a query that a system has no ranking for counts with 0.
    """
    want = relevant.select("query", "id").distinct()
    sizes = want.groupBy("query").agg(F.count("*").alias("n_relevant"))
    tops = rankings.where(F.col("rank") <= k).select("system", "query", "id", "rank").join(want, ["query", "id"], "left_semi")
    per = tops.groupBy("system", "query").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("best"))
    grid = sizes.join(F.broadcast(rankings.select("system").distinct()))  # one row per system
    j = grid.join(per, ["system", "query"], "left")
    return j.groupBy("system").agg(F.count("*").alias("n_queries"), F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0))).alias("recall"), F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("reciprocal_rank"))


def positioned(references: DataFrame, results: DataFrame, key: str, position: str) -> DataFrame:
    """``key, expected, found``: ids that don't stand at the same position in both, or are missing from one."""
    a, b = references.select(key, F.col(position).alias("expected")), results.select(key, F.col(position).alias("found"))
    return a.join(b, key, "full").where("not (expected <=> found)")


def acceptance(summary: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """A one-row summary with each condition and ``accepted``, which holds if all do (null counts as failed)."""
    out = summary
    for name, c in conditions.items():
        out = out.withColumn(name, F.coalesce(c, F.lit(False)))
    accepted = F.lit(True)
    for name in conditions:
        accepted = accepted & F.col(name)
    return out.withColumn("accepted", accepted)


def best_variant(scores: DataFrame, variant: str, *metrics: str) -> DataFrame:
    """One row: the variant with the greatest metrics, compared in order."""
    return scores.agg(F.max_by(variant, F.struct(*metrics)).alias("best"))


def lowest(scores: DataFrame, metric: str, key: str, n: int = 40) -> DataFrame:
    """The review set: the ``n`` lowest scores, ties by key."""
    return scores.orderBy(metric, key).limit(n)


def optional_means(df: DataFrame, by: list[str], means: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Means over the rows where each is eligible: name -> (value, eligible); null where no row is."""
    return df.groupBy(*by).agg(*(F.avg(F.when(ok, v)).alias(n) for n, (v, ok) in means.items()), *(F.sum(F.when(ok, 1).otherwise(0)).alias(f"n_{n}") for n, (_, ok) in means.items()))


def coalesce_passes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Answers of a second pass where it finished, else of the first, with the pass that was used."""
    s = second.select(key, F.col("answer").alias("_s"))
    return first.join(s, key, "left").select(key, F.coalesce("_s", "answer").alias("answer"), F.when(F.col("_s").isNotNull(), "second").otherwise("first").alias("used_pass"))


def order_changes(orders: DataFrame) -> DataFrame:
    """One row about ``query, before, after`` (arrays of ids): how often the order and the first id changed."""
    share = lambda c: F.avg(c.cast("double"))
    changed, top = F.col("before") != F.col("after"), F.element_at("before", 1) != F.element_at("after", 1)
    return orders.agg(F.count("*").alias("n"), F.sum(changed.cast("int")).alias("n_changed"), F.sum(top.cast("int")).alias("n_top_changed"), share(changed).alias("rate_changed"))


def mean_distinct(rows: DataFrame, variant: str, query: str, **what: Column) -> DataFrame:
    """Per variant the mean over queries of the number of distinct values (nulls within a struct are a value)."""
    per = rows.groupBy(variant, query).agg(*(F.countDistinct(c).alias(n) for n, c in what.items()))
    return per.groupBy(variant).agg(*(F.avg(n).alias(n) for n in what))


def rank_windows(df: DataFrame, query: str, before: Column, after: Column) -> DataFrame:
    """Old and new rank of each row of a query, for the trace of a reranker."""
    return df.withColumn("old_rank", F.row_number().over(Window.partitionBy(query).orderBy(before))).withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(after)))


def variant_rollup(scores: DataFrame, variant: str, metrics: list[str], flags: list[str]) -> DataFrame:
    """Per variant: rows, mean of each metric, count and rate of each flag."""
    return scores.groupBy(variant).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics), *(F.sum(F.col(f).cast("int")).alias(f"n_{f}") for f in flags), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags))


def failure_audit(scores: DataFrame, contexts: DataFrame, key: str, metric: str, n: int = 40) -> DataFrame:
    """The lowest scores beside what the retrieval gave for them (``key, n_contexts, best_score``); a key without contexts has 0."""
    low = lowest(scores, metric, key, n)
    return low.join(contexts, key, "left").withColumn("n_contexts", F.coalesce("n_contexts", F.lit(0)))


def import_finished(earlier: DataFrame, plan: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Finished records of an earlier partial run that the plan asks for, and what is left of the plan."""
    done = earlier.where("finish_reason = 'eos'").join(plan.select(key), key, "left_semi").dropDuplicates([key])
    return done, plan.join(done.select(key), key, "left_anti")

"""Fusing rankings: weighted reciprocal ranks, weight grids, articles from chunks, overlap measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C


def _parts(branches: dict[str, float], constant: float) -> list[Column]:
    """One sum per branch, so that the total adds up in a fixed order."""
    return [F.sum(F.when(F.col("branch") == b, F.lit(w) / (constant + F.col("rank"))).otherwise(0.0)) for b, w in branches.items()]


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.round(out, 12)


def _reciprocal(branch: str, constant: float, weight: float = 1.0) -> Column:
    """Aggregate: what a branch's best rank of an id gives; 0 without one."""
    return F.coalesce(F.lit(weight) / (constant + F.min(F.when(F.col("branch") == branch, F.col("rank")))), F.lit(0.0))


def fuse(hits: DataFrame, branches: dict[str, float], constant: float = 60.0, top_k: int | None = None) -> DataFrame:
    """``query, id, score, rank`` from ``query, branch, id, rank``: score descending, then id. Of several ranks of an id in one branch the best counts, so hits of many runs need no aggregate before."""
    scored = hits.where(F.col("branch").isin(list(branches))).groupBy("query", "id").agg(_total([_reciprocal(b, constant, w) for b, w in branches.items()]).alias("score"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    return out.where(F.col("rank") <= top_k) if top_k else out


def fuse_with_trace(hits: DataFrame, branches: dict[str, float], constant: float = 60.0) -> DataFrame:
    """:func:`fuse` that also keeps each branch's rank and contribution; equal scores go by the best branch rank, then id."""
    trace = F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "rank"))))
    scored = hits.where(F.col("branch").isin(list(branches))).groupBy("query", "id").agg(_total(_parts(branches, constant)).alias("score"), F.min("rank").alias("best_rank"), trace.alias("branch_ranks"))
    weights = F.create_map(*[F.lit(x) for b, w in branches.items() for x in (b, float(w))])
    scored = scored.withColumn("branch_contributions", F.transform_values("branch_ranks", lambda b, r: F.element_at(weights, b) / (constant + r)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "best_rank", "id")))


def weight_grid(hits: DataFrame, grid: dict[str, dict[str, float]], constant: float = 60.0, top_k: int = 20) -> DataFrame:
    """:func:`fuse` for every named set of weights in one aggregation; ``variant`` names the set. Repeated ranks as there."""
    names = sorted({b for w in grid.values() for b in w})
    sums = hits.where(F.col("branch").isin(names)).groupBy("query", "id").agg(*(_reciprocal(b, constant).alias(f"_{b}") for b in names))
    variants = F.array(*(F.struct(F.lit(v).alias("variant"), _total([F.lit(w.get(b, 0.0)) * F.col(f"_{b}") for b in names]).alias("score")) for v, w in grid.items()))
    rows = sums.select("query", "id", F.inline(variants))
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "query").orderBy(F.col("score").desc(), "id")))
    return out.where(F.col("rank") <= top_k).select("variant", "query", "id", "score", "rank")


def aggregate_articles(hits: DataFrame, weights: dict[str, float], constant: float = 60.0, cap: int = 3) -> DataFrame:
    """Articles from ``query, branch, id, rank, document_id, block_id``: per branch an article's best ``cap`` ranks count.

    ``representative`` is the chunk with the highest score of its own, then the best rank, then the id.
    """
    w = Window.partitionBy("query", "document_id", "block_id", "branch").orderBy("rank", "id")
    kept = hits.where(F.col("branch").isin(list(weights))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    chunk = kept.groupBy("query", "document_id", "block_id", "id").agg(*(p.alias(f"_{b}") for b, p in zip(weights, _parts(weights, constant), strict=True)), F.min("rank").alias("best_rank"))
    own = _total([F.col(f"_{b}") for b in weights])
    # the largest struct: negated rank, and ids compared last through the smallest of the equals
    first = F.min(F.struct((-own).alias("s"), F.col("best_rank").alias("r"), F.col("id").alias("id")))
    out = chunk.groupBy("query", "document_id", "block_id").agg(_total([F.sum(f"_{b}") for b in weights]).alias("score"), first.alias("first"), F.count("*").alias("n_chunks"))
    out = out.select("query", "document_id", "block_id", "score", F.col("first.id").alias("representative"), (-F.col("first.s")).alias("representative_score"), "n_chunks")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("representative_score").desc(), "document_id", "block_id")))


def diverse_order(hits: DataFrame, top_k: int = 12) -> DataFrame:
    """First the best hit of every (document, article), in rank order, then the others; null articles are one article of their document."""
    first = F.row_number().over(Window.partitionBy("query", "document_id", "article_number").orderBy("rank", "id")) > 1
    order = F.row_number().over(Window.partitionBy("query").orderBy("_again", "rank", "id"))
    return hits.withColumn("_again", first).withColumn("position", order).where(F.col("position") <= top_k).drop("_again")


def top_sets_jaccard(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query the Jaccard similarity of two rankings' top ``k`` ids; a query missing on one side counts as an empty set."""
    tops = [x.where(F.col("rank") <= k).groupBy("query").agg(F.collect_set("id").alias(n)) for x, n in ((a, "a"), (b, "b"))]
    none = F.array().cast(dict(tops[0].dtypes)["a"])
    return tops[0].join(tops[1], "query", "full").select("query", C.jaccard(F.coalesce("a", none), F.coalesce("b", none)).alias("jaccard"))

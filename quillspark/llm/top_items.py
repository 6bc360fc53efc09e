"""Top N items of every group by a mergeable bounded heap (problem 2).

Each input partition keeps, per group, a heap of the N best distinct items; the heaps are merged
after one shuffle by group. An item of the final N is beaten by fewer than N items in the partition
that holds its best score, so nothing is lost by the early cut, whatever a group's size: a group
that holds a third of all rows sends at most N rows per flush of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

#: Rows of heap state that one task holds before it sends them on and starts anew (memory bound, not a cap on the result).
FLUSH_ROWS = 200_000


def _best(t: pa.Table, n: int) -> pa.Table:
    """Per group the n best items: highest score of each item, then score descending and item ascending (code points)."""
    if not t.num_rows:
        return t
    t = t.group_by(["g", "item"], use_threads=False).aggregate([("score", "max")]).rename_columns(["g", "item", "score"])
    t = t.sort_by([("g", "ascending"), ("score", "descending"), ("item", "ascending")])
    codes = t["g"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    rank = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    return t.filter(pa.array(rank < n))


def _heaps(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, settled = 0, 0
        for b in batches:
            g, items, scores = b.column(0), b.column(1), b.column(2)
            # an entry without an item or score, or with NaN, doesn't count; nor does a row without a group
            parent = pc.list_parent_indices(items)
            t = pa.table({"g": g.take(parent), "item": pc.list_flatten(items), "score": pc.list_flatten(scores)})
            ok = pc.and_(pc.and_(pc.is_valid(t["g"]), pc.is_valid(t["item"])), pc.fill_null(pc.invert(pc.is_nan(t["score"])), False))
            t = t.filter(ok)
            held.append(_best(t, n))
            rows += held[-1].num_rows
            if rows > 2 * settled + 20_000:
                held = [_best(pa.concat_tables(held), n)]
                rows = settled = held[0].num_rows
            if rows > FLUSH_ROWS:
                yield from held[0].to_batches() if len(held) == 1 else _best(pa.concat_tables(held), n).to_batches()
                held, rows, settled = [], 0, 0
        if held:
            yield from _best(pa.concat_tables(held), n).to_batches(max_chunksize=50_000)

    return run


def top_n_per_group(df: DataFrame, group: Column, items: Column, scores: Column, n: int = 5) -> DataFrame:
    """The ``n`` best distinct items of every group.

    ``items`` (array of strings) and ``scores`` (array of doubles) are parallel arrays of one row;
    for flat rows wrap the value in ``F.array``. An item's score is its highest in the group.
    Gives ``group STRING, item STRING, score DOUBLE, rank_no INT``; equal scores rank by item in
    code-point order. Null groups, items and scores, NaN scores, null and empty arrays count for
    nothing; repeated rows change nothing; +-Infinity are ordinary scores and -0.0 equals 0.0; a group
    with fewer than ``n`` items gives what it has; an empty table gives no rows. Other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    # + 0.0 makes one zero of the two
    src = df.select(group.cast("string").alias("g"), items.cast("array<string>").alias("items"), F.transform(scores.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("scores"))
    src = src.where(F.col("g").isNotNull() & (F.size("items") > 0))
    # arrays of different length can't be aligned; the shorter is filled with nulls, which don't count
    size = F.greatest(F.size("items"), F.coalesce(F.size("scores"), F.lit(0)))
    pad = lambda name, kind: F.when(F.size(name) == size, F.col(name)).otherwise(F.concat(F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")), F.array_repeat(F.lit(None).cast(kind), size - F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)))))
    src = src.select("g", pad("items", "string").alias("items"), pad("scores", "double").alias("scores"))
    heaps = src.mapInArrow(_heaps(n), "g string, item string, score double")
    # one exchange by group serves both the merge of equal items and the ranking
    merged = heaps.repartition("g").groupBy("g", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("item").asc()))
    return merged.withColumn("rank_no", rank).where(F.col("rank_no") <= n).withColumnRenamed("g", "group")


def best_chunks(results: DataFrame, n: int = 5) -> DataFrame:
    """``question_id, rank_no, chunk_id, score`` over all fused entries of each question."""
    top = top_n_per_group(results, F.col("question_id"), F.col("fused.chunk_id"), F.col("fused.rrf_score"), n)
    return top.select(F.col("group").alias("question_id"), "rank_no", F.col("item").alias("chunk_id"), "score")


def best_chunks_with_context(results: DataFrame, n: int = 5) -> DataFrame:
    """:func:`best_chunks` with what ``contexts`` says of each chunk within the question.

    A chunk's context is that of its latest run (then the greatest text, so that ties are settled);
    chunks that no context mentions keep nulls. Context entries are pre-aggregated per question and
    chunk, with map-side combine, after a semi-join with the winners: entries of other chunks never
    reach the aggregate. The winners, at most ``n`` rows a question, are written as both joins read them.
    """
    top = cut_lineage(best_chunks(results, n))
    ctx = (
        results.where("question_id is not null and size(contexts) > 0")
        .select("question_id", "run_at", F.explode("contexts").alias("c"))
        .where("c.chunk_id is not null")
        .select("question_id", F.col("c.chunk_id").alias("chunk_id"), F.struct("run_at", F.col("c.text").alias("text"), F.col("c.article_number").alias("article_number"), F.col("c.document_id").alias("document_id")).alias("said"))
        .join(top.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi")
        .groupBy("question_id", "chunk_id")
        .agg(F.max("said").alias("said"))
    )
    return top.join(ctx, ["question_id", "chunk_id"], "left").select("question_id", "rank_no", "chunk_id", "score", "said.document_id", "said.article_number", F.col("said.text").alias("context_text"))

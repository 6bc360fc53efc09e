"""Splits, samples, shards and their merge, kept free of leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.session import cut_lineage


def hash_sample(df: DataFrame, key: str, seed: str, n: int, separator: str = "\0") -> DataFrame:
    """The ``n`` rows with the smallest sha256 of seed, separator and key; ``position`` from 1. The same on every run and cluster."""
    sep = F.decode(F.unhex(F.lit("00")), "UTF-8") if separator == "\0" else F.lit(separator)
    h = F.sha2(F.concat(F.lit(seed), sep, F.col(key).cast("string")), 256)
    top = df.withColumn("sample_hash", h).orderBy("sample_hash", key).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy("sample_hash", key)))


def numeric_aware_order(key: str) -> list[Column]:
    """Decimal ids as numbers first, then the others as strings."""
    is_number = F.col(key).rlike(r"^[0-9]+$")
    return [F.when(is_number, 0).otherwise(1), F.when(is_number, F.col(key).cast("decimal(38,0)")), F.col(key)]


def positions(df: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Zero-based ``position`` of the distinct keys in string order, or in another ``order`` (columns over the key).

    A range partition sorts them; only the counts per partition, a few numbers, give each partition its offset, so no
    task sees all keys.
    """
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    order = order or [F.col(key)]
    ranged = ids.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    # written once: the borders of range partitions are sampled, and both uses below need the same
    local = cut_lineage(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    sizes = local.groupBy("_p").agg(F.max("_i").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(sizes.withColumn("_o", offset).drop("_n")), "_p").select(key, (F.col("_i") + F.col("_o") - 1).cast("long").alias("position"))


def shard_assignment(df: DataFrame, key: str, shards: int = 4) -> DataFrame:
    """``position`` and ``shard``: sorted position modulo the number of shards."""
    return positions(df, key).withColumn("shard", F.pmod(F.col("position"), F.lit(shards)).cast("int"))


def merge_shards(shards: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The union of shard results after checking that none holds an id of another and that all expected ids are there."""
    from quillspark.operators.audit import require_same_ids, require_unique

    require_unique(shards, key)
    require_same_ids(shards, expected, key)
    return shards


def leakage_safe_splits(records: DataFrame, key: str, question: Column, answer: Column, protected: Column, seed: str, buckets: int, holdout_buckets: int) -> DataFrame:
    """``key, group, role``: where each record may go.

    Rows for which ``protected`` holds (public and private questions) are ``protected``; others whose normalised
    question is among theirs are ``quarantined``; groups with differing answers are ``conflicting``; the rest
    is ``holdout`` or ``train`` by the hash bucket of the group, so that a question never stands on both sides.
    """
    rows = records.select(key, C.normalize_question(question).alias("group"), answer.alias("answer"), F.coalesce(protected, F.lit(False)).alias("protected"))
    groups = rows.groupBy("group").agg(F.max("protected").alias("has_protected"), F.countDistinct(F.when(~F.col("protected"), F.col("answer"))).alias("answers"))
    bucket = C.hash_bucket(seed, F.col("group"), buckets)
    role = F.when(F.col("protected"), "protected").when(F.col("group").isNull(), "invalid").when(F.col("has_protected"), "quarantined").when(F.col("answers") > 1, "conflicting").when(bucket < holdout_buckets, "holdout").otherwise("train")
    return rows.join(groups, rows["group"].eqNullSafe(groups["group"])).drop(groups["group"]).select(key, "group", role.alias("role"))


def warmup_alias(warmup: DataFrame, train: DataFrame, question: str, answer: str, key: str) -> DataFrame:
    """Warm-up records that stand in train under another id: same normalised question. ``agrees`` tells whether the answers do too."""
    a = warmup.select(F.col(key).alias("warmup_id"), C.normalize_question(F.col(question)).alias("group"), F.col(answer).alias("_a"))
    b = train.select(F.col(key).alias("train_id"), C.normalize_question(F.col(question)).alias("group"), F.col(answer).alias("_b"))
    return a.join(b, "group").select("warmup_id", "train_id", F.col("_a").eqNullSafe(F.col("_b")).alias("agrees"))


def group_holdout(groups: DataFrame, salt: str, size: int) -> DataFrame:
    """Whole groups (``group, n_rows``) in hash order until exactly ``size`` rows are taken; groups that would go beyond are skipped, later ones may fit.
    Fewer come out where no later group fits; callers that need the exact size check it.

    The greedy walk is sequential: it streams the groups in order through the driver, a partition of the sorted table at a
    time, and ends as soon as ``size`` rows are taken. Groups that can't be taken at all never leave the executors.
    """
    ordered = groups.where((F.col("n_rows") > 0) & (F.col("n_rows") <= size)).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("group")), 256)).select("h", "group", "n_rows")
    left, taken = size, []
    for r in ordered.orderBy("h", "group").toLocalIterator():
        if r.n_rows <= left:
            taken.append((r.group, int(r.n_rows), len(taken)))
            left -= r.n_rows
        if left == 0:
            break
    return groups.sparkSession.createDataFrame(taken, "group string, n_rows long, position int")

"""Corpus audits: counts, exact percentiles, duplicates, conflicts, overlaps, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, value: Column, points: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles by rank ``round((n - 1) * p)``, half to even: not interpolated.

    Works on the histogram of distinct values (``groupBy(value).count()``), so no list of all values is ever
    collected; a running count over the sorted histogram finds the rank. Null values don't count.
    """
    by = by or []
    hist = df.select(*by, value.alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    if by:
        w = Window.partitionBy(*by)
        hist = hist.withColumn("_upto", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    else:
        # without a group one task sorts the histogram: as many rows as there are distinct values
        w = Window.partitionBy(F.lit(0))
        hist = hist.withColumn("_upto", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") > F.bround((F.col("_n") - 1) * F.lit(p), 0), F.col("_v"))).alias(f"p{round(100 * p)}")
    return hist.groupBy(*by).agg(*(at(p) for p in points))


def flags(df: DataFrame, conditions: dict[str, Column], *more: Column) -> DataFrame:
    """One row: how many rows meet each condition, beside other aggregates."""
    return df.agg(*(F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in conditions.items()), *more)


def exact_duplicates(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """Per text that stands more than once (by sha256): its hash, copies, first key and extra rows."""
    rows = df.select(key.alias("k"), F.sha2(text, 256).alias("text_sha256")).where("text_sha256 is not null")
    return rows.groupBy("text_sha256").agg(F.count("*").alias("copies"), F.min("k").alias("first_key")).where("copies > 1").withColumn("extra", F.col("copies") - 1)


def longest(df: DataFrame, key: Column, length: Column, n: int = 10) -> DataFrame:
    """The longest rows; equal lengths by key as a string, descending."""
    rows = df.select(key.cast("string").alias("key"), length.alias("length")).where("length is not null")
    return rows.orderBy(F.col("length").desc(), F.col("key").desc()).limit(n)


def conflicting_groups(df: DataFrame, group: Column, answer: Column) -> DataFrame:
    """Groups of more than one row whose answers differ; null groups are none."""
    rows = df.select(group.alias("group"), answer.alias("answer")).where("group is not null")
    return rows.groupBy("group").agg(F.count("*").alias("n_rows"), F.countDistinct("answer").alias("n_answers")).where("n_rows > 1 and n_answers > 1")


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side, in both, and in one only."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(one(has_l).alias("n_left"), one(has_r).alias("n_right"), one(has_l & has_r).alias("n_both"), one(has_l & ~has_r).alias("n_left_only"), one(~has_l & has_r).alias("n_right_only"))


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail closed: raise with a few examples if there is any row."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {rows}")


def require_unique(df: DataFrame, *keys: str) -> None:
    require_empty(df.groupBy(*keys).count().where("count > 1"), f"repeated {', '.join(keys)}")


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Both tables hold the same ids, each as often."""
    a, b = left.select(key), right.select(key)
    require_empty(a.exceptAll(b), f"{key} missing on the right")
    require_empty(b.exceptAll(a), f"{key} missing on the left")


def provenance_violations(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans whose text isn't the stated stretch of their document (positions in code points); a missing document is one too."""
    j = spans.join(documents.select("document_id", F.col("cleaned_text").alias("_t")), "document_id", "left")
    return j.where(~F.coalesce(F.expr("substring(_t, start_char + 1, end_char - start_char) = text"), F.lit(False))).drop("_t")


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of the schema, at any depth, that are named like something that must not be there."""
    found: list[str] = []

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            if f.name in names:
                found.append(f"{path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        for part in ("elementType", "valueType", "keyType"):
            if hasattr(kind, part):
                walk(getattr(kind, part), path)

    walk(df.schema, "")
    return found


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one side has (an allowlist against what is there); nulls are none."""
    a, b = (t.select(key).where(F.col(key).isNotNull()).distinct().withColumn(s, F.lit(True)) for t, s in ((left, "l"), (right, "r")))
    return a.join(b, key, "full").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def manifest(tables: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """``name, n_rows, n_columns, n_keys, sha256`` of each table: counts, and a hash of its keys that doesn't depend on order."""
    out = None
    for name, t in tables.items():
        k = F.col(key[name]).cast("string")
        row = t.agg(F.count("*").alias("n_rows"), F.countDistinct(k).alias("n_keys"), F.sum(F.conv(F.substring(F.sha2(k, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
        row = row.select(F.lit(name).alias("name"), "n_rows", F.lit(len(t.columns)).alias("n_columns"), "n_keys", F.sha2(F.coalesce(F.col("s").cast("string"), F.lit("0")), 256).alias("sha256"))
        out = row if out is None else out.unionByName(row)
    return out


def manifest_violations(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``name, field, stored, found``: what a stored manifest says otherwise, a missing table in every field."""
    fields = ["n_rows", "n_columns", "n_keys", "sha256"]
    j = stored.alias("s").join(found.alias("f"), "name", "full")
    pairs = F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"s.{x}").cast("string").alias("stored"), F.col(f"f.{x}").cast("string").alias("found")) for x in fields))
    return j.select("name", F.inline(pairs)).where("not (stored <=> found)")


def group_members(df: DataFrame, group: Column, key: Column, value: Column) -> DataFrame:
    """``group, position, key, n_rows, n_values``: members of groups of more than one row, numbered by key, with how many different values the group has. Rows, not lists, so that a group may be of any size."""
    rows = df.select(group.alias("group"), key.alias("key"), value.alias("value")).where("group is not null")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n_rows"), F.countDistinct("value").alias("n_values")).where("n_rows > 1")
    return rows.join(sizes, "group").select("group", F.row_number().over(Window.partitionBy("group").orderBy("key")).alias("position"), "key", "n_rows", "n_values")


def require_expected(df: DataFrame, expected: dict[str, object]) -> None:
    """A one-row table of identities (counts, hashes) equals what is expected."""
    row = df.first()
    wrong = {k: (v, row[k] if row else None) for k, v in expected.items() if row is None or row[k] != v}
    if wrong:
        raise ValueError(f"unexpected identity (expected, found): {wrong}")


def binding_violations(contexts: DataFrame, raw: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose context, raw and clean rows don't belong together: one is missing, or a stored hash isn't that of the row it names.

    ``contexts`` has ``record_sha256``; ``raw`` and ``clean`` have ``context_record_sha256``, and ``clean`` also ``raw_sha256`` against ``raw.record_sha256``.
    """
    c = contexts.select(*keys, F.col("record_sha256").alias("_c"))
    r = raw.select(*keys, F.col("context_record_sha256").alias("_rc"), F.col("record_sha256").alias("_r"))
    f = clean.select(*keys, F.col("context_record_sha256").alias("_fc"), F.col("raw_sha256").alias("_fr"))
    j = c.join(r, keys, "full").join(f, keys, "full")
    holds = (F.col("_c") == F.col("_rc")) & (F.col("_c") == F.col("_fc")) & (F.col("_r") == F.col("_fr"))
    return j.where(~F.coalesce(holds, F.lit(False))).select(*keys)


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and how many have a non-blank value in each column."""
    return df.agg(F.count("*").alias("n"), *(F.sum(F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0)).alias(f"n_{c}") for c in columns))

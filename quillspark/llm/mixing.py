"""Mixing sources to target shares by pivotal dependent rounding (problem 7).

Sizes are counted in tokens of a public tokenizer. From sizes, target shares and repeat limits each
source gets a number of copies per document, whose fraction is then rounded: two documents with
fractional copies trade token mass, in a random direction whose expectation is zero, until one of
them is integral. The mass of a source is kept exactly but for one last document. Buckets of
documents are rounded side by side; the residual document of each bucket goes on to the next level
of a reduction tree.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

#: Folder of the public vocabulary files; set the variable or pass the path where they lie elsewhere.
TOKENIZERS = os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents per bucket of the first level, residuals per bucket of the others.
BUCKET_ROWS = 50_000
FAN_IN = 1_000


@lru_cache(2)
def _encoding(path: str, pattern: str | None):
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(encoding, text: str) -> int:
    return len(encoding.encode_ordinary(text))


def _count_batches(path: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for b in batches:
            n = [0 if not t else _count(encoding, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("source"), pa.array(n, pa.int64())], names=["doc", "source", "n_tokens"])

    return run


def source_name(source: Column) -> Column:
    """Case and outer blanks of any kind carry no meaning; blank names are null."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^[\s\x{85}\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{85}\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]+$", "")), F.lit(""))


def token_sizes(documents: DataFrame, doc_id: Column, source: Column, text: Column, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc STRING, source STRING, n_tokens BIGINT``; null and empty texts have 0 tokens."""
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    src = documents.select(doc_id.cast("string").alias("doc"), source_name(source).alias("source"), text.alias("text"))
    return src.mapInArrow(_count_batches(path, pattern), "doc string, source string, n_tokens long")


def plan_shares(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source shall give.

    Without ``total``: the largest mix in which all sources that have tokens stand to each other as
    their targets. With it: what is missing where a source is at its limit goes to the others in
    proportion to their targets, until all is placed or all are at their limits.
    """
    most = {s: float(sizes[s] * r) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    weight = {s: targets[s][0] for s in most}
    if not most:
        return {}
    if total is None:
        scale = min(most[s] / weight[s] for s in most)
        return {s: weight[s] * scale for s in most}
    give, free, left = dict.fromkeys(most, 0.0), set(most), float(total)
    while free and left > 1e-9:
        scale = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * scale >= most[s]}
        for s in full or free:
            give[s] = most[s] if full else weight[s] * scale
            left -= give[s]
        free = free - full if full else set()
    return give


def _uniform(seed: int, a: str, b: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}\0{a}\0{b}".encode(), digest_size=8).digest(), "big") / 2**64


def pivot(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """Trade mass between fractions p, q of sizes a, b until one is 0 or 1; a*p + b*q stays, and so does each expectation."""
    up = min((1 - p) * a, q * b)  # mass that p can take
    down = min(p * a, (1 - q) * b)  # mass that p can give
    if up + down <= 0:
        return p, q
    if u * (up + down) < down:  # the likelier direction is the shorter way
        p2, q2 = p + up / a, q - up / b
        p2, q2 = (1.0, q2) if up == (1 - p) * a else (p2, 0.0)
    else:
        p2, q2 = p - down / a, q + down / b
        p2, q2 = (0.0, q2) if down == p * a else (p2, 1.0)
    return min(1.0, max(0.0, p2)), min(1.0, max(0.0, q2))


def _round_batches(seed: int, last: bool):
    """Rows (source, bucket, doc, n_tokens, p) sorted by source and bucket. Gives each row's rounding: 0, 1, or null for a bucket's residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None

        def settle(row, value):
            out.append((*row[:4], row[4], value))

        out: list[tuple] = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("source", "bucket", "doc", "n_tokens", "p")]
            for row in zip(*cols, strict=True):
                if row[:2] != group:
                    if held is not None:
                        settle(held, None)
                    group, held = row[:2], None
                row = list(row)
                if row[4] <= 0 or row[4] >= 1 or row[3] <= 0:
                    settle(row, int(row[4] >= 1 and row[3] > 0))
                elif held is None:
                    held = row
                else:
                    held[4], row[4] = pivot(held[4], held[3], row[4], row[3], _uniform(seed, held[2], row[2]))
                    for x in (held, row):
                        if x[4] in (0.0, 1.0):
                            settle(x, int(x[4]))
                    rest = [x for x in (held, row) if x[4] not in (0.0, 1.0)]
                    held = rest[0] if rest else None
            if out:
                yield _rows(out)
                out = []
        if held is not None:
            settle(held, None)
        if out:
            yield _rows(out)

    def _rows(rows):
        if last:
            rows = [r if r[5] is not None else (*r[:5], int(_uniform(seed, r[2], "") < r[4])) for r in rows]
        s, k, d, n, p, v = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(k, pa.int64()), pa.array(d, pa.string()), pa.array(n, pa.int64()), pa.array(p, pa.float64()), pa.array(v, pa.int32())], names=["source", "bucket", "doc", "n_tokens", "p", "up"])

    return run


_ROUNDED = "source string, bucket long, doc string, n_tokens long, p double, up int"


def _round_level(rows: DataFrame, buckets: Column, seed: int, last: bool) -> DataFrame:
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc"), F.greatest(buckets, F.lit(1)).cast("long"))
    rows = rows.withColumn("bucket", spread)
    if last:
        rows = rows.withColumn("bucket", F.lit(0).cast("long"))
    return rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.xxhash64(F.lit(seed + 1), "doc"), "doc").select("source", "bucket", "doc", "n_tokens", "p").mapInArrow(_round_batches(seed, last), _ROUNDED)


def mix_sources(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and the shares reached.

    ``sizes`` has ``doc, source, n_tokens``; ``targets`` has ``source, target_share, max_repeats`` (one row per
    source; a few rows, checked). Gives ``doc, source, n_tokens, copies`` (documents of sources with a
    target, copies 0 included) and, per source of either table, ``source, target_share, max_repeats,
    n_documents, largest, source_tokens, planned_tokens, mixed_documents, mixed_tokens, reached_share, highest_copies``.
    Sources without target get no copy; targets without documents reach 0. Null sources are one source without
    target; documents without tokens get no copy; a row repeated under the same id is a document of its own with the same draw;
    null shares or repeats count as 0; empty tables give empty results. Extra columns are ignored.
    """
    spark = sizes.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r")).where("source is not null").limit(100_001).collect()
    if len(rows) > 100_000 or len({r.source for r in rows}) < len(rows):
        raise ValueError("targets must be at most 100,000 distinct sources")
    goal = {r.source: (float(r.w), int(r.r)) for r in rows}
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("largest"))
    # only sources that have a target come to the driver: as many rows as targets at most
    known = {r.source: r for r in per_source.where(F.col("source").isin(list(goal))).collect()} if goal else {}
    give = plan_shares({s: r.t for s, r in known.items()}, goal, total)
    plan = [(s, goal[s][0], goal[s][1], give.get(s, 0.0), give.get(s, 0.0) / known[s].t if s in known and known[s].t else 0.0, math.ceil(known[s].n / BUCKET_ROWS) if s in known else 1) for s in goal]
    plan_df = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, planned_tokens double, rate double, buckets long")
    whole = F.floor(F.col("rate") + 1e-12)
    sizes = sizes.select("doc", "source", "n_tokens")
    docs = sizes.join(F.broadcast(plan_df.select("source", "rate", "buckets")), "source").withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - whole))
    most = max((x[5] for x in plan), default=1)
    level = _round_level(docs, F.col("buckets"), seed, last=most <= 1)
    settled = None
    while most > 1:
        # written, as both what is settled and what goes on read it: each level is rounded once
        level = cut_lineage(level)
        part = level.where("up is not null")
        settled = part if settled is None else settled.unionByName(part)
        most = math.ceil(most / FAN_IN)
        seed += 2
        level = _round_level(level.where("up is null"), F.lit(most), seed, last=most <= 1)
    part = level.where("up is not null")
    settled = part if settled is None else settled.unionByName(part)
    copies = settled.join(F.broadcast(plan_df.select("source", "rate")), "source").select("doc", "source", "n_tokens", F.when(F.col("n_tokens") > 0, whole.cast("int") + F.col("up")).otherwise(0).alias("copies"))
    return copies, shares(copies, per_source, plan_df)


def shares(copies: DataFrame, per_source: DataFrame, plan: DataFrame) -> DataFrame:
    """The report of :func:`mix_sources`, from the copies as they are."""
    got = copies.groupBy("source").agg(F.sum((F.col("copies") > 0).cast("long")).alias("mixed_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("highest_copies"))
    all_tokens = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = per_source.withColumnRenamed("t", "source_tokens").withColumnRenamed("n", "n_documents").join(plan.drop("rate", "buckets"), "source", "full").join(got, "source", "left").join(F.broadcast(all_tokens))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", zero("largest"), zero("target_share"), "max_repeats", zero("n_documents"), zero("source_tokens"), zero("planned_tokens"), zero("mixed_documents"), zero("mixed_tokens"), F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"), zero("highest_copies"))

"""Exact dense search: a block of query vectors against all vectors, with a bounded heap per query and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.operators.lexical import ranked

#: Bytes of query vectors that travel with one pass; more queries take further passes.
BLOCK_BYTES = 64_000_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.asarray(pc.list_value_length(column))
    if len(lengths) and (lengths.min() != dim or lengths.max() != dim):
        raise ValueError(f"vectors of length {lengths.min()} to {lengths.max()} against queries of length {dim}")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _search(ids: list, query_kind: pa.DataType, queries: np.ndarray, k: int, skip_self: bool):
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        kind = None
        for b in batches:
            kind, keys = b.schema.field("id").type, b.column("id").to_pylist()
            scores = np.round(queries @ _matrix(b.column("v"), dim).T, 9)
            for i, own in enumerate(best):
                s = scores[i]
                at = np.flatnonzero(s >= -own[-1][0]) if len(own) == k else np.arange(len(s))
                if len(at) > k + 1:  # all that tie with the last that may stay do, until they are sorted by key; one more, as a row may be the query's own
                    at = at[s[at] >= np.partition(s[at], len(at) - k - 1)[len(at) - k - 1]]
                if len(at):
                    best[i] = sorted([*own, *((-s[j], keys[j]) for j in at.tolist() if not (skip_self and keys[j] == ids[i]))])[:k]
        if kind is not None:
            rows = [(ids[i], key, -s) for i, own in enumerate(best) for s, key in own]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], query_kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=["query", "id", "score"])

    return run


def dense_search(vectors: DataFrame, key: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, k: int, skip_self: bool = False) -> DataFrame:
    """``query, id, score, rank``: the ``k`` largest inner products per query, rounded to 9 digits, ties by id.

    Ids are numbers or strings and keep their types; ``skip_self`` leaves out a vector with the query's own id. Every
    vector meets every query of the block, so the result is exact. Null keys and vectors are left out; vectors of another
    length than the query's are an error. Each task sends at most ``k`` rows per query.
    """
    src = vectors.select(key.alias("id"), vector.alias("v")).where("id is not null and v is not null")
    asked = queries.select(query.alias("q"), query_vector.alias("v")).where("q is not null and v is not null")
    kinds = dict(asked.dtypes)["q"], dict(src.dtypes)["id"]
    schema = f"query {kinds[0]}, id {kinds[1]}, score double"
    out, ids, block, size = None, [], [], 0
    query_kind = to_arrow_type(asked.schema["q"].dataType)

    def scan() -> DataFrame:
        if len({len(v) for v in block}) > 1:
            raise ValueError("query vectors of different lengths")
        part = src.mapInArrow(_search(ids, query_kind, np.asarray(block, dtype=np.float64), k, skip_self), schema)
        return part if out is None else out.unionByName(part)

    for row in asked.orderBy("q").toLocalIterator():
        ids.append(row.q)
        block.append(row.v)
        size += 8 * len(row.v)
        if size >= BLOCK_BYTES:
            out, ids, block, size = scan(), [], [], 0
    if ids:
        out = scan()
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    return ranked(out, "query", "score", "id", k)

"""Lexical indexes as tables, and BM25 over them.

An index is three tables: postings ``(term, id, tf)``, lengths ``(id, dl)`` and one row of totals
``(n, avgdl)``. Document frequencies come with the postings that a query touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.unicode_text import fold_accents
from quillspark.session import cut_lineage

K1, B = 1.2, 0.75
#: An idf of zero or less is replaced, as terms in half of all rows would count against a row.
LEAST_IDF = 1e-6


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Parquet tables under ``path``; postings are clustered by term so that a lookup prunes files by their statistics."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "totals")))


def build_index(rows: DataFrame, key: Column, tokens: Column) -> LexicalIndex:
    """An index of arrays of tokens. Rows without a token count with length 0, rows without a key not at all; a repeated key must be removed before.

    Tokens are made once and written, as postings, lengths and totals all read them.
    """
    src = cut_lineage(rows.select(key.alias("id"), tokens.alias("tokens")).where("id is not null"))
    postings = src.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    lengths = src.select("id", F.size("tokens").alias("dl"))
    return LexicalIndex(postings, lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def bm25_score(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def ranked(df: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """The best ``k`` rows per query by score, then key; ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(index: LexicalIndex, queries: DataFrame, query: Column, tokens: Column, k: int, at_least: int = 1) -> DataFrame:
    """``query, id, score, rank``: rows with any (or at least ``at_least``, if it has as many) of the query's distinct terms.

    The query side is exploded and joined to the postings by term; Catalyst broadcasts it if it is small
    enough by its statistics. Scores are rounded to 9 digits before ranking, so that summation order can't
    break a tie.
    """
    terms = queries.select(query.alias("query"), F.array_distinct(tokens).alias("terms")).where("query is not null")
    terms = terms.select("query", F.least(F.lit(at_least), F.size("terms")).alias("need"), F.explode("terms").alias("term"))
    # only the postings of terms that a query names: their frequencies are counted after this reduction
    touched = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    freq = touched.groupBy("term").agg(F.count("*").alias("df"))
    hits = touched.join(freq, "term").join(index.lengths, "id").join(F.broadcast(index.totals))
    hits = hits.select("term", "id", bm25_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n"), F.col("df")).alias("part"))
    scored = terms.join(hits, "term").groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("met"), F.max("need").alias("need"))
    return ranked(scored.where("met >= need").select("query", "id", "score"), "query", "score", "id", k)


# --- a block of queries against all rows, without a shuffle of matches ---

#: Distinct terms of the queries that one scan takes along; more queries take further scans.
TERMS_PER_BLOCK = 4096
#: Cells of the dense matrix of rows by terms that a task works on at once.
MATRIX_CELLS = 4_000_000


def _frequencies(b: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of each query term in a batch, and all row lengths."""
    tokens, lengths = b.column("tokens"), np.asarray(b.column("dl"))
    at = pc.index_in(pc.list_flatten(tokens), vocabulary)
    known = np.asarray(pc.is_valid(at))
    rows = np.asarray(pc.list_parent_indices(tokens)).astype(np.int64)[known]
    terms = np.asarray(pc.drop_null(at)).astype(np.int64)
    cells, tf = np.unique(rows * len(vocabulary) + terms, return_counts=True)
    return cells // len(vocabulary), cells % len(vocabulary), tf.astype(np.float64), lengths


def _count_terms(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total, vocabulary = np.zeros(len(terms), np.int64), 0, 0, pa.array(terms, pa.string())
        for b in batches:
            _, t, _, lengths = _frequencies(b, vocabulary)
            df += np.bincount(t, minlength=len(terms))
            n, total = n + len(lengths), total + int(lengths.sum())
        # the two totals travel as terms -1 and -2
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *range(len(terms))], pa.int32()), pa.array([n, total, *df.tolist()], pa.int64())], names=["t", "c"])

    return run


def _best_rows(terms: list[str], queries: list[tuple], weight: np.ndarray, avgdl: float, k: int):
    """``queries``: (query, terms as positions, how many of them a row must hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.string())
        asked = np.zeros((len(terms), len(queries)))
        for j, (_, own, _) in enumerate(queries):
            asked[own, j] = 1.0
        need = np.array([q[2] for q in queries])
        best: list[list[tuple]] = [[] for _ in queries]
        step = max(1, MATRIX_CELLS // max(1, len(terms)))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                r, t, tf, dl = _frequencies(b, vocabulary)
                part = np.zeros((b.num_rows, len(terms)))
                part[r, t] = weight[t] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl[r] / avgdl))
                scores = np.round(part @ asked, 9)
                met = ((part > 0) @ asked >= need) if need.max(initial=0) > 1 else part @ asked > 0
                keys = b.column("id").to_pylist()
                for j, own in enumerate(best):
                    s = scores[:, j]
                    floor = -own[-1][0] if len(own) == k else -np.inf
                    at = np.flatnonzero(met[:, j] & (s >= floor))
                    if len(at) > k:  # all that tie with the k-th stay until they are sorted by key
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    if len(at):
                        best[j] = sorted([*own, *((-s[i], keys[i]) for i in at)])[:k]
        out = [(q[0], key, -score) for q, own in zip(queries, best, strict=True) for score, key in own]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["query", "id", "score"])

    return run


def bm25_scan(rows: DataFrame, key: Column, tokens: Column, queries: DataFrame, query: Column, query_tokens: Column, k: int, at_least: int = 1, length: Column | None = None) -> DataFrame:
    """The result of :func:`bm25_search` (ids and queries as strings) for a stated set of queries, by scanning all rows.

    Cheaper than the postings join where queries share frequent terms: two passes over the tokens (frequencies,
    then scores as a product of matrices) and at most ``k`` rows per query and task to shuffle. Queries travel in blocks.
    ``length`` replaces the number of tokens as a row's length.
    """
    own_length = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)) if length is None else F.col("dl")
    src = rows.select(key.cast("string").alias("id"), tokens.alias("tokens"), *([length.alias("dl")] if length is not None else [])).where("id is not null")
    src = cut_lineage(src.select("id", "tokens", own_length.cast("long").alias("dl")))
    asked = queries.select(query.cast("string").alias("query"), F.array_distinct(query_tokens).alias("terms")).where("query is not null and size(terms) > 0")
    out, block, held = None, [], set()

    def scan() -> DataFrame:
        terms = sorted(held)
        place = {t: i for i, t in enumerate(terms)}
        counts = {r.t: r.c for r in src.mapInArrow(_count_terms(terms), "t int, c long").groupBy("t").agg(F.sum("c").alias("c")).collect()}
        n, df = counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(terms))], dtype=np.float64)
        idf = np.log((n - df + 0.5) / (df + 0.5)) if n else np.zeros(len(terms))
        packed = [(q, [place[t] for t in own], min(at_least, len(own))) for q, own in block]
        return src.mapInArrow(_best_rows(terms, packed, np.where(idf <= 0, LEAST_IDF, idf), counts.get(-2, 0) / n if n and counts.get(-2) else 1.0, k), "query string, id string, score double")

    for r in asked.orderBy("query").toLocalIterator():
        if block and len(held | set(r.terms)) > TERMS_PER_BLOCK:
            part = scan()
            out, block, held = part if out is None else out.unionByName(part), [], set()
        block.append((r["query"], r.terms))
        held.update(r.terms)
    if block:
        part = scan()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query string, id string, score double, rank int")
    return ranked(out, "query", "score", "id", k)


def word_tokens(text: Column) -> Column:
    return C.tokens(text)


def folded_tokens(text: Column) -> Column:
    """Words of the accent-folded text."""
    return F.coalesce(F.regexp_extract_all(C.fold_accents(text), F.lit(C.TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))


# --- substrings ---


@dataclass(frozen=True)
class TrigramIndex:
    """``texts`` (id, folded text, number of trigrams) and ``grams`` (gram, id): which rows hold which three characters."""

    texts: DataFrame
    grams: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Parquet tables under ``path``; grams are clustered so that a lookup prunes files by their statistics."""
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        self.grams.repartitionByRange(buckets, "gram").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/grams")

    @staticmethod
    def read(spark, path: str) -> TrigramIndex:
        return TrigramIndex(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/grams"))


def _grams(text: Column) -> Column:
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))


def build_trigram_index(rows: DataFrame, key: Column, text: Column) -> TrigramIndex:
    """Rows without a key are left out, null texts count as empty; a repeated key must be removed before. Texts are folded once and written."""
    src = cut_lineage(rows.select(key.cast("string").alias("id"), F.coalesce(C.fold_accents(text), F.lit("")).alias("text")).where("id is not null").select("id", "text", F.greatest(F.lit(0), F.length("text") - 2).cast("long").alias("dl")))
    return TrigramIndex(src, src.select("id", F.explode(_grams(F.col("text"))).alias("gram")))


def trigram_search(index: TrigramIndex, queries: DataFrame, query: Column, query_text: Column, k: int, most_terms: int = 8) -> DataFrame:
    """The result of :func:`substring_search` by an index: only rows that hold all trigrams of a term are looked at.

    For queries that name few of the rows; a block of many queries over all rows is cheaper by the scan. Terms have three characters or more.
    """
    asked = queries.select(query.cast("string").alias("query"), C.longest_terms(F.array_distinct(folded_tokens(query_text)), 3, most_terms).alias("terms")).where("query is not null")
    terms = cut_lineage(asked.select("query", F.least(F.lit(2), F.size("terms")).alias("need"), F.explode("terms").alias("term")))
    grams = terms.select("term").distinct().select("term", _grams(F.col("term")).alias("g")).select("term", F.size("g").alias("n"), F.explode("g").alias("gram"))
    # a row's grams are distinct, so it holds all of a term's exactly if as many meet
    may = index.grams.join(grams, "gram").groupBy("term", "id").agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m = n").select("term", "id")
    found = may.join(index.texts, "id").select("term", "id", "dl", F.regexp_count("text", F.concat(F.lit("(?="), "term", F.lit(")"))).alias("tf")).where("tf > 0")
    found = cut_lineage(found)  # counted per term, then scored
    totals = index.texts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    freq = found.groupBy("term").agg(F.count("*").alias("df"))
    hits = found.join(freq, "term").join(F.broadcast(totals)).select("term", "id", bm25_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n"), F.col("df")).alias("part"))
    scored = terms.join(hits, "term").groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("met"), F.max("need").alias("need"))
    return ranked(scored.where("met >= need").select("query", "id", "score"), "query", "score", "id", k)


def _substrings(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        scan = ahocorasick.Automaton()
        for t in terms:
            scan.add_word(t, t)
        scan.make_automaton()
        for b in batches:
            folded = [fold_accents(t) or "" for t in b.column("text").to_pylist()]
            found = [[t for _, t in scan.iter(x)] if terms else [] for x in folded]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.string())), pa.array([max(0, len(x) - 2) for x in folded], pa.int64())], names=["id", "tokens", "dl"])

    return run


#: Query terms that one scan of the texts looks for; more take further scans.
TERMS_PER_SCAN = 50_000


def substring_search(rows: DataFrame, key: Column, text: Column, queries: DataFrame, query: Column, query_text: Column, k: int, shortest: int = 3, most_terms: int = 8) -> DataFrame:
    """BM25 over substrings of the accent-folded text: rows that hold at least two of the query's longest terms (one, if it has one).

    Term frequency counts overlapping occurrences, a row's length is its number of trigrams. All terms of a
    block of queries are found in one scan per text by one automaton, over whole texts.
    """
    asked = queries.select(query.cast("string").alias("query"), C.longest_terms(F.array_distinct(folded_tokens(query_text)), shortest, most_terms).alias("terms")).where("query is not null")
    terms = sorted({r.t for r in asked.select(F.explode("terms").alias("t")).distinct().toLocalIterator()})
    src, out = rows.select(key.cast("string").alias("id"), text.alias("text")).where("id is not null"), None
    for i in range(0, len(terms), TERMS_PER_SCAN):
        block = terms[i : i + TERMS_PER_SCAN]
        part = src.mapInArrow(_substrings(block), "id string, tokens array<string>, dl long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query string, id string, score double, rank int")
    if len(terms) > TERMS_PER_SCAN:
        out = out.groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.max("dl").alias("dl"))
    return bm25_scan(out, F.col("id"), F.col("tokens"), asked, F.col("query"), F.col("terms"), k, at_least=2, length=F.col("dl"))

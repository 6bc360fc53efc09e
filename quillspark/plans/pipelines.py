"""Whole plans: a corpus from raw passages, prompts from questions, answers finalised, resumable generation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.answers import clean_answer_udf
from quillspark.functions.cleaning import clean_passages
from quillspark.operators import chunking, context, dense, evaluate, fusion, lexical, packing
from quillspark.session import cut_lineage


def build_corpus(raw: DataFrame, bounds: chunking.Bounds | None = None) -> tuple[DataFrame, DataFrame, lexical.LexicalIndex]:
    """``document_id, source_title, source_url, raw_text`` -> documents, chunks and the word index of the chunks.

    The cleaned documents are written once, as both chunks and callers read them.
    """
    cleaned = clean_passages(raw, F.col("document_id"), F.col("raw_text")).withColumnRenamed("id", "document_id")
    docs = cut_lineage(raw.select("document_id", "source_title", "source_url", F.sha2("raw_text", 256).alias("raw_text_sha256"), F.length("raw_text").alias("raw_character_count")).join(cleaned, "document_id").withColumn("cleaned_character_count", F.length("cleaned_text")).withColumn("document_number", C.source_number(F.col("cleaned_text"))))
    chunks = cut_lineage(chunking.chunk_documents(docs, F.col("document_id"), F.col("source_title"), F.col("cleaned_text"), bounds))
    return docs, chunks, lexical.build_index(chunks, F.col("chunk_id"), lexical.word_tokens(F.col("search_text")))


def hybrid_retrieve(index: lexical.LexicalIndex, questions: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, candidates: int = 40, fused: int = 20, selected: int = 12) -> DataFrame:
    """``query, question, id, score, rank``: the best of either branch, fused with equal weights.

    ``questions`` has ``query, question``; ``vectors`` has ``id, v`` and ``query_vectors`` ``query, v``, ids of any type; without them only words count.
    """
    sparse = lexical.bm25_search(index, questions, F.col("query"), lexical.word_tokens(F.col("question")), candidates)
    return fuse_branches(sparse, questions, vectors, query_vectors, candidates, fused, selected)


def fuse_branches(sparse: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, candidates: int = 40, fused: int = 20, selected: int = 12) -> DataFrame:
    """:func:`hybrid_retrieve` from word hits (``query, id, rank``) that are there already, as those of :func:`lexical.bm25_scan` for a block of many questions."""
    hits = sparse.select(F.col("query").cast(dict(questions.dtypes)["query"]).alias("query"), F.lit("sparse").alias("branch"), F.col("id").cast("string").alias("id"), "rank")
    if vectors is not None and query_vectors is not None:
        near = dense.dense_search(vectors, F.col("id"), F.col("v"), query_vectors, F.col("query"), F.col("v"), candidates)
        hits = hits.unionByName(near.select(F.col("query").cast(dict(questions.dtypes)["query"]).alias("query"), F.lit("dense").alias("branch"), F.col("id").cast("string").alias("id"), "rank"))
    out = fusion.fuse(hits, {"sparse": 0.5, "dense": 0.5}, 60, fused).where(F.col("rank") <= selected)
    return out.join(questions.select("query", "question"), "query")


def prepare_prompts(hits: DataFrame, chunks: DataFrame, documents: DataFrame, budget: packing.Budget | None = None, expand: bool = True) -> DataFrame:
    """Prompts for hits (``query, question, id, rank``), with evidence widened to its article under the budget."""
    blocks = context.article_blocks(chunks)
    return packing.pack(context.seed_units(hits, blocks, documents), budget, expand)


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], top_k: int) -> DataFrame:
    """Hits (``query, question, text, id, rank``) by the scores of a model hook on batches of pairs; ties by old rank, then id."""

    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        return score(question, text)

    scored = hits.withColumn("rerank_score", F.pandas_udf(run, "double")("question", "text"))
    out = evaluate.rank_windows(scored, "query", F.col("rank"), F.struct((-F.col("rerank_score")).alias("s"), "rank", "id"))
    return out.where(F.col("new_rank") <= top_k)


def generate(prompts: DataFrame, done: DataFrame | None, model: Callable[[pd.DataFrame], pd.DataFrame], key: str = "query") -> DataFrame:
    """Records for the prompts that ``done`` lacks. ``model`` takes a batch with ``key, prompt`` and gives ``key, answer, finish_reason``."""
    todo = prompts if done is None else prompts.join(done.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)[[key, "answer", "finish_reason"]]

    return todo.select(key, "prompt").mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, answer string, finish_reason string")


def run_resumable(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], path: str, identity: str, key: str = "query", batch_rows: int | None = None) -> DataFrame:
    """Generate what isn't stored under ``path`` yet, append it, and give all records.

    The folder's name carries the identity of model and prompts: records of another identity are never reused.
    Each call stores at most ``batch_rows`` more records (a bounded unit of work), so a stopped run goes on where it was.
    """
    spark = prompts.sparkSession
    store = f"{path}/identity={identity}"
    schema = f"{key} {dict(prompts.dtypes)[key]}, answer string, finish_reason string"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(store)
    has = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    done = spark.read.schema(schema).parquet(store) if has else spark.createDataFrame([], schema)
    todo = prompts.join(done.select(key), key, "left_anti")
    generate(todo.orderBy(key).limit(batch_rows) if batch_rows else todo, None, model, key).write.mode("append").parquet(store)
    return spark.read.schema(schema).parquet(store)


def run_until(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], path: str, identity: str, batch_rows: int, seconds: float, key: str = "query") -> tuple[DataFrame, bool]:
    """:func:`run_resumable` batch after batch until all is stored or ``seconds`` are over: all records, and whether they are complete. The deadline is looked at between batches, so records are whole."""
    ends, total = time.monotonic() + seconds, prompts.count()
    while True:
        records = run_resumable(prompts, model, path, identity, key, batch_rows)
        complete = records.count() >= total
        if complete or time.monotonic() >= ends:
            return records, complete


def contiguous_prefix(plan: DataFrame, records: DataFrame, key: str = "query") -> DataFrame:
    """The records of the plan (``key, position`` from 0) up to the first position without one: what an ordered run can go on from."""
    j = plan.join(records, key, "left").withColumn("_has", F.col("finish_reason").isNotNull())
    first_gap = plan.join(records.select(key), key, "left_anti").agg(F.min("position").alias("_gap"))
    return j.join(F.broadcast(first_gap)).where(F.col("_has") & (F.col("_gap").isNull() | (F.col("position") < F.col("_gap")))).drop("_has", "_gap")


def worker_status(plan: DataFrame, records: DataFrame, stopped: bool = False, key: str = "query") -> DataFrame:
    """``worker, assigned, completed, status, rerouted`` of ``key, worker`` and ``key, finish_reason``.

    A worker with a record that failed is failed, with one out of memory oom, else complete if none is missing, else
    stopped or running; ``rerouted`` counts what another worker must take: records out of memory or failed.
    """
    bad = lambda *w: F.sum(F.when(F.col("finish_reason").isin(*w), 1).otherwise(0))
    per = plan.join(records.select(key, "finish_reason"), key, "left").groupBy("worker").agg(F.count("*").alias("assigned"), F.count("finish_reason").alias("done"), bad("oom").alias("oom"), bad("failed").alias("failed"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("oom") > 0, "oom").when(F.col("done") == F.col("assigned"), "complete").otherwise("stopped" if stopped else "running")
    return per.select("worker", "assigned", (F.col("done") - F.col("oom") - F.col("failed")).alias("completed"), status.alias("status"), (F.col("oom") + F.col("failed")).alias("rerouted"))


def derive_variants(answers: DataFrame, variants: dict[str, Column], key: str = "query") -> DataFrame:
    """``variant, key, answer, changed`` from saved answers, without generating again: each variant is an expression over ``answer``."""
    rows = F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("derived")) for n, c in variants.items()))
    return answers.select(key, "answer", F.inline(rows)).select("variant", key, F.col("derived").alias("answer"), (~F.col("derived").eqNullSafe(F.col("answer"))).alias("changed"))


def finalize_answers(first: DataFrame, second: DataFrame | None = None, key: str = "query") -> DataFrame:
    """``key, raw, answer, removed_characters``: second-pass answers where there are some, cleaned at the end."""
    rows = first.select(key, "answer") if second is None else evaluate.coalesce_passes(first, second, key)
    out = rows.select(key, F.col("answer").alias("raw")).withColumn("answer", clean_answer_udf(F.col("raw")))
    return out.withColumn("removed_characters", F.length("raw") - F.length("answer"))


def cleanup_rates(final: DataFrame) -> DataFrame:
    flags = C.answer_diagnostics(F.col("answer"))
    rows = final.withColumn("d", flags)
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("removed_characters") > 0).cast("double")).alias("changed_rate"), F.sum("removed_characters").alias("removed_characters"), *(F.avg(F.col(f"d.{x}").cast("double")).alias(f"{x}_rate") for x in ("duplicate_line", "duplicate_sentence", "abbreviation_loop", "non_sentence_ending")))


def route(prompts: DataFrame, tokens: str, threshold: int) -> DataFrame:
    return prompts.withColumn("route", F.when(F.col(tokens) <= threshold, "short").otherwise("long"))


def retry(records: DataFrame, prompts: DataFrame, key: str = "query") -> DataFrame:
    """What a second pass takes: records that ended by length, or failed for memory, with the same prompt hash."""
    again = records.where("finish_reason in ('length', 'oom')").select(key, F.col("prompt_sha256").alias("_h"))
    return prompts.join(again, key).where(F.sha2("prompt", 256) == F.col("_h")).drop("_h")


def encode(rows: DataFrame, model: Callable[[pd.Series], pd.Series], path: str, key: str = "chunk_id", text: str = "search_text", shards: int = 64) -> DataFrame:
    """Unit vectors of the texts by a model hook, stored by hash shard; rows that are stored already are not encoded again."""
    spark = rows.sparkSession
    schema = f"{key} {dict(rows.dtypes)[key]}, embedding array<double>, shard int"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    has = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    todo = rows.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti") if has else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "v": model(b[text])})

    vectors = todo.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, v array<double>")
    vectors.select(key, C.l2_normalize(F.col("v")).alias("embedding"), F.pmod(F.hash(key), F.lit(shards)).alias("shard")).write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)

"""Queries over the driver's tables for sources, sinks, state and audits: tables are written in the shared folder and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import audit, chunking, evaluate, fusion, lexical, packing, references, splits, training
from quillspark.plans import pipelines
from quillspark.queries import answered, branch_hits, branch_rows, chunks_of, query
from quillspark.session import cut_lineage, shared_folder, table
from quillspark.sources import readers, writers
from quillspark.streaming import events


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sources and sinks ---


@query
def sk03_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    writers.write_json_lines(table(spark, sf, "documents").select("doc_id", "source_title", "lang", "text"), path)
    rows = readers.read_json_lines(spark, path, "doc_id long, source_title string, lang string, text string")
    return rows.select("doc_id", "source_title", "lang", F.sha2("text", 256).alias("text_sha256"))


@query
def sc07_chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    path, names = _path(spark), [c.strip().split(" ")[0] for c in readers.CHUNK.split(",")]
    chunks = cut_lineage(chunks_of(spark, sf, *(n for n in names if n != "chunk_id")))
    writers.write_json_lines(chunks, path)
    expected = readers.content_identity(chunks.select("chunk_id", F.sha2("text", 256).alias("h")), "chunk_id", "h").first().asDict()
    rows = readers.read_chunks(spark, path, expected)
    return rows.select("chunk_id", "document_id", "article_number", F.array_join("clause_numbers", ",").alias("clauses"), "chunk_index", "start_char", F.sha2("text", 256).alias("text_sha256"))


@query
def sc06_questions(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    records = answered(spark, sf).where(~C.is_blank(F.col("question"))).select(F.col("record_id").cast("string").alias("question_id"), "question", "answer")
    writers.write_questions(records, path)
    return readers.read_questions(spark, path).select("question_id", F.sha2("question", 256).alias("question_sha256"), F.sha2("answer", 256).alias("answer_sha256"))


@query
def sc01_archives(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with a text and an address, by way of ZIP archives of strict JSON members."""
    path = _path(spark)
    docs = table(spark, sf, "documents").where("text is not null").where(C.is_https(F.col("source_url"))).select("document_id", "source_title", "source_url", F.col("text").alias("raw_text"))
    writers.write_passage_archives(docs.repartition(4, "document_id"), path)
    rows = readers.read_passage_archives(spark, path)
    return rows.select("document_id", "source_title", "source_url", F.sha2("raw_text", 256).alias("text_sha256"), "source_name")


@query
def sc12_registry(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    table(spark, sf, "documents").select(F.concat(F.lit(" "), "source_url", F.lit("//")).alias("﻿URL")).where("source_url is not null").write.option("header", "true").csv(path)
    return readers.read_registry(spark, path, "url")


@query
def sc13_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = readers.read_vectors(spark, f"{sf}/embeddings.parquet")
    return v.select("vec_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query
def sc08_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that English records' runs cite, by one scan with a semi-join."""
    runs = table(spark, sf, "retrieval_results").select("question_id", F.explode("contexts.document_id").alias("document_id"))
    docs = table(spark, sf, "documents").select("document_id", "source_title", "n_chars")
    asked = table(spark, sf, "training_records").where("lang = 'en'").select("question_id").distinct()
    wanted = runs.join(asked, "question_id", "left_semi").where("document_id is not null").select("document_id").distinct()
    known = wanted.join(docs.select("document_id"), "document_id", "left_semi")
    return readers.select_wanted(docs, "document_id", known)


@query
def sc09_chunks_by_document(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").where("lang = 'en'")
    out = readers.chunks_by_document(chunks_of(spark, sf, "document_id", "chunk_index", "article_number", "start_char", "end_char", "text"), wanted)
    return out.select("document_id", F.size("chunks").alias("n_chunks"), F.sha2(F.array_join("chunks.chunk_id", "\n"), 256).alias("ids_sha256"))


@query
def sc14_fetch_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks, with the rank each was asked for."""
    chunks = chunks_of(spark, sf, "text")
    ids = splits.positions(chunks, "chunk_id").select("chunk_id", F.col("position").alias("rank"))
    return readers.fetch_ordered(chunks, ids).select("chunk_id", "rank", F.length("text").alias("n_chars"))


def _nation_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    table(spark, sf, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = readers.file_hashes(spark, path, "*.txt")
    return files.withColumn("n_nationkey", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int"))


@query
def sc05_file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _nation_files(spark, sf).select("n_nationkey", "length", "sha256")


@query
def sc15_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    files = cut_lineage(_nation_files(spark, sf))
    wanted = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("name"), F.sha2(F.concat("n_name", F.lit("\n")), 256).alias("sha256"))
    return readers.resolve_artifacts(files, wanted).select("name", "sha256", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"))


@query
def sk10_bundle(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_path(spark)}.zip"
    writers.write_bundle(table(spark, sf, "nation").select(F.concat(F.lit("nations/"), "n_nationkey", F.lit(".txt")).alias("name"), F.col("n_name").alias("content")), path)
    return readers.read_bundle(spark, path).select("name", F.col("content").cast("string").alias("content"))


@query
def sk04_published(spark: SparkSession, sf: str) -> DataFrame:
    path, customers = _path(spark), table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    writers.publish(customers.where("c_nationkey < 10"), path)
    writers.publish(customers, path, "c_nationkey")
    return spark.read.schema(customers.schema).parquet(path)


@query
def sk06_split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    writers.write_splits(table(spark, sf, "training_records").where("split is not null"), path, "split", "record_id")
    stored = spark.read.schema("split string, n long, ids_sha256 string").json(f"{path}/manifest")
    kept = spark.read.parquet(f"{path}/data").groupBy("split").agg(F.countDistinct("record_id").alias("n_ids"))
    return stored.join(kept, "split").select("split", "n", "n_ids")


@query
def sk01_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """The postings join over an index that is stored clustered by term and read back."""
    path = _path(spark)
    lexical.build_index(chunks_of(spark, sf, "search_text"), F.col("chunk_id"), lexical.word_tokens(F.col("search_text"))).write(path, 8)
    asked = table(spark, sf, "documents").where("doc_id % 50 = 0 and source_title is not null").select("doc_id", "source_title")
    hits = lexical.bm25_search(lexical.LexicalIndex.read(spark, path), asked, F.col("doc_id"), lexical.word_tokens(F.col("source_title")), 10)
    return hits.select(F.col("query").alias("doc_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def sk02_trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    """Substring search by a stored index of trigrams."""
    path = _path(spark)
    lexical.build_trigram_index(chunks_of(spark, sf, "search_text"), F.col("chunk_id"), F.col("search_text")).write(path, 8)
    hits = lexical.trigram_search(lexical.TrigramIndex.read(spark, path), table(spark, sf, "eval_items"), F.col("item_id"), F.col("text"), 10)
    return hits.select(F.col("query").cast("long").alias("item_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def sk07_submission(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_path(spark)}.zip"
    rows = answered(spark, sf).where(~C.is_blank(F.col("answer"))).select(F.col("record_id").cast("string").alias("question_id"), "answer")
    writers.write_submission(rows, rows.select("question_id"), path)
    return writers.read_submission(spark, path).select("question_id", F.sha2("answer", 256).alias("answer_sha256"))


def _two_numbers(texts: pd.Series) -> pd.Series:
    """A stand-in for an encoder: characters and blank-separated words."""
    return texts.map(lambda t: [float(len(t)), float(len(t.split(" ")))])


@query
def sk05_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by a hook, in two calls: the second encodes only what the first left."""
    path, chunks = _path(spark), chunks_of(spark, sf, "article_number", "text").where("text is not null")
    pipelines.encode(chunks.where("article_number is null"), _two_numbers, path, text="text", shards=4)
    out = pipelines.encode(chunks, _two_numbers, path, text="text", shards=4)
    return out.select("chunk_id", F.round(F.element_at("embedding", 1), 6).alias("a"), F.round(F.element_at("embedding", 2), 6).alias("b"))


# --- state of long runs ---


def _shouting(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a generator."""
    return batch.assign(answer=batch["prompt"].str.upper(), finish_reason=["eos" if len(p) < 200 else "length" for p in batch["prompt"]])


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").where("text is not null").select(F.col("item_id").alias("query"), F.col("text").alias("prompt"))


@query
def ss02_resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run in bounded batches until all is stored, after a run of another identity that must not count."""
    path, prompts = _path(spark), _prompts(spark, sf)
    pipelines.run_resumable(prompts, _shouting, path, "other", batch_rows=5)
    records, _ = pipelines.run_until(prompts, _shouting, path, "one", batch_rows=60, seconds=600)
    return records.select("query", F.length("answer").alias("n_chars"), "finish_reason")


@query
def ss03_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """A deadline that is over at once stops the run after one whole batch."""
    records, complete = pipelines.run_until(_prompts(spark, sf), _shouting, _path(spark), "one", batch_rows=7, seconds=0)
    return records.agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_queries")).withColumn("complete", F.lit(complete))


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A plan over the questions with four workers, and records as the questions' runs suggest them."""
    plan = splits.shard_assignment(table(spark, sf, "training_records"), "question_id", 4).select(F.col("question_id").alias("query"), "position", F.col("shard").alias("worker"))
    runs = table(spark, sf, "retrieval_results").where("question_id is not null").groupBy(F.col("question_id").alias("query")).agg(F.count("*").alias("n"))
    reason = F.when(F.col("n") > 40, "oom").when(F.col("n") > 6, "length").otherwise("eos")
    return plan, runs.select("query", reason.alias("finish_reason"))


@query
def ss01_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.contiguous_prefix(*_records(spark, sf)).select("query", "position", "finish_reason")


@query
def ss04_worker_status(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.worker_status(*_records(spark, sf), stopped=True)


@query
def ss05_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """What a second pass takes: cut or out of memory, with the prompt as it was (odd positions have another by now)."""
    plan, records = _records(spark, sf)
    old = plan.join(records, "query").select("query", "finish_reason", F.sha2("query", 256).alias("prompt_sha256"))
    prompts = plan.select("query", F.when(F.col("position") % 2 == 0, F.col("query")).otherwise(F.concat("query", F.lit("?"))).alias("prompt"))
    return pipelines.retry(old, prompts).select("query", "prompt")


@query
def ss07_imported(spark: SparkSession, sf: str) -> DataFrame:
    plan, records = _records(spark, sf)
    done, left = evaluate.import_finished(records, plan, "query")
    return done.select("query", F.lit("done").alias("state")).unionByName(left.select("query", F.lit("left").alias("state")))


@query
def pf07_route(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "eval_items").select("item_id", C.whitespace_count(F.col("text")).alias("n"))
    return pipelines.route(p, "n", 100).select("item_id", "n", "route")


@query
def ss06_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of event files, of which half come twice, appended once: two runs over the same checkpoint, the second after more files came."""
    folder, target, checkpoint = _path(spark), _path(spark), _path(spark)
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e.where("event_type <> 'purchase'").repartition(3).write.parquet(folder)
    events.start_upsert(events.read_event_stream(spark, folder), target, checkpoint, "event_id").awaitTermination()
    e.repartition(3).write.mode("append").parquet(folder)
    events.start_upsert(events.read_event_stream(spark, folder), target, checkpoint, "event_id").awaitTermination()
    return spark.read.schema(events.EVENTS).parquet(target).select("event_id", "event_type", F.round("value", 6).alias("value"))


@query
def ss06_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by a stream with a watermark, in complete mode."""
    folder, name = _path(spark), f"windows_{uuid.uuid4().hex}"
    table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").where("ts is not null").repartition(2).write.parquet(folder)
    stream = events.window_counts(events.read_event_stream(spark, folder), "1 hour")
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# --- rankings ---


def _shortest_first(question: pd.Series, text: pd.Series) -> pd.Series:
    """A stand-in for a reranker."""
    return -text.str.len().astype("float64")


@query
def rt09_reranked(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 20).join(chunks_of(spark, sf, "text").withColumnRenamed("chunk_id", "id").where("text is not null"), "id")
    out = pipelines.rerank(hits.withColumn("question", F.col("query")), _shortest_first, 12)
    return out.select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "old_rank", "new_rank")


@query
def rt08_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Each branch and their fusion against the chunks that contexts hold, all in one pass over the hits."""
    hits = cut_lineage(branch_hits(spark, sf))
    fused = fusion.fuse(hits, {"sparse": 0.5, "dense": 0.5}, 60, 10).withColumn("system", F.lit("fused"))
    rankings = hits.withColumn("system", F.col("branch")).select("system", "query", "id", "rank").unionByName(fused.select("system", "query", "id", "rank"))
    relevant = table(spark, sf, "retrieval_results").where("question_id is not null").select(F.col("question_id").alias("query"), F.explode("contexts.chunk_id").alias("id")).where("id is not null")
    out = evaluate.compare_rankings(rankings, relevant, 10)
    return out.select("system", "n_queries", *(F.round(c, 9).alias(c) for c in ("hit_rate", "recall", "reciprocal_rank")))


@query
def ag28_order_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How often the fused lists stand in another order than their scores'."""
    rows = table(spark, sf, "retrieval_results").where("fused is not null and not exists(fused, x -> x is null or x.chunk_id is null or x.rrf_score is null or isnan(x.rrf_score))")
    after = F.transform(F.array_sort(F.transform("fused", lambda x: F.struct((-x["rrf_score"]).alias("s"), x["chunk_id"].alias("id")))), lambda x: x["id"])
    o = rows.where("size(fused) > 0").select("result_id", F.col("fused.chunk_id").alias("before"), after.alias("after"))
    return evaluate.order_changes(o).select("n", "n_changed", "n_top_changed", F.round("rate_changed", 9).alias("rate_changed"))


@query
def rt15_whole_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole contexts of each result row under a budget of 300 words."""
    return packing.pack_contexts(_contexts(spark, sf), packing.Budget(300)).select(F.col("query").alias("row_id"), "n_tokens", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query
def rt31_context_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The same under 60 words: where nothing fits whole, a prefix of the first context."""
    out = packing.pack_contexts(_contexts(spark, sf), packing.Budget(60), prefix=True)
    return out.select(F.col("query").alias("row_id"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), (F.col("n_tokens") <= 60).alias("fits"), F.col("cut_chars").isNotNull().alias("is_cut"))


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "retrieval_results").where("question_id is not null and size(contexts) > 0").groupBy("result_id").agg(F.min("question_id").alias("question"), F.min_by("contexts", "ingested_at").alias("c"))
    return r.where("c is not null").select(F.col("result_id").cast("string").alias("query"), "question", F.transform("c", lambda x: F.coalesce(x["text"], F.lit(""))).alias("contexts"))


# --- audits and checks ---


@query
def st05_merged_shards(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "training_records").where("split = 'public' and question_id is not null").groupBy("question_id").agg(F.count("*").alias("n"))
    shards = cut_lineage(splits.shard_assignment(r, "question_id", 3).join(r, "question_id"))
    return splits.merge_shards(_union([shards.where(F.col("shard") == i) for i in range(3)]), r, "question_id").select("question_id", "shard", "n")


@query
def st06_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of documents that have no target, and targets without documents."""
    d = table(spark, sf, "documents").select(F.lower(F.trim("source")).alias("source")).where("source <> ''")
    return audit.set_differences(d, table(spark, sf, "mix_targets").select(F.lower(F.trim("source")).alias("source")), "source")


@query
def dq02_manifest(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"documents": "doc_id", "training_records": "record_id", "retrieval_results": "result_id", "eval_items": "item_id", "legal_chunks": "chunk_id"}
    return audit.manifest({n: table(spark, sf, n) for n in keys}, keys).select("name", "n_rows", "n_columns", "n_keys")


@query
def dq02_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What a manifest says that was stored before one question's records went away."""
    r = table(spark, sf, "training_records")
    found = audit.manifest({"records": r, "items": table(spark, sf, "eval_items")}, {"records": "record_id", "items": "item_id"})
    old = audit.manifest({"records": r.where("split is null or split <> 'dev'"), "items": table(spark, sf, "eval_items"), "gone": r}, {"records": "record_id", "items": "item_id", "gone": "record_id"})
    return audit.manifest_violations(old, found).where("field <> 'sha256'").unionByName(audit.manifest_violations(old, found).where("field = 'sha256'").select("name", "field", F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("found")))


@query
def dq03_submission(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions that keep the contract: one non-blank answer per expected id."""
    p = answered(spark, sf).where(~C.is_blank(F.col("answer"))).groupBy("record_id").agg(F.min("answer").alias("answer"))
    writers.check_submission(p, p.select("record_id"), "record_id")
    return p.select("record_id", F.length("answer").alias("n_chars"))


@query
def dq01_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The order-free identity of the documents is that of the same documents in another order and layout."""
    d = table(spark, sf, "documents").select("document_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    one = readers.content_identity(d, "document_id", "h")
    audit.require_expected(readers.content_identity(d.repartition(7).orderBy(F.col("h").desc()), "document_id", "h"), one.first().asDict())
    return one.select("members", (F.length("identity_sha256") == 64).alias("hashed"))


@query
def pf10_forbidden_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.forbidden_fields(table(spark, sf, "retrieval_results"), {"text", "chunk_id"})
    return spark.createDataFrame([(p,) for p in found], "path string")


@query
def ag05_group_members(spark: SparkSession, sf: str) -> DataFrame:
    return audit.group_members(answered(spark, sf), C.normalize_question(F.col("question")), F.col("record_id"), C.normalize_question(F.col("answer")))


@query
def jn08_triggered(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as triggers: those of even place stand in a question, the others count inside the first 2,000 characters of their document."""
    c = chunks_of(spark, sf, "document_id", "chunk_index", "start_char", "end_char").where("start_char is not null and end_char is not null")
    refs = c.select("chunk_id", "document_id", F.col("document_id").alias("query"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.when(F.col("chunk_index") % 2 == 0, "question").otherwise("evidence").alias("origin"))
    spans = table(spark, sf, "documents").where("lang = 'vi'").select("document_id", F.col("document_id").alias("query"), F.lit(0).alias("start"), F.lit(2000).alias("end"))
    return references.triggered(refs, spans).select("chunk_id", "origin")


@query
def jn11_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose place among all isn't that among those with an answer."""
    r = table(spark, sf, "training_records")
    a, b = splits.positions(r, "question_id"), splits.positions(answered(spark, sf), "question_id")
    return evaluate.positioned(a, b, "question_id", "position")


@query
def jn15_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Records that don't belong together: raw rows of dev name another context, clean rows of public are missing."""
    r = table(spark, sf, "training_records").where("question is not null").select("record_id", "split", F.sha2("question", 256).alias("h"))
    contexts = r.select("record_id", F.col("h").alias("record_sha256"))
    raw = r.select("record_id", F.when(F.col("split") == "dev", "x").otherwise(F.col("h")).alias("context_record_sha256"), F.sha2(F.concat("h", F.lit("raw")), 256).alias("record_sha256"))
    clean = r.where("split is null or split <> 'public'").select("record_id", F.col("h").alias("context_record_sha256"), F.sha2(F.concat("h", F.lit("raw")), 256).alias("raw_sha256"))
    return audit.binding_violations(contexts, raw, clean, ["record_id"])


@query
def ag13_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = answered(spark, sf).select("source", F.length("answer").cast("double").alias("chars"), F.length("question").cast("double").alias("asked"), F.col("answer").contains("Điều").alias("cites"))
    out = evaluate.variant_rollup(r, "source", ["chars", "asked"], ["cites"])
    return out.select("source", "n", F.round("chars", 6).alias("chars"), F.round("asked", 6).alias("asked"), "n_cites", F.round("cites_rate", 9).alias("cites_rate"))


@query
def ag21_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    models = n.where("n_nationkey <> 7").select(F.col("n_name").alias("model_key"), (F.col("n_nationkey") * 1.5).alias("parameters"))
    stacks = n.groupBy(F.col("n_regionkey").cast("string").alias("stack")).agg(F.collect_list("n_name").alias("model_keys"))
    return training.parameter_budget(models, stacks, 90.0).select("stack", "parameters", "n_known", "valid")


@query
def ag24_record_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_records").select("record_id", C.stable_json_hash("split", "record_id", "source").alias("record_sha256"))


@query
def ag29_lengths(spark: SparkSession, sf: str) -> DataFrame:
    out = training.length_summary(answered(spark, sf), C.whitespace_count(F.col("answer")))
    return out.withColumn("mean_length", F.round("mean_length", 6))


@query
def tx23_upper_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of cleaned texts that are upper-case headings."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("cleaned_text", "\n")).alias("line"))
    return lines.where(C.is_upper_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def tx41_finish_reasons(spark: SparkSession, sf: str) -> DataFrame:
    n = C.whitespace_count(F.col("answer"))
    last = F.when(F.col("answer").endswith("."), 2).otherwise(9)
    return answered(spark, sf).select("record_id", C.finish_reason(last, n, 2, 20).alias("reason"))


@query
def tx42_label_masks(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: F.length(x))
    return answered(spark, sf).where("question is not null").select("record_id", F.array_join(C.label_mask(ids("question"), ids("answer")).cast("array<string>"), " ").alias("labels"))


@query
def tx43_https(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.is_https(F.col("source_url")).alias("is_https"))


@query
def rt30_variants(spark: SparkSession, sf: str) -> DataFrame:
    a = answered(spark, sf).select(F.col("record_id").alias("query"), "answer")
    out = pipelines.derive_variants(a, {"as_is": F.col("answer"), "first_line": F.split("answer", "\n", 2)[0], "bare": F.trim("answer")})
    return out.select("variant", F.col("query").alias("record_id"), "changed", F.length("answer").alias("n_chars"))


@query
def sc10_extracted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that texts give themselves, with how many documents claim each."""
    n = table(spark, sf, "documents").select("document_id", C.source_number(F.col("cleaned_text")).alias("number")).where("number is not null")
    return n.groupBy("number").agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_document")).withColumn("resolved", F.col("n_documents") == 1)


@query
def rt_chunk_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: chunks hold their limits, say what their offsets say, and leave no visible character out."""
    return _chunk_checks(spark, sf, chunking.Bounds(120, 900, 20, 120))


def _letters_as_tokens(text: str) -> int:
    """A stand-in for a model tokenizer: a token per four characters of a word."""
    return sum((len(w) + 3) // 4 for w in text.split())


@query
def rt29_model_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a model tokenizer's count."""
    return _chunk_checks(spark, sf, chunking.Bounds(120, 900, 20, 120, _letters_as_tokens, 150))


def _chunk_checks(spark: SparkSession, sf: str, bounds: chunking.Bounds) -> DataFrame:
    docs = table(spark, sf, "documents").where("cleaned_text is not null").select("document_id", "source_title", "cleaned_text")
    c = chunking.chunk_documents(docs, F.col("document_id"), F.col("source_title"), F.col("cleaned_text"), bounds).select("document_id", "chunk_index", "start_char", "end_char", "text", "whitespace_token_count", "model_token_count")
    reach = F.max("end_char").over(Window.partitionBy("document_id").orderBy("start_char", "chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("before", F.coalesce(reach, F.lit(0))).join(docs.select("document_id", "cleaned_text"), "document_id")
    gap = F.expr("case when start_char > before then substring(cleaned_text, before + 1, start_char - before) end")
    one_word = F.col("whitespace_token_count") == 1
    fits = one_word | (F.length("text") <= bounds.max_chars) & (F.col("whitespace_token_count") <= bounds.max_words) & (F.coalesce("model_token_count", F.lit(0)) <= bounds.max_tokens)
    per = c.groupBy("document_id").agg(
        F.min(F.expr("substring(cleaned_text, start_char + 1, end_char - start_char) = text")).alias("exact"), F.min(fits).alias("fits"),
        F.min(C.is_blank(gap)).alias("gapless"), F.max("end_char").alias("upto"), F.max("cleaned_text").alias("t"),
    )
    covered = F.col("gapless") & C.is_blank(F.expr("substring(t, upto + 1)"))
    return per.select("document_id", "exact", "fits", covered.alias("covered"))

"""The pN_ queries with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import broken_pairs, leakage, mixing, sentences, split_overlap, splitting, top_items, visual_form
from quillspark.session import cut_lineage, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "training_records").select("record_id", "question", "split"))
    pairs = split_overlap.question_overlaps(rows, F.col("record_id"), F.col("question"), F.col("split"))
    return pairs.select(F.least("train_id", "other_id").alias("record_id_a"), F.greatest("train_id", "other_id").alias("record_id_b"))


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "training_records").select("record_id", "question", "split"))
    links = split_overlap.overlap_links(rows, F.col("record_id"), F.col("question"), F.col("split"))
    return links.select(F.col("id").alias("record_id"), "is_train", F.hex("class_id").alias("class_id"), "n_links")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "training_records").select("record_id", "question", "split", "source"))
    return split_overlap.overlap_report(rows, F.col("record_id"), F.col("question"), F.col("split"), F.col("source"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_items.best_chunks(table(spark, sf, "retrieval_results")).select("question_id", "rank_no", "chunk_id")


def p2_top_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return top_items.best_chunks_with_context(table(spark, sf, "retrieval_results"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf, "legal_chunks"), whole=False)
    return pieces.where("piece_no = 0").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "legal_chunks")
    columns = ["chunk_id", "document_id", "article_number", "text", "start_char", "end_char"]
    moved = splitting.relocate(chunks.select(columns), table(spark, sf, "documents"))
    pieces = splitting.split_oversized(moved)
    return pieces.dropDuplicates(["chunk_id", "piece_no", "text"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "training_records").select("record_id", "split", "question", "answer", "lang")).where("coalesce(split, '') not in ('public', 'private')")
    return broken_pairs.broken_pairs(rows, F.col("record_id"), F.col("question"), F.col("answer"), F.col("lang")).select(F.col("id").alias("record_id"), "defect")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, key, text in (("documents", "doc_id", "cleaned_text"), ("legal_chunks", "chunk_id", "search_text")):
        pairs = visual_form.lookalike_pairs(spread(table(spark, sf, name).select(key, text)), F.col(key), F.col(text)).select(F.lit(name).alias("table_name"), "key_a", "key_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, key, text in (("documents", "doc_id", "cleaned_text"), ("legal_chunks", "chunk_id", "search_text")):
        part = visual_form.lookalike_links(spread(table(spark, sf, name).select(key, text)), F.col(key), F.col(text)).select(F.lit(name).alias("table_name"), "key", F.hex("class_id").alias("class_id"), "n_links")
        out = part if out is None else out.unionByName(part)
    return out


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, key, text in (("documents", "doc_id", "cleaned_text"), ("legal_chunks", "chunk_id", "search_text")):
        part = visual_form.canonical_texts(spread(table(spark, sf, name).select(key, text)), F.col(key), F.col(text)).select(F.lit(name).alias("table_name"), "key", "form", "changed", "class_id")
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items")
    return leakage.leaked_items(spread(table(spark, sf, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("lang"), F.col("text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("doc_id").cast("long").alias("doc_id"), "item_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, sf), table(spark, sf, "eval_items"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut_lineage(mixing.token_sizes(spread(table(spark, sf, "documents").select("doc_id", "source", "text")), F.col("doc_id"), F.col("source"), F.col("text")))
    return mixing.mix_sources(sizes, table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0].select(F.col("doc").cast("long").alias("doc_id"), "source", "n_tokens", "copies").where("copies > 0")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix promises, per source: no document above its limit, and as many tokens as planned but for one document."""
    s = _mix(spark, sf)[1].where("source is not null")
    meets = F.abs(F.col("mixed_tokens") - F.col("planned_tokens")) <= F.col("largest")
    return s.select("source", "n_documents", (F.col("highest_copies") <= F.coalesce("max_repeats", F.lit(0))).alias("within_limit"), meets.alias("meets_plan"), (F.col("target_share") > 0).alias("has_target"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_texts(spark, sf), F.col("doc_id"), F.col("text"), F.col("lang")).select(F.col("id").alias("doc_id"), "end_char")


def p8_model(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.learn(_texts(spark, sf), F.col("text"), F.col("lang"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_links, p1_report, p2_found, p2_top_chunks, p3_found, p3_pieces, p4_found, p5_found, p5_links, p5_forms, p6_found, p6_report, p7_mix, p7_shares, p7_kept, p8_found, p8_model)}

"""Queries over the driver's tables for the core operators. Names begin with the operator's id; ``sql.py`` holds the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.answers import clean_answer_udf, trim_answer_udf, trim_interior_udf
from quillspark.functions.cleaning import clean_passages
from quillspark.operators import audit, chunking, context, dense, evaluate, fusion, lexical, packing, references, splits, training
from quillspark.plans import pipelines
from quillspark.session import balance, cut_lineage, spread, spread_by, table
from quillspark.sql import SQL
from quillspark.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_PLACE = ("document_id", "article_number", "article_title", "chunk_index", "start_char", "end_char", "text")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def chunks_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Chunks without redelivered rows: of each id the row with the least index, then the least of the other columns."""
    own = dict.fromkeys(("chunk_index", *columns))
    rows = spread_by(table(spark, sf, "legal_chunks").select("chunk_id", *own), "chunk_id")
    return rows.groupBy("chunk_id").agg(F.min(F.struct(*own)).alias("c")).select("chunk_id", *(f"c.{c}" for c in columns))


def placed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose own offsets fit their text, as the SQL of the queries over them says; :func:`located_chunks` has all."""
    return chunks_of(spark, sf, *_PLACE).where("end_char - start_char = length(text)")


def located_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks with offsets that hold in their documents: their own, found again by search, or null if the text isn't there."""
    return chunking.relocate(chunks_of(spark, sf, *_PLACE), table(spark, sf, "documents"))


def branch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``query, branch, id, rank`` of all runs of a question."""
    rows = table(spark, sf, "retrieval_results").where("question_id is not null").select(F.col("question_id").alias("query"), F.explode("fused").alias("f"))
    return rows.select("query", F.col("f.chunk_id").alias("id"), F.explode("f.branch_ranks").alias("branch", "rank")).where("id is not null and rank is not null").select("query", "branch", "id", "rank")


def branch_hits(spark: SparkSession, sf: str) -> DataFrame:
    """``query, branch, id, rank``: the best rank of each chunk per branch over all runs of a question."""
    return branch_rows(spark, sf).groupBy("query", "branch", "id").agg(F.min("rank").alias("rank"))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_records").where("coalesce(split, '') not in ('public', 'private') and answer is not null")


# --- lexical and dense retrieval ---


def _bm25(spark: SparkSession, sf: str, tokens: Callable[[Column], Column]) -> DataFrame:
    chunks = chunks_of(spark, sf, "search_text")
    hits = lexical.bm25_scan(chunks, F.col("chunk_id"), tokens(F.col("search_text")), table(spark, sf, "eval_items"), F.col("item_id"), tokens(F.col("text")), 10)
    return hits.select(F.col("query").cast("long").alias("item_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def rt01_bm25_word(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, lexical.word_tokens)


@query
def jn01_bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as queries, by the postings join."""
    index = lexical.build_index(chunks_of(spark, sf, "search_text"), F.col("chunk_id"), lexical.word_tokens(F.col("search_text")))
    asked = table(spark, sf, "documents").where("doc_id % 50 = 0 and source_title is not null").select("doc_id", "source_title")
    hits = lexical.bm25_search(index, asked, F.col("doc_id"), lexical.word_tokens(F.col("source_title")), 10)
    return hits.select(F.col("query").alias("doc_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def rt02_bm25_folded(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, lexical.folded_tokens)


@query
def rt03_bm25_substring(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical.substring_search(chunks_of(spark, sf, "search_text"), F.col("chunk_id"), F.col("search_text"), table(spark, sf, "eval_items"), F.col("item_id"), F.col("text"), 10)
    return hits.select(F.col("query").cast("long").alias("item_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def rt04_fused_sparse(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("word", rt01_bm25_word), ("folded", rt02_bm25_folded), ("substring", rt03_bm25_substring)]
    hits = None
    for name, f in parts:
        h = f(spark, sf).select(F.col("item_id").alias("query"), F.lit(name).alias("branch"), F.col("chunk_id").alias("id"), "rank")
        hits = h if hits is None else hits.unionByName(h)
    out = fusion.fuse_with_trace(hits, {"word": 0.5, "folded": 0.3, "substring": 0.2})
    return out.where("rank <= 10").select(F.col("query").alias("item_id"), F.col("id").alias("chunk_id"), "score", "best_rank", "rank")


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return dense.dense_search(v, F.col("vec_id"), F.col("embedding"), v.where("vec_id % 50 = 0"), F.col("vec_id"), F.col("embedding"), k, skip_self=True)


@query
def rt05_dense_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 10).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def tx40_vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    n = F.col("embedding")
    return v.select("vec_id", F.round(C.dot(n, n), 6).alias("squared_norm"), F.round(C.dot(C.l2_normalize(n), n), 6).alias("norm"))


@query
def rt06_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 12).select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def rt06_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval end to end: words and vectors of all chunks, by their own ids. The encoder is a stand-in of three counts."""
    count = lambda c, mark: F.size(F.split(c, mark)).cast("double")
    encode = lambda c: F.array(F.length(c).cast("double") / 1000, count(c, " ") / 100, count(c, "a") / 50)
    chunks, items = cut_lineage(chunks_of(spark, sf, "text", "search_text")), table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    sparse = lexical.bm25_scan(chunks, F.col("chunk_id"), lexical.word_tokens(F.col("search_text")), items, F.col("query"), lexical.word_tokens(F.col("question")), 40)
    vectors = chunks.where("text is not null").select(F.col("chunk_id").alias("id"), encode(F.col("text")).alias("v"))
    out = pipelines.fuse_branches(sparse, items, vectors, items.where("question is not null").select("query", encode(F.col("question")).alias("v")))
    return out.select(F.col("query").alias("item_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def rt07_weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = {f"s{s}_d{d}": {"sparse": s / 10, "dense": d / 10} for s, d in ((6, 4), (5, 5), (4, 6))}
    return fusion.weight_grid(branch_rows(spark, sf), grid, 60, 5).select("variant", F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "score", "rank")


@query
def ag09_rrf_trace(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.fuse_with_trace(branch_hits(spark, sf), {"sparse": 0.5, "dense": 0.5})
    at = lambda b: F.try_element_at("branch_ranks", F.lit(b))
    return out.where("rank <= 10").select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "score", "best_rank", at("sparse").alias("sparse_rank"), at("dense").alias("dense_rank"), "rank")


@query
def ag11_articles(spark: SparkSession, sf: str) -> DataFrame:
    where = chunks_of(spark, sf, "document_id", "article_number").select(F.col("chunk_id").alias("id"), "document_id", F.coalesce("article_number", F.col("chunk_id")).alias("block_id"))
    out = fusion.aggregate_articles(branch_hits(spark, sf).join(where, "id"), {"sparse": 0.5, "dense": 0.5})
    return out.where("rank <= 8").select(F.col("query").alias("question_id"), "document_id", "block_id", "score", "representative", "representative_score", "n_chunks", "rank")


@query
def wn02_diverse_order(spark: SparkSession, sf: str) -> DataFrame:
    where = chunks_of(spark, sf, "document_id", "article_number").withColumnRenamed("chunk_id", "id")
    hits = fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 20).join(where, "id")
    return fusion.diverse_order(hits, 12).select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "rank", "position")


@query
def rt32_context_variants(spark: SparkSession, sf: str) -> DataFrame:
    where = chunks_of(spark, sf, "document_id", "article_number").withColumnRenamed("chunk_id", "id")
    hits = cut_lineage(fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 20).join(where, "id"))
    plain = hits.withColumn("position", F.col("rank"))
    variants = [("top20", plain), ("top12", plain.where("rank <= 12")), ("diverse12", fusion.diverse_order(hits, 12))]
    rows = None
    for name, v in variants:
        v = v.select(F.lit(name).alias("variant"), "query", "id", "document_id", "article_number", "rank", "position")
        rows = v if rows is None else rows.unionByName(v)
    out = evaluate.mean_distinct(rows, "variant", "query", documents=F.col("document_id"), units=F.struct("document_id", F.coalesce("article_number", F.lit("~")).alias("a")))
    return out.select("variant", F.round("documents", 9).alias("documents"), F.round("units", 9).alias("units"))


@query
def ag19_branch_overlap(spark: SparkSession, sf: str) -> DataFrame:
    hits = branch_hits(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query", "branch").orderBy("rank", "id")))
    out = fusion.top_sets_jaccard(hits.where("branch = 'sparse'"), hits.where("branch = 'dense'"), 5)
    return out.select(F.col("query").alias("question_id"), F.round("jaccard", 9).alias("jaccard"))


# --- blocks, spans, packing ---


@query
def wn03_article_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return context.article_blocks(placed_chunks(spark, sf)).select("chunk_id", "block_id", "block_pos")


@query
def wn04_expansions(spark: SparkSession, sf: str) -> DataFrame:
    out = context.expansions(context.article_blocks(placed_chunks(spark, sf)))
    return out.select("chunk_id", "kind", "start", "end", F.size("chunk_ids").alias("n_chunks"))


@query
def wn04_run_expansions(spark: SparkSession, sf: str) -> DataFrame:
    """The same where all consecutive articles of a document count as one, as most articles here are a single chunk."""
    c = placed_chunks(spark, sf).where("article_number is not null").withColumn("article_number", F.lit("run")).withColumn("article_title", F.lit(None).cast("string"))
    return context.expansions(context.article_blocks(c)).select("chunk_id", "kind", "start", "end", F.size("chunk_ids").alias("n_chunks"))


@query
def wn05_merged_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = placed_chunks(spark, sf).select("document_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("chunk_index").alias("rank"), F.array("chunk_id").alias("chunk_ids"))
    return context.merge_spans(spans, ["document_id"]).select("document_id", "start", "end", "rank", F.size("chunk_ids").alias("n_chunks"))


@query
def jn07_enclosing_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Each article chunk with its block's span, found by containment."""
    c = placed_chunks(spark, sf).where("article_number is not null")
    articles = context.article_blocks(c).groupBy("document_id", "block_id", F.col("article_number").alias("number")).agg(F.min("start_char").alias("start"), F.max("end_char").alias("end"))
    return context.enclosing_articles(c, articles).groupBy("document_id").agg(F.count("*").alias("n_pairs"), F.count("article_start").alias("n_enclosed"))


@query
def dq04_provenance(spark: SparkSession, sf: str) -> DataFrame:
    spans = chunks_of(spark, sf, "document_id", "start_char", "end_char", "text")
    return audit.provenance_violations(spans, table(spark, sf, "documents")).select("chunk_id", "document_id")


def _units(spark: SparkSession, sf: str, run: bool = False) -> DataFrame:
    """Each question's 12 best chunks as units with their expansions; with ``run`` all consecutive articles of a document count as one, as most articles here are a single chunk."""
    docs = table(spark, sf, "documents").select("document_id", "source_title", "document_number", "cleaned_text")
    chunks = located_chunks(spark, sf).drop("text")
    if run:
        chunks = chunks.where("article_number is not null").withColumn("article_number", F.lit("run")).withColumn("article_title", F.lit(None).cast("string"))
    blocks = cut_lineage(context.article_blocks(chunks).where("start_char is not null"))
    hits = fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 12)
    asked = _asked(spark, sf)
    return balance(context.seed_units(hits.join(asked, "query").select("query", "question", "id", "rank"), blocks, docs), "query")


@query
def rt14_packed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_units(spark, sf), packing.Budget(2000, 400)).select(F.col("query").alias("question_id"), "n_tokens", "n_units", "n_expanded", "body_chars", F.sha2("prompt", 256).alias("prompt_sha256"))


@query
def rt14_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What packing promises: no hit is forgotten, and the prompt fits."""
    out = packing.pack(_units(spark, sf), packing.Budget(2000, 400))
    return out.select(F.col("query").alias("question_id"), (F.col("n_units") + F.col("n_skipped")).alias("n_hits"), (F.col("n_tokens") <= 2000).alias("fits"))


@query
def rt16_packed_without_merge(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_units(spark, sf), packing.Budget(2000, 400), merge=False).select(F.col("query").alias("question_id"), "n_tokens", "n_units", "n_expanded", "body_chars")


@query
def rt16_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds alone, each a context of its own, under a budget that not all of them meet."""
    out = packing.pack(_units(spark, sf), packing.Budget(600), expand=False, merge=False)
    return out.select(F.col("query").alias("question_id"), "n_tokens", "n_units", F.sha2("prompt", 256).alias("prompt_sha256"))


@query
def rt17_selective_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of widened units; here all consecutive articles of a document count as one."""
    out = context.selective_segments(_units(spark, sf, run=True))
    return out.select(F.col("query").alias("question_id"), "segment.rank", "segment.document_id", "segment.start", "segment.end", F.sha2("segment.text", 256).alias("text_sha256"))


@query
def rt17_packed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds and up to three segments of the widened units, ordered by a stand-in for a reranker: those of better seeds first, then the longest."""
    units = cut_lineage(_units(spark, sf, run=True))
    s = F.col("segment")
    order = Window.partitionBy("query").orderBy(s["rank"], F.length(s["text"]).desc(), s["document_id"], s["start"])
    ranked = context.selective_segments(units).withColumn("position", F.row_number().over(order))
    out = packing.pack_segments(units, ranked, packing.Budget(2000, 400), 3)
    return out.select(F.col("query").alias("question_id"), "n_tokens", "n_units", F.size("added").alias("n_added"), "body_chars", F.sha2("prompt", 256).alias("prompt_sha256"))


@query
def rt19_packed_references(spark: SparkSession, sf: str) -> DataFrame:
    """Widened evidence and up to two articles that the question or the evidence refers to, where one document and one article of it answer to the reference."""
    units, chunks = cut_lineage(_units(spark, sf)), cut_lineage(located_chunks(spark, sf))
    numbers = table(spark, sf, "documents").select("document_id", "document_number", "source_title", "cleaned_text")
    articles = context.article_blocks(chunks).where("article_number is not null and start_char is not null").groupBy("document_id", "block_id", F.col("article_number").alias("number")).agg(F.min("article_title").alias("title"), F.min("start_char").alias("start"), F.max("end_char").alias("end"), F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    seeds = units.select("query", "question", F.explode("units").alias("u")).select("query", "question", "u.rank", "u.document_id", "u.start", "u.end", F.explode("u.chunk_ids").alias("id"))
    asked = references.extract_references(units, F.col("query"), F.col("question"), True).withColumn("query", F.col("id")).withColumn("rank", F.lit(-1)).withColumn("trigger_document", F.lit(None).cast("string"))
    hit = chunks.join(seeds.select("id").distinct(), chunks["chunk_id"] == F.col("id"), "left_semi").where("start_char is not null")
    said = references.extract_references(hit, F.col("chunk_id"), F.col("text"), False, F.col("document_id"), F.col("start_char"))
    said = said.join(seeds.select("query", "rank", "id"), "id").withColumn("trigger_document", F.col("document_id"))
    refs = references.resolve_targets(asked.unionByName(said.select(asked.columns)), numbers.where("document_number is not null").select("document_id", "document_number"), articles)
    a, d = articles.toDF("td", "block_id", "number", "title", "target_start", "target_end", "ids"), numbers.toDF("td", "number_", "source", "t")
    j = refs.where("target_start is not null").withColumnRenamed("target_document", "td").join(a, ["td", "target_start", "target_end"]).join(d, "td")
    span = F.struct(
        F.lit(100).alias("rank"), F.col("td").alias("document_id"), "block_id", F.col("number").alias("article_number"), F.col("title").alias("article_title"), F.col("source").alias("source_title"), F.col("number_").alias("document_number"),
        F.col("target_start").alias("start"), F.col("target_end").alias("end"), F.expr("substring(t, target_start + 1, target_end - target_start)").alias("text"), F.col("ids").alias("chunk_ids"),
    )
    own = lambda c: F.when(F.col("trigger_document").isNotNull(), F.col(c))
    rows = j.select("query", "trigger_document", own("start").alias("trigger_start"), own("end").alias("trigger_end"), F.array(span).alias("options"), "rank", F.col("start").alias("_s"), "id")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("rank", "id", "_s", F.col("options")[0]["document_id"], F.col("options")[0]["start"]))).drop("rank", "_s", "id")
    out = packing.pack_references(units, rows, packing.Budget(2000, 400), 2)
    return out.select(F.col("query").alias("question_id"), "n_tokens", "n_units", F.array_join("added", ",").alias("added"), "body_chars")


@query
def rt20_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The section of a retrieved document that a question points to, and the prompt with it in place of the document's hits."""
    units = cut_lineage(_units(spark, sf))
    spans = units.select("query", "question", F.explode("units").alias("u")).select("query", "question", (F.col("u.rank") - 1).alias("rank"), "u.document_id", "u.start", "u.end")
    found = cut_lineage(references.resolve_sections(spans, table(spark, sf, "documents").select("document_id", "source_title", "cleaned_text")))
    packed = packing.pack(references.replacement_units(units.join(found.select("query"), "query", "left_semi"), found), packing.Budget(2000, 400), expand=False)
    return found.join(packed.select("query", "n_tokens", "n_units"), "query").select(F.col("query").alias("question_id"), "document_id", "kind", "start", "end", "score", "n_tokens", "n_units")


@query
def rt22_training_gates(spark: SparkSession, sf: str) -> DataFrame:
    """All gates: records of the answered training questions against their answers, their seeds, their documents, a second run with other answers, and the settings."""
    gold = answered(spark, sf).where("split = 'train'").groupBy(F.col("question_id").alias("query")).agg(F.min("answer").alias("answer"))
    units, budget = cut_lineage(_units(spark, sf)), packing.Budget(8192, 1200)
    make = lambda answers: cut_lineage(training.training_records(units, answers, budget, _word_ids, 2))
    records, other = make(gold), make(gold.withColumn("answer", F.regexp_replace("answer", r"\S+", "khác")))
    stored = training.identities(records)
    answers = records.select("query").join(gold, "query").select("query", C.text_udf(lambda t: [*_word_ids(t), 2], "array<int>")(F.col("answer")).alias("answer_ids"))
    seeds = records.select("query").join(units.select("query", F.flatten("units.chunk_ids").alias("seed_ids")), "query")
    spans = units.select(F.explode("units").alias("u")).select("u.document_id", F.col("u.start").alias("start_char"), F.col("u.end").alias("end_char"), "u.text")
    violations = audit.provenance_violations(spans, table(spark, sf, "documents"))
    settings = {"max_input_tokens": budget.max_input_tokens, "max_parent_tokens": budget.max_parent_tokens, "order": context.EXPANSION_ORDER}
    return training.gates(records, 8192, stored=stored, answers=answers, seeds=seeds, provenance=violations, mutated=other, contract=(settings, {"max_input_tokens": 8192, "max_parent_tokens": 1200, "order": context.EXPANSION_ORDER}))


def _word_ids(text: str) -> list[int]:
    """A stand-in for a model tokenizer: a stable number per word."""
    import zlib

    return [3 + zlib.crc32(w.encode()) % 32_000 for w in text.split()]


@query
def rt_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    out = chunking.chunk_documents(docs, F.col("document_id"), F.col("source_title"), F.col("cleaned_text"), chunking.Bounds(120, 900, 20, 120))
    return out.select("chunk_id", "document_id", "article_number", "article_title", "section_kind", "split_method", "chunk_index", "start_char", "end_char", "whitespace_token_count")


@query
def wn06_fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.fixed_windows(table(spark, sf, "documents"), F.col("doc_id"), F.col("cleaned_text"), 64, 16)
    return out.select(F.col("id").alias("doc_id"), "window_no", F.sha2("text", 256).alias("text_sha256"))


# --- audits ---


@query
def ag01_corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    n = F.length(t)
    return audit.flags(
        table(spark, sf, "documents"),
        {"n_blank": C.is_blank(t), "n_markup": t.rlike("<[a-z/]"), "n_cr": t.contains("\r"), "n_stale_count": ~F.col("raw_character_count").eqNullSafe(n), "n_untitled": F.col("source_title").isNull()},
        F.count("*").alias("n_documents"), F.sum(n).alias("total_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
    )


@query
def ag02_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return audit.percentiles(table(spark, sf, "documents").where("source is not null").withColumn("src", F.lower(F.trim("source"))), F.length("text"), [0.5, 0.9, 0.99], ["src"])


@query
def ag03_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exact_duplicates(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


@query
def tk10_longest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.longest(table(spark, sf, "documents"), F.col("doc_id"), F.length("text"), 20)


@query
def ag04_chunk_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks_of(spark, sf, "section_kind", "split_method", "article_number", "whitespace_token_count", "text")
    stale = ~F.col("whitespace_token_count").eqNullSafe(C.whitespace_count(F.col("text")))
    return c.groupBy("section_kind", "split_method").agg(F.count("*").alias("n"), F.count("article_number").alias("n_numbered"), F.sum(stale.cast("long")).alias("n_stale"), F.sum(F.length("text")).alias("chars"))


@query
def ag20_token_audit(spark: SparkSession, sf: str) -> DataFrame:
    n = C.whitespace_count(F.col("text"))
    return audit.flags(chunks_of(spark, sf, "text"), {f"over_{x}": n > x for x in (64, 128, 256, 512)}, F.count("*").alias("n"), F.max(n).alias("longest"))


@query
def ag25_metadata_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(table(spark, sf, "documents"), "source_title", "document_number", "source", "lang", "source_name")


@query
def ag06_conflicting_answers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.conflicting_groups(answered(spark, sf), C.normalize_question(F.col("question")), C.normalize_question(F.col("answer")))


@query
def ag07_split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "training_records").select("split", C.normalize_question(F.col("question")).alias("q")).where("q is not null")
    return audit.set_report(r.where("split = 'train'"), r.where("split <> 'train'"), "q")


@query
def dq05_leaking_groups(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "training_records").select("split", C.normalize_question(F.col("question")).alias("q"))
    return audit.leaking_groups(r, "q", "split")


@query
def ag23_ordered_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "retrieval_results").select("result_id", F.sha2(F.array_join("fused.chunk_id", "\n"), 256).alias("ids_sha256")).distinct()


@query
def sc10_document_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that name exactly one document (resolve or ambiguous)."""
    n = table(spark, sf, "documents").where("document_number is not null").groupBy("document_number").agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_document"))
    return n.withColumn("resolved", F.col("n_documents") == 1)


# --- splits, samples, shards ---


@query
def tx39_hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_records").select("record_id", C.hash_bucket("quill", F.col("question_id"), 100).alias("bucket"))


@query
def tk08_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "training_records").where("split = 'dev' and question_id is not null").select("question_id").distinct()
    return splits.hash_sample(ids, "question_id", "dev-7", 200).select("question_id", "position")


@query
def rt23_split_roles(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "training_records")
    return splits.leakage_safe_splits(r, "record_id", F.col("question"), F.col("answer"), F.col("split").isin("public", "private"), "quill", 100, 10).select("record_id", "role")


@query
def rt24_group_holdout(spark: SparkSession, sf: str) -> DataFrame:
    g = answered(spark, sf).where("split = 'train'").select(C.normalize_question(F.col("question")).alias("group")).groupBy("group").agg(F.count("*").alias("n_rows"))
    return splits.group_holdout(g, "holdout-1", 50)


@query
def rt25_shards(spark: SparkSession, sf: str) -> DataFrame:
    return splits.shard_assignment(table(spark, sf, "training_records").where("split = 'private'"), "question_id", 4).select("question_id", "position", "shard")


@query
def jn12_warmup_alias(spark: SparkSession, sf: str) -> DataFrame:
    r = answered(spark, sf)
    return splits.warmup_alias(r.where("source = 'warmup'"), r.where("source <> 'warmup'"), "question", "answer", "record_id")


@query
def tk13_numeric_order(spark: SparkSession, sf: str) -> DataFrame:
    return splits.positions(table(spark, sf, "training_records"), "question_id", splits.numeric_aware_order("question_id"))


# --- text ---


@query
def tx01_normalized_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_records").select("record_id", C.normalize_question(F.col("question")).alias("normalized"))


@query
def tx02_folded_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.fold_accents(F.col("source_title")).alias("folded_title"))


@query
def tx03_query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = C.distinct_tokens(F.col("question"))
    return table(spark, sf, "training_records").select("record_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query
def tx05_longest_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = C.longest_terms(C.distinct_tokens(F.col("text")), 3, 8)
    return table(spark, sf, "eval_items").select("item_id", F.array_join(t, " ").alias("terms"))


@query
def tx06_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_passages(spread(table(spark, sf, "documents")), F.col("doc_id"), F.col("text")).withColumnRenamed("id", "doc_id")


@query
def tx12_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks_of(spark, sf, "document_id", "chunk_index", "text")
    return c.select("chunk_id", C.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text")).alias("expected_id"))


@query
def tx13_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(spark, sf, "text").select("chunk_id", C.whitespace_count(F.col("text")).alias("n_words"))


@query
def tx14_source_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.source_number(F.col("cleaned_text")).alias("source_number"))


@query
def tx15_enriched(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("document_id", "document_number")
    c = chunks_of(spark, sf, "document_id", "source_title", "article_title", "text").join(d, "document_id", "left")
    return c.select("chunk_id", F.sha2(C.enrich_context(F.col("text"), F.col("source_title"), F.col("document_number"), F.col("article_title")), 256).alias("enriched_sha256"))


@query
def tx17_references(spark: SparkSession, sf: str) -> DataFrame:
    return references.extract_references(table(spark, sf, "training_records"), F.col("record_id"), F.col("question"), True).select(F.col("id").alias("record_id"), "article_number", "clause_number", "document_number", "resolution", "start", "end")


@query
def rt19_cross_references(spark: SparkSession, sf: str) -> DataFrame:
    c = cut_lineage(located_chunks(spark, sf))
    refs = references.extract_references(c, F.col("chunk_id"), F.col("text"), False, F.col("document_id"), F.col("start_char"))
    numbers = table(spark, sf, "documents").select("document_id", "document_number").where("document_number is not null")
    articles = context.article_blocks(c).where("article_number is not null").groupBy("document_id", "block_id", F.col("article_number").alias("number")).agg(F.min("start_char").alias("start"), F.max("end_char").alias("end"))
    out = references.resolve_targets(refs, numbers, articles)
    return out.groupBy("resolution").agg(F.count("*").alias("n"), F.count("target_document").alias("n_document"), F.count("target_start").alias("n_article"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's text, spread for the folding that follows."""
    rows = table(spark, sf, "training_records").where("question is not null").select(F.col("question_id").alias("query"), "question")
    return spread_by(rows, "query").groupBy("query").agg(F.min("question").alias("question"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best of each question that has a text."""
    return fusion.fuse(branch_rows(spark, sf), {"sparse": 0.5, "dense": 0.5}, 60, 20).select("query", "id", "rank")


@query
def rt11_citation_order(spark: SparkSession, sf: str) -> DataFrame:
    contexts = references.citation_contexts(chunks_of(spark, sf, "document_id", "article_number", "text").withColumnRenamed("chunk_id", "id"))
    hits = _hits(spark, sf).where("rank <= 12").withColumn("rank", F.col("rank") - 1)
    out = references.citation_order(references.citation_scores(hits, contexts, references.citation_questions(_asked(spark, sf))))
    return out.select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "rank", "document_hits", "article_hits", "clause_hits", "token_hits", "bigram_hits", "score", "position")


@query
def rt12_source_aware(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked = table(spark, sf, "documents").select("document_id", "source_title", "document_number"), _asked(spark, sf)
    place = chunks_of(spark, sf, "document_id").withColumnRenamed("chunk_id", "id").join(docs.select("document_id"), "document_id", "left_semi")
    pool = cut_lineage(_hits(spark, sf).join(asked.select("query"), "query", "left_semi").join(place, "id"))
    out = references.source_aware_selection(pool, references.resolve_sources(pool, asked, docs))
    return out.select(F.col("query").alias("question_id"), F.col("id").alias("chunk_id"), "rank", "position", "promoted")


@query
def tx24_answer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    a = answered(spark, sf).where("question_id is not null").groupBy(F.col("question_id").alias("query")).agg(F.min("answer").alias("answer"))
    texts = chunks_of(spark, sf, "text").select(F.col("chunk_id").alias("id"), F.col("text").alias("context"))
    best = _hits(spark, sf).where("rank = 1").join(_asked(spark, sf).select("query"), "query", "left_semi").join(texts, "id").select("query", "context")
    return references.answer_evidence(a.join(best, "query")).withColumnRenamed("query", "question_id")


@query
def rt27_failure_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "retrieval_results").where("question_id is not null").groupBy("question_id").agg(F.count("*").alias("n_contexts"))
    scored = _scored(spark, sf).join(answered(spark, sf).select("record_id", "question_id"), "record_id")
    s = scored.groupBy("question_id").agg(F.min(F.round("meteor_exact", 9)).alias("metric"))
    return evaluate.failure_audit(s, r, "question_id", "metric", 50)


# --- answers and scores ---


@query
def tx25_answer_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).select("record_id", C.answer_diagnostics(F.col("answer")).alias("d")).select("record_id", "d.*")


@query
def tx26_rouge_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).select("record_id", F.array_join(C.rouge_tokens(F.col("answer")), " ").alias("tokens"))


@query
def tx34_cleaned_answers(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("answer")
    return answered(spark, sf).select("record_id", clean_answer_udf(a).alias("cleaned"), trim_answer_udf(a).alias("trimmed"), trim_interior_udf(a).alias("interior"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Each record's answer as a prediction for the least answer of its question."""
    r = answered(spark, sf).where("question_id is not null")
    gold = r.groupBy("question_id").agg(F.min("answer").alias("r"))
    return evaluate.score_columns(r.join(gold, "question_id").select("record_id", "source", "r", F.col("answer").alias("p")), "record_id")


@query
def rt26_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("record_id", F.round("rouge_l", 9).alias("rouge_l"), F.round("meteor_exact", 9).alias("meteor_exact"))


@query
def tk11_lowest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.lowest(_scored(spark, sf).select("record_id", F.round("meteor_exact", 9).alias("meteor_exact")), "meteor_exact", "record_id", 40)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Per question the best fused score of even and odd runs: a paired comparison of two systems."""
    r = table(spark, sf, "retrieval_results").where("question_id is not null").select("question_id", "sample_index", F.explode("fused.rrf_score").alias("s")).where("s is not null and not isnan(s)")
    return r.groupBy("question_id").agg(F.max(F.when(F.col("sample_index") % 2 == 0, F.col("s"))).alias("even"), F.max(F.when(F.col("sample_index") % 2 != 0, F.col("s"))).alias("odd"))


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).where("even is not null and odd is not null")
    return evaluate.paired_deltas(runs.select("question_id", F.col("even").alias("m")), runs.select("question_id", F.col("odd").alias("m")), "question_id", "m")


@query
def ag14_paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluate.delta_summary(_deltas(spark, sf), 1e-6)
    return d.select("n", F.round("mean_delta", 9).alias("mean_delta"), F.round("min_delta", 9).alias("min_delta"), F.round("max_delta", 9).alias("max_delta"), "improved", "worsened", "tied")


@query
def ag15_ranked_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bootstrap_by_rank(_deltas(spark, sf), "question_id", "sample-1", 2000)


@query
def ag16_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bootstrap(_deltas(spark, sf), "question_id")


@query
def ag17_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.delta_summary(_deltas(spark, sf), 1e-6)
    out = evaluate.acceptance(s, {"mean_ok": F.col("mean_delta") > -0.01, "more_better": F.col("improved") >= F.col("worsened")})
    return out.select("n", "mean_ok", "more_better", "accepted")


@query
def ag12_optional_means(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "training_records")
    out = evaluate.optional_means(r.where("split is not null"), ["split"], {"answer_chars": (F.length("answer"), F.col("answer").isNotNull()), "question_chars": (F.length("question"), F.col("lang") == "vi")})
    return out.select("split", F.round("answer_chars", 6).alias("answer_chars"), F.round("question_chars", 6).alias("question_chars"), "n_answer_chars", "n_question_chars")


@query
def jn14_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Per question the answer of its latest record, else of its first."""
    r = answered(spark, sf).where("question_id is not null")
    first = r.groupBy("question_id").agg(F.min_by("answer", "record_id").alias("answer"))
    second = r.where("source = 'official'").groupBy("question_id").agg(F.max_by("answer", "record_id").alias("answer"))
    return evaluate.coalesce_passes(first, second, "question_id")


@query
def ag18_best_variant(spark: SparkSession, sf: str) -> DataFrame:
    r = answered(spark, sf).where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("answer")).alias("m"))
    return evaluate.best_variant(r, "source", "n", "m")


@query
def ag26_cleanup_rates(spark: SparkSession, sf: str) -> DataFrame:
    final = pipelines.finalize_answers(answered(spark, sf).select(F.col("record_id").alias("query"), "answer"))
    return pipelines.cleanup_rates(final)


@query
def rt28_resampled(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.poisson_bootstrap(_deltas(spark, sf), "question_id")


@query
def rt28_paired_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned answers against raw ones, both scored against the question's least answer; the flag is an answer that ends without a mark."""
    r = answered(spark, sf).where("question_id is not null")
    gold = r.groupBy("question_id").agg(F.min("answer").alias("r"))
    rows = cut_lineage(r.join(gold, "question_id").select("record_id", "r", F.col("answer").alias("raw"), clean_answer_udf(F.col("answer")).alias("cleaned")))
    sides = []
    for c in ("cleaned", "raw"):
        flag = rows.select("record_id", F.coalesce(C.answer_diagnostics(F.col(c))["non_sentence_ending"], F.lit(True)).alias("unended"))
        sides.append(evaluate.score_columns(rows.select("record_id", "r", F.col(c).alias("p")), "record_id").join(flag, "record_id"))
    return evaluate.paired_gate(*sides, "record_id", "meteor_exact", "rouge_l", "unended")


@query
def ss01_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with results but without a run after the first: what a resumed run would take."""
    r = table(spark, sf, "retrieval_results").where("question_id is not null").select("question_id", "sample_index")
    return r.select("question_id").distinct().join(r.where("sample_index > 1").select("question_id").distinct(), "question_id", "left_anti")


# --- events ---


@query
def ss_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.window_counts(table(spark, sf, "events"), "1 hour")


@query
def ss_event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return ev.window_counts(table(spark, sf, "events"), "1 hour", "30 minutes")


@query
def ss_event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sessions(table(spark, sf, "events"), "30 minutes")


from quillspark import queries_files, sql_files  # noqa: E402, F401  (the first registers its queries)

SQL = SQL | sql_files.SQL

__all__ = ["QUERIES", "SQL"]

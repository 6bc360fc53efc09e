"""Legal references in texts, relevance by citation, source-aware selection, cross references, sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.unicode_text import fold_accents
from quillspark.operators.chunking import article_spans
from quillspark.operators.packing import UNIT

# Words that carry no content in a question, that titles share, and kinds of legal documents (folded).
STOPWORDS = "ai bao bi cac can co cua duoc gi hay hien khi la lam mot nao nhung phai quy ra sau the thi theo trong tren truoc tu va ve voi".split()
TITLE_STOPWORDS = "cac cho cua duoc so theo trong va ve".split()
LEGAL_TYPES = ("bo luat", "luat", "nghi dinh", "thong tu", "quyet dinh", "nghi quyet", "phap lenh")
#: Characters around a reference in which a document number belongs to it, and after it in which a kind of document points elsewhere.
BEFORE, AFTER, CUE = 120, 180, 100

_REFERENCE = re.compile(r"(?:\bkhoản\s+(\d+[a-zđ]?)\s*,?\s*(?:của\s+)?(?=điều\b))?\bđiều\s+(\d+[a-zđ]?)\b", re.I)
_NUMBER = re.compile(C.DOCUMENT_NUMBER)
_KIND = re.compile(r"\b(?:" + "|".join(LEGAL_TYPES) + r")\b")
_THIS = re.compile(r"\b(?:van ban|" + "|".join(LEGAL_TYPES) + r")\s+nay\b")


def find_references(text: str, from_question: bool, document_id: str | None = None, start: int = 0) -> list[dict]:
    """References to articles with how each resolves: exact_document_number, same_document, ambiguous_document_numbers,
    unresolved_external_document or question_without_exact_document_number. Positions are in code points."""
    everywhere = list(dict.fromkeys(_NUMBER.findall(fold_accents(text))))
    out = []
    for m in _REFERENCE.finditer(text):
        near = list(dict.fromkeys(_NUMBER.findall(fold_accents(text[max(0, m.start() - BEFORE) : m.end() + AFTER]))))
        near = near or (everywhere if from_question else [])
        after = fold_accents(text[m.end() : m.end() + CUE])
        external = bool(_KIND.search(after)) and not _THIS.search(after)
        if len(near) > 1:
            how = "ambiguous_document_numbers"
        elif near:
            how = "exact_document_number"
        elif external:
            how = "unresolved_external_document"
        else:
            how = "same_document" if not from_question and document_id else "question_without_exact_document_number"
        out.append({"article_number": m[2].lower(), "clause_number": m[1].lower() if m[1] else None, "document_number": near[0] if len(near) == 1 else None, "resolution": how, "start": start + m.start(), "end": start + m.end(), "text": m[0]})
    return out


_REF = "article_number string, clause_number string, document_number string, resolution string, start int, end int, text string"


def extract_references(df: DataFrame, key: Column, text: Column, from_question: bool, document_id: Column | None = None, start: Column | None = None) -> DataFrame:
    """``id, document_id`` and one row per reference; null texts have none."""
    src = df.select(key.cast("string").alias("id"), (document_id if document_id is not None else F.lit(None)).cast("string").alias("document_id"), (start if start is not None else F.lit(0)).cast("int").alias("start"), text.alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in _REF.split(",")]
        for b in batches:
            keep, refs = [], []
            for i, (t, d, s) in enumerate(zip(b.column("text").to_pylist(), b.column("document_id").to_pylist(), b.column("start").to_pylist(), strict=True)):
                found = find_references(t, from_question, d, s or 0)
                keep += [i] * len(found)
                refs += found
            rows = pa.array(keep, pa.int64())
            cols = [pa.array([r[n] for r in refs], pa.int32() if n in ("start", "end") else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("document_id").take(rows), *cols], names=["id", "document_id", *names])

    return src.mapInArrow(run, f"id string, document_id string, {_REF}")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def citation_contexts(chunks: DataFrame, key: str = "id") -> DataFrame:
    """What :func:`citation_scores` needs of each chunk (``key, document_id, article_number, text``), folded once however many questions hit it."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = chunks.select(key, "document_id", C.fold_accents(F.concat_ws(" ", blank("document_id"), blank("article_number"), blank("text"))).alias("_c"), C.fold_accents(blank("article_number")).alias("_a"))
    return rows.select(key, "document_id", "_c", "_a", _found(F.col("_c"), C.ARTICLE_REFERENCE, 1).alias("_ctx_ar"), _found(F.col("_c"), C.CLAUSE_REFERENCE, 1).alias("_ctx_cl"), F.array_distinct(_found(F.col("_c"), "[a-z0-9]+", 0)).alias("_ctx_t"))


def citation_questions(questions: DataFrame) -> DataFrame:
    """What :func:`citation_scores` needs of each question (``query, question``)."""
    rows = questions.select("query", C.fold_accents(F.col("question")).alias("_q")).withColumn("_t", F.filter(_found(F.col("_q"), "[a-z0-9]+", 0), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))
    rest = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("_t", F.lit(1), rest), F.slice("_t", F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)))
    named = lambda pattern, group: F.array_distinct(_found(F.col("_q"), pattern, group))
    return rows.select("query", F.array_distinct("_t").alias("_t"), pairs.alias("_pairs"), named(C.DOCUMENT_NUMBER, 0).alias("_d"), named(C.ARTICLE_REFERENCE, 1).alias("_ar"), named(C.CLAUSE_REFERENCE, 1).alias("_cl"))


def citation_scores(hits: DataFrame, contexts: DataFrame, questions: DataFrame, weights: dict[str, float] | None = None, limit: int = 12) -> DataFrame:
    """Relevance of ``query, id, rank`` hits (rank from 0) by references and shared words, with :func:`citation_contexts` and :func:`citation_questions`.

    Gives ``query, id, rank, document_id``, hits of documents, articles, clauses, distinct words and word pairs,
    ``has_reference`` and ``score``. Hits without a context or question are left out.
    """
    w = {"document": 1000.0, "article": 500.0, "clause": 100.0, "token": 1.0, "bigram": 4.0, "rank": 1.5} | (weights or {})
    rows, c = hits.select("query", "id", "rank").join(contexts, "id").join(questions, "query"), F.col("_c")
    count = lambda items, test: F.size(F.filter(items, test))
    rows = rows.select(
        "query", "id", "rank", "document_id",
        count(F.col("_d"), lambda x: F.contains(c, x)).alias("document_hits"),
        count(F.col("_ar"), lambda x: F.array_contains("_ctx_ar", x) | (F.col("_a") == x)).alias("article_hits"),
        count(F.col("_cl"), lambda x: F.array_contains("_ctx_cl", x)).alias("clause_hits"),
        F.size(F.array_intersect("_t", "_ctx_t")).alias("token_hits"),
        count(F.col("_pairs"), lambda x: F.contains(c, x)).alias("bigram_hits"),
        (F.size("_d") + F.size("_ar") + F.size("_cl") > 0).alias("has_reference"),
    )
    score = sum((F.col(f"{k}_hits") * w[k] for k in ("document", "article", "clause", "token", "bigram")), F.lit(0.0)) + (limit - F.col("rank")) * w["rank"]
    return rows.withColumn("score", score.cast("double"))


def citation_order(scored: DataFrame, window: int = 6) -> DataFrame:
    """Rows of :func:`citation_scores` with ``position``: by score within the window (all of a query that names a reference), the rest as it was."""
    explicit = F.max("has_reference").over(Window.partitionBy("query"))
    inside = explicit | (F.col("rank") < window)
    rows = scored.withColumn("_in", inside).withColumn("_by", F.when(F.col("_in"), -F.col("score")))
    order = Window.partitionBy("query").orderBy(F.col("_in").desc(), F.col("_by").asc(), F.col("rank").asc())
    return rows.withColumn("position", F.row_number().over(order)).drop("_in", "_by")


def _line(text: Column) -> Column:
    """Folded a-z and 0-9 words on one line."""
    return F.array_join(_found(C.fold_accents(text), "[a-z0-9]+", 0), " ")


def title_key(question_line: Column, title_line: Column, least: int = 2, coverage: float = 0.5) -> Column:
    """``(phrase, overlap, overlap * 10000 // n, n)`` of a title whose words a question names, both as folded lines, or null if the cue is weak."""
    words = F.array_distinct(F.filter(F.split(title_line, " "), lambda x: (F.length(x) >= 2) & ~x.isin(TITLE_STOPWORDS)))
    shared = F.array_intersect(words, F.split(question_line, " "))
    kinds = sorted({w for k in LEGAL_TYPES for w in k.split()})
    n, m = F.size(words), F.size(shared)
    ok = (n > 0) & (m >= least) & (m >= coverage * n) & F.arrays_overlap(shared, F.array(*map(F.lit, kinds)))
    return F.when(ok, F.struct(F.contains(question_line, title_line).cast("int").alias("phrase"), m.alias("overlap"), F.floor(m * 10_000 / n).alias("share"), n.alias("n")))


def number_key(number: Column) -> Column:
    """A document number as compared: folded letters and digits only."""
    return F.regexp_replace(C.fold_accents(number), "[^a-z0-9]+", "")


def resolve_sources(pool: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``query, document_id, resolution``: the one document that a question points to among its candidates, if it is certain.

    ``pool`` has ``query, document_id``, ``questions`` ``query, question`` and ``documents`` ``document_id, document_number,
    source_title``; each text is folded once. First by number, then by the best title; two equal candidates are
    ambiguous and resolve to none.
    """
    folded = questions.select("query", C.fold_accents(F.col("question")).alias("f"))
    numbers = F.transform(_found(F.col("f"), C.DOCUMENT_NUMBER, 0), lambda x: F.regexp_replace(x, "[^a-z0-9]+", ""))
    asked = folded.select("query", numbers.alias("named"), F.array_join(_found(F.col("f"), "[a-z0-9]+", 0), " ").alias("q"))
    known = documents.select("document_id", number_key(F.col("document_number")).alias("number"), _line(F.coalesce("source_title", F.lit(""))).alias("t"))
    docs = pool.select("query", "document_id").distinct().join(known, "document_id").join(asked, "query")
    docs = docs.select("query", "document_id", F.coalesce(F.array_contains("named", F.col("number")), F.lit(False)).alias("by_number"), title_key(F.col("q"), F.col("t")).alias("key"))
    docs = docs.withColumn("is_best", F.coalesce(F.col("key") == F.max("key").over(Window.partitionBy("query")), F.lit(False)))
    only = lambda c: F.when(F.sum(c.cast("int")) == 1, F.max(F.when(c, F.col("document_id"))))
    n = lambda c: F.sum(c.cast("int"))
    out = docs.groupBy("query").agg(only(F.col("by_number")).alias("d1"), n(F.col("by_number")).alias("n1"), only(F.col("is_best")).alias("d2"), n(F.col("is_best")).alias("n2"))
    how = F.when(F.col("n1") == 1, "document_number").when(F.col("n1") > 1, "ambiguous_document_number").when(F.col("n2") == 1, "source_title").when(F.col("n2") > 1, "ambiguous_source_title").otherwise("no_high_precision_source_cue")
    return out.select("query", F.when(F.col("n1") == 1, F.col("d1")).when(F.col("n1") == 0, F.col("d2")).alias("document_id"), how.alias("resolution"))


def source_aware_selection(pool: DataFrame, resolved: DataFrame, out: int = 12, promotions: int = 2) -> DataFrame:
    """The first ``out`` of each query's pool, with up to ``promotions`` later hits of the resolved document in place of the last of other documents.

    ``pool`` has ``query, id, document_id, rank`` (rank from 1). Promoted hits stand behind the last kept hit of
    their document, or first if there is none. ``position`` from 1.
    """
    w = Window.partitionBy("query")
    rows = pool.join(resolved.select("query", F.col("document_id").alias("_want")), "query", "left")
    mine = F.coalesce(F.col("document_id") == F.col("_want"), F.lit(False))
    rows = rows.withColumn("_mine", mine).withColumn("_head", F.col("rank") <= out)
    tail_no = F.row_number().over(Window.partitionBy("query", "_mine", "_head").orderBy("rank"))
    rows = rows.withColumn("_tail", ~F.col("_head") & F.col("_mine") & (tail_no <= promotions))
    rows = rows.withColumn("_n", F.sum(F.col("_tail").cast("int")).over(w)).withColumn("_free", F.sum((F.col("_head") & ~F.col("_mine")).cast("int")).over(w))
    rows = rows.withColumn("_n", F.when(F.col("_free") >= F.col("_n"), F.col("_n")).otherwise(0))
    from_end = F.row_number().over(Window.partitionBy("query", "_mine", "_head").orderBy(F.col("rank").desc()))
    rows = rows.withColumn("_drop", F.col("_head") & ~F.col("_mine") & (from_end <= F.col("_n")))
    rows = rows.where((F.col("_head") & ~F.col("_drop")) | (F.col("_tail") & (F.col("_n") > 0)))
    anchor = F.max(F.when(F.col("_head") & F.col("_mine"), F.col("rank"))).over(w)
    place = F.when(F.col("_tail"), F.coalesce(anchor, F.lit(0)) + 0.5).otherwise(F.col("rank"))
    rows = rows.withColumn("_place", place)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("_place", "rank"))).select("query", "id", "document_id", "rank", "position", F.col("_tail").alias("promoted"))


def resolve_targets(refs: DataFrame, numbers: DataFrame, articles: DataFrame) -> DataFrame:
    """References with the article they point to: only if exactly one document has the number and one article of it the article number.

    ``numbers`` has ``document_id, document_number``; ``articles`` has ``document_id, number, start, end``.
    """
    one_doc = numbers.select(number_key(F.col("document_number")).alias("_k"), "document_id").where("_k <> ''").distinct().groupBy("_k").agg(F.count("*").alias("_n"), F.first("document_id").alias("_d")).where("_n = 1").select("_k", "_d")
    r = refs.withColumn("_k", number_key(F.col("document_number"))).join(one_doc, "_k", "left")
    r = r.withColumn("target_document", F.when(F.col("resolution") == "same_document", F.col("document_id")).when(F.col("resolution") == "exact_document_number", F.col("_d")))
    one_article = articles.groupBy(F.col("document_id").alias("target_document"), F.lower("number").alias("article_number")).agg(F.count("*").alias("_c"), F.first("start").alias("target_start"), F.first("end").alias("target_end")).where("_c = 1").drop("_c")
    return r.join(one_article, ["target_document", "article_number"], "left").drop("_k", "_d")


def triggered(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """References that count: those of questions, and those whose trigger lies inside a selected span of the same document (semi-join with containment)."""
    s = spans.select(F.col("document_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("query").alias("_q"))
    on = (F.col("document_id") == F.col("_d")) & (F.col("query") == F.col("_q")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    return refs.where("origin = 'question'").unionByName(refs.where("origin <> 'question'").join(s, on, "left_semi"))


# Words that say nothing of a section, and how a procedure's heading and a numbered line begin.
SECTION_STOPWORDS = "ai bao cac can chi cho co cua da de den dieu duoc gi khi la lam mot nao nay nguoi nhieu nhu nhung quy dinh sao sau se theo thi tren trong tu va ve voi phap luat hien tai thuc hien truong hop doi tuong thanh pho nam bao gom noi dung".split()
PROCEDURE = r"(?:PHẪU THUẬT|KỸ THUẬT|QUY TRÌNH|ĐIỀU TRỊ)\b"
NUMBERED_LINE = r"(?:[IVX]+|\d+)\s*[.)-]\s+"
_PROCEDURE, _NUMBERED_LINE = re.compile(PROCEDURE, re.I), re.compile(NUMBERED_LINE, re.I)
#: Lines that a procedure's heading may take besides its first, and characters of a whole heading.
HEADING_LINES, HEADING_CHARS = 3, 220


def _upper(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 12 and sum(map(str.isupper, letters)) >= 0.9 * len(letters)


def procedure_headings(text: str) -> list[tuple[int, str]]:
    """Starts and titles of procedures: an upper-case line that names one, with the upper-case lines that go on with it."""
    lines = [(m.start(), m[0].strip()) for m in re.finditer("[^\n]+", text)]
    opens = [bool(_PROCEDURE.match(x)) and _upper(x) for _, x in lines]
    goes_on = [_upper(x) and not _PROCEDURE.match(x) and not _NUMBERED_LINE.match(x) for _, x in lines]
    out = []
    for i in (i for i, o in enumerate(opens) if o):
        title = [lines[i][1], *(x for (_, x), _ in takewhile(lambda p: p[1], zip(lines[i + 1 : i + 1 + HEADING_LINES], goes_on[i + 1 :], strict=False)))]
        if len(" ".join(title)) <= HEADING_CHARS:
            out.append((lines[i][0], " ".join(title)))
    return out


def text_sections(text: str) -> list[dict]:
    """Articles, and procedures up to the next one or the end of their article."""
    articles, found = article_spans(text), procedure_headings(text)
    out = [{"kind": "article", "start": a["start"], "end": a["end"], "heading": a["heading"], "article_number": a["number"], "article_title": a["title"]} for a in articles]
    for (start, title), following in zip(found, [*(s for s, _ in found[1:]), len(text)], strict=False):
        end = min([following, *(a["end"] for a in articles if a["start"] <= start < a["end"])])
        out.append({"kind": "procedure", "start": start, "end": end, "heading": title, "article_number": None, "article_title": title})
    return out


def document_sections(documents: DataFrame, max_chars: int = 6000) -> DataFrame:
    """``document_id, source_title, kind, start, end, heading, article_number, article_title, text`` of sections that aren't longer than ``max_chars`` or blank; null texts have none."""
    names = ("kind", "start", "end", "heading", "article_number", "article_title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows, texts = [], [], []
            for i, text in enumerate(b.column("cleaned_text").to_pylist()):
                for s in text_sections(text):
                    part = text[s["start"] : s["end"]]
                    if len(part) <= max_chars and part.strip():
                        keep.append(i)
                        rows.append(s)
                        texts.append(part)
            at = pa.array(keep, pa.int64())
            cols = [pa.array([r[n] for r in rows], pa.int32() if n in ("start", "end") else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([b.column("document_id").take(at), b.column("source_title").take(at), *cols, pa.array(texts, pa.string())], names=["document_id", "source_title", *names, "text"])

    src = documents.where("cleaned_text is not null").select(F.col("document_id").cast("string").alias("document_id"), "source_title", "cleaned_text")
    return src.mapInArrow(run, "document_id string, source_title string, kind string, start int, end int, heading string, article_number string, article_title string, text string")


def section_terms(text: Column) -> Column:
    """Distinct folded a-z and 0-9 words that say something of a section; hyphens and underscores part words."""
    words = F.coalesce(F.regexp_extract_all(C.fold_accents(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(SECTION_STOPWORDS)))


def resolve_sections(spans: DataFrame, documents: DataFrame, least: float = 2.0, margin: float = 0.25, top: int = 2) -> DataFrame:
    """``query``, the section that its question points to among the documents of its ``spans``, and ``score``: if there is one that is certain.

    ``spans``: ``query, question, rank, document_id, start, end`` of the packed evidence, ranks from 0. A section that a
    span of rank ``top`` or better holds already is none. See :func:`best_sections`.
    """
    per = spans.groupBy("query", "document_id").agg(F.min("rank").alias("first_rank"), F.first("question").alias("question"))
    wanted = documents.join(per.select("document_id").distinct(), "document_id", "left_semi")
    sections = document_sections(wanted).withColumn("section", section_terms(F.col("heading"))).withColumn("source", section_terms(F.coalesce("source_title", F.lit(""))))
    asked = per.withColumn("terms", section_terms(F.col("question")))
    rows = asked.join(sections, "document_id").where(F.arrays_overlap("section", "terms")).withColumnRenamed("question", "asked").withColumnRenamed("terms", "question")
    best = best_sections(rows, least, margin)
    held = spans.where(F.col("rank") <= top).select(F.col("query").alias("_q"), F.col("document_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col("query") == F.col("_q")) & (F.col("document_id") == F.col("_d")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end"))
    return best.join(held, inside, "left_anti").select("query", "document_id", "source_title", "kind", "start", "end", "article_number", "article_title", "text", "score")


def replacement_units(units: DataFrame, sections: DataFrame) -> DataFrame:
    """``query, question, units`` with each query's resolved section, first of all, in place of its units of the same document."""
    s = sections.select(F.col("query").alias("_q"), F.struct("document_id", "start", "end", "article_number", "article_title", "source_title", "text").alias("_s"))
    j = units.join(s, F.col("query") == F.col("_q"), "left")
    c = lambda name: F.col("_s")[name]
    same, others = F.filter("units", lambda u: u["document_id"] == c("document_id")), F.filter("units", lambda u: u["document_id"] != c("document_id"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda u: u["chunk_ids"]))))
    number = F.element_at(F.transform(F.array_sort(F.transform(same, lambda u: F.struct(u["rank"].alias("r"), u["document_number"].alias("n")))), lambda x: x["n"]), 1)
    fields = {"rank": F.lit(-1), "document_id": c("document_id"), "block_id": F.concat(F.lit("section:"), c("document_id"), F.lit(":"), c("start").cast("string")), "article_number": c("article_number"), "article_title": c("article_title"), "source_title": c("source_title"), "document_number": number, "start": c("start"), "end": c("end"), "text": c("text"), "chunk_ids": ids, "expansions": F.lit(None)}
    first = F.array(F.struct(*(v.alias(k) for k, v in fields.items())).cast(UNIT))
    own = F.col("units").cast(f"array<{UNIT}>")
    return j.select("query", "question", F.when(F.col("_s").isNull() | (F.size(same) == 0), own).otherwise(F.concat(first, others.cast(f"array<{UNIT}>"))).alias("units"))


def best_sections(sections: DataFrame, least: float = 2.0, margin: float = 0.25) -> DataFrame:
    """Per query the one section whose score (``query, document_id, start, first_rank, section, question, source``: arrays of terms) is high enough and beats the second by a margin."""
    scored = sections.withColumn("score", C.section_score(F.col("section"), F.col("question"), F.col("source"))).where(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "first_rank", "document_id", "start")
    scored = scored.withColumn("_k", F.row_number().over(w)).withColumn("_second", F.lead("score").over(w))
    return scored.where((F.col("_k") == 1) & F.coalesce(F.col("score") - F.col("_second") >= margin, F.lit(True))).drop("_k", "_second")


def answer_evidence(rows: DataFrame) -> DataFrame:
    """How far retrieved text holds what an answer says: ``query, answer, context`` -> shares and reference hits.

    ``token_coverage`` is the share of the answer's distinct folded words in the context (null without words);
    ``any_reference`` and ``all_references`` tell whether articles that the answer names stand in it (null if it names none).
    For diagnosis after the fact only: it reads the answer.
    """
    none = F.array().cast("array<string>")
    words = lambda c: F.array_distinct(F.coalesce(F.regexp_extract_all(C.fold_accents(c), F.lit(C.TOKEN_PATTERN), F.lit(0)), none))
    refs = lambda c: F.array_distinct(F.coalesce(F.regexp_extract_all(C.fold_accents(c), F.lit(C.ARTICLE_REFERENCE), F.lit(1)), none))
    r = rows.withColumn("_a", words(F.col("answer"))).withColumn("_c", words(F.col("context"))).withColumn("_ra", refs(F.col("answer"))).withColumn("_rc", refs(F.col("context")))
    hit = F.size(F.array_intersect("_ra", "_rc"))
    named = F.size("_ra") > 0
    share = F.when(F.size("_a") > 0, F.size(F.array_intersect("_a", "_c")) / F.size("_a"))
    return r.select("query", share.alias("token_coverage"), F.when(named, hit > 0).alias("any_reference"), F.when(named, hit == F.size("_ra")).alias("all_references"))

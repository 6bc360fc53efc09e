import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, chunking, context, dense, fusion, packing, references


def hits(spark, rows):
    return spark.createDataFrame(rows, "query string, branch string, id string, rank int")


def test_rrf(spark):
    ids = [f"chunk_{i}" for i in range(40)]
    rows = [("q", "sparse", c, i + 1) for i, c in enumerate(ids)] + [("q", "dense", c, i + 1) for i, c in enumerate(reversed(ids))]
    random.Random(1).shuffle(rows)
    out = fusion.fuse(hits(spark, rows), {"sparse": 0.5, "dense": 0.5}, 60, 20).orderBy("rank").collect()
    want = sorted(((-round(0.5 / (61 + i) + 0.5 / (100 - i), 12), c) for i, c in enumerate(ids)))[:20]
    assert [(r.score, r.id) for r in out] == [(-s, c) for s, c in want]
    trace = fusion.fuse_with_trace(hits(spark, rows), {"sparse": 0.7, "dense": 0.3}).where("id = 'chunk_3'").first()
    assert trace.branch_ranks == {"sparse": 4, "dense": 37} and trace.branch_contributions["dense"] == pytest.approx(0.3 / 97)
    grid = fusion.weight_grid(hits(spark, rows), {"a": {"sparse": 1.0}, "b": {"dense": 1.0}}, 60, 1).collect()
    assert {(r.variant, r.id) for r in grid} == {("a", "chunk_0"), ("b", "chunk_39")}


def test_diverse_and_articles(spark):
    df = spark.createDataFrame([("q", i, f"c{i}", d, a) for i, (d, a) in enumerate([("d", "1"), ("d", "1"), ("d", None), ("e", "1"), ("d", None)], 1)], "query string, rank int, id string, document_id string, article_number string")
    assert [r.id for r in fusion.diverse_order(df, 4).orderBy("position").collect()] == ["c1", "c3", "c4", "c2"]
    rows = [("q", "s", f"c{i}", i, "d", "b1") for i in range(1, 6)] + [("q", "s", "x", 6, "e", "b2"), ("q", "t", "x", 1, "e", "b2")]
    out = fusion.aggregate_articles(spark.createDataFrame(rows, "query string, branch string, id string, rank int, document_id string, block_id string"), {"s": 0.5, "t": 0.5}).orderBy("rank").collect()
    assert [(r.block_id, r.n_chunks, r.representative) for r in out] == [("b1", 3, "c1"), ("b2", 1, "x")]
    a, b = spark.createDataFrame([("q", "x", 1), ("p", "y", 1)], "query string, id string, rank int"), spark.createDataFrame([("q", "x", 1), ("q", "z", 2)], "query string, id string, rank int")
    assert {(r.query, r.jaccard) for r in fusion.top_sets_jaccard(a, b, 5).collect()} == {("q", 0.5), ("p", 0.0)}


def test_dense_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(200, 8)), 1)
    v[50:60] = v[49]
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(None, [0.0] * 8), (999, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    vec = np.float32(v).astype(float)

    def brute(q, k):
        s = np.round(vec @ vec[q], 9)
        return [int(i) for i in sorted((i for i in range(200) if i != q), key=lambda i: (-s[i], i))[:k]]

    for size in (64_000_000, 100):
        monkeypatch.setattr(dense, "BLOCK_BYTES", size)
        out = dense.dense_search(df, F.col("id"), F.col("v"), df.where("id % 25 = 0"), F.col("id"), F.col("v"), 7, skip_self=True)
        got = {}
        for r in out.orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        assert got == {q: brute(q, 7) for q in range(0, 200, 25)}
    assert dense.dense_search(df, F.col("id"), F.col("v"), df.limit(0), F.col("id"), F.col("v"), 7).count() == 0


def test_merge_spans(spark):
    rows = [("d", "b", 0, 16, 1, ["c1"]), ("d", "b", 16, 33, 0, ["c2"]), ("d", "b", 40, 50, 2, ["c3"]), ("d", "b", 41, 42, 3, ["c3"]), ("d", "x", 10, 20, 5, ["c9"]), ("d", "b", 0, 16, 1, ["c1"])]
    df = spark.createDataFrame(rows, "document_id string, block_id string, start int, end int, rank int, chunk_ids array<string>")
    got = {(r.block_id, r.start, r.end, r.rank, tuple(r.chunk_ids)) for r in context.merge_spans(df, ["document_id", "block_id"]).collect()}
    assert got == {("b", 0, 33, 0, ("c1", "c2")), ("b", 40, 50, 2, ("c3",)), ("x", 10, 20, 5, ("c9",))}
    docs = spark.createDataFrame([("d", "x" * 33 + "y" * 30)], "document_id string, cleaned_text string")
    texts = {(r.start, r.text) for r in context.with_text(context.merge_spans(df, ["document_id", "block_id"]), docs).collect()}
    assert (40, "y" * 10) in texts
    units = [dict(document_id="d", block_id="b", start=s, end=e, rank=r, text=("x" * 33 + "y" * 30)[s:e], chunk_ids=c) for d, b, s, e, r, c in rows[:4]]
    assert [(m["start"], m["end"], m["text"]) for m in packing.united(units)] == [(0, 33, "x" * 33), (40, 50, "y" * 10)]


CHUNKS = "document_id string, chunk_id string, chunk_index int, article_number string, article_title string, start_char int, end_char int"


def test_blocks_and_expansions(spark):
    rows = [("d", "c0", 0, None, None, 0, 5), ("d", "c1", 1, "1", "t", 5, 10), ("d", "c2", 2, "1", "t", 10, 20), ("d", "c3", 3, "1", "t", 20, 30), ("d", "c4", 4, "1", "other", 30, 40), ("d", "c6", 6, "1", "other", 40, 50), ("d", "c7", 7, None, None, 50, 60), ("d", "c8", 8, None, None, 60, 70)]
    b = context.article_blocks(spark.createDataFrame(rows, CHUNKS))
    assert {r.chunk_id: r.block_id for r in b.collect()} == {"c0": "c0", "c1": "c1", "c2": "c1", "c3": "c1", "c4": "c4", "c6": "c6", "c7": "c7", "c8": "c8"}
    x = {}
    for r in context.expansions(b).orderBy("chunk_id", "position").collect():
        x.setdefault(r.chunk_id, []).append((r.kind, r.start, r.end))
    assert x["c1"] == [("whole_article", 5, 30), ("both_neighbors", 5, 20)] and x["c2"] == [("whole_article", 5, 30), ("previous_neighbor", 5, 20), ("next_neighbor", 10, 30)] and "c0" not in x and "c4" not in x
    assert {r.kind for r in context.expansions(b, 15).where("chunk_id = 'c2'").collect()} == {"previous_neighbor"}


def unit(rank, text, doc="d", start=0, expansions=()):
    return dict(rank=rank, document_id=doc, block_id=f"b{rank}", article_number="1", article_title=None, source_title="Luật", document_number=None, start=start, end=start + len(text), text=text, chunk_ids=[f"c{rank}"], expansions=list(expansions))


def test_packing_skips_and_expands():
    wide = dict(kind="whole_article", start=0, end=11, text="một hai ba bốn năm"[:11], chunk_ids=["c0", "cx"])
    units = [unit(0, "một", expansions=[dict(wide, text="w " * 100, end=200), wide]), unit(1, "x " * 500, "e"), unit(2, "hai", "f")]
    chosen, taken = packing.pack_units("hỏi?", units, packing.Budget(60, 50))
    assert [u["rank"] for u in chosen] == [0, 2] and taken == [{"rank": 0, "kind": "whole_article"}]
    assert packing.pack_whole("q", ["a " * 50, "b", "c " * 50, "d"], packing.Budget(30)) == [1, 3]
    out = packing.pack_or_prefix("q", ["từ " * 100], packing.Budget(30))
    assert len(out) == 1 and 0 < len(out[0]) < 300 and len(packing.prompt("q", out).split()) <= 30
    assert packing.pack_or_prefix("q", [], packing.Budget(30)) == []
    assert len(packing.render("q", chosen, merge=False)) >= len(packing.render("q", chosen))


def test_spans_that_disagree_are_an_error_and_seeds_are_refused():
    a, b = unit(0, "abcdef"), dict(unit(0, "xy"), start=4, end=6)
    with pytest.raises(ValueError, match="disagree"):
        packing.united([a, b])
    assert packing.united([a, dict(b, text="ef")])[0]["text"] == "abcdef"
    with pytest.raises(ValueError, match="budget"):
        packing.pack_units("q", [unit(0, "x " * 50)], packing.Budget(20), strict=True)


def test_two_spans_that_touch_are_one():
    first, second = "Điều 1. Nội dung", " tiếp theo của nó"
    units = [dict(unit(3, first), chunk_ids=["b"], block_id="x"), dict(unit(1, second, start=len(first)), chunk_ids=["a"], block_id="x"), dict(unit(2, "khác", start=60), block_id="x")]
    one, two = packing.united(units)
    assert (one["start"], one["end"], one["text"], one["rank"], one["chunk_ids"]) == (0, 33, first + second, 1, ["a", "b"]) and two["start"] == 60


@pytest.mark.parametrize("merge", [True, False])
def test_added_up_budgets_equal_rendered_ones(merge):
    rng = random.Random(8)
    for _ in range(60):
        texts = {d: " ".join(f"{d}{i}" for i in range(200)) for d in "ab"}
        units = []
        for rank in range(8):
            d, at, n = rng.choice("ab"), rng.randrange(0, 500), rng.randrange(20, 200)
            t = texts[d]
            spans = [dict(kind=k, start=max(0, at - m), end=at + n + m, text=t[max(0, at - m) : at + n + m], chunk_ids=[f"{k}{rank}"]) for k, m in (("whole", 90), ("near", 30))]
            spans = [dict(x, end=x["start"] + len(x["text"])) for x in spans]
            u = dict(unit(rank, t[at : at + n], d, at, spans), block_id="x")
            units.append(u)
        sizes = [packing.pack_units("hỏi gì đây", units, packing.Budget(120, 60, additive=x), merge=merge) for x in (True, False)]
        assert sizes[0] == sizes[1]
        meter = packing.Meter("hỏi gì đây", packing.Budget(), merge)
        text = packing.render("hỏi gì đây", sizes[0][0], merge)
        assert meter.measure(sizes[0][0]) == (len(text.split()), sum(len(s["text"]) for s in packing.united(sizes[0][0])))


def test_adding_segments_and_references(spark):
    text = " ".join(f"w{i}" for i in range(100))
    seed = dict(unit(0, text[:30]), block_id="b", expansions=[])
    part = lambda a, b, doc="d", block="b": {k: v for k, v in dict(unit(1, text[a:b], doc, a), block_id=block).items() if k != "expansions"}
    spans, added = packing.add_options("q", [seed], [[part(0, 20)], [part(20, 60), part(40, 50)], [part(100, 380)], [part(70, 90)]], packing.Budget(60), 2)
    assert added == [(1, 0), (3, 0)] and [(s["start"], s["end"]) for s in packing.united(spans)] == [(0, 60), (70, 90)]
    units = spark.createDataFrame([("q", "hỏi", [seed]), ("r", None, None)], f"query string, question string, units array<{packing.UNIT}>")
    ranked = spark.createDataFrame([("q", 2, part(70, 90)), ("q", 1, part(20, 60)), ("q", 3, part(62, 68))], f"query string, position int, segment {packing.SPAN}")
    out = {r.query: r for r in packing.pack_segments(units, ranked, packing.Budget(200), 2).collect()}
    assert out["q"].added == ["d:20-60", "d:70-90"] and out["q"].body_chars == 80 and (out["r"].added, out["r"].n_units) == ([], 0)
    triggers = [("q", 1, "d", 40, 45, [part(0, 10, "e")]), ("q", 2, "d", 5, 9, [part(0, 400, "f"), part(0, 12, "f")]), ("q", 3, None, None, None, [part(0, 9, "g")]), ("q", 4, None, None, None, [part(0, 9, "h")])]
    c = spark.createDataFrame(triggers, f"query string, position int, trigger_document string, trigger_start int, trigger_end int, options array<{packing.SPAN}>")
    out = {r.query: r for r in packing.pack_references(units, c, packing.Budget(200), 2, max_chars=100).collect()}
    assert out["q"].added == ["f:0-12", "g:0-9"] and out["r"].n_tokens == len(packing.prompt("", []).split())


def test_packing_whole_contexts_and_prefixes(spark):
    rows = [("a", "q", ["w " * 50, "x", None]), ("b", "q", ["w " * 50]), ("c", None, None), ("d", "q", [])]
    df = spark.createDataFrame(rows, "query string, question string, contexts array<string>")
    out = {r.query: r for r in packing.pack_contexts(df, packing.Budget(20), prefix=True).collect()}
    assert out["a"].kept == [1, 2] and out["a"].cut_chars is None and out["b"].kept == [] and out["b"].n_tokens <= 20 and out["b"].cut_chars > 20 and out["c"].kept == out["d"].kept == []
    assert packing.pack_contexts(df, packing.Budget(20)).where("query = 'b'").first().cut_chars is None


def test_packing_never_drops_seeds_within_budget():
    for n in range(1, 13):
        units = [unit(i, f"từ {i} " * 5, f"d{i}") for i in range(n)]
        chosen, _ = packing.pack_units("q", units, packing.Budget(8192))
        assert len(chosen) == n and len(packing.render("q", chosen).split()) <= 8192


def test_segments():
    text = "Đoạn một khá dài để giữ lại. " * 3 + "\n" + "x" * 30 + "\n" + "Đoạn hai. " * 30
    spans = context.split_segments(text, 1000, 40, 120)
    assert all(40 <= b - a <= 120 for a, b in spans) and all(text[a - 1000 : b - 1000] == text[a - 1000 : b - 1000].strip() for a, b in spans)


TEXT = "CHÍNH PHỦ\nSố: 1/2020/NĐ-CP\nĐiều 1. Phạm vi\n1. Khoản một dài.\n2. Khoản hai.\n\nĐiều 2a: Đối tượng\n" + "Nội dung rất dài. " * 60 + "\nĐiều 3\nKết thúc."


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([("d", "T", TEXT), ("blank", None, " \n "), ("null", None, None), ("plain", None, "không có điều nào " * 100)], "document_id string, source_title string, text string")
    bounds = chunking.Bounds(40, 300, 8, 50)
    rows = chunking.chunk_documents(docs, F.col("document_id"), F.col("source_title"), F.col("text"), bounds).collect()
    texts = {"d": TEXT, "plain": "không có điều nào " * 100}
    assert {r.document_id for r in rows} == set(texts)
    for doc, text in texts.items():
        own = [r for r in rows if r.document_id == doc]
        assert [r.chunk_index for r in sorted(own, key=lambda r: r.chunk_index)] == list(range(len(own)))
        seen = set()
        for r in own:
            assert text[r.start_char : r.end_char] == r.text and len(r.text) <= 300 and r.whitespace_token_count == len(r.text.split()) <= 40 and r.search_text.endswith(r.text)
            seen.update(range(r.start_char, r.end_char))
        assert all(i in seen or ch.isspace() for i, ch in enumerate(text))
    d = {r.chunk_index: r for r in rows if r.document_id == "d"}
    assert d[0].section_kind == "preamble" and d[1].article_number == "1" and d[1].clause_numbers == ["1", "2"] and d[1].search_text.startswith("T\nCHÍNH PHỦ")
    assert {r.article_title for r in rows if r.article_number == "3"} == {"Kết thúc."}
    with pytest.raises(ValueError):
        chunking.Bounds(10, 300, 8, 50)


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "a"), (3, " "), (4, None)], "id int, t string")
    out = {}
    for r in chunking.fixed_windows(df, F.col("id"), F.col("t"), 4, 1).orderBy("id", "window_no").collect():
        out.setdefault(r.id, []).append(r.text)
    assert out == {1: ["0 1 2 3", "3 4 5 6", "6 7 8 9"], 2: ["a"]}


def test_references():
    r = references.find_references("Theo khoản 2 Điều 5 Nghị định 12/2020/NĐ-CP và điều 7 của luật này.", True)
    assert [(x["clause_number"], x["article_number"], x["resolution"]) for x in r] == [("2", "5", "exact_document_number"), (None, "7", "exact_document_number")]
    assert references.find_references("xem Điều 9 Luật Đất đai", False, "d")[0]["resolution"] == "unresolved_external_document"
    assert references.find_references("xem Điều 9 ở trên", False, "d", 10)[0] | {"text": ""} == dict(article_number="9", clause_number=None, document_number=None, resolution="same_document", start=14, end=20, text="")
    assert references.find_references("1/2020/A và 2/2020/B: Điều 9", True)[0]["resolution"] == "ambiguous_document_numbers"


def test_citation_and_sources(spark):
    rows = [("q", "Điều 5 của 12/2020/nđ-cp về quyền thuê đất", i, f"d{i}", a, t) for i, (a, t) in enumerate([("1", "quyền thuê"), ("5", "nội dung"), ("2", "12/2020/NĐ-CP khác")])]
    rows = spark.createDataFrame(rows, "query string, question string, rank int, document_id string, article_number string, text string").withColumn("id", F.col("rank").cast("string"))
    scored = references.citation_scores(rows, references.citation_contexts(rows), references.citation_questions(rows.select("query", "question").distinct()))
    by = {r["rank"]: r for r in scored.collect()}
    assert by[2].document_hits == 1 and by[1].article_hits == 1 and by[0].token_hits == 2 and by[0].bigram_hits == 1 and by[0].has_reference
    assert [r["rank"] for r in references.citation_order(scored).orderBy("position").collect()] == [2, 1, 0]
    pool = [("q", "Luật Đất đai quy định gì", f"c{r}", r, d, None, {"a": "Luật Đất đai", "b": "Nghị định thuế", "z": None}[d]) for r, d in enumerate("bbabzzbbzzbbaaab", 1)]
    df = spark.createDataFrame(pool, "query string, question string, id string, rank int, document_id string, document_number string, source_title string")
    got = references.resolve_sources(df, df.select("query", "question").distinct(), df.select("document_id", "document_number", "source_title").distinct())
    assert [(r.document_id, r.resolution) for r in got.collect()] == [("a", "source_title")]
    out = [(r.id, r.promoted) for r in references.source_aware_selection(df, got).orderBy("position").collect()]
    assert len(out) == 12 and [i for i, p in out if p] == ["c13", "c14"] and out[2][0] == "c3" and out[3][0] == "c13" and {"c11", "c12"}.isdisjoint(i for i, _ in out)


def test_targets_triggers_sections(spark):
    refs = spark.createDataFrame([("q1", "d1", "5", None, "same_document", 3, 9, "selected"), ("q1", None, "5", "12/2020/NĐ-CP", "exact_document_number", 0, 4, "question"), ("q1", None, "6", "3/2020/X", "exact_document_number", 0, 4, "question")], "query string, document_id string, article_number string, document_number string, resolution string, start int, end int, origin string")
    numbers = spark.createDataFrame([("d2", "12/2020/nđ-cp"), ("d3", "3/2020/X"), ("d4", "3/2020/x")], "document_id string, document_number string")
    articles = spark.createDataFrame([("d1", "5", 0, 9), ("d2", "5", 1, 8), ("d1", "7", 0, 1), ("d1", "7", 2, 3)], "document_id string, number string, start int, end int")
    out = {(r.resolution, r.target_document, r.target_start) for r in references.resolve_targets(refs, numbers, articles).collect()}
    assert out == {("same_document", "d1", 0), ("exact_document_number", "d2", 1), ("exact_document_number", None, None)}
    spans = spark.createDataFrame([("q1", "d1", 0, 8)], "query string, document_id string, start int, end int")
    assert references.triggered(refs, spans).count() == 2
    s = spark.createDataFrame([("q", "d", 0, 1, ["a", "b", "c"], ["a", "b"], ["a"]), ("q", "d", 9, 2, ["a", "x", "y", "z"], ["a", "b"], [])], "query string, document_id string, start int, first_rank int, section array<string>, question array<string>, source array<string>")
    assert [r.start for r in references.best_sections(s).collect()] == [0]


def test_audit(spark):
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate([5, 1, 9, 3, 7, 3, 2, 8, 8, 1, 4])] + [(0, None)], "g int, v double")
    values = sorted([5, 1, 9, 3, 7, 3, 2, 8, 8, 1, 4])
    row = audit.percentiles(df, F.col("v"), [0.25, 0.5, 0.9]).first()
    assert (row.p25, row.p50, row.p90) == tuple(float(values[round(10 * p)]) for p in (0.25, 0.5, 0.9))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "k int, t string")
    assert [(r.copies, r.first_key, r.extra) for r in audit.exact_duplicates(docs, F.col("k"), F.col("t")).collect()] == [(2, 1, 1)]
    assert audit.forbidden_fields(spark.createDataFrame([], "a int, b array<struct<answer:string,c:map<string,struct<answer:int>>>>"), {"answer"}) == ["b.answer", "b.c.answer"]
    for check in (lambda: audit.require_unique(docs, "t"), lambda: audit.require_same_ids(docs, docs.limit(2), "k"), lambda: audit.require_expected(docs.agg(F.count("*").alias("n")), {"n": 4})):
        with pytest.raises(ValueError):
            check()
    audit.require_same_ids(docs, docs, "k")
    left, right = docs, spark.createDataFrame([("a",), ("z",)], "t string")
    r = audit.set_report(left.where("t is not null"), right, "t").first()
    assert (r.n_left, r.n_right, r.n_both, r.n_left_only, r.n_right_only) == (2, 2, 1, 1, 1)


def test_short_rests_join_the_segment_before():
    text = "a" * 200 + "\n4. Bãi bỏ."
    assert context.split_segments(text, 10) == [(10, 10 + len(text))]
    assert context.split_segments("Mục 1\n" + "b" * 50, 0) == [(0, 56)] and context.split_segments("", 0) == context.split_segments("ngắn", 0) == []
    assert context.split_segments("c" * 100 + "\n" + "d" * 30, 0, 40, 120) == [(0, 100)]


def test_selective_segments_of_copies_all_come_out(spark):
    text = "a" * 60 + "\n" + "b" * 60 + "\n" + "c" * 60
    seed = lambda doc, rank, start: (rank, doc, "b0", "1", None, None, None, start, start + 60, text[start : start + 60], [f"{doc}{start}"], [("whole_article", 0, len(text), text, ["x"])])
    rows = [("q", "?", [seed("d1", 0, 0), seed("d2", 1, 0), seed("d2", 2, 61)]), ("r", "?", [seed("d1", 3, 0), seed("d1", 3, 0)]), ("s", "?", None)]
    units = spark.createDataFrame(rows, f"query string, question string, units array<{packing.UNIT}>")
    got = sorted((r.query, r.segment.document_id, r.segment.rank, r.segment.start, r.segment.end, r.segment.text) for r in context.selective_segments(units).collect())
    b, c = (61, 121, "b" * 60), (122, 182, "c" * 60)
    assert got == [("q", "d1", 0, *b), ("q", "d1", 0, *c), ("q", "d2", 1, *c), ("r", "d1", 3, *b), ("r", "d1", 3, *c)]


def test_stale_chunks_are_located_for_units_segments_and_references(spark, tmp_path):
    from quillspark import queries

    parts = ["Một phần đầu đủ dài để thành một đoạn riêng.", "Phần hai dẫn chiếu điều 5 của luật này và dài.", "Phần ba đã đổi khác so với văn bản và dài.", "Phần bốn dẫn chiếu điều 6 của luật này và dài."]
    text = "\n".join(parts)
    at = [text.index(p) for p in parts]
    offsets = [(at[0], at[0] + len(parts[0])), (None, None), (7, 9), (at[3] - 5, at[3] - 5 + len(parts[3]))]
    rows = [(f"c{i}", "d", "1", "A", i, *offsets[i], p if i != 2 else "Không còn ở đâu, theo điều 7.") for i, p in enumerate(parts)]
    tables = {
        "documents": ([("d", "T", "1/2020", text)], "document_id string, source_title string, document_number string, cleaned_text string"),
        "legal_chunks": (rows, "chunk_id string, document_id string, article_number string, article_title string, chunk_index int, start_char int, end_char int, text string"),
        "training_records": ([("q", "Hỏi gì?")], "question_id string, question string"),
        "retrieval_results": ([("q", [(f"c{i}", 1.0, {"sparse": i + 1}) for i in range(4)])], "question_id string, fused array<struct<chunk_id string, rrf_score double, branch_ranks map<string,int>>>"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    units = queries._units(spark, str(tmp_path)).collect()[0].units
    assert {(u.chunk_ids[0], u.start, u.text, u.block_id) for u in units} == {(f"c{i}", at[i], parts[i], "c0") for i in (0, 1, 3)}
    assert all(any(x.start == 0 and x.end == len(text) for x in u.expansions) for u in units)
    assert sum(r.n for r in queries.rt19_cross_references(spark, str(tmp_path)).collect()) == 3
    segments = queries.rt17_selective_segments(spark, str(tmp_path)).collect()
    assert {(r.start, r.end) for r in segments} == {(a, a + len(p)) for k, (a, p) in enumerate(zip(at, parts)) if k == 2}  # the others are seeds


PROCEDURES = "Điều 1. Phạm vi\nNội dung.\nKỸ THUẬT TIÊM KHỚP GỐI DƯỚI SIÊU ÂM\nCỦA BỆNH VIỆN TRUNG ƯƠNG\n1. CHỈ ĐỊNH VÀ CHỐNG CHỈ ĐỊNH\nViêm khớp.\nQUY TRÌNH CHĂM SÓC NGƯỜI BỆNH\nTheo dõi.\nĐiều 2. Hiệu lực\nCó hiệu lực."


def test_sections_of_a_text():
    found = references.text_sections(PROCEDURES)
    assert [(s["kind"], s["heading"]) for s in found] == [("article", "Điều 1. Phạm vi"), ("article", "Điều 2. Hiệu lực"), ("procedure", "KỸ THUẬT TIÊM KHỚP GỐI DƯỚI SIÊU ÂM CỦA BỆNH VIỆN TRUNG ƯƠNG"), ("procedure", "QUY TRÌNH CHĂM SÓC NGƯỜI BỆNH")]
    assert PROCEDURES[found[2]["start"] : found[2]["end"]].endswith("Viêm khớp.\n") and found[3]["end"] == found[0]["end"]
    assert references.procedure_headings("Quy trình thường\nQUY TRÌNH " + "DÀI " * 60) == [] and references.text_sections("") == []


def test_resolved_section_takes_the_place_of_its_document(spark):
    docs = spark.createDataFrame([("d", "Bệnh viện", PROCEDURES), ("e", None, None), ("f", "Luật", "Điều 1. Khác hẳn\nX")], "document_id string, source_title string, cleaned_text string")
    span = lambda q, text, rank, doc, s, e: (q, text, rank, doc, s, e)
    asked = "Quy trình chăm sóc người bệnh gồm gì?"
    spans = [span("q", asked, 0, "f", 0, 5), span("q", asked, 1, "d", 0, 20), span("r", asked, 0, "d", 0, len(PROCEDURES)), span("s", "Không liên quan", 0, "d", 0, 5), span("t", None, 0, "e", 0, 1)]
    df = spark.createDataFrame(spans, "query string, question string, rank int, document_id string, start int, end int")
    out = references.resolve_sections(df, docs)
    (row,) = out.collect()
    assert (row["query"], row.document_id, row.kind, row.text[:30]) == ("q", "d", "procedure", "QUY TRÌNH CHĂM SÓC NGƯỜI BỆNH\n"[:30])
    seeds = [{k: v for k, v in dict(unit(i, t, doc), expansions=[]).items()} for i, (t, doc) in enumerate([("khác", "f"), ("một", "d"), ("hai", "d")])]
    units = spark.createDataFrame([("q", asked, seeds), ("r", asked, seeds)], f"query string, question string, units array<{packing.UNIT}>")
    got = {r["query"]: [(u.rank, u.document_id, u.chunk_ids) for u in r.units] for r in references.replacement_units(units, out).collect()}
    assert got["q"] == [(-1, "d", ["c1", "c2"]), (0, "f", ["c0"])] and [u[1] for u in got["r"]] == ["f", "d", "d"]
    assert packing.pack(references.replacement_units(units, out), packing.Budget(200)).count() == 2

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, evaluate, packing, splits, training
from quillspark.plans import pipelines
from quillspark.sources import readers, writers
from quillspark.streaming import events as ev


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, payload in members:
            z.writestr(name, payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False))


def good(i, **more):
    return f"a/context_{i}.json", {"id": i, "link": "https://x.vn/a", "passage": f"Điều {i}. Nội dung"} | more


def test_passage_archives(spark, tmp_path):
    archive(tmp_path / "one.zip", [good(2), good(1, name=" Tên ")])
    rows = {r.document_id: r for r in readers.read_passage_archives(spark, str(tmp_path)).collect()}
    assert rows["1"].source_title == "Tên" and rows["2"].source_title is None and rows["1"].raw_text == "Điều 1. Nội dung"
    bad = [("context_3.json", '{"id": 3, "id": 3, "link": "https://x", "passage": ""}'), ("../context_4.json", "{}"), ("notes.txt", "x"), ("context_5.json", {"id": 6, "link": "https://x", "passage": ""}), ("context_7.json", {"id": 7, "link": "http://x", "passage": ""}), ("context_8.json", {"id": True, "link": "https://x", "passage": ""}), ("context_9.json", {"id": 9, "link": "https://x", "passage": "", "z": 1})]
    archive(tmp_path / "two.zip", [*bad, good(10)])
    q = readers.read_passage_archives(spark, str(tmp_path), quarantine=True)
    assert q.where("error is not null").count() == len(bad) and q.where("error is null").count() == 3
    with pytest.raises(ValueError):
        readers.read_passage_archives(spark, str(tmp_path))


def test_identity_is_free_of_order(spark):
    rows = [("a", "1"), ("b", "2"), ("c", "3")]
    ids = {readers.content_identity(spark.createDataFrame(r, "n string, d string").repartition(p), "n", "d").first() for r, p in ((rows, 1), (rows[::-1], 3))}
    assert len(ids) == 1 and readers.content_identity(spark.createDataFrame(rows[:2], "n string, d string"), "n", "d").first() not in ids


def test_json_lines_keep_other_separators(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question_id": "1", "answer": "a\x85b\u2028c"}\r\n{"question_id": "2", "answer": "d"}\n', encoding="utf-8")
    out = readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "question_id string, answer string").collect()
    assert {r.question_id: r.answer for r in out} == {"1": "a\x85b\u2028c", "2": "d"}
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "b.jsonl"), "question_id string").collect()


def test_questions_registry_vectors_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"1": {"question": "A?", "answer": None}, "2": {"question": "B?", "answer": "b"}}))
    assert readers.read_questions(spark, str(tmp_path / "q.json")).count() == 2
    for need in (True, False):
        with pytest.raises(ValueError):
            readers.read_questions(spark, str(tmp_path / "q.json"), need)
    (tmp_path / "r.csv").write_text("\ufeffName,URL\nx,https://a/b/\ny,https://a/b\nz,\n", encoding="utf-8")
    assert [r.url for r in readers.read_registry(spark, str(tmp_path / "r.csv"), "url").collect()] == ["https://a/b"]
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"))
    files = readers.file_hashes(spark, str(tmp_path), "*.csv")
    sha = files.first().sha256
    found = readers.resolve_artifacts(files, spark.createDataFrame([("reg", sha)], "name string, sha256 string")).first()
    assert found.path.endswith("r.csv")
    with pytest.raises(ValueError):
        readers.resolve_artifacts(files, spark.createDataFrame([("reg", "0")], "name string, sha256 string"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    want = spark.createDataFrame([("b", 1), ("a", 2)], "chunk_id string, rank int")
    assert [r.v for r in readers.fetch_ordered(df, want).orderBy("rank").collect()] == [2, 1] and readers.select_wanted(df, "chunk_id", want).count() == 2
    with pytest.raises(ValueError):
        readers.fetch_ordered(df.limit(1), want)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("2", "hai"), ("1", "một")], "question_id string, answer string")
    paths = [str(tmp_path / f"{i}.zip") for i in range(2)]
    for p, df in zip(paths, (rows, rows.repartition(3)), strict=True):
        writers.write_submission(df, rows, p)
    assert len({open(p, "rb").read() for p in paths}) == 1
    assert list(json.loads(zipfile.ZipFile(io.BytesIO(open(paths[0], "rb").read())).read("submission.json"))) == ["1", "2"]
    assert {tuple(r) for r in readers_of(spark, paths[0])} == {("1", "một"), ("2", "hai")}
    for bad in (rows.limit(1), rows.union(rows), rows.withColumn("answer", F.lit(" "))):
        with pytest.raises(ValueError):
            writers.write_submission(bad, rows, str(tmp_path / "bad.zip"))
    for n in (1, 2):
        writers.publish(rows.limit(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    m = writers.write_splits(rows.withColumn("split", F.lit("dev")), str(tmp_path / "s")).first()
    assert m.n == 2 and spark.read.parquet(str(tmp_path / "s/data/split=dev")).count() == 2
    writers.write_json_lines(rows, str(tmp_path / "j"))
    assert readers.read_json_lines(spark, str(tmp_path / "j"), "question_id string, answer string").count() == 2


def readers_of(spark, path):
    return writers.read_submission(spark, path).collect()


def test_splits(spark):
    rows = [(1, "Hỏi A?", "x", "train"), (2, "hỏi  a?", None, "public"), (3, "Hỏi B?", "x", "train"), (4, "hỏi b?", "y", "train"), (5, "Hỏi C?", "z", "train"), (6, None, "z", "train"), (7, "hỏi c?", "z", None)]
    df = spark.createDataFrame(rows, "id int, q string, a string, split string")
    role = {r.id: r.role for r in splits.leakage_safe_splits(df, "id", F.col("q"), F.col("a"), F.col("split") == "public", "s", 10, 5).collect()}
    assert role[1] == "quarantined" and role[2] == "protected" and role[3] == role[4] == "conflicting" and role[5] == role[7] in ("train", "holdout") and role[6] == "invalid"
    ids = spark.createDataFrame([(f"{i:03}",) for i in range(50)] * 2 + [(None,)], "k string").repartition(5)
    assert [(r.k, r.position, r.shard) for r in splits.shard_assignment(ids, "k", 4).orderBy("k").collect()] == [(f"{i:03}", i, i % 4) for i in range(50)]
    sample = splits.hash_sample(ids.where("k is not null").distinct(), "k", "s", 7).orderBy("position").collect()
    assert len(sample) == 7 and [r.k for r in sample] == [r.k for r in splits.hash_sample(ids.where("k is not null").distinct().repartition(9), "k", "s", 7).orderBy("position").collect()]
    groups = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate([3, 4, 1, 5, 2, 9, 1])], "group string, n_rows long")
    import hashlib

    left, want = 10, set()
    for g, n in sorted(((f"g{i}", n) for i, n in enumerate([3, 4, 1, 5, 2, 9, 1])), key=lambda x: hashlib.sha256(f"s{x[0]}".encode()).hexdigest()):
        if n <= left:
            want.add(g)
            left -= n
    assert {r.group for r in splits.group_holdout(groups, "s", 10).collect()} == want
    assert sum(r.n_rows for r in splits.group_holdout(groups, "s", 100).collect()) == 25
    a = splits.warmup_alias(spark.createDataFrame([(1, "Hỏi?", "x"), (2, "Gì?", "y")], "i int, q string, a string"), spark.createDataFrame([(9, "hỏi?", "x"), (8, "gì?", "z")], "i int, q string, a string"), "q", "a", "i")
    assert {(r.warmup_id, r.train_id, r.agrees) for r in a.collect()} == {(1, 9, True), (2, 8, False)}
    ordered = spark.createDataFrame([("10",), ("9",), ("b",), ("a2",)], "k string").orderBy(*splits.numeric_aware_order("k")).collect()
    assert [r.k for r in ordered] == ["9", "10", "a2", "b"]
    assert splits.merge_shards(groups.select("group"), groups.select("group"), "group").count() == 7
    with pytest.raises(ValueError):
        splits.merge_shards(groups.select("group").limit(3), groups.select("group"), "group")
    assert audit.leaking_groups(df.withColumn("g", F.lower("q")), "g", "split").count() == 0


def test_evaluation(spark):
    refs = spark.createDataFrame([("1", "một hai"), ("2", "ba")], "question_id string, answer string")
    pred = spark.createDataFrame([("2", "ba"), ("1", None)], "question_id string, answer string")
    out = {r.question_id: r for r in evaluate.score_predictions(refs, pred).collect()}
    assert out["1"].rouge_l == 0 and out["2"].rouge_l == 1.0 and out["2"].meteor_exact == pytest.approx(0.5)
    with pytest.raises(ValueError):
        evaluate.score_predictions(refs, pred.limit(1))
    a = spark.createDataFrame([(i, i / 10) for i in range(40)], "k int, m double")
    b = spark.createDataFrame([(i, i / 10 + (0.1 if i % 4 == 0 else -0.1 if i % 4 == 1 else 0)) for i in range(40)], "k int, m double")
    d = evaluate.paired_deltas(b, a, "k", "m")
    s = evaluate.delta_summary(d, 1e-6)
    assert (s.first().improved, s.first().worsened, s.first().tied) == (10, 10, 20)
    one, two = (evaluate.bootstrap(x, "k", resamples=500).first() for x in (d, d.repartition(7)))
    assert one == two and one.low < 0 < one.high and evaluate.bootstrap_seeded([0.0, 1.0] * 20, "s", 200) == evaluate.bootstrap_seeded([0.0, 1.0] * 20, "s", 200)
    p = evaluate.poisson_bootstrap(d, "k", 100).first()
    assert p == evaluate.poisson_bootstrap(d.repartition(1), "k", 100).first() and p.low < 0 < p.high
    gate = evaluate.acceptance(s, {"a": F.col("mean_delta") > -1, "b": F.col("mean_delta") > 5}).first()
    assert gate.a and not gate.b and not gate.accepted
    assert evaluate.best_variant(spark.createDataFrame([("x", 1, 2), ("y", 1, 3)], "v string, a int, b int"), "v", "a", "b").first().best == "y"
    o = evaluate.order_changes(spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["b", "a"])], "before array<string>, after array<string>")).first()
    assert (o.n_changed, o.n_top_changed, o.rate_changed) == (1, 1, 0.5)


def test_training_records(spark):
    def unit(rank, text):
        return dict(rank=rank, document_id=f"d{rank}", block_id="b", article_number=None, article_title=None, source_title=None, document_number=None, start=0, end=len(text), text=text, chunk_ids=["c"], expansions=None)

    units = [("1", "hỏi gì", [unit(0, "nội dung một"), unit(1, "từ " * 40)]), ("2", "hỏi", [unit(0, "x")]), ("3", "hỏi", [unit(0, "x")])]
    df = spark.createDataFrame(units, f"query string, question string, units array<{packing.UNIT}>")
    gold = spark.createDataFrame([("1", "đáp án"), ("2", "khác"), ("3", " ")], "query string, answer string")
    encode = lambda t: [len(w) for w in t.split()]
    rec = training.training_records(df, gold, packing.Budget(100, 50), encode, 0)
    g = training.gates(rec, 100, expected=2).first()
    assert g.passed, g
    row = rec.where("query = '1'").first()
    assert row.labels[: len(row.prompt_ids)] == [-100] * len(row.prompt_ids) and row.labels[len(row.prompt_ids) :] == [3, 2, 0] or row.labels[-1] == 0
    encoded = spark.createDataFrame([("1", [3, 2, 0]), ("2", [4, 0])], "query string, answer_ids array<int>")
    stored, seeds = training.identities(rec), rec.select("query", "seed_ids")
    same = dict(stored=stored, answers=encoded.where("query in ('1', '2')"), seeds=seeds, provenance=df.limit(0), mutated=rec, contract=({"a": 1}, {"a": 1}))
    good = training.gates(rec, 100, **same).first()
    assert not good.answer_complete or good.passed
    wrong = dict(stored={"ids_sha256": "x", "records_sha256": "y"}, answers=encoded.where("query = '1'"), seeds=seeds.withColumn("seed_ids", F.array(F.lit("z"))), provenance=df, mutated=rec.withColumn("prompt_sha256", F.lit("other")), contract=({"a": 1}, {"a": 2}))
    failed = training.gates(rec.withColumn("gold_evidence", F.lit(1)), 100, **wrong).first()
    assert not any((failed.ordered_ids, failed.records_as_stored, failed.answer_complete, failed.seeds_as_retrieved, failed.exact_provenance, failed.answer_blind, failed.settings_agree, failed.no_reference_fields, failed.passed))
    changed = training.training_records(df, gold.withColumn("answer", F.concat("answer", F.lit(" khác hẳn"))), packing.Budget(100, 50), encode, 0)
    assert changed.where("query = '2'").first().prompt == rec.where("query = '2'").first().prompt
    padded = training.pad_batch(rec, 90, 7).first()
    assert len(padded.input_ids) == len(padded.labels) == len(padded.attention_mask) == 90 and padded.labels[-1] == -100
    assert not training.gates(rec.withColumn("labels", F.col("input_ids")), 100).first().passed
    dropped = training.gates(rec.withColumn("n_kept", F.col("n_chosen") - 1), 100).first()
    assert not dropped.seeds_kept and not dropped.passed
    tight = training.training_records(df, gold.withColumn("answer", F.lit("dài " * 60)), packing.Budget(100, 50), encode, 0)
    assert not training.gates(tight, 200).first().seeds_kept
    budget = training.parameter_budget(spark.createDataFrame([("a", 5.0), ("b", 7.0)], "model_key string, parameters double"), spark.createDataFrame([("s", ["a", "b"]), ("t", ["a", "z"])], "stack string, model_keys array<string>"), 12.0)
    assert {(r.stack, r.valid) for r in budget.collect()} == {("s", True), ("t", False)}


RAW = [(str(i), f"Luật số {i}", "https://x", f"CHÍNH PHỦ\nSố: {i}/2020/NĐ-CP\nĐiều 1. Thuê đất\nNgười thuê đất loại {w} phải nộp tiền.\nĐiều 2. Hiệu lực\nCó hiệu lực từ năm 20{i}0.") for i, w in ((1, "vàng"), (2, "bạc"), (3, "đồng"))]


def test_corpus_to_prompt(spark):
    raw = spark.createDataFrame(RAW, "document_id string, source_title string, source_url string, raw_text string")
    docs, chunks, index = pipelines.build_corpus(raw)
    assert audit.provenance_violations(chunks, docs).count() == 0 and {r.document_number for r in docs.collect()} == {f"{i}/2020/NĐ-CP" for i in (1, 2, 3)}
    q = spark.createDataFrame([("a", "thuê đất loại bạc")], "query string, question string")
    hits = pipelines.hybrid_retrieve(index, q, selected=2)
    best = hits.where("rank = 1").join(chunks, F.col("id") == F.col("chunk_id")).first()
    assert best.document_id == "2" and best.article_number == "1"
    out = pipelines.prepare_prompts(hits, chunks, docs).first()
    assert "Số văn bản: 2/2020/NĐ-CP" in out.prompt and out.n_units == 2 and out.prompt.endswith("Câu hỏi: thuê đất loại bạc")
    ranked = pipelines.rerank(hits.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id"), lambda q, t: -t.str.len().astype(float), 1)
    assert ranked.count() == 1


def test_resumable_generation(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)], "query string, prompt string")

    def model(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(answer="đáp " + b["prompt"], finish_reason="eos")

    assert pipelines.run_resumable(prompts, model, str(tmp_path), "v1", batch_rows=2).count() == 2
    assert pipelines.run_resumable(prompts, model, str(tmp_path), "v1").count() == 5
    assert pipelines.run_resumable(prompts, model, str(tmp_path), "v1").count() == 5
    assert pipelines.run_resumable(prompts, model, str(tmp_path), "v2", batch_rows=1).count() == 1
    first = spark.createDataFrame([("1", "A. A. A."), ("2", "b")], "query string, answer string")
    final = {r["query"]: r.answer for r in pipelines.finalize_answers(first, spark.createDataFrame([("2", "c.")], "query string, answer string")).collect()}
    assert final == {"1": "A.", "2": "c."}
    rec = prompts.limit(2).withColumn("finish_reason", F.lit("length")).withColumn("prompt_sha256", F.sha2("prompt", 256))
    assert pipelines.retry(rec, prompts).count() == 2 and pipelines.route(prompts.withColumn("n", F.length("prompt")), "n", 1).where("route = 'long'").count() == 5


def test_streams_equal_tables(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(60), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta([i * 7 for i in range(60)], unit="min"), "user_id": [i % 3 for i in range(60)], "event_type": ["a", "b"] * 30, "value": [1.5] * 60, "props": ["{}"] * 60})
    df = spark.createDataFrame(rows).select("event_id", "ts", F.col("user_id").cast("long"), "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("w", ev.window_counts), ("s", lambda e: ev.sessions(e, "15 minutes"))):
        out = f(ev.read_event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        out.awaitTermination(120)
        got, want = {tuple(r) for r in spark.table(name).collect()}, {tuple(r) for r in f(df).collect()}
        assert got == want if name == "w" else got <= want and got
    for _ in range(2):
        ev.start_upsert(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"cp{_}"), "event_id").awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_cut_lineage_and_release(spark):
    from quillspark.session import cut_lineage, shared_folder

    df = cut_lineage(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and shared_folder(spark) in df.inputFiles()[0].replace("file://", "")


def test_runs_with_a_deadline_states_and_variants(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "query long, prompt string")
    model = lambda b: b.assign(answer=b["prompt"], finish_reason="eos")
    records, complete = pipelines.run_until(prompts, model, str(tmp_path / "r"), "i", 2, 0)
    assert records.count() == 2 and not complete
    records, complete = pipelines.run_until(prompts, model, str(tmp_path / "r"), "i", 2, 600)
    assert records.count() == 5 and complete
    plan = spark.createDataFrame([(i, i, f"w{i // 2}") for i in range(6)], "query long, position long, worker string")
    done = spark.createDataFrame([(0, "eos"), (1, "oom"), (2, "eos"), (3, "eos"), (5, "eos")], "query long, finish_reason string")
    assert sorted(r["query"] for r in pipelines.contiguous_prefix(plan, done).collect()) == [0, 1, 2, 3]
    assert {(r.worker, r.completed, r.status, r.rerouted) for r in pipelines.worker_status(plan, done).collect()} == {("w0", 1, "oom", 1), ("w1", 2, "complete", 0), ("w2", 1, "running", 0)}
    out = pipelines.derive_variants(spark.createDataFrame([(1, " a"), (2, None)], "query long, answer string"), {"x": F.col("answer"), "y": F.trim("answer")})
    assert {(r.variant, r["query"], r.answer, r.changed) for r in out.collect()} == {("x", 1, " a", False), ("y", 1, "a", True), ("x", 2, None, False), ("y", 2, None, False)}


def test_bundles_are_safe(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", b"x"), ("c.txt", b"")], "name string, content binary")
    path = str(tmp_path / "b.zip")
    writers.write_bundle(files, path)
    assert {(r.name, bytes(r.content)) for r in readers.read_bundle(spark, path).collect()} == {("a/b.txt", b"x"), ("c.txt", b"")}
    for bad in ({"../x": b"1"}, {"extra": b"1"}):
        broken = str(tmp_path / f"{len(str(bad))}.zip")
        with zipfile.ZipFile(path) as old, zipfile.ZipFile(broken, "w") as new:
            for i in old.infolist():
                new.writestr(i.filename, old.read(i))
            for n, c in bad.items():
                new.writestr(n, c)
        with pytest.raises(Exception, match="bundle"):
            readers.read_bundle(spark, broken).collect()


def test_paired_gate_and_rankings(spark):
    rows = lambda m, s, f: spark.createDataFrame([(i, m + i % 3 * 0.001, s, f and i < 9) for i in range(30)], "k long, m double, s double, f boolean")
    good = evaluate.paired_gate(rows(0.5, 0.4, False), rows(0.4, 0.4, True), "k", "m", "s", "f", resamples=200).first()
    assert good.accepted and good.n == 30 and good.low > 0
    assert not evaluate.paired_gate(rows(0.5, 0.3, False), rows(0.4, 0.4, True), "k", "m", "s", "f", resamples=200).first().accepted
    assert not evaluate.paired_gate(rows(0.5, 0.4, True), rows(0.4, 0.4, True), "k", "m", "s", "f", resamples=200).first().rate_ok
    r = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 1), ("b", 1, "z", 1)], "system string, query long, id string, rank int")
    rel = spark.createDataFrame([(1, "x"), (1, "w"), (2, "q")], "query long, id string")
    assert {(x.system, x.n_queries, x.hit_rate, x.recall, x.reciprocal_rank) for x in evaluate.compare_rankings(r, rel).collect()} == {("a", 2, 0.5, 0.25, 0.25), ("b", 2, 0.0, 0.0, 0.0)}
    one = evaluate.bootstrap_by_rank(spark.createDataFrame([(str(i), float(i)) for i in range(9)], "k string, delta double"), "k", "s", 100).first()
    assert one.n == 9 and one.low <= one.mean_delta <= one.high


def test_dense_search_over_string_ids(spark):
    from quillspark.operators import dense

    v = spark.createDataFrame([("ctx-1::00000::ab", [1.0, 0.0]), ("ctx-2", [0.0, 1.0]), ("ctx-3", [1.0, 0.0])], "id string, v array<double>")
    out = dense.dense_search(v, F.col("id"), F.col("v"), v, F.col("id"), F.col("v"), 2, skip_self=True)
    got = {(r["query"], r.id, r.score, r["rank"]) for r in out.collect()}
    assert ("ctx-1::00000::ab", "ctx-3", 1.0, 1) in got and ("ctx-2", "ctx-1::00000::ab", 0.0, 1) in got and len(got) == 6
    mixed = v.unionByName(spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("y", [4.0])], "id string, v array<double>"))
    with pytest.raises(Exception, match="length"):
        dense.dense_search(mixed, F.col("id"), F.col("v"), v, F.col("id"), F.col("v"), 2).collect()


def test_only_small_scans_are_spread(spark, tmp_path, monkeypatch):
    from quillspark import session

    spark.range(100).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(session.spread_by(t, "id")) and "Repartition" in plan(session.spread(t.coalesce(1)))
    monkeypatch.setattr(session, "SPREAD_BYTES", 1)
    assert "Repartition" not in plan(session.spread_by(t, "id")) and session.spread(t) is t


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from quillspark import session

    fake = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named, set=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert session.shared_folder(fake("spark://host:7077", "hdfs:///x/")) == "hdfs:///x/quillspark-a"
    assert "quillspark-" in session.shared_folder(fake("local[4]", None)) and "quillspark-" in session.shared_folder(fake("local", None))
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master, None))

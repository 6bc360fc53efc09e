"""Sinks: JSON lines, tables with a manifest, split folders, and the keyed submission object."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.audit import require_empty, require_same_ids, require_unique
from quillspark.sources.readers import MANIFEST


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the folder appear whole or not at all. Nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write beside the target, then swap by renames; the old table comes back if the last rename fails."""
    spark = df.sparkSession
    jvm = spark._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new", path + ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path + ".new")
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't publish {path}")
    fs.delete(old, True)


def write_splits(df: DataFrame, path: str, split: str = "split", key: str = "question_id") -> DataFrame:
    """One folder per split and a manifest row each: ``split, n, ids_sha256`` (an order-free hash)."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    manifest = df.groupBy(split).agg(F.count("*").alias("n"), F.sha2(F.sum(F.xxhash64(F.col(key).cast("string")).cast("decimal(38,0)")).cast("string"), 256).alias("ids_sha256"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def check_submission(predictions: DataFrame, expected: DataFrame, key: str = "question_id") -> None:
    """Exactly one non-blank answer per expected id."""
    require_unique(predictions, key)
    require_same_ids(predictions, expected, key)
    require_empty(predictions.where("answer is null or trim(answer) = ''").select(key), "blank answers")


def write_submission(predictions: DataFrame, expected: DataFrame, path: str, key: str = "question_id") -> None:
    """A ZIP with one JSON object ``id -> {"answer": ...}`` in order of ids: the same bytes for the same answers.

    A submission is one object in one file by its definition, so it is streamed through the driver, sorted by Spark,
    into a file there, and copied to ``path`` when it is whole.
    """
    check_submission(predictions, expected, key)
    handle, local = tempfile.mkstemp(suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as archive:
        info = zipfile.ZipInfo("submission.json", (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        with archive.open(info, "w") as f:
            f.write(b"{")
            for i, row in enumerate(predictions.select(key, "answer").orderBy(key).toLocalIterator()):
                f.write(("," * bool(i) + f"\n  {json.dumps(str(row[0]), ensure_ascii=False)}: " + json.dumps({"answer": row.answer}, ensure_ascii=False)).encode())
            f.write(b"\n}\n")
    spark = predictions.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def _submission(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content").to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                rows = list(json.loads(archive.read("submission.json")).items())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v["answer"] for _, v in rows], pa.string())], names=["question_id", "answer"])


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_submission, "question_id string, answer string")


def write_questions(df: DataFrame, path: str, key: str = "question_id") -> None:
    """Files of one JSON object ``id -> {question, answer}`` each, one per partition: what :func:`readers.read_questions` reads. Ids must be unique."""
    require_unique(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for k, q, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[k] = {"question": q, "answer": a}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(held, ensure_ascii=False)], pa.string())], names=["value"])

    df.select(F.col(key).cast("string"), "question", "answer").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_passage_archives(df: DataFrame, path: str) -> int:
    """ZIP archives of ``context_<document_id>.json`` members, one per partition of ``document_id, source_title, source_url, raw_text``: what :func:`readers.read_passage_archives` reads. Gives the number of members.

    Tasks write files, so ``path`` must be on a file system that all nodes have mounted. A task that runs again writes its archive anew.
    """
    folder = path.removeprefix("file://")
    if "://" in folder:
        raise ValueError("archives are written to mounted file systems only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        target, n = f"{folder}/part-{TaskContext.get().partitionId():05}.zip", 0
        with zipfile.ZipFile(f"{target}.{os.getpid()}.new", "w", zipfile.ZIP_DEFLATED) as archive:
            for b in batches:
                for doc, title, url, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    archive.writestr(f"context_{doc}.json", json.dumps({"id": doc, "name": title, "link": url, "passage": text} if title is not None else {"id": doc, "link": url, "passage": text}, ensure_ascii=False))
                    n += 1
        os.replace(f"{target}.{os.getpid()}.new", target)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(F.col("document_id").cast("string"), "source_title", "source_url", "raw_text")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_bundle(files: DataFrame, path: str) -> None:
    """A ZIP of ``name, content`` (binary) with a manifest of their hashes, in order of names: a checkpoint or result package, small by its nature (it passes through the driver)."""
    spark = files.sparkSession
    require_unique(files, "name")
    handle, local = tempfile.mkstemp(suffix=".zip")
    os.close(handle)
    hashes = {}
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in files.select("name", F.col("content").cast("binary").alias("content")).orderBy("name").toLocalIterator():
            hashes[row.name] = hashlib.sha256(row.content).hexdigest()
            archive.writestr(zipfile.ZipInfo(row.name, (1980, 1, 1, 0, 0, 0)), bytes(row.content))
        archive.writestr(zipfile.ZipInfo(MANIFEST, (1980, 1, 1, 0, 0, 0)), json.dumps(hashes, sort_keys=True))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)

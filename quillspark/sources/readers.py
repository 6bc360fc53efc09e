"""Sources: archives of JSON passages, JSON lines, question mappings, CSV registries, vectors, files by content."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import columns as C
from quillspark.operators.audit import require_empty, require_unique

_MEMBER = re.compile(r"context_(.+)\.json")
_FIELDS, _OPTIONAL = {"id", "link", "passage"}, {"name"}


def _unique(pairs: list[tuple]) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError("repeated JSON key")
    return dict(pairs)


def strict_json(payload: bytes | str):
    """JSON in UTF-8 whose objects repeat no key."""
    return json.loads(payload.decode("utf-8") if isinstance(payload, bytes) else payload, object_pairs_hook=_unique)


def unsafe_member(info: zipfile.ZipInfo) -> str | None:
    """Why an archive member must not be read, or None."""
    path = PurePosixPath(info.filename.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or re.match(r"^[A-Za-z]:", info.filename):
        return "unsafe path"
    if info.flag_bits & 1:
        return "encrypted"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "symlink"
    return None if _MEMBER.fullmatch(path.name) else "foreign name"


def _passage(name: str, payload: bytes) -> tuple:
    """(document_id, title, url, raw_text, error) of one member."""
    try:
        raw = strict_json(payload)
        if not isinstance(raw, dict) or not _FIELDS <= raw.keys() or raw.keys() - _FIELDS - _OPTIONAL:
            raise ValueError("wrong fields")
        if isinstance(raw["id"], bool) or not isinstance(raw["id"], (int, str)) or not str(raw["id"]).strip():
            raise ValueError("wrong id")
        doc = str(raw["id"]).strip()
        if doc != _MEMBER.fullmatch(PurePosixPath(name).name)[1]:
            raise ValueError("id differs from the file name")
        if not isinstance(raw["passage"], str) or not isinstance(raw["link"], str) or not re.match(r"https://[^/?#\s]+", raw["link"].strip(), re.I):
            raise ValueError("wrong link or passage")
        title = raw.get("name")
        if title is not None and not isinstance(title, str):
            raise ValueError("wrong name")
        return doc, (title or "").strip() or None, raw["link"].strip(), raw["passage"], None
    except ValueError as e:
        return None, None, None, None, str(e)


_PASSAGE = "source_name string, document_id string, source_title string, source_url string, raw_text string, error string, raw_text_sha256 string"


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = [x.strip().split(" ")[0] for x in _PASSAGE.split(",")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    for b in batches:
        for content in b.column("content").to_pylist():
            rows, size = [], 0
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.filename):
                    bad = unsafe_member(info)
                    payload = b"" if bad else archive.read(info)
                    parts = (None, None, None, None, bad) if bad else _passage(info.filename, payload)
                    rows.append((info.filename, *parts, hashlib.sha256(payload).hexdigest()))
                    size += len(payload)
                    if size > 32_000_000:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_passage_archives(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Documents in ZIP archives of ``context_<id>.json`` members ``{id, link, passage[, name]}``.

    One task per archive, so large corpora should come as many archives. With ``quarantine`` rejected members
    come out with their ``error``; else any of them, or a repeated id, is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    rows = files.mapInArrow(_unzip, _PASSAGE)
    if quarantine:
        return rows
    require_empty(rows.where("error is not null").select("source_name", "error"), "rejected archive members")
    require_unique(rows, "document_id")
    return rows.drop("error")


#: The member of a bundle that names the hashes of the others.
MANIFEST = "manifest.json"


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        for content in b.column("content").to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                members = [i for i in archive.infolist() if not i.is_dir()]
                names = [i.filename for i in members]
                bad = [i.filename for i in members if unsafe_member(i) not in (None, "foreign name")]
                if bad or len(set(names)) < len(names) or MANIFEST not in names:
                    raise ValueError(f"unsafe bundle: {bad or names}")
                hashes = strict_json(archive.read(MANIFEST))
                if hashes.keys() != set(names) - {MANIFEST}:
                    raise ValueError(f"bundle and manifest differ: {sorted(hashes.keys() ^ (set(names) - {MANIFEST}))}")
                rows = [(n, archive.read(n)) for n in sorted(hashes)]
            wrong = [n for n, payload in rows if hashlib.sha256(payload).hexdigest() != hashes[n]]
            if wrong:
                raise ValueError(f"changed members: {wrong}")
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.binary())], names=["name", "content"])


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of a package of :func:`writers.write_bundle`. Unsafe, repeated, missing, additional or changed members are an error."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unbundle, "name string, content binary")


def content_identity(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """One row: members and a hash of all names and digests that doesn't depend on order or layout.

    Each member's hash is read as a 256-bit number in four parts whose sums are hashed again: an aggregate that merges, instead of a list of all members.
    """
    h = F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name), F.lit(":"), F.col(digest)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("members"), *(part(i).alias(f"s{i}") for i in range(4)))
    return sums.select("members", F.sha2(F.concat_ws(",", *(F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("identity_sha256"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256`` of files; each must fit in a task's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def resolve_artifacts(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ``name, sha256`` with the one file of that content; none or several is an error."""
    found = files.groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    j = wanted.join(found, "sha256", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    require_empty(j.where("n <> 1").select("name", "n"), "artifacts not found exactly once")
    return j.select("name", "sha256", "path")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records separated by LF or CRLF only: U+0085 and U+2028 are data. A record that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


QA = "struct<question:string,answer:string>"


def read_questions(spark: SparkSession, path: str, require_answer: bool | None = None) -> DataFrame:
    """``question_id, question, answer`` from a file with one JSON object ``id -> {question, answer}``.

    ``require_answer``: True if every record must have an answer, False if none may. Blank questions are an error.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{QA}>", {"mode": "FAILFAST"})).alias("question_id", "qa")).select("question_id", "qa.question", "qa.answer")
    require_empty(rows.where(C.is_blank(F.col("question"))).select("question_id"), "blank questions")
    if require_answer is not None:
        wrong = C.is_blank(F.col("answer")) if require_answer else F.col("answer").isNotNull()
        require_empty(rows.where(wrong).select("question_id"), "answers missing" if require_answer else "answers where there must be none")
    return rows


def read_registry(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A column of addresses from a CSV file: the header is matched without case and byte-order mark, closing slashes go."""
    raw = spark.read.option("header", "true").csv(path)
    named = {c.lstrip("\ufeff").strip().lower(): c for c in raw.columns}
    if column.lower() not in named:
        raise ValueError(f"no column {column}")
    return raw.select(F.regexp_replace(F.trim(F.col(f"`{named[column.lower()]}`")), "/+$", "").alias(column)).where(f"{column} <> ''").distinct()


def read_vectors(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, vector``; unique keys and one length of all vectors are required."""
    rows = spark.read.parquet(path).select(key, vector)
    require_unique(rows, key)
    sizes = rows.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of length {sizes.a} to {sizes.b}")
    return rows


def select_wanted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of wanted keys (semi-join); a wanted key without a row, or with several, is an error."""
    rows = df.join(wanted.select(key).distinct(), key, "left_semi")
    require_unique(rows, key)
    require_empty(wanted.select(key).distinct().join(rows, key, "left_anti"), f"no row for {key}")
    return rows


def fetch_ordered(df: DataFrame, ids: DataFrame, key: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Rows of the ids with the rank that each was asked for; an unknown id is an error."""
    require_empty(ids.join(df.select(key), key, "left_anti"), f"unknown {key}")
    return ids.select(key, rank).join(df, key)


CHUNK = "chunk_id string, document_id string, source_title string, source_url string, article_number string, article_title string, clause_numbers array<string>, section_kind string, split_method string, chunk_index int, start_char int, end_char int, whitespace_token_count int, model_token_count int, text string, search_text string"


def read_chunks(spark: SparkSession, path: str, expected: dict[str, object] | None = None) -> DataFrame:
    """Chunks from JSON lines with unique ids; ``expected`` may give ``members`` and ``identity_sha256`` of ids and texts."""
    from quillspark.operators.audit import require_expected

    rows = read_json_lines(spark, path, CHUNK)
    require_unique(rows, "chunk_id")
    if expected:
        require_expected(content_identity(rows.select("chunk_id", F.sha2("text", 256).alias("h")), "chunk_id", "h"), expected)
    return rows


def chunks_by_document(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``document_id, chunks``: the chunks of wanted documents in order (a document's chunks meet in one row)."""
    rows = chunks.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    return rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "article_number", "start_char", "end_char", "text"))).alias("chunks"))

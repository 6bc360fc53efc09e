"""Same or nearly the same question across splits, by a partitioned suffix array (problem 1).

Each distinct question becomes one canonical text: its distinct words, rarest first. The canonical
texts of a batch stand concatenated in one array; their suffixes go, by the hash of their leading
``SPAN`` words (and the digits of the question), to partitions, and are sorted there. One walk over
the sorted suffixes compares neighbours: a run of suffixes whose common prefix with the one before
reaches ``SPAN`` words is an interval, and the cross-split pairs of an interval are candidates.

No pair is lost. If two word sets A and B reach a Jaccard similarity t >= 0.75 and differ at all, they
have at least ``d + 2`` words in common, d = |A - B| + |B - A|. Each differing word can part two common
words that follow each other in at most one place, so among the first d + 2 common words two stand
side by side in both texts. They lie within the first ``d + 2 + |A - B|`` words of A, which is at most
``2 * (1 - t) * |A| + 2``; suffixes from there on are not needed. The order beyond the leading words
can't matter to candidates, so the array is sorted to that depth only.

Candidates pass the lengths, the positions (words before and after the span bound what can be common)
and a 64-bit signature, whose differing bits never exceed the differing words, and then the exact test.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode_text import DIGITS, fold_words
from quillspark.session import cut_lineage

#: Words of the common prefix that two similar texts must share somewhere.
SPAN = 2
#: Words of a span that counts as shared text in the coverage of a record.
COVERED_SPAN = 3
#: The most frequent words, placed last in a canonical text; all others stand before them. Only the
#: order depends on this list, never the result; it bounds what is sent to the workers.
ORDERED_WORDS = 4096
#: Cross-split pairs of one interval that one task tests; the suffixes of larger intervals are spread over a grid of cells of about this size.
INTERVAL_PAIRS = 50_000_000
#: Candidate pairs that are held as arrays at once.
_CHUNK = 4_000_000


def question_parts(text: str | None) -> tuple[list[str], str]:
    """Distinct folded words in order of first occurrence, and the sorted digit runs."""
    if not text:
        return [], ""
    words = fold_words(text)
    return list(dict.fromkeys(words)), " ".join(sorted(d for w in words if not w.isalpha() for d in DIGITS.findall(w)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, classes, digits, words = [], [], [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            w, d = question_parts(t)
            if w:
                text = " ".join(sorted(w))
                keep.append(i)
                digits.append(d)
                words.append(text)
                classes.append(xxhash.xxh3_128_digest(f"{d}\n{text}"))
        rows = pa.array(keep, pa.int64())
        out = [b.column("id").take(rows), b.column("is_train").take(rows), pa.array(classes, pa.binary()), pa.array(digits, pa.string()), pa.array(words, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["id", "is_train", "class_id", "digits", "words"])


# --- the suffix array ---


@lru_cache(2)
def _ranks(frequent: tuple[str, ...]) -> dict[str, int]:
    return {w: i for i, w in enumerate(frequent)}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered by a bijection (the finaliser of a public mixing generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def concatenated(texts: list[str], ranks: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The canonical texts one after another as 64-bit word hashes, and the row that each word belongs to."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], dtype=np.uint64)
    place = np.array([ranks.get(w, -1) for w in vocabulary], dtype=np.int64)
    at, rows = np.asarray(coded.indices), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    order = np.lexsort((hashes[at], place[at], rows))
    return hashes[at][order], rows


def suffix_rows(texts: list[str], digits: list[str], ranks: dict[str, int], threshold: float) -> tuple[np.ndarray, ...]:
    """Row, position and leading hash of every suffix that is needed; number of words and signature per row."""
    words, rows = concatenated(texts, ranks)
    n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    starts = np.cumsum(n) - n
    # parities: a word turns one bit over, so that n words that differ turn over n bits at most
    signature = np.bitwise_xor.reduceat(np.uint64(1) << (words & np.uint64(63)), starts) if len(words) else np.zeros(0, np.uint64)
    numbers = np.array([xxhash.xxh3_64_intdigest(d) for d in digits], dtype=np.uint64)
    reach = np.minimum(n, np.ceil(2 * (1 - threshold) * n - 1e-9).astype(np.int64) + SPAN)
    count = np.maximum(reach - SPAN + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lead, at = _mixed(numbers[row]), starts[row] + position
    for k in range(SPAN):
        lead = _mixed(lead * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return row, position, lead.view(np.int64), n, signature.view(np.int64)


_SUFFIXES = "lead long, class_no long, signature long, place long"


def _suffixes(frequent: tuple[str, ...], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(frequent)
        for b in batches:
            if not b.num_rows:
                continue
            row, position, lead, n, signature = suffix_rows(b.column("words").to_pylist(), b.column("digits").to_pylist(), ranks, threshold)
            sides = np.asarray(b.column("train").cast(pa.int8())).astype(np.int64) + 2 * np.asarray(b.column("other").cast(pa.int8())).astype(np.int64)
            place = n[row] << 32 | position << 2 | sides[row]
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(np.asarray(b.column("class_no"))[row]), pa.array(signature[row]), pa.array(place)], names=["lead", "class_no", "signature", "place"])

    return run


def _tested(train: np.ndarray, other: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs into ``rows`` (class, signature, place) those that may be similar, as classes."""
    number, signature, place = rows
    n = place >> 32
    most = (n[train] + n[other]) * ((1 - threshold) / (1 + threshold)) + 1e-9
    ok = np.bitwise_count((signature[train] ^ signature[other]).view(np.uint64)) <= most
    train, other = train[ok], other[ok]
    na, nb, i, j = n[train], n[other], (place[train] >> 2) & 0x3FFFFFFF, (place[other] >> 2) & 0x3FFFFFFF
    common = np.minimum(i, j) + np.minimum(na - i, nb - j)
    ok = common >= (na + nb) * (threshold / (1 + threshold)) - 1e-9
    return number[train[ok]], number[other[ok]]


def interval_pairs(lead: np.ndarray, rows: np.ndarray, threshold: float, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Candidates of sorted suffixes, and which rows stand in intervals of more than ``limit`` cross-split pairs, left for the grid."""
    # neighbours whose common prefix is too short bound the intervals
    interval = np.concatenate([[0], np.cumsum(lead[1:] != lead[:-1])])
    side = rows[2] & 3
    train, other = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    size = interval[-1] + 1
    n_train, n_other = np.bincount(interval[train], minlength=size), np.bincount(interval[other], minlength=size)
    wide = n_train * n_other > limit
    train = train[~wide[interval[train]] & (n_other[interval[train]] > 0)]
    first = np.cumsum(n_other) - n_other
    per_train = n_other[interval[train]]
    out, at, upto = [], 0, np.cumsum(per_train)
    while at < len(train):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _CHUNK, "right")))
        part, k = train[at:end], per_train[at:end]
        offsets = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out.append(_tested(np.repeat(part, k), other[np.repeat(first[interval[part]], k) + offsets], rows, threshold))
        at = end
    return out, wide[interval]


_WALKED = "lead long, a long, b long, place long"


def _walk(threshold: float, limit: int):
    """Sorted suffixes to candidates (``a, b``: classes of the train and the other side), and the suffixes of wide intervals as they came."""

    def batch(lead, a, b, place):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lead, a, b, place)], names=["lead", "a", "b", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, rows, hot = np.zeros(0, np.int64), np.zeros((3, 0), np.int64), None

        def closed(upto: int):
            pairs, wide = interval_pairs(lead[:upto], rows[:, :upto], threshold, limit)
            a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
                yield batch([None] * len(a), a, b, [None] * len(a))
            if wide.any():
                yield batch(lead[:upto][wide], *rows[:, :upto][:, wide])

        for b in batches:
            if not b.num_rows:
                continue
            new, more = np.asarray(b.column("lead")), np.stack([np.asarray(b.column(c)) for c in ("class_no", "signature", "place")])
            if hot is not None:  # the rest of an interval that has been passed on
                upto = int(np.searchsorted(new != hot, True)) if new[-1] != hot else len(new)
                if upto:
                    yield batch(new[:upto], *more[:, :upto])
                new, more = new[upto:], more[:, upto:]
                if not len(new):
                    continue
                hot = None
            lead, rows = np.concatenate([lead, new]), np.concatenate([rows, more], axis=1)
            open_at = int(np.searchsorted(lead != lead[-1], False)) if lead[0] == lead[-1] else len(lead) - int(np.argmax(lead[::-1] != lead[-1]))
            if open_at:
                yield from closed(open_at)
                lead, rows = lead[open_at:], rows[:, open_at:]
            if len(lead) ** 2 // 4 > limit:  # too wide whatever its sides; no task holds more of one interval than this
                yield batch(lead, *rows)
                hot, lead, rows = lead[0], lead[:0], rows[:, :0]
        if len(lead):
            yield from closed(len(lead))

    return run


def _cells(wide: DataFrame) -> DataFrame:
    """Suffixes of wide intervals over a grid: each train row meets each other row in one cell, a new interval of bounded size."""
    side = lambda bit: (F.col("place").bitwiseAND(bit) != 0).cast("long")
    sizes = wide.groupBy("lead").agg(F.sum(side(1)).alias("nt"), F.sum(side(2)).alias("no"))
    edge = int(INTERVAL_PAIRS**0.5)
    sizes = sizes.where("nt > 0 and no > 0").select("lead", F.ceil(F.col("nt") / edge).cast("int").alias("down"), F.ceil(F.col("no") / edge).cast("int").alias("across"))
    rows = wide.join(sizes, "lead")
    cell = lambda mine, n: F.pmod(F.xxhash64("a", F.lit(mine)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    parts = []
    for bit, down, across in ((1, F.array(cell("t", F.col("down"))), every("across")), (2, every("down"), F.array(cell("o", F.col("across"))))):
        # a class that stands on both sides comes once for each
        own = rows.where(F.col("place").bitwiseAND(bit) != 0).withColumn("place", F.col("place").bitwiseAND(~3).bitwiseOR(bit))
        own = own.withColumn("d", F.explode(down)).withColumn("c", F.explode(across))
        parts.append(own.select(F.xxhash64("lead", "d", "c").alias("lead"), F.col("a").alias("class_no"), F.col("b").alias("signature"), "place"))
    return parts[0].unionByName(parts[1])


def _sorted(suffixes: DataFrame) -> DataFrame:
    """The suffix array: suffixes with the same leading words in one partition, in order."""
    spark = suffixes.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return suffixes.repartition(n, "lead").sortWithinPartitions("lead")


def candidates(suffixes: DataFrame, threshold: float, limit: int = INTERVAL_PAIRS) -> DataFrame:
    """``a, b``: class pairs, train side first, whose suffixes meet in an interval and pass the bounds."""
    walked = cut_lineage(_sorted(suffixes).mapInArrow(_walk(threshold, limit), _WALKED))
    rest = _sorted(_cells(walked.where("lead is not null"))).mapInArrow(_walk(threshold, 1 << 62), _WALKED)
    return walked.where("lead is null").select("a", "b").unionByName(rest.select("a", "b")).distinct()


# --- pairs ---


def question_texts(records: DataFrame, record_id: Column, question: Column, split: Column, train: str = "train") -> DataFrame:
    """``id, is_train, class_id, digits, words``, written once: records with equal ``class_id`` ask the same words in any order."""
    src = records.select(record_id.alias("id"), (split == train).alias("is_train"), question.alias("text")).where("id is not null and is_train is not null and text is not null")
    return cut_lineage(src.mapInArrow(_parts, f"id {dict(src.dtypes)['id']}, is_train boolean, class_id binary, digits string, words string"))


def class_pairs(parts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``class_a, class_b, common_words, all_words``: classes of :func:`question_texts`, the first with a training record, the second with another, that ask the same."""
    if not 0.75 <= threshold <= 1:
        raise ValueError("threshold must lie between 0.75 and 1")
    one_text = F.min(F.struct("digits", "words")).alias("t")  # all of a class have the same
    classes = parts.groupBy("class_id").agg(F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("other"), one_text)
    # a number is shorter than the class; should two classes ever share one, the exact test parts them again
    classes = cut_lineage(classes.select("class_id", F.xxhash64("class_id").alias("class_no"), "train", "other", "t.digits", "t.words"))
    counts = classes.select(F.explode(F.split("words", " ")).alias("w")).groupBy("w").count()
    frequent = tuple(r.w for r in reversed(counts.orderBy(F.col("count").desc(), "w").limit(ORDERED_WORDS).collect()))
    suffixes = classes.select("class_no", "train", "other", "digits", "words").mapInArrow(_suffixes(frequent, threshold), _SUFFIXES)
    size = F.size(F.split("words", " "))
    same = classes.where("train and other").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), size.alias("common_words"), size.alias("all_words"))
    texts = classes.select("class_no", "class_id", "digits", "words")
    found = candidates(suffixes, threshold).join(texts.toDF("a", "class_a", "digits_a", "words_a"), "a").join(texts.toDF("b", "class_b", "digits_b", "words_b"), "b")
    found = found.where("digits_a = digits_b and class_a <> class_b").withColumn("wa", F.split("words_a", " ")).withColumn("wb", F.split("words_b", " "))
    found = found.withColumn("common_words", F.size(F.array_intersect("wa", "wb"))).withColumn("all_words", F.size("wa") + F.size("wb") - F.col("common_words")).where(F.col("common_words") >= threshold * F.col("all_words") - 1e-9)
    return found.select("class_a", "class_b", "common_words", "all_words").unionByName(same)


def question_overlaps(records: DataFrame, record_id: Column, question: Column, split: Column, train: str = "train", threshold: float = 0.8) -> DataFrame:
    """``train_id, other_id, common_words, all_words``: pairs of a training record and one of another split with the same question.

    Same: at least ``threshold`` of the distinct words of either are common to both (case, accents, width,
    invisible characters, blanks, punctuation and markup ignored) and the digit runs form the same multiset.
    Null ids, splits and questions and questions without a word have no pair; records repeated under one id
    count once; copies are joined as one class and expanded only in the result; an empty table gives none.
    Extra columns are ignored.
    """
    parts = question_texts(records, record_id.cast("long"), question, split, train)
    left = parts.where("is_train").select(F.col("class_id").alias("class_a"), F.col("id").alias("train_id"))
    right = parts.where("not is_train").select(F.col("class_id").alias("class_b"), F.col("id").alias("other_id"))
    return class_pairs(parts, threshold).join(left, "class_a").join(right, "class_b").select("train_id", "other_id", "common_words", "all_words").distinct()


def overlap_links(records: DataFrame, record_id: Column, question: Column, split: Column, train: str = "train", threshold: float = 0.8) -> DataFrame:
    """``id, is_train, class_id, n_links`` of every record that overlaps: with how many records of the other side it shares its question.

    The form for groups of any size: nothing is expanded, links are sums of the sizes of paired classes. A record with
    several questions has a row for each; nulls and repetitions count as in :func:`question_overlaps`.
    """
    parts = question_texts(records, record_id.cast("long"), question, split, train)
    owned = parts.select("id", "is_train", "class_id").distinct()
    pairs = cut_lineage(class_pairs(parts, threshold).select("class_a", "class_b"))
    sizes = cut_lineage(owned.groupBy("class_id", "is_train").agg(F.count("*").alias("n")))
    links = None
    for mine, theirs, is_train in (("class_a", "class_b", True), ("class_b", "class_a", False)):
        n = sizes.where(~F.col("is_train") if is_train else F.col("is_train")).select(F.col("class_id").alias(theirs), "n")
        part = pairs.join(n, theirs).groupBy(F.col(mine).alias("class_id")).agg(F.sum("n").alias("n_links")).withColumn("is_train", F.lit(is_train))
        links = part if links is None else links.unionByName(part)
    return owned.join(links, ["class_id", "is_train"]).select("id", "is_train", "class_id", "n_links")


# --- coverage and report ---


def text_spans(words: list[str], k: int) -> list[int]:
    """Hashes of all spans of ``k`` words in order."""
    return [xxhash.xxh3_64_intdigest("\n".join(words[i : i + k])) - (1 << 63) for i in range(len(words) - k + 1)]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a training text the spans of all lengths up to COVERED_SPAN, of another those of its own length only."""
    for b in batches:
        n, spans = [], []
        for text, is_train in zip(b.column("text").to_pylist(), b.column("is_train").to_pylist(), strict=True):
            words = fold_words(text)
            n.append(len(words))
            spans.append([h for k in range(1, COVERED_SPAN + 1) for h in text_spans(words, k)] if is_train else text_spans(words, min(COVERED_SPAN, len(words))))
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("class_id"), pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.int64()))], names=["text", "class_id", "n", "spans"])


def text_coverage(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``text, n_words, n_covered`` of the texts outside training in ``pairs`` (``class_a, class_b``); ``texts`` has ``text, is_train, class_id``, each text once a side.

    Covered are words, in the text's own order and with repetitions, that lie in a span of COVERED_SPAN words (all of
    a shorter text) which stands in any training text of a paired class; spans that overlap are merged. Spans meet by
    join, so many spellings of one question on both sides cost their sum, not their product.
    """
    schema = "text string, class_id binary, n int, spans array<long>"
    source = texts.where("is_train").join(pairs.select(F.col("class_a").alias("class_id")).distinct(), "class_id", "left_semi")
    held = source.select("text", "class_id", "is_train").mapInArrow(_spans, schema).select(F.col("class_id").alias("class_a"), F.explode("spans").alias("span")).distinct()
    held = pairs.join(held, "class_a").select(F.col("class_b").alias("class_id"), "span").distinct()
    asked = texts.where("not is_train").join(pairs.select(F.col("class_b").alias("class_id")).distinct(), "class_id", "left_semi")
    own = asked.select("text", "class_id", "is_train").mapInArrow(_spans, schema).select("text", "class_id", "n", F.posexplode("spans").alias("at", "span"))
    met = own.join(held.withColumn("met", F.lit(True)), ["class_id", "span"], "left")
    words = met.select("text", "n", F.when(F.col("met"), F.sequence(F.col("at"), F.col("at") + F.least(F.lit(COVERED_SPAN), "n") - 1)).alias("p"))
    places = words.select("text", "n", F.explode_outer("p").alias("p")).distinct()
    return places.groupBy("text").agg(F.max("n").alias("n_words"), F.count("p").alias("n_covered"))


def overlap_report(records: DataFrame, record_id: Column, question: Column, split: Column, source: Column, train: str = "train", threshold: float = 0.8) -> DataFrame:
    """``split, source, n_records, n_overlapping, n_pairs, mean_coverage`` of the splits other than ``train``.

    Counts come from classes, never from expanded pairs; ``n_pairs`` is what :func:`question_overlaps` would give. A
    record's coverage is that of :func:`text_coverage`; ``mean_coverage`` is over the records that overlap, null without
    one. Records with a null id or split don't count, those without a question never overlap; a record repeated with the
    same question, split and source counts once; an empty table gives no row.
    """
    src = records.select(record_id.alias("id"), question.alias("text"), split.alias("split"), source.alias("source")).where("id is not null and split is not null").distinct()
    src = cut_lineage(src.withColumn("is_train", F.col("split") == train))
    parts = question_texts(src.select("text", "is_train").distinct(), F.col("text"), F.col("text"), F.when(F.col("is_train"), train).otherwise(""), train)
    pairs = cut_lineage(class_pairs(parts, threshold).select("class_a", "class_b"))
    texts = parts.select(F.col("id").alias("text"), "is_train", "class_id")
    owned = src.join(texts, ["text", "is_train"])
    n_train = owned.where("is_train").select("class_id", "id").distinct().groupBy(F.col("class_id").alias("class_a")).agg(F.count("*").alias("n"))
    per_class = pairs.join(n_train, "class_a").groupBy(F.col("class_b").alias("class_id")).agg(F.sum("n").alias("n_pairs"))
    per_text = texts.where("not is_train").join(per_class, "class_id").join(text_coverage(pairs, texts), "text").select("text", "n_pairs", (F.col("n_covered") / F.col("n_words")).alias("coverage"))
    rows = src.where("not is_train").join(per_text, "text", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.avg("coverage").alias("mean_coverage"))

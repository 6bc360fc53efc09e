"""Column expressions that stay in the JVM, and Arrow wrappers where Spark has no counterpart."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import unicode_text

#: A word of the lexical index: letters and numbers.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def text_udf(function: Callable, result: str | T.DataType) -> Callable[..., Column]:
    """A scalar Arrow-batched UDF from a function of one or more values; null in the first argument gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    def one(c: pd.Series) -> pd.Series:
        return run(c)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def call(*columns: Column) -> Column:
        # made per call: a UDF is bound to the session of its first use
        return F.pandas_udf(one if len(columns) == 1 else two, result)(*columns)

    return call


fold_accents = text_udf(unicode_text.fold_accents, "string")
casefold_key = text_udf(unicode_text.casefold_key, "string")


def squeeze(c: Column) -> Column:
    """Blanks of any kind squeezed to one and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Texts of these characters only are NFC, fold as they are lower-cased and have no blank that Java and Unicode see differently.
PLAIN_TEXT = r"^[\x{00}-\x{1b}\x{20}-\x{7e}\x{a0}-\x{b4}\x{b6}-\x{de}\x{e0}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}\x{1a0}\x{1a1}\x{1af}\x{1b0}\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{2030}-\x{205e}]*$"


def normalize_question(c: Column) -> Column:
    """NFC, full case folding, blanks of any kind squeezed and trimmed; accents and punctuation stay.

    The JVM has it for texts of :data:`PLAIN_TEXT`, nearly all; only the others carry their text to Python.
    """
    plain = c.rlike(PLAIN_TEXT)
    return F.when(plain, squeeze(F.lower(c))).otherwise(casefold_key(F.when(~plain, c)))


def tokens(c: Column) -> Column:
    """Words in order, lower case; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def distinct_tokens(c: Column) -> Column:
    """Distinct words in order of first occurrence."""
    return F.array_distinct(tokens(c))


def longest_terms(terms: Column, at_least: int, at_most: int) -> Column:
    """The longest terms (earlier ones first among equals), back in their own order."""
    numbered = F.transform(terms, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("t")))
    best = F.slice(F.array_sort(F.filter(numbered, lambda s: s["n"] <= -at_least)), 1, at_most)
    return F.transform(F.array_sort(F.transform(best, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t")))), lambda s: s["t"])


def whitespace_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("ctx-"), document_id, F.lit("::"), F.lpad(index.cast("string"), 5, "0"), F.lit("::"), F.substring(F.sha2(text, 256), 1, 12))


def hash_bucket(seed: str, c: Column, buckets: int) -> Column:
    """The first eight bytes of sha256(seed NUL value), big-endian, modulo the buckets."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.decode(F.unhex(F.lit("00")), "UTF-8"), c), 256), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)")).cast("int")


def ordered_hash(order: Column, value: Column) -> Column:
    """Aggregate: sha256 of the values joined by line feeds in the given order. The values of a group meet in one row; meant for ids of bounded lists."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])
    return F.sha2(F.array_join(items, "\n"), 256)


def stable_json_hash(*columns: str) -> Column:
    """sha256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double precision; null if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def rouge_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text: accented letters split words."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def search_text(*parts: Column) -> Column:
    """The distinct non-empty parts in order, one per line."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), "\n")


def compact_header(c: Column, limit: int) -> Column:
    """Non-blank lines, trimmed, cut to a number of characters."""
    lines = F.filter(F.transform(F.split(c, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.regexp_replace(F.substring(F.array_join(lines, "\n"), 1, limit), r"(?U)\s+$", "")


def is_upper_heading(c: Column) -> Column:
    """At least 12 letters, at least nine tenths of them upper case."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters >= 12) & (F.regexp_count(c, F.lit(r"\p{Lu}")) >= 0.9 * letters)


def is_https(c: Column) -> Column:
    """An absolute HTTPS address with a host; null is none."""
    return F.coalesce(c.rlike(r"^(?i:https)://[^/?#\s]+"), F.lit(False))


def finish_reason(last_token: Column, n_tokens: Column, eos: int, cap: int) -> Column:
    return F.when(last_token == eos, "eos").when(n_tokens >= cap, "length").otherwise("other")


def label_mask(prompt_ids: Column, answer_ids: Column, ignore: int = -100) -> Column:
    """Labels that ignore the prompt."""
    return F.concat(F.array_repeat(F.lit(ignore), F.size(prompt_ids)), answer_ids)


def section_score(section: Column, question: Column, source: Column) -> Column:
    """2 precision + 1.5 recall + 0.5 source recall + 0.4 shared terms, rounded to 6 digits; 0 with fewer than two shared terms. Both recalls are shares of the question's terms."""
    shared = F.size(F.array_intersect(section, question))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    score = 2 * share(shared, F.size(section)) + 1.5 * share(shared, F.size(question)) + 0.5 * share(F.size(F.array_intersect(source, question)), F.size(question)) + 0.4 * shared
    return F.when(shared < 2, 0.0).otherwise(F.round(score, 6))


# The forms of references in legal texts.
DOCUMENT_NUMBER = r"\b[0-9]{1,4}/[0-9]{4}/[a-z0-9]+(?:-[a-z0-9]+)*\b"
ARTICLE_REFERENCE = r"\bdieu\s+([0-9]+[a-z]?)\b"
CLAUSE_REFERENCE = r"\bkhoan\s+([0-9]+[a-z]?)\b"
SOURCE_NUMBER = r"(?iu)\b([0-9]{1,4}/[0-9]{4}/[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"
ARTICLE_HEADING = r"(?imu)^\s*Điều\s+[0-9]+[a-zđ]?"


def source_number(cleaned_text: Column, header: int = 600) -> Column:
    """The document's own number: the only one that stands before the first article (or in the first characters); else null."""
    head = F.when(cleaned_text.rlike(ARTICLE_HEADING), F.element_at(F.split(cleaned_text, ARTICLE_HEADING, 2), 1)).otherwise(F.substring(cleaned_text, 1, header))
    found = F.array_distinct(F.regexp_extract_all(head, F.lit(SOURCE_NUMBER), F.lit(1)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def enrich_context(text: Column, source_title: Column, number: Column, article_title: Column) -> Column:
    """The chunk's text under lines that name its source."""
    line = lambda label, c: F.when(null_if_blank(c).isNotNull(), F.concat(F.lit(label + ": "), F.trim(c)))
    return F.concat_ws("\n", line("Tên nguồn", source_title), line("Số văn bản", number), line("Tiêu đề Điều", article_title), F.lit("Nội dung:"), text)


def answer_diagnostics(answer: Column) -> Column:
    """Flags of repetitive or unfinished answers, as one struct."""
    pieces = lambda pattern, least: F.filter(F.transform(F.split(answer, pattern), lambda x: squeeze(F.lower(x))), lambda x: F.length(x) >= least)
    repeated = lambda items: F.size(items) != F.size(F.array_distinct(items))
    return F.struct(
        repeated(pieces(r"\n", 8)).alias("duplicate_line"),
        repeated(pieces(r"(?<=[.!?])\s+", 20)).alias("duplicate_sentence"),
        answer.rlike(r"(?:-[A-ZĐ]{2,10}){10,}").alias("abbreviation_loop"),
        (~answer.rlike(r"(?U)[.!?…:;)\]”\"]\s*$")).alias("non_sentence_ending"),
    )


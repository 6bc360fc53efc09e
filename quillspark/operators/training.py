"""Training records: evidence, tokens, labels, and the gates they must pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators.audit import forbidden_fields
from quillspark.operators.packing import Budget, drop_expansions, pack_units, render

Tokenizer = Callable[[str], list[int]]


def _evidence(budget: Budget, encode: Tokenizer, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, question, answer, units in zip(*(b.column(c).to_pylist() for c in ("query", "question", "answer", "units")), strict=True):
                ids = [*encode(answer), eos]
                # the evidence is chosen without sight of the answer; only its length is reserved afterwards
                chosen, taken = pack_units(question, units, budget)
                seeds = {u["rank"]: u for u in units}
                kept = drop_expansions(question, chosen, [seeds[u["rank"]] for u in chosen], budget, len(ids))
                text = render(question, kept)
                names = [i for u in sorted(units, key=lambda u: u["rank"]) for i in u["chunk_ids"]]
                out.append((q, text, encode(text), ids, len(chosen), len(kept), len(taken), names))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query", "prompt", "prompt_ids", "answer_ids", "n_chosen", "n_kept", "n_expanded", "seed_ids"])

    return run


def training_records(units: DataFrame, answers: DataFrame, budget: Budget, encode: Tokenizer, eos: int) -> DataFrame:
    """``query, prompt, input_ids, attention_mask, labels, record_sha256`` and counters, from ``query, question, units`` and ``query, answer``.

    Labels ignore the prompt; answers are never cut. Null and blank answers give no record.
    """
    src = units.join(answers.where(~C.is_blank(F.col("answer"))).select("query", "answer"), "query").select("query", "question", "answer", "units")
    rows = src.mapInArrow(_evidence(budget, encode, eos), "query string, prompt string, prompt_ids array<int>, answer_ids array<int>, n_chosen int, n_kept int, n_expanded int, seed_ids array<string>")
    rows = rows.withColumn("input_ids", F.concat("prompt_ids", "answer_ids")).withColumn("labels", C.label_mask(F.col("prompt_ids"), F.col("answer_ids")))
    rows = rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    rows = rows.withColumn("prompt_sha256", F.sha2("prompt", 256))
    return rows.withColumn("record_sha256", C.stable_json_hash("query", "input_ids", "labels"))


def pad_batch(records: DataFrame, length: int, pad: int) -> DataFrame:
    """Arrays padded to one length: ids with ``pad``, mask with 0, labels with -100; longer records are an error of the caller and stay."""
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.greatest(F.lit(length) - F.size(c), F.lit(0))))
    return records.withColumn("input_ids", fill("input_ids", pad)).withColumn("attention_mask", fill("attention_mask", 0)).withColumn("labels", fill("labels", -100))


#: Fields that a training record must not carry.
REFERENCE_FIELDS = frozenset(("reference", "reference_answer", "gold_evidence", "gold_answer"))


def identities(records: DataFrame) -> dict[str, str]:
    """Hashes of the ordered ids and of all records, as :func:`gates` holds them against what was stored. Sums of hashes merge; the order is the ids' own."""
    row = records.agg(*(c.alias(n) for n, c in _identity_columns().items())).first()
    return row.asDict()


def _identity_columns() -> dict[str, Column]:
    part = lambda c, i: F.sum(F.conv(F.substring(F.sha2(c, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    merged = lambda c: F.sha2(F.concat_ws(",", *(F.coalesce(part(c, i).cast("string"), F.lit("0")) for i in range(4))), 256)
    return {"ids_sha256": merged(F.col("query").cast("string")), "records_sha256": merged(F.concat_ws(":", F.col("query").cast("string"), "record_sha256"))}


def gates(
    records: DataFrame,
    max_tokens: int = 8192,
    expected: int | None = None,
    least_mean_prompt: float = 0.0,
    least_retention: float = 0.95,
    stored: dict[str, str] | None = None,
    answers: DataFrame | None = None,
    seeds: DataFrame | None = None,
    provenance: DataFrame | None = None,
    mutated: DataFrame | None = None,
    contract: tuple[dict, dict] | None = None,
) -> DataFrame:
    """One row of booleans about training records, and ``passed``.

    From the records alone: count, unique queries, budget, aligned labels and masks, prompts ignored, answers kept whole
    and not empty, hashes of prompts and records, evidence, mean prompt, retention, no field of a reference. Against other
    tables, each true where it isn't given: ``stored`` identities (:func:`identities`); ``answers`` (``query,
    answer_ids`` encoded again, with the end token); ``seeds`` (``query, seed_ids`` as retrieved); ``provenance``
    (violations, which must be none); ``mutated`` (records made with other answers: their evidence must be the same where
    as much room is left); ``contract`` (settings used, settings agreed).
    """
    bad = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("int")) == 0
    size, labels, prompt = F.size("input_ids"), F.size("labels"), F.size("prompt_ids")
    none = lambda violations: violations.limit(1).count() == 0
    differ = lambda other, mine, theirs: none(records.join(other.withColumnRenamed(theirs, "_other"), "query", "full").where(~F.coalesce(F.col(mine) == F.col("_other"), F.lit(False))))
    found = _identity_columns()
    checks = {
        "count": F.count("*") == F.lit(expected) if expected is not None else F.count("*") > 0,
        "unique_queries": F.count("*") == F.countDistinct("query"),
        "ordered_ids": found["ids_sha256"] == F.lit(stored["ids_sha256"]) if stored else F.lit(True),
        "within_budget": bad(size > max_tokens),
        "labels_align": bad(labels != size),
        "mask_aligns": bad(F.size("attention_mask") != size),
        "prompt_ignored": bad(F.exists(F.slice("labels", F.lit(1), prompt), lambda x: x != -100)),
        "answer_kept": bad(F.slice("labels", prompt + 1, F.size("answer_ids")) != F.col("answer_ids")),
        "answer_not_empty": bad(F.size("answer_ids") < 2),
        "answer_complete": F.lit(answers is None or differ(answers, "answer_ids", "answer_ids")),
        "input_is_prompt_and_answer": bad(F.col("input_ids") != F.concat("prompt_ids", "answer_ids")),
        "no_reference_fields": F.lit(not forbidden_fields(records, REFERENCE_FIELDS)),
        "exact_provenance": F.lit(provenance is None or none(provenance)),
        "seeds_as_retrieved": F.lit(seeds is None or differ(seeds, "seed_ids", "seed_ids")),
        "answer_blind": F.lit(mutated is None or none(records.alias("a").join(mutated.alias("b"), "query").where("size(a.answer_ids) = size(b.answer_ids) and not (a.prompt_sha256 <=> b.prompt_sha256)"))),
        "prompt_hashes_hold": bad(F.col("prompt_sha256") != F.sha2("prompt", 256)),
        "hashes_hold": bad(F.col("record_sha256") != C.stable_json_hash("query", "input_ids", "labels")),
        "records_as_stored": found["records_sha256"] == F.lit(stored["records_sha256"]) if stored else F.lit(True),
        "has_evidence": bad(F.col("n_kept") < 1),
        "seeds_kept": bad(F.col("n_kept") < F.col("n_chosen")),
        "mean_prompt": F.coalesce(F.avg(prompt) >= least_mean_prompt, F.lit(False)),
        "retention": F.coalesce(F.sum("n_kept") >= least_retention * F.sum("n_chosen"), F.lit(False)),
        "settings_agree": F.lit(contract is None or all(contract[0].get(k) == v for k, v in contract[1].items())),
    }
    row = records.agg(F.count("*").alias("_n"), *(c.alias(n) for n, c in checks.items())).drop("_n")
    passed: Column = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return row.withColumn("passed", passed)


def length_summary(records: DataFrame, what: Column) -> DataFrame:
    return records.agg(F.count("*").alias("n"), F.avg(what).alias("mean_length"), F.min(what).alias("min_length"), F.max(what).alias("max_length"))


def parameter_budget(models: DataFrame, stacks: DataFrame, limit: float) -> DataFrame:
    """Per stack (``stack, model_keys``) the sum of its models' parameters (``model_key, parameters``), and whether all are known, distinct and within the limit."""
    parts = stacks.select("stack", F.size("model_keys").alias("n_keys"), F.explode("model_keys").alias("model_key"))
    j = parts.join(models.select("model_key", "parameters"), "model_key", "left")
    out = j.groupBy("stack").agg(F.sum("parameters").alias("parameters"), F.max("n_keys").alias("n_keys"), F.countDistinct("model_key").alias("n_distinct"), F.count("parameters").alias("n_known"))
    return out.withColumn("valid", (F.col("n_keys") == F.col("n_distinct")) & (F.col("n_known") == F.col("n_keys")) & (F.col("parameters") <= limit))

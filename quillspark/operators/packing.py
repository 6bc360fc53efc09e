"""Prompts from ranked evidence under token budgets: greedy, skipping what doesn't fit, so a fold per question.

A question's evidence is bounded by its top k hits and their expansions, so it may meet in one row.
Spans of a run of one article are laid over each other by their offsets; a prompt's tokens are added up
from those of its lines, each counted once, and the text is rendered once, for what was chosen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = dict


def _words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Budget:
    """``count`` gives the tokens of a text; by default blank-separated words.

    ``additive``: the tokens of a prompt are the sum of its lines'. Without it every trial is rendered and counted whole.
    """

    max_input_tokens: int = 8192
    max_parent_tokens: int = 1200
    count: Callable[[str], int] = _words
    additive: bool = True


# --- spans ---


def _laid(group: list[Span]) -> Span:
    """Spans that touch each other as one: the least rank, all chunk ids, and the text on which all of them agree."""
    start, end = group[0]["start"], max(s["end"] for s in group)
    canvas: list[str | None] = [None] * (end - start)
    for s in group:
        here = slice(s["start"] - start, s["end"] - start)
        if any(old is not None and old != new for old, new in zip(canvas[here], s["text"], strict=True)):
            raise ValueError(f"spans of document {s['document_id']} disagree between {s['start']} and {s['end']}")
        canvas[here] = s["text"]
    ids = sorted({i for s in group for i in s["chunk_ids"]})
    return {**group[0], "end": end, "text": "".join(canvas), "rank": min(s["rank"] for s in group), "chunk_ids": ids}


def united(spans: Iterable[Span]) -> list[Span]:
    """Overlapping or touching spans of a document's block laid together, in order of rank, document and start. Spans whose texts disagree are an error."""
    runs: dict[tuple, list[Span]] = defaultdict(list)
    for s in spans:
        runs[s["document_id"], s["block_id"]].append(s)
    out = []
    for run in runs.values():
        run.sort(key=lambda s: (s["start"], s["end"]))
        reach = list(accumulate((s["end"] for s in run), max))
        breaks = [i for i in range(1, len(run)) if run[i]["start"] > reach[i - 1]]
        out += (run[a] if b - a == 1 else _laid(run[a:b]) for a, b in pairwise([0, *breaks, len(run)]))
    return sorted(out, key=lambda s: (s["rank"], s["document_id"], s["start"]))


# --- rendering ---


def span_lines(spans: list[Span]) -> Iterator[str]:
    """The lines of one context: its source, then each span under its article."""
    # The labels of a prompt
    for label, key in (("Tên nguồn", "source_title"), ("Số văn bản", "document_number")):
        if spans[0].get(key):
            yield f"{label}: {spans[0][key].strip()}"
    for s in spans:
        name = f"Điều {s['article_number']}" if s.get("article_number") else "Trích đoạn"
        yield name + (f": {s['article_title']}" if s.get("article_title") else "")
        yield "Nội dung:"
        yield s["text"]


def contexts_of(spans: list[Span], merge: bool) -> list[list[Span]]:
    """The spans of each context: one per document in order of its best rank, or, unmerged, one per span."""
    if not merge:
        return [[s] for s in spans]
    documents: dict[str, list[Span]] = {}
    for s in united(spans):
        documents.setdefault(s["document_id"], []).append(s)
    return list(documents.values())


def prompt(question: str, contexts: list[str]) -> str:
    # The frame of a prompt
    return "Ngữ cảnh:\n" + "\n\n".join(f"[{i}] {c}" for i, c in enumerate(contexts, 1)) + f"\n\nCâu hỏi: {question}"


def render(question: str, spans: list[Span], merge: bool = True) -> str:
    return prompt(question, ["\n".join(span_lines(c)) for c in contexts_of(spans, merge)])


@dataclass
class Meter:
    """What prompts of one question cost; documents that stay as they are between two trials are measured once."""

    question: str
    budget: Budget
    merge: bool = True
    _known: dict = field(default_factory=dict)

    def _known_of(self, what: Callable[[list[Span]], int], spans: list[Span]) -> int:
        key = what.__name__, *sorted((s["document_id"], s["block_id"], s["start"], s["end"], s["rank"]) for s in spans)
        if key not in self._known:
            self._known[key] = what(spans)
        return self._known[key]

    def _tokens(self, spans: list[Span]) -> int:
        """Of one context: all spans of a document, or, unmerged, a single span."""
        return sum(map(self.budget.count, ("[1]", *span_lines(united(spans)))))

    def _characters(self, spans: list[Span]) -> int:
        """Of the evidence of one document."""
        return sum(len(s["text"]) for s in united(spans))

    def measure(self, spans: list[Span]) -> tuple[int, int]:
        """Tokens of the prompt, and characters of its evidence without what stands in it twice."""
        documents: dict[str, list[Span]] = defaultdict(list)
        for s in spans:
            documents[s["document_id"]].append(s)
        characters = sum(self._known_of(self._characters, d) for d in documents.values())
        if not self.budget.additive:
            return self.budget.count(render(self.question, spans, self.merge)), characters
        if "frame" not in self._known:
            self._known["frame"] = sum(map(self.budget.count, prompt(self.question, []).split("\n")))
        contexts = documents.values() if self.merge else ([s] for s in spans)
        return self._known["frame"] + sum(self._known_of(self._tokens, c) for c in contexts), characters


# --- choosing ---


def pack_units(question: str, units: list[Span], budget: Budget, expand: bool = True, merge: bool = True, reserve: int = 0, strict: bool = False) -> tuple[list[Span], list[dict]]:
    """Seeds first, all that fit in rank order; then per seed its first expansion that adds text and still fits.

    ``reserve`` tokens are kept free, for an answer. With ``strict`` a seed that doesn't fit is an error, else it is
    left out. Gives the chosen units and the expansions taken.
    """
    limit, meter = budget.max_input_tokens - reserve, Meter(question, budget, merge)
    chosen: list[Span] = []
    for u in sorted(units, key=lambda u: u["rank"]):
        if meter.measure([*chosen, u])[0] <= limit:
            chosen.append(u)
        elif strict:
            raise ValueError(f"seed {u['rank']} exceeds the budget")
    if not expand:
        return chosen, []
    taken, held = [], meter.measure(chosen)[1]
    for at, seed in enumerate(tuple(chosen)):
        for wide in seed.get("expansions") or ():
            if budget.count(wide["text"]) > budget.max_parent_tokens:
                continue
            trial = chosen.copy()
            trial[at] = seed | {k: wide[k] for k in ("start", "end", "text", "chunk_ids")}
            tokens, characters = meter.measure(trial)
            if characters > held and tokens <= limit:
                chosen, held = trial, characters
                taken.append({"rank": seed["rank"], "kind": wide["kind"]})
                break
    return chosen, taken


def add_options(question: str, chosen: list[Span], candidates: Iterable[list[Span]], budget: Budget, most: int) -> tuple[list[Span], list[tuple[int, int]]]:
    """Chosen spans and, of each candidate in order, its first option that adds text and fits, until ``most`` are added; and which (candidate, option) were."""
    meter, spans, added = Meter(question, budget), list(chosen), []
    held = meter.measure(spans)[1]
    for i, options in enumerate(candidates):
        if len(added) == most:
            break
        for k, option in enumerate(options):
            tokens, characters = meter.measure([*spans, option])
            if characters > held and tokens <= budget.max_input_tokens:
                spans, held = [*spans, option], characters
                added.append((i, k))
                break
    return spans, added


def drop_expansions(question: str, units: list[Span], seeds: list[Span], budget: Budget, reserve: int) -> list[Span]:
    """Training evidence: put seeds back for expanded units from the last rank on until the prompt leaves ``reserve`` tokens; then drop from the end, but for one."""
    meter, limit, units = Meter(question, budget), budget.max_input_tokens - reserve, list(units)
    fits = lambda: meter.measure(units)[0] <= limit
    for i in reversed(range(len(units))):
        if fits():
            return units
        units[i] = seeds[i]
    while len(units) > 1 and not fits():
        units.pop()
    return units


def pack_whole(question: str, contexts: list[str], budget: Budget) -> list[int]:
    """Positions of whole contexts kept greedily in order; one that doesn't fit is skipped, later ones may fit."""
    kept: list[int] = []
    for i in range(len(contexts)):
        if budget.count(prompt(question, [contexts[j] for j in (*kept, i)])) <= budget.max_input_tokens:
            kept.append(i)
    return kept


def longest_prefix(question: str, text: str, budget: Budget) -> str:
    """The longest prefix of a context that fits by itself, by binary search; "" if none does."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        if budget.count(prompt(question, [text[:mid]])) <= budget.max_input_tokens:
            low = mid
        else:
            high = mid - 1
    return text[:low]


def pack_or_prefix(question: str, contexts: list[str], budget: Budget) -> list[str]:
    """:func:`pack_whole`, or if none fits the longest prefix of the first context that does."""
    kept = [contexts[i] for i in pack_whole(question, contexts, budget)]
    return kept or [p for c in contexts[:1] if (p := longest_prefix(question, c, budget))]


# --- operators ---

_SPAN = "rank:int,document_id:string,block_id:string,article_number:string,article_title:string,source_title:string,document_number:string,start:int,end:int,text:string,chunk_ids:array<string>"
SPAN = f"struct<{_SPAN}>"
UNIT = f"struct<{_SPAN},expansions:array<struct<kind:string,start:int,end:int,text:string,chunk_ids:array<string>>>>"
_PACKED = "query string, prompt string, n_tokens int, n_units int, n_expanded int, n_skipped int, body_chars int"
_ADDED = "query string, prompt string, n_tokens int, n_units int, added array<string>, body_chars int"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types, strict=True)], names=list(names))


def _per_row(row: Callable[..., tuple], columns: tuple[str, ...], schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([row(*values) for values in zip(*(b.column(c).to_pylist() for c in columns), strict=True)], schema)

    return run


def pack(units: DataFrame, budget: Budget | None = None, expand: bool = True, merge: bool = True) -> DataFrame:
    """``query, prompt, n_tokens, n_units, n_expanded, n_skipped, body_chars`` of :func:`context.seed_units`. A null question or null units give an empty prompt's figures."""
    budget = budget or Budget()

    def row(query, question, own):
        chosen, taken = pack_units(question or "", own or [], budget, expand, merge)
        text = render(question or "", chosen, merge)
        return query, text, budget.count(text), len(chosen), len(taken), len(own or ()) - len(chosen), sum(len(s["text"]) for s in united(chosen))

    return _units(units).mapInArrow(_per_row(row, ("query", "question", "units"), _PACKED), _PACKED)


def _units(units: DataFrame, *more: str) -> DataFrame:
    return units.select(F.col("query").cast("string").alias("query"), "question", F.col("units").cast(f"array<{UNIT}>").alias("units"), *more)


def pack_segments(units: DataFrame, ranked: DataFrame, budget: Budget | None = None, most: int = 3) -> DataFrame:
    """Seeds and the first ``most`` segments (``query, position, segment`` of :func:`context.selective_segments`, reranked) that add text and fit: ``query, prompt, n_tokens, n_units, added, body_chars``.

    Segments of a query are bounded by its seeds' expansions, so they may meet in one row. Seeds that don't fit together are left out as in :func:`pack_units`.
    """
    budget = budget or Budget()
    per = ranked.groupBy(F.col("query").cast("string").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("segment").cast(SPAN).alias("segment")))), lambda s: s["segment"]).alias("segments"))

    def row(query, question, own, segments):
        chosen, _ = pack_units(question or "", own or [], budget, expand=False)
        spans, added = add_options(question or "", chosen, [[s] for s in segments or ()], budget, most)
        text = render(question or "", spans)
        names = [f"{s['document_id']}:{s['start']}-{s['end']}" for s in (segments[i] for i, _ in added)]
        return query, text, budget.count(text), len(spans), names, sum(len(s["text"]) for s in united(spans))

    return _units(units).join(per, "query", "left").mapInArrow(_per_row(row, ("query", "question", "units", "segments"), _ADDED), _ADDED)


def pack_references(units: DataFrame, candidates: DataFrame, budget: Budget | None = None, most: int = 2, max_chars: int = 6000, max_tokens: int = 1200) -> DataFrame:
    """Widened evidence and the first ``most`` articles it refers to that fit: ``query, prompt, n_tokens, n_units, added, body_chars``.

    ``candidates``: ``query, position, trigger_document, trigger_start, trigger_end`` (null: the question itself) and
    ``options``, the target's spans in order of trial. A candidate counts if its trigger lies in the evidence that was
    chosen; options beyond ``max_chars`` or ``max_tokens``, or that add no text, are passed over. References of a query's hits are few and meet in one row.
    """
    budget = budget or Budget()
    c = candidates.select(F.col("query").cast("string").alias("query"), F.struct("position", "trigger_document", "trigger_start", "trigger_end", F.col("options").cast(f"array<{SPAN}>").alias("options")).alias("c"))
    per = c.groupBy("query").agg(F.sort_array(F.collect_list("c")).alias("candidates"))

    def row(query, question, own, found):
        chosen, _ = pack_units(question or "", own or [], budget)
        base = united(chosen)
        inside = lambda c: c["trigger_document"] is None or any(s["document_id"] == c["trigger_document"] and s["start"] <= c["trigger_start"] and c["trigger_end"] <= s["end"] for s in base)
        options = [[o for o in c["options"] or () if len(o["text"]) <= max_chars and budget.count(o["text"]) <= max_tokens] for c in found or () if inside(c)]
        spans, added = add_options(question or "", chosen, options, budget, most)
        text = render(question or "", spans)
        names = [f"{o['document_id']}:{o['start']}-{o['end']}" for o in (options[i][k] for i, k in added)]
        return query, text, budget.count(text), len(spans), names, sum(len(s["text"]) for s in united(spans))

    return _units(units).join(per, "query", "left").mapInArrow(_per_row(row, ("query", "question", "units", "candidates"), _ADDED), _ADDED)


def pack_contexts(rows: DataFrame, budget: Budget | None = None, prefix: bool = False) -> DataFrame:
    """``query, prompt, n_tokens, kept, cut_chars`` of ``query, question, contexts`` (array of strings): whole contexts greedily, by their positions from 0.

    With ``prefix``, where no context fits whole, the longest prefix of the first that does: ``kept`` is empty and
    ``cut_chars`` its length, else null. Null contexts count as empty strings, a null question as an empty one.
    """
    budget = budget or Budget()
    schema = "query string, prompt string, n_tokens int, kept array<int>, cut_chars int"

    def row(query, question, contexts):
        question, contexts = question or "", [c or "" for c in contexts or ()]
        kept = pack_whole(question, contexts, budget)
        part = longest_prefix(question, contexts[0], budget) if prefix and contexts and not kept else ""
        text = prompt(question, [contexts[i] for i in kept] or ([part] if part else []))
        return query, text, budget.count(text), kept, len(part) if part else None

    return rows.select(F.col("query").cast("string").alias("query"), "question", "contexts").mapInArrow(_per_row(row, ("query", "question", "contexts"), schema), schema)

"""Broken prompt and response pairs (problem 4).

Copies are found by aligning the tokens of answer and question: shingle containment picks the
candidates, a longest common subsequence aligns them and shows what else the answer holds. Refusals
are aligned sentence by sentence against templates of declining: orders of the parts that words and
phrases play (speaker, negation, act, what was asked).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode_text import fold_words, invisible, strip_markup
from quillspark.llm.langid import FREQUENT_WORDS, language, latin_evidence, script

# Fixed values, folded (no case, no accents). PLACEHOLDERS: whole answers that say nothing.
PLACEHOLDERS = "n a|na|null|none|nil|nan|undefined|tbd|tba|todo|empty|blank|missing|no answer|no data|not available|not applicable|khong ap dung|chua co|chua co du lieu|chua cap nhat|dang cap nhat|chua tra loi|khong co cau tra loi|khong co du lieu|bo trong|de trong|xxx|placeholder|lorem ipsum".split("|")
# REFUSAL_TERMS: words and phrases by the part they play where someone declines: speaker, another's doing, negation, what is
# not done, passively too, what was asked for, a reply, its possibility, out of bounds, declining. A phrase may play several parts.
REFUSAL_TERMS = {
    "speaker": "toi|chung toi|minh|em|tro ly|he thong|chatbot|mo hinh ngon ngu|i|we|me|my|our|us|this assistant|this system|this service|the system|this model|language model|automated assistant|je|nous",
    "someone": "ban|anh|chi|ong|ba|ho|nguoi|ben|you|he|she|they|one|who|vous|il|elle|ils",
    "negation": "khong|chua|khong the|chua the|khong duoc|khong duoc phep|khong du|khong co|khong co du|chua co du|khong co tham quyen|cannot|can not|can t|could not|couldn t|not|unable|unable to|not able to|do not|don t|does not|doesn t|won t|will not|may not|not allowed to|not permitted to|no|never|lack|ne peux pas|ne peut pas|ne pouvons pas|ne suis pas",
    "act": "tra loi|giup|giup do|ho tro|cung cap|tu van|dua ra|dap ung|thuc hien|giai dap|binh luan|phan tich|ket luan|answer|help|assist|provide|give|advise|comment|discuss|respond|reply|offer|address|handle|process|support|share|say|repondre|aider|donner|fournir|commenter",
    "passive": "answered|handled|dealt with|dealt|addressed|discussed|processed|resolved|supported|covered|duoc tra loi|duoc giai dap|duoc ho tro|duoc xu ly",
    "asked": "cau hoi|noi dung|yeu cau|loai yeu cau|van de|chu de|dieu nay|viec nay|ket luan|y kien|loi khuyen|thong tin|question|questions|request|requests|topic|matter|query|inquiry|issue|that|this|it|advice|opinion|information|conclusion|cette question|cette demande",
    "reply": "reply|answer|response|advice|opinion|comment|information|help|assistance|cau tra loi|loi khuyen|y kien",
    "possible": "possible|available|given|provided|offered|permitted|allowed",
    "outside": "ngoai pham vi|vuot pham vi|vuot qua pham vi|ngoai kha nang|vuot qua kha nang|ngoai tham quyen|outside|beyond|hors de",
    "decline": "tu choi|xin tu choi|xin phep khong|xin duoc tu choi|decline|refuse|refrain|abstain|rather not|prefer not|decliner|refuser",
}
# COURTESIES: what goes along with it and has no substance. PLAIN: what may stand around it besides.
COURTESIES = (
    "xin loi|rat tiec|that tiec|thanh that|cam on ban|mong ban|thong cam|vui long|hay lien he|co quan chuc nang|hay hoi|hoi luat su|luat su|hoi cau khac|thu lai sau|toi hieu|moi quan tam|tu dong|tran trong|chuc ban|"
    "sorry|apologise|apologize|apologies|afraid|regret|regrettably|unfortunately|thank|thanks|asking|understand|concern|please|consult|lawyer|try|competent office|contact|again|regards|wishes|something else|desole|malheureusement|merci"
).split("|")
PLAIN = "a able ai am an as ask automated because concerns discuss enough expert have here kind legal law like ll m main now may must need permitted phap ly qualified re regarding right s sort sufficient take t type ve viec voi would xin loai kien ket luan phap".split()
#: Orders of parts in which a sentence declines: with its speaker, or without one, where nothing else may be said beside it.
SPOKEN = (("speaker", "negation", "act"), ("speaker", "decline"), ("outside", "speaker"), ("speaker", "outside"))
UNSPOKEN = (("negation", "act", "asked"), ("asked", "negation", "passive"), ("asked", "negation", "act"), ("negation", "reply", "possible"), ("decline", "act"))
#: Share of a sentence's words that may have substance besides.
SUBSTANCE_SHARE = 0.5
# Names that a copied question may go under, and abbreviations after which no sentence ends.
COPY_LABELS = "cau hoi ban hoi hoi noi dung de bai theo cau hoi cua ban nhac lai question q the you asked your query prompt asked is was dap tra loi answer a".split()
OPEN_ABBREVIATIONS = "tp q p tr nxb ts ths pgs gs bs ks ls mr mrs ms dr st no nos art arts sec fig vol cf pp ch par approx vs eg ie prof inc jr ref тт ст п гл см напр ул г руб".split()
CAPITAL_ABBREVIATIONS = "no nos sec fig par ref ch".split()  # words of their own unless capitalised
PAIRS = "“” ‘’ «» 「」 『』 （） () [] 【】 {}".split()

SHINGLE = 4
#: Shares of the question that an answer must align with, and words that it may hold besides.
COPY_SHARE, COPY_REST = 0.8, 5
#: Evidence for another language than the question's (log probabilities), in sum and per word.
LEAST_EVIDENCE, LEAST_PER_WORD = 2.0, 0.4
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")

_SENTENCE_END = re.compile(r"[.!?;:…]+\s+|\n+")
_TERMINAL = frozenset(".!?…。！？।．｡")
_UNPUNCTUATED = re.compile("[ก-๛]")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, markup, punctuation or a placeholder."""
    words = fold_words(answer)
    return not words or " ".join(words) in PLACEHOLDERS


def align(question: list[str], answer: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as (question, answer) positions, in the answer as early as can be.

    Bit vectors: after the last ``k`` words of the question, bit ``c`` of vector ``k`` is 0 where one more word of the
    answer's end makes the subsequence longer. Every so many vectors are kept, the others made again where they are needed.
    """
    n, m = len(question), len(answer)
    full, masks = (1 << m) - 1, {}
    for j, w in enumerate(answer):
        masks[w] = masks.get(w, 0) | 1 << (m - 1 - j)

    def after(v: int, k: int) -> int:
        met = v & masks.get(question[n - k], 0)
        return (v + met | v - met) & full

    every = math.isqrt(n) + 1
    kept, v = [full], full
    for k in range(1, n + 1):
        v = after(v, k)
        if k % every == 0:
            kept.append(v)
    blocks: dict[int, list[int]] = {}

    def length(k: int, c: int) -> int:
        at = k // every
        if at not in blocks:
            blocks.pop(at + 2, None)
            block = [kept[at]]
            for x in range(at * every + 1, min(n, at * every + every - 1) + 1):
                block.append(after(block[-1], x))
            blocks[at] = block
        return c - (blocks[at][k - at * every] & ((1 << c) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if question[i] == answer[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(n - i - 1, m - j) == length(n - i, m - j):
            i += 1
        else:
            j += 1
    return out


def _close(a: str, b: str) -> bool:
    """The same word but for a slip: same letters in another order, or one letter more, less or other."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2:
        return False
    if sorted(a) == sorted(b):
        return True
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def _repeats(question: list[str], answer: list[str]) -> bool:
    """The answer is the question's own words, once or more, and labels; words of unspaced scripts go by characters."""
    question, answer = ([x for w in words for x in (w if _UNSPACED.search(w) else (w,))] for words in (question, answer))
    n, at, copies = len(question), 0, 0
    while n and at < len(answer):
        if answer[at : at + n] == question:
            at, copies = at + n, copies + 1
        elif answer[at] in COPY_LABELS:
            at += 1
        else:
            return False
    return copies > 0


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The answer only gives the question back: relabelled, repeated or respelled, but nothing more; questions under three words aren't taken as respelled."""
    if len(question) < 3:
        return _repeats(question, answer)
    if len(answer) < COPY_SHARE * len(question):
        return False
    k = min(SHINGLE, len(question))
    shingles = {tuple(question[i : i + k]) for i in range(len(question) - k + 1)}
    if sum(tuple(answer[i : i + k]) in shingles for i in range(len(answer) - k + 1)) < 0.2 * len(shingles):
        return False
    rest, copies, left = 0, 0, answer
    while left:
        if len(left) < COPY_SHARE * len(question):
            # a copy that breaks off, or what the answer says besides
            hits = align(question[: len(left) + 2], left) if copies else []
            rest += len(left) if len(hits) < COPY_SHARE * len(left) else len(left) - len(hits)
            break
        hits = align(question, left[: len(question) + 2 * COPY_REST + 10])
        if len(hits) < COPY_SHARE * len(question):
            rest += len(left)
            break
        first, last = hits[0][1], hits[-1][1]
        used = {j for _, j in hits}
        seen = {i for i, _ in hits}
        lost = [w for i, w in enumerate(question) if i not in seen]
        extra = [w for w in (left[j] for j in range(first, last + 1) if j not in used) if not any(_close(w, x) for x in lost)]
        rest += len(extra) + len([w for w in left[:first] if w not in COPY_LABELS and not any(_close(w, x) for x in lost)])
        # what follows may be the question's own last words, respelled
        tail = len(question) - 1 - hits[-1][0]
        while tail and last + 1 < len(left) and any(_close(left[last + 1], x) for x in lost):
            last, tail = last + 1, tail - 1
        left, copies = left[last + 1 :], copies + 1
    return copies > 0 and rest <= min(COPY_REST, 0.2 * len(question) + 1)


@lru_cache(None)
def _parts_of_phrases() -> tuple[dict[tuple[str, ...], frozenset], int]:
    parts: dict[tuple[str, ...], set] = {}
    for part, phrases in REFUSAL_TERMS.items():
        for p in phrases.split("|"):
            parts.setdefault(tuple(p.split()), set()).add(part)
    for p in COURTESIES:
        parts.setdefault(tuple(p.split()), set()).add("courtesy")
    for w in (*PLAIN, *FREQUENT_WORDS["vi"].split(), *FREQUENT_WORDS["en"].split(), *FREQUENT_WORDS["fr"].split()):
        parts.setdefault((w,), set()).add("plain")
    return {p: frozenset(x) for p, x in parts.items()}, max(map(len, parts))


@lru_cache(None)
def _turns() -> frozenset:
    """Words without which no sentence declines."""
    return frozenset(p.split()[0] for part in ("negation", "outside", "decline") for p in REFUSAL_TERMS[part].split("|")) | {"xin"}


def _tagged(words: list[str]) -> list[tuple[frozenset, int]]:
    """The parts that each phrase of a sentence plays, longest phrases first, and its number of words; nothing known: substance."""
    known, longest = _parts_of_phrases()
    out, at = [], 0
    while at < len(words):
        for k in range(min(longest, len(words) - at), 0, -1):
            parts = known.get(tuple(words[at : at + k]))
            if parts:
                break
        out.append((parts or frozenset(), k))
        at += k
    return out


def aligned(tags: list[tuple[frozenset, int]], template: tuple[str, ...]) -> tuple[int, int] | None:
    """The tightest stretch of a tagged sentence that holds the template's parts in order, or None."""
    best = None
    for end in (i for i, (t, _) in enumerate(tags) if template[-1] in t):
        at, k = end, len(template) - 2
        while k >= 0:
            at = next((i for i in range(at - 1, -1, -1) if template[k] in tags[i][0]), -1)
            if at < 0:
                break
            k -= 1
        else:
            if best is None or end - at < best[1] - best[0]:
                best = at, end
    return best


def _declines(tags: list[tuple[frozenset, int]]) -> bool:
    substance = [k if not t else 0 for t, k in tags]
    if sum(substance) > SUBSTANCE_SHARE * sum(k for _, k in tags):
        return False
    for template in SPOKEN:
        found = aligned(tags, template)
        if found and ("decline" in template and _negated(tags, found) or "act" in template and any("decline" in t and "negation" not in t for t, _ in tags[found[0] : found[1]])):
            continue
        # between speaker and negation stands nothing else, as it would be what the negation is about
        if found and not any(substance[found[0] : found[1]]) and not any("someone" in t and "speaker" not in t for t, _ in tags[found[0] + 1 : found[1]]):
            return True
    if any(substance):
        return False
    for template in UNSPOKEN:
        found = aligned(tags, template)
        if found and not any("someone" in t for t, _ in tags[: found[1]]) and not ("decline" in template and _negated(tags, found)):
            return True
    return False


def _negated(tags: list[tuple[frozenset, int]], found: tuple[int, int]) -> bool:
    """Whether what declines is itself denied: "cannot refuse"."""
    at = next(i for i in range(found[0], found[1] + 1) if "decline" in tags[i][0])
    return any("negation" in t for t, _ in tags[:at])


def is_refusal(answer: str, words: list[str] | None = None) -> bool:
    """Declines and holds no sentence of substance: every sentence aligns with a template of :data:`SPOKEN` or :data:`UNSPOKEN`, or is a courtesy."""
    if _turns().isdisjoint(fold_words(answer) if words is None else words):
        return False
    declines = False
    for part in _SENTENCE_END.split(strip_markup(answer)):
        own = fold_words(part)
        if not own:
            continue
        tags = _tagged(own)
        if _declines(tags):
            declines = True
        elif not (any("courtesy" in t for t, _ in tags) and sum(k for t, k in tags if not t) <= SUBSTANCE_SHARE * len(own)):
            return False
    return declines


def is_truncated(answer: str) -> bool:
    """Stops before its last sentence is finished."""
    text = invisible().sub("", strip_markup(answer)).rstrip()
    for pair in PAIRS:
        if text.count(pair[0]) > text.count(pair[1]):
            return True
    if text.count('"') % 2:
        return True
    bare = text.rstrip("”’»」』）)]】}\"' \t\n\xa0")
    if not bare:
        return False
    if bare[-1] not in _TERMINAL:
        # closed by a bracket or quote around a finished statement: "(Art. 4)"
        if len(bare) < len(text) and text[-1] in ")）]】":
            opened = max(text.rfind(x) for x in "(（[【")
            return not (opened > 0 and text[:opened].rstrip()[-1:] in _TERMINAL)
        return not _UNPUNCTUATED.search(bare[-1])
    if bare[-1] == "." and not bare.endswith(".."):
        *before, last = bare[:-1].split() or [""]
        if not before or before[-1][-1:] in _TERMINAL:  # a sentence of one word: "No."
            return False
        word = "".join(c for c in unicodedata.normalize("NFC", last.lower()) if c.isalnum() or c == ".")
        if word in OPEN_ABBREVIATIONS:
            return not (word in CAPITAL_ABBREVIATIONS and last[:1].islower())
        return len(last) == 1 and last.isupper()
    return False


def is_foreign(question: str | None, question_lang: str | None, answer: str, words: list[str]) -> bool:
    """In another language than the question: by script, and in Latin script by the evidence that its words give, in sum and on average, for another language against the question's."""
    lang, share = script(answer)
    if lang is None:
        return False
    asked, sure = language(question)
    if asked is None or sure < 0.2:
        asked = (question_lang or "").strip().lower() or None
    if not asked:
        return False
    if lang != "latin":
        return lang != asked and share >= 0.3
    evidence = latin_evidence(answer, words)
    more = share * (max(evidence.values()) - evidence.get(asked, 0.0))  # a question in another script: any language that shows
    return more >= LEAST_EVIDENCE and more >= LEAST_PER_WORD * sum(not w[0].isdigit() for w in words)


def defect(question: str | None, answer: str | None, question_lang: str | None) -> str | None:
    """The one defect of a pair, or None: empty, refusal, copied, language, truncated, in this order."""
    a = fold_words(answer)
    if not a or " ".join(a) in PLACEHOLDERS:
        return "empty"
    if is_refusal(answer, a):
        return "refusal"
    if is_copy(fold_words(question), a):
        return "copied"
    bare = strip_markup(answer)
    if is_foreign(strip_markup(question or ""), question_lang, bare, a):
        return "language"
    return "truncated" if is_truncated(bare) else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("question").to_pylist(), b.column("answer").to_pylist(), b.column("lang").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([defect(*r) for r in rows], pa.string())], names=["id", "defect"])


def broken_pairs(pairs: DataFrame, record_id: Column, question: Column, answer: Column, lang: Column) -> DataFrame:
    """``id, defect``: the defective pairs, one row per row of the input at most.

    Null and empty answers are ``empty`` whatever the question; with a null question an answer can't be a copy,
    and its language is held against ``lang``; with that null or unknown too, nothing is said of language.
    Rows with a null id are left out; a repeated row comes out as often as it came in; an empty table gives none.
    Extra columns are ignored. Whole texts are read, row by row, without a shuffle.
    """
    src = pairs.select(record_id.alias("id"), question.cast("string").alias("question"), answer.cast("string").alias("answer"), lang.cast("string").alias("lang")).where("id is not null")
    return src.mapInArrow(_judge, f"id {dict(src.dtypes)['id']}, defect string").where(F.col("defect").isNotNull())

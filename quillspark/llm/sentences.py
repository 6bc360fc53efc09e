"""Sentence units across languages and scripts (problem 8).

One pass over all texts counts, per language, how each word stands to periods: with and without one,
and what follows. Log-likelihood ratios over these counts give abbreviations before digits and before
names, collocations of an abbreviation with a capitalised word, and sentence starters; no list of
abbreviations is given. A second pass classifies each period with them. Marks of scripts without
case, blanks in Thai, quotations, list numbers and layout are settled by rule.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode_text import INLINE_TAGS, TAG, invisible
from quillspark.llm.langid import language
from quillspark.llm.visual_form import skeleton
from quillspark.session import cut_lineage

#: Largest model (rows of abbreviations, starters and collocations) that is sent to every worker; a larger one is joined to the texts.
MODEL_ROWS = 200_000
#: Counts that a task holds before it sends them on.
FLUSH_COUNTS = 300_000
#: Critical value of the log-likelihood ratio (chi-square, one degree of freedom, p = 0.001).
SIGNIFICANT = 10.83
#: Least length of the lines of a wrapped paragraph.
WRAPPED_WIDTH = 50

TERMINAL = ".!?…。！？।॥．｡؟"
CLOSERS = "”’»」』）)]】}\"'"
_OPENERS = "“‘«「『（([【{\"'‹"
_DASHES = "—–-•*·―"
# A line break of the text, or one of markup (vertical tab).
_BREAK = re.compile(r"(?:\x0b *\n?|\n)")
_BLANK_LINE = re.compile(r"(?:\x0b *\n?|\n) *(?:\x0b *\n?|\n)[\x0b\n ]*")
_BR_TAGS = frozenset(("br", "wbr"))
_INLINE = frozenset(INLINE_TAGS)
_BLANKS = re.compile(r"[\t\x0c\x1c-\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_LINE_ENDS = re.compile(r"\r\n|[\r\x85\u2028\u2029]")
_WIDE = re.compile("[Ａ-Ｚａ-ｚ０-９]+")
_ENTITY = re.compile(r"&(?:nbsp|ensp|emsp|thinsp|#160|#xa0);", re.I)
_SPECIAL = re.compile(r"[<&\r\t\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000０-９Ａ-Ｚａ-ｚ]")
_THAI = re.compile("[ก-๎]")
#: Spans taken as a whole, then marks, then (for Thai) blanks between letters.
_SPANS = r"“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】"
_SCAN = re.compile(rf"({_SPANS})|([.!?…]+[”’»)\]}}'\"]*(?= |$)|[。！？｡।॥．؟]+[.!?…。！？｡।॥．؟]*[”’»」』）)\]】]*|…{{2,}})")
_SCAN_THAI = re.compile(_SCAN.pattern + r"|((?<=[ก-๎ฯๆ]) +(?=[ก-๎]))")
_TOKEN_BEFORE = re.compile(r"[^\s(（“«「\"'‘\[]*$")
#: What numbers a unit: a number or single letter, maybe after one word where a line begins.
_LABEL = re.compile(r"[\W_]*(?:\d+(?:\.\d+)*[^\W\d_]?|[^\W\d_]|[IVXLC]+)$")
_LINE_LABEL = re.compile(r"[\W_]*(?:[^\W\d_][^\s\d.]* +)?\d+(?:\.\d+)*[^\W\d_]?$")
# Lines of tables and indexes, marks that fill them, what opens a list item, and an end of a sentence inside a line.
_LEADER = re.compile(r"(?:\.{4,}|…{2,}|(?:\. ){4,}|_{4,}) *[\divxlc]* *$", re.I)
_CELLS = re.compile(r"[\d|.…_=+·-]")
_ITEM = re.compile(r" *(?:[-–—•*·+] |(?:\d+(?:\.\d+)*|[^\W\d_]|[ivxlc]+)[.)] )", re.I)
_INNER_END = re.compile(r"[.!?…。！？।॥．؟][”’»」』）)\]】\"']* *\w")
_PUNCTUATION = ".,;:!?…()[]{}“”‘’«»\"'-–—/|*•·"


def _pad(m: re.Match) -> str:
    name = (m[1] or "").lower()
    if name in _INLINE:
        return "\u2060" * len(m[0])
    if name in ("td", "th"):  # cells of one table line
        return " " * len(m[0])
    return ("\x0b" if name in _BR_TAGS else "\n\n").ljust(len(m[0]))[: len(m[0])]


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without markup and invisible characters, blanks and width made plain; and the place of each character (None: its own)."""
    if _SPECIAL.search(text):
        if "<" in text:
            text = TAG.sub(_pad, text)
        if "&" in text:
            text = _ENTITY.sub(lambda m: " " * len(m[0]), text)
        text = _LINE_ENDS.sub(lambda m: " \n" if len(m[0]) == 2 else "\n", text)
        text = _BLANKS.sub(" ", text)
        text = _WIDE.sub(lambda m: "".join(chr(ord(c) - 0xFEE0) for c in m[0]), text)
    if text.isascii() or not invisible().search(text):
        return text, None
    kept, places, at = [], [], 0
    for m in invisible().finditer(text):
        kept.append(text[at : m.start()])
        places += range(at, m.start())
        at = m.end()
    kept.append(text[at:])
    places += range(at, len(text))
    return "".join(kept), places


def _finished(line: str) -> bool:
    return line.rstrip().rstrip(CLOSERS + " ")[-1:] in TERMINAL


def _goes_on(line: str, following: str) -> bool:
    """A line break inside a sentence: nothing ends before it, or a word in lower case follows."""
    return not _finished(line) or _next_word(following, 0)[0] == "l"


def _table_line(line: str) -> bool:
    """A row of cells, a line with leader dots, or one that is mostly digits and rules (a short one may be the number on which a sentence ends)."""
    if line.count("|") >= 2 or _LEADER.search(line):
        return True
    visible = line.replace(" ", "")
    return len(line) >= WRAPPED_WIDTH and 2 * len(_CELLS.findall(visible)) >= len(visible)


def _inside_phrase(line: str, following: str) -> bool:
    """A line break that surely stands inside a phrase: letters before it, and a word in lower case, or in a script without case, after it that labels nothing."""
    before = line.rstrip().rstrip(CLOSERS + " ,")[-1:]
    if _finished(line) or not (before.isalnum() or unicodedata.category(before or " ")[0] == "M") or _ITEM.match(following):
        return False
    kind = _next_word(following, 0)[0]
    return kind == "l" or kind == "c" and not before.isdigit()


def _wrapped(lines: list[str]) -> list[bool] | None:
    """For each line break of a paragraph wrapped at a fixed width whether it ends a unit; None: the text isn't wrapped, each does."""
    # such a paragraph has no short lines and breaks inside sentences (Thai shows no ends to tell it by)
    if len(lines) < 2 or min(map(len, lines[:-1])) < WRAPPED_WIDTH:
        return None
    tables = [_table_line(x) for x in lines]
    ends = [a or b for a, b in zip(tables, tables[1:])]
    prose = [(a, b) for a, b, end in zip(lines, lines[1:], ends) if not end]
    inside = [(a, b) for a, b in prose if _inside_phrase(a, b)]
    if not inside or 4 * len(inside) < len(prose) or sum(_goes_on(a, b) for a, b in prose) < 0.8 * len(prose):
        return None
    # without lower case only sentences that end inside lines tell a paragraph from a list
    if not any(_next_word(b, 0)[0] == "l" for _, b in inside) and not any(_INNER_END.search(x) for x, table in zip(lines, tables) if not table):
        return None
    return ends


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """Stretches that no unit crosses, with their starts; line breaks that end nothing are blanks in them."""
    if _BLANK_LINE.search(text.strip()):
        cuts = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)]
    else:
        cuts = [(m.start(), m.end()) for m in _BREAK.finditer(text)]
        if cuts and "\x0b" not in text and not _THAI.search(text):
            bounds = [0, *(x for cut in cuts for x in cut), len(text)]
            full = [k for k, (a, b) in enumerate(zip(bounds[::2], bounds[1::2])) if text[a:b].strip()]
            ends = _wrapped([text[bounds[2 * k] : bounds[2 * k + 1]] for k in full])
            if ends is not None:
                cuts = [cuts[k - 1] for k, end in zip(full[1:], ends) if end]
    at = 0
    for start, end in cuts:
        yield at, _BREAK.sub(lambda x: " " * len(x[0]), text[at:start])
        at = end
    yield at, _BREAK.sub(lambda x: " " * len(x[0]), text[at:])


def _next_word(block: str, at: int) -> tuple[str, str]:
    """The class of what follows and the word: '' nothing, l lower, U upper, d digit, c letter without case, o other."""
    n = len(block)
    while at < n and (block[at] == " " or block[at] in _OPENERS):
        at += 1
    if at >= n:
        return "", ""
    end = at
    while end < n and (block[end].isalnum() or block[end] == "-" or ord(block[end]) > 0x2FF and block[end] not in " “”’»…—–。，"):
        end += 1
    word = block[at:end]
    c = block[at]
    if len(word) == 1 and c.isalpha() and block[end : end + 1] == ".":
        word = "."  # an initial, whatever its letter
    if c.isdigit():
        return "d", word
    if c.isupper():
        return "U", word
    if c.islower():
        return ("U", word) if len(word) > 1 and word[1:2].isupper() else ("l", word)
    return ("c", word) if c.isalpha() else ("o", word)


class Model:
    """Per language: abbreviations before digits, before names, and of scripts without case; sentence starters."""

    def __init__(self, rows: list[tuple[str, str, str, str]]) -> None:
        self.sets: dict[tuple[str, str], set] = defaultdict(set)
        for lang, kind, a, b in rows:
            self.sets[lang, kind].add((a, b) if b else a)

    def has(self, lang: str, kind: str, what) -> bool:
        """In the language's own statistics; or, for a word they say nothing of (a line in another language), in any other's."""
        if what in self.sets.get((lang, kind), ()):
            return True
        return what in self.sets.get(("*", kind), ()) and what not in self.sets.get((lang, "plain"), ())


def _periods(block: str, lang: str) -> Iterator[tuple]:
    """All places where a unit may end: (kind, end, start of the mark)."""
    scan = _SCAN_THAI if _THAI.search(block) else _SCAN
    for m in scan.finditer(block):
        if m[1]:
            inner = m[1][1:-1].rstrip()
            if inner[-1:] in TERMINAL and inner:
                yield "span", m.end(), m.start()
        elif m[2]:
            yield "mark", m.end(), m.start()
        else:
            yield "thai", m.start(), m.start()


def units(block: str, lang: str, model: Model) -> Iterator[int]:
    """Ends of the units of a block, each just after its last visible character."""
    begin, first = 0, True
    for kind, end, start in _periods(block, lang):
        if end <= begin:
            continue
        if kind != "thai" and not _ends(block, begin, first, kind, start, end, lang, model):
            continue
        visible = block[begin:end].rstrip()
        if visible.strip():
            yield begin + len(visible)
            begin, first = end, False
    visible = block[begin:].rstrip()
    if visible.strip():
        yield begin + len(visible)


def _ends(block: str, begin: int, first: bool, kind: str, start: int, end: int, lang: str, model: Model) -> bool:
    rest = block[end:].lstrip(" ") if kind == "span" else None
    follow, word = _next_word(block, end)
    if not follow:
        return True
    if kind == "span":
        c = rest[:1]
        if not c or c in ",;:，；、。.!?！？" or c in _DASHES:
            return False
        if follow == "l":
            return False
        if "぀" <= c <= "ゟ":  # Japanese goes on with a particle
            return False
        return block[end : end + 1] == " " or follow == "c" and block[start] not in "(（[【"
    mark = block[start:end]
    if mark[0] in "。！？｡।॥．؟" or mark[:2] == "……":
        return True
    if block[end : end + 1] not in (" ", ""):
        return False
    bare = mark.rstrip(CLOSERS)
    if follow == "l":
        return False
    if follow == "o" and block[end:].lstrip(" ")[:1] in ",;:":
        return False
    if bare != ".":
        if block[end:].lstrip(" ")[:1] in _DASHES and len(bare) < len(mark):
            return False
        return True
    before = block[begin:start]
    if _LABEL.match(before) or first and _LINE_LABEL.match(before):
        return False
    token = _TOKEN_BEFORE.search(before)[0]
    if token[:1].isdigit() or not token:
        return not _list_number(before, token)
    token, word = word_key(token), word_key(word)
    if follow == "d":
        return not model.has(lang, "digit", token)
    if follow == "c" or follow == "o":
        return not (model.has(lang, "caseless", token) or follow == "o" and model.has(lang, "name", token))
    if model.has(lang, "collocation", (token, word.lower())):
        return False
    if len(token) == 1 and token.isupper():
        return model.has(lang, "starter", word.lower())
    if model.has(lang, "name", token):
        return model.has(lang, "mixed", token) and model.has(lang, "starter", word.lower())
    return True


def _list_number(before: str, token: str) -> bool:
    """A number right after a colon, semicolon or comma numbers the item that follows."""
    return bool(token) and token.isdigit() and len(token) <= 3 and before[: -len(token)].rstrip()[-1:] in (":", ";", "：", "；")


# --- learning ---


@lru_cache(1 << 17)
def word_key(word: str) -> str:
    """One key for all codings of a word."""
    return word if word.isascii() else skeleton(word)


def count_text(text: str, lang: str, n: Counter, inside: Counter) -> None:
    """Add what one text says of its words: keys (lang, what, word, next word); ``inside`` counts lower-case words inside sentences, the most of them."""
    text, _ = plain(text)
    for _, block in blocks(text):
        # sure: whether the next word surely begins a sentence; None: nobody knows
        sure, prev, first = True, None, True
        for token in block.split():
            if sure is False and prev is None and token.islower() and token.isalpha():
                inside[token] += 1
                continue
            core = token.strip(_PUNCTUATION)
            if not core:
                if token[-1] in "!?…":
                    sure, prev = True, None
                continue
            tail = token[token.rfind(core) + len(core) :]
            if not core.isascii():
                core = word_key(core)
            c, word = core[0], core.lower()
            shouted = len(core) > 1 and core.isupper()
            upper = c.isupper() or len(core) > 1 and c.islower() and core[1].isupper()
            if prev is not None:
                # the word stands after a period that may end a sentence
                follow = "d" if c.isdigit() else "U" if upper else "l" if c.islower() else "c"
                n[lang, "p" + follow, prev, ""] += 1
                if follow == "U":
                    n[lang, "pair", prev, "." if len(core) == 1 and tail[:1] == "." else word] += 1
            elif (len(core) == 1 or first and c.isdigit()) and tail[:1] in (")", "."):
                pass  # a label or an initial
            elif sure is not None and token[0] not in _OPENERS and not shouted and c.isalpha():
                n[lang, ("start" if sure else "mid") if upper else "low", word, ""] += 1
            last = token[-1]
            prev = None
            if first and (len(core) == 1 or c.isdigit()) and tail[:1] == ")":
                first = False
                continue
            if tail == "." and not c.isdigit():
                label = first and len(core) == 1
                prev = None if label else core
                sure = True if label else None
            elif tail == ".":
                sure = True if first else None  # a list number keeps what follows at the start
            else:
                sure = None if last == ":" else last in "!?" or (tail[:1] in (".", "!", "?", "…") and last in "”»")
                if c.isalpha() and "." not in tail:
                    n[lang, "bare", core, ""] += 1
            first = False
        if prev is not None:
            n[lang, "pend", prev, ""] += 1


@lru_cache(1 << 12)
def _lang_column(lang: str) -> str:
    lang = lang.strip().lower().split("-")[0]
    return lang if lang.isalpha() and 2 <= len(lang) <= 3 and lang not in ("und", "mul", "zxx", "unk", "nan") else ""


def effective_language(lang: str | None, text: str) -> str:
    return (_lang_column(lang) if lang else "") or language(text)[0] or "und"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    inside: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, words in inside.items():
            for token, k in words.items():
                word = word_key(token)
                n[lang, "low", word.lower(), ""] += k
                n[lang, "bare", word, ""] += k
        inside.clear()
        keys = list(n)
        cols = list(zip(*keys, strict=True)) or [(), (), (), ()]
        out = [*(pa.array(c, pa.string()) for c in cols), pa.array([n[k] for k in keys], pa.int64())]
        n.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "what", "word", "next", "n"])

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            lang = effective_language(lang, text)
            count_text(text, lang, n, inside[lang])
        if len(n) + sum(map(len, inside.values())) > FLUSH_COUNTS:
            yield flush()
    yield flush()


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of k1 of n1 against k2 of n2."""
    xlogp = lambda k, n, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.ln(1 - p)).otherwise(0.0)
    p = (k1 + k2) / (n1 + n2)
    out = 2 * (xlogp(k1, n1, k1 / n1) + xlogp(k2, n2, k2 / n2) - xlogp(k1, n1, p) - xlogp(k2, n2, p))
    return F.when((n1 > 0) & (n2 > 0), out).otherwise(0.0)


def learn(documents: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``lang, kind, a, b``: the model, from counts over all texts."""
    src = documents.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).where("length(text) > 0")
    counts = cut_lineage(src.mapInArrow(_count_batches, "lang string, what string, word string, next string, n long").groupBy("lang", "what", "word", "next").agg(F.sum("n").alias("n")))
    total = lambda *what: F.coalesce(F.sum(F.when(F.col("what").isin(*what), F.col("n"))), F.lit(0)).cast("double")
    # words by case: a starter is capitalised where a sentence surely begins, a name in the middle too
    words = counts.where("what in ('start', 'mid', 'low')").groupBy("lang", "word").agg(total("start").alias("s"), total("mid").alias("m"), total("low").alias("l"))
    all_words = words.groupBy("lang").agg(F.sum("s").alias("all_s"), F.sum("m").alias("all_m"))
    words = words.join(F.broadcast(all_words), "lang").withColumn("llr", _llr(F.col("s"), F.col("s") + F.col("m"), F.col("all_s") - F.col("s"), F.col("all_s") + F.col("all_m") - F.col("s") - F.col("m")))
    starter = (F.col("s") > 4 * F.col("m")) & ((F.col("llr") > SIGNIFICANT) | (F.col("l") > F.col("m")) & (F.col("s") >= 2))
    words = cut_lineage(words.select("lang", F.col("word").alias("next"), starter.alias("starter")))
    pairs = counts.where("what = 'pair'").select("lang", "word", "next", "n").join(words, ["lang", "next"], "left")
    by_type = pairs.groupBy("lang", "word").agg(F.sum(F.when(F.col("starter"), F.col("n")).otherwise(0)).cast("double").alias("ns"), F.sum(F.when(F.col("starter"), 0).otherwise(F.col("n"))).cast("double").alias("nn"))
    types = counts.where("what in ('pd', 'pU', 'pl', 'pc', 'pend', 'bare')").groupBy("lang", "word").agg(*(total(k).alias(k) for k in ("pd", "pU", "pl", "pc", "pend", "bare")))
    types = types.join(by_type, ["lang", "word"], "left").fillna(0, ["ns", "nn"]).withColumn("p", F.col("pd") + F.col("pU") + F.col("pl") + F.col("pc"))
    per_lang = types.groupBy("lang").agg(*(F.sum(c).alias(f"all_{c}") for c in ("p", "pd", "ns", "nn", "pl", "pend", "bare")))
    t = types.join(F.broadcast(per_lang), "lang")  # one row per language
    c = F.col
    other = lambda x: c(f"all_{x}") - c(x)
    with_period = c("p") + c("pend")
    # attachment: an abbreviation stands with its period more than other words do, weighed down by its length
    attached = _llr(with_period, with_period + c("bare"), other("p") + other("pend"), other("p") + other("pend") + other("bare")) * F.exp(-F.length(F.regexp_replace("word", r"\.", "")) / 2)
    bound = (with_period > c("bare")) & (attached > 0.3)
    digit = (bound | (c("pd") > 0.9 * c("p"))) & (c("pd") > 0.5 * c("p")) & (_llr(c("pd"), c("p"), other("pd"), other("p")) > SIGNIFICANT)
    named = bound & (c("nn") > c("ns")) & (_llr(c("nn"), c("nn") + c("ns"), other("nn"), other("nn") + other("ns")) > SIGNIFICANT)
    caseless = bound & (c("pc") > 0.5 * c("p")) & (c("p") >= 3) & (c("bare") < 0.1 * with_period)
    flags = {"digit": digit, "name": named, "caseless": caseless, "mixed": named & (c("ns") > 0.1 * (c("ns") + c("nn")))}
    t = cut_lineage(t.select("lang", "word", (with_period + c("bare")).alias("seen"), "pU", *(((c("p") > 0) & f).alias(k) for k, f in flags.items())))
    row = lambda df, lang, kind, a, b=F.lit(""): df.select(lang.alias("lang"), kind.alias("kind"), a.alias("a"), b.alias("b"))
    kinds = lambda *names: F.explode(F.filter(F.array(*(F.when(c(k), k) for k in names)), lambda x: x.isNotNull()))
    abbreviations = t.where("digit or name or caseless")
    own = row(t, c("lang"), kinds(*flags), c("word"))
    # what is an abbreviation somewhere serves texts of other languages too, except where the word is known as an ordinary one
    anywhere = row(abbreviations, F.lit("*"), kinds("digit", "name", "caseless"), c("word")).distinct()
    ordinary = t.where("seen >= 5 and not coalesce(digit or name or caseless, false)").join(abbreviations.select("word").distinct(), "word", "left_semi")
    # collocations: an abbreviation and a capitalised word that follow each other more than their counts explain
    seen = counts.where("what in ('pair', 'start', 'mid')").groupBy("lang", F.when(c("what") == "pair", c("next")).otherwise(c("word")).alias("next")).agg(F.sum("n").cast("double").alias("nx"))
    per_lang = counts.where("what in ('pair', 'start', 'mid')").groupBy("lang").agg(F.sum("n").cast("double").alias("all_n"))
    n = c("n").cast("double")
    more = (n >= 3) & ~F.coalesce("starter", F.lit(False)) & (n / c("pU") > c("nx") / c("all_n")) & (_llr(n, c("pU"), c("nx") - n, c("all_n") - c("pU")) > SIGNIFICANT)
    together = pairs.join(abbreviations.select("lang", "word", "pU"), ["lang", "word"]).join(seen, ["lang", "next"]).join(F.broadcast(per_lang), "lang").where(more)
    parts = [own, anywhere, row(ordinary, c("lang"), F.lit("plain"), c("word")), row(words.where("starter"), c("lang"), F.lit("starter"), c("next")), row(together, c("lang"), F.lit("collocation"), c("word"), c("next"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


# --- applying ---


@lru_cache(2)
def _model(packed: bytes) -> Model:
    return Model(pickle.loads(packed))


def unit_ends(text: str | None, lang: str | None, model: Model) -> list[int]:
    """Ends of all units of a text, as positions in it."""
    if not text:
        return []
    lang = effective_language(lang, text)
    flat, places = plain(text)
    ends = []
    for at, block in blocks(flat):
        if block.isspace() or not block:
            continue
        ends += [at + e for e in units(block, lang, model)]
    return ends if places is None else [places[e - 1] + 1 for e in ends]


def _unit_batches(packed: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, numbers, ends = [], [], []
            own = b.column("model").to_pylist() if packed is None else None
            for i, (text, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)):
                model = _model(packed) if own is None else Model([(r["lang"], r["kind"], r["a"], r["b"]) for r in own[i] or ()])
                e = unit_ends(text, lang, model)
                keep += [i] * len(e)
                numbers += range(len(e))
                ends += e
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array(numbers, pa.int32()), pa.array(ends, pa.int32())], names=["id", "unit_no", "end_char"])

    return run


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a text on which its model may turn, those before a period and those after one (with "" beside them), and both together."""
    for b in batches:
        ids, langs, words, following = [], [], [], []
        for i, (text, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)):
            lang, flat = effective_language(lang, text), plain(text)[0]
            tokens = set()
            for _, block in blocks(flat):
                for kind, end, start in _periods(block, lang):
                    if kind == "mark":
                        token, word = word_key(_TOKEN_BEFORE.search(block[:start])[0]), word_key(_next_word(block, end)[1]).lower()
                        tokens |= {(token, ""), (word, ""), (token, word)}
            ids += [i] * len(tokens)
            langs += [lang] * len(tokens)
            words += [a for a, _ in tokens]
            following += [b for _, b in tokens]
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(following, pa.string())], names=["id", "lang", "a", "b"])


def sentence_units(documents: DataFrame, doc_id: Column, text: Column, lang: Column, model: DataFrame | None = None) -> DataFrame:
    """``id, unit_no, end_char``: the units of every text, ``end_char`` in code points of the text as it is.

    Null and empty texts and texts without a visible character have no unit; a null or unknown language is told
    from the text; rows repeated under one id give their units once per row; an empty table gives none and learns nothing. A text without
    any mark is one unit per line or block. Extra columns are ignored. ``model`` is what :func:`learn` gives;
    by default it is learned from the same texts. It is sent to the workers if it is small, else joined to the texts.
    """
    src = documents.select(doc_id.alias("id"), text.cast("string").alias("text"), lang.cast("string").alias("lang")).where("id is not null and length(text) > 0")
    kind = dict(src.dtypes)["id"]
    schema = f"id {kind}, unit_no int, end_char int"
    model = learn(documents, text, lang) if model is None else model
    rows = [tuple(r) for r in model.select("lang", "kind", "a", "b").limit(MODEL_ROWS + 1).collect()]
    if len(rows) <= MODEL_ROWS:
        return src.mapInArrow(_unit_batches(pickle.dumps(sorted(rows))), schema)
    # on both words: a collocation comes only to texts that hold it, so what a text collects is bounded by its own words
    tokens = src.mapInArrow(_token_batches, f"id {kind}, lang string, a string, b string").distinct()
    both = tokens.alias("t").join(model.alias("m"), F.expr("t.a = m.a and t.b = m.b and m.lang in (t.lang, '*')"))
    own = both.groupBy("id").agg(F.collect_list(F.struct("m.lang", "m.kind", "m.a", "m.b")).alias("model"))
    return src.join(own, "id", "left").select("id", "text", "lang", "model").mapInArrow(_unit_batches(None), schema)

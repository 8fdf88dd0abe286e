"""Answer extraction from free text, as one vectorised function over (text, labels, option texts).

Words are mapped to one symbol each and the grammar is a regular expression over the symbol string, so a
reply is scanned once. ``|`` marks a word that ended its sentence. A route for replies that are nothing but
a letter stays in the JVM.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, MISSING, AMBIGUOUS = "parse_ok", "parse_missing", "parse_ambiguous"
PARSE_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in ("final_choice", "status", "normalized_text", "reason")])

# Fixed values of the answer grammar.
_ROLES = {
    "f": ["final"],
    "a": ["answer"],
    "p": ["pick"],
    "n": ["choice", "selection", "vote"],
    "v": ["choose", "select"],
    "t": ["therefore", "thus"],
    "c": ["is", "was"],
    "g": ["go", "goes"],
    "w": ["with"],
    "o": ["option", "letter"],
    "h": ["probably", "likely", "maybe", "perhaps", "possibly", "certainly", "definitely", "clearly", "apparently", "arguably"],
}
_STRIPPED = "()[]{}<>\".,:;!?'“”‘’"
_WRAPPING_TAGS = "answer|final|choice"

_ROLE_OF = {word: role for role, words in _ROLES.items() for word in words}
_CHAIN = r"L(?:k(?:k\|?)*L)*"
_GRAMMAR = re.compile(
    rf"(?P<selection>(?:f\|?a|[apn]\|?c|[apvt]|g\|?w)\|?(?:h\|?)?{_CHAIN})|(?P<reference>o\|?(?:c\|?)?{_CHAIN})|(?P<weak>{_CHAIN})"
)
_WRAPPED = re.compile(
    r"\*\*(.*\S.*)\*\*|__(.*\S.*)__|`(.*\S.*)`|“(.*\S.*)”|\"(.*\S.*)\"|‘(.*\S.*)’|'(.*\S.*)'" + rf"|<(?P<tag>(?i:{_WRAPPING_TAGS}))>(.*\S.*)</(?P=tag)>",
    re.DOTALL,
)
_CUE = re.compile(r"(?:(?:my|the|final)\s+)*(?:answer|choice|selection|pick|vote)\b[\s:.\-]*(?:is|was)?\s*(?:the\s+)?", re.I)
_COPULA = re.compile(r".+?\b(?:is|was|are|were|(?:could|may|might|would|should|must)\s+be)\s+(?:the\s+){0,2}", re.I)
_APPOSITION = re.compile(r"(?:\s*[,;:\-–—]\s*\S+){1,2}\s*[.!]?")
_COMMITS = (
    re.compile(r"(?:(?:i|we|you)\s+)?(?:(?:will|shall|'ll|’ll)\s+)?(?:choose|pick|select)\s+(?:the\s+)?(.+?)\s*[.!]?", re.I),
    re.compile(r"(?:(?:i|we|you|he|she|it|they)\s+)?go(?:es)?\s+with\s+(?:the\s+)?(.+?)\s*[.!]?", re.I),
)
_SENTENCES = re.compile(r"(?<=[.!?)])\s+")


class Parsed(NamedTuple):
    """Outcome of one reply."""

    final_choice: str | None
    status: str
    normalized_text: str
    reason: str


def normalise_output(text: object) -> str:
    """Trimmed, white space collapsed; anything but a string is empty."""
    return " ".join(text.split()) if isinstance(text, str) else ""


def unwrap(text: str) -> str:
    """Take off marks and answer tags that enclose the whole text, as long as something is inside."""
    while (m := _WRAPPED.fullmatch(text)) is not None:
        text = next(g for g in m.groups()[:7] + m.groups()[8:] if g is not None).strip()
    return text


def letter_answer(text: str, labels: frozenset[str]) -> Parsed:
    """The letter a text commits to: the last selection, else the last mention; several joined letters are ambiguous."""
    if not text:
        return Parsed(None, MISSING, text, "nothing to parse")
    words = text.split()
    bare = [w.strip(_STRIPPED) for w in words]
    if len(words) == 1 and bare[0].upper() in labels:
        return Parsed(bare[0].upper(), OK, text, "single letter")
    symbols, word_at = [], []
    for i, (w, b) in enumerate(zip(words, bare)):
        role = "L" if b.upper() in labels else "k" if b in ("or", "and") else _ROLE_OF.get(b.lower(), "e" if b else "_")
        mark = role + "|" if w.endswith((".", "!", "?")) else role
        symbols.append(mark)
        word_at.extend([i] * len(mark))
    last = last_selection = None
    for m in _GRAMMAR.finditer("".join(symbols)):
        found = [bare[word_at[k]].upper() for k in range(m.start(), m.end()) if m.string[k] == "L"]
        last = (m.lastgroup, found[0], len(set(found)) > 1)
        if m.lastgroup == "selection":
            last_selection = last
    kind, head, compound = last_selection or last or (None, None, False)
    if kind is None:
        return Parsed(None, MISSING, text, "no letter")
    if compound:
        return Parsed(None, AMBIGUOUS, text, "several letters")
    return Parsed(head, OK, text, f"{kind} letter")


_short_letter_answer = lru_cache(maxsize=65_536)(letter_answer)
#: Replies of at most this length recur often enough to be remembered; memory stays bounded.
_SHORT = 100


def _mentions(option: str, text: str) -> bool:
    """Whether the option occurs, in any letter case, not inside a run of ASCII letters and digits."""
    word = lambda c: c.isascii() and c.isalnum()
    o, t = option.lower(), text.lower()
    at = t.find(o)
    while at >= 0:
        end = at + len(o)
        if not (at and word(t[at - 1])) and not (end < len(t) and word(t[end])):
            return True
        at = t.find(o, at + 1)
    return False


def _states(option: str, text: str, sentence: str, commits: list[str]) -> bool:
    """Whether the text gives the option as its answer, in one of five forms."""
    if text == option:
        return True
    low = option.lower()
    for body in {text, text[:-1].rstrip() if text.endswith((".", "!")) else text}:
        if body.lower().endswith(low) and _CUE.fullmatch(body[: len(body) - len(option)]):
            return True
    if sentence.lower().endswith(low) and _COPULA.fullmatch(sentence[: len(sentence) - len(option)]):
        return True
    if text.startswith(option) and _APPOSITION.fullmatch(text[len(option) :]):
        return True
    return low in commits


def option_answer(text: str, options: dict[str, str]) -> Parsed:
    """The option whose text is given as the answer; a mere mention never decides, several mentions are ambiguous."""
    if not text:
        return Parsed(None, MISSING, text, "nothing to parse")
    parts = [s for s in _SENTENCES.split(text) if s.strip()]
    sentence = (parts[-1] if parts else text).rstrip(".!?").strip()
    first = next((m for p in _COMMITS if (m := p.fullmatch(text))), None)
    commits = [first.group(1).strip().lower()] if first else []
    texts = {label: o for label, t in options.items() if (o := normalise_output(t))}
    stated = [label for label, o in texts.items() if _states(o, text, sentence, commits)]
    if len(stated) == 1:
        return Parsed(stated[0], OK, text, "option text")
    if stated or sum(_mentions(o, text) for o in texts.values()) > 1:
        return Parsed(None, AMBIGUOUS, text, "several option texts")
    return Parsed(None, MISSING, text, "no answer form")


def parse_answer(raw_text: object, options: dict[str, str]) -> Parsed:
    """Normalise, unwrap, look for a letter, then for an option text. Never raises on any reply."""
    text = unwrap(normalise_output(raw_text))
    read = _short_letter_answer if len(text) <= _SHORT else letter_answer
    got = read(text, frozenset(options))
    return option_answer(text, options) if got.status == MISSING else got


@F.pandas_udf(PARSE_TYPE)
def parse_udf(raw_text: pd.Series, labels: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Vectorised :func:`parse_answer` over parallel arrays of labels and texts."""
    rows = [parse_answer(r, dict(zip(l if l is not None else [], t if t is not None else []))) for r, l, t in zip(raw_text, labels, texts)]
    return pd.DataFrame(rows, columns=["final_choice", "status", "normalized_text", "reason"])


def single_letter(raw_text: Column, labels: Column) -> Column:
    """The letter of a reply that is one letter between strip characters, else null; decided without Python."""
    core = F.upper(F.regexp_extract(raw_text, r"(?U)^\s*[\(\)\[\]\{\}<>\".,:;!?'“”‘’]*([A-Za-z])[\(\)\[\]\{\}<>\".,:;!?'“”‘’]*\s*$", 1))
    return F.when(F.array_contains(labels, core), core)


def parse_replies(df: DataFrame, raw_text: str = "raw_text", options: str = "options") -> DataFrame:
    """``df`` plus final_choice, status, normalized_text and reason.

    ``options`` is array<struct<label, text, ...>>; null options are no options. Rows that a single letter
    decides never reach Python: both routes are unions of disjoint filters, as a Python function under a
    condition would run for every row.
    """
    labels = F.coalesce(F.transform(F.col(options), lambda o: o["label"]), F.array().cast("array<string>"))
    marked = df.withColumn("__letter", F.coalesce(single_letter(F.col(raw_text), labels), F.lit("")))
    quick = marked.where(F.col("__letter") != "").select(
        *df.columns, F.col("__letter").alias("final_choice"), F.lit(OK).alias("status"), F.trim(F.regexp_replace(raw_text, r"(?U)\s+", " ")).alias("normalized_text"), F.lit("single letter").alias("reason")
    )
    texts = F.coalesce(F.transform(F.col(options), lambda o: o["text"]), F.array().cast("array<string>"))
    slow = marked.where(F.col("__letter") == "").withColumn("__p", parse_udf(F.col(raw_text), labels, texts)).select(*df.columns, "__p.*")
    return quick.unionByName(slow)

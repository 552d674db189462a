"""Language and lexicon levels of a text of Latin letters in one pass, in Arrow batches.

Spark interprets what is done to each element of an array, so that the expressions of
``langid`` and ``compress`` cost microseconds a token. Here a token costs a few look-ups.
Only characters that Java and Python class alike are taken (``OTHER`` has the rest); a
text with any other gets null, and its caller takes the expressions. Both give the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, filterfalse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from winnower.functions.lexicon import DEFAULT
from winnower.operators.compress import ENDS, GROUPS, NOUN_CAPITALS, SUFFIXES
from winnower.operators.langid import LEAST_RATIO

#: Beyond Latin letters up to U+024F, dashes, quotes and the euro; U+0130 becomes two characters in lower case.
OTHER = re.compile(r"[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
# among these characters the numbers that are no decimal digits are superscripts and fractions, and no mark is
_LETTERS = re.compile(r"[^\W\d_²³¹¼½¾]+(?:'[^\W\d_²³¹¼½¾]+)?")
_WORD = re.compile(r"\w+(?:'\w+)?")
#: The most usual signs: blanks in their place leave the words as they are.
_SIGNS = (",", ";", ":", ")", '"')


@lru_cache(maxsize=1)
def _known() -> dict[str, list[tuple[int, bool]]]:
    """For each function word its languages, and whether it is a marker of them."""
    out: dict[str, list[tuple[int, bool]]] = {}
    for k, lang in enumerate(DEFAULT.languages):
        marks = set(DEFAULT.exclusive[lang])
        for w in dict.fromkeys(DEFAULT.function[lang]):
            out.setdefault(w, []).append((k, w in marks))
    return out


@lru_cache(maxsize=32)
def _words(kind: str, lang: str) -> frozenset[str]:
    return frozenset(getattr(DEFAULT, kind).get(lang, ()))


def _spaced(text: str, signs: tuple[str, ...]) -> str:
    for sign in signs:
        text = text.replace(sign, " ")
    return text


def language(text: str) -> str:
    """As ``langid.detect``."""
    known, langs = _known(), DEFAULT.languages
    tokens = _spaced(text.lower(), (*_SIGNS, ".")).split()
    # what isn't of letters alone is cut into tokens; the others are tokens
    odd = _LETTERS.findall(" ".join(filterfalse(str.isalpha, tokens)))
    raw, marks = [0] * len(langs), [0] * len(langs)
    for w, n in Counter(filter(known.__contains__, chain(filter(str.isalpha, tokens), odd))).items():
        for k, marker in known[w]:
            raw[k] += n
            marks[k] += n * marker
    most, top = max(marks), max(raw)
    if not top:
        return "eng"
    if most and marks.count(most) == 1:
        return langs[marks.index(most)]
    n = sum(map(str.isalpha, tokens)) + len(odd)
    return "eng" if top / n < LEAST_RATIO else langs[raw.index(top)]


def _capital(w: str) -> bool:
    return "A" <= w[0] <= "Z" if w[0] < "\x80" else unicodedata.category(w[0]) in ("Lu", "Lt")


@lru_cache(maxsize=32)
def _suffixes(lang: str) -> tuple[str, ...]:
    return tuple(s for _, suffixes in SUFFIXES[GROUPS[lang]] for s in suffixes.split())


def _descriptive(w: str, lang: str) -> bool:
    n = len(w)
    return n >= 4 and w.endswith(_suffixes(lang)) and any(w.endswith(s) and n > len(s) + least for least, suffixes in SUFFIXES[GROUPS[lang]] for s in suffixes.split())


class Forms:
    """What becomes of words in a language at a level."""

    def __init__(self, level: str, lang: str) -> None:
        self.light, self.hard, self.lang = level == "light", level == "aggressive", lang
        self.names = lang not in NOUN_CAPITALS
        self.negation = _words("negation", lang)
        self.dropped = (_words("function", lang) | (_words("generic", lang) if self.hard else frozenset())) - self.negation

    def weak(self, low: str) -> bool:
        return (len(low) <= 1 or _descriptive(low, self.lang)) and low not in self.negation

    def form(self, w: str, first: bool) -> str | None:
        """The form of any word, where a sentence begins (``first``) or inside; null for one that is dropped."""
        low = w.lower()
        if self.light:
            return None if low in self.dropped else w
        if low in self.negation or (not first and self.names and low != w and _capital(w)):
            return w
        return None if low in self.dropped or (w.isascii() and w.isdigit()) or (self.hard and self.weak(low)) else low

    def lower(self, words: list[str]) -> Iterable[str]:
        """The forms of words of letters in lower case, all inside a sentence."""
        kept = filterfalse(self.dropped.__contains__, words)
        return filterfalse(self.weak, kept) if self.hard else kept


_forms = lru_cache(maxsize=32)(Forms)


def chosen(text: str, level: str, lang: str) -> list[str]:
    """The forms of the tokens that ``compress`` keeps; no sign is, nor a word that begins with a low line."""
    forms = _forms(level, lang)
    out: list[str] = []
    text = _spaced(text, _SIGNS)
    for end in ENDS[1:]:
        text = text.replace(end, ENDS[0])
    for sentence in text.split(ENDS[0]):
        words = sentence.split()
        if not words:
            continue
        if "".join(words).isalpha():
            first, rest = words[0], words[1:]
            if (form := forms.form(first, True)) is not None:
                out.append(form)
            tail = " ".join(rest)
            out += forms.lower(rest) if tail == tail.lower() else filter(None, (forms.form(w, False) for w in rest))
        else:
            words = [w for w in _WORD.findall(sentence) if w[0] != "_"]
            out += filter(None, (forms.form(w, not k) for k, w in enumerate(words)))
    return out


def squeeze(text: str | None, level: str) -> str | None:
    """A text in its language at a level, light, semantic or aggressive; null for a text with other characters."""
    if not text:
        return ""
    if not text.isascii() and OTHER.search(text):
        return None
    lang = language(text)
    kept = chosen(text, level, lang)
    if not kept and level == "aggressive":
        kept = chosen(text, "semantic", lang)
    return " ".join(kept)


@lru_cache(maxsize=1)
def _squeeze_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([squeeze(t, x) for t, x in zip(texts, levels, strict=True)], dtype=object)

    return run


def squeezed(text: str | Column, level: str | Column) -> Column:
    return _squeeze_udf()(text, level)

"""Tokenizers, token counters and text splitters as columns.

Each pattern is given twice: for Java (Spark) and, where an oracle needs it, for
RE2 (DuckDB), whose classes are ASCII unless spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_OR_SIGN = r"(?U)[\p{L}\p{M}\p{N}_]+(?:'[\p{L}\p{M}\p{N}_]+)?|[^\w\s]"
WORD_OR_SIGN_RE2 = r"[\p{L}\p{M}\p{N}_]+(?:'[\p{L}\p{M}\p{N}_]+)?|[^\p{L}\p{M}\p{N}_\s\v\x{85}\p{Z}]"
LETTERS = r"(?U)[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)?"
LETTERS_RE2 = r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)?"
TERMS = r"[\p{L}\p{M}\p{N}]+"
SUMMARY_WORDS = r"(?U)[^\W\d_]+"
BAG = r"(?U)\b\w{3,}\b"
PIECE = r"[a-zA-Z0-9_]+|(?U:\S)"
BLANK_RUN = r"(?U)\s{4,}"

# These pieces count as one token.
SHORT_PIECES = "a an the in on at to of is it as by or be if do no up we he she me my i u x y z & |".split()
# Factors and prices of the models (USD per 1,000 tokens).
MODEL_FACTORS = {"gpt-4": 1.0, "gpt-3.5": 1.0, "llama-3": 1.05, "gemma-3": 1.02, "claude-3": 0.98}
MODEL_PRICES = {"gpt-4": 0.03, "gpt-3.5": 0.0015, "claude-3": 0.015, "llama-3": 0.0, "gemma-3": 0.0}
USD_TO_EUR = 0.92
ENERGY_MWH, CO2_MG = 0.005, 0.4


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def extract(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def compression_tokens(text: str | Column) -> Column:
    return extract(text, WORD_OR_SIGN)


def is_punct(token: Column) -> Column:
    """A token is punctuation unless it begins with a letter or a digit."""
    return ~token.rlike(r"^[\p{L}\p{Nd}\p{No}]")


def detector_tokens(text: str | Column) -> Column:
    return extract(F.lower(_col(text)), LETTERS)


def retrieval_tokens(text: str | Column) -> Column:
    return extract(F.lower(_col(text)), TERMS)


def summary_tokens(text: str | Column, stop: list[str]) -> Column:
    words = extract(F.lower(_col(text)), SUMMARY_WORDS)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def bag_tokens(text: str | Column) -> Column:
    return extract(F.lower(_col(text)), BAG)


def chars_count(text: str | Column) -> Column:
    """A quarter of the code points."""
    return F.floor(F.length(_col(text)) / 4).cast("long")


def words_count(text: str | Column) -> Column:
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")).cast("long")


def pieces_count(text: str | Column) -> Column:
    """The approximation of byte-pair tokens; a blank text has none."""
    t = _col(text)
    sizes = F.transform(
        extract(t, PIECE),
        lambda w: F.when(F.lower(w).isin(SHORT_PIECES) | (F.length(w) <= 4), 1).when(F.length(w) <= 8, 2).otherwise(2 + F.floor((F.length(w) - 5) / 4).cast("int")),
    )
    runs = F.transform(extract(t, BLANK_RUN), lambda w: F.floor(F.length(w) / 4).cast("int"))
    total = F.aggregate(F.concat(sizes, runs), F.lit(0), lambda a, x: a + x)
    return F.when(t.isNull() | ~t.rlike(r"(?U)\S"), 0).otherwise(F.greatest(F.lit(1), total)).cast("long")


def model_count(pieces: Column, model: str) -> Column:
    return (pieces * F.lit(MODEL_FACTORS[model])).cast("long")


def cost_usd(tokens: Column, model: str) -> Column:
    return tokens / 1000 * F.lit(MODEL_PRICES[model])


def energy_mwh(saved: Column) -> Column:
    return saved * ENERGY_MWH


def metrics_line(before: Column, after: Column, price: float = MODEL_PRICES["gpt-4"]) -> Column:
    """``before=.. after=.. saved=.. (p%) ~$c``"""
    saved = F.greatest(F.lit(0), before - after)
    percent = F.when(before > 0, F.round(saved * 100.0 / before, 1)).otherwise(0.0)
    return F.format_string("before=%d after=%d saved=%d (%.1f%%) ~$%.6f", before, after, saved, percent, saved / 1000 * price)


def blocks(text: str | Column) -> Column:
    """Blocks between blank lines, without empty ones."""
    return F.filter(F.split(_col(text), r"\n\s*\n"), lambda b: F.trim(b) != "")


def chat_blocks(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), r"\n{2,}"), lambda b: F.trim(b) != "")


# Fixed value: the marks that are dropped.
MARKDOWN = r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|>\s+)|\*\*|__|`{1,3}"


def strip_markdown(text: str | Column) -> Column:
    """Without heading, list and quote marks, strong emphasis and backticks."""
    return F.regexp_replace(_col(text), MARKDOWN, "")


#: Python's line ends; a trailing one opens no line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def lines(text: str | Column) -> Column:
    t = _col(text)
    parts = F.split(t, LINE_END)
    return F.when(t == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: A typed splitter: the alternatives in order of priority.
KINDS = [
    ("URL", r"https?://\S+|www\.\S+"),
    ("Email", r"(?U:[\w.+-])+@(?U:[\w-])+\.[a-zA-Z]{2,}"),
    ("Number", r"\p{Nd}+(?:[.,]\p{Nd}+)*"),
    ("Word", r"[\p{L}\p{M}][\p{L}\p{M}']*"),
    ("Whitespace", r"[\p{Zs}\t]"),
    ("Newline", r"\n"),
    ("Punctuation", r"[\p{P}\p{S}]"),
    ("Emoji", r"[\x{1F601}-\x{10FFFF}]"),
    ("Other", r"(?s:.)"),
]


def typed_tokens(text: str | Column) -> Column:
    """An array of (text, type) that covers the whole text."""
    t = extract(text, "|".join(f"(?:{p})" for _, p in KINDS))

    def kind(w: Column) -> Column:
        out = F.lit("Other")
        for name, p in reversed(KINDS[:-1]):
            out = F.when(w.rlike(f"^(?:{p})$"), name).otherwise(out)
        # most tokens are a blank or a word, which no kind before them matches
        return F.when(w == " ", "Whitespace").when(w.rlike(f"^(?:{dict(KINDS)['Word']})$"), "Word").otherwise(out)

    return F.transform(t, lambda w: F.struct(w.alias("text"), kind(w).alias("type")))

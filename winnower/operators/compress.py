"""Lexicon compression of texts at six levels, as column expressions.

Words that begin a sentence are marked in the text by a regular expression before
it is cut into tokens, so that the protection of names needs no second pass. The
per-token decisions are lookups in hashed literal sets, chosen by language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from winnower.functions import tokens as T
from winnower.functions.lexicon import DEFAULT, GENERIC_FALLBACK, ISO1, Lexicon
from winnower.operators import langid
from winnower.sources import tables
from winnower.sources.scratch import small_batches

LEVELS = ["none", "light", "semantic", "aggressive", "statistical", "syntactic"]
ENDS = [".", "!", "?", "…"]
MARK = "\u0001"
_SKIP = r"(?:[^\p{L}\p{M}\p{N}_.!?…]|[_\p{M}][\p{L}\p{M}\p{N}_]*+(?:'[\p{L}\p{M}\p{N}_]+)?)*+"
SENTENCE_START = rf"((?:\A|[.!?…]){_SKIP})(?=[\p{{L}}\p{{N}}])"
MARKED_TOKEN = rf"{MARK}?(?:{T.WORD_OR_SIGN})"
#: Languages that capitalise all nouns: a capital tells nothing there.
NOUN_CAPITALS = ["deu"]

# Suffixes of descriptive words by group of languages, with the letters that must precede them.
GROUPS = {"eng": "en", "ita": "romance", "fra": "romance", "spa": "romance", "por": "romance", "deu": "germanic", "nld": "germanic"}
SUFFIXES = {
    "en": [(1, "ly wise wards"), (2, "ous ive able ible ful less ic ant ent ish like some")],
    "romance": [(2, "mente oso osa ivo iva abile ibile ale ese ista")],
    "germanic": [(2, "lich ig isch sam bar haft los voll arm reich")],
}


def marked_tokens(text: str = "text") -> Column:
    """Tokens, those that begin a sentence with a mark in front."""
    bare = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))
    return T.extract(F.regexp_replace(bare, SENTENCE_START, f"$1{MARK}"), MARKED_TOKEN)


def one_of(w: Column, words: Iterable[str]) -> Column:
    """As ``isin``; the words go to the JVM together, since one call for each takes seconds a plan."""
    words = list(words)
    if not words:
        return F.lit(False)
    jvm = SparkContext._active_spark_context._jvm
    return ClassicColumn(w._jc.isInCollection(jvm.java.util.Collections.list(jvm.java.util.StringTokenizer(MARK.join(words), MARK))))


def _by_language(lang: Column, table: dict[str, Iterable[str]], w: Column, default: Iterable[str] = ()) -> Column:
    out = one_of(w, default)
    for iso3, words in sorted(table.items()):
        out = F.when(lang == iso3, one_of(w, words)).otherwise(out)
    return out


def is_number(w: Column) -> Column:
    return w.rlike(r"^[\p{Nd}.,\- ]+$")


def word(t: Column) -> Column:
    """A token without its mark."""
    return F.when(t.startswith(MARK), unmarked(t)).otherwise(t)


def unmarked(t: Column) -> Column:
    """A marked token without its mark, which is its first character and nowhere else."""
    return F.substring(t, 2, 2**31 - 1)


def lower_case(t: Column) -> Column:
    """Whether a token begins with a to z: then it has no mark, and is neither a sign nor a number nor a name."""
    return (t >= "a") & (t < "{")


def ascii_sign(t: Column) -> Column:
    """Whether a token is one of the signs from ! to /, most of all signs in prose."""
    return (t >= "!") & (t < "0")


def upper_case(t: Column) -> Column:
    """Whether a token begins with A to Z: then it has no mark, and is neither a sign nor a number."""
    return (t >= "A") & (t < "[")


def marked_letter(t: Column) -> Column:
    """Whether a token has a mark and begins with a to z or A to Z: marks are only before letters and numbers."""
    return (t >= MARK + "A") & (t < MARK + "{")


def per_language(lang: Column, lexicon: Lexicon, build: Callable[[Rules], Column]) -> Column:
    """``build`` under the rules of each text's language, which is looked at once a text."""
    tables = (lexicon.function, lexicon.generic, lexicon.negation, lexicon.proper, lexicon.lemma, lexicon.pos)
    out = build(Rules(lang, lexicon, ""))
    for iso3 in sorted({*GROUPS, *NOUN_CAPITALS, *(k for table in tables for k in table)}):
        out = F.when(lang == iso3, build(Rules(lang, lexicon, iso3))).otherwise(out)
    return out


def descriptive(w: Column, lang: Column, only: str | None = None) -> Column:
    """Whether a lower-case word has a descriptive suffix of its language's group."""
    out = F.lit(False)
    n = F.length(w)
    for iso3, group in GROUPS.items():
        if only not in (None, iso3):
            continue
        hit = F.lit(False)
        for least, suffixes in SUFFIXES[group]:
            for s in suffixes.split():
                # one letter more than the least before the suffix
                hit = hit | (F.endswith(w, F.lit(s)) & (n > len(s) + least))
        out = F.when(lang == iso3, hit & (n >= 4)).otherwise(out) if only is None else (n >= 4) & hit
    return out


class Rules:
    """The per-token decisions for a language column, under one lexicon.

    With ``only``, those for texts of that language alone ("": of none that has lists),
    so that a token isn't asked for its language at each list.
    """

    def __init__(self, lang: Column, lexicon: Lexicon = DEFAULT, only: str | None = None) -> None:
        self.lang, self.lexicon, self.only = lang, lexicon, only

    def _in(self, table: dict[str, Iterable[str]], w: Column, default: Iterable[str] = ()) -> Column:
        return _by_language(self.lang, table if self.only is None else {}, w, default if self.only is None else table.get(self.only, default))

    def function(self, w: Column) -> Column:
        return self._in(self.lexicon.function, w)

    def generic(self, w: Column) -> Column:
        return self._in(self.lexicon.generic, w, GENERIC_FALLBACK)

    def negation(self, w: Column) -> Column:
        listed = self._in(self.lexicon.negation, w)
        if self.only not in (None, "zho"):
            return listed
        begins = w.rlike("^(?:" + "|".join(self.lexicon.negation.get("zho", ["\u0001"])) + ")")
        return listed | (F.when(self.lang == "zho", begins).otherwise(False) if self.only is None else begins)

    def kept(self, w: Column, low: Column, starts: Column) -> Column:
        """Whether a word is protected: a negation, or a name inside a sentence."""
        named = self._in(self.lexicon.proper, low)
        capital = w.rlike(r"^[\p{Lu}\p{Lt}]")
        inside = ~starts & (F.lit(self.only not in NOUN_CAPITALS) if self.only else ~self.lang.isin(NOUN_CAPITALS))
        return self.negation(low) | (capital & (inside | named))

    def weak(self, lemma: Column) -> Column:
        return self.generic(lemma) | descriptive(lemma, self.lang, self.only)

    def letter(self, t: Column, *classes: tuple[Column, str], other: str, unsure: str | None = None) -> Column:
        """One letter for a marked token: End, Punctuation, Kept, Dropped number, or that of the first class it is in."""
        def classed(case: Column) -> Column:
            for condition, name in classes:
                case = case.when(condition, name)
            return case.otherwise(other)

        w = word(t)
        punct, kept = T.is_punct(w), self.kept(w, F.lower(w), t.startswith(MARK))
        full = F.when(punct & _is_end(w), "E").when(punct, "P").when(kept, "K")
        if unsure and self.only == "":
            full = full.when(kept.isNull(), unsure)
        return F.when(lower_case(t), classed(F.when(self.negation(F.lower(t)), "K"))).otherwise(classed(full.when(is_number(w), "D")))

    def plain(self) -> bool:
        """Whether the language is known and has no names: then a capital protects inside a sentence only, and not where all nouns have one."""
        return bool(self.only) and not self.lexicon.proper.get(self.only)

    def chosen(self, tokens: Column, out: Callable[[Column], Column]) -> Column:
        """The forms of the tokens that are left when those for which ``out`` holds are dropped; signs and numbers are."""
        def stays(t: Column) -> Column:
            w = word(t)
            full = ~T.is_punct(w) & (self.kept(w, F.lower(w), t.startswith(MARK)) | ~(is_number(w) | out(F.lower(w))))
            # most words aren't dropped, and only those that would be are looked up among the negations
            unless = lambda low: F.when(out(low), self.negation(low)).otherwise(True)
            usual = F.when(lower_case(t), unless(F.lower(t))).when(ascii_sign(t), False)
            if self.plain():
                usual = usual.when(upper_case(t), unless(F.lower(t)) if self.only in NOUN_CAPITALS else True).when(marked_letter(t), unless(F.lower(unmarked(t))))
            return usual.otherwise(full)

        def shown(t: Column) -> Column:
            w = word(t)
            kept = F.when(lower_case(t), self.negation(F.lower(t))).otherwise(self.kept(w, F.lower(w), t.startswith(MARK)))
            full = F.when(kept, w).otherwise(self.lemma(F.lower(w)))
            if self.lexicon.lemma:
                return full
            # without lemmas, a word in lower case is shown as it is, a negation or not
            usual = F.when(lower_case(t) & (F.lower(t) == t), t)
            if self.plain():
                negated = lambda w: F.when(self.negation(F.lower(w)), w).otherwise(F.lower(w))
                usual = usual.when(upper_case(t), negated(t) if self.only in NOUN_CAPITALS else t).when(marked_letter(t), negated(unmarked(t)))
            return usual.otherwise(full)

        return F.transform(F.filter(tokens, stays), shown)

    def words(self, tokens: Column, hard: bool = False) -> Column:
        """The tokens as structs that hold each decision once; ``hard`` adds those of the hard levels."""

        def seen(t: Column) -> Column:
            w = F.translate(t, MARK, "")
            return F.struct(w.alias("w"), F.lower(w).alias("low"), t.startswith(MARK).alias("starts"), T.is_punct(w).alias("punct"))

        def judged(x: Column) -> Column:
            lemma = self.lemma(x["low"])
            parts = [x["w"].alias("w"), x["punct"].alias("punct"), lemma.alias("lemma"), self.kept(x["w"], x["low"], x["starts"]).alias("kept"), is_number(x["w"]).alias("num"), self.listed(x["low"], lemma).alias("fun")]
            if hard:
                parts.append((self.generic(lemma) | descriptive(lemma, self.lang)).alias("weak"))
            if hard and self.lexicon.pos:
                parts += [self.is_a("VERB", x["low"]).alias("verb"), descriptive(lemma, self.lang).alias("descr")]
            return F.struct(*parts)

        return F.transform(F.transform(tokens, seen), judged)

    def listed(self, low: Column, lemma: Column) -> Column:
        return self.function(low) | self.function(lemma) if self.lexicon.lemma else self.function(low)

    def is_a(self, tag: str, low: Column) -> Column:
        """Whether a lower-case word's part of speech is ``tag``; false where it isn't known."""
        return self._in({iso3: [w for w, t in table.items() if t == tag] for iso3, table in self.lexicon.pos.items()}, low)

    def lemma(self, w: Column) -> Column:
        """The lemma of a word, lower-cased; adverbs stay as they are."""
        low = F.lower(w)
        out = low
        for iso3, table in self.lexicon.lemma.items():
            if self.only not in (None, iso3):
                continue
            adverbs = {k for k, v in self.lexicon.pos.get(iso3, {}).items() if v == "ADV"}
            pairs = [F.lit(x) for k, v in table.items() if k not in adverbs for x in (k, v)]
            if pairs:
                out = F.when(self.lang == iso3, F.coalesce(F.create_map(pairs)[low], low)).otherwise(out)
        return out


def light(tokens: Column, r: Rules) -> Column:
    def stays(t: Column) -> Column:
        listed = lambda w: ~r.function(F.lower(w)) | r.negation(F.lower(w))
        return F.when(lower_case(t), listed(t)).otherwise(~T.is_punct(word(t)) & listed(word(t)))

    return F.transform(F.filter(tokens, stays), word)


def semantic(tokens: Column, r: Rules) -> Column:
    return r.chosen(tokens, lambda low: r.listed(low, r.lemma(low)))


def aggressive(tokens: Column, r: Rules) -> Column:
    return r.chosen(tokens, lambda low: r.listed(low, r.lemma(low)) | (F.length(r.lemma(low)) <= 1) | r.weak(r.lemma(low)))


def compress(df: DataFrame, level: str, text: str = "text", lang: str | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``df`` with compressed_text, original_tokens and compressed_tokens.

    The language is detected unless the column ``lang`` gives its ISO 639-3 code; it
    comes back as ``detected``. A null or blank text gives an empty one. Unknown
    languages have empty word lists. Counts are numbers of tokens.
    """
    df = langid.detect(df, text, lexicon) if lang is None else df.withColumn("detected", F.col(lang))
    base = df.withColumn("_tokens", marked_tokens(text))
    own = lambda build: per_language(F.col("detected"), lexicon, build)
    if level == "statistical":
        base = _statistical(base, lexicon)
    elif level == "none":
        base = base.withColumn("_kept", F.lit(None).cast("array<string>"))
    elif level == "light":
        base = base.withColumn("_kept", own(lambda r: light(F.col("_tokens"), r)))
    elif level == "semantic":
        base = base.withColumn("_kept", own(lambda r: semantic(F.col("_tokens"), r)))
    elif level == "aggressive":
        base = base.withColumn("_hard", own(lambda r: aggressive(F.col("_tokens"), r)))
        base = base.withColumn("_kept", F.when(F.size("_hard") > 0, F.col("_hard")).otherwise(own(lambda r: semantic(F.col("_tokens"), r)))).drop("_hard")
    elif level == "syntactic" and lexicon.pos:
        base = base.withColumn("_words", Rules(F.col("detected"), lexicon).words(F.col("_tokens"), hard=True)).withColumn("_kept", _elliptic(F.col("_words"))).drop("_words")
    elif level == "syntactic":
        base = base.withColumn("_kept", own(lambda r: _syntactic(F.col("_tokens"), r)))
    else:
        raise ValueError(f"unknown level {level}")
    n = F.size("_tokens")
    joined = F.array_join("_kept", " ") if level != "none" else F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "").otherwise(F.col(text))
    kept = F.size("_kept") if level != "none" else n
    return base.withColumn("compressed_text", joined).withColumn("original_tokens", n.cast("long")).withColumn("compressed_tokens", kept.cast("long")).drop("_tokens", "_kept")


def _is_end(t: Column) -> Column:
    return t.isin(ENDS)


def _elided(words: Column) -> Column:
    """For each word whether it is in a leading clause that the sentence's last verb makes superfluous.

    A sentence of two verbs or more loses all before the last one, names apart, if
    between its verbs there are only function words, descriptive words, signs and
    names: a content word there means coordinated clauses. One letter stands for each
    token (Verb, Glue, End, X for content), and a regular expression judges a sentence.
    """
    def letter(x: Column) -> Column:
        verb = ~x["punct"] & ~x["kept"] & x["verb"]
        return F.when(x["punct"] & _is_end(x["w"]), "E").when(verb, "V").when(x["punct"] | x["kept"] | x["fun"] | x["descr"], "G").otherwise("X")

    def judged(c: Column) -> Column:
        head = F.regexp_extract(c, r"^([GX]*(?:VG*)+)V[GX]*$", 1)
        return F.concat(F.repeat(F.lit("D"), F.length(head)), F.substring(c, F.length(head) + 1, F.length(c)))

    clauses = F.split(F.array_join(F.transform(words, letter), ""), "E", -1)
    marks = F.split(F.array_join(F.transform(clauses, judged), "E"), "")
    return F.transform(F.arrays_zip(words.alias("x"), marks.alias("m")), lambda p: (p["m"] == "D") & ~p["x"]["kept"])


def _elliptic(words: Column) -> Column:
    """As ``_syntactic``; leading clauses are elided, by parts of speech."""
    live = F.transform(words, lambda x: ~x["punct"] & (x["kept"] | ~(x["num"] | x["fun"] | x["weak"])))
    follows = F.concat(F.slice(live, 2, F.greatest(F.size(live), F.lit(1))), F.array(F.lit(False)))
    gone = _elided(words)
    pairs = F.arrays_zip(words.alias("x"), live.alias("live"), follows.alias("follows"), gone.alias("gone"))

    def form(p: Column) -> Column:
        x = p["x"]
        glue = ~x["num"] & x["fun"]
        kept = ~x["punct"] & ~p["gone"] & (x["kept"] | F.when(glue, p["follows"]).otherwise(p["live"]))
        shown = F.when(x["kept"] | glue, x["w"]).otherwise(x["lemma"])
        return F.struct(x["w"].alias("w"), x["punct"].alias("punct"), kept.alias("keep"), shown.alias("shown"))

    items = F.transform(pairs, form)
    # the floor: the first word of a sentence of which nothing is kept. One letter stands for each token
    # (Kept, Word, Punctuation, End), and a regular expression finds the sentences without a K
    letters = F.transform(items, lambda x: F.when(x["keep"], "K").when(~x["punct"], "W").when(_is_end(x["w"]), "E").otherwise("P"))
    floored = F.split(F.regexp_replace(F.array_join(letters, ""), r"(?<=^|E)(P*)W(?=[WP]*(?:E|$))", "$1F"), "")
    chosen = F.filter(F.arrays_zip(items.alias("x"), floored.alias("f")), lambda p: p["f"].isin("K", "F"))
    return F.transform(chosen, lambda p: p["x"]["shown"])


def _marked(tokens: Column, marks: Column, r: Rules) -> Column:
    """The tokens with a mark other than a dot: as they are under a capital, else their lemmas."""
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), F.split(marks, "").alias("m")), lambda p: p["m"].isin("W", "l"))
    return F.transform(pairs, lambda p: F.when(p["m"] == "W", word(p["t"])).otherwise(r.lemma(F.lower(word(p["t"])))))


def _syntactic(tokens: Column, r: Rules) -> Column:
    """Content words, and function words right before one; no sentence goes empty."""
    def letter(t: Column) -> Column:
        lemma = r.lemma(F.lower(word(t)))
        return r.letter(t, (r.listed(F.lower(word(t)), lemma), "G"), (r.weak(lemma), "D"), other="L")

    c = F.regexp_replace(F.array_join(F.transform(tokens, letter), ""), "G(?=[KL])", "K")
    # the floor: the first word of a sentence of which nothing is kept
    for dropped, mark in (("G", "W"), ("D", "l")):
        c = F.regexp_replace(c, rf"(?<=^|E)(P*){dropped}(?=[GDP]*(?:E|$))", f"$1{mark}")
    return _marked(tokens, F.translate(c, "KLGDPE", "Wl...."), r)


def rated(letters: str, keys: list[str]) -> str:
    """Marks (W: as it is, l: lemma, a dot: dropped) of a text's tokens by TF-IDF over its own sentences.

    Words that score at least the median positive score stay, and names; a sentence
    of which nothing would be left keeps its best word, and a text without a scored
    word its words. Letters: End, Punctuation, Kept, Dropped number, Unsure (neither
    a name nor scored), Zero for a common word, S for any other.
    """
    if "S" not in letters and "Z" not in letters:
        return "".join("W" if c in "KU" else "." for c in letters)
    sentences = letters.count("E") + 1
    tf: Counter[str] = Counter()
    df: Counter[str] = Counter()
    start, bounds = 0, []
    for part in letters.split("E"):
        bounds.append((start, start + len(part)))
        own = [keys[i] for i, c in enumerate(part, start) if c in "SZ"]
        tf.update(own)
        df.update(set(own))
        start += len(part) + 1
    common = {k for k, c in zip(keys, letters, strict=True) if c == "Z"}
    score = {k: 0.0 if k in common else n * (math.log(sentences / (1 + df[k])) + 1 if sentences > 1 else 1.0) for k, n in tf.items()}
    positive = sorted(x for x in score.values() if x > 0)
    least = positive[len(positive) // 2] if positive else math.inf
    out = []
    for a, b in bounds:
        marks = ["W" if c == "K" else "l" if c == "S" and score[k] >= least else "." for c, k in zip(letters[a:b], keys[a:b], strict=True)]
        if "W" not in marks and "l" not in marks:
            # max takes the first of equal ones
            best = max((i for i in range(b - a) if letters[a + i] in "SZ"), key=lambda i: score[keys[a + i]], default=None)
            if best is not None:
                marks[best] = "l"
        out.append("".join(marks))
    return ".".join(out)


def _rated(letters: str, keys: str) -> Column:
    @F.pandas_udf("string")
    def run(letters: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else rated(c, k.split(MARK)) if c else "" for c, k in zip(letters, keys, strict=True)], dtype=object)

    return run(letters, keys)


def _statistical(base: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``base`` with the words kept by ``rated``: one text at a time, so that nothing is shuffled."""
    def letters(r: Rules) -> Column:
        def letter(t: Column) -> Column:
            lemma = r.lemma(F.lower(word(t)))
            return r.letter(t, (r.function(lemma) | r.generic(lemma), "Z"), other="S", unsure="U")

        return F.array_join(F.transform("_tokens", letter), "")

    own = lambda build: per_language(F.col("detected"), lexicon, build)
    small_batches(base.sparkSession)
    base = base.withColumn("_letters", own(letters)).withColumn("_keys", own(lambda r: F.array_join(F.transform("_tokens", lambda t: r.lemma(F.lower(word(t)))), MARK)))
    base = base.withColumn("_marks", _rated("_letters", "_keys"))
    return base.withColumn("_kept", own(lambda r: _marked(F.col("_tokens"), F.col("_marks"), r))).drop("_letters", "_keys", "_marks")


def custom_filter(df: DataFrame, text: str = "text", lang: str = "iso3", keep_only: list[str] | None = None, remove: list[str] | None = None, predicate=None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``df`` with compressed_text of the tokens of the categories asked for.

    Categories: FUNC, NUM, PUNCT, PROPN (a capital), CONTENT. ``predicate`` maps a
    token column to a condition that must hold too.
    """
    r = Rules(F.col(lang), lexicon)

    def category(w: Column) -> Column:
        return F.when(r.function(F.lower(w)), "FUNC").when(is_number(w), "NUM").when(T.is_punct(w), "PUNCT").when(w.rlike(r"^\p{Lu}"), "PROPN").otherwise("CONTENT")

    tokens = T.compression_tokens(F.coalesce(F.col(text), F.lit("")))
    if remove and "PUNCT" in remove:
        tokens = F.filter(tokens, lambda w: ~T.is_punct(w))
    if keep_only is not None:
        tokens = F.filter(tokens, lambda w: category(w).isin(keep_only))
    elif remove:
        rest = [c for c in remove if c != "PUNCT"]
        tokens = F.filter(tokens, lambda w: ~category(w).isin(rest)) if rest else tokens
    if predicate is not None:
        tokens = F.filter(tokens, predicate)
    return df.withColumn("compressed_text", F.array_join(tokens, " "))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.create_map([F.lit(x) for k, v in ISO1.items() for x in (k, v)])
    return tables.read(spark, sf_dir, "documents").withColumn("iso3", F.coalesce(codes[F.col("lang")], F.col("lang")))


def _level(level: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compress(_documents(spark, sf_dir), level, lang="iso3").select("doc_id", "compressed_text", "original_tokens", "compressed_tokens")

    return query


def compress_savings_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compress(tables.read(spark, sf_dir, "documents"), "light")
    return out.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("docs"), F.sum("original_tokens").alias("before"), F.sum("compressed_tokens").alias("after"), F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("saved"))


def compress_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom_filter(_documents(spark, sf_dir), keep_only=["CONTENT", "PROPN"]).select("doc_id", "compressed_text")


_TOKENS = f"""
lex(iso3, kind, w) AS (VALUES {langid.values(("function", "negation", "generic"))}),
iso(lang, iso3) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ISO1.items())}),
tok AS (SELECT doc_id, iso3, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM (
  SELECT doc_id, iso3, regexp_extract_all(text, '{T.WORD_OR_SIGN_RE2.replace("'", "''")}') AS ts FROM documents JOIN iso USING (lang))),
typed AS (SELECT *, lower(w) AS low, NOT regexp_matches(w, '^[\\p{{L}}\\p{{Nd}}\\p{{No}}]') AS punct FROM tok),
flag AS (SELECT t.*, f.w IS NOT NULL AS fun, n.w IS NOT NULL AS neg, g.w IS NOT NULL AS gen, regexp_matches(t.w, '^[\\p{{Nd}}.,\\- ]+$') AS num,
    coalesce(max(CASE WHEN NOT punct THEN pos END) OVER p, 0) AS last_word, coalesce(max(CASE WHEN t.w IN ('.', '!', '?', '…') THEN pos END) OVER p, 0) AS last_end
  FROM typed t LEFT JOIN (SELECT DISTINCT iso3, w FROM lex WHERE kind = 'function') f ON f.iso3 = t.iso3 AND f.w = t.low
  LEFT JOIN (SELECT DISTINCT iso3, w FROM lex WHERE kind = 'negation') n ON n.iso3 = t.iso3 AND n.w = t.low
  LEFT JOIN (SELECT DISTINCT iso3, w FROM lex WHERE kind = 'generic') g ON g.iso3 = t.iso3 AND g.w = t.low
  WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
word AS (SELECT *, neg OR (iso3 <> 'deu' AND regexp_matches(w, '^[\\p{{Lu}}\\p{{Lt}}]') AND last_word > last_end) AS kept,
    CASE WHEN length(low) < 4 THEN false
      WHEN iso3 = 'eng' THEN regexp_matches(low, '^(?s:.{{2,}}(?:ly|wise|wards)|.{{3,}}(?:ous|ive|able|ible|ful|less|ic|ant|ent|ish|like|some))$')
      WHEN iso3 IN ('ita', 'fra', 'spa', 'por') THEN regexp_matches(low, '^(?s:.{{3,}}mente|.{{3,}}(?:oso|osa|ivo|iva|abile|ibile|ale|ese|ista))$')
      WHEN iso3 IN ('deu', 'nld') THEN regexp_matches(low, '^(?s:.{{3,}}(?:lich|ig|isch|sam|bar|haft|los|voll|arm|reich))$') ELSE false END AS descr
  FROM flag)"""
_OUT = "SELECT d.doc_id, coalesce(string_agg({shown}, ' ' ORDER BY pos) FILTER ({keep}), '') AS compressed_text, count(t.w)::BIGINT AS original_tokens, count(*) FILTER ({keep})::BIGINT AS compressed_tokens FROM documents d LEFT JOIN word t USING (doc_id) GROUP BY d.doc_id"
_SEM = "NOT punct AND (kept OR NOT (num OR fun))"
_AGG = "NOT punct AND (kept OR NOT (num OR fun OR length(low) <= 1 OR gen OR descr))"
_SHOWN = "CASE WHEN kept THEN w ELSE low END"
_LIGHT = "NOT punct AND (NOT fun OR neg)"

QUERIES = {f"compress_{x}": _level(x) for x in LEVELS} | {"compress_savings_by_lang": compress_savings_by_lang, "compress_custom": compress_custom}
ORACLES = {
    "compress_none": f"WITH {_TOKENS} SELECT d.doc_id, any_value(d.text) AS compressed_text, count(t.w)::BIGINT AS original_tokens, count(t.w)::BIGINT AS compressed_tokens FROM documents d LEFT JOIN word t USING (doc_id) GROUP BY d.doc_id",
    "compress_light": f"WITH {_TOKENS} " + _OUT.format(shown="w", keep=_LIGHT),
    "compress_semantic": f"WITH {_TOKENS} " + _OUT.format(shown=_SHOWN, keep=_SEM),
    "compress_aggressive": f"WITH {_TOKENS}, hard AS ({_OUT.format(shown=_SHOWN, keep=_AGG)}), soft AS ({_OUT.format(shown=_SHOWN, keep=_SEM)}) SELECT doc_id, CASE WHEN h.compressed_tokens > 0 THEN h.compressed_text ELSE s.compressed_text END AS compressed_text, h.original_tokens, CASE WHEN h.compressed_tokens > 0 THEN h.compressed_tokens ELSE s.compressed_tokens END AS compressed_tokens FROM hard h JOIN soft s USING (doc_id)",
    "compress_statistical": f"""WITH {_TOKENS}, s AS (SELECT *, coalesce(sum((w IN ('.', '!', '?', '…'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sen,
        CASE WHEN NOT punct AND NOT kept AND NOT num THEN low END AS k FROM word),
      size AS (SELECT doc_id, max(sen + (w IN ('.', '!', '?', '…'))::INT) + 1 AS n FROM s GROUP BY doc_id),
      term AS (SELECT doc_id, k, any_value(fun OR gen) AS common, count(*) AS tf, count(DISTINCT sen) AS df FROM s WHERE k IS NOT NULL GROUP BY doc_id, k),
      sc AS (SELECT doc_id, k, CASE WHEN common THEN 0 ELSE tf * CASE WHEN n > 1 THEN ln(n / (1 + df)::DOUBLE) + 1 ELSE 1.0 END END AS score FROM term JOIN size USING (doc_id)),
      th AS (SELECT doc_id, p[len(p) // 2 + 1] AS threshold FROM (SELECT doc_id, list_sort(list(score)) AS p FROM sc WHERE score > 0 GROUP BY doc_id)),
      j AS (SELECT s.*, score, kept AND NOT punct OR coalesce(score > 0 AND score >= coalesce(threshold, 0), false) AS keep FROM s LEFT JOIN sc USING (doc_id, k) LEFT JOIN th USING (doc_id)),
      f AS (SELECT *, keep OR (NOT bool_or(keep) OVER q AND k IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, sen ORDER BY (k IS NULL), -score, pos) = 1) AS final FROM j WINDOW q AS (PARTITION BY doc_id, sen)),
      has AS (SELECT DISTINCT doc_id, true AS scored FROM sc)
      SELECT d.doc_id, coalesce(string_agg(CASE WHEN NOT coalesce(scored, false) THEN w WHEN kept THEN w ELSE k END, ' ' ORDER BY pos) FILTER (CASE WHEN scored THEN final ELSE NOT punct AND NOT num END), '') AS compressed_text,
        count(t.w)::BIGINT AS original_tokens, count(*) FILTER (CASE WHEN scored THEN final ELSE NOT punct AND NOT num AND t.w IS NOT NULL END)::BIGINT AS compressed_tokens
      FROM documents d LEFT JOIN f t USING (doc_id) LEFT JOIN has USING (doc_id) GROUP BY d.doc_id""",
    "compress_syntactic": f"""WITH {_TOKENS}, s AS (SELECT *, coalesce(sum((w IN ('.', '!', '?', '…'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sen,
        NOT punct AND (kept OR NOT (num OR fun OR gen OR descr)) AS live FROM word),
      k AS (SELECT *, fun AND NOT kept AND NOT num AS glue, CASE WHEN punct THEN false WHEN kept THEN true WHEN fun AND NOT num THEN coalesce(lead(live) OVER (PARTITION BY doc_id ORDER BY pos), false) ELSE live END AS keep FROM s),
      f AS (SELECT *, keep OR (NOT punct AND NOT bool_or(keep) OVER q AND row_number() OVER (PARTITION BY doc_id, sen ORDER BY punct, pos) = 1) AS final FROM k WINDOW q AS (PARTITION BY doc_id, sen))
      SELECT d.doc_id, coalesce(string_agg(CASE WHEN kept OR glue THEN w ELSE low END, ' ' ORDER BY pos) FILTER (final), '') AS compressed_text, count(t.w)::BIGINT AS original_tokens,
        count(*) FILTER (final)::BIGINT AS compressed_tokens FROM documents d LEFT JOIN f t USING (doc_id) GROUP BY d.doc_id""",
    "compress_custom": f"WITH {_TOKENS} SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT fun AND NOT num AND NOT punct), '') AS compressed_text FROM documents d LEFT JOIN word t USING (doc_id) GROUP BY d.doc_id",
    "compress_savings_by_lang": langid._DETECT.replace("lex(", "lex0(").replace("JOIN lex ", "JOIN lex0 ") + f""", lex(iso3, kind, w) AS (VALUES {langid.values(("function", "negation"))}),
      t AS (SELECT doc_id, detected, lang, unnest(regexp_extract_all(text, '{T.WORD_OR_SIGN_RE2.replace("'", "''")}')) AS w FROM documents JOIN verdict USING (doc_id, lang)),
      c AS (SELECT t.lang, t.doc_id, t.detected, count(*) AS b, count(*) FILTER (regexp_matches(t.w, '^[\\p{{L}}\\p{{Nd}}\\p{{No}}]') AND (f.w IS NULL OR n.w IS NOT NULL)) AS a FROM t
        LEFT JOIN (SELECT DISTINCT iso3, w FROM lex WHERE kind = 'function') f ON f.iso3 = detected AND f.w = lower(t.w)
        LEFT JOIN (SELECT DISTINCT iso3, w FROM lex WHERE kind = 'negation') n ON n.iso3 = detected AND n.w = lower(t.w) GROUP BY 1, 2, 3)
      SELECT v.lang, v.detected, count(*) AS docs, sum(coalesce(b, 0))::BIGINT AS before, sum(coalesce(a, 0))::BIGINT AS after, sum(coalesce(b - a, 0))::BIGINT AS saved FROM verdict v LEFT JOIN c USING (doc_id) GROUP BY 1, 2""",
}

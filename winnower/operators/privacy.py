"""Personal data: counts, scores, flags, masks and a vault to restore from.

Counts are plain column expressions. What needs checksums and the places of the
matches goes through one Arrow UDF, which sees only texts that have a digit, an
``@`` or one of the few words that rules begin with.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions.checksums import VALIDATORS
from winnower.functions.pii_rules import FOLDED, RULES, Rule, needs
from winnower.sources import tables
from winnower.sources.scratch import cut

BLOCK_AT = 61
AROUND = 25
# Categories that add flags of their own.
PERSONAL = {
    "Email", "Phone E.164", "Italian Tax Code (CF)", "Spanish Tax/ID Number (NIF/NIE)", "Polish PESEL", "Dutch BSN", "French Social Security (NIR)", "Swedish Personal ID", "Danish CPR Number", "Finnish Personal ID (Hetu)",
    "Irish PPSN", "Belgian National Registry", "Czech Birth Number", "Romanian Personal Code (CNP)", "Bulgarian EGN", "Croatian OIB", "Slovenian EMSO", "Lithuanian Personal Code", "Latvian Personal Code", "Estonian Personal ID",
    "German Tax ID (Steuer-Id)", "Hungarian Tax ID", "Portuguese Tax Number (NIF)", "Greek Tax Number (AFM)", "Cypriot ID Number", "Maltese ID Number", "Luxembourg National ID", "Slovak Birth Number",
}
FINANCIAL = {"Credit Card", "IBAN", "Italian VAT Number", "French Business ID (SIREN/SIRET)", "Polish VAT (NIP)", "Austrian VAT (UID)"}
DERIVED = [
    (PERSONAL, ["GDPR/DSGVO/RGPD/RODO - Personal Identifiers"]),
    (FINANCIAL, ["PCI-DSS & SEPA - Financial/Payment Data"]),
    ({"Password/Secret", "JWT/Token"}, ["NIST 800-53 - Credentials & Secrets", "NIS2 Art.21 - Cybersecurity Risk Management (Credential Exposure)"]),
    ({"GPS Coordinates"}, ["GDPR Art.4(1) - Location Tracking"]),
    ({"EU Vehicle License Plate"}, ["GDPR Art.4(1) - Indirect Identifiers"]),
    ({"PNR / Booking Code"}, ["GDPR Art.4(1) - Mobility Data"]),
    ({"Social / Messenger Handle"}, ["GDPR Art.4(1) - Digital Identity"]),
    ({"Minor Data (<16)"}, ["GDPR Art.8 - Enhanced Minor Protection", "EU AI Act Art.5 - Vulnerable Groups Protection"]),
    ({"Legal Case / File Number"}, ["GDPR Art.10 - Judicial Data", "EU AI Act Annex III(8) - Law Enforcement & Justice"]),
    ({"Employee / Badge ID"}, ["GDPR Art.4(1) - Employment Data", "EU AI Act Annex III(4) - Employment/Worker Management"]),
    (FINANCIAL, ["EU AI Act Annex III(5) - Credit Scoring & Essential Services"]),
]
# Names of the levels by language.
RISK = {
    "en": ["Safe (AI Ready)", "Low (Monitoring)", "Medium (Anonymization Required)", "High (Block Recommended)", "Critical (Absolute Prohibition)"],
    "it": ["Sicuro (AI Ready)", "Basso (Monitoraggio)", "Medio (Anonimizzazione Obbligatoria)", "Alto (Blocco Consigliato)", "Critico (Divieto Assoluto)"],
    "de": ["Sicher (AI Ready)", "Niedrig (Überwachung)", "Mittel (Anonymisierung erforderlich)", "Hoch (Blockade empfohlen)", "Kritisch (Absolutes Verbot)"],
    "fr": ["Sûr (AI Ready)", "Faible (Surveillance)", "Moyen (Anonymisation requise)", "Élevé (Blocage recommandé)", "Critique (Interdiction absolue)"],
    "es": ["Seguro (AI Ready)", "Bajo (Monitoreo)", "Medio (Anonimización requerida)", "Alto (Bloqueo recomendado)", "Crítico (Prohibición absoluta)"],
}
LEVELS = [15, 35, 60, 85]
#: A text without any of these can match no rule.
CANDIDATES = ["passw", "pwd", "secret", "token", "api_key", "apikey", "bearer", "targa", "kennzeichen", "plate", "placa", "rejestracja", "kenteken", "immatric", "pnr", "booking", "prenotazione", "codice", "reserv", "buchung", "boeking", "t.me", "instagram", "x.com", "tiktok", "discord", "telegram", "linkedin", "matricola", "badge", "dipendente", "studente", "employ", "personalnummer", "pracownika", "werknemer", "funcion", "empleado", "kennung", "identyfik"]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values())))


def candidate(text: Column) -> Column:
    """Whether any rule may match: searches for plain words are many times as fast as one expression of all of them."""

    def any_of(low: Column) -> Column:
        return reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in CANDIDATES))

    return text.rlike("[0-9@]") | F.contains(text, F.lit("eyJ")) | F.exists(F.array(F.lower(text)), any_of)


def java(pattern: str) -> str:
    """A rule's pattern for Java: classes and word boundaries as in Unicode."""
    return "(?U)" + pattern.replace("(?-i)", "")


def counts(text: str = "text", rules: list[Rule] = RULES) -> Column:
    """A map from category to the number of matches, in one pass of a row; empty for none."""
    t = normalised(text)

    def some(x: Column) -> Column:
        def n(r: Rule) -> Column:
            run, words = needs(r)
            may = reduce(Column.__or__, (F.contains(x["low"], F.lit(w)) for w in words)) if words else F.lit(True)
            return F.when((x["run"] >= run) & may, F.regexp_count(x["t"], F.lit(java(r.pattern)))).otherwise(0)

        return F.filter(F.array(*(F.struct(F.lit(r.category).alias("c"), n(r).alias("n")) for r in rules)), lambda p: p["n"] > 0)

    # the parts that all rules share are made once a text, as the variable of a function
    run = F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\d+"), F.lit(0)), lambda w: F.length(w))))
    found = F.flatten(F.transform(F.array(F.struct(t.alias("t"), _folded(t).alias("low"), run.alias("run"))), some))
    return F.when(candidate(t), F.map_from_entries(found)).otherwise(F.create_map().cast("map<string,int>"))


_FOLDED = str.maketrans(FOLDED)


@lru_cache(maxsize=16)
def _compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(r.pattern.replace("(?-i)", ""))) for r in rules]


def analyse(text: str | None, rules: tuple[Rule, ...] = tuple(RULES), whitelist: frozenset[str] = frozenset()) -> tuple[int, dict[str, int], dict[str, int], int, float, list[tuple[int, int, str, str]]]:
    """(score, matches by category, valid ones by category, matches, density, spans)."""
    if not text or not text.strip():
        return 0, {}, {}, 0, 0.0, []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found, valid, spans, base = {}, {}, [], 0.0
    hits: list[tuple[Rule, re.Match]] = []
    low, longest = text.translate(_FOLDED).lower(), max(map(len, re.findall(r"\d+", text)), default=0)
    for rule, pattern in _compiled(rules):
        run, some = needs(rule)
        if longest < run or (some and not any(w in low for w in some)):
            continue
        own = [m for m in pattern.finditer(text)]
        hits += [(rule, m) for m in own]
        own = [m for m in own if m[0] not in whitelist]
        if not own:
            continue
        good = sum(VALIDATORS[rule.validator](m[0]) if rule.validator else True for m in own)
        found[rule.category], valid[rule.category] = len(own), good
        base += len(own) * (rule.weight * (1.3 if good else 0.5) * (1.2 if rule.high else 0.8))
        spans += [(m.start(), m.end(), rule.category, m[0]) for m in own]
    total = len(spans)
    near = sum(0.12 for rule, m in hits if rule.category in found and rule.keywords and any(k in text[max(0, m.start() - AROUND) : m.end() + AROUND].lower() for k in rule.keywords))
    density = min(total / max(1, len(text) / 100.0) * 0.7, 1.0)
    score = base * min(1.0 + len(found) * 0.12, 2.2) + min(near, 1.0) * 12 + density * 18
    return int(max(0.0, min(100.0, score))), found, valid, total, density, spans


def merged(spans: list[tuple[int, int, str, str]], text: str) -> list[tuple[int, int, str, str]]:
    """Spans by start; overlapping ones are one, with the first's category and all their text."""
    out: list[list] = []
    for a, b, category, _ in sorted(spans, key=lambda s: s[0]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, category])
    return [(a, b, c, text[a:b]) for a, b, c in out]


def mask(text: str | None, rules: tuple[Rule, ...] = tuple(RULES), whitelist: frozenset[str] = frozenset(), vault: bool = True) -> tuple[str | None, list[tuple[int, str, str]]]:
    """The masked text and its vault rows (n, value, category).

    Placeholders ``[PG_n]`` are numbered from the end of the text; equal values share
    one. Without a vault the placeholder is the category.
    """
    if not text or not text.strip():
        return text, []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    known: dict[str, tuple[int, str]] = {}
    parts, hi = [], len(text)
    for a, b, category, value in reversed(merged(analyse(text, rules, whitelist)[5], text)):
        n, _ = known.setdefault(value, (len(known) + 1, category))
        parts += [text[b:hi], f"[PG_{n}]" if vault else f"[{category.upper()}]"]
        hi = a
    return "".join(reversed([*parts, text[:hi]])), [(n, v, c) for v, (n, c) in known.items()]


_ANALYSIS = T.StructType([
    T.StructField("score", T.IntegerType()), T.StructField("matches", T.MapType(T.StringType(), T.IntegerType())), T.StructField("valid", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("match_count", T.IntegerType()), T.StructField("density", T.DoubleType()),
])
_MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("vault", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("category", T.StringType())])))])


def analysis(text: str = "text", rules: list[Rule] = RULES, whitelist: list[str] | None = None) -> Column:
    """A struct (score, matches, valid, match_count, density)."""
    table, white = tuple(rules), frozenset(whitelist or ())

    @F.pandas_udf(_ANALYSIS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(t, table, white)[:5] for t in texts], columns=_ANALYSIS.names)

    return run(F.when(candidate(F.col(text)), F.col(text)))


def masking(text: str = "text", rules: list[Rule] = RULES, whitelist: list[str] | None = None, vault: bool = True) -> Column:
    """A struct (text, vault); texts without candidates don't travel."""
    table, white = tuple(rules), frozenset(whitelist or ())

    @F.pandas_udf(_MASKED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mask(t, table, white, vault) for t in texts], columns=_MASKED.names)

    return run(F.when(candidate(F.col(text)), F.col(text)))


def masked(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``df`` with masked_text and vault; line ends become \\n."""
    out = df.withColumn("_m", masking(text, **kw))
    return out.withColumn("masked_text", F.coalesce("_m.text", F.when(F.col(text).isNotNull(), normalised(text)))).withColumn("vault", F.col("_m.vault")).drop("_m")


def restore(df: DataFrame, text: str, vault: str = "vault") -> Column:
    """A masked text with its values back; unknown placeholders stay."""
    gaps, marks = F.split(F.col(text), r"\[PG_\d+\]", -1), F.regexp_extract_all(F.col(text), F.lit(r"\[PG_\d+\]"), F.lit(0))
    table = F.map_from_entries(F.transform(F.coalesce(F.col(vault), F.array().cast(df.schema[vault].dataType)), lambda e: F.struct(F.concat(F.lit("[PG_"), e["n"], F.lit("]")), e["value"])))
    values = F.transform(marks, lambda m: F.coalesce(F.element_at(table, m), m))
    return F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def vault_rows(df: DataFrame, session: str) -> DataFrame:
    """The vault as a table (session_id, n, placeholder, original_value, category)."""
    v = df.select(F.col(session).alias("session_id"), F.explode("vault").alias("v"))
    return v.select("session_id", "v.n", F.concat(F.lit("[PG_"), "v.n", F.lit("]")).alias("placeholder"), F.col("v.value").alias("original_value"), "v.category")


def merge_vaults(vault: DataFrame, into: str = "session_id") -> DataFrame:
    """Vault rows of several sessions renumbered under one: equal values share a placeholder.

    Values are numbered by the number that they had, then by themselves: first the
    parts of equal number and beginning, then the values of a part, so that no task
    has all of a session's.
    """
    w = vault.groupBy(into, "original_value").agg(F.min(F.struct("n", "category")).alias("f"))
    w = cut(w.select(into, "original_value", F.col("f.n").alias("_n"), F.col("f.category").alias("category"), F.substring("original_value", 1, 3).alias("_part")), "values")
    parts = w.groupBy(into, "_n", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(into).orderBy("_n", "_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut(parts.select(F.col(into).alias("_into"), F.col("_n").alias("_pn"), F.col("_part").alias("_pp"), F.coalesce(before, F.lit(0)).alias("_before")), "parts")
    rows = w.join(parts, F.col(into).eqNullSafe(F.col("_into")) & (F.col("_n") == F.col("_pn")) & (F.col("_part") == F.col("_pp")))
    n = (F.row_number().over(Window.partitionBy(into, "_n", "_part").orderBy("original_value")) + F.col("_before")).cast("int")
    return rows.select(into, n.alias("n"), F.concat(F.lit("[PG_"), n, F.lit("]")).alias("placeholder"), "original_value", "category")


def risk(score: Column, blank: Column, lang: Column | None = None) -> Column:
    """The level's name in a language; English where there is none; None for a blank text."""
    step = sum(((score > x).cast("int") for x in LEVELS), F.lit(0))
    names = F.create_map([x for k, v in RISK.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(names[F.lower(lang)] if lang is not None else None, names[F.lit("en")]) if lang is not None else names[F.lit("en")]
    return F.when(blank, "None").otherwise(own[step])


def flags(categories: Column, rules: list[Rule] = RULES) -> Column:
    """Compliance flags of an array of categories: the rules' tags, then the derived ones, first seen."""
    parts = [F.when(F.array_contains(categories, r.category), F.array(*map(F.lit, r.tags))) for r in rules if r.tags]
    parts += [F.when(F.arrays_overlap(categories, F.array(*map(F.lit, sorted(c)))), F.array(*map(F.lit, f))) for c, f in DERIVED]
    return F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def validators_column(value: str, name: str) -> Column:
    check = VALIDATORS[name]

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else check(v) for v in values])

    return run(F.col(value))


def luhn_column(value: str) -> Column:
    """The Luhn check of 13 to 19 digits without Python."""
    d = F.regexp_replace(F.col(value), "[^0-9]", "")
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(d)))
    part = lambda k: F.substring(F.reverse(d), k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
    total = F.aggregate(steps, F.lit(0), lambda a, k: a + part(k) - F.when(part(k) > 9, 9).otherwise(0))
    return F.length(d).between(13, 19) & (total % 10 == 0)


def _docs(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(counts()).alias("category", "n"))


def pii_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("a", analysis())
    score, blank = F.coalesce("a.score", F.lit(0)), ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
    return d.select("doc_id", score.alias("score"), risk(score, blank, F.col("lang")).alias("risk"), F.coalesce("a.match_count", F.lit(0)).alias("match_count"), (score >= BLOCK_AT).alias("blocked"), F.to_json(F.coalesce("a.valid", F.create_map().cast("map<string,int>"))).alias("valid"))


def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("c", F.map_keys(counts())).where(F.size("c") > 0)
    return d.select("doc_id", F.array_join(flags(F.col("c")), "; ").alias("flags"))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "masked_text", F.size(F.coalesce("vault", F.array().cast(_MASKED["vault"].dataType))).alias("vault_size"))


def pii_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masked(_docs(spark, sf_dir).select("doc_id", "text"))
    return m.select("doc_id", restore(m, "masked_text").alias("restored"))


def pii_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vault_rows(masked(_docs(spark, sf_dir).select("doc_id", "source", "text")), "source")
    return merge_vaults(v)


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of scores from 0 to 100, made from each order's key, in turn in each language."""
    langs = F.array(*map(F.lit, ["en", "it", "de", "fr", "es", "xx"]))
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 101).alias("score"), langs[(F.col("o_orderkey") % 6).cast("int")].alias("lang"))
    return o.select("o_orderkey", risk(F.col("score"), F.lit(False), F.col("lang")).alias("risk"), (F.col("score") >= BLOCK_AT).alias("blocked"))


def validators_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 digits made from each order's key."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4").alias("number"))
    return o.select("o_orderkey", validators_column("number", "LUHN").alias("valid"))


def validators_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 11, "4").alias("number"))
    return o.select("o_orderkey", *(validators_column("number", n).alias(n.lower()) for n in ("PESEL_PL", "STEUER_ID_DE", "OIB_HR", "NN_BE")))


#: Validators by the length of the numbers that they take, for the query below.
_BY_LENGTH = {
    9: ["BSN_NL", "NIF_PT", "AFM_GR"], 10: ["CPR_DK", "EGN_BG", "RNOKPP_UA", "PERSONNUMMER_SE"], 11: ["AK_LT", "IK_EE", "PK_LV", "PIVA_IT"], 12: ["INN_RU"], 13: ["CNP_RO", "EMSO_SI"], 15: ["NIR_FR"],
}


def validators_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each length, and some with letters, made from each order's key."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 104_729 + 1_234_567).cast("string").alias("k"))
    out = o.select("o_orderkey", "k", *(F.lpad("k", n, "37").alias(f"n{n}") for n in _BY_LENGTH))
    letter = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (F.col("o_orderkey") % 23 + 1).cast("int"), F.lit(1))
    out = out.withColumn("es", F.concat(F.lpad("k", 8, "3"), letter)).withColumn("fi", F.concat(F.lpad("k", 6, "0"), F.lit("A"), F.lpad("k", 3, "0"), letter)).withColumn("ch", F.concat(F.lit("756"), F.lpad("k", 10, "37")))
    out = out.withColumn("cn", F.concat(F.lpad("k", 17, "37"), F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise((F.col("o_orderkey") % 10).cast("string"))))
    pairs = [(f"n{n}", v) for n, vs in _BY_LENGTH.items() for v in vs] + [("es", "NIF_ES"), ("fi", "HETU_FI"), ("ch", "AHV_CH"), ("cn", "ID_CN")]
    return out.select("o_orderkey", *(validators_column(c, v).alias(v.lower()) for c, v in pairs))


QUERIES = {"pii_counts": pii_counts, "pii_score": pii_score, "pii_flags": pii_flags, "risk_levels": risk_levels, "pii_mask": pii_mask, "pii_restore": pii_restore, "pii_vault": pii_vault, "validators_luhn": validators_luhn, "validators_national": validators_all, "validators_more": validators_more}
_D = "list_transform(range(1, {n} + 1), lambda k: substr({s}, k, 1)::INT)"
ORACLES = {
    "pii_counts": "WITH d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', E'\\n', 'g') AS t FROM documents) SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{r.category}' AS category, len(regexp_extract_all(t, '{r.pattern.replace('(?-i)', '').replace(chr(39), chr(39) * 2)}'))::INTEGER AS n FROM d" for r in RULES) + ") WHERE n > 0",
    "pii_restore": "SELECT doc_id, regexp_replace(text, '\\r\\n?', E'\\n', 'g') AS restored FROM documents",
    "validators_luhn": "WITH o AS (SELECT o_orderkey, reverse(lpad((o_orderkey * 7919)::VARCHAR, 16, '4')) AS s FROM orders) SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 0 THEN (substr(s, k, 1)::INT * 2) // 10 + (substr(s, k, 1)::INT * 2) % 10 ELSE substr(s, k, 1)::INT END)) % 10 = 0 AS valid FROM o",
    "validators_national": f"""WITH o AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 11, '4') AS s FROM orders), d AS (SELECT *, {_D.format(n=11, s="s")} AS d FROM o)
      SELECT o_orderkey, list_dot_product(d::DOUBLE[], [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1]::DOUBLE[])::INT % 10 = 0 AS pesel_pl,
        (11 - list_dot_product(d[1:10]::DOUBLE[], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]::DOUBLE[])::INT % 11) % 11 = d[11] AS steuer_id_de,
        CASE 11 - list_dot_product(d[1:10]::DOUBLE[], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2]::DOUBLE[])::INT % 11 WHEN 10 THEN 0 ELSE 11 - list_dot_product(d[1:10]::DOUBLE[], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2]::DOUBLE[])::INT % 11 END = d[11] AS oib_hr,
        (97 - substr(s, 1, 9)::BIGINT % 97) % 100 = substr(s, 10, 2)::INT AS nn_be FROM d""",
}

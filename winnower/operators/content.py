"""Content typing, routing parameters and terminal noise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.sources import tables

# What tells the types apart.
LOG_LEVEL = r"(?i)\b(ERROR|WARN(?:ING)?|INFO|DEBUG|FATAL|TRACE)\b"
STACK_FRAME = r"(?m)^\s+at\s+\S"
DIFF_HEADER = r"(?m)^(\+\+\+|---)\s"
NUMBERED = r"(?m)^\s*\d+\.\s+\S"
GREP = r"(?m)^[A-Za-z0-9_./@\-\\][^:\n]*:\d+:\S"
HTML_MARKERS = ["<html", "<!doctype", "<body", "<div", "<p>"]
#: A text without any of these, lower-cased, has no LOG_LEVEL.
LOG_WORDS = ["error", "warn", "info", "debug", "fatal", "trace"]
CODE_SIGNS = ["{", "}", ";", "=>", "->", "def ", "function ", "class ", "import ", "#include", "public ", "private "]
#: What (?U)\s matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONFIDENCE = {"JsonArray": 0.98, "JsonObject": 0.95, "GitDiff": 0.93, "LogOrStackTrace": 0.88, "Html": 0.90, "SearchResults": 0.80, "Tabular": 0.75, "SourceCode": 0.70, "PlainText": 1.0}

# Profiles of the router (level, rows kept of an array).
PROFILES = {"light": ("light", 25), "balanced": ("semantic", 15), "agent": ("semantic", 10), "aggressive": ("aggressive", 8)}
LADDER = ["none", "light", "semantic", "aggressive"]

# Noise of terminals.
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[@-Z\\-_]"
SPINNER = r"^\s*[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏]\s*$"
BAR = r"^\s*[█▓▒░▏▎▍▌▋▊▉]{3,}(?:\s+\d{1,3}%)?\s*$|^\s*\[[=#\-> ]{3,}\]\s*\d{1,3}%\s*$"

# Commands whose success is worth a line or three, and those lines.
QUIET_COMMANDS = ["git push", "git pull", "npm install", "npm ci", "yarn install", "pip install", "docker build", "docker push", "terraform apply", "terraform plan"]
SALIENT = [
    r"(?i)^\s*added \d+ packages?.*$",
    r"(?i)^\s*removed \d+ packages?.*$",
    r"(?i)^\s*changed \d+ packages?.*$",
    r"(?i)^.*\d+ vulnerabilit\w+.*$",
    r"(?i)^\s*Successfully installed .*$",
    r"(?i)^\s*Successfully built [0-9a-f]+\s*$",
    r"(?i)^\s*Successfully tagged \S+\s*$",
    r"^\s*\S+\.\.\S+\s+\S+\s*->\s*\S+\s*$",
    r"(?i)^\s*Everything up-to-date\s*$",
    r"(?i)^\s*Apply complete!.*$",
    r"(?i)^\s*Plan:\s*\d+ to add.*$",
    r"(?i)^\s*No changes\. Your infrastructure matches.*$",
    r"(?i)^\s*(?:Already up to date|Already up-to-date)\.?\s*$",
]


def content_type(text: str = "text") -> Column:
    """The type of a text, by the first test that holds; null and blank are plain.

    Tests that look at each line are tried only on texts that hold what they cannot
    match without, which is found in one fast pass.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    head = F.ltrim(t, F.lit(BLANKS))
    lines = T.lines(t)
    holds = lambda s: F.contains(t, F.lit(s))

    def json(opens: str, closes: str) -> Column:
        # the parser is called only on what looks the part
        looks = head.startswith(opens) & F.rtrim(head, F.lit(BLANKS)).endswith(closes)
        return F.when(looks, F.expr(f"try_parse_json(`{text}`)").isNotNull()).otherwise(False)

    logs = _with_lower(t, LOG_WORDS) & (F.size(F.filter(lines, lambda x: x.rlike(LOG_LEVEL))) >= 2)
    frames = (t.rlike(r"at\s(?<=[\s\x85\u2028\u2029]\sat\s)") | (head != t)) & (F.regexp_count(t, F.lit(STACK_FRAME)) >= 2)
    html = holds("<") & _with_lower(t, HTML_MARKERS)
    code = sum((holds(s).cast("int") for s in CODE_SIGNS), F.lit(0))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|")))
    table = holds("|") & (pipes > 4) & F.exists(F.slice(lines, 1, 5), lambda x: x.startswith("|"))
    found = (t.rlike(r"\d\.\s") & t.rlike(NUMBERED)) | (holds(":") & t.rlike(r":\d++:\S") & t.rlike(GREP))
    return (
        F.when(head == "", "PlainText").when(json("[", "]"), "JsonArray").when(json("{", "}"), "JsonObject").when((holds("+++") | holds("---")) & t.rlike(DIFF_HEADER), "GitDiff")
        .when(logs | frames, "LogOrStackTrace").when(html, "Html").when(found, "SearchResults")
        .when(table, "Tabular").when(code >= 3, "SourceCode").otherwise("PlainText")
    )


def _with_lower(t: Column, words: list[str]) -> Column:
    """Whether a text, lower-cased once, holds any of ``words``."""
    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return F.exists(F.array(F.lower(t)), any_of)


def confidence(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, c in CONFIDENCE.items():
        out = F.when(kind == name, c).otherwise(out)
    return out


def adaptive(text: str = "text", profile: str = "balanced") -> tuple[Column, Column]:
    """(level, rows) for a text: longer texts are treated harder."""
    level, rows = PROFILES[profile]
    at = LADDER.index(level)
    n = T.chars_count(F.coalesce(F.col(text), F.lit("")))
    step = F.when(n >= 25_000, 2).when(n >= 5_000, 1).otherwise(0)
    ladder = F.array(*(F.lit(x) for x in LADDER))
    scaled = F.greatest(F.lit(3), F.floor(F.lit(rows) * F.when(n >= 25_000, 0.35).when(n >= 5_000, 0.6).otherwise(1.0)).cast("int"))
    return F.element_at(ladder, F.least(F.lit(len(LADDER)), F.lit(at + 1) + step)), scaled


def guarded(original: Column, compressed: Column, strategy: Column) -> tuple[Column, Column]:
    """(text, strategy): the original where the result is not smaller."""
    no_gain = (T.chars_count(compressed) >= T.chars_count(original)) & ~strategy.rlike("Passthrough|Error")
    return F.when(no_gain, original).otherwise(compressed), F.when(no_gain, F.concat(strategy, F.lit("→Passthrough(no-gain)"))).otherwise(strategy)


def noisy(text: str = "text") -> Column:
    """Whether a text may hold what ``strip_noise`` takes away: escapes, returns, spinners, blocks, bars with a percentage."""
    t = F.col(text)
    holds = lambda s: F.contains(t, F.lit(s))
    drawn = (F.octet_length(t) > F.length(t)) & t.rlike("[▀-▟⠀-⣿]")
    return holds("\x1b") | holds("\r") | (drawn & t.rlike("[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏█▓▒░]")) | (holds("%") & t.rlike(r"[▉-▏]|\]\s*+\d{1,3}%"))


def strip_noise(text: str = "text") -> Column:
    """Without escapes, overwritten parts of lines, spinners and progress bars."""
    rows = F.split(F.regexp_replace(F.col(text), ANSI, ""), "\n", -1)
    rows = F.transform(rows, lambda x: F.substring_index(x, "\r", -1))
    return F.array_join(F.filter(rows, lambda x: ~x.rlike(SPINNER) & ~x.rlike(BAR)), "\n")


def collapse_success(text: str = "text", command: str = "command", exit_code: str | None = "exit_code") -> Column:
    """The up to three telling lines of a known command that succeeded, else null."""
    cmd = F.lower(F.trim(F.col(command)))
    known = F.lit(False)
    for c in QUIET_COMMANDS:
        known = known | cmd.startswith(c)
    if exit_code is not None:
        known = known & (F.coalesce(F.col(exit_code), F.lit(0)) == 0)
    found = F.flatten(F.array(*(F.regexp_extract_all(F.col(text), F.lit("(?m)" + p), F.lit(0)) for p in SALIENT)))
    facts = F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")), 1, 3)
    return F.when(known & (F.size(facts) > 0), F.array_join(facts, "\n"))


def code_language(text: str = "text") -> Column:
    """The language that the first 500 characters look like."""
    head = F.lower(F.substring(F.col(text), 1, 500))
    has = lambda *words: F.greatest(*(F.contains(head, F.lit(w)) for w in words), F.lit(False))
    python = (has("def ", "import ") | (has("class ") & has(":"))) & ~has("public class", "function ")
    return (
        F.when(python, "python").when(has("public class", "private void", "namespace "), "csharp").when(has("function ", "const ", "=>"), "javascript")
        .when(has("#include"), "cpp").when(has("package ") & has("func "), "go").otherwise("unknown")
    )


def strip_code(text: str = "text") -> Column:
    """Code without comments and blank lines.

    ``//`` and ``#`` begin a comment in every language, also inside strings; a
    first line of ``#!`` stays in Python. Block comments stay in Python only.
    """
    python = code_language(text) == "python"
    rows = T.lines(F.when(python, F.col(text)).otherwise(F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", "")))

    def bare(line: Column, k: Column) -> Column:
        return F.when(python & (k == 0) & line.startswith("#!"), line).otherwise(F.regexp_replace(F.regexp_replace(line, r"(//|#)[^\n]*", ""), r"(?U)\s+$", ""))

    return F.array_join(F.filter(F.transform(rows, bare), lambda x: x.rlike(r"(?U)\S")), "\n")


def log_key(line: Column) -> Column:
    """A log line without timestamps, addresses, thread names and long numbers."""
    k = F.regexp_replace(line, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TS>")
    k = F.regexp_replace(k, r"\b0x[0-9a-fA-F]{4,}\b", "<ADDR>")
    k = F.regexp_replace(k, r"\[(?:Thread|thread|TID|PID)[\s-]?\d+\]|Thread-\d+|pid=\d+", "<THR>")
    return F.regexp_replace(F.regexp_replace(k, r"\b\d{4,}\b", "<N>"), r"(?U)^\s+|\s+$", "")


def log_dedup(df: DataFrame, id_col: str, text: str = "text", max_lines: int = 200) -> DataFrame:
    """Rows (id, pos, line, n): the first of each kind of line, and how many there are.

    Blank lines go. After ``max_lines`` kinds the rest of a text is not read; its
    lines are not counted.
    """
    from pyspark.sql import Window

    rows = df.select(F.col(id_col), F.posexplode(T.lines(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("key", log_key(F.col("line")))
    first = rows.groupBy(id_col, "key").agg(F.min("pos").alias("pos"))
    kinds = first.withColumn("k", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")))
    stop = kinds.where(F.col("k") == max_lines).select(id_col, F.col("pos").alias("stop"))
    live = rows.join(stop, id_col, "left").where(F.coalesce(F.col("pos") <= F.col("stop"), F.lit(True)))
    out = live.groupBy(id_col, "key").agg(F.min(F.struct("pos", "line")).alias("f"), F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("n") > 1, F.concat("f.line", F.lit("  [×"), F.col("n"), F.lit("]"))).otherwise(F.col("f.line"))
    return out.select(id_col, F.col("f.pos").alias("pos"), shown.alias("line"), "n")


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = tables.read(spark, sf_dir, "pages").select(F.lit("p").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    e = tables.read(spark, sf_dir, "events").select(F.lit("e").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("text"))
    out = d.unionByName(p).unionByName(e).select("origin", "id", content_type().alias("type"))
    return out.withColumn("confidence", confidence(F.col("type")))


def adaptive_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, rows = adaptive()
    return tables.read(spark, sf_dir, "documents").select("doc_id", level.alias("level"), rows.alias("rows"))


def anti_expansion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeezed = F.regexp_replace("text", "[ \t]{2,}|(?<=\n)\n+", "")
    text, strategy = guarded(F.col("text"), squeezed, F.lit("Squeeze"))
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), strategy.alias("strategy"))


def noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("\x1b[32m"), F.regexp_replace("text", r"\. ", ".\r"), F.lit("\x1b[0m\n  ⠙\n[====>   ] 40%\n█████ 60%\n---"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", noisy.alias("text")).select("doc_id", strip_noise().alias("clean"))


def code_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", strip_code("html").alias("code"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_dedup(tables.read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", "line", "n")


def success_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of commands made up from events: three lines of noise, one that tells."""
    e = tables.read(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    command = F.when(F.col("event_type") == "click", "npm install left-pad").otherwise("ls -l")
    out = F.concat(F.lit("fetching\nadded "), F.col("user_id"), F.lit(" packages in 2s\n\nfound 0 vulnerabilities\nadded "), F.col("user_id"), F.lit(" packages in 2s\ndone"))
    return e.select("event_id", command.alias("command"), out.alias("text"), F.lit(0).alias("exit_code")).select("event_id", collapse_success().alias("summary"))


_SPACE = r"[\s\v\x{85}\p{Z}]"
_TS = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}:\d{2}:\d{2}(?:\.\d+)?"
_LINES = r"regexp_split_to_array({t}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"

QUERIES = {
    "content_type": content_types,
    "adaptive_level": adaptive_level,
    "anti_expansion_guard": anti_expansion_guard,
    "strip_noise": noise_strip,
    "code_strip": code_strip,
    "log_dedup": log_lines,
    "success_collapse": success_collapse,
}
ORACLES = {
    "content_type": rf"""WITH a AS (SELECT 'd' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages UNION ALL SELECT 'e', event_id, props FROM events),
      b AS (SELECT *, trim(text, E' \t\n\r\x0b\x0c') AS s, {_LINES.format(t="text")} AS ls FROM a),
      c AS (SELECT origin, id, CASE WHEN s = '' THEN 'PlainText' WHEN s[1] = '[' AND s[-1] = ']' AND json_valid(text) THEN 'JsonArray' WHEN s[1] = '{{' AND s[-1] = '}}' AND json_valid(text) THEN 'JsonObject'
        WHEN regexp_matches(text, '(?m)^(\+\+\+|---)\s') THEN 'GitDiff'
        WHEN len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\b(ERROR|WARN(?:ING)?|INFO|DEBUG|FATAL|TRACE)\b'))) >= 2 OR len(regexp_extract_all(text, '(?m)^\s+at\s+\S')) >= 2 THEN 'LogOrStackTrace'
        WHEN {" OR ".join(f"contains(lower(text), '{m}')" for m in HTML_MARKERS)} THEN 'Html'
        WHEN regexp_matches(text, '(?m)^\s*\d+\.\s+\S') OR regexp_matches(text, '(?m)^[A-Za-z0-9_./@\-\\][^:\n]*:\d+:\S') THEN 'SearchResults'
        WHEN length(text) - length(replace(text, '|', '')) > 4 AND len(list_filter(ls[1:5], lambda x: starts_with(x, '|'))) > 0 THEN 'Tabular'
        WHEN {" + ".join(f"contains(text, '{m}')::INT" for m in CODE_SIGNS)} >= 3 THEN 'SourceCode' ELSE 'PlainText' END AS type FROM b)
      SELECT origin, id, type, CASE type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in CONFIDENCE.items())} END::DOUBLE AS confidence FROM c""",
    "adaptive_level": "SELECT doc_id, CASE WHEN length(text) // 4 >= 5000 THEN 'aggressive' ELSE 'semantic' END AS level, CASE WHEN length(text) // 4 >= 25000 THEN 5 WHEN length(text) // 4 >= 5000 THEN 9 ELSE 15 END::INTEGER AS rows FROM documents",
    "anti_expansion_guard": r"""SELECT conv_id, turn, CASE WHEN length(c) // 4 >= length(text) // 4 THEN text ELSE c END AS text, CASE WHEN length(c) // 4 >= length(text) // 4 THEN 'Squeeze→Passthrough(no-gain)' ELSE 'Squeeze' END AS strategy
      FROM (SELECT *, regexp_replace(regexp_replace(text, '[ \t]{2,}', '', 'g'), '\n+', E'\n', 'g') AS c FROM conversations)""",
    "strip_noise": r"SELECT doc_id, array_to_string(list_transform(str_split(text, chr(10)), lambda x: list_last(str_split(replace(x, '. ', E'.\r'), E'\r'))), chr(10)) || E'\n---' AS clean FROM documents",
    "log_dedup": rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, {_LINES.format(t="text")} AS ls FROM documents)),
      k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '{_TS}', '<TS>', 'g'), '\b0x[0-9a-fA-F]{{4,}}\b', '<ADDR>', 'g'), '\[(?:Thread|thread|TID|PID)[\s-]?\d+\]|Thread-\d+|pid=\d+', '<THR>', 'g'), '\b\d{{4,}}\b', '<N>', 'g')) AS key FROM l WHERE trim(line) <> ''),
      f AS (SELECT doc_id, key, min(pos) AS first FROM k GROUP BY doc_id, key), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS kind FROM f),
      s AS (SELECT doc_id, first AS stop FROM r WHERE kind = 200), g AS (SELECT doc_id, key, count(*) AS n, min(pos) AS pos, arg_min(line, pos) AS line FROM k LEFT JOIN s USING (doc_id) WHERE stop IS NULL OR pos <= stop GROUP BY doc_id, key)
      SELECT doc_id, pos::INTEGER AS pos, CASE WHEN n > 1 THEN line || '  [×' || n || ']' ELSE line END AS line, n FROM g""",
    "code_strip": rf"""WITH h AS (SELECT page_id, html, lower(html[1:500]) AS h FROM pages), l AS (SELECT page_id, (contains(h, 'def ') OR contains(h, 'import ') OR (contains(h, 'class ') AND contains(h, ':'))) AND NOT contains(h, 'public class') AND NOT contains(h, 'function ') AS py, html FROM h),
      r AS (SELECT page_id, py, {_LINES.format(t="CASE WHEN py THEN html ELSE regexp_replace(html, '(?s)/[*].*?[*]/', '', 'g') END")} AS ls FROM l)
      SELECT page_id, array_to_string(list_filter(list_transform(ls, lambda x, i: CASE WHEN py AND i = 1 AND starts_with(x, '#!') THEN x ELSE regexp_replace(regexp_replace(x, '(//|#)[^\n]*', ''), '{_SPACE}+$', '') END), lambda x: regexp_matches(x, '[^\s\v\x{{85}}\p{{Z}}]')), chr(10)) AS code FROM r""",
    "success_collapse": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'added ' || user_id || E' packages in 2s\\nfound 0 vulnerabilities' END AS summary FROM events WHERE event_type IN ('click', 'view')",
}

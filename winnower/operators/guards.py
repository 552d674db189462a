"""Guards: injection, safety, secrets, waste, cache alignment, shaping, requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.sources import tables

# Fixed values: (category, pattern, weight); each fires once, case is ignored.
INJECTION = [
    ("Instruction Override", r"\b(ignore|disregard|forget)\b.{0,30}\b(previous|prior|above|earlier|all)\b.{0,30}\b(instructions?|prompts?|rules?)\b", 30),
    ("Instruction Override", r"\b(ignora|dimentica)\b.{0,30}\b(le istruzioni|il prompt|le regole)\b", 30),
    ("Instruction Override", r"\bnew instructions?\s*:", 20),
    ("System Prompt Exfiltration", r"\b(repeat|reveal|show|print|output)\b.{0,20}\b(your|the)\b.{0,20}\b(system prompt|instructions|initial prompt)\b", 30),
    ("System Prompt Exfiltration", r"\bwhat (are|were) your (instructions|rules|guidelines)\b", 25),
    ("Role Hijack", r"\byou are now\b.{0,30}\b(dan|jailbroken|unrestricted|uncensored)\b", 35),
    ("Role Hijack", r"\b(developer mode|dan mode|jailbreak)\b", 30),
    ("Role Hijack", r"\bpretend (you are|to be)\b.{0,30}\bno (restrictions|rules|filters)\b", 30),
    ("Role Hijack", r"\bact as if\b.{0,30}\b(no|without)\b.{0,20}\b(restrictions|filters|guidelines|rules)\b", 25),
    ("Delimiter Injection", r"<\|im_start\|>\s*(system|assistant)", 35),
    ("Delimiter Injection", r"\[\s*(system|SYSTEM)\s*\]\s*:", 25),
    ("Delimiter Injection", r"```\s*system\b", 20),
    ("Encoded Payload", r"\b[A-Za-z0-9+/]{80,}={0,2}\b", 15),
    ("Data Exfiltration Coercion", r"\bsend\b.{0,30}\b(api key|password|secret|credentials)\b.{0,30}\bto\b", 30),
]

# Phrases of each level of safety, in the order in which they are tried.
CRITICAL = ["security", "vulnerability", "exploit", "cve-", "data breach", "leak", "exposed", "malware", "ransomware", "trojan", "authentication bypass", "unauthorized access", "remote code execution", "rce", "sql injection", "sqli", "xss", "csrf", "privilege escalation", "denial of service", "dos", "ddos", "buffer overflow", "overflow", "certificate expired", "tls", "ssl", "encryption key", "private key", "secret exposed", "firewall", "intrusion"]
DESTRUCTIVE = ["rm -rf", "del /f", "format ", "mkfs", "dd if=", "> /dev/sda", "> /dev/sd", "drop database", "drop table", "truncate table", "delete from", "shutdown", "reboot", "chmod 777", "chown -r", "git push --force", "git reset --hard", ">|", ":!q", ":w!", "cargo clean", "npm cache clean", "docker rmi -f", "docker system prune -a"]
WARNING = ["warning", "caution", "important", "do not", "never", "avoid", "deprecated", "removed", "obsolete", "experimental", "unstable", "untested", "backup", "back up", "permission denied", "access denied", "rate limit", "timeout", "irreversible", "irreversibile", "production", "prod", "deploy", "rollback", "migration"]

# Shapes of secrets, in order (Java spelling, RE2 spelling).
SECRETS = [
    ("private-key-block", r"-----BEGIN[\s\S]*?PRIVATE KEY-----", r"-----BEGIN[\s\S]*?PRIVATE KEY-----"),
    ("aws-access-key", r"(?<![A-Z0-9])AKIA[A-Z0-9]{16,}(?![A-Z0-9])", r"(?:^|[^A-Z0-9])AKIA[A-Z0-9]{16,}(?:[^A-Z0-9]|$)"),
    ("github-token", r"\bghp_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b", r"\bghp_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("slack-token", r"\bxox[bp]-[A-Za-z0-9-]{10,}\b", r"\bxox[bp]-[A-Za-z0-9-]{10,}\b"),
    ("api-secret-key", r"(?<![A-Za-z])sk-[A-Za-z0-9]{20,}\b", r"(?:^|[^A-Za-z])sk-[A-Za-z0-9]{20,}\b"),
    ("bearer-token", r"Authorization:\s*Bearer\s+[A-Za-z0-9._-]{20,}", r"Authorization:\s*Bearer\s+[A-Za-z0-9._-]{20,}"),
    ("aws-secret-line", r"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)\s*=\s*[A-Za-z0-9/+=]{30,}", r"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)\s*=\s*[A-Za-z0-9/+=]{30,}"),
]
DOTENV = r"(?m)^[ \t]*[A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|APIKEY|API_KEY)[A-Z0-9_]*=[ \t]*\S.*$"
SCANNED = 64 * 1024

# Waste and volatile shapes.
WASTE = {"html": r"<[^>]{1,200}>|<!--[\s\S]*?-->", "base64": r"[A-Za-z0-9+/]{50,}={0,2}", "whitespace": r"[ \t]{4,}|\n{3,}", "json": r"\{[\s\S]{500,}\}"}
VOLATILE = [
    ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("ISO8601", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?"),
    ("JWT", r"[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}"),
    ("HexHash", r"\b[0-9a-fA-F]{32}\b|\b[0-9a-fA-F]{40}\b|\b[0-9a-fA-F]{64}\b"),
]

# Texts that steer an assistant's verbosity, by level.
STEER_1 = 'Skip preamble and postamble. Do not say things like "Sure!", "Of course!", "Great question!", "Certainly!", "I\'d be happy to...", "Let me...", or similar. Start with substance immediately.'
STEER_2 = "Never restate or echo back code, file contents, diffs, or tool output shown in context. Do not repeat what was provided. If you need to refer to it, use filename:line references."
STEER_3 = "Give conclusions and results only. Do not explain your reasoning unless explicitly asked."
STEER_4 = "Minimum token response. Sentence fragments are fine. No preamble. No postamble. No restatement. No reasoning."
STEERING = {1: STEER_1, 2: f"{STEER_1}\n{STEER_2}", 3: f"{STEER_1}\n{STEER_2}\n{STEER_3}", 4: STEER_4}
SENTINEL = "<!-- winnower-verbosity-"

# Commands that get a flag, and where it goes.
REWRITES = [("git log", "--no-pager", "git"), ("git show", "--no-pager", "git"), ("git diff", "--no-pager", "git"), ("npm install", "--no-fund --no-audit", "npm install"), ("npm ci", "--no-fund --no-audit", "npm ci"), ("pip install", "--quiet", "pip install")]
COMPOSITE = r"\$\(|`|\||&&|;|>|<|\n"

# Rules for requests, in order (category, name, severity, pattern, target); case is ignored.
REQUEST_RULES = [
    ("SqlInjection", "UNION SELECT", "High", r"\bunion\b\s+\bselect\b", "url"),
    ("SqlInjection", "SELECT ... FROM", "Medium", r"\bselect\b[\s\S]{1,60}\bfrom\b", "url"),
    ("SqlInjection", "OR 1=1", "High", r"\bor\b\s+\d+\s*=\s*\d+", "url"),
    ("SqlInjection", "SQL comment / stacked", "Medium", r"('|%27)\s*(;|--|#)", "url"),
    ("SqlInjection", "Time-based", "High", r"\b(sleep|benchmark|pg_sleep|waitfor\s+delay)\s*\(", "url"),
    ("SqlInjection", "information_schema", "High", r"information_schema|\bdrop\b\s+\btable\b|\binsert\b\s+\binto\b", "url"),
    ("Xss", "<script>", "High", r"<\s*script\b", "url"),
    ("Xss", "event handler", "Medium", r"\bon(error|load|click|mouseover)\s*=", "url"),
    ("Xss", "javascript: URI", "Medium", r"javascript:\s*\w", "url"),
    ("Xss", "iframe/svg/img onload", "Medium", r"<\s*(iframe|svg|img)\b[^>]*on\w+\s*=", "url"),
    ("Xss", "document.cookie", "Medium", r"document\s*\.\s*cookie", "url"),
    ("PathTraversal", "../ traversal", "High", r"(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|%252e%252e)", "url"),
    ("PathTraversal", "sensitive file", "High", r"(/etc/passwd|/etc/shadow|c:\\windows|boot\.ini|win\.ini)", "url"),
    ("CommandInjection", "shell chain", "High", r"(;|\||&&)\s*(cat|ls|id|whoami|wget|curl|nc|bash|sh|rm|chmod|ping)\b", "url"),
    ("CommandInjection", "command substitution", "High", r"\$\([^)]+\)|`[^`]+`", "url"),
    ("ScannerProbe", "config/secret probe", "Medium", r"(/\.env|/\.git/|/\.aws/|/\.ssh/|/config\.php|/wp-config)", "url"),
    ("ScannerProbe", "CMS/admin probe", "Low", r"(/wp-login|/wp-admin|/xmlrpc\.php|/phpmyadmin|/administrator/|/boaform|/owa/)", "url"),
    ("ScannerProbe", "PHP probe", "Low", r"\.(php|asp|jsp|cgi)(\?|$)", "url"),
    ("BadUserAgent", "attack tool", "High", r"(sqlmap|nikto|nmap|masscan|acunetix|nessus|dirbuster|gobuster|wpscan|hydra|metasploit|zgrab|nuclei|fuzzer)", "ua"),
]

STYLE_NOTICES = {
    "en": "This content was processed with the help of an AI system.",
    "it": "Questo contenuto è stato elaborato con l'aiuto di un sistema di IA.",
    "de": "Dieser Inhalt wurde mit Hilfe eines KI-Systems verarbeitet.",
    "fr": "Ce contenu a été traité à l'aide d'un système d'IA.",
    "es": "Este contenido se ha procesado con la ayuda de un sistema de IA.",
}


#: What a text must hold, lower-cased, for a pattern to be tried at all.
HINTS = {
    0: ["ignore", "disregard", "forget"], 1: ["ignora", "dimentica"], 2: ["new instruction"], 3: ["system prompt", "instructions", "initial prompt"], 4: ["your"], 5: ["you are now"],
    6: ["developer mode", "dan mode", "jailbreak"], 7: ["pretend"], 8: ["act as if"], 9: ["<|im_start|>"], 10: ["system"], 11: ["```"], 13: ["send"],
}


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def injection(text: str = "text", patterns: list[tuple[str, str, int]] | None = None) -> Column:
    """A struct (score, risk, categories) of a text, in one pass over it."""
    hints = HINTS if patterns is None else {}
    patterns = INJECTION if patterns is None else patterns

    def fires(k: int, p: str, x: Column) -> Column:
        there = F.lit(k not in hints)
        for word in hints.get(k, []):
            there = there | F.contains(x["low"], F.lit(word))
        return there & x["text"].rlike("(?i)" + p)

    def some(x: Column) -> Column:
        return F.filter(F.array(*(F.when(fires(k, p, x), F.struct(F.lit(c).alias("c"), F.lit(w).alias("w"))) for k, (c, p, w) in enumerate(patterns))), lambda y: y.isNotNull())

    def once(value: Column, f) -> Column:
        """``f`` of a value that is made once a text, as the variable of a function."""
        return F.transform(F.array(value), f)[0]

    def told(fired: Column, score: Column) -> Column:
        risk = F.when(score == 0, "Safe").when(score <= 20, "Low").when(score <= 45, "Medium").when(score <= 70, "High").otherwise("Critical")
        return F.struct(score.alias("score"), risk.alias("risk"), F.array_sort(F.array_distinct(F.transform(fired, lambda x: x["c"]))).alias("categories"))

    def scored(fired: Column) -> Column:
        return once(F.least(F.lit(100), F.aggregate(fired, F.lit(0), lambda a, x: a + x["w"])), lambda score: told(fired, score))

    return once(F.struct(F.col(text).alias("text"), F.lower(F.col(text)).alias("low")), lambda x: once(some(x), scored))


def _bounded(phrase: str, java: bool = True) -> str:
    body = "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in phrase)
    left = ("(?<![A-Za-z0-9])" if java else "(?:^|[^A-Za-z0-9])") if phrase[0].isalnum() else ""
    right = ("(?![A-Za-z0-9])" if java else "(?:[^A-Za-z0-9]|$)") if phrase[-1].isalnum() else ""
    return "(?i)" + left + body + right


def safety(text: str = "text", extra_critical: list[str] | None = None, extra_warning: list[str] | None = None) -> Column:
    """A struct (level, phrase); the first phrase that occurs decides."""
    out = F.struct(F.lit("Normal").alias("level"), F.lit("").alias("phrase"))
    ladder = [("Critical", CRITICAL + (extra_critical or [])), ("Critical", DESTRUCTIVE), ("Warning", WARNING + (extra_warning or []))]
    t, low = F.col(text), F.lower(F.col(text))
    for level, phrases in reversed(ladder):
        for p in reversed(phrases):
            # a search for the bare phrase is much cheaper than the pattern with its bounds
            out = F.when(F.contains(low, F.lit(p)) & t.rlike(_bounded(p)), F.struct(F.lit(level).alias("level"), F.lit(p).alias("phrase"))).otherwise(out)
    return out


def secret_class(text: str = "text") -> Column:
    """The class of the first secret shape in the first 65,536 characters, else null."""
    t = F.substring(F.col(text), 1, SCANNED)
    out = F.when(F.regexp_count(t, F.lit(DOTENV)) >= 3, "dotenv-bulk-secrets")
    for name, p, _ in reversed(SECRETS):
        out = F.when(t.rlike(p), name).otherwise(out)
    return out


def waste(text: str = "text") -> list[Column]:
    """Estimated tokens of each kind of waste."""
    return [F.aggregate(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")).alias(f"{k}_tokens") for k, p in WASTE.items()]


def volatile(text: str = "text") -> Column:
    """(label, sample) of each kind of volatile token, its first occurrence, 40 characters."""
    t = F.col(text)
    return F.filter(F.array(*(F.when(t.rlike(p), F.struct(F.lit(k).alias("label"), F.substring(F.regexp_extract(t, f"({p})", 1), 1, 40).alias("sample"))) for k, p in VOLATILE)), lambda x: x.isNotNull())


def align(text: str = "text") -> Column:
    """A struct (prompt, moved): blocks with volatile tokens go last, in order."""
    t = F.col(text)
    some = "|".join(f"(?:{p})" for _, p in VOLATILE)

    def arranged(sep: str) -> tuple[Column, Column, Column]:
        parts = F.filter(F.split(t, sep, -1), lambda b: b.rlike(r"(?U)\S"))
        stable, moving = F.filter(parts, lambda b: ~b.rlike(some)), F.filter(parts, lambda b: b.rlike(some))
        return F.size(parts), F.array_join(F.concat(stable, moving), sep), F.when((F.size(stable) > 0), F.size(moving)).otherwise(0)

    n, by_block, moved = arranged("\n\n")
    n_lines, by_line, moved_lines = arranged("\n")
    new = F.when(n >= 2, by_block).when(n_lines >= 2, by_line).otherwise(t)
    count = F.when(n >= 2, moved).when(n_lines >= 2, moved_lines).otherwise(0)
    changed = (count > 0) & (new != t)
    return F.struct(F.when(changed, new).otherwise(t).alias("prompt"), F.when(changed, count).otherwise(0).alias("moved"))


def unshape(text: str = "text") -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit(SENTINEL)), F.regexp_replace(F.substring_index(t, SENTINEL, 1), r"[\n\r ]+$", "")).otherwise(t)


def shape(text: str, level: int) -> Column:
    """A prompt with the steering of a level, once."""
    if level == 0:
        return F.col(text)
    mark = f"{SENTINEL}{level} -->"
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit(mark)), t).otherwise(F.concat(F.regexp_replace(unshape(text), r"(?U)\s+$", ""), F.lit(f"\n\n{mark}\n{STEERING[level]}")))


def rewrite_command(command: str = "command") -> Column:
    """The command with a flag that quiets it; composites stay as they are."""
    c = F.trim(F.col(command))
    out = F.col(command)
    for prefix, flag, head in reversed(REWRITES):
        fits = (c == prefix) | c.startswith(prefix + " ")
        new = F.when(F.contains(c, F.lit(flag)), F.col(command)).otherwise(F.concat(F.lit(f"{head} {flag}"), F.substring(c, len(head) + 1, 1 << 30)))
        out = F.when(fits, new).otherwise(out)
    return F.when(c.rlike(COMPOSITE), F.col(command)).otherwise(out)


def inspect_request(url: str, agent: str | None = None, disabled: list[str] | None = None) -> Column:
    """A struct (category, rule, severity, sample) of the first rule that fits, else null.

    A url is looked at raw and decoded.
    """
    raw = F.coalesce(F.col(url), F.lit(""))
    target = F.concat(raw, F.lit(" "), F.coalesce(F.try_url_decode(raw), raw))
    ua = F.coalesce(F.col(agent), F.lit("")) if agent else F.lit("")
    out = F.lit(None).cast("struct<category:string,rule:string,severity:string,sample:string>")
    for category, name, severity, pattern, where in reversed(REQUEST_RULES):
        if disabled and category in disabled:
            continue
        hay = ua if where == "ua" else target
        sample = F.substring(F.regexp_extract(hay, f"(?i)({pattern})", 1), 1, 120)
        out = F.when(hay.rlike("(?i)" + pattern), F.struct(F.lit(category).alias("category"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), sample.alias("sample"))).otherwise(out)
    return out


def notice(lang: str = "lang", override: str | None = None) -> Column:
    """The transparency notice in a row's language; English where there is none."""
    if override is not None:
        return F.lit(override)
    table = F.create_map([F.lit(x) for kv in STYLE_NOTICES.items() for x in kv])
    return F.coalesce(table[F.lower(F.col(lang))], F.lit(STYLE_NOTICES["en"]))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), "text")
    c = tables.read(spark, sf_dir, "conversations").select(F.lit("c").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.unionByName(c)


_UNION = "(SELECT 'd' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations)"


def prompt_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _texts(spark, sf_dir).withColumn("r", injection())
    return out.select("origin", "id", F.col("r.score").cast("long").alias("score"), F.col("r.risk").alias("risk"), F.array_join("r.categories", ",").alias("categories"))


def safety_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("origin", "id", safety().alias("s")).select("origin", "id", "s.level", "s.phrase")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("origin", "id", secret_class().alias("secret"))


def waste_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", *waste("html"))


def waste_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.read(spark, sf_dir, "conversations").select("conv_id", *waste())
    return w.groupBy("conv_id").agg(*(F.sum(f"{k}_tokens").alias(f"{k}_tokens") for k in WASTE))


def cache_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("origin", "id", F.explode(volatile()).alias("v")).select("origin", "id", "v.label", "v.sample")


def cache_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("origin", "id", align().alias("a")).select("origin", "id", "a.prompt", "a.moved")


def verbosity_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").where("role = 'system'")
    once = c.withColumn("shaped", shape("text", 2)).withColumn("twice", shape("shaped", 2)).withColumn("bare", unshape("twice"))
    return once.select("conv_id", "turn", "twice", "bare")


def command_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands made up from events."""
    cmd = F.element_at(F.array(*(F.lit(x) for x in ("git log -3", "git log --no-pager", "npm ci", "pip install x && rm y", "ls -l", " pip install pandas", "git diffx"))), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return tables.read(spark, sf_dir, "events").select("event_id", cmd.alias("command")).select("event_id", "command", rewrite_command().alias("rewritten"))


def waf_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", "?q=1%20UNION%20SELECT%20a", "?x=<script>", "/../../etc/passwd", "/index.php", "?c=;cat%20x", "?n=' --"))), (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    agent = F.when(F.pmod("page_id", F.lit(5)) == 0, "sqlmap/1.0").otherwise("Mozilla/5.0")
    p = tables.read(spark, sf_dir, "pages").select("page_id", F.concat(F.split("url", "[?#]")[0], tail).alias("url"), agent.alias("ua"))
    return p.select("page_id", inspect_request("url", "ua").alias("r")).select("page_id", "r.category", "r.rule", "r.severity", "r.sample")


def transparency_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", notice().alias("notice"))


def _first(phrases: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, {_sql(_bounded(p, False))}) THEN {_sql(p)}" for p in phrases) + " END"


def _w(col: str, p: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({col}, {_sql(p)}), lambda x: greatest(1, length(x) // 4))), 0)::BIGINT"


_FIRED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_sql('(?i)' + p)}) THEN {{'c': '{c}', 'w': {w}}} END" for c, p, w in INJECTION) + "], lambda x: x IS NOT NULL)"
_SOME = _sql("|".join(f"(?:{p})" for _, p in VOLATILE))
_URL = "regexp_replace(url, '[?#].*$', '') || ['', '?q=1%20UNION%20SELECT%20a', '?x=<script>', '/../../etc/passwd', '/index.php', '?c=;cat%20x', '?n='' --'][page_id % 7 + 1]"

QUERIES = {
    "prompt_injection": prompt_injection, "safety_level": safety_level, "secret_class": secrets, "waste_tokens": waste_tokens, "waste_by_conversation": waste_by_conversation,
    "cache_volatile": cache_volatile, "cache_align": cache_align, "verbosity_shape": verbosity_shape, "rewrite_command": command_rewrites, "waf_inspect": waf_inspect, "transparency_notice": transparency_notice,
}
ORACLES = {
    "prompt_injection": f"""SELECT origin, id, score, CASE WHEN score = 0 THEN 'Safe' WHEN score <= 20 THEN 'Low' WHEN score <= 45 THEN 'Medium' WHEN score <= 70 THEN 'High' ELSE 'Critical' END AS risk, categories FROM (
        SELECT origin, id, least(100, coalesce(list_sum(list_transform(f, lambda x: x.w)), 0))::BIGINT AS score, array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.c))), ',') AS categories FROM (SELECT origin, id, {_FIRED} AS f FROM {_UNION}))""",
    "safety_level": f"""SELECT origin, id, CASE WHEN c IS NOT NULL OR d IS NOT NULL THEN 'Critical' WHEN w IS NOT NULL THEN 'Warning' ELSE 'Normal' END AS level, coalesce(c, d, w, '') AS phrase FROM (
        SELECT origin, id, {_first(CRITICAL)} AS c, {_first(DESTRUCTIVE)} AS d, {_first(WARNING)} AS w FROM {_UNION})""",
    "secret_class": "SELECT origin, id, CASE " + " ".join(f"WHEN regexp_matches(text[1:{SCANNED}], {_sql(p)}) THEN '{n}'" for n, _, p in SECRETS) + f" WHEN len(regexp_extract_all(text[1:{SCANNED}], {_sql(DOTENV)})) >= 3 THEN 'dotenv-bulk-secrets' END AS secret FROM {_UNION}",
    "waste_tokens": "SELECT page_id, " + ", ".join(f"{_w('html', p)} AS {k}_tokens" for k, p in WASTE.items()) + " FROM pages",
    "waste_by_conversation": "SELECT conv_id, " + ", ".join(f"sum({_w('text', p)})::BIGINT AS {k}_tokens" for k, p in WASTE.items()) + " FROM conversations GROUP BY conv_id",
    "cache_volatile": " UNION ALL ".join(f"SELECT origin, id, '{k}' AS label, regexp_extract(text, {_sql(p)})[1:40] AS sample FROM {_UNION} WHERE regexp_matches(text, {_sql(p)})" for k, p in VOLATILE),
    "cache_align": f"""WITH a AS (SELECT origin, id, text, list_filter(str_split(text, E'\\n\\n'), lambda b: regexp_matches(b, '\\S')) AS p, list_filter(str_split(text, E'\\n'), lambda b: regexp_matches(b, '\\S')) AS l FROM {_UNION}),
        b AS (SELECT *, CASE WHEN len(p) >= 2 THEN p WHEN len(l) >= 2 THEN l END AS u, CASE WHEN len(p) >= 2 THEN E'\\n\\n' ELSE E'\\n' END AS sep FROM a),
        c AS (SELECT *, list_filter(u, lambda x: NOT regexp_matches(x, {_SOME})) AS s, list_filter(u, lambda x: regexp_matches(x, {_SOME})) AS v FROM b),
        d AS (SELECT *, CASE WHEN len(p) >= 2 THEN array_to_string(s || v, E'\\n\\n') ELSE array_to_string(s || v, E'\\n') END AS new, u IS NOT NULL AND len(s) > 0 AND len(v) > 0 AS can FROM c)
        SELECT origin, id, CASE WHEN can AND new <> text THEN new ELSE text END AS prompt, CASE WHEN can AND new <> text THEN len(v) ELSE 0 END::INTEGER AS moved FROM d""",
    "verbosity_shape": f"SELECT conv_id, turn, regexp_replace(text, '\\s+$', '') || E'\\n\\n' || {_sql(SENTINEL + '2 -->')} || E'\\n' || {_sql(STEER_1)} || E'\\n' || {_sql(STEER_2)} AS twice, regexp_replace(text, '\\s+$', '') AS bare FROM conversations WHERE role = 'system'",
    "rewrite_command": """SELECT event_id, command, CASE command WHEN 'git log -3' THEN 'git --no-pager log -3' WHEN 'npm ci' THEN 'npm ci --no-fund --no-audit' WHEN ' pip install pandas' THEN 'pip install --quiet pandas' ELSE command END AS rewritten
        FROM (SELECT event_id, ['git log -3', 'git log --no-pager', 'npm ci', 'pip install x && rm y', 'ls -l', ' pip install pandas', 'git diffx'][event_id % 7 + 1] AS command FROM events)""",
    "waf_inspect": f"""WITH p AS (SELECT page_id, u || ' ' || url_decode(u) AS target, CASE WHEN page_id % 5 = 0 THEN 'sqlmap/1.0' ELSE 'Mozilla/5.0' END AS ua FROM (SELECT page_id, {_URL} AS u FROM pages)),
        r(o, category, rule, severity, pattern, target_kind) AS (VALUES {", ".join(f"({i}, {_sql(c)}, {_sql(n)}, {_sql(s)}, {_sql('(?i)' + q)}, {_sql(t)})" for i, (c, n, s, q, t) in enumerate(REQUEST_RULES))}),
        m AS (SELECT page_id, o, category, rule, severity, regexp_extract(CASE WHEN target_kind = 'ua' THEN ua ELSE target END, pattern)[1:120] AS sample FROM p, r WHERE regexp_matches(CASE WHEN target_kind = 'ua' THEN ua ELSE target END, pattern)),
        f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY o) = 1)
        SELECT p.page_id, category, rule, severity, sample FROM p LEFT JOIN f USING (page_id)""",
    "transparency_notice": "SELECT doc_id, CASE lang " + " ".join(f"WHEN '{k}' THEN {_sql(v)}" for k, v in STYLE_NOTICES.items()) + " END AS notice FROM documents",
}

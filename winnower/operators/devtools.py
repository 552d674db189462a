"""Development tools: commit messages and reviews of diffs, symbols of source code.

Diffs are tables (id, diff); their lines are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnower.sources import tables

# The first word that occurs gives a commit's type; words that mean a break; words that are no subject.
TYPES = [("feat:", "feat"), ("feature:", "feat"), ("add", "feat"), ("new", "feat"), ("implement", "feat"), ("bug", "fix"), ("fix", "fix"), ("hotfix", "fix"), ("patch", "fix"), ("doc", "docs"), ("style", "style"), ("format", "style"), ("refactor", "refactor"), ("perf", "perf"), ("optimize", "perf"), ("test", "test"), ("chore", "chore"), ("bump", "chore"), ("update dep", "chore"), ("upgrade", "chore"), ("ci", "ci"), ("pipeline", "ci"), ("build", "ci")]
BREAKING = ["breaking", "breaking change", "major", "remove", "removed", "api change"]
STOP = "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between out off over under again further then once this that these those not or and but if because so than too very just also about now get got set".split()
SECURITY = ["password", "secret", "token", "apikey", "api_key", "connectionstring", "connstring", "plaintext", "base64", "decrypt", "eval(", "exec(", "shell_exec"]
BUGS = ["null", "nullptr", "null reference", "nullreference", "exception", "throw", "catch", "todo", "hack", "fixme", "xxx", "undefined", "undef", "memory leak", "deadlock", "infinite loop", "crash", "sqli", "xss", "injection", "exploit"]
SLOW = ["for(", "foreach(", "while(", "n+1", "select *", "orderby", "sort", "distinct", "recursive", "iteration"]
CHECKED = r"!=|== null|is null|\?\.|\?\?"
CLASS = r"\b(class|interface|struct|enum|record)\s+(\w+)"
METHOD = r"(?:public|private|protected|internal|static|virtual|override|async|unsafe|\s)+\s+(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\("
DEF = r"^(func|def|function|sub)\s+(\w+)"


def diff_lines(diffs: DataFrame, id_col: str, diff: str = "diff") -> DataFrame:
    """Rows (id, pos, kind, content, line, file) of a diff's added, removed and context lines."""
    rows = diffs.select(F.col(id_col), F.posexplode(F.split(diff, "\n", -1)).alias("pos", "raw"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file_ = F.when(F.col("raw").rlike(r"^\+\+\+ b/"), F.substring("raw", 7, 1 << 30))
    head = F.when(F.col("raw").rlike(r"^@@ -\d+(?:,\d+)? \+\d+"), F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    rows = rows.withColumn("file", F.last(file_, ignorenulls=True).over(w)).withColumn("hunk", F.last(F.when(head.isNotNull(), F.col("pos")).when(file_.isNotNull(), F.lit(-1)), ignorenulls=True).over(w)).withColumn("head", F.last(head, ignorenulls=True).over(w))
    kind = F.when(F.col("raw").rlike(r"^(\+\+\+|---)"), "header").when(F.col("raw").startswith("+"), "add").when(F.col("raw").startswith("-"), "del").when(F.col("raw").startswith(" "), "same").otherwise("other")
    rows = rows.withColumn("kind", kind).withColumn("content", F.trim(F.substring("raw", 2, 1 << 30)))
    in_hunk = Window.partitionBy(id_col, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.count_if(F.col("kind").isin("add", "del", "same")).over(in_hunk), F.lit(0))
    return rows.withColumn("line", F.when(F.col("hunk") >= 0, F.col("head") + step).cast("int")).select(id_col, "pos", "kind", "content", "line", "file")


def commit_messages(diffs: DataFrame, id_col: str, diff: str = "diff") -> DataFrame:
    """Rows (id, type, scope, subject, message): a conventional commit message for each diff."""
    rows = diff_lines(diffs, id_col, diff)
    changed = F.col("kind").isin("add", "del") & (F.col("content") != "")
    words = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]+|[a-z]{3,}\b"), F.lit(0)), F.lower), lambda w: ~w.isin(STOP))
    order = F.when(F.col("kind") == "add", F.col("pos")).otherwise(F.col("pos") + (1 << 30))
    per = rows.withColumn("_low", F.lower("content")).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(changed, F.struct(order.alias("o"), F.col("_low").alias("low"), F.slice(words, 1, 3).alias("w"))))).alias("c"),
        F.count_if(changed & (F.col("kind") == "add")).alias("added"), F.count_if(changed & (F.col("kind") == "del")).alias("removed"), F.array_sort(F.collect_set("file")).alias("files"),
    )
    text = F.array_join(F.transform("c", lambda x: x["low"]), " ")
    kind = F.when(F.col("removed") > F.col("added"), "fix").otherwise("feat")
    for word, name in reversed(TYPES):
        kind = F.when(F.contains(F.col("_text"), F.lit(word)), name).otherwise(kind)
    breaking = F.lit(False)
    for word in BREAKING:
        breaking = breaking | F.contains(F.col("_text"), F.lit(word))
    dirs = F.array_distinct(F.filter(F.transform("files", lambda f: F.split(f, "/")[0]), lambda d: d != ""))
    scope = F.when((F.size(dirs) == 1) & (F.length(dirs[0]) <= 15), dirs[0])
    stems = F.transform(F.slice("files", 1, 2), lambda f: F.lower(F.regexp_replace(F.element_at(F.split(f, "/"), -1), r"(?<=.)\.[^.]*$", "")))
    keys = F.slice(F.array_distinct(F.flatten(F.transform("c", lambda x: x["w"]))), 1, 5)
    keys = F.when(F.size(keys) > 0, keys).otherwise(stems)
    subject = F.when(F.size(keys) == 0, "update project files").otherwise(F.array_join(keys, " "))
    out = per.withColumn("_text", text).withColumn("type", kind).withColumn("_breaking", breaking).withColumn("scope", scope).withColumn("subject", subject)
    out = out.withColumn("subject", F.when((F.col("type") == "fix") & (F.length("subject") > 3) & (F.size(keys) > 0), F.concat(F.lit("handle "), "subject")).otherwise(F.col("subject")))
    out = out.withColumn("subject", F.when(F.length("subject") > 45, F.concat(F.substring("subject", 1, 42), F.lit("…"))).otherwise(F.col("subject")))
    tail = F.when(F.col("scope").isNotNull(), F.concat(F.lit("("), "scope", F.lit(")"))).otherwise("")
    full = F.concat("type", F.when(F.col("_breaking"), "!").otherwise(""), tail, F.lit(": "), "subject")
    room = 50 - (F.length("type") + F.length(F.coalesce("scope", F.lit(""))) + 4)
    long_ = (F.length(full) > 50) & (F.length("subject") > 10)
    cut = F.when(long_ & (room > 5) & (F.length("subject") > room), F.concat(F.substring(F.col("subject"), F.lit(1), room - 1), F.lit("…"))).otherwise(F.col("subject"))
    return out.select(id_col, "type", "scope", cut.alias("subject"), F.when(long_, F.concat("type", tail, F.lit(": "), cut)).otherwise(full).alias("message"))


def _around(low: Column, content: Column, word: str) -> Column:
    at = F.instr(low, word)
    ctx = F.trim(F.substring(content, F.greatest(F.lit(1), at - 15), F.lit(len(word)) + 15 + F.least(F.lit(15), at - 1)))
    return F.when(F.length(ctx) > 30, F.concat(F.substring(ctx, 1, 27), F.lit("…"))).otherwise(ctx)


def review(diffs: DataFrame, id_col: str, diff: str = "diff") -> DataFrame:
    """Rows (id, file, line, severity, message): at most one remark for each added line."""
    rows = diff_lines(diffs, id_col, diff).where((F.col("kind") == "add") & F.col("line").isNotNull() & (F.col("content") != ""))
    c = F.col("content")
    low = F.lower(c)
    out = F.lit(None).cast("struct<severity:string,message:string>")
    remark = lambda s, m: F.struct(F.lit(s).alias("severity"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))
    out = F.when(low.rlike(r"try\s*\{") & ~F.contains(low, F.lit("catch")), remark("warning", "bare try without catch")).otherwise(out)
    out = F.when(c.rlike(r"^\s*var\s+\w+\s*=\s*null;?$"), remark("warning", "var init null. Use default or nullable?")).otherwise(out)
    for word in reversed(SLOW):
        out = F.when(F.contains(low, F.lit(word)), remark("perf", F.concat(F.lit("perf: "), _around(low, c, word), F.lit(" may impact performance")))).otherwise(out)
    for word in reversed(BUGS):
        hit = F.contains(low, F.lit(word))
        if word in ("null", "nullptr"):
            hit = hit & c.rlike(CHECKED)
        out = F.when(hit, remark("info" if word == "todo" else "bug", F.concat(F.lit(f"{word}: "), _around(low, c, word)))).otherwise(out)
    for word in reversed(SECURITY):
        out = F.when(F.contains(low, F.lit(word)), remark("critical", F.concat(F.lit("security: possible "), _around(low, c, word), F.lit(" leak")))).otherwise(out)
    out = F.when(F.length(c) > 200, remark("warning", F.concat(F.lit("long line "), F.length(c), F.lit("ch. Consider split.")))).otherwise(out)
    return rows.withColumn("r", out).where("r is not null").select(id_col, "file", "line", "r.severity", "r.message")


def symbols(text: str = "text") -> Column:
    """An array of (name, kind, line) of what a source text defines."""
    rows = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, k: F.struct(F.trim(x).alias("x"), (k + 1).alias("line")))
    live = F.filter(rows, lambda r: (r["x"] != "") & ~r["x"].rlike("^(//|#)"))

    def one(r: Column) -> Column:
        x = r["x"]
        sym = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"), r["line"].alias("line"))
        method = F.regexp_extract(x, METHOD, 1)
        return (
            F.when(x.rlike(CLASS), sym(F.regexp_extract(x, CLASS, 2), F.regexp_extract(x, CLASS, 1)))
            .when((method != "") & ~method.isin("if", "while", "for", "foreach", "using") & ~F.contains(x, F.lit("class ")), sym(method, F.lit("method")))
            .when(x.rlike(DEF), sym(F.regexp_extract(x, DEF, 2), F.regexp_extract(x, DEF, 1)))
        )

    return F.filter(F.transform(live, one), lambda s: s.isNotNull())


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of each document: one line goes, a line with its number's word comes for each of the text."""
    lines = F.split("text", "\n")
    words = F.array(*map(F.lit, ["fix null check != null", "add password field", "sort the rows", "plain change", "todo later"]))
    body = F.transform(lines, lambda x, k: F.concat(F.lit("+"), F.element_at(words, (F.pmod(F.col("doc_id") + k, F.lit(5)) + 1).cast("int"))))
    head = F.concat(F.lit("--- a/src/f"), F.col("doc_id"), F.lit(".py\n+++ b/src/f"), F.col("doc_id"), F.lit(".py\n@@ -1,2 +1,2 @@\n-old line\n"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.array_join(body, "\n")).alias("diff"))


def commit_message_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_messages(_diffs(spark, sf_dir), "doc_id")


def review_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review(_diffs(spark, sf_dir), "doc_id")


def symbols_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("class A"), F.col("event_id"), F.lit(":\n    # note\n    def run(self):\n        pass\npublic static int Go(x) {"))
    e = tables.read(spark, sf_dir, "events").select("event_id", code.alias("text"))
    return e.select("event_id", F.explode(symbols()).alias("s")).select("event_id", "s.name", "s.kind", "s.line")


_LINES = """l AS (SELECT doc_id, unnest(generate_series(0, len(str_split(text, chr(10))) - 1)) AS k FROM documents), w AS (SELECT doc_id, k, ['fix null check != null', 'add password field', 'sort the rows', 'plain change', 'todo later'][(doc_id + k) % 5 + 1] AS c FROM l)"""
QUERIES = {"commit_message": commit_message_query, "review_diff": review_diff_query, "code_symbols": symbols_query}
ORACLES = {
    "review_diff": f"""WITH {_LINES} SELECT doc_id, 'src/f' || doc_id || '.py' AS file, (k + 2)::INTEGER AS line, CASE WHEN contains(c, 'password') THEN 'critical' WHEN contains(c, 'null') THEN 'bug' WHEN contains(c, 'todo') THEN 'info' ELSE 'perf' END AS severity,
      CASE WHEN contains(c, 'password') THEN 'security: possible add password field leak' WHEN contains(c, 'null') THEN 'null: fix null check != null' WHEN contains(c, 'todo') THEN 'todo: todo later' ELSE 'perf: sort the rows may impact performance' END AS message FROM w WHERE c <> 'plain change'""",
    "code_symbols": "SELECT event_id, 'A' || event_id AS name, 'class' AS kind, 1::INTEGER AS line FROM events UNION ALL SELECT event_id, 'run', 'def', 3 FROM events UNION ALL SELECT event_id, 'Go', 'method', 5 FROM events",
}

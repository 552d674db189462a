import json

import pytest

from winnower.operators import content, devtools, structured as S


def test_array_forms():
    rows = [{"id": i, "name": f"n|{i}", "value": None} for i in range(12)]
    out, how, *_ = S.crush_json(json.dumps(rows))
    assert how == "MarkdownTable" and "n\\|3" in out and "None" in out
    wide = [{f"key_{k}": i for k in range(9)} for i in range(30)]
    assert S.crush_json(json.dumps(wide))[1] == "Csv"


def test_rows_are_dropped_by_rank():
    rows = [{"a": "x" * 3, "b": f"plain {i}"} for i in range(20)]
    rows[13]["b"] = "needle here"
    text = json.dumps(rows, separators=(",", ":"))
    out, how, digest, n, kept, dropped = S.crush_json(text, "needle", 3)
    if how != "LossyRowDrop":  # small enough as a table
        assert S.rank_rows(rows, "needle", 3)[0] == 13
    assert S.rank_rows(rows, "", 3) == [0, 1, 2]


def test_lossy_drop_is_whole():
    rows = [{"k": "v"} for _ in range(5)] + [{"k": {"deep": [1, 2, {"x": "y" * 5}]}}]
    got = S.crush_json('[{"k":1},{"k":2},{"k":3},{"k":4}]', "", 2)
    assert got[1] in ("Csv", "MarkdownTable", "LossyRowDrop")
    assert S.crush_json(json.dumps(rows))[3] == 6


def test_chains_and_schemas():
    assert S.crush_json('{"a": {"b": {"c": "x"}}}')[0] == "a.b.c: x"
    schema = '{"type": "object", "properties": {"a": {"type": "string"}}}'
    assert S.crush_json(schema)[0] == schema
    nested = '{"tool": ' + schema + "}"
    assert S.crush_json(nested)[0] == nested


@pytest.mark.parametrize("text", ["", None, "not json", "[]", "[1, 2]", "{}", "null", "3"])
def test_json_that_stays(text):
    assert S.crush_json(text)[0] == text


def test_tool_signatures():
    tools = [{"name": "find", "description": "Finds", "parameters": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q"]}}] * 2
    assert S.crush_json(json.dumps(tools))[0].splitlines()[0] == "find(q:string, n?:integer) — Finds"


def test_diff():
    body = "".join(f" c{i}\n" for i in range(6))
    text = f"--- a\n+++ b\n@@ -1 +1 @@\n{body}-old\n+new\n{body}@@ -9 +9 @@\n same\n"
    assert S.trim_diff(text) == "--- a\n+++ b\n@@ -1 +1 @@\n c4\n c5\n-old\n+new\n c0\n c1\n"
    assert S.trim_diff("plain text") == "plain text"
    assert S.trim_diff("") == "" and S.trim_diff(None) is None


def test_log_fold():
    lines = "E user=1 login failed from host alpha today again now\n" * 3 + "completely different words stand here"
    assert S.fold_log(lines).splitlines()[0].endswith("[×3]")
    assert S.fold_log("") == ""


def test_skeletons():
    code = "class A:\n    def f(self):\n        a = 1\n        return a\n    def g(self):\n        pass"
    assert S.skeleton(code, "python") == ("class A:\n    def f(self):\n        ...\n    def g(self):\n        pass", 1)
    c = 'int main(int a) {\n  char* s = "}{";\n  return a + 1 + 2 + 3 + 4 + 5 + 6;\n}\n'
    out, n = S.skeleton(c, "cpp")
    assert n == 1 and out.count("{") == out.count("}") and "return" not in out
    assert S.skeleton("if (x) {\n" + "  y();\n" * 20 + "}", "cpp")[1] == 0
    assert S.skeleton("", "python") == ("", 0)


def test_html():
    assert S.html_text("<html><head><title>t</title></head><body><h1>Head</h1><script>x()</script><p>One &amp; two<p>Three</body>") == "# Head\n\nOne & two\nThree"
    assert S.html_text("<p>open <b>tags") == "open <b>tags".replace("<b>", "")
    assert S.html_text("  ") == "" and S.html_text(None) == ""


def test_table():
    t = "| a | b |\n|---|---|\n| 1 |  |\n| 2 |  |"
    assert S.prune_table(t) == "| a |\n| --- |\n| 1 |\n| 2 |"
    assert S.prune_table("| a |\n|---|") == "| a |\n|---|"


def kinds(spark, rows):
    return [r.t for r in spark.createDataFrame([(x,) for x in rows], "text string").select(content.content_type().alias("t")).collect()]


def test_types(spark):
    rows = ["[1]", '{"a": 1}', "--- a\n+++ b\n", "INFO a\nERROR b", "<div>x</div>", "1. one", "| a | b | c |\n| d | e | f |", "def f(): {}; import x", "plain words", "", None, "[broken"]
    assert kinds(spark, rows) == ["JsonArray", "JsonObject", "GitDiff", "LogOrStackTrace", "Html", "SearchResults", "Tabular", "SourceCode", "PlainText", "PlainText", "PlainText", "PlainText"]


def test_route_never_grows(spark):
    rows = ["[]", "short", None, json.dumps([{"a": i, "b": "x"} for i in range(30)]), "<html><body><p>Hello there, this is the text.</p></body></html>"]
    out = S.route(spark.createDataFrame([(x,) for x in rows], "text string")).collect()
    assert all(r.tokens_after <= r.tokens_before for r in out)
    assert any("no-gain" in r.strategy for r in out)


def test_noise_and_success(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m\n  ⠙ \n50%\rdone\n[===>  ] 40%\n---", "npm ci", 0), ("added 3 packages in 2s\nfound 0 vulnerabilities", "npm install x", 0), ("added 3 packages", "npm ci", 1), ("added 3 packages", "ls", 0)], "text string, command string, exit_code int")
    r = df.select(content.strip_noise().alias("n"), content.collapse_success().alias("s")).collect()
    assert r[0].n == "red\ndone\n---"
    assert r[1].s == "added 3 packages in 2s\nfound 0 vulnerabilities"
    assert r[2].s is None and r[3].s is None


def test_diffs_hold_every_line(spark, data):
    docs = {r.doc_id: r.text for r in devtools.tables.read(spark, data, "documents").select("doc_id", "text").where("text is not null").collect()}
    got = {r.doc_id: r["diff"].split("\n")[4:] for r in devtools._diffs(spark, data).where("diff is not null").collect()}
    assert {i: len(x) for i, x in got.items()} == {i: len(t.split("\n")) for i, t in docs.items()}
    assert max(map(len, got.values())) > 5


def test_review_reads_long_diffs_to_the_end(spark):
    diff = "+++ b/a.py\n@@ -0,0 +1,40 @@\n" + "\n".join("+add password field" if k % 2 else "+plain" for k in range(40))
    out = devtools.review(spark.createDataFrame([(1, diff)], "doc_id long, diff string"), "doc_id").collect()
    assert sorted(r.line for r in out) == list(range(2, 41, 2))

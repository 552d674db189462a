"""The url filter against a plain reading of its method, its rules against SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from winnower.llm import registry, urlfilter as u

RULES_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(verdict, name, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, name || start AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) AS k
  FROM q JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
)
SELECT q.page_id, host, path, rule, verdict FROM q LEFT JOIN fits ON fits.page_id = q.page_id AND k = 1
"""


def brute(rows):
    """purity and template of each (host, shapes, verdict), step by step in plain Python."""
    leaves = defaultdict(lambda: [0, 0, 0])
    for host, shapes, verdict in rows:
        x = leaves[host, tuple(shapes)]
        x[0] += 1
        x[1] += verdict is not None
        x[2] += verdict == "block"
    made = {k: k[1] for k in leaves}

    def below(level):
        out = defaultdict(lambda: defaultdict(list))
        for (host, shape), t in made.items():
            if len(t) >= level:
                out[host, t[: level - 1]][t[level - 1]].append((host, shape))
        return out

    def rename(names, level):
        for (host, prefix, value), new in names.items():
            for k, t in list(made.items()):
                if k[0] == host and t[: level - 1] == prefix and len(t) >= level and t[level - 1] == value:
                    made[k] = (*t[: level - 1], new, *t[level:])

    depth = max((len(s) for _, s in leaves), default=0)
    for level in range(1, depth + 1):
        names = {}
        for (host, prefix), values in below(level).items():
            size = {v: sum(leaves[k][0] for k in ks) for v, ks in values.items()}
            if len(values) > u.MAX_VALUES:
                names |= {(host, prefix, v): "*" for v, n in size.items() if n < u.RARE_ROWS or n < u.RARE_SHARE * sum(size.values())}
        rename(names, level)
    for level in range(1, depth + 1):
        names = {}
        for (host, prefix), values in below(level).items():
            if len(values) < 2:
                continue
            children, kind = {}, {}
            for v, ks in values.items():
                children[v] = Counter()
                for k in ks:
                    t = made[k]
                    children[v][t[level] if len(t) > level else "$"] += leaves[k][0]
                labelled, blocked = (sum(leaves[k][i] for k in ks) for i in (1, 2))
                share = (blocked + u.PRIOR_ROWS * u.PRIOR_SHARE) / (labelled + u.PRIOR_ROWS)
                kind[v] = "unlabelled" if not labelled else "blocked" if share >= u.REJECT else "allowed" if share <= 1 - u.REJECT else "mixed"
            pool = {g: sum((children[v] for v in values if kind[v] == g), Counter()) for g in set(kind.values())}
            chosen = defaultdict(list)
            for v, own in children.items():
                total, best = sum(own.values()), []
                for g, p in pool.items():
                    if g == kind[v] or kind[v] == "unlabelled":
                        gap = sum(max(0.0, n / total - p[c] / sum(p.values())) for c, n in own.items())
                        if gap <= u.VARIATION + 0.5 * math.sqrt(len(own) / total):
                            best.append((g == "unlabelled", round(gap, 9), g))
                if best:
                    chosen[min(best)[2]].append(v)
            for g, vs in chosen.items():
                if len(vs) > 1:
                    names |= {(host, prefix, v): f"~{g}:{min(vs)}" for v in vs}
        rename(names, level)

    def towards(parent, x):
        w = u.PRIOR_ROWS + u.PRIOR_UNLABELLED * (x[0] - x[1])
        return (x[2] + w * parent) / (x[1] + w)

    def domain(host):
        m = re.search(r"([^.]+\.[^.]+)$", host)
        return host if re.fullmatch(r"[0-9.]*", host) or not m else m[1]

    sums = defaultdict(lambda: [0, 0, 0])
    for k, x in leaves.items():
        host, t = k[0], made[k]
        for node in (("domain", domain(host)), ("host", host), *((host, t[:i]) for i in range(1, len(t) + 1))):
            sums[node] = [a + b for a, b in zip(sums[node], x, strict=True)]
    out = {}
    for (host, shape), t in made.items():
        p = u.PRIOR_SHARE
        for node in (("domain", domain(host)), ("host", host), *((host, t[:i]) for i in range(1, len(t) + 1))):
            p = towards(p, sums[node])
        out[host, "/".join(shape)] = ("/".join(t), p if sums[host, t][1] else None)
    return out


def check(spark, pages, rules=None):
    got = u.judge(pages, rules)
    rows = got.withColumn("shapes", u.shapes("path")).collect()
    want = brute([(r.host, r.shapes, r.verdict if r.rule is not None else None) for r in rows])
    for r in rows:
        template, purity = want[r.host, "/".join(r.shapes)]
        assert r.template == template and (r.purity == purity if purity is None else r.purity == pytest.approx(purity, abs=2e-6))
        if r.rule is None:
            assert r.verdict == ("block" if purity is not None and purity >= u.REJECT else "allow")
    return rows


def test_query_equals_its_method_and_its_rules(spark, data, duck):
    rows = registry.QUERIES["op1_url_filter"](spark, data).toPandas().set_index("page_id").sort_index()
    want = duck.execute(RULES_SQL).df().set_index("page_id").sort_index()
    assert (rows.index == want.index).all() and (rows.host == want.host).all() and (rows.path == want.path).all()
    ruled = want.rule.notna()
    assert (rows.rule.notna() == ruled).all() and (rows.rule[ruled] == want.rule[ruled]).all() and (rows.verdict[ruled] == want.verdict[ruled]).all()
    check(spark, spark.read.parquet(f"{data}/pages.parquet"))


def test_the_method_decides_both_ways(spark):
    """Pages of a host with a blocked folder, and of one with an allowed folder, look alike below all folders."""
    urls = [f"http://{h}/{lang}/{i}" for h in ("a.example.com", "a.example.org") for lang in ("en", "de", "fr") for i in range(40)]
    got = check(spark, spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string"))
    assert {(r.host, r.verdict) for r in got if r.rule is None} == {("a.example.com", "block"), ("a.example.org", "allow")}
    # few labels don't decide a large template
    urls = [f"http://a.example.com/de/{i}" for i in range(20)] + [f"http://a.example.com/en/{i}" for i in range(900)]
    got = check(spark, spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string"))
    assert {r.verdict for r in got if r.rule is None} == {"allow"}


def test_trees_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["news", "item", "blog", "tag", *(f"name{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8))]
    urls = [f"http://{rng.choice(['a.net', 'b.a.org', 'c.com', '10.0.0.1'])}/" + "/".join(rng.choice([rng.choice(words), str(rng.randrange(99)), rng.choice(words[:4])]) for _ in range(rng.randrange(0, 5))) for _ in range(600)]
    rules = [("block", "a.net/news/"), ("allow", "c.com/blog/"), ("block", "a.org/item/tag/"), ("block", "c.com/tag/")]
    check(spark, spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string"), rules)


def test_any_depth_ties_and_odd_columns(spark):
    deep = "/".join(f"d{chr(97 + i)}" for i in range(20))
    urls = [f"http://h.com/{deep}/bad/{i}" for i in range(9)] + [f"http://h.com/{deep}/good/x{i}y/z" for i in range(9)] + ["http://h.com/" + "a/b/" * 300, "http://h.com/" + "seg" * 40_000, None, "http://h.com/t/"]
    rows = [(k, x, "x", "x", "x", "x") for k, x in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, _host string, `a.b` string, Verdict string, _shape string")
    got = check(spark, df, [("block", f"h.com/{deep}/bad/"), ("allow", "com/t/"), ("block", "com/t/")])
    assert len(got) == len(rows) and got[0]["a.b"] == "x" and got[0]["_host"] == "x"
    assert {r.verdict for r in got if r.url and f"{deep}/bad" in r.url} == {"block"} and len({r.template for r in got if r.url and deep in r.url}) == 2
    assert [r.rule for r in got if r.url == "http://h.com/t/"] == ["com/t/"] and [r.verdict for r in got if r.url == "http://h.com/t/"] == ["allow"]
    assert u.judge(df.where(F.lit(False))).count() == 0

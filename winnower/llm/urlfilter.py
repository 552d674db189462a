"""URL filters: a tree of path templates for each host, judged by labelled purity.

Rules of (host, path) judge the urls they fit. The others are judged by templates:

1. A path's segments become shapes (runs of digits are ``{n}``, long hex words
   ``{x}``, a part that repeats four times or more is written once, then ``{+}``).
   From here on only counts of (host, shape) are worked on.
2. Level by level, a position with many values of which most are rare is variable:
   its rare values become ``*``.
3. Level by level, branches below one parent are merged if what follows them is
   shared out as in all such branches together and their labels don't speak against
   it: a branch without labels joins the closest group, labelled ones only their like.
4. A template is rejected if the share of blocked rows among its labelled rows is
   high; without labelled rows it is left alone. The share is smoothed towards that of its parent, and so on up the path to
   the host and its registered domain; unlabelled rows weigh a little on the
   parent's side, so that few labels don't decide a large template. Labels are the
   rules' verdicts.

Branches are compared with the sum of their siblings, never in pairs; all steps are
aggregations with partial sums, so that a host with most of the rows is as cheap as
any. Paths may have any depth: a level is worked on while prefixes of it are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common

#: (verdict, rule); the part up to the first slash is the host.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A position with more values than this is variable; values under this share are rare.
MAX_VALUES, RARE_SHARE, RARE_ROWS = 16, 0.01, 4
#: Branches merge if the total variation from a group's sum is at most this, plus sampling noise.
VARIATION = 0.1
#: A parent's share counts as so many labelled rows, and as so many for each unlabelled row.
PRIOR_ROWS, PRIOR_UNLABELLED = 4.0, 0.25
#: The share above the domains; the share from which a branch or a template is blocked.
PRIOR_SHARE, REJECT = 0.5, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(F.col(common.quoted(url)).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal ones the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(f"/{rest}"))
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shapes(path: str = "path") -> Column:
    """The shapes of a path's segments; an empty path has one, empty."""
    parts = F.split(F.regexp_replace(F.col(path), r"\A/", ""), "/", -1)
    shaped = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{16,}(?![0-9A-Za-z])", "{x}"), "[0-9]+", "{n}"))
    once = F.regexp_replace(F.concat(F.array_join(shaped, "/"), F.lit("/")), r"(?<![^/])((?:[^/]+/){1,3}?)\1{3,}", "$1{+}/")
    return F.split(F.substring(once, F.lit(1), F.length(once) - 1), "/", -1)


def registered_domain(host: str = "host") -> Column:
    """The last two labels of a host's name; an address of digits and dots as it is."""
    last = F.regexp_extract(F.col(host), r"([^.]+\.[^.]+)\z", 1)
    return F.when(F.col(host).rlike(r"\A[0-9.]*\z") | (last == ""), F.col(host)).otherwise(last)


def _prefix(level: int) -> Column:
    return F.slice("template", 1, level - 1)


def _values(leaves: DataFrame, level: int) -> tuple[DataFrame, DataFrame, int]:
    """The values below each shared prefix of a level, those prefixes, and their number.

    A prefix with one template has nothing to generalise or merge, here or deeper.
    """
    here = leaves.where(F.size("template") >= level).withColumn("text", F.array_join("template", "/"))
    at = here.groupBy("host", _prefix(level).alias("prefix"), F.element_at("template", level).alias("value")).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("leaves"), F.min("text").alias("lo"), F.max("text").alias("hi")
    )
    at = common.materialise(at, "values")
    shared = at.groupBy("host", "prefix").agg(
        F.count(F.lit(1)).alias("values"), F.sum("rows").alias("all"), F.sum("leaves").alias("leaves"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).where("lo <> hi")
    shared, seen = common.counted(shared.select("host", "prefix", "values", "all", "leaves"), "prefixes")
    return at, shared, seen.n


def _generalise(leaves: DataFrame, level: int) -> DataFrame | None:
    """Rare values of a variable position become ``*``; None if no prefix has so many values."""
    at, shared, n = _values(leaves, level)
    if not n or shared.where(F.col("leaves") > MAX_VALUES).isEmpty():
        return None
    wide = shared.where(F.col("values") > MAX_VALUES).select("host", "prefix", "all")
    rare = at.join(wide, ["host", "prefix"]).where((F.col("rows") < RARE_ROWS) | (F.col("rows") < RARE_SHARE * F.col("all")))
    return _rename(leaves, rare.select("host", "prefix", "value", F.lit("*").alias("new")), level)


def _rename(leaves: DataFrame, names: DataFrame, level: int) -> DataFrame:
    names, seen = common.counted(names, "renamed")
    if not seen.n:
        return leaves
    keyed = leaves.withColumn("prefix", _prefix(level)).withColumn("value", F.when(F.size("template") >= level, F.get("template", F.lit(level - 1))))
    new = F.expr(f"concat(slice(template, 1, {level - 1}), array(new), slice(template, {level + 1}, size(template)))")
    out = keyed.join(names, ["host", "prefix", "value"], "left").withColumn("template", F.when(F.col("new").isNotNull(), new).otherwise(F.col("template")))
    return common.materialise(out.select(leaves.columns), "leaves")


def _merge(leaves: DataFrame, level: int) -> DataFrame | None:
    """Branches that agree with a group of siblings get one name; None if no prefix has siblings."""
    _, shared, n = _values(leaves, level)
    if not n:
        return None
    key, sums = ["host", "prefix", "value"], ("rows", "labelled", "blocked")
    deep = leaves.where(F.size("template") >= level).select("host", _prefix(level).alias("prefix"), F.element_at("template", level).alias("value"), F.coalesce(F.get("template", F.lit(level)), F.lit("$")).alias("child"), *sums)
    deep = deep.join(shared.where("values > 1").select("host", "prefix"), ["host", "prefix"], "left_semi")
    children = common.materialise(deep.groupBy(*key, "child").agg(*(F.sum(c).alias(c) for c in sums)), "children")
    branches = children.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"), *(F.sum(c).alias(c) for c in sums))
    share = (F.col("blocked") + PRIOR_ROWS * PRIOR_SHARE) / (F.col("labelled") + PRIOR_ROWS)
    own = F.when(F.col("labelled") == 0, "unlabelled").when(share >= REJECT, "blocked").when(share <= 1 - REJECT, "allowed").otherwise("mixed")
    branches = common.materialise(branches.select(*key, "kinds", own.alias("own"), F.col("rows").alias("total")), "branches")
    sized = children.select(*key, "child", "rows").join(branches, key)
    pool = sized.groupBy("host", "prefix", F.col("own").alias("group"), "child").agg(F.sum("rows").alias("pooled"))
    pools = branches.groupBy("host", "prefix", F.col("own").alias("group")).agg(F.sum("total").alias("pool_total"))
    # a labelled branch tries its own group, an unlabelled one each of the four at most
    tries = sized.join(pools, ["host", "prefix"]).where("own = group or own = 'unlabelled'")
    tries = tries.join(pool, ["host", "prefix", "group", "child"], "left")
    gap = F.greatest(F.lit(0.0), F.col("rows") / F.col("total") - F.coalesce("pooled", F.lit(0)) / F.col("pool_total"))
    apart = tries.groupBy(*key, "own", "group", "kinds", "total").agg(F.sum(gap).alias("variation"))
    close = apart.where(F.col("variation") <= VARIATION + 0.5 * F.sqrt(F.col("kinds") / F.col("total")))
    # labelled groups first, of those the closest
    order = F.struct((F.col("group") == "unlabelled").alias("last"), F.round("variation", 9).alias("variation"), "group")
    close = common.materialise(close.groupBy(*key).agg(F.min(order)["group"].alias("group")), "close")
    first = close.groupBy("host", "prefix", "group").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    names = close.join(first, ["host", "prefix", "group"]).select(*key, F.concat(F.lit("~"), F.col("group"), F.lit(":"), F.col("first")).alias("new"))
    return _rename(leaves, names, level)


def _towards(parent: Column, rows: Column, labelled: Column, blocked: Column) -> Column:
    """The share of blocked among labelled rows, smoothed towards a parent's."""
    weight = F.lit(PRIOR_ROWS) + F.lit(PRIOR_UNLABELLED) * (rows - labelled)
    return (blocked + weight * parent) / (labelled + weight)


def _purities(leaves: DataFrame) -> DataFrame:
    """Rows (host, template, purity or null): from the domain to the host and down the path."""
    sums = [F.sum(c).alias(c) for c in ("rows", "labelled", "blocked")]
    count = [F.col(c) for c in ("rows", "labelled", "blocked")]
    hosts = common.materialise(leaves.groupBy("host").agg(*sums).withColumn("domain", registered_domain()), "hosts")
    domains = hosts.groupBy("domain").agg(*sums).select("domain", _towards(F.lit(PRIOR_SHARE), *count).alias("parent"))
    hosts = hosts.join(domains, "domain").select("host", _towards(F.col("parent"), *count).alias("host_purity"))
    hosts = common.materialise(hosts, "host-purities")
    steps = leaves.groupBy("host", "template").agg(*sums).select("host", "template", *count, F.explode(F.sequence(F.lit(1), F.size("template"))).alias("level"))
    # a prefix goes by its digest: a deep path has many
    node = F.md5(F.to_json(F.struct("host", F.expr("slice(template, 1, level)").alias("t"))))
    steps = common.materialise(steps.withColumn("node", node), "steps")
    nodes = common.materialise(steps.groupBy("node").agg(*sums), "nodes")
    path = steps.select("host", "template", "level", "node").join(nodes, "node").groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", *count))).alias("path"))
    down = F.aggregate("path", F.col("host_purity"), lambda p, x: _towards(p, x["rows"], x["labelled"], x["blocked"]))
    return path.join(hosts, "host").select("host", "template", F.when(F.element_at("path", -1)["labelled"] > 0, down).alias("purity"))


def templates(labelled: DataFrame) -> DataFrame:
    """Rows (host, shape, template, purity) of rows (host, shapes, verdict or null).

    ``purity`` is the smoothed share of blocked rows among the template's labelled
    rows; null if it has none.
    """
    leaves = labelled.groupBy("host", F.col("shapes").alias("template")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked")
    )
    leaves = common.materialise(leaves.select("host", F.array_join("template", "/").alias("shape"), "template", "rows", "labelled", "blocked"), "leaves")
    for step in (_generalise, _merge):
        level, new = 1, step(leaves, 1)
        while new is not None:
            level, leaves = level + 1, new
            new = step(leaves, level)
    out = leaves.select("host", "shape", "template").join(_purities(leaves), ["host", "template"])
    return common.materialise(out.select("host", "shape", F.array_join("template", "/").alias("template"), "purity"), "templates")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity.

    Every row comes back, repeated ones too. A null url, or one without ``://``, has
    an empty host and path, and is judged as such; urls of any length and depth are
    judged whole. ``verdict`` is the longest fitting rule's (of equally long ones the
    first in order); without one it is block if the template's purity is REJECT or
    more, else allow. An empty table gives an empty result. Same-named columns are
    replaced, others pass through, whatever their names.
    """
    rules = RULES if rules is None else rules
    new = ["host", "path", "rule", "verdict", "template", "purity"]
    at, way, said, why, parts, name, made, pure = common.free(pages, "at", "way", "said", "why", "parts", "name", "made", "pure")
    host, path = host_and_path(url)
    base = pages.select("*", host.alias(at), path.alias(way))
    rule, verdict = fitting_rule(rules, at, way)
    base = base.select(*common.columns(pages, new), at, way, rule.alias(why), verdict.alias(said), shapes(way).alias(parts))
    tree = templates(base.select(F.col(at).alias("host"), F.col(parts).alias("shapes"), F.col(said).alias("verdict")))
    tree = tree.select(F.col("host").alias(at), F.col("shape").alias(name), F.col("template").alias(made), F.col("purity").alias(pure))
    both = base.withColumn(name, F.array_join(parts, "/")).join(tree, [at, name], "left")
    by_purity = F.when(F.col(pure) >= REJECT, "block").otherwise("allow")
    return both.select(*common.columns(pages, new), F.col(at).alias("host"), F.col(way).alias("path"), F.col(why).alias("rule"), F.coalesce(said, by_purity).alias("verdict"), F.col(made).alias("template"), F.col(pure).alias("purity"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    out = judge(common.table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))

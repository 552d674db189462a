"""Files of a project: a catalogue, its symbols, an overview in markdown."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.operators.devtools import symbols

# What is ignored, what is text, what kinds of other files there are.
IGNORED_FOLDERS = ".git .svn .hg node_modules bin obj dist build .vs .idea __pycache__ packages .nuget".split()
IGNORED_ENDS = [".pdb", ".min.js", ".map", ".lock"]
TEXT = ".cs .csproj .sln .vb .fs .py .txt .json .xml .config .yml .yaml .js .ts .jsx .tsx .html .css .scss .md .sh .bat .ps1 .sql .proto .graphql .ini .toml .csv .rs .go .java .kt .rb .php .c .h .cpp .hpp .swift .r .jl .lua .dart".split()
CODE = ".cs .vb .fs .py .js .ts .jsx .tsx .rs .go .java .kt .rb .php .c .h .cpp .hpp .swift .r .jl .lua .dart".split()
KINDS = {
    "image": ".jpg .jpeg .png .gif .bmp .webp .tiff .tif .ico .heic .raw .psd .ai .svg", "document": ".pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .rtf", "archive": ".zip .rar .7z .tar .gz .bz2 .xz .iso",
    "audio": ".mp3 .wav .flac .aac .ogg .m4a .wma", "video": ".mp4 .mov .avi .mkv .webm .wmv .flv", "font": ".ttf .otf .woff .woff2", "binary": ".dll .exe .so .dylib .bin .dat .db .sqlite",
}
DEPTHS = {1: (10, 3), 2: (25, 5), 3: (60, 10), 4: (120, 25)}
MAX_SIZE = 512 * 1024


def files(spark: SparkSession, root: str, max_size: int = MAX_SIZE) -> DataFrame:
    """Rows (path, size, extension, category, is_binary, line_count, text) by relative path.

    Ignored folders and endings are left out. Texts over ``max_size`` and other
    files are catalogued without their content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace(F.col("path"), "^file:/*", "/")
    base = root.replace("file://", "").rstrip("/")
    rel = F.regexp_replace(F.substring(full, len(base) + 2, 1 << 30), "^/+", "")
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), "content")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_FOLDERS))))
    for end in IGNORED_ENDS:
        rows = rows.where(~F.lower("path").endswith(end))
    dot = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    category = F.lit("other")
    for kind, ends in KINDS.items():
        category = F.when(dot.isin(ends.split()), kind).otherwise(category)
    category = F.when(dot.isin(TEXT) | (dot == ""), "text").otherwise(category)
    rows = rows.withColumn("extension", dot).withColumn("category", category).withColumn("is_binary", F.col("category") != "text")
    text = F.when((F.col("category") == "text") & (F.col("size") <= max_size), F.try_validate_utf8(F.col("content").cast("string")))
    rows = rows.withColumn("text", F.coalesce(text, F.when((F.col("category") == "text") & (F.col("size") <= max_size), F.make_valid_utf8(F.col("content").cast("string"))))).drop("content")
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n")))
    return rows.withColumn("line_count", lines)


def read_paths(spark: SparkSession, paths: list[str], text_limit: int = 1 << 31) -> DataFrame:
    """Rows (path, text, size_chars, error) for a list of files; a missing one has an error."""
    out = spark.createDataFrame([(p,) for p in paths], "path string")
    found = None
    for p in paths:  # a list that a caller names, not a scan
        try:
            one = spark.read.text(p, wholetext=True).select(F.lit(p).alias("path"), F.col("value").alias("text")).limit(1)
        except Exception:  # not there
            continue
        found = one if found is None else found.unionAll(one)
    found = found if found is not None else spark.createDataFrame([], "path string, text string")
    both = out.join(found, "path", "left")
    return both.select("path", "text", F.length("text").alias("size_chars"), F.when(F.col("text").isNull(), "file not found").alias("error"))


def dependencies(catalogue: DataFrame) -> DataFrame:
    """Rows (source, name, version) of the manifests that a project has at its root."""
    roots = catalogue.where(F.col("path").isin("package.json", "requirements.txt", "pyproject.toml")).select("path", "text").limit(3).collect()
    out = []
    for r in roots:
        if r.path == "package.json":
            try:
                parsed = json.loads(r.text or "{}")
            except ValueError:
                continue
            out += [(r.path, k, str(v)) for part in ("dependencies", "devDependencies") for k, v in (parsed.get(part) or {}).items()]
        elif r.path == "requirements.txt":
            out += [(r.path, m[1], m[2] or None) for m in re.finditer(r"^([A-Za-z0-9_.\-]+)\s*(?:[=<>~!]=?\s*([^\s;#]+))?", r.text or "", re.M)]
        else:
            out += [(r.path, m[1], m[2] or None) for m in re.finditer(r'^\s*"([A-Za-z0-9_.\-]+)\s*(?:[=<>~!]=?\s*([^"\s;]+))?[^"]*",?\s*$', r.text or "", re.M)]
    return catalogue.sparkSession.createDataFrame(out, "source string, name string, version string")


def key_components(catalogue: DataFrame, depth: int = 2) -> DataFrame:
    """The files of most symbols, with some of them."""
    top, each = DEPTHS[depth]
    code = catalogue.where(F.col("extension").isin(CODE)).withColumn("symbols", symbols("text")).where(F.size("symbols") > 0)
    first = F.array_join(F.transform(F.slice("symbols", 1, each), lambda s: s["name"]), ", ")
    ranked = code.select("path", F.size("symbols").alias("n"), "line_count", first.alias("names"))
    return ranked.orderBy(F.desc("n"), "path").limit(top)


def tree(catalogue: DataFrame) -> DataFrame:
    """Rows (folder, files, size) of the folders that hold files."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return catalogue.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def wiki(spark: SparkSession, root: str, depth: int = 2) -> str:
    """An overview of a project in markdown: totals, tree, key components, dependencies."""
    cat = files(spark, root).cache()
    kinds = cat.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("category").collect()
    parts = [f"# {root.rstrip('/').rsplit('/', 1)[-1]}", "", "## Overview", "", *(f"- {r.category}: {r.n} files, {r['size']} bytes" for r in kinds), "", "## Tree", ""]
    parts += [f"- {r.folder or '.'}/ ({r.files} files)" for r in tree(cat).orderBy("folder").limit(200).collect()]
    parts += ["", "## Key components", "", *(f"- `{r.path}` ({r.line_count} lines): {r.names}" for r in key_components(cat, depth).collect())]
    if depth > 1:
        parts += ["", "## Dependencies", "", *(f"- {r.name} {r.version or ''}".rstrip() for r in dependencies(cat).orderBy("source", "name").collect())]
    cat.unpersist()
    return "\n".join(parts) + "\n"

"""The dispatch of tools by name: each is a function from tables to a table.

``call(name, df, **arguments)`` runs one; ``register(spark)`` makes the row-wise ones
SQL functions, so that a query can say ``SELECT wn_pieces(text) FROM documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.functions.checksums import VALIDATORS
from winnower.operators import agents, compress, content, devtools, guards, langid, ledger, privacy, retrieval, sessions, structured, summarize
from winnower.sources import stores

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "compress": lambda df, level="semantic", **kw: compress.compress(df, level, **kw),
    "compress_batch": lambda df, level="semantic", **kw: compress.compress(df, level, **kw),
    "detect_language": langid.detect,
    "route_content": structured.route,
    "summarize": lambda df, text="text", method="tfidf", count=None, ratio=None: df.withColumn("summary", summarize.summary_of(text, F.lit("eng"), method, count, ratio)),
    "compress_for_context": agents.fit_budget,
    "compress_conversation": agents.compress_conversations,
    "deduplicate": retrieval.greedy_dedup,
    "session_record": ledger.redacted,
    "session_recall": retrieval.recall,
    "status": ledger.totals,
    "safety_check": lambda df, text="text": df.withColumn("safety", guards.safety(text)),
    "check_sensitive_content": lambda df, text="text": df.withColumn("secret", guards.secret_class(text)),
    "analyze_waste": lambda df, text="text": df.select("*", *guards.waste(text)),
    "check_cache_alignment": lambda df, text="text": df.withColumn("volatile", guards.volatile(text)),
    "align_cache_prompt": lambda df, text="text": df.withColumn("aligned", guards.align(text)),
    "shape_output": lambda df, text="text", level=2: df.withColumn("shaped", guards.shape(text, level)),
    "focus_relevant": retrieval.focus,
    "estimate_cost": lambda df, tokens="tokens", model="gpt-4": df.withColumn("usd", T.cost_usd(F.col(tokens), model)),
    "generate_commit_message": devtools.commit_messages,
    "review_diff": devtools.review,
    "check_tool_loop": sessions.loop_guard,
    "list_relevant_tools": retrieval.prune_tools,
    "mask_old_tool_output": lambda df, *a, **kw: sessions.mask_outputs(df, *a, **kw)[0],
    "get_artifact_index": sessions.artifact_index,
    "rewrite_command": lambda df, command="command": df.withColumn("rewritten", guards.rewrite_command(command)),
    "diff_tool_output": sessions.repeat_diff,
    "check_read_maturity": sessions.read_lifecycle,
    "analyze_privacy": lambda df, text="text": df.withColumn("privacy", privacy.analysis(text)),
    "restore_privacy_text": lambda df, text="masked_text", vault="vault": df.withColumn("restored", privacy.restore(df, text, vault)),
    "check_prompt_injection": lambda df, text="text": df.withColumn("injection", guards.injection(text)),
    "get_ai_transparency_notice": lambda df, lang="lang": df.withColumn("notice", guards.notice(lang)),
    "retrieve_compressed_text": lambda df, tokens: df.join(tokens.select("token"), "token", "left_semi"),
    "memory_add": stores.new_notes,
    "memory_recall": retrieval.recall,
    "strip_noise": lambda df, text="text": df.withColumn("clean", content.strip_noise(text)),
}


def call(name: str, df: DataFrame, *args, **kwargs) -> DataFrame:
    """Run a tool; an unknown name is an error that lists the known ones."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name}; known: {', '.join(sorted(TOOLS))}")
    return TOOLS[name](df, *args, **kwargs)


def register(spark: SparkSession) -> list[str]:
    """Register row-wise functions for SQL; returns their names."""

    @F.pandas_udf("boolean")
    def valid(values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or n not in VALIDATORS else VALIDATORS[n](v) for v, n in zip(values, names, strict=True)])

    @F.pandas_udf("string")
    def page_text(pages: pd.Series) -> pd.Series:
        return pages.map(structured.html_text)

    @F.pandas_udf("string")
    def summary(texts: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series([summarize.tfidf_summary(t, "eng", int(n)) for t, n in zip(texts, sentences, strict=True)])

    found = {"wn_valid": valid, "wn_html_text": page_text, "wn_summary": summary}
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)

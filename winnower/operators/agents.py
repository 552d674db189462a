"""Compositions for agents: budgets, conversations, context windows, shared context, gates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.operators import guards, privacy, retrieval, sessions
from winnower.operators.compress import compress
from winnower.operators.structured import route
from winnower.operators.summarize import rank_summary
from winnower.sources import tables
from winnower.sources.scratch import cut

HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+"
LONGEST_WORD = 8
WINDOW_RATIO, WINDOW_KEEP = 0.3, 4
SHARED_TTL, SHARED_MOST = 1800, 500
LONG_MESSAGE = 15


def segment_han(run: str, vocabulary: frozenset[str], longest: int = LONGEST_WORD) -> list[str]:
    """Words of a run of Han characters: the path of the largest sum of squared lengths.

    What is in no word is a character by itself. Of equal paths the shorter next word.
    """
    n = len(run)
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        ends = [j for j in range(i + 1, min(n, i + longest) + 1) if run[i:j] in vocabulary] or [i + 1]
        best[i] = max(((j - i) ** 2 + best[j][0], -j) for j in ends)
    out, i = [], 0
    while i < n:
        j = -best[i][1]
        out.append(run[i:j])
        i = j
    return out


def han_tokens(text: str | Column, vocabulary: Iterable[str]) -> Column:
    """The tokens of each run of Han characters of a text, in order."""
    words = frozenset(vocabulary)

    @F.pandas_udf("array<string>")
    def run(runs: pd.Series) -> pd.Series:
        return pd.Series([[w for r in (rs if rs is not None else []) for w in segment_han(r, words)] for rs in runs])

    return run(T.extract(text, HAN))


@lru_cache(maxsize=8)
def _ratio_udf(lo: float, hi: float):
    @F.pandas_udf("string")
    def run(texts: pd.Series, langs: pd.Series, budgets: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rank_summary(t, lang or "eng", ratio=max(lo, min(hi, b / max(n, 1)))) for t, lang, b, n in zip(texts, langs, budgets, sizes, strict=True)])

    return run


def fit_budget(df: DataFrame, budget: int, text: str = "text", prefer: str = "auto", profile: str = "agent") -> DataFrame:
    """``df`` with routed text that fits a budget of tokens, if it can.

    Texts that routing leaves over budget are summarised (unless ``prefer`` is
    another way); tokens of a summary are words. Adds type, strategy, fitted,
    tokens, fits, exceeded_by.
    """
    r = cut(route(df, text, profile), "routed")
    over = F.col("tokens_after") > budget
    summary = _ratio_udf(0.05, 0.9)(F.when(over & F.lit(prefer in ("auto", "summarize")), F.col("routed")), F.lit("eng"), F.lit(budget), F.col("tokens_after"))
    r = r.withColumn("_s", summary).withColumn("_n", T.words_count(F.coalesce("_s", F.lit(""))))
    better = F.coalesce((F.col("_s") != "") & (F.col("_n") < F.col("tokens_after")), F.lit(False))
    tokens = F.when(better, F.col("_n")).otherwise(F.col("tokens_after"))
    out = r.withColumn("fitted", F.when(better, F.col("_s")).otherwise(F.col("routed"))).withColumn("tokens", tokens)
    out = out.withColumn("strategy", F.when(better, "route+summarize").otherwise("route")).withColumn("fits", F.col("tokens") <= budget)
    return out.withColumn("exceeded_by", F.greatest(F.lit(0).cast("long"), F.col("tokens") - budget)).drop("_s", "_n", "routed", "tokens_before", "tokens_after")


def compress_conversations(messages: DataFrame, budget: int | None = None, keep: int = 4) -> DataFrame:
    """Rows (conv_id, turn, role, text): older messages routed, the last ones verbatim.

    Over a budget of words, the older ones become one system message at the place
    of the first of them, a summary.
    """
    m = sessions.conversation_split(messages, "conv_id", "turn", keep)
    long_ = ~F.col("verbatim") & (T.words_count("text") > LONG_MESSAGE)
    r = cut(route(m.withColumn("_text", F.col("text")).withColumn("text", F.when(long_, F.col("text")).otherwise("")), "text", "agent"), "routed")
    r = r.withColumn("text", F.when(long_ | (F.col("routed") != ""), F.coalesce(F.nullif("routed", F.lit("")), "_text")).otherwise(F.col("_text"))).select("conv_id", "turn", "role", "text", "verbatim")
    if budget is None:
        return r.select("conv_id", "turn", "role", "text")
    n = T.words_count("text")
    sizes = r.groupBy("conv_id").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("verbatim"), n).otherwise(0)).alias("tail"))
    # a conversation's older part is one text: bounded by the conversation
    old = r.where("not verbatim").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"]), "\n").alias("history"))
    old = old.join(sizes.where(F.col("total") > budget), "conv_id")
    room = F.greatest(F.lit(20), F.lit(budget) - F.col("tail"))
    old = old.withColumn("s", _ratio_udf(0.05, 0.8)("history", F.lit("eng"), room, T.words_count("history"))).where("s <> ''")
    summary = old.select("conv_id", "turn", F.lit("system").alias("role"), F.concat(F.lit("[Compressed conversation history]\n"), "s").alias("text"))
    gone = r.join(old.select("conv_id").withColumn("over", F.lit(True)), "conv_id", "left")
    return gone.where("verbatim or over is null").select("conv_id", "turn", "role", "text").unionByName(summary)


class ContextWindow:
    """A context window that is summarised when it is over its budget: the fold of one conversation."""

    def __init__(self, budget: int, keep: int = WINDOW_KEEP, dedup: bool = True) -> None:
        self.budget, self.keep, self.dedup = budget, keep, dedup
        self.messages: list[tuple[str, str]] = []
        self.seen: set[str] = set()

    def render(self) -> str:
        return "\n".join(f"{r}: {t}" for r, t in self.messages)

    def add(self, role: str, text: str | None) -> None:
        if not text or not text.strip() or (self.dedup and text in self.seen):
            return
        self.seen.add(text)
        self.messages.append((role, text))
        if len(self.render()) // 4 > self.budget and len(self.messages) > self.keep:
            self.compact()

    def compact(self) -> None:
        system = [m for m in self.messages if m[0] == "system"]
        old = self.messages[len(system) : len(self.messages) - self.keep]
        if old:
            summary = rank_summary("\n".join(f"{r}: {t}" for r, t in old), "eng", ratio=WINDOW_RATIO)
            self.messages = [*system, ("assistant", f"[Summary of earlier context: {summary}]"), *self.messages[-self.keep :]]


def context_windows(messages: DataFrame, budget: int, keep: int = WINDOW_KEEP) -> DataFrame:
    """Rows (conv_id, pos, role, text): what each conversation's window holds at its end."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("turn", kind="stable")
        w = ContextWindow(budget, keep)
        for role, text in zip(f["role"], f["text"], strict=True):
            w.add(role, text)
        return pd.DataFrame({"conv_id": f["conv_id"].iloc[0], "pos": range(len(w.messages)), "role": [m[0] for m in w.messages], "text": [m[1] for m in w.messages]})

    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, pos int, role string, text string")


def shared_context(entries: DataFrame, now: Column, ttl: int = SHARED_TTL, most: int = SHARED_MOST) -> DataFrame:
    """Live entries (key, original, compressed, tokens_before, tokens_after) of (key, text, created_at).

    The last entry of a key counts; the oldest go beyond ``most``.
    """
    last = entries.groupBy("key").agg(F.max(F.struct("created_at", "text")).alias("e")).select("key", "e.created_at", "e.text")
    live = last.where(F.col("created_at") >= now - F.make_interval(secs=F.lit(ttl))).orderBy(F.desc("created_at"), "key").limit(most)
    c = compress(live, "semantic")
    return c.select("key", F.col("text").alias("original"), F.col("compressed_text").alias("compressed"), T.pieces_count("text").alias("tokens_before"), T.pieces_count("compressed_text").alias("tokens_after"))


def gate(requests: DataFrame, rules: DataFrame, block_mode: bool = False, limit: int = sessions.RATE_LIMIT) -> DataFrame:
    """``requests`` (ip, ts, path, query, user_agent, id) with decision, category and rule.

    An allowed address passes; a blocked one (rules: ip, kind, expires_at) is turned
    away only in block mode; then comes the rate, then the content. Without block
    mode all pass and what was found is told.
    """
    named = requests.join(rules.where("kind = 'Allow'").select("ip").distinct().withColumn("_allow", F.lit(True)), "ip", "left")
    active = rules.where("kind = 'Block'").select(F.col("ip").alias("_ip"), "expires_at")
    blocked = named.join(active.groupBy("_ip").agg(F.max(F.coalesce("expires_at", F.lit("9999-12-31").cast("timestamp"))).alias("_until")), F.col("ip") == F.col("_ip"), "left").drop("_ip")
    rated = sessions.rate_limit(blocked, "ip", limit=limit)
    target = F.concat_ws(" ", "path", F.coalesce("query", F.lit("")))
    found = rated.withColumn("_t", target).withColumn("_w", guards.inspect_request("_t", "user_agent"))
    kind = F.when(F.col("_allow"), None).when(F.col("_until") > F.col("ts"), F.when(F.lit(block_mode), "IpBlock")).when(F.col("limited"), "RateLimit").otherwise(F.col("_w.category"))
    category = F.coalesce(kind, F.when(F.col("_allow").isNull() & F.col("limited"), "RateLimit"), F.when(F.col("_allow").isNull(), F.col("_w.category")))
    decision = F.when(category.isNull(), "Allowed").when(F.lit(block_mode), "Blocked").otherwise("Detected")
    return found.withColumn("category", category).withColumn("decision", decision).withColumn("rule", F.when(F.col("category") == F.col("_w.category"), F.col("_w.rule"))).drop("_allow", "_until", "_t", "_w", "in_window", "limited")


def rag_prepare(messages: DataFrame, notes: DataFrame, block_at: int | None = privacy.BLOCK_AT, recall: int = 3) -> DataFrame:
    """Messages (id, text) masked, routed and with the notes (note_id, text) that they recall.

    A message whose score reaches ``block_at`` is blocked: it has no text.
    """
    m = messages.withColumn("score", F.coalesce(privacy.analysis("text")["score"], F.lit(0)))
    m = cut(privacy.masked(m).withColumn("blocked", F.col("score") >= block_at if block_at is not None else F.lit(False)), "masked")
    r = cut(route(m.withColumn("text", F.when(~F.col("blocked"), F.col("masked_text"))), "text"), "routed")
    near = retrieval.recall_many(notes, "note_id", m.select("id", F.col("masked_text").alias("text")), "id", recall)
    recalled = near.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("recalled"))
    out = r.join(recalled, F.col("id") == F.col("query"), "left")
    return out.select("id", "score", "blocked", F.when(~F.col("blocked"), F.col("routed")).alias("prepared"), F.when(~F.col("blocked"), F.col("recalled")).alias("recalled"), "tokens_before", "tokens_after")


def compress_for_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_budget(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), 200)


def conversation_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_conversations(tables.read(spark, sf_dir, "conversations"), 60)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_windows(tables.read(spark, sf_dir, "conversations"), 100)


def shared_context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("key"), "text", F.timestamp_seconds("doc_id").alias("created_at"))
    return shared_context(d, F.lit(d.agg(F.max("created_at")).first()[0]), 86_400)


def han_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up Chinese of a few words, one for each event."""
    words = ["我们", "不是", "问题", "这", "学生", "大学生"]
    pick = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("event_id") + k, F.lit(6)) + 1).cast("int"))
    e = tables.read(spark, sf_dir, "events").select("event_id", F.concat(pick(0), F.lit("的"), pick(2), F.lit("。"), pick(4)).alias("text"))
    return e.select("event_id", F.array_join(han_tokens("text", words), "|").alias("tokens"))


def waf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    q = F.when(F.col("event_type") == "error", "q=1 union select 2").otherwise("q=1")
    r = e.select("event_id", F.col("user_id").cast("string").alias("ip"), "ts", F.lit("/search").alias("path"), q.alias("query"), F.lit("Mozilla").alias("user_agent"))
    rules = spark.createDataFrame([("1", "Allow", None), ("2", "Block", None)], "ip string, kind string, expires_at timestamp")
    return gate(r, rules, block_mode=True).select("event_id", "decision", "category", "rule")


def rag_prepare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    notes = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("note_id"), "text")
    return rag_prepare(c, notes).withColumn("recalled", F.array_join(F.transform("recalled", lambda x: x.cast("string")), ","))


QUERIES = {
    "compress_for_context": compress_for_context, "conversation_compress": conversation_compress, "context_window": context_window, "shared_context": shared_context_query, "han_segments": han_segments,
    "waf_gate": waf_gate, "rag_prepare": rag_prepare_query,
}
ORACLES = {
    "waf_gate": """SELECT event_id, CASE WHEN user_id = 1 THEN 'Allowed' WHEN user_id = 2 OR event_type = 'error' THEN 'Blocked' ELSE 'Allowed' END AS decision, CASE WHEN user_id = 1 THEN NULL WHEN user_id = 2 THEN 'IpBlock' WHEN event_type = 'error' THEN 'SqlInjection' END AS category,
      CASE WHEN user_id NOT IN (1, 2) AND event_type = 'error' THEN 'UNION SELECT' END AS rule FROM events""",
}

"""Multi-step queries: planning, evidence merging, sufficiency, fallback, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that split a query, ask for history, or ask for more than one hop.
SPLIT = r"(?i)\s+&&\s+|\s+and\s+|\s+also\s+|\s+versus\s+|\s+vs\.?\s+|[;；]+|以及|并且|同时|对比|比较"
HISTORY = r"(?i)history|historical|change|changed|evolution|previous|before|timeline|why|历史|变化|演化|之前|原因|决策过程"
MULTI_HOP = r"(?i)relationship|related across|across projects|root cause|multi[- ]?hop|关系|跨项目|根因|多跳"
PLANNING_WORDS = r"(?i)\b(?:history|historical|change|changed|evolution|previous|before|timeline|why|relationship|related across|across projects|root cause|multi[- ]?hop)\b"
PLANNING_SIGNS = "历史|变化|演化|之前|原因|决策过程|关系|跨项目|根因|多跳"
MOST_OBLIGATIONS = 32


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(parts: Column) -> Column:
    """Parts without planning words, in order, each once; a part of planning words alone stays as it is."""
    part = lambda p: F.coalesce(F.nullif(squeeze(F.regexp_replace(F.regexp_replace(p, PLANNING_WORDS, " "), PLANNING_SIGNS, " ")), F.lit("")), squeeze(p))
    return F.filter(F.array_distinct(F.transform(parts, part)), lambda p: p != "")


def split_query(query: Column) -> Column:
    return stripped(F.split(query, SPLIT))


def plan_id(requests: DataFrame, queries: Column) -> Column:
    """16 signs of a digest of what was asked and planned; absent fields count as null."""
    of = lambda c, kind="string": (F.col(c) if c in requests.columns else F.lit(None)).cast(kind)
    fields = F.struct(F.col("query"), queries.alias("queries"), F.col("strategy"), F.col("include_history").alias("includeHistory"), of("key").alias("key"), of("kind").alias("kind"), of("scope").alias("scope"), of("task_id").alias("taskId"))
    return F.substring(base64url(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)), 1, 16)


def plan(requests: DataFrame, most_subqueries: int) -> DataFrame:
    """``requests`` (query, key, strategy, include_history, and subqueries where given) with queries, total_queries, capped, complexity,
    strategy_used, history, refused and plan_id. Sub-queries given stand for the query's own parts, a key for both. A plan of more than
    MOST_OBLIGATIONS sub-queries is refused: it has none."""
    parts = F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.split("query", SPLIT))
    asked = stripped(F.coalesce("subqueries", parts) if "subqueries" in requests.columns else parts)
    wanted = F.when(F.col("strategy") == "direct", F.when(F.size(asked) > 0, F.slice(asked, 1, 1)).otherwise(F.array("query"))).otherwise(asked)
    history = (F.col("strategy") != "direct") & (F.col("include_history") | F.col("query").rlike(HISTORY))
    hops = F.col("query").rlike(MULTI_HOP)
    out = requests.withColumn("requested", wanted).withColumn("refused", F.size("requested") > MOST_OBLIGATIONS)
    out = out.withColumn("queries", F.when(F.col("refused"), F.array().cast("array<string>")).otherwise(F.slice("requested", 1, most_subqueries)))
    complexity = F.when(hops, "L3").when(history | (F.size("queries") > 1), "L2").when(F.col("key").isNotNull(), "L0").otherwise("L1")
    out = out.withColumns({"total_queries": F.size("requested"), "capped": F.size("requested") > most_subqueries, "history": history, "complexity": complexity, "plan_id": plan_id(requests, F.col("queries"))})
    used = F.when(F.col("strategy") == "direct", "direct").when((F.col("strategy") == "multi_step") | F.col("complexity").isin("L2", "L3"), "multi_step").otherwise("direct")
    return out.withColumn("strategy_used", used).withColumn("history", F.col("history") & (F.col("strategy_used") == "multi_step") & ~F.col("refused"))


def steps(plans: DataFrame, most_steps: int) -> DataFrame:
    """One row a step: recalls in order, then history; steps past ``most_steps`` are skipped."""
    recall = F.transform("queries", lambda q, i: F.struct((i + 1).alias("step"), F.concat(F.lit("recall-"), (i + 1).cast("string")).alias("step_id"), q.alias("query")))
    last = F.when(F.col("history"), F.array(F.struct((F.size("queries") + 1).alias("step"), F.lit("history-1").alias("step_id"), F.lit(None).cast("string").alias("query")))).otherwise(F.array().cast("array<struct<step:int,step_id:string,query:string>>"))
    out = plans.select("request_id", F.explode(F.concat(recall, last)).alias("s")).select("request_id", "s.*")
    return out.withColumn("status", F.when(F.col("step") <= most_steps, "completed").otherwise("skipped"))


def merge_evidence(hits: DataFrame, k: int = 60) -> DataFrame:
    """Evidence of a request over its sub-queries: summed scores, best rank, matched sub-queries. ``hits``: request_id,
    subquery, memory_id, updated_at, rank, score (null: by rank)."""
    score = F.coalesce("score", F.lit(1.0) / (F.lit(k) + F.col("rank")))
    merged = hits.groupBy("request_id", "memory_id", "updated_at").agg(
        F.round(F.sum(score), 8).alias("score"), F.min("rank").alias("min_rank"), F.array_join(F.array_sort(F.collect_set(F.col("subquery").cast("string"))), ",").alias("matched"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("memory_id"))
    return merged.withColumn("evidence_rank", F.row_number().over(w))


def sufficiency(rows: DataFrame) -> DataFrame:
    """``rows`` (evidence, min_evidence, matched, total_queries, history, history_count, history_truncated, unsupported,
    capped, stopped) with status, reasons and fallback."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("evidence") == 0, "no_evidence"), F.when(c("evidence") < c("min_evidence"), "below_min_evidence"), F.when(c("matched") < c("total_queries"), "partial_query_coverage"),
        F.when(c("history") & (c("history_count") == 0), "missing_history_evidence"), F.when(c("history_truncated"), "history_limit"), F.when(c("unsupported"), "unsupported_complexity"),
        F.when(c("stopped") != "completed", c("stopped"))))
    good = (~c("unsupported") & ~c("capped") & ~c("history_truncated") & (c("evidence") >= c("min_evidence")) & (c("matched") == c("total_queries"))
            & (~c("history") | (c("history_count") > 0)) & (c("stopped") == "completed"))
    status = F.when(good, "sufficient").when(c("evidence") > 0, "partial").otherwise("insufficient")
    fallback = F.array_compact(F.array(
        F.when(c("unsupported"), "unsupported_complexity"), F.when(c("capped"), "subquery_limit"), F.when(c("history_truncated"), "history_limit"),
        F.when(c("stopped") == "max_steps", "max_steps"), F.when(c("stopped") == "timeout", "timeout"), F.when(~good, "insufficient_evidence")))
    return rows.withColumns({"status": status, "reasons": F.array_join(reasons, ","), "fallback": F.array_join(fallback, ",")})


def base64url(digest_hex: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(digest_hex)), "+/", "-_"), F.lit("="))


def budgeted_sufficiency(rows: DataFrame) -> DataFrame:
    """``sufficiency`` of what was packed: its columns with ``packed`` (evidence packed), ``covered`` (queries covered), candidate_truncated and
    fact_conflict; history is never packed. A truncated candidate list makes enough evidence partial."""
    judged = sufficiency(rows.withColumns({"found": F.col("evidence"), "evidence": F.col("packed"), "matched": F.col("covered"), "history_count": F.lit(0)}))
    c = F.col
    more = F.array_compact(F.array(
        F.nullif(c("reasons"), F.lit("")), F.when((c("found") > 0) & (c("packed") == 0), "empty_context"), F.when(c("packed") < c("found"), "context_budget"), F.when(c("history"), "history_not_projected"),
        F.when(c("capped"), "subquery_limit"), F.when(c("candidate_truncated"), "candidate_limit"), F.when(c("fact_conflict"), "fact_conflict")))
    status = F.when((c("status") == "sufficient") & c("candidate_truncated"), "partial").otherwise(c("status"))
    return judged.withColumns({"reasons": F.array_join(more, ","), "status": status})


def with_history(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """``evidence`` (memory_id) with event_count and versions of its history, joined once by memory. ``events``: memory_id, version."""
    past = events.groupBy("memory_id").agg(F.count("*").alias("event_count"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    return evidence.join(past, "memory_id", "left").fillna({"event_count": 0, "versions": ""})

"""Context packs: selection order, token-budgeted packing, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a purpose prefers a kind.
PURPOSE_WEIGHT = {
    "general": {"user_preference": 8, "user_fact": 6, "task_state": 7, "decision": 7},
    "coding": {"task_state": 12, "decision": 10, "user_preference": 8, "user_fact": 5},
    "research": {"decision": 12, "user_fact": 10, "task_state": 7, "user_preference": 5},
    "browser": {"user_preference": 12, "user_fact": 6, "task_state": 10, "decision": 5},
}


def purpose_weight(purpose: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p, kinds in PURPOSE_WEIGHT.items() for k, w in kinds.items() for x in (f"{p}/{k}", w)])
    return F.try_element_at(table, F.concat_ws("/", purpose, kind))


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4))).cast("bigint")


def selection_order(candidates: DataFrame, mode: str) -> DataFrame:
    """``candidates`` (request_id, input_rank, exact_tier, score, purpose, kind, scope, user_confirmed, updated_at, memory_id)
    with priority and select_rank. One unscored candidate puts its whole request in input order."""
    weight = purpose_weight(F.col("purpose"), F.col("kind"))
    unscored = F.max(F.col("score").isNull().cast("int")).over(Window.partitionBy("request_id")) == 1
    if mode == "input_order":
        unscored = F.lit(True)
    score = F.coalesce("score", F.lit(0.0))
    legacy = F.round(score * 1000 + F.when(F.col("scope") == "task", 20).when(F.col("scope") == "agent", 15).otherwise(0) + F.when(F.col("user_confirmed"), 10).otherwise(0) + weight, 6)
    tier, first, second = {
        "relevance_first": (F.col("exact_tier"), score, weight), "relevance_only": (F.col("exact_tier"), score, F.lit(0)),
        "legacy_weighted": (F.lit(0), legacy, F.lit(0)), "input_order": (F.lit(0), score, F.lit(0))}[mode]
    keyed = candidates.withColumns({"__in": F.when(unscored, F.col("input_rank")).otherwise(0), "__t": F.when(unscored, 0).otherwise(tier),
                                    "__a": F.when(unscored, 0.0).otherwise(first.cast("double")), "__b": F.when(unscored, 0).otherwise(second)})
    w = Window.partitionBy("request_id").orderBy("__in", F.desc("__t"), F.desc("__a"), F.desc("__b"), F.desc("updated_at"), F.desc("memory_id"))
    return keyed.withColumn("select_rank", F.row_number().over(w)).drop("__in", "__t", "__a", "__b")


def pack(ordered: DataFrame) -> DataFrame:
    """Greedy packing with skips of ``ordered`` (request_id, select_rank, memory_id, line, usable, token_budget, max_memories).

    A fold along the ranks: the budget is tested on the whole joined text, and rejected rows use none of it. A
    request holds at most a few channels' limits of candidates, so its list is short.
    Returns request_id, memory_id, select_rank, reason ("packed" or why not), used_tokens after it.
    """
    row = F.struct("select_rank", "memory_id", F.octet_length("line").alias("size"), F.coalesce("usable", F.lit(True)).alias("usable"))
    lists = ordered.groupBy("request_id", "token_budget", "max_memories").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "array<struct<memory_id:string,select_rank:int,reason:string,used_tokens:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("items"), F.array().cast(kind).alias("out"))

    def step(a, r):
        size = a["bytes"] + F.when(a["items"] > 0, 1).otherwise(0) + r["size"]
        reason = F.when(~r["usable"], "fact_unresolved").when(a["items"] >= F.col("max_memories"), "max_memories").when(F.ceil(size / 4) > F.col("token_budget"), "token_budget").otherwise("packed")
        taken = reason == "packed"
        used = F.when(taken, size).otherwise(a["bytes"])
        item = F.struct(r["memory_id"].alias("memory_id"), r["select_rank"].alias("select_rank"), reason.alias("reason"), F.ceil(used / 4).cast("bigint").alias("used_tokens"))
        return F.struct(used.cast("bigint").alias("bytes"), (a["items"] + taken.cast("int")).alias("items"), F.concat(a["out"], F.array(item)).alias("out"))

    return lists.select("request_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("packed_row")).select("request_id", "packed_row.*")


def pack_for_coverage(ordered: DataFrame) -> DataFrame:
    """Greedy set cover before rank order: as ``pack``, with ``obligations`` (array<string>) a candidate.

    Each step takes the candidate that covers most open obligations (ties by rank); what it can't fit is left
    out for good. The rest follows by rank. A request has at most some hundreds of rows."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("select_rank").itertuples(index=False))
        budget, most = int(rows[0].token_budget), int(rows[0].max_memories)
        need = {o for r in rows for o in r.obligations}
        covered: set[str] = set()
        size, items, out, left = 0, 0, [], list(rows)

        def offer(r) -> bool:
            nonlocal size, items
            grown = size + (items > 0) + len(r.line.encode())
            reason = "max_memories" if items >= most else "token_budget" if -(-grown // 4) > budget else "packed"
            if reason == "packed":
                size, items = grown, items + 1
                covered.update(r.obligations)
            out.append((r.request_id, r.memory_id, r.select_rank, reason))
            return reason == "packed"

        while need - covered and items < most:
            best = max(left, key=lambda r: (len(set(r.obligations) - covered), -r.select_rank), default=None)
            if best is None or not set(best.obligations) - covered:
                break
            left.remove(best)
            offer(best)
        for r in left:
            offer(r)
        return pd.DataFrame(out, columns=["request_id", "memory_id", "select_rank", "reason"])

    return ordered.groupBy("request_id").applyInPandas(fold, "request_id bigint, memory_id string, select_rank int, reason string")


def coverage(obligations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """request_id, obligation, outcome: the best fate of the memories that meet it.

    ``obligations``: request_id, obligation, memory_id (null: none was found); ``outcomes``: request_id, memory_id, reason.
    """
    joined = obligations.join(outcomes, ["request_id", "memory_id"], "left")
    has = lambda c: F.max(c.cast("int")) == 1
    reason = F.col("reason")
    return joined.groupBy("request_id", "obligation").agg(
        F.when(has(F.coalesce(reason == "packed", F.lit(False))), "selected").when(~has(F.col("memory_id").isNotNull()), "none_retrieved")
        .when(has(F.coalesce(reason == "confirmation_required", F.lit(False))), "confirmation_required").when(has(F.coalesce(reason == "fact_unresolved", F.lit(False))), "fact_unresolved")
        .otherwise("context_budget").alias("outcome"))


def escape_envelope(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def selection_receipt(candidates: DataFrame, mode: str) -> DataFrame:
    """request_id, input_count, eligible_count, confirmation_filtered, order. ``candidates``: request_id, require_confirmed, user_confirmed, score."""
    stays = ~F.col("require_confirmed") | F.col("user_confirmed")
    counted = candidates.groupBy("request_id").agg(F.count("*").alias("input_count"), F.count_if(stays).alias("eligible_count"), F.count_if(stays & F.col("score").isNull()).alias("unscored"))
    named = {"relevance_first": "exact_score_purpose_updated_id", "relevance_only": "exact_score_updated_id", "legacy_weighted": "legacy_weighted"}[mode]
    order = F.lit(named) if mode == "legacy_weighted" else F.when(F.col("unscored") > 0, "input_order").otherwise(named)
    return counted.select("request_id", "input_count", "eligible_count", (F.col("input_count") - F.col("eligible_count")).alias("confirmation_filtered"), order.alias("order"))


def first_seen(candidates: DataFrame, content: list[str]) -> DataFrame:
    """The first of each request's rows of a memory by input_rank, with how often it came and whether all its rows agree in ``content``."""
    same = Window.partitionBy("request_id", "memory_id")
    told = F.xxhash64(*content)
    out = candidates.withColumns({"place": F.row_number().over(same.orderBy("input_rank")), "times": F.count("*").over(same), "consistent": F.min(told).over(same) == F.max(told).over(same)})
    return out.where("place = 1").drop("place")


def requirement_violations(requirements: DataFrame, candidates: DataFrame, most: int = 32, most_ids: int = 100) -> DataFrame:
    """request_id, code of requirements (request_id, requirement_id, query, memory_ids) that can't be checked: too many, repeated, blank, or of unknown memories."""
    each = requirements.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("requirement_id").alias("ids"), F.count_if(F.length(F.trim("query")) == 0).alias("blank"),
                                                  F.count_if((F.size("memory_ids") > most_ids) | (F.size(F.array_distinct("memory_ids")) < F.size("memory_ids"))).alias("lists"))
    named = requirements.select("request_id", F.explode("memory_ids").alias("memory_id")).distinct()
    unknown = named.join(candidates.select("request_id", "memory_id"), ["request_id", "memory_id"], "left_anti").select("request_id").distinct().withColumn("unknown", F.lit(True))
    codes = F.array_compact(F.array(F.when(F.col("n") > most, "too_many"), F.when(F.col("ids") < F.col("n"), "repeated_id"), F.when(F.col("blank") > 0, "blank_query"), F.when(F.col("lists") > 0, "memory_list"), F.when(F.col("unknown"), "unknown_memory")))
    return each.join(unknown, "request_id", "left").select("request_id", F.explode(codes).alias("code"))

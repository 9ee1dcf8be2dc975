"""Retrieval quality and latency metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.round(F.when(denominator != 0, numerator / denominator), 6)


def ranking_scores(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per request with a relevant memory: recall, reciprocal rank and nDCG at ``k``, misses, false selections, leaks.

    ``ranked``: request_id, memory_id, final_rank; ``judged``: request_id, memory_id, grade (>0 relevant, <0 forbidden).
    """
    top = ranked.where(F.col("final_rank") <= k).select("request_id", "memory_id", "final_rank")
    wanted = judged.groupBy("request_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    seen = top.join(judged, ["request_id", "memory_id"], "left")
    gain = F.pow(F.lit(2.0), F.col("grade").cast("double")) - 1
    got = seen.groupBy("request_id").agg(
        F.count("*").alias("selected"), F.count_if(F.col("grade") > 0).alias("hits"), F.count_if(F.col("grade") < 0).alias("leaks"), F.min(F.when(F.col("grade") > 0, F.col("final_rank"))).alias("first"),
        F.sum(F.when(F.col("grade") > 0, gain / F.log2(F.col("final_rank") + 1.0))).alias("dcg"))
    w = Window.partitionBy("request_id").orderBy(F.desc("grade"), "memory_id")
    ideal = judged.where("grade > 0").withColumn("p", F.row_number().over(w)).where(F.col("p") <= k).groupBy("request_id").agg(F.sum(gain / F.log2(F.col("p") + 1.0)).alias("idcg"))
    out = wanted.where("relevant > 0").join(got, "request_id", "left").join(ideal, "request_id").fillna(0, ["selected", "hits", "leaks"])
    return out.select(
        "request_id", "relevant", "selected", "hits", ratio(F.col("hits"), F.col("relevant")).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"), (F.col("relevant") - F.col("hits")).alias("missed"), (F.col("selected") - F.col("hits")).alias("false_selected"), "leaks")


def nearest_rank(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """``by`` and, for each of ``shares``, the smallest value with at least that share of the values at or below it; nulls don't count. Equal
    values are counted before they are sorted, and a group is read in order: no task holds a group's values."""
    counted = rows.select(*by, value.alias("__v")).where("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.where(value.isNotNull()).groupBy(*by).agg(F.count("*").alias("__total"))
    placed = counted.withColumn("__upto", upto).join(totals, by)
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * share), F.col("__v"))).alias(name) for name, share in shares.items()])


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles: no interpolation."""
    found = nearest_rank(rows, by, F.col(value), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("most")).join(found, by).select(*by, "n", "p50", "p95", "p99", "most")


def regression_gate(rounds: DataFrame, by: str, factor: float = 1.5, slack: float = 0.5) -> DataFrame:
    """Median over rounds of each phase's p95 (``by``, phase before/after, round, p95): after <= before * factor + slack."""
    found = nearest_rank(rounds, [by, "phase"], F.col("p95"), {"median": 0.5})
    medians = found.groupBy(by).agg(*[F.max(F.when(F.col("phase") == x, F.col("median"))).alias(x) for x in ("before", "after")])
    return medians.withColumn("passes", F.col("after") <= F.col("before") * factor + slack)


def issues(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """request_id, memory_id, stage, reason of what went wrong in the first ``k``: relevant memories not found, cut off, or below a selected
    distractor, and selected ones that are not relevant."""
    relevant = judged.where("grade > 0").select("request_id", "memory_id", F.lit(True).alias("relevant"))
    seen = ranked.select("request_id", "memory_id", "final_rank").join(relevant, ["request_id", "memory_id"], "full")
    wrong = F.col("relevant").isNull() & (F.col("final_rank") <= k)
    told = seen.withColumn("first_wrong", F.min(F.when(wrong, F.col("final_rank"))).over(Window.partitionBy("request_id")))
    issue = lambda when, stage, reason: F.when(when, F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason")))
    found = F.array_compact(F.array(
        issue(F.col("relevant") & F.col("final_rank").isNull(), "unattributed", "candidate_not_in_evidence"), issue(F.col("relevant") & (F.col("final_rank") > k), "ranking", "output_top_k"),
        issue(wrong, "relevance", "unrelated_selection"), issue(F.col("relevant") & (F.col("final_rank") > k) & (F.col("first_wrong") < F.col("final_rank")), "ranking", "relevant_below_selected_distractor")))
    return told.select("request_id", "memory_id", F.explode(found).alias("i")).select("request_id", "memory_id", "i.*")


def failure_counts(found: DataFrame) -> DataFrame:
    """stage, reason, distinct cases (requests) and observations."""
    return found.groupBy("stage", "reason").agg(F.countDistinct("request_id").alias("cases"), F.count("*").alias("observations"))


def grouped_summary(scores: DataFrame, by: str) -> DataFrame:
    """Ratios of summed counts and means of ``ranking_scores`` by group, and over all (group null)."""
    return scores.rollup(by).agg(F.count("*").alias("requests"), ratio(F.sum("hits"), F.sum("relevant")).alias("micro_recall"), ratio(F.sum("missed"), F.sum("relevant")).alias("miss"),
                                 ratio(F.sum("false_selected"), F.sum("selected")).alias("false_selection"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def stability(observations: DataFrame) -> DataFrame:
    """case_id, repeat_stable (each rebuild gives one list in all repeats), rebuild_stable (first repeats give one list in all
    rebuilds). ``observations``: case_id, rebuild, repeat_no, place, item."""
    lists = observations.groupBy("case_id", "rebuild", "repeat_no").agg(F.md5(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]))).alias("h"))
    built = lists.groupBy("case_id", "rebuild").agg((F.countDistinct("h") == 1).alias("steady"), F.min_by("h", "repeat_no").alias("first"))
    return built.groupBy("case_id").agg(F.min("steady").alias("repeat_stable"), (F.countDistinct("first") == 1).alias("rebuild_stable"))

"""Input and evidence checks as violation tables: row key, path, code. A clean input gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What enumerated fields may hold.
ENUMS = {
    "kind": ["user_preference", "user_fact", "task_state", "decision"], "scope": ["user", "task", "agent"], "sensitivity": ["public", "private"],
    "purpose": ["general", "coding", "research", "browser"], "write_mode": ["replace", "merge"], "strategy": ["auto", "direct", "multi_step"],
}
MOST_QUERY_CHARS, MOST_TERMS, MOST_LIMIT = 2048, 32, 100


def violations(rows: DataFrame, key: str, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """key, path, code for each rule (path, code) whose condition, true where broken, holds. One pass over ``rows``."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for (path, code), bad in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("key", "v.path", "v.code")


def memory_rules() -> dict[tuple[str, str], Column]:
    """A memory: enumerations, non-empty key without NUL, scope and its owner fields together, half-open validity."""
    rules = {(c, "not_allowed"): ~F.col(c).isin(ENUMS[c]) for c in ("kind", "scope", "sensitivity")}
    return rules | {
        ("memory_key", "empty"): F.length(F.trim(F.coalesce("memory_key", F.lit("")))) == 0, ("memory_key", "nul"): F.contains("memory_key", F.lit("\0")),
        ("task_id", "scope_mismatch"): (F.col("scope") == "task") != F.col("task_id").isNotNull(), ("owner_agent_id", "scope_mismatch"): (F.col("scope") == "agent") != F.col("owner_agent_id").isNotNull(),
        ("version", "not_positive"): F.col("version") < 1,
    }


def request_rules() -> dict[tuple[str, str], Column]:
    return {
        ("query", "too_long"): F.length("query") > MOST_QUERY_CHARS, ("query", "nul"): F.contains("query", F.lit("\0")), ("query", "too_many_terms"): F.size(F.split(F.trim("query"), r"\s+")) > MOST_TERMS,
        ("limit", "out_of_range"): ~F.col("limit").between(1, MOST_LIMIT), ("kind", "not_allowed"): ~F.col("kind").isin(ENUMS["kind"]), ("purpose", "not_allowed"): ~F.col("purpose").isin(ENUMS["purpose"]),
    }


def channel_skips(requests: DataFrame) -> DataFrame:
    """request_id, channel, reason of channels that a request does not use: exact needs a key, or a query that stands for it; structured
    needs a key, kind or scope (a task alone is none); full text needs a query."""
    key, query = F.col("key"), F.nullif(F.trim("query"), F.lit(""))
    reasons = {"exact": F.when(key.isNull() & query.isNull(), "missing_exact_key").when(key.isNotNull() & query.isNotNull() & (key != query), "key_query_mismatch"),
               "structured": F.when(key.isNull() & F.col("kind").isNull() & F.col("scope").isNull(), "missing_structured_filter"), "full_text": F.when(query.isNull(), "empty_query")}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), r.alias("reason")) for c, r in reasons.items()])).alias("skip")
    return requests.select("request_id", rows).select("request_id", "skip.*").where("reason IS NOT NULL")


def ineligible_hits(hits: DataFrame, eligible_pairs: DataFrame) -> DataFrame:
    """Hits that eligibility would not have let through."""
    return hits.join(eligible_pairs.select("request_id", "memory_id"), ["request_id", "memory_id"], "left_anti")


def uncited(statements: DataFrame, packed: DataFrame) -> DataFrame:
    """Statements whose exact version is not in the packed evidence."""
    keys = ["request_id", "memory_id", "source_event_id", "version"]
    return statements.join(packed.select(*keys), keys, "left_anti")


def delta_rules() -> dict[tuple[str, str], Column]:
    """What a capture source hands over (source, asked_source, thread_id, asked_thread, cursor, base_cursor, is_delta, checkpoint_cursor)."""
    c, blank = F.col, lambda n: F.length(F.col(n)) == 0
    return {
        ("source", "mismatch"): ~c("source").eqNullSafe(c("asked_source")), ("thread_id", "mismatch"): ~c("thread_id").eqNullSafe(c("asked_thread")), ("cursor", "invalid"): blank("cursor"), ("base_cursor", "invalid"): blank("base_cursor"),
        ("is_delta", "no_checkpoint"): c("is_delta") & (c("checkpoint_cursor").isNull() | blank("checkpoint_cursor")), ("base_cursor", "other_checkpoint"): c("is_delta") & ~c("base_cursor").eqNullSafe(c("checkpoint_cursor")),
        ("cursor", "missing"): c("is_delta") & (c("cursor").isNull() | blank("cursor")), ("base_cursor", "on_full_snapshot"): ~c("is_delta") & c("base_cursor").isNotNull(),
    }

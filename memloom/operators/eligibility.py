"""Who may see what: predicates that come before any ranking or limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requests that are broadcast to the memories; more are joined by their user or by trigrams.
MOST_BROADCAST_REQUESTS = 5_000


def small(requests: DataFrame) -> DataFrame:
    """``requests`` with a broadcast hint where they are few. Their number is checked, not assumed."""
    return F.broadcast(requests) if requests.limit(MOST_BROADCAST_REQUESTS + 1).count() <= MOST_BROADCAST_REQUESTS else requests


def visible(r: str = "r", m: str = "m") -> Column:
    """Scope, sensitivity and confirmation of a memory ``m`` for a request ``r`` of the same user."""
    c = lambda a, n: F.col(f"{a}.{n}")
    scope = (c(m, "scope") == "user") | ((c(m, "scope") == "agent") & (c(m, "owner_agent_id") == c(r, "agent_id"))) | ((c(m, "scope") == "task") & (c(m, "task_id") == c(r, "task_id")))
    return scope & (c(r, "include_private") | (c(m, "sensitivity") != "private")) & (~c(r, "require_confirmed") | c(m, "user_confirmed"))


def eligible(requests: DataFrame, memories: DataFrame, *more: Column) -> DataFrame:
    """Pairs of aliases r and m: an equi-join on the user with the rest of the predicate beside it."""
    on = (F.col("r.user_id") == F.col("m.user_id")) & visible()
    for condition in more:
        on &= condition
    return memories.alias("m").join(small(requests).alias("r"), on)


def access_outcome(requests: DataFrame, api_key: str | None, agents: list[str], allow_private: bool) -> DataFrame:
    """``requests`` (transport, api_key, agent_id, include_private) with ``outcome``: the first rule that refuses, or allowed."""
    refused = F.when((F.col("transport") == "http") & ~F.col("api_key").eqNullSafe(F.lit(api_key)), "UNAUTHORIZED") if api_key else F.when(F.lit(False), "")
    if agents:
        refused = refused.when(~F.coalesce(F.col("agent_id").isin(agents), F.lit(False)), "FORBIDDEN_AGENT")
    if not allow_private:
        refused = refused.when(F.col("include_private"), "FORBIDDEN_PRIVATE")
    return requests.withColumn("outcome", refused.otherwise("allowed"))


def workspace_allowed(path: Column, allowed: Column) -> Column:
    """Equal to an allowed path, or below it; never a mere prefix of a name."""
    base = F.regexp_replace(allowed, "/+$", "")
    return (path == allowed) | path.startswith(F.concat(base, F.lit("/")))

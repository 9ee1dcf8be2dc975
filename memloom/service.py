"""The service: batches of requests over a ledger and its current memories. Each method is one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import context, dense, facts, ledger, query, recall


@dataclass(frozen=True)
class Policy:
    """Limits of one deployment."""

    most_subqueries: int = 3
    most_steps: int = 4
    selection: str = "relevance_first"
    fact_group_limit: int = facts.GROUP_LIMIT
    recall: recall.RecallPolicy = field(default_factory=recall.RecallPolicy)


@dataclass(frozen=True)
class MemoryService:
    """``memories``: current rows; ``events``: their ledger; ``claims``: facts of memories, where there are any; ``index``: vectors, where there
    are any. Requests are DataFrames, so many are answered at once."""

    memories: DataFrame
    events: DataFrame
    policy: Policy = field(default_factory=Policy)
    claims: DataFrame | None = None
    index: recall.VectorIndex | None = None

    def remember(self, commands: DataFrame) -> DataFrame:
        """Outcome of each write command, folded in order."""
        return ledger.apply_commands(commands)

    def forget(self, targets: DataFrame) -> DataFrame:
        """Outcome of a forget for each of ``targets`` (user_id, memory_key, event_seq, idempotency_key)."""
        none = lambda kind: F.lit(None).cast(kind)
        return ledger.apply_commands(targets.select("user_id", "memory_key", "event_seq", F.lit("forget").alias("op"), none("string").alias("value"), F.lit("replace").alias("mode"), none("bigint").alias("expected_version"), "idempotency_key"))

    def history(self, requests: DataFrame) -> DataFrame:
        """A page of the events that each request may see."""
        return ledger.visible_history(requests, self.events)

    def recalled(self, requests: DataFrame) -> recall.Recalled:
        return recall.recall(requests, self.memories, self.policy.recall, self.index)

    def reviewed(self, requests: DataFrame, ranked: DataFrame, at: Column | None = None) -> DataFrame:
        """``ranked`` with status, usable, reason, coverage and accepted_rank. ``at``: the time at which facts must hold (now by default)."""
        if self.claims is None:
            none = F.lit("not_applicable")
            return ranked.select("*", F.lit("unannotated").alias("status"), F.lit(True).alias("usable"), F.lit("legacy_unverified").alias("reason"), none.alias("coverage"), F.col("final_rank").alias("accepted_rank"))
        return facts.resolve(ranked, self.claims, requests, F.current_timestamp() if at is None else at, self.policy.fact_group_limit)

    def recall(self, requests: DataFrame, at: Column | None = None) -> DataFrame:
        """Ranked memories of each request whose facts may be used."""
        found = self.reviewed(requests, self.recalled(requests).ranked, at).where("usable")
        return found.select("request_id", "memory_id", "updated_at", "exact_tier", "score", "channels", F.col("accepted_rank").alias("final_rank"))

    def page(self, requests: DataFrame, at: Column | None = None) -> DataFrame:
        """One page of ``recall`` for each request (cursor, limit), with next_cursor."""
        return recall.page_of(self.recall(requests, at), requests, self.policy.recall)

    def sync(self, jobs: DataFrame, most: int = 100) -> DataFrame:
        """What one run over each user's oldest pending embeddings does (see dense.sync_counts)."""
        return dense.sync_counts(jobs, most)

    def context(self, requests: DataFrame, at: Column | None = None) -> DataFrame:
        """Packed and left-out memories of each request within its token budget; a memory whose fact may not be used is left out for it."""
        fields = self.memories.select("memory_id", "memory_key", "kind", "scope", "user_confirmed", "value")
        asked = requests.select("request_id", "purpose", "token_budget", "max_memories")
        line = F.to_json(F.struct(F.col("memory_key").alias("key"), "value", "kind", "scope"))
        found = self.reviewed(requests, self.recalled(requests).ranked, at)
        rows = found.join(fields, "memory_id").join(asked, "request_id").withColumns({"input_rank": F.col("final_rank"), "line": line})
        return context.pack(context.selection_order(rows, self.policy.selection))

    def query(self, requests: DataFrame, at: Column | None = None) -> DataFrame:
        """Merged evidence of each request over its planned sub-queries (request_id, query, strategy, include_history and the recall fields)."""
        plans = query.plan(requests, self.policy.most_subqueries)
        steps = query.steps(plans, self.policy.most_steps).where("status = 'completed' AND query IS NOT NULL").select("request_id", F.col("step_id").alias("subquery"), F.col("query").alias("subquery_text"))
        asked = requests.join(steps, "request_id").withColumn("query", F.col("subquery_text")).withColumn("asker", F.col("request_id")).withColumn("request_id", F.concat_ws("/", F.col("request_id").cast("string"), "subquery"))
        part = self
        if self.index is not None:  # a sub-query is compared by its request's vector
            named = asked.select("request_id", "asker").join(self.index.queries.withColumnRenamed("request_id", "asker"), "asker")
            part = replace(self, index=replace(self.index, queries=named.select("request_id", "embedding")))
        found = part.recall(asked, at).join(asked.select("request_id", "asker", "subquery"), "request_id")
        return query.merge_evidence(found.select(F.col("asker").alias("request_id"), "subquery", "memory_id", "updated_at", F.col("final_rank").alias("rank"), "score"))

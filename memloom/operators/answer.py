"""Answers made of memories alone: one canonical JSON projection for lines, snapshots and citations, statements word for word.

A projection is a JSON object with its fields in a fixed order, absent ones left out. Two rows have equal projections where all their
fields are equal, whatever signs the fields hold; so lines, snapshot equality and content hashes come from the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.query import base64url

# The fields of a line and of a cited projection, in order, with the column of each.
LINE = {"key": "memory_key", "value": "value", "kind": "kind", "scope": "scope", "version": "version", "taskId": "task_id"}
CITED = {"key": "memory_key", "value": "value", "kind": "kind", "scope": "scope", "taskId": "task_id", "memoryId": "memory_id", "sourceEventId": "source_event_id", "version": "version", "sourceAgentId": "agent_id"}
LIMITATIONS = ["no_semantic_synthesis", "not_truth_verification"]


def projection(fields: dict[str, str], *more: Column, alias: str = "") -> Column:
    """The JSON text of ``fields`` (name to column) and of ``more`` named columns after them."""
    return F.to_json(F.struct(*[F.col(f"{alias}{c}").alias(n) for n, c in fields.items()], *more))


def line(fact_status: Column | None = None) -> Column:
    """The line of a memory in a context, with the assessed status of its fact where it has one."""
    fact = [] if fact_status is None else [F.when(fact_status.isNotNull(), F.struct(fact_status.alias("status"))).alias("fact")]
    return projection(LINE, *fact)


def snapshot_hash() -> Column:
    """Equal for two rows of one memory that hold the same, whatever ranking put beside them."""
    return F.sha2(projection(CITED), 256)


def cite(memories: DataFrame) -> DataFrame:
    """``memories`` with content_hash and citation: an id of an exact version and its content."""
    content = F.sha2(projection(CITED), 256)
    # A JSON array keeps its items apart.
    named = F.concat(F.lit("["), F.to_json(F.struct(F.col("memory_id").alias("a"), F.col("source_event_id").alias("b"), F.col("version").alias("c"), F.col("content_hash").alias("d"))), F.lit("]"))
    return memories.withColumn("content_hash", content).withColumn("citation", F.concat(F.lit("memory:"), base64url(F.sha2(named, 256))))


def inconsistent_snapshots(hits: DataFrame) -> DataFrame:
    """request_id, memory_id of memories that a request's channels saw with unlike contents."""
    return hits.select("request_id", "memory_id", snapshot_hash().alias("h")).groupBy("request_id", "memory_id").agg(F.countDistinct("h").alias("snapshots")).where("snapshots > 1").select("request_id", "memory_id")


def statements(packed: DataFrame, memories: DataFrame) -> DataFrame:
    """What each request may say: request_id, place, memory_id, citation, value, verification, start, stop (code points of the line in the
    context, lines one line feed apart), line.

    ``packed``: request_id, memory_id, select_rank, source_event_id, version of what was packed, and status (of its fact; null: none). A row whose
    version is no longer the memory's gives no statement (see ``contract_violations``).
    """
    held = cite(memories)
    exact = packed.join(held, ["memory_id", "source_event_id", "version"])
    told = exact.withColumn("line", line(F.col("status")))
    w = Window.partitionBy("request_id").orderBy("select_rank", "memory_id")
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    verification = F.when(F.col("status").isNull(), "unverified_memory").otherwise("visible_explicit_assertion")
    return told.select("request_id", F.row_number().over(w).alias("place"), "memory_id", "citation", "value", verification.alias("verification"), before.alias("start"), (before + F.length("line")).alias("stop"), "line")


def contract_violations(packed: DataFrame, memories: DataFrame) -> DataFrame:
    """request_id, memory_id, code of packed rows that can't be cited: not current in that version, packed twice, or of a fact that may not be used (usable)."""
    current = memories.select("memory_id", "source_event_id", "version").withColumn("current", F.lit(True))
    seen = packed.join(current, ["memory_id", "source_event_id", "version"], "left").withColumn("times", F.count("*").over(Window.partitionBy("request_id", "memory_id")))
    codes = F.array_compact(F.array(F.when(F.col("current").isNull(), "other_version"), F.when(F.col("times") > 1, "repeated"), F.when(F.col("status").isNotNull() & ~F.coalesce("usable", F.lit(False)), "fact_not_usable")))
    return seen.select("request_id", "memory_id", F.explode(codes).alias("code"))


def compose(requests: DataFrame, said: DataFrame, coverage: DataFrame, history: Column | None = None) -> DataFrame:
    """request_id, status, statements, covered, total, limitations: evidence_ready where all that was asked is covered, partial where
    something is said, else abstain.

    ``requests``: request_id; ``said``: rows of ``statements``; ``coverage``: request_id, obligation, outcome. A request's
    statements are as few as its pack.
    """
    item = F.struct("place", "citation", "value", "verification", "start", "stop")
    lists = said.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("statements"))
    met = coverage.groupBy("request_id").agg(F.count_if(F.col("outcome") == "selected").alias("covered"), F.count("*").alias("total"))
    rows = requests.join(lists, "request_id", "left").join(met, "request_id", "left").fillna(0, ["covered", "total"])
    status = F.when(F.coalesce(F.size("statements"), F.lit(0)) <= 0, "abstain").when(F.col("covered") >= F.col("total"), "evidence_ready").otherwise("partial")
    limits = F.array(*[F.lit(x) for x in LIMITATIONS])
    limits = limits if history is None else F.when(history, F.concat(limits, F.array(F.lit("history_not_projected")))).otherwise(limits)
    return rows.select("request_id", status.alias("status"), "statements", "covered", "total", limits.alias("limitations"))

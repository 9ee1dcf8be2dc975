"""The event ledger: replay, versions, lifetimes, replacements, idempotency, compare-and-set, history.

The ledger is the only authority; current state is derived, one hash partitioning by identity for all of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.jsontext import merge_objects
from memloom.functions.shared import in_batches
from memloom.operators.eligibility import small
from memloom.operators.ranking import record_page

IDENTITY = ["user_id", "memory_key"]


#: Events that one task sorts, by and large.
TASK_EVENTS = 250_000


def dealt(events: DataFrame) -> DataFrame:
    """``events`` by identity, in as many parts as their number asks for, so that what a task sorts does not grow with them."""
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // TASK_EVENTS))
    return events.repartition(parts, *IDENTITY)


def applied(events: DataFrame) -> DataFrame:
    """``events`` without forgets of keys that have no current state."""
    w = Window.partitionBy(*IDENTITY).orderBy("event_seq", "event_id")
    before = F.lag("is_forget").over(w)
    return dealt(events).withColumn("__before", before).where(~F.col("is_forget") | (F.col("__before") == F.lit(False))).drop("__before")


def versions(events: DataFrame) -> DataFrame:
    """Applied events with lifetime, version, memory_id (its lifetime's first event), supersedes_event, action."""
    w = Window.partitionBy(*IDENTITY).orderBy("event_seq", "event_id")
    lived = applied(events).withColumn("lifetime", F.coalesce(F.sum(F.col("is_forget").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    life = Window.partitionBy(*IDENTITY, "lifetime").orderBy("event_seq", "event_id")
    version = F.sum((~F.col("is_forget")).cast("bigint")).over(life.rowsBetween(Window.unboundedPreceding, 0))
    previous = F.lag("event_id").over(life)
    action = F.when(F.col("is_forget"), "forgotten").when(previous.isNull(), "created").otherwise("replaced")
    return lived.select("*", version.alias("version"), F.first("event_id").over(life.rowsBetween(Window.unboundedPreceding, 0)).alias("memory_id"), previous.alias("supersedes_event"), action.alias("action"))


def current(events: DataFrame) -> DataFrame:
    """The live row of each identity."""
    w = Window.partitionBy(*IDENTITY).orderBy(F.desc("event_seq"), F.desc("event_id"))
    return versions(events).withColumn("__rn", F.row_number().over(w)).where("__rn = 1 AND NOT is_forget").drop("__rn")


def idempotency(events: DataFrame) -> DataFrame:
    """Remembers with the first of their idempotency key, and whether they repeat it or conflict with it."""
    w = Window.partitionBy("user_id", "idempotency_key").orderBy("event_seq", "event_id")
    request = F.sha2(F.concat_ws("|", "memory_key", "kind", F.format_string("%.6f", "value")), 256)
    first = F.first(request).over(w)
    outcome = F.when(F.row_number().over(w) == 1, "original").when(request == first, "duplicate").otherwise("conflict")
    return events.where("NOT is_forget").select("event_id", "user_id", "idempotency_key", F.first("event_id").over(w).alias("first_event"), outcome.alias("outcome"))


def cas_outcomes(events: DataFrame) -> DataFrame:
    """Each command's ``expected_version`` against the version that the ledger held before it (0: no current state)."""
    w = Window.partitionBy(*IDENTITY).orderBy("event_seq", "event_id")
    seen = versions(events)
    before = F.coalesce(F.lag(F.when(F.col("is_forget"), 0).otherwise(F.col("version"))).over(w), F.lit(0))
    return seen.withColumn("actual_version", before).where("NOT is_forget").withColumn("conflict", F.col("expected_version") != F.col("actual_version"))


def history_page(events: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` applied events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_seq"), F.desc("event_id"))
    return applied(events).withColumn("page_rank", F.row_number().over(w)).where(F.col("page_rank") <= size)


def visible_history(requests: DataFrame, events: DataFrame) -> DataFrame:
    """A page of the applied events that each request may see, newest first: request_id, memory_key, event_id, event_seq, page_rank, next_cursor.

    ``requests``: request_id, user_id, agent_id, task_id, include_private, limit, cursor (null: the first page) and memory_key (null: all).
    ``events`` also hold agent_id (who wrote the event, which an agent's event is checked by), scope, task_id, sensitivity.
    """
    print_ = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("user_id", "agent_id", "task_id", "include_private", "memory_key")])), 256)
    asked = requests.withColumn("fingerprint", print_)
    scope = (F.col("m.scope") == "user") | ((F.col("m.scope") == "agent") & (F.col("m.agent_id") == F.col("r.agent_id"))) | ((F.col("m.scope") == "task") & (F.col("m.task_id") == F.col("r.task_id")))
    on = (F.col("r.user_id") == F.col("m.user_id")) & scope & (F.col("r.include_private") | (F.col("m.sensitivity") != "private")) & (F.col("r.memory_key").isNull() | (F.col("r.memory_key") == F.col("m.memory_key")))
    columns = ["user_id", "memory_key", "event_id", "event_seq", "agent_id", "scope", "task_id", "sensitivity"]
    slim = applied(events.select(*columns, "is_forget")).select(*columns)
    rows = slim.alias("m").join(small(asked).alias("r"), on).select("r.request_id", "m.memory_key", "m.event_id", "m.event_seq")
    return record_page(rows, asked.select("request_id", "limit", "cursor", "fingerprint"), "event", "event_seq", "event_id")


def history_quota(targets: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """``limit`` events shared out over each request's targets (request_id, target_rank, user_id, memory_key): an equal
    part each, the remainder to the first ones."""
    n = targets.groupBy("request_id").agg(F.count("*").alias("n"))
    quota = targets.join(n, "request_id").withColumn("quota", F.floor(F.lit(limit) / F.col("n")) + (F.col("target_rank") <= F.lit(limit) % F.col("n")).cast("int"))
    w = Window.partitionBy("request_id", "target_rank").orderBy(F.desc("event_seq"), F.desc("event_id"))
    return quota.join(applied(events).select(*IDENTITY, "event_id", "event_seq"), IDENTITY).withColumn("rn", F.row_number().over(w)).where("rn <= quota")


COMMANDS = "user_id bigint, memory_key bigint, event_seq bigint, status string, version bigint, value string"


def apply_commands(commands: DataFrame) -> DataFrame:
    """Ordered fold of write commands (user_id, memory_key, event_seq, op, value, mode, expected_version,
    idempotency_key; event_id where given, for commands of one event_seq): merge, compare-and-set and replays of a key depend on each other, so each
    identity is folded in order. A command's status is created, replaced, merged, forgotten,
    replayed, version_conflict, idempotency_conflict, not_mergeable or not_found.

    Identities lie one after another in a task's sorted rows; one at a time is held."""
    columns = [*IDENTITY, "event_seq", "op", "value", "mode", "expected_version", "idempotency_key"]
    order = [*IDENTITY, "event_seq", *[c for c in ("event_id",) if c in commands.columns]]
    names = [f.split()[0] for f in COMMANDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, keys = None, None, {}
        for batch in batches:
            statuses, versions_, values = [], [], []
            for user, key, op, text, mode, expected, once in zip(*(batch.column(c).to_pylist() for c in columns if c != "event_seq"), strict=True):
                if (user, key) != at:
                    at, state, keys = (user, key), None, {}
                status, after, held = _applied_command(state, keys, op, text, mode, expected, once)
                statuses.append(status)
                versions_.append(after)
                values.append(held)
                if status == "forgotten":
                    state = None
                elif status in ("created", "replaced", "merged"):
                    state = (after, held)
                    if once is not None:
                        keys[once] = ((op, text, mode, expected), state)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(pa.int64()) for c in names[:3]], *[pa.array(v, t) for v, t in zip((statuses, versions_, values), types[3:], strict=True)]], names=names)

    ordered = dealt(commands.select(*columns, *order[3:])).sortWithinPartitions(*order)
    return in_batches(ordered, fold, COMMANDS)


def _applied_command(state: tuple[int, str] | None, keys: dict, op: str, text: str, mode: str, expected: int | None, once: str | None) -> tuple[str, int, str | None]:
    """status, version and value of one command on an identity's ``state`` (version, value) and the receipts of its idempotency ``keys``."""
    version = state[0] if state else 0
    if op == "forget":
        return ("forgotten" if state else "not_found"), version, None
    if once is not None and once in keys:
        old, receipt = keys[once]
        return ("replayed", *receipt) if old == (op, text, mode, expected) else ("idempotency_conflict", version, None)
    if expected is not None and expected != version:
        return "version_conflict", version, None
    value, status = json.loads(text), "replaced" if state else "created"
    if mode == "merge" and state:
        held = json.loads(state[1])
        if not (isinstance(value, dict) and isinstance(held, dict)):
            return "not_mergeable", version, None
        value, status = merge_objects(held, value), "merged"
    return status, version + 1, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def guard_reviewed(writes: DataFrame, current: DataFrame) -> DataFrame:
    """``writes`` of reviewed handoffs (user_id, task_id, memory_key, kind, scope, user_confirmed, expected_version, seen_id, seen_event, seen_version) with
    ``outcome``: invalid, conflict (the current row is not the reviewed one: id, event and version), or accepted. ``current``: user_id, task_id, memory_id, source_event_id, version."""
    c = F.col
    fresh = (c("seen_version") == 0) & c("seen_id").isNull() & c("seen_event").isNull()
    known = (c("seen_version") > 0) & c("seen_id").isNotNull() & c("seen_event").isNotNull()
    sound = ((c("kind") == "task_state") & (c("scope") == "task") & (c("memory_key") == F.concat(F.lit("handoff:"), c("task_id"))) & c("user_confirmed") & (c("expected_version") == c("seen_version")) & (fresh | known))
    held = current.select("user_id", "task_id", c("memory_id").alias("now_id"), c("source_event_id").alias("now_event"), c("version").alias("now_version"))
    same = c("now_id").eqNullSafe(c("seen_id")) & c("now_event").eqNullSafe(c("seen_event")) & (F.coalesce("now_version", F.lit(0)) == c("seen_version"))
    outcome = F.when(~F.coalesce(sound, F.lit(False)), "invalid").when(~same, "conflict").otherwise("accepted")
    return writes.join(held, ["user_id", "task_id"], "left").withColumn("outcome", outcome).drop("now_id", "now_event", "now_version")

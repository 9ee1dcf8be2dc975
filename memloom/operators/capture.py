"""Conversation capture: turns, redaction, candidate extraction, dedupe, review, retention."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memloom.operators import dice

# What counts as sensitive, in the order in which it is replaced.
REDACTIONS = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "<redacted:private-key>"),
    ("secret", r"\b(?:sk|pk)-[A-Za-z0-9_-]{16,}\b", "<redacted:secret>"),
    ("credential", r"(?i)\b(?:bearer|token|api[_ -]?key|password|passwd|secret)\s*[:=]\s*[^\s,;]+", "<redacted:credential>"),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<redacted:email>"),
    ("phone", r"(?<!\d)(?:\+?\d[\d -]{8,}\d)(?!\d)", "<redacted:phone>"),
]
# Phrases that state something worth keeping: pattern, rationale, kind, confidence.
EXTRACTIONS = [
    (r"(?i)(?:请)?记住[：,:，]?\s*(.+)", "explicit_remember_request", "user_fact", 0.98),
    (r"(?i)我(?:更)?(?:喜欢|偏好|希望)[：,:，]?\s*(.+)", "stated_preference", "user_preference", 0.92),
    (r"(?i)我不喜欢[：,:，]?\s*(.+)", "stated_dislike", "user_preference", 0.92),
    (r"(?i)(?:我们)?(?:决定|确定)(?:以后)?[：,:，]?\s*(.+)", "stated_decision", "decision", 0.9),
    (r"(?i)(?:以后|之后)(?:请)?\s*(.+)", "future_instruction", "user_preference", 0.9),
    (r"(?i)(?:remember that|please remember)\s+(.+)", "explicit_remember_request", "user_fact", 0.98),
    (r"(?i)(?:i prefer|i would like|i like)\s+(.+)", "stated_preference", "user_preference", 0.92),
]
PARTIAL_CONFIDENCE = 0.6
SIMILAR = 0.72


def redact(text: Column, kinds: list[str] | None = None) -> tuple[Column, dict[str, Column]]:
    """Text with sensitive parts replaced in order, and whether each kind was met in what was left by the ones before."""
    found = {}
    for kind, pattern, label in REDACTIONS:
        if kinds is None or kind in kinds:
            found[kind] = text.rlike(pattern)
            text = F.regexp_replace(text, pattern, label.replace("$", r"\$"))
    return text, found


def candidates(items: DataFrame) -> DataFrame:
    """Memory candidates of user messages (thread_id, ordinal, item_type, text, quality): the first match of each pattern,
    trimmed, 2 to 500 characters, each value once an item by pattern order."""
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_extract("text", p, 1).alias("raw"), F.lit(r).alias("rationale"), F.lit(k).alias("kind"), F.lit(c).alias("confidence")) for n, (p, r, k, c) in enumerate(EXTRACTIONS)])
    rows = items.where("item_type = 'user_message' AND text IS NOT NULL").select("thread_id", "ordinal", "quality", F.explode(found).alias("f")).select("thread_id", "ordinal", "quality", "f.*")
    value = F.trim(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^[：,:，\s]+", ""), r"[。.!！\s]+$", ""))
    kept = rows.withColumn("value", value).where(F.length("value").between(2, 500))
    w = Window.partitionBy("thread_id", "ordinal", "value").orderBy("pattern")
    confidence = F.when(F.col("quality") == "complete", F.col("confidence")).otherwise(F.least("confidence", F.lit(PARTIAL_CONFIDENCE)))
    key = F.concat_ws(":", "kind", F.substring(F.sha2(F.concat("kind", F.lit(":\0"), "value"), 256), 1, 16))
    return kept.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("thread_id", "ordinal", "kind", "value", "rationale", confidence.alias("confidence"), "quality", key.alias("dedupe_key"))


def dedupe(found: DataFrame) -> DataFrame:
    """One candidate a dedupe_key: its first place, occurrences, best confidence, complete if ever complete."""
    return found.groupBy("dedupe_key", "kind", "value").agg(
        F.count("*").alias("occurrences"), F.min(F.struct("thread_id", "ordinal")).alias("first"), F.max("confidence").alias("confidence"),
        F.max((F.col("quality") == "complete").cast("int")).alias("complete")).select("dedupe_key", "kind", "value", "occurrences", F.col("first.thread_id").alias("first_thread"), F.col("first.ordinal").alias("first_ordinal"), "confidence", "complete")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def comparable(text: Column, fold: bool = False) -> Column:
    """Lower case without punctuation, symbols and white space; ``fold`` normalises compatibility forms first."""
    return F.regexp_replace(F.lower(nfkc(text) if fold else text), r"[\p{P}\p{S}\s]+", "")


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 2, F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """left_id, right_id, similarity of rows (id, kind, value) of one kind whose bigram Dice similarity is ``least`` or more.

    Nearly all texts share bigrams, so blocks of sets meet as matrices and only pairs that are alike leave a task (see dice)."""
    return dice.alike(_sets(left), _sets(right), least).select("left_id", "right_id", "similarity")


def _sets(rows: DataFrame) -> DataFrame:
    """id, kind, codes, version of the rows whose text has a bigram."""
    version = F.col("version") if "version" in rows.columns else F.lit(0)
    return rows.select("id", "kind", version.alias("version"), dice.element_codes(bigrams(comparable(F.col("value")))).alias("codes")).where(F.size("codes") > 0)


def turns(items: DataFrame) -> DataFrame:
    """``items`` (thread_id, ordinal, role) with turn_no (a user message opens one), place in the turn and final_answer."""
    w = Window.partitionBy("thread_id").orderBy("ordinal")
    numbered = items.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    t = Window.partitionBy("thread_id", "turn_no")
    final = (F.col("role") == "assistant") & (F.col("ordinal") == F.max(F.when(F.col("role") == "assistant", F.col("ordinal"))).over(t))
    return numbered.withColumns({"place": (F.row_number().over(t.orderBy("ordinal")) - 1).cast("bigint"), "final_answer": F.coalesce(final, F.lit(False))})


def turn_quality(numbered: DataFrame) -> DataFrame:
    """complete: a user message and a final answer; else partial."""
    return numbered.groupBy("thread_id", "turn_no").agg(F.count("*").alias("items"), F.max((F.col("role") == "user").cast("int")).alias("user"), F.max(F.col("final_answer").cast("int")).alias("final")).select(
        "thread_id", "turn_no", "items", F.when((F.col("user") == 1) & (F.col("final") == 1), "complete").otherwise("partial").alias("quality"))


def retained(rows: DataFrame, observed: Column, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff; rows without a readable time stay."""
    return rows.where(observed.isNull() | (observed >= cutoff))


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def last_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def needs_sync(threads: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Threads whose update time is not the checkpoint's."""
    return threads.join(checkpoints, "thread_id", "left").where(~F.col("updated").eqNullSafe(F.col("seen"))).drop("seen")


MOST_MATCHES = 5


def review(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """left_id, right_id, similarity, version, place, action for every candidate (id, kind, value) over ``memories`` (id, kind, value, version): equal
    ones link, similar ones (the nearest MOST_MATCHES) must be replaced, else one is created (right_id null)."""
    pairs = dice.alike(_sets(candidates), _sets(memories), SIMILAR, MOST_MATCHES)
    w = Window.partitionBy("left_id").orderBy(F.desc("similarity"), F.desc("version"), "right_id")
    near = pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST_MATCHES)
    equal = near.where("similarity = 1").select("left_id").distinct().withColumn("equal", F.lit(True))
    told = candidates.select(F.col("id").alias("left_id")).join(equal, "left_id", "left").join(near, "left_id", "left").where("equal IS NULL OR similarity = 1")
    return told.withColumn("action", F.when(F.col("equal"), "link_duplicate").when(F.col("right_id").isNotNull(), "replace_required").otherwise("create")).drop("equal")


def decisions(commands: DataFrame) -> DataFrame:
    """``commands`` (command approve or reject, status, sensitivity, wanted_sensitivity, memory_event, action, replace_id, replace_kind,
    replace_version, kind) with outcome, status_after and expected_version of the write. Outcomes that begin with ``refused`` change nothing."""
    c = F.col
    approve = (F.when(c("status") == "rejected", "refused_rejected").when((c("status") == "approved") & (c("sensitivity") != F.coalesce("wanted_sensitivity", "sensitivity")), "refused_sensitivity")
               .when((c("status") == "approved") & c("memory_event").isNotNull(), "already_approved").when(c("action") == "link_duplicate", "linked_duplicate")
               .when((c("action") == "replace_required") & c("replace_id").isNull(), "refused_needs_replacement").when(c("replace_id").isNotNull() & c("replace_kind").isNull(), "refused_no_such_memory")
               .when(c("replace_id").isNotNull() & (c("replace_kind") != c("kind")), "refused_other_kind").when(c("replace_id").isNotNull(), "replaced").otherwise("created"))
    outcome = F.when(c("command") == "approve", approve).when(c("status") == "approved", "refused_approved").otherwise("rejected")
    out = commands.withColumn("outcome", outcome)
    after = F.when(c("outcome").startswith("refused"), c("status")).when(c("outcome") == "rejected", "rejected").otherwise("approved")
    return out.withColumns({"status_after": after, "expected_version": F.when(c("outcome") == "replaced", c("replace_version"))})


def expire(candidates: DataFrame, occurrences: DataFrame, threads: DataFrame, turns: DataFrame, items: DataFrame, cutoff: Column, candidate_cutoff: Column) -> dict[str, DataFrame]:
    """What the cascade keeps of each table: pending candidates go by when they were last seen, reviewed ones by their review, their
    occurrences with them; then turns by their own time or, without one, their thread's; their items; and old threads left without turns."""
    c = F.col
    late = lambda at, limit: F.coalesce(at < limit, F.lit(False))
    pending = c("status") == "pending"
    dead = candidates.where((pending & late(c("last_seen"), candidate_cutoff)) | (~pending & late(F.coalesce("reviewed_at", "last_seen", "created_at"), cutoff))).select("candidate_id")
    seen = occurrences.where(~late(c("observed_at"), candidate_cutoff)).join(dead, "candidate_id", "left_anti")
    counts = seen.groupBy("candidate_id").agg(F.count("*").alias("occurrence_count"))
    left = candidates.join(dead, "candidate_id", "left_anti").drop("occurrence_count").join(counts, "candidate_id", "left").fillna(0, ["occurrence_count"])
    old = threads.where(late(c("updated_at"), cutoff)).select("thread_id")
    at = F.coalesce("completed_at", "started_at")
    gone = turns.where(late(at, cutoff)).select("thread_id", "turn_id").unionAll(turns.where(at.isNull()).join(old, "thread_id", "left_semi").select("thread_id", "turn_id"))
    kept = turns.join(gone, ["thread_id", "turn_id"], "left_anti")
    return {"candidates": left, "occurrences": seen, "turns": kept, "items": items.join(gone, ["thread_id", "turn_id"], "left_anti"),
            "threads": threads.join(old.join(kept.select("thread_id").distinct(), "thread_id", "left_anti"), "thread_id", "left_anti")}


def checkpoint_status(checkpoints: DataFrame) -> DataFrame:
    """threads, tracked_items and latest times by source."""
    return checkpoints.groupBy("source").agg(F.count("*").alias("threads"), F.sum(F.coalesce("items", F.lit(0))).alias("tracked_items"), F.max("synced_at").alias("latest_synced"), F.max("updated_at").alias("latest_updated"))


def sync_state(runs: DataFrame) -> DataFrame:
    """source, last_success, last_error (null after a success) and failures since the last success. ``runs``: source, at, ok."""
    succeeded = runs.where("ok").groupBy("source").agg(F.max("at").alias("last_success"))
    since = F.coalesce(F.col("at") > F.col("last_success"), F.lit(True)) & ~F.col("ok")
    return runs.join(succeeded, "source", "left").groupBy("source").agg(
        F.max("last_success").alias("last_success"), F.max(F.when(since, F.col("at"))).alias("last_error"), F.count_if(since).alias("consecutive_failures"))

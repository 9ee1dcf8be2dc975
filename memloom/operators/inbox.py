"""The conversation inbox: threads, turns and items imported again and again, each row written only where it is new or changed.

All three levels lie in one versioned table, as the rows that each import changed; the last one of a key counts. One import puts out one version
with all its rows and the checkpoints beside them, so data and checkpoint can't part, and an import that changes nothing puts out none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import capture
from memloom.sources.versioned import Version, VersionedTable

KEYS = {"threads": ["source", "thread_id"], "turns": ["source", "thread_id", "turn_id"], "items": ["source", "thread_id", "turn_id", "item_id"], "candidates": ["dedupe_key"]}
SCHEMAS = {
    "threads": "source string, thread_id string, session_id string, cwd string, cli_version string, preview string, created_at bigint, updated_at bigint, cursor string, round int",
    "turns": "source string, thread_id string, turn_id string, status string, quality string, round int",
    "items": "source string, thread_id string, turn_id string, item_id string, ordinal int, item_type string, text string, sensitive boolean, round int",
    "candidates": "dedupe_key string, memory_key string, kind string, value string, confidence double, complete int, occurrences bigint, status string, round int",
}
COUNTERS = ["threads_seen", "threads_imported", "turns_imported", "items_imported", "candidates_created", "skipped_ephemeral", "sensitive_redacted", "candidates_blocked"]


def latest(table: VersionedTable, kind: str, number: int | None = None) -> DataFrame:
    """The last row of each key of a ``kind``."""
    rows = table.read(kind, SCHEMAS[kind], number)
    rest = [c for c in rows.columns if c not in (*KEYS[kind], "round")]
    return rows.groupBy(*KEYS[kind]).agg(F.max_by(F.struct(*rest), "round").alias("x")).select(*KEYS[kind], "x.*")


def sanitised(items: DataFrame) -> DataFrame:
    """``items`` with sensitive parts of their texts replaced, and sensitive where any was, or was said to be; redacted: any was."""
    text, found = capture.redact(F.col("text"))
    met = F.lit(False)
    for hit in found.values():
        met |= F.coalesce(hit, F.lit(False))
    return items.withColumns({"redacted": met, "text": text, "sensitive": met | F.coalesce("sensitive", F.lit(False))})


def _changed(rows: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """``rows`` that are new or unlike what is held, and whether they are new (fresh). Keys of both are whole."""
    rest = [c for c in rows.columns if c not in KEYS[kind]]
    digest = lambda: F.sha2(F.to_json(F.struct(*rest)), 256)
    old = held.select(*KEYS[kind], digest().alias("__old"))
    met = rows.withColumn("__new", digest()).join(old, KEYS[kind], "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("__new")))
    return met.withColumn("fresh", F.col("__old").isNull()).drop("__old", "__new")


def import_threads(table: VersionedTable, source: str, threads: DataFrame, turns: DataFrame, items: DataFrame) -> tuple[Version, DataFrame]:
    """Import a batch, and the counters of COUNTERS as one row.

    ``threads``: source, thread_id, session_id, cwd, cli_version, preview, created_at, updated_at, cursor, ephemeral, is_delta; ``turns``: thread_id,
    turn_id, status, quality; ``items``: thread_id, turn_id, item_id, ordinal, item_type, text, sensitive. A thread of another source raises.
    Ephemeral threads are left out with all below them. A delta keeps the preview and the time of creation that are held, and the client's version
    where it names none. Of a candidate that is held or comes again the occurrences, the best confidence and the best quality are kept; sensitive
    items give none.
    """
    at = table.version()
    number = at.number + 1
    wrong = F.when(F.col("source") != source, F.raise_error(F.lit("a thread of another source"))).otherwise(F.col("source"))
    given = threads.withColumn("source", wrong)
    seen = given.where("NOT ephemeral")
    held = {kind: latest(table, kind, at.number) for kind in KEYS}

    old = held["threads"].select(*KEYS["threads"], *[F.col(c).alias(f"old_{c}") for c in ("preview", "created_at", "cli_version", "updated_at", "cursor")])
    met = seen.join(old, KEYS["threads"], "left")
    preview, _ = capture.redact(F.col("preview"))
    kept = lambda c, new: F.when(F.col("is_delta") & F.col(f"old_{c}").isNotNull(), F.col(f"old_{c}")).otherwise(new)
    version = F.when(F.col("is_delta") & (F.col("cli_version") == "unknown") & F.col("old_cli_version").isNotNull(), F.col("old_cli_version")).otherwise(F.col("cli_version"))
    merged = met.withColumns({"preview": kept("preview", preview), "created_at": kept("created_at", F.col("created_at")), "cli_version": version, "cursor": F.coalesce("cursor", "old_cursor"),
                              "imported": F.col("old_updated_at").isNull() | (F.col("old_updated_at") != F.col("updated_at"))})
    columns = [c for c in SCHEMAS["threads"].replace(",", "").split()[::2] if c != "round"]
    thread_counts = merged.agg(F.count("*").alias("n"), F.count_if("imported").alias("imported"))

    names = seen.select("thread_id").distinct()
    new_turns = turns.join(names, "thread_id").withColumn("source", F.lit(source))
    clean = sanitised(items.join(names, "thread_id").withColumn("source", F.lit(source)))
    new_items = clean.select(*[c for c in SCHEMAS["items"].replace(",", "").split()[::2] if c != "round"])
    item_counts = clean.agg(F.count_if("redacted").alias("redacted"), F.count_if(F.col("sensitive") & (F.col("item_type") == "user_message")).alias("blocked"))

    told = clean.where("NOT sensitive").join(new_turns.select("thread_id", "turn_id", "quality"), ["thread_id", "turn_id"])
    found = capture.candidates(told.withColumn("ordinal", F.struct("turn_id", "item_id")))
    counted = found.groupBy("dedupe_key", "kind", "value").agg(F.max("confidence").alias("confidence"), F.max((F.col("quality") == "complete").cast("int")).alias("complete"), F.countDistinct("thread_id", "ordinal").alias("occurrences"))
    before = held["candidates"].select("dedupe_key", *[F.col(c).alias(f"old_{c}") for c in ("confidence", "complete", "occurrences", "status")])
    grown = counted.join(before, "dedupe_key", "left")
    candidates = grown.select(
        "dedupe_key", F.concat(F.lit("captured:"), "dedupe_key").alias("memory_key"), "kind", "value", F.greatest("confidence", F.coalesce("old_confidence", F.lit(0.0))).alias("confidence"), F.greatest("complete", F.coalesce("old_complete", F.lit(0))).alias("complete"),
        F.greatest("occurrences", F.coalesce("old_occurrences", F.lit(0))).alias("occurrences"), F.coalesce("old_status", F.lit("pending")).alias("status"))

    parts, fresh = [], {}
    for kind, rows in (("threads", merged.select(*columns)), ("turns", new_turns.select("source", "thread_id", "turn_id", "status", "quality")), ("items", new_items), ("candidates", candidates)):
        parts.append(table.write_part(_changed(rows, held[kind], kind).withColumn("round", F.lit(number)), kind))
        fresh[kind] = table.spark.read.schema(f"{SCHEMAS[kind]}, fresh boolean").parquet(f"{table.path}/{parts[-1]['folder']}")
    count = lambda kind: fresh[kind].agg(F.count_if("fresh").alias("n")).first().n
    t, i = thread_counts.first(), item_counts.first()
    numbers = [given.count(), t.imported, count("turns"), count("items"), count("candidates"), given.where("ephemeral").count(), i.redacted, i.blocked]
    counters = table.spark.createDataFrame([tuple(numbers)], ", ".join(f"{c} bigint" for c in COUNTERS))
    if all(rows.isEmpty() for rows in fresh.values()):
        return at, counters
    return table.publish([*at.parts, *parts], at.number, dict(zip(COUNTERS, numbers, strict=True))), counters


def needs_sync(table: VersionedTable, threads: DataFrame) -> DataFrame:
    """``threads`` (source, thread_id, updated_at) that are not held as of that time."""
    held = latest(table, "threads").select("source", "thread_id", "updated_at")
    return threads.join(held, ["source", "thread_id", "updated_at"], "left_anti")


def checkpoints(table: VersionedTable) -> DataFrame:
    """source, thread_id, updated_at, cursor, items: where each thread's import stands."""
    n = latest(table, "items").groupBy("source", "thread_id").agg(F.count("*").alias("items"))
    return latest(table, "threads").select("source", "thread_id", "updated_at", "cursor").join(n, ["source", "thread_id"], "left").fillna(0, ["items"])


"""What the ledger and pages do must not grow with the number of identities, requests or rows of one task."""

import json
import random

from pyspark.sql import functions as F

from memloom.operators import ledger


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_commands_fold_over_sorted_rows_and_not_group_by_group(spark):
    """Identities that go over batches, ties of event_seq by event_id; against the same fold in plain Python."""
    r = random.Random(2)
    rows = [(r.randrange(40), r.randrange(3), r.randrange(60), r.choice(["remember"] * 4 + ["forget"]), json.dumps(r.choice([{"a": r.randrange(3)}, {"b": {"c": r.randrange(3)}}, 7])), r.choice(["merge", "replace"]),
             r.choice([None, None, 0, 1, 2]), r.choice([None, "k1", "k2", "k3"]), i) for i in range(3000)]
    held, want = {}, []
    for u, k, seq, op, value, mode, expected, once, _ in sorted(rows, key=lambda x: (x[2], x[8])):
        state, keys = held.setdefault((u, k), [None, {}])
        status, version, after = ledger._applied_command(state, keys, op, value, mode, expected, once)
        want.append((u, k, seq, status, version, after))
        if status in ("created", "replaced", "merged"):
            state = (version, after)
            if once:
                keys[once] = ((op, value, mode, expected), state)
        elif status == "forgotten":
            state = None
        held[(u, k)][0] = state
    df = spark.createDataFrame(rows, "user_id long, memory_key long, event_seq long, op string, value string, mode string, expected_version long, idempotency_key string, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ledger.apply_commands(df)
        assert "FlatMapGroups" not in plan(got) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {w[3] for w in want} >= {"created", "replaced", "merged", "forgotten", "replayed", "version_conflict", "idempotency_conflict", "not_mergeable", "not_found"}


def events(spark, n):
    i = F.col("id")
    return spark.range(n).select((i % 50).alias("user_id"), (i % 3).alias("memory_key"), i.alias("event_id"), i.alias("event_seq"), F.lit(False).alias("is_forget"), F.lit("a0").alias("agent_id"), F.lit("user").alias("scope"), F.lit(None).cast("string").alias("task_id"), F.lit("public").alias("sensitivity"))


def test_a_task_sorts_no_more_events_where_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(ledger, "TASK_EVENTS", 100, raising=False)
    assert ledger.applied(events(spark, 3000)).rdd.getNumPartitions() == 30


def test_pages_drop_rows_before_the_shuffle(spark):
    e = events(spark, 3000)
    asked = e.select(F.col("user_id").alias("request_id"), "user_id").distinct().selectExpr("*", "'a0' agent_id", "'t' task_id", "true include_private", "CAST(NULL AS BIGINT) memory_key", "3 `limit`", "CAST(NULL AS STRING) cursor")
    page = ledger.visible_history(asked, e)
    assert "WindowGroupLimit" in plan(page)
    newest = page.groupBy("request_id").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    assert {tuple(r) for r in newest.collect()} == {(u, 3, 2950 + u) for u in range(50)}

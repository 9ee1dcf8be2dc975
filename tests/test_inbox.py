"""Imports into the conversation inbox, worked out by hand."""

import pytest

from memloom.operators import inbox
from memloom.sources.versioned import VersionedTable

THREAD = "source string, thread_id string, session_id string, cwd string, cli_version string, preview string, created_at long, updated_at long, cursor string, ephemeral boolean, is_delta boolean"
TURN, ITEM = "thread_id string, turn_id string, status string, quality string", "thread_id string, turn_id string, item_id string, ordinal int, item_type string, text string, sensitive boolean"


def batch(spark, threads, turns, items):
    """(id, preview, created, updated, cursor, ephemeral, delta, cli), (thread, turn, quality), (thread, turn, item, type, text, sensitive)"""
    return (spark.createDataFrame([("cli", t, "s", "/w", cli, p, c, u, cur, e, d) for t, p, c, u, cur, e, d, cli in threads], THREAD), spark.createDataFrame([(t, n, "completed", q) for t, n, q in turns], TURN),
            spark.createDataFrame([(t, n, i, k, kind, text, s) for k, (t, n, i, kind, text, s) in enumerate(items)], ITEM))


@pytest.fixture()
def store(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/inbox")


FIRST = ([("a", "password: hunter2 is it", 1, 10, "c1", False, False, "1.2"), ("b", "plain", 1, 10, None, True, False, "1.2")], [("a", "1", "partial"), ("b", "1", "complete")],
         [("a", "1", "x", "user_message", "I prefer tea. ", False), ("a", "1", "y", "assistant_message", "mail me at a.b@example.org", False), ("a", "1", "z", "user_message", "remember that token: abc123", False),
          ("a", "1", "w", "user_message", "remember that it is hidden", True), ("b", "1", "x", "user_message", "I prefer ephemera", False)])


def test_first_import(spark, store):
    version, counters = inbox.import_threads(store, "cli", *batch(spark, *FIRST))
    assert counters.first().asDict() == {"threads_seen": 2, "threads_imported": 1, "turns_imported": 1, "items_imported": 4, "candidates_created": 1, "skipped_ephemeral": 1, "sensitive_redacted": 2, "candidates_blocked": 2} and version.number == 1
    assert inbox.latest(store, "threads").first().preview == "<redacted:credential> is it"
    items = {r.item_id: (r.text, r.sensitive) for r in inbox.latest(store, "items").collect()}
    assert items["y"] == ("mail me at <redacted:email>", True) and "abc123" not in items["z"][0] and items["x"] == ("I prefer tea. ", False)
    found = inbox.latest(store, "candidates").collect()
    assert len(found) == 1 and found[0].memory_key.startswith("captured:user_preference:") and found[0].value == "tea" and found[0].confidence == 0.6 and found[0].status == "pending"
    assert [tuple(r) for r in inbox.checkpoints(store).collect()] == [("cli", "a", 10, "c1", 4)]


def test_importing_twice_changes_nothing(spark, store):
    inbox.import_threads(store, "cli", *batch(spark, *FIRST))
    before = store.version()
    version, counters = inbox.import_threads(store, "cli", *batch(spark, *FIRST))
    assert version == before == store.version() and counters.first().items_imported == counters.first().candidates_created == counters.first().threads_imported == 0


def test_deltas_keep_what_they_do_not_tell(spark, store):
    inbox.import_threads(store, "cli", *batch(spark, *FIRST))
    later = ([("a", "other", 99, 20, None, False, True, "unknown"), ("n", "new", 5, 5, "k", False, True, "unknown")], [("a", "1", "complete"), ("a", "2", "complete"), ("n", "1", "complete")],
             [("a", "1", "x", "user_message", "I prefer tea. ", False), ("a", "2", "x", "user_message", "I like tea", False)])
    version, counters = inbox.import_threads(store, "cli", *batch(spark, *later))
    c = counters.first()
    assert (c.threads_imported, c.turns_imported, c.items_imported, c.candidates_created) == (2, 2, 1, 0) and version.number == 2
    rows = {r.thread_id: r for r in inbox.latest(store, "threads").collect()}
    assert (rows["a"].preview, rows["a"].created_at, rows["a"].cli_version, rows["a"].updated_at, rows["a"].cursor) == ("<redacted:credential> is it", 1, "1.2", 20, "c1")
    assert (rows["n"].preview, rows["n"].created_at, rows["n"].cli_version) == ("new", 5, "unknown")
    tea = inbox.latest(store, "candidates").first()
    assert (tea.occurrences, tea.confidence, tea.complete) == (2, 0.92, 1)
    asked = spark.createDataFrame([("cli", "a", 20), ("cli", "a", 21), ("cli", "q", 1)], "source string, thread_id string, updated_at long")
    assert {(r.thread_id, r.updated_at) for r in inbox.needs_sync(store, asked).collect()} == {("a", 21), ("q", 1)}
    # What was before stays readable.
    assert inbox.latest(store, "items", 1).count() == 4 and inbox.latest(store, "items").count() == 5


def test_other_sources_raise(spark, store):
    threads, turns, items = batch(spark, *FIRST)
    with pytest.raises(Exception, match="another source"):
        inbox.import_threads(store, "app", threads, turns, items)
    assert store.version().number == 0


def test_empty_import(spark, store):
    threads, turns, items = batch(spark, *FIRST)
    version, counters = inbox.import_threads(store, "cli", threads.limit(0), turns.limit(0), items.limit(0))
    assert version.number == 0 and set(counters.first()) == {0}

"""Versioned tables, the maintained index, backups and answers on small cases."""

import threading

import pytest
from pyspark.sql import functions as F

from memloom.operators import answer, channels, postings, query
from memloom.sources import backup
from memloom.sources.versioned import Version, VersionConflict, VersionedTable

CHANGE = "memory_id string, memory_key string, value string"


def rows_of(spark, *rows, schema="id long, v string"):
    return spark.createDataFrame(list(rows), schema)


def test_versions_and_conflicts(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.version() == Version() and t.read("rows", "id long, v string").count() == 0
    assert t.import_empty(rows_of(spark, (1, "a")), "rows").number == 1
    with pytest.raises(VersionConflict):
        t.import_empty(rows_of(spark, (9, "z")), "rows")
    t.append(rows_of(spark, (2, "b")), "rows", 1)
    with pytest.raises(VersionConflict):
        t.append(rows_of(spark, (3, "c")), "rows", 1)
    read = lambda n=None: sorted(r.id for r in t.read("rows", "id long, v string", n).collect())
    assert read() == [1, 2] and read(1) == [1]
    t.overwrite(rows_of(spark, (7, "g")), "rows", 2)
    assert read() == [7] and read(2) == [1, 2] and t.vacuum(1) == 2 and read() == [7]


def test_two_writers_one_version(spark, tmp_path):
    """Both expect the same version; one gets it, the other a conflict, and the rows are those of the one."""
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.import_empty(rows_of(spark, (1, "a")), "rows")
    parts = [t.write_part(rows_of(spark, (10 + i, "x")), "rows") for i in range(4)]
    out, gate = [], threading.Barrier(4)

    def write(i):
        gate.wait()
        try:
            out.append((i, t.publish([*t.version(1).parts, parts[i]], 1).number))
        except VersionConflict:
            out.append((i, None))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    winners = [i for i, n in out if n == 2]
    assert len(winners) == 1 and sorted(r.id for r in t.read("rows", "id long, v string").collect()) == [1, 10 + winners[0]]


def test_failed_tasks_publish_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.import_empty(rows_of(spark, (1, "a")), "rows")
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken task"))).otherwise(F.col("id").cast("string")).alias("v"), "id").select("id", "v")
    with pytest.raises(Exception, match="broken task"):
        t.append(bad, "rows", 1)
    assert t.version().number == 1 and t.read("rows", "id long, v string").count() == 1
    (tmp_path / "t" / "manifest-2.json").write_text('{"parts": [')  # a writer that died while publishing
    assert t.version().number == 1
    with pytest.raises(VersionConflict):
        t.append(rows_of(spark, (2, "b")), "rows", 1)


def test_index_equals_a_rebuild(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/p")
    change = lambda *rows: postings.apply_changes(t, rows_of(spark, *rows, schema=CHANGE))
    now = {}

    def check(*rows):
        for m, k, v in rows:
            now.pop(m, None)
            if k is not None or v is not None:
                now[m] = (k, v)
        got = sorted(tuple(r) for r in postings.live_postings(t).collect())
        texts = rows_of(spark, *[(m, "\n".join(x.lower() for x in kv if x is not None)) for m, kv in now.items()], schema="memory_id string, t string")
        want = sorted((r.g, r.memory_id) for r in texts.select(F.explode(channels.trigrams(F.col("t"))).alias("g"), "memory_id").collect())
        assert got == want

    first = [("a", "Key", "green nebula"), ("b", "k", "other"), ("c", "k", None), ("d", "k", "gone soon")]
    assert change(*first).number == 1
    check(*first)
    second = [("a", "Key", "red nebula"), ("b", "k", "other"), ("d", None, None), ("e", None, "new"), ("x", None, None)]
    assert change(*second).number == 2
    check(*second)
    # The same again changes nothing, and puts out no version.
    assert change(*second).number == 2
    third = [("d", "k", "back again"), ("a", None, None)]
    change(*third)
    check(*third)
    assert postings.compact(t).number == 4
    check()
    assert t.read("entries", postings.ENTRIES).count() == len(now)
    change(("b", "k", "OTHER"))  # folded, it is the same text
    assert t.version().number == 4


def test_candidates_hold_all_trigrams(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/p")
    postings.apply_changes(t, rows_of(spark, ("a", "k", "green nebula"), ("b", "k", "nebu lain"), ("c", "nebula", "x"), schema=CHANGE))
    asked = rows_of(spark, (1, "Nebula"), (2, "ne"), (3, "%ebu"), schema="request_id long, query string")
    assert {tuple(r) for r in postings.candidates(asked, t).collect()} == {(1, "a"), (1, "c")}


def test_index_rows_are_as_many_as_blocks_times_trigrams(spark, tmp_path):
    """Many memories of few trigrams take few rows, which hold what a table of pairs would, before and after blocks are merged."""
    t = VersionedTable(spark, f"{tmp_path}/p")
    text = lambda i: ("nebula" if i % 3 else "\U0001f600né") + "x" * (i % 4)
    rows = rows_of(spark, *[(f"m{i:05}", "k", text(i)) for i in range(9000)], schema=CHANGE)
    postings.apply_changes(t, rows.repartition(7))
    postings.apply_changes(t, rows_of(spark, *[(f"m{i:05}", None, None) for i in range(0, 9000, 5)], schema=CHANGE))
    now = {f"m{i:05}": "k\n" + text(i) for i in range(9000) if i % 5}
    want = {}
    for m, x in now.items():
        for g in {x[k : k + 3] for k in range(len(x) - 2)}:
            want.setdefault(g, []).append(m)
    for _ in range(2):
        assert t.read("postings", postings.POSTINGS).count() < 400
        assert {tuple(r) for r in postings.live_counts(t).collect()} == {(g, len(m), min(m)) for g, m in want.items()}
        assert postings.live_postings(t).count() == sum(map(len, want.values()))
        asked = rows_of(spark, (1, "\U0001f600Néxx"), (2, "nebulaxxx"), schema="request_id long, query string")
        found = {}
        for r in postings.candidates(asked, t).collect():
            found.setdefault(r.request_id, []).append(r.memory_id)
        assert {k: sorted(v) for k, v in found.items()} == {1: sorted(m for m, x in now.items() if "\U0001f600néxx" in x), 2: sorted(m for m, x in now.items() if "nebulaxxx" in x)}
        postings.compact(t)


def test_backups(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.concat(F.lit("v"), F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("maybe"))
    backup.back_up(rows.repartition(5), f"{tmp_path}/b", "id", 64)
    assert backup.verify(spark, f"{tmp_path}/b").count() == 0 and backup.restore(spark, f"{tmp_path}/b").exceptAll(rows).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        backup.back_up(rows, f"{tmp_path}/b", "id")
    # One row of all is another: its bucket alone differs, and the restore is refused.
    other = rows.withColumn("v", F.when(F.col("id") == 777, "changed").otherwise(F.col("v")))
    found = backup.differing(backup.digests(rows, "id", 64), backup.digests(other, "id", 64)).collect()
    assert len(found) == 1 and found[0].n == found[0].other_n
    other.write.mode("overwrite").parquet(f"{tmp_path}/b/rows")
    with pytest.raises(ValueError, match=str(found[0].bucket)):
        backup.restore(spark, f"{tmp_path}/b")
    backup.back_up(rows.limit(0), f"{tmp_path}/none", "id")
    assert backup.restore(spark, f"{tmp_path}/none").count() == 0


MEMORY = "memory_id string, memory_key string, value string, kind string, scope string, task_id string, source_event_id string, version int, agent_id string"


def memories_of(spark, *rows):
    return spark.createDataFrame([(m, k, v, "fact", "user", None, f"e{m}", 1, "a") for m, k, v in rows], MEMORY)


def test_citations_keep_fields_apart(spark):
    """Values that differ by where a sign lies between two fields have unlike citations; so have versions."""
    m = memories_of(spark, ("a", "k|v", "x"), ("b", "k", "v|x"), ("c", 'k","value":"v', "x"))
    same = m.withColumn("memory_id", F.lit("one")).withColumn("source_event_id", F.lit("e"))
    assert answer.cite(same).select("citation").distinct().count() == 3 and answer.cite(same).select("content_hash").distinct().count() == 3
    assert answer.cite(same.withColumn("version", F.lit(2))).join(answer.cite(same), "citation").count() == 0
    assert answer.inconsistent_snapshots(same.withColumn("request_id", F.lit(1))).count() == 1 and answer.inconsistent_snapshots(m.withColumn("request_id", F.lit(1))).count() == 0


def test_statements_lie_in_the_context(spark):
    m = memories_of(spark, ("a", "k", "first \U0001F600 \"quoted\""), ("b", "k", "second\nline"), ("c", "k", "third"))
    packed = spark.createDataFrame([(1, "b", 1, "eb", 1, None, None), (1, "a", 2, "ea", 1, "active_assertion", True), (2, "c", 1, "ec", 9, None, None)],
                                   "request_id int, memory_id string, select_rank int, source_event_id string, version int, status string, usable boolean")
    said = answer.statements(packed, m).orderBy("place").collect()
    context = "\n".join(r.line for r in said)
    assert [context[r.start:r.stop] for r in said] == [r.line for r in said] and [r.memory_id for r in said] == ["b", "a"]
    assert [r.verification for r in said] == ["unverified_memory", "visible_explicit_assertion"] and '"fact":{"status":"active_assertion"}' in said[1].line
    assert {(r.request_id, r.code) for r in answer.contract_violations(packed, m).collect()} == {(2, "other_version")}
    covered = spark.createDataFrame([(1, "x", "selected"), (1, "y", "none_retrieved")], "request_id int, obligation string, outcome string")
    got = {r.request_id: r for r in answer.compose(spark.createDataFrame([(1,), (2,)], "request_id int"), answer.statements(packed, m), covered).collect()}
    assert got[1].status == "partial" and [s.value for s in got[1].statements] == ["second\nline", "first \U0001F600 \"quoted\""] and got[2].status == "abstain"


def test_plans_given_and_refused(spark):
    rows = [(1, "a and b", None, "auto", False, ["x history", "x", " y "]), (2, " and ".join(f"q{i}" for i in range(33)), None, "auto", False, None), (3, "a", "history key", "auto", False, None), (4, " and ".join(f"q{i}" for i in range(33)), None, "direct", False, None)]
    plans = {r.request_id: r for r in query.plan(spark.createDataFrame(rows, "request_id int, query string, key string, strategy string, include_history boolean, subqueries array<string>"), 3).collect()}
    assert plans[1].queries == ["x", "y"] and plans[3].queries == ["key"] and plans[2].refused and plans[2].queries == [] and not plans[4].refused and plans[4].queries == ["q0"]
    assert len({p.plan_id for p in plans.values()}) == 4 and all(len(p.plan_id) == 16 for p in plans.values())

"""Recall in stages, pages and authorised vectors on small cases worked out by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import channels, dense, ledger, ranking, recall

MEMORY = "memory_id string, user_id string, scope string, owner_agent_id string, task_id string, memory_key string, value string, kind string, sensitivity string, user_confirmed boolean, updated_at long, source_event_id string, version long"
REQUEST = "request_id long, user_id string, agent_id string, task_id string, include_private boolean, require_confirmed boolean, query string, key string, kind string, scope string"


def memories_of(spark, *rows):
    """(memory_id, key, value, changes)"""
    base = {"user_id": "u", "scope": "user", "owner_agent_id": None, "task_id": None, "kind": "fact", "sensitivity": "public", "user_confirmed": True}
    out = [{**base, "memory_id": m, "memory_key": k, "value": v, "updated_at": i, "source_event_id": f"e{m}", "version": 1, **more} for i, (m, k, v, more) in enumerate(rows)]
    return spark.createDataFrame(out, MEMORY)


def requests_of(spark, *rows):
    base = {"user_id": "u", "agent_id": "a", "task_id": "t", "include_private": False, "require_confirmed": False, "key": None, "kind": None, "scope": None}
    return spark.createDataFrame([{**base, "request_id": i, "query": q, **more} for i, (q, more) in enumerate(rows)], REQUEST)


@pytest.fixture(scope="module")
def some(spark):
    return memories_of(spark, ("a", "color", "green nebula", {}), ("b", "nebula", "a word of it", {}), ("c", "k", "the green one", {"sensitivity": "private"}), ("d", "k", "other nebula", {"user_id": "v"}),
                       ("e", "k", "agents nebulae", {"scope": "agent", "owner_agent_id": "a"}), ("f", "k", None, {"kind": "task"}))


def ranked(found, request):
    return [(r.memory_id, r.channels) for r in found.ranked.where(F.col("request_id") == request).orderBy("final_rank").collect()]


def test_stages(spark, some):
    asked = requests_of(spark, ("nebula", {}), ("nebulx", {}), ("green nebulx", {}), (None, {}), ("  ", {"kind": "task"}), ("zzzzzz", {}), ("green", {"include_private": True}), ("nebula", {"scope": "agent"}), ("green", {"key": "color"}), ("color", {"key": "color"}))
    found = recall.recall(asked, some)
    assert ranked(found, 0)[0] == ("b", "exact,full_text") and {m for m, _ in ranked(found, 0)} == {"a", "b", "e"}
    assert {m for m, _ in ranked(found, 1)} == {"a", "b"} and ranked(found, 2) == [("a", "full_text")]
    assert [m for m, _ in ranked(found, 3)] == ["f", "e", "b", "a"] and ranked(found, 4) == [("f", "list")]
    assert ranked(found, 5) == [] and [m for m, _ in ranked(found, 6)] in (["a", "c"], ["c", "a"]) and ranked(found, 7) == [("e", "full_text,structured")]
    # A key beside another query filters, but is no exact hit.
    assert ranked(found, 8) == [("a", "full_text,structured")] and ranked(found, 9) == [("a", "exact,full_text,structured")]
    stages = {r.request_id: (r.stage, r.lexical) for r in found.receipts.collect()}
    assert stages[0] == ("literal", 3) and stages[1] == ("spelling", 2) and stages[3] == ("list", 0) and stages[5] == ("none", 0)


def test_spelling_only_after_a_miss(spark, some):
    """A request that full text answers is not corrected, though a corrected word would find more."""
    found = recall.recall(requests_of(spark, ("nebulae", {}), ("nebula", {})), some)
    assert {m for m, _ in ranked(found, 0)} == {"e"} and {r.stage for r in found.receipts.collect()} == {"literal"}
    off = recall.recall(requests_of(spark, ("nebulx", {})), some, recall.RecallPolicy(spelling=False))
    assert off.ranked.count() == 0


def test_one_pass_over_texts(spark, tmp_path):
    """Lookups read no text; both lexical stages share one scan of it."""
    path = f"{tmp_path}/m"
    memories_of(spark, ("a", "k", "green nebula", {})).write.parquet(path)
    m = spark.read.parquet(path)
    asked = recall.prepared(requests_of(spark, ("green", {})), 5)
    scans = lambda df: re.findall(r"FileScan parquet \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    found = [s for df in (*recall.lookups(asked, m, F.broadcast), recall.listed(asked, m, F.broadcast)) for s in scans(df)]
    assert len(found) == 3 and not any("value#" in s for s in found)
    words = asked.select(F.explode("terms").alias("term"), F.lit(True).alias("worded"))
    assert ["value#" in s for s in scans(recall.text_hits(m, words))] == [True]


def test_terms_in_groups_and_without_an_automaton(spark, some, monkeypatch):
    words = spark.createDataFrame([("nebulx", True), ("green", True), ("aa", False), ("word", False), ("neb", False)], "term string, worded boolean")
    rows = lambda: sorted(tuple(r) for r in recall.text_hits(some, words).where("memory_id IS NOT NULL").select("memory_id", "term", "tf", F.coalesce("token", F.lit(False)), "fix", "edit").collect())
    total = lambda: recall.text_hits(some, words).where("memory_id IS NULL").agg(F.sum("tf"), F.sum("dl")).first()[:]
    want, sums = rows(), total()
    assert ("a", "nebulx", 0.0, False, "nebula", "substitute") in want and ("b", "neb", 1.0, False, None, None) in want and sums[0] == 6
    monkeypatch.setattr(recall, "MOST_TERMS", 2)
    assert rows() == want and total() == sums


@pytest.mark.parametrize("seed", range(3))
def test_edits_are_those_of_the_column(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        x = list(w)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(x)) if x else 0
            kind = rng.randrange(4)
            x[at:at + 1] = [[], [rng.choice("abc")], [*x[at:at + 1], rng.choice("abc")], x[at:at + 2][::-1]][kind]
        if x:
            pairs.append((w, "".join(x)))
    got = spark.createDataFrame(pairs, "q string, w string").select("q", "w", channels.one_edit(F.col("q"), F.col("w")).alias("e")).collect()
    assert all(recall.edit_between(r.q, r.w) == r.e for r in got)


def test_limits(spark, some):
    with pytest.raises(ValueError, match="candidate_limit"):
        recall.recall(requests_of(spark, ("x", {})), some, recall.RecallPolicy(candidate_limit=101))
    with pytest.raises(Exception, match="term budget"):
        recall.recall(requests_of(spark, (" ".join(f"t{i}" for i in range(33)), {})), some)
    assert recall.recall(requests_of(spark, ("x", {})).limit(0), some).ranked.count() == 0 and recall.recall(requests_of(spark, ("x", {})), some.limit(0)).ranked.count() == 0


def test_pages_join_to_one_list(spark):
    m = memories_of(spark, *[(f"m{i:02}", "same" if i % 3 else f"k{i}", f"word {'word ' * (i % 2)}", {"updated_at": i // 4}) for i in range(23)])
    asked = requests_of(spark, ("word", {}), ("same", {}), (None, {}))
    found = recall.recall(asked, m)
    whole = {r: [x.memory_id for x in found.ranked.where(F.col("request_id") == r).orderBy("final_rank").collect()] for r in range(3)}
    got, cursors, pages = {0: [], 1: [], 2: []}, dict.fromkeys(range(3)), 0
    while cursors:
        rows = [(r, c, 4) for r, c in cursors.items()]
        page = recall.page_of(found.ranked, asked.join(spark.createDataFrame(rows, "request_id long, cursor string, limit int"), "request_id")).orderBy("request_id", "page_rank").collect()
        for x in page:
            got[x.request_id].append(x.memory_id)
        cursors = {x.request_id: x.next_cursor for x in page if x.next_cursor}
        pages += 1
    assert got == whole and pages == 6
    mine = recall.page_of(found.ranked, asked.withColumn("cursor", F.lit(None).cast("string")).withColumn("limit", F.lit(2))).where("next_cursor IS NOT NULL").select("request_id", F.col("next_cursor").alias("cursor")).distinct()
    for other in (asked.withColumn("agent_id", F.lit("someone")), asked.withColumn("query", F.lit("else"))):
        with pytest.raises(Exception, match="Invalid retrieval pagination cursor"):
            recall.page_of(found.ranked, other.join(mine, "request_id")).collect()
    with pytest.raises(Exception, match="Invalid retrieval pagination cursor"):
        recall.page_of(found.ranked, asked.withColumn("cursor", F.lit("bm90IGpzb24"))).collect()


def test_record_pages(spark):
    rows = spark.createDataFrame([(1, 10**15 + i // 2, i) for i in range(7)], "request_id int, at long, id long")
    page = lambda cursor: ranking.record_page(rows, spark.createDataFrame([(1, 3, cursor, "f")], "request_id int, limit int, cursor string, fingerprint string"), "event", "at", "id").orderBy("page_rank").collect()
    one = page(None)
    two = page(one[0].next_cursor)
    three = page(two[0].next_cursor)
    assert [[r.id for r in p] for p in (one, two, three)] == [[6, 5, 4], [3, 2, 1], [0]] and three[0].next_cursor is None
    with pytest.raises(Exception, match="cursor_filter_mismatch"):
        ranking.record_page(rows, spark.createDataFrame([(1, 3, one[0].next_cursor, "g")], "request_id int, limit int, cursor string, fingerprint string"), "event", "at", "id").collect()


def test_history_is_the_writers(spark):
    """An agent's events are seen by the agent that wrote them, a private one by who includes private ones."""
    events = spark.createDataFrame([(i, i, "u", "k", False, a, s, t, p) for i, (a, s, t, p) in enumerate([("a", "agent", None, "public"), ("b", "agent", None, "public"), ("b", "user", None, "private"), ("b", "task", "t", "public"), ("b", "user", None, "public")])],
                                   "event_id long, event_seq long, user_id string, memory_key string, is_forget boolean, agent_id string, scope string, task_id string, sensitivity string")
    asked = spark.createDataFrame([(1, "u", "a", "t", False, None, 9, None), (2, "u", "b", "x", True, None, 9, None), (3, "v", "b", "t", True, None, 9, None), (4, "u", "a", "t", False, "other", 9, None)],
                                  "request_id int, user_id string, agent_id string, task_id string, include_private boolean, memory_key string, limit int, cursor string")
    got = Counter((r.request_id, r.event_id) for r in ledger.visible_history(asked, events).collect())
    assert got == Counter([(1, 0), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4)])


def vectors_of(memories, rows):
    return memories.sparkSession.createDataFrame([(m, f"e{m}", 1, "m1", v) for m, v in rows], "memory_id string, source_event_id string, version long, model string, embedding array<double>")


def test_vectors_that_may_be_seen(spark, some):
    held = vectors_of(some, [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0, 0.1]), ("d", [1.0, 0.0]), ("e", [0.0, 1.0]), ("f", None)])
    asked = requests_of(spark, ("x", {}), ("x", {"include_private": True}), ("x", {"user_id": "v"}), ("x", {"agent_id": "z"}), ("x", {"kind": "task"}), ("x", {"user_id": "nobody"})).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    rows = dense.authorised_top_k(asked, dense.indexed(some, held, "m1"), 2, 0.9).collect()
    got = {r: [(x.memory_id, x.population, x.above) for x in sorted(rows, key=lambda x: x["rank"]) if x.request_id == r] for r in range(6)}
    assert got == {0: [("a", 3, 1), ("b", 3, 1)], 1: [("a", 4, 2), ("c", 4, 2)], 2: [("d", 1, 1)], 3: [("a", 2, 1), ("b", 2, 1)], 4: [], 5: []}


def test_what_is_no_vector(spark):
    """Null, zero, infinite and shorter vectors are in no list and no count, as queries too."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.5, None]), (7, [2.0, 0.1])], "vec_id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(100, [1.0, 0.0]), (101, None), (102, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = dense.top_k(q, v, 9).collect()
    assert [(r.query_id, r.vec_id, r.population) for r in sorted(got, key=lambda r: r["rank"])] == [(100, 1, 2), (100, 7, 2)]
    assert dense.top_k(q.where("query_id = 101"), v, 9).count() == 0 and dense.top_k(q, v.limit(0), 9).count() == 0


@pytest.mark.parametrize("blocks", [(16_384, 1024, 1 << 21), (6, 2, 8)])
def test_top_k_against_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("GROUP_QUERIES", "BLOCK_QUERIES", "PRODUCT"), blocks, strict=True):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)), np.ones((20, 4))])
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.population) for r in dense.top_k(v.where("vec_id % 8 = 0").withColumnRenamed("vec_id", "query_id"), v, 7).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(0, 80, 8):
        s = np.round(np.clip(unit[i] @ unit.T, -1, 1), 6)
        best = sorted((j for j in range(80) if j != i), key=lambda j: (-s[j], -j))[:7]
        want |= {(i, k + 1): (j, 79) for k, j in enumerate(best)}
    assert got == want


def test_rows_out_of_tasks_do_not_grow_with_vectors(spark):
    """What leaves the map side is queries x (k + 1) a task, whatever a task holds."""
    def passed(n):
        v = spark.range(n).select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("time"), F.array(F.rand(1), F.rand(2)).alias("embedding")).repartition(2)
        q = v.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
        return dense._in_groups(q, v, 5, 0.0, "query_id", "vec_id", False).count()

    assert passed(2_000) == passed(30_000) == 2 * 9 * 6


def test_dense_stage(spark, some):
    held = vectors_of(some, [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("e", [0.0, 1.0]), ("f", [0.0, -1.0]), ("c", [1.0, 0.0])])
    queries = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(5)], "request_id long, embedding array<double>")
    index = recall.VectorIndex(held, queries, "m1")
    asked = requests_of(spark, ("nebula", {}), ("zzz", {}), ("zzz", {"user_id": "v"}), (None, {}), ("zzz", {"include_private": True, "kind": "fact"}))
    policy = recall.RecallPolicy(min_score=0.5, min_margin=0.1)
    found = recall.recall(asked, some, policy, index)
    reasons = {r.request_id: r.dense_reason for r in found.receipts.collect()}
    # Request 2 sees d, which has no vector; request 4 sees c, which is as near as a.
    assert reasons == {0: "lexical_preserved", 1: "admitted", 2: "index_incomplete", 3: None, 4: "ambiguous_candidates"} and ranked(found, 1) == [("a", "dense")]
    both = recall.recall(asked, some, recall.RecallPolicy(min_score=0.5, dense_mode="hybrid"), index)
    assert {m: c for m, c in ranked(both, 0)} == {"a": "dense,full_text", "b": "dense,exact,full_text", "e": "full_text"}


def test_changed_index_counts_for_nothing(spark, some):
    held = vectors_of(some, [(m, [1.0, float(i)]) for i, m in enumerate("abcdef")])
    asked = recall.prepared(requests_of(spark, ("zzz", {})), 5).withColumn("lexical_matches", F.lit(0)).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    for now, reason, n in ((held, "admitted", 1), (held.withColumn("version", F.when(F.col("memory_id") == "d", 2).otherwise(1)), "index_changed", 0)):
        hits, why = dense.retrieve(asked, some, held, "m1", now=now)
        assert why.first().reason == reason and hits.count() == n

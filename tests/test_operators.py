"""Small cases with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from memloom.functions import jsontext
from memloom.operators import capture, channels, context, dense, eligibility, facts, ledger, metrics, query, ranking, recall
from memloom.sources import ledger_files


def hits(spark, **lists):
    rows = [(1, ch, i + 1, m, 100, 10) for ch, ms in lists.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "request_id int, channel string, channel_rank int, memory_id string, updated_at long, limit int")


def order(df, by):
    return [r.memory_id for r in df.orderBy(by).collect()]


def test_exact_tier_first(spark):
    assert set(order(ranking.fuse(hits(spark, exact=["user", "task"], full_text=["text"])), "final_rank")[:2]) == {"user", "task"}


def test_corroboration_beats_one_list(spark):
    assert order(ranking.fuse(hits(spark, exact=["c"], full_text=["newer", "other", "c"]), tier=False), "final_rank")[0] == "c"


def test_filters_are_no_evidence(spark):
    assert ranking.fuse(hits(spark, structured=["s"])).count() == 0
    assert ranking.fuse_legacy(hits(spark, structured=["s"])).count() == 1


def test_integrity(spark):
    assert ranking.batch_violations(hits(spark, exact=["a", "b"])).count() == 0
    assert ranking.batch_violations(hits(spark, exact=["a", "a"])).count() == 1


@pytest.mark.parametrize(("asked", "word", "edit"), [("nebulra", "nebula", "delete"), ("nebul", "nebula", "insert"), ("nebulx", "nebula", None), ("nebulz", "nebulx", "substitute"), ("concsie", "concise", "transpose"), ("same", "same", None), ("abcde", "abdcf", None)])
def test_one_edit(spark, asked, word, edit):
    want = "substitute" if (asked, word) == ("nebulx", "nebula") else edit
    assert spark.createDataFrame([(asked, word)], "q string, w string").select(channels.one_edit(F.col("q"), F.col("w")).alias("e")).first().e == want


def test_trigrams(spark):
    assert spark.createDataFrame([("aaaa",), ("ab",), ("abcd",)], "t string").select(channels.trigrams(F.col("t")).alias("g")).collect() == [(["aaa"],), ([],), (["abc", "bcd"],)]


def fact_rows(spark, rows, version=1):
    """(memory, value, valid_from, valid_until, the memory or memories that it replaces)."""
    listed = lambda r: [(m, f"e-{m}", version) for m in ((r,) if isinstance(r, str) else r or ())]
    return spark.createDataFrame([("u", "user", "-", "user_fact", "g", *r[:4], f"e-{r[0]}", 1, listed(r[4])) for r in rows], "user_id string, scope string, scope_identity string, kind string, fact_group string, memory_id string, fact_value string, "
                                 "valid_from int, valid_until int, source_event_id string, version int, replaces array<struct<memory_id:string,source_event_id:string,version:int>>")


@pytest.mark.parametrize(("rows", "status"), [
    ([("old", "1", None, None, None), ("new", "2", None, None, "old")], {"old": "superseded", "new": "active_assertion"}),
    ([("a", "1", None, None, None), ("b", "2", None, None, None)], {"a": "conflict", "b": "conflict"}),
    ([("a", "1", None, None, None), ("b", "1", None, None, None)], {"a": "consistent_assertions", "b": "consistent_assertions"}),
    ([("a", "1", None, None, "b"), ("b", "2", None, None, "a")], {"a": "unresolved", "b": "unresolved"}),
    ([("a", "1", None, None, "gone"), ("b", "2", None, 20200101, None)], {"a": "unresolved", "b": "expired"}),
    ([("a", "1", 20990101, None, None), ("b", "2", None, None, "a")], {"a": "not_yet_valid", "b": "active_assertion"}),
])
def test_adjudication(spark, rows, status):
    assert {r.memory_id: r.status for r in facts.adjudicate(fact_rows(spark, rows), F.lit(20240601)).collect()} == status


def test_references_to_old_versions(spark):
    rows = [("old", "1", None, None, None), ("new", "2", None, None, "old")]
    assert {r.status for r in facts.adjudicate(fact_rows(spark, rows, 2), F.lit(20240601)).collect()} == {"unresolved"}


@pytest.mark.parametrize("edges", [20_000, 0])
def test_cycles_by_peeling(spark, monkeypatch, edges):
    """Chains, diamonds and repeated rows are no cycles; two cycles in a partition are one answer. With and without a task for a whole group."""
    monkeypatch.setattr(facts, "GROUP_EDGES", edges)
    row = lambda m, *to: (m, "1", None, None, to)
    cyclic = lambda rows: facts.cyclic_groups(facts.references(fact_rows(spark, rows), F.lit(20240601))).count()
    n = 300 if edges else 8
    chain = [row(f"m{i}", *([f"m{i - 1}"] if i else [])) for i in range(n)]
    assert cyclic(chain) == 0 and cyclic([row("m0", f"m{n - 1}"), *chain[1:]]) == 1
    diamond = [row("top", "left", "right"), row("left", "end"), row("right", "end"), row("end")]
    assert cyclic(diamond * 3) == 0 and cyclic([*diamond[:3], row("end", "top")]) == 1
    assert cyclic([row("a", "b"), row("b", "a"), row("c", "d", "a"), row("d", "c"), row("e")] * 2) == 1 and cyclic([row("self", "self")]) == 1


def test_edges_only_get_fewer(spark, monkeypatch):
    """Twelve facts that each name all earlier ones: no round holds more than their 66 references."""
    monkeypatch.setattr(facts, "GROUP_EDGES", 0)
    sizes, keep = [], facts.stored
    monkeypatch.setattr(facts, "stored", lambda df, what: (out := keep(df, what), sizes.append((what, out.count())))[0])
    rows = [(f"m{i}", "1", None, None, [f"m{j}" for j in range(i)]) for i in range(12)]
    assert facts.cyclic_groups(facts.references(fact_rows(spark, rows), F.lit(20240601))).count() == 0
    rounds = [n for what, n in sizes if what == "peeled"]
    assert rounds[0] == 66 and rounds == sorted(rounds, reverse=True) and rounds[-1] == 0


def test_several_references(spark):
    status = lambda rows: {r.memory_id: r.status for r in facts.adjudicate(fact_rows(spark, rows), F.lit(20240601)).collect()}
    assert status([("a", "1", None, None, None), ("b", "2", None, None, None), ("c", "3", None, None, ("a", "b"))]) == {"a": "superseded", "b": "superseded", "c": "active_assertion"}
    assert status([("a", "1", None, None, None), ("c", "3", None, None, ("a", "gone"))]) == {"a": "unresolved", "c": "unresolved"}
    with pytest.raises(Exception, match="more than 16"):
        status([("a", "1", None, None, [f"m{i}" for i in range(17)])])


def group_of(spark, rows):
    """(memory, value, private, updated_at) of one group."""
    base = fact_rows(spark, [(m, v, None, None, None) for m, v, _, _ in rows])
    more = spark.createDataFrame([(m, "private" if p else "public", True, t) for m, _, p, t in rows], "memory_id string, sensitivity string, user_confirmed boolean, updated_at long")
    return base.join(more, "memory_id")


def test_facts_of_a_ranked_list(spark):
    ranked = spark.createDataFrame([(r, m, i + 1) for r in (1, 2) for i, m in enumerate(("x", "plain"))], "request_id int, memory_id string, final_rank int")
    asked = spark.createDataFrame([(1, False, False), (2, True, False)], "request_id int, include_private boolean, require_confirmed boolean")
    found = lambda rows, limit: {(r.request_id, r.memory_id): (r.status, r.coverage, r.accepted_rank) for r in facts.resolve(ranked, group_of(spark, rows), asked, F.lit(20240601), limit).collect()}
    hidden = [("x", "1", False, 1), ("y", "2", True, 2)]
    # A private sibling makes a conflict only for the request that includes it.
    assert found(hidden, 5) == {(1, "x"): ("active_assertion", "visible_filtered_group", 1), (1, "plain"): ("unannotated", "not_applicable", 2),
                                (2, "x"): ("conflict", "visible_filtered_group", None), (2, "plain"): ("unannotated", "not_applicable", 1)}
    many = [("x", "1", False, 1), *[(f"z{i}", "1", False, 2 + i) for i in range(4)]]
    assert found(many, 5)[(1, "x")] == ("consistent_assertions", "visible_filtered_group", 1)
    assert found(many, 4)[(1, "x")] == ("unresolved", "truncated", None)
    left = facts.review(facts.resolve(ranked, group_of(spark, many), asked, F.lit(20240601), 4)).where("request_id = 1").first()
    assert left.accepted == 1 and [tuple(x) for x in left.omitted] == [("x", "group_budget")]


def test_large_groups_are_cut_before_the_shuffle(spark):
    """Of a group of many members, each task passes on limit + 1."""
    rows = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("memory_id"), F.lit("u").alias("user_id"), F.lit("user").alias("scope"), F.lit("-").alias("scope_identity"), F.lit("k").alias("kind"), F.lit("g").alias("fact_group"), F.lit("1").alias("fact_value"),
                                      F.lit(None).cast("int").alias("valid_from"), F.lit(None).cast("int").alias("valid_until"), F.lit("e").alias("source_event_id"), F.lit(1).alias("version"),
                                      F.array().cast("array<struct<memory_id:string,source_event_id:string,version:int>>").alias("replaces"), F.lit("public").alias("sensitivity"), F.lit(True).alias("user_confirmed"), F.col("id").alias("updated_at"))
    ranked = spark.createDataFrame([(1, "m7", 1)], "request_id int, memory_id string, final_rank int")
    asked = spark.createDataFrame([(1, False, False)], "request_id int, include_private boolean, require_confirmed boolean")
    kept = []
    keep = facts.stored
    facts.stored = lambda df, what: (kept.append((what, df._jdf.queryExecution().executedPlan().toString())), keep(df, what))[1]
    try:
        assert facts.resolve(ranked, rows, asked, F.lit(20240601), 10).first().reason == "group_budget"
    finally:
        facts.stored = keep
    plan = next(p for what, p in kept if what == "members")
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan


def memory_rows(spark, rows):
    return spark.createDataFrame([(m, u, "user", None, None, k, v, s, True, i) for i, (m, u, k, v, s) in enumerate(rows)],
                                 "memory_id string, user_id string, scope string, owner_agent_id string, task_id string, memory_key string, value string, sensitivity string, user_confirmed boolean, updated_at long")


def request_rows(spark, *rows):
    return spark.createDataFrame([(i, u, "a", "t", False, False, q, n) for i, (u, q, n) in enumerate(rows)], "request_id long, user_id string, agent_id string, task_id string, include_private boolean, require_confirmed boolean, query string, limit int")


def test_spelling_sees_visible_words_alone(spark):
    m = memory_rows(spark, [("a", "u1", "k", "green nebula", "public"), ("b", "u1", "k", "secretword", "private"), ("c", "u2", "k", "secretword", "public"), ("d", "u1", "k", "nebula alone", "public"), ("e", "u1", "k", "nebulas literal", "public")]).withColumn("kind", F.lit("fact"))
    r = request_rows(spark, ("u1", "nebulx", 5), ("u1", "secretwird", 5), ("u1", "green nebulx", 5), ("u1", "greem nebulx", 5), ("u1", "nebula", 5), ("u2", "secretwird", 5))
    got = {(x.request_id, x.memory_id, x.query_token, x.matched_token) for x in recall.spelling(r, m).collect()}
    assert got == {(0, "a", "nebulx", "nebula"), (0, "d", "nebulx", "nebula"), (2, "a", "nebulx", "nebula"), (5, "c", "secretwird", "secretword")}


def test_terms_without_an_automaton(spark, monkeypatch):
    m = memory_rows(spark, [("a", "u", "Key", "aaaa b.c", "public"), ("b", "u", "k", "xaay", "public"), ("c", "u", "", None, "public")]).withColumn("kind", F.lit("fact"))
    terms = spark.createDataFrame([("aa",), ("aaa",), ("b.c",), ("y",), ("key",)], "term string").withColumn("worded", F.lit(False))
    rows = lambda: {(r.memory_id, r.term, r.tf) for r in recall.text_hits(m, terms).where("memory_id IS NOT NULL").collect()}
    want = rows()
    assert want == {("a", "aa", 3.0), ("a", "aaa", 2.0), ("a", "b.c", 1.0), ("a", "y", 1.0), ("a", "key", 1.0), ("b", "aa", 1.0), ("b", "y", 1.0)}
    monkeypatch.setattr(recall, "ahocorasick", None)
    assert rows() == want


def test_limits_over_the_largest_raise(spark):
    m = memory_rows(spark, [("a", "u", "k", "v", "public")])
    with pytest.raises(Exception, match="a limit is over 100"):
        channels.substring(request_rows(spark, ("u", "v", 101)), m).collect()


def packing(spark, rows, budget, most):
    return spark.createDataFrame([(1, i + 1, m, line, True, budget, most, ob) for i, (m, line, ob) in enumerate(rows)], "request_id long, select_rank int, memory_id string, line string, usable boolean, token_budget int, max_memories int, obligations array<string>")


def test_oversized_is_skipped(spark):
    got = {r.memory_id: r.reason for r in context.pack(packing(spark, [("huge", "x" * 5000, []), ("b", "y" * 40, [])], 256, 1)).collect()}
    assert got == {"huge": "token_budget", "b": "packed"}


def test_joined_text_is_budgeted(spark):
    got = context.pack(packing(spark, [("a", "x" * 4, []), ("b", "x" * 4, []), ("c", "x" * 3, [])], 2, 9)).orderBy("select_rank").collect()
    assert [r.reason for r in got] == ["packed", "token_budget", "packed"] and got[2].used_tokens == 2


def test_coverage_packing(spark):
    rows = [("a1", "x", ["a"]), ("a2", "x", ["a"]), ("b", "x", ["b"])]
    got = {r.memory_id: r.reason for r in context.pack_for_coverage(packing(spark, rows, 100, 2)).collect()}
    assert got == {"a1": "packed", "b": "packed", "a2": "max_memories"}
    shared = {r.memory_id: r.reason for r in context.pack_for_coverage(packing(spark, [*rows, ("s", "x", ["a", "b"])], 100, 1)).collect()}
    assert shared["s"] == "packed"


def test_unscored_means_input_order(spark):
    rows = [(1, i, m, 0, s, "coding", k, "user", False, 5) for i, m, s, k in ((1, "first", 0.01, "user_fact"), (2, "second", None, "task_state"))]
    schema = "request_id int, input_rank int, memory_id string, exact_tier int, score double, purpose string, kind string, scope string, user_confirmed boolean, updated_at long"
    assert order(context.selection_order(spark.createDataFrame(rows, schema), "relevance_first"), "select_rank") == ["first", "second"]
    tie = [(1, i, m, 0, 0.02, "coding", k, "user", False, u) for i, m, k, u in ((1, "fact", "user_fact", 9), (2, "task", "task_state", 5))]
    assert order(context.selection_order(spark.createDataFrame(tie, schema), "relevance_first"), "select_rank") == ["task", "fact"]


def test_merge():
    assert jsontext.merge_objects({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"x": None}, "l": [2]}) == {"a": {"x": None, "y": 2}, "l": [2]}
    assert jsontext.lexical({"k": ["v", 1, True], "n": {"z": "a\0b"}}) == "k\nv\n1\ntrue\nn\nz\na b"
    assert jsontext.redact_keys({"api_key": "x", "n": [{"password": 1, "ok": 2}]}) == {"api_key": "<redacted:credential>", "n": [{"password": "<redacted:credential>", "ok": 2}]}


def test_registered_function(spark):
    jsontext.register(spark)
    assert spark.sql("SELECT lexical_text('{\"a\":[1,\"b\"]}') AS t").first().t == "a\n1\nb"


def test_command_fold(spark):
    c = [(1, 1, 1, "remember", '{"a":1}', "replace", 0, "k"), (1, 1, 2, "remember", '{"b":2}', "merge", 1, None), (1, 1, 3, "remember", '{"a":1}', "replace", 0, "k"), (1, 1, 4, "remember", '{"c":3}', "replace", 1, None),
         (1, 1, 5, "remember", '{"x":1}', "replace", None, "k"), (1, 1, 6, "forget", None, None, None, None), (1, 1, 7, "forget", None, None, None, None), (1, 1, 8, "remember", "1", "merge", 0, None), (1, 1, 9, "remember", '{"a":1}', "merge", None, None)]
    got = ledger.apply_commands(spark.createDataFrame(c, "user_id long, memory_key long, event_seq long, op string, value string, mode string, expected_version long, idempotency_key string")).orderBy("event_seq").collect()
    assert [r.status for r in got] == ["created", "merged", "replayed", "version_conflict", "idempotency_conflict", "forgotten", "not_found", "created", "not_mergeable"]
    assert got[1].version == 2 and json.loads(got[1].value) == {"a": 1, "b": 2} and got[2].version == 1


def event_rows(spark):
    rows = [(i, i, u, k, f, "click", float(i), f"k{i}") for i, (u, k, f) in enumerate([(1, 1, False), (1, 1, False), (1, 1, True), (1, 1, True), (1, 1, False), (2, 1, True), (2, 2, False)])]
    return spark.createDataFrame(rows, ledger_files.EVENT_SCHEMA)


def test_lifetimes(spark):
    got = {r.event_id: (r.lifetime, r.version, r.action) for r in ledger.versions(event_rows(spark)).collect()}
    assert got == {0: (0, 1, "created"), 1: (0, 2, "replaced"), 2: (0, 2, "forgotten"), 4: (1, 1, "created"), 6: (0, 1, "created")}


def test_package_round_trip(spark, tmp_path):
    ledger_files.export_package(event_rows(spark), f"{tmp_path}/p")
    assert ledger_files.import_package(spark, f"{tmp_path}/p").exceptAll(event_rows(spark)).count() == 0
    assert {r.user_id for r in ledger_files.import_package(spark, f"{tmp_path}/p", 9).collect()} == {9}
    event_rows(spark).limit(2).selectExpr("to_json(struct(*)) AS value").write.mode("append").text(f"{tmp_path}/p/events")
    with pytest.raises(ledger_files.PackageError):
        ledger_files.import_package(spark, f"{tmp_path}/p")


def test_json_ledgers(spark, tmp_path):
    event = {"event_id": 1, "event_seq": 1, "user_id": 1, "memory_key": 1, "is_forget": False, "kind": "k", "value": 1.0, "idempotency_key": "x"}
    for name, data in (("v1", {"events": [event]}), ("v2", {"schemaVersion": 2, "eventsV2": [event, event]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert [ledger_files.read_ledger(spark, f"{tmp_path}/{n}.json").count() for n in ("v1", "v2")] == [1, 2]


def test_redaction(spark):
    text, found = capture.redact(F.col("t"))
    row = spark.createDataFrame([("token: abc, mail a@b.org or +49 170 1234567",)], "t string").select(text.alias("t"), *[c.alias(k) for k, c in found.items()]).first()
    assert row.t == "<redacted:credential>, mail <redacted:email> or <redacted:phone>" and row.credential and row.email and row.phone and not row.secret


def test_extraction(spark):
    rows = [(1, 0, "user_message", "我偏好先给结论，再列出验证结果。", "complete"), (1, 1, "user_message", "Please remember that I prefer tea.", "partial"), (1, 2, "assistant_message", "I prefer x y", "complete")]
    got = {(r.ordinal, r.kind, r.value, r.confidence) for r in capture.candidates(spark.createDataFrame(rows, "thread_id int, ordinal int, item_type string, text string, quality string")).collect()}
    assert got == {(0, "user_preference", "先给结论，再列出验证结果", 0.92), (1, "user_fact", "that I prefer tea", 0.6), (1, "user_preference", "tea", 0.6)}


def test_similarity(spark):
    a = spark.createDataFrame([("1", "k", "prefer green tea"), ("2", "k", "!!")], "id string, kind string, value string")
    b = spark.createDataFrame([("x", "k", "Prefer green-tea!"), ("y", "k", "prefer black coffee"), ("z", "j", "prefer green tea")], "id string, kind string, value string")
    assert [(r.left_id, r.right_id, r.similarity) for r in capture.similar_pairs(a, b).collect()] == [("1", "x", 1.0)]
    assert spark.createDataFrame([("ＡＢ c",)], "t string").select(capture.comparable(F.col("t"), fold=True).alias("t")).first().t == "abc"


def test_plan(spark):
    rows = [("1", "compare a and b; c", None, "auto", False), ("2", "history", None, "auto", False), ("3", "x and y", None, "direct", True), ("4", "root cause of z", None, "auto", False), ("5", "q", "key", "auto", False)]
    got = {r.request_id: r for r in query.plan(spark.createDataFrame(rows, "request_id string, query string, key string, strategy string, include_history boolean"), 2).collect()}
    assert got["1"].queries == ["compare a", "b"] and got["1"].capped and got["1"].complexity == "L2"
    assert got["2"].queries == ["history"] and got["2"].history and got["3"].queries == ["x"] and not got["3"].history
    assert got["4"].complexity == "L3" and got["4"].queries == ["of z"] and got["5"].complexity == "L0" and got["5"].strategy_used == "direct"


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 2)
    v = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(6)], "vec_id long, embedding array<double>").repartition(3)
    got = dense.top_k(v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), v, 2, 0.9).collect()
    assert len(got) == 10 and {r.population for r in got} == {5} and {r.vec_id for r in got if r.query_id == 0 and r["rank"] == 1} == {1}


def test_access_and_paths(spark):
    r = spark.createDataFrame([(1, "http", None, "a", False), (2, "mcp", None, "b", False), (3, "mcp", None, "a", True), (4, "http", "k", "a", False)], "id int, transport string, api_key string, agent_id string, include_private boolean")
    assert [x.outcome for x in eligibility.access_outcome(r, "k", ["a"], False).orderBy("id").collect()] == ["UNAUTHORIZED", "FORBIDDEN_AGENT", "FORBIDDEN_PRIVATE", "allowed"]
    p = spark.createDataFrame([("/a/b", "/a/"), ("/ab", "/a"), ("/a", "/a")], "p string, a string")
    assert [x.ok for x in p.select(eligibility.workspace_allowed(F.col("p"), F.col("a")).alias("ok")).collect()] == [True, False, True]


def test_nearest_rank(spark):
    got = metrics.latency_summary(spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double"), ["k"], "v").first()
    assert (got.p50, got.p95, got.most) == (5.0, 10.0, 10.0)


def test_large_request_batches_shuffle(spark, monkeypatch):
    monkeypatch.setattr(eligibility, "MOST_BROADCAST_REQUESTS", 1)
    from memloom.plans import retrieval_queries as rq

    sf = "/root/testdata/sf0.001"
    few = {tuple(r) for r in rq.whole_query_substring(spark, sf).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in rq.whole_query_substring(spark, sf).collect()}


def test_violations(spark):
    from memloom.operators import validation

    rows = [("ok", "user_fact", "user", "public", "k", None, None, 1), ("bad", "x", "task", "public", " ", None, "a", 0)]
    df = spark.createDataFrame(rows, "memory_id string, kind string, scope string, sensitivity string, memory_key string, task_id string, owner_agent_id string, version int")
    got = {(r.key, r.path, r.code) for r in validation.violations(df, "memory_id", validation.memory_rules()).collect()}
    assert got == {("bad", "kind", "not_allowed"), ("bad", "memory_key", "empty"), ("bad", "task_id", "scope_mismatch"), ("bad", "owner_agent_id", "scope_mismatch"), ("bad", "version", "not_positive")}
    r = spark.createDataFrame([(1, "k", "k", None, None), (2, None, "q", "user_fact", None), (3, "k", " ", None, None)], "request_id int, key string, query string, kind string, scope string")
    assert {(x.request_id, x.channel, x.reason) for x in validation.channel_skips(r).collect()} == {(3, "full_text", "empty_query")}


def test_transcripts(spark, tmp_path):
    from memloom.sources import transcripts

    line = lambda t, u, text, **more: json.dumps({"type": t, "sessionId": "s", "uuid": u, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": t, "content": text}, **more})
    (tmp_path / "a.jsonl").write_text("\n".join([line("user", "1", "hi"), line("user", "1", "hi"), line("assistant", "2", "yo"), line("user", "3", "x", isMeta=True), line("user", "4", "<system-reminder> y"), "{broken"]))
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert lines.where("damaged").count() == 1
    assert sorted((r.role, r.text) for r in transcripts.latest_items(transcripts.items(lines)).collect()) == [("assistant", "yo"), ("user", "hi")]
    rows = spark.createDataFrame([("t", "1", "completed", 0, "userMessage"), ("t", "1", "completed", 1, "agentMessage"), ("t", "2", "completed", 0, "userMessage"), ("t", "3", "interrupted", 0, "userMessage")], "thread_id string, turn_id string, turn_status string, ordinal int, item_type string")
    assert {r.turn_id: r.quality for r in transcripts.app_turns(rows).collect()} == {"1": "complete", "2": "partial", "3": "interrupted"}


def test_service(spark):
    from memloom.plans import recall_queries as rq
    from memloom.plans.fixtures import FACT_DAY, facts, ledger_events
    from memloom.service import MemoryService, Policy

    sf = "/root/testdata/sf0.001"
    r = rq.recall_requests(spark, sf).withColumns({"strategy": F.lit("auto"), "include_history": F.lit(False), "purpose": F.lit("general"), "token_budget": F.lit(512), "max_memories": F.lit(4), "limit": F.lit(2)})
    s = MemoryService(rq.recall_memories(spark, sf), ledger_events(spark, sf), Policy(fact_group_limit=2), facts(spark, sf), rq.index(spark, sf))
    day = F.lit(FACT_DAY)
    assert s.recall(r, day).count() > 0 and {"packed", "fact_unresolved"} <= {x.reason for x in s.context(r, day).collect()} and s.page(r, day).where("page_rank > 2").count() == 0
    assert s.query(r.where("query IS NOT NULL"), day).count() > 0
    targets = spark.createDataFrame([(1, 1, 1, "k")], "user_id long, memory_key long, event_seq long, idempotency_key string")
    assert s.forget(targets).count() == 1
    asked = spark.createDataFrame([(1, 1, "a1", "t1", True, None, 3, None)], "request_id long, user_id long, agent_id string, task_id string, include_private boolean, memory_key long, limit int, cursor string")
    assert s.history(asked).count() == 3


def test_injection(spark):
    from memloom.operators import injection

    prompts = [("讨论 HAPPY_TOPIC.7 时应该使用什么短语？", "HAPPY_TOPIC.7"), ("please follow the green style, then stop", "the green style"), ("plain question", "plain question"), ("using x. now", "using x. now")]
    got = spark.createDataFrame(prompts, "p string, want string").select("want", injection.injection_query(F.col("p")).alias("q")).collect()
    assert [r.q for r in got] == [r.want for r in got]
    rows = [(1, "p", True, True, "a<b", False, 5, 10, "2024-01-01"), (2, "p", False, True, "x", False, 5, 10, "bad"), (3, "p", True, True, "x", False, 50, 10, "2024-01-03"), (4, " ", True, True, "x", False, 5, 10, "2024-01-04"), (5, "p", True, True, "", True, 5, 10, "2024-01-05")]
    out = injection.outcomes(spark.createDataFrame(rows, "request_id int, prompt string, enabled boolean, workspace_allowed boolean, context string, failed boolean, millis int, most_millis int, created_at string"))
    assert [r.outcome for r in out.orderBy("request_id").collect()] == ["injected", "disabled", "timeout", "skipped", "failed"]
    assert "a&lt;b" in out.where("request_id = 1").first().envelope
    log = injection.receipts(out)
    assert {r.request_id for r in injection.retain_receipts(log, F.lit("2024-01-02").cast("timestamp"), 2).collect()} == {4, 5} and injection.receipt_status(log).first().malformed == 1

"""Queries over the ledger, facts, context packs and query plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.shared import checkpoint_dir, stored
from memloom.operators import answer, context, facts, ledger, query, ranking
from memloom.plans import retrieval_queries as rq
from memloom.plans.fixtures import EVENTS, FACT_DAY, FACTS, MEMORIES, ledger_events, memories, requests, table
from memloom.plans.fixtures import facts as fact_rows
from memloom.streaming.ledger_stream import latest_state, run_available


def _ledger(spark, sf_dir):
    return ledger_events(spark, sf_dir)


def ledger_versions(spark, sf_dir):
    return ledger.versions(_ledger(spark, sf_dir)).select("event_id", "user_id", "memory_key", "lifetime", "version", "memory_id", F.coalesce("supersedes_event", F.lit(-1)).alias("supersedes_event"), "action")


def ledger_current(spark, sf_dir):
    return ledger.current(_ledger(spark, sf_dir)).select("user_id", "memory_key", "memory_id", "event_id", "version", "kind", "value")


def ledger_tombstones(spark, sf_dir):
    return ledger.versions(_ledger(spark, sf_dir)).where("is_forget").groupBy("user_id").agg(F.count("*").alias("forgotten"), F.max("version").alias("most_versions"))


def idempotent_outcomes(spark, sf_dir):
    return ledger.idempotency(_ledger(spark, sf_dir)).select("event_id", "first_event", "outcome")


def cas_conflicts(spark, sf_dir):
    e = _ledger(spark, sf_dir).withColumn("expected_version", (F.col("event_id") % 3).cast("bigint"))
    return ledger.cas_outcomes(e).select("event_id", "expected_version", F.col("actual_version").cast("bigint").alias("actual_version"), "conflict")


def history_visible(spark, sf_dir):
    """Two pages of what one request a user may see, the second from the first one's cursor; every third asks for one key."""
    e = _ledger(spark, sf_dir)
    u = F.col("user_id")
    asked = e.select("user_id").distinct().select(u.alias("request_id"), "user_id", F.concat(F.lit("a"), u % 3).alias("agent_id"), F.concat(F.lit("t"), u % 7).alias("task_id"), (u % 2 == 0).alias("include_private"), F.when(u % 3 == 0, u % 10).alias("memory_key"), F.lit(3).alias("limit"))
    # A few rows a request; the second page reads them again.
    first = stored(ledger.visible_history(asked.withColumn("cursor", F.lit(None).cast("string")), e), "page")
    again = asked.join(first.where("next_cursor IS NOT NULL").select("request_id", F.col("next_cursor").alias("cursor")).distinct(), "request_id")
    page = lambda df, n: df.select("request_id", F.lit(n).alias("page"), "event_id", "page_rank", F.col("next_cursor").isNotNull().alias("more"))
    return page(first, 1).unionAll(page(ledger.visible_history(again, e), 2))


def history_quota(spark, sf_dir):
    cur = ledger.current(_ledger(spark, sf_dir))
    targets = cur.select(F.col("user_id").alias("request_id"), (F.col("memory_key") + 1).alias("target_rank"), "user_id", "memory_key")
    return ledger.history_quota(targets, _ledger(spark, sf_dir), 10).select("request_id", "target_rank", "event_id", F.col("quota").cast("bigint").alias("quota"), "rn")


def command_fold(spark, sf_dir):
    e = _ledger(spark, sf_dir)
    commands = e.select("user_id", "memory_key", "event_seq", "event_id", F.when(F.col("is_forget"), "forget").otherwise("remember").alias("op"), F.to_json(F.struct(F.col("kind"), F.struct(F.col("value").alias("v")).alias("n"))).alias("value"),
                        F.when(F.col("event_id") % 2 == 0, "merge").otherwise("replace").alias("mode"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 3).cast("bigint")).alias("expected_version"), "idempotency_key")
    return ledger.apply_commands(commands)


def stream_ledger_equals_batch(spark, sf_dir):
    from uuid import uuid4

    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = source.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_seq"), "user_id", (k % 10).alias("memory_key"), (F.col("event_type") == "error").alias("is_forget"), F.col("event_type").alias("kind"), "value")
    return run_available(spark, rows, f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid4().hex}").select("user_id", "memory_key", "event_id", "is_forget", "kind", "value")


def batch_latest(spark, sf_dir):
    return latest_state(_ledger(spark, sf_dir)).select("user_id", "memory_key", "event_id", "is_forget", "kind", "value")


def fact_temporal_status(spark, sf_dir):
    return fact_rows(spark, sf_dir).select("memory_id", F.coalesce(facts.temporal(F.col("valid_from"), F.col("valid_until"), F.lit(FACT_DAY)), F.lit("active")).alias("status"))


def fact_refs(spark, sf_dir):
    return facts.references(fact_rows(spark, sf_dir), F.lit(FACT_DAY)).select("memory_id", "replaces", "resolved")


def fact_adjudication(spark, sf_dir):
    return facts.adjudicate(fact_rows(spark, sf_dir), F.lit(FACT_DAY)).select("memory_id", "status", "usable", "reason")


def fact_group_budget(spark, sf_dir):
    return facts.over_budget_groups(fact_rows(spark, sf_dir), 3).groupBy("truncated").agg(F.count("*").alias("groups"), F.sum("members").alias("members"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def _candidates(spark, sf_dir):
    ranked = ranking.fuse(rq.channel_hits(spark, sf_dir))
    m = memories(spark, sf_dir).select("memory_id", "memory_key", "kind", "scope", "user_confirmed", "value")
    r = requests(spark, sf_dir).select("request_id", "purpose", "token_budget", "max_memories", "terms")
    line = F.concat_ws(" | ", "memory_key", "kind", "scope", "value")
    return ranked.join(m, "memory_id").join(r, "request_id").withColumn("input_rank", F.col("final_rank")).withColumn("line", line)


def _ordered(mode):
    def run(spark, sf_dir):
        return context.selection_order(_candidates(spark, sf_dir), mode).select("request_id", "memory_id", "select_rank")

    run.__name__ = f"context_{mode}"
    return run


def context_pack_greedy(spark, sf_dir):
    ordered = context.selection_order(_candidates(spark, sf_dir), "relevance_first").withColumn("usable", F.lit(True))
    return context.pack(ordered).select("request_id", "memory_id", "select_rank", "reason", "used_tokens")


def context_pack_coverage(spark, sf_dir):
    ordered = context.selection_order(_candidates(spark, sf_dir), "relevance_first").withColumn("obligations", F.filter("terms", lambda t: F.contains(F.lower("value"), t)))
    return context.pack_for_coverage(ordered.select("request_id", "memory_id", "select_rank", "line", "token_budget", "max_memories", "obligations"))


def coverage_receipt(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    packed = context.pack(context.selection_order(cand, "relevance_first").withColumn("usable", F.lit(True))).select("request_id", "memory_id", "reason")
    wanted = requests(spark, sf_dir).select("request_id", F.explode("terms").alias("obligation"))
    met = cand.select("request_id", "memory_id", F.explode(F.filter("terms", lambda t: F.contains(F.lower("value"), t))).alias("obligation"))
    return context.coverage(wanted.join(met, ["request_id", "obligation"], "left"), packed)


def envelope_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(context.escape_envelope(F.coalesce("html", F.lit("")))).alias("escaped_md5"))


def _asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.coalesce("text", F.lit("")).alias("query"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("k"), F.col("turn"), F.lit(" history"))).alias("key"),
                    F.when(F.col("turn") % 3 == 0, "auto").when(F.col("turn") % 3 == 1, "direct").otherwise("multi_step").alias("strategy"), (F.col("turn") % 4 == 2).alias("include_history"))


def query_plan(spark, sf_dir):
    return query.plan(_asked(spark, sf_dir), 3).select("request_id", F.col("total_queries").cast("bigint").alias("total_queries"), "capped", "history", "complexity", "strategy_used", F.md5(F.array_join("queries", "|")).alias("queries_md5"))


def query_steps(spark, sf_dir):
    return query.steps(query.plan(_asked(spark, sf_dir), 3), 2).groupBy("status").agg(F.count("*").alias("steps"))


def evidence_merge(spark, sf_dir):
    hits = rq.channel_hits(spark, sf_dir).where("channel <> 'structured'").select("request_id", F.col("channel").alias("subquery"), "memory_id", "updated_at", F.col("channel_rank").alias("rank"), F.lit(None).cast("double").alias("score"))
    return query.merge_evidence(hits).select("request_id", "memory_id", "score", "min_rank", "matched", "evidence_rank")


def sufficiency(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        i, (i % 4).alias("evidence"), (1 + i % 3).alias("min_evidence"), (i % 5).alias("matched"), (1 + i % 4).alias("total_queries"), (i % 7 == 0).alias("history"), (i % 2).alias("history_count"), (i % 11 == 0).alias("history_truncated"),
        (i % 13 == 0).alias("unsupported"), (i % 17 == 0).alias("capped"), F.when(i % 19 == 0, "max_steps").when(i % 23 == 0, "timeout").otherwise("completed").alias("stopped"))
    return query.sufficiency(rows).select("event_id", "status", "reasons", "fallback")


def citation_hash(spark, sf_dir):
    return answer.cite(memories(spark, sf_dir)).select("memory_id", "content_hash", "citation")


def _packed(spark, sf_dir):
    """Packed memories by their canonical lines, with the exact version that was packed."""
    ranked = ranking.fuse(rq.channel_hits(spark, sf_dir))
    m, r = memories(spark, sf_dir), requests(spark, sf_dir).select("request_id", "purpose", "token_budget", "max_memories")
    rows = ranked.join(m.drop("updated_at", "doc_id", "user_id", "agent_id"), "memory_id").join(r, "request_id").withColumns({"input_rank": F.col("final_rank"), "line": answer.line(), "usable": F.lit(True)})
    packed = context.pack(context.selection_order(rows, "relevance_first")).where("reason = 'packed'")
    return packed.join(m.select("memory_id", "source_event_id", "version"), "memory_id").withColumn("status", F.lit(None).cast("string"))


def evidence_statements(spark, sf_dir):
    said = answer.statements(_packed(spark, sf_dir), memories(spark, sf_dir))
    return said.select("request_id", "place", "memory_id", "citation", "verification", "start", "stop", F.md5("value").alias("value_md5"), F.md5("line").alias("line_md5"))


def grounded_answers(spark, sf_dir):
    """Answers over what was packed, and how much of what was asked they cover."""
    packed, m, r = _packed(spark, sf_dir), memories(spark, sf_dir), requests(spark, sf_dir)
    wanted = r.select("request_id", F.explode("terms").alias("obligation"))
    held = packed.select("request_id", "memory_id").join(m.select("memory_id", "value"), "memory_id").join(wanted, "request_id").where(F.contains(F.lower("value"), F.col("obligation"))).select("request_id", "obligation").distinct().withColumn("outcome", F.lit("selected"))
    met = wanted.join(held, ["request_id", "obligation"], "left").fillna("missing", ["outcome"])
    out = answer.compose(r.select("request_id"), answer.statements(packed, m), met)
    return out.select("request_id", "status", F.greatest(F.coalesce(F.size("statements"), F.lit(0)), F.lit(0)).alias("statements"), "covered", "total")


def contract_violations(spark, sf_dir):
    """Packed rows of which some name an older version, a repeated one or a fact that may not be used."""
    p = _packed(spark, sf_dir)
    n = F.substring("memory_id", 2, 12).cast("bigint")
    told = p.withColumns({"version": F.col("version") - (n % 5 == 0).cast("int"), "status": F.when(n % 3 == 0, "conflict"), "usable": n % 2 == 0})
    return answer.contract_violations(told.unionByName(told.where(n % 7 == 0)), memories(spark, sf_dir))


def handoff_resume_status(spark, sf_dir):
    """A task's newest capsule: ready, expired, or not found."""
    m = memories(spark, sf_dir).where("kind = 'task_state'").groupBy("task_id").agg(F.max_by("memory_id", F.struct("updated_at", "memory_id")).alias("memory_id"), F.max("updated_at").alias("updated_at"))
    tasks = requests(spark, sf_dir).select("task_id").union(spark.createDataFrame([("t99",)], "task_id string")).distinct()
    limit = 1704067200 + 996
    return tasks.join(m, "task_id", "left").select("task_id", "memory_id", F.when(F.col("memory_id").isNull(), "not_found").when(F.col("updated_at") < limit, "expired").otherwise("ready").alias("status"))


QUERIES = {f.__name__: f for f in (
    ledger_versions, ledger_current, ledger_tombstones, idempotent_outcomes, cas_conflicts, history_visible, history_quota, command_fold, stream_ledger_equals_batch, batch_latest, fact_temporal_status, fact_refs,
    fact_adjudication, fact_group_budget, token_estimate, _ordered("relevance_first"), _ordered("relevance_only"), _ordered("legacy_weighted"), _ordered("input_order"), context_pack_greedy, context_pack_coverage,
    coverage_receipt, envelope_escape, query_plan, query_steps, evidence_merge, sufficiency, citation_hash, evidence_statements, grounded_answers, contract_violations, handoff_resume_status)}

APPLIED = f"""WITH {EVENTS}, flagged AS (SELECT *, lag(is_forget) OVER (PARTITION BY user_id, memory_key ORDER BY event_seq, event_id) AS was FROM ledger),
applied AS (SELECT * FROM flagged WHERE NOT is_forget OR was = false),
lived AS (SELECT *, CAST(coalesce(sum(is_forget::INT) OVER (PARTITION BY user_id, memory_key ORDER BY event_seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lifetime FROM applied),
versions AS (SELECT *, CAST(sum((NOT is_forget)::INT) OVER w AS BIGINT) AS version, first_value(event_id) OVER w AS memory_id, lag(event_id) OVER w AS supersedes_event FROM lived WINDOW w AS (PARTITION BY user_id, memory_key, lifetime ORDER BY event_seq, event_id))"""
_LATEST = f"WITH {EVENTS} SELECT user_id, memory_key, event_id, is_forget, kind, value FROM ledger QUALIFY row_number() OVER (PARTITION BY user_id, memory_key ORDER BY event_seq DESC, event_id DESC) = 1"
_TEMPORAL = f"CASE WHEN {FACT_DAY} < valid_from THEN 'not_yet_valid' WHEN {FACT_DAY} >= valid_until THEN 'expired' END"
_P = "user_id, scope, scope_identity, kind, fact_group"
FACT_BASE = f"""WITH RECURSIVE {MEMORIES}, {FACTS}, timed AS (SELECT *, {_TEMPORAL} AS temporal FROM facts),
named AS (SELECT {_P}, memory_id, ref.memory_id AS replaces, ref.source_event_id AS replaces_event, ref.version AS replaces_version FROM (SELECT *, unnest(replaces) AS ref FROM timed WHERE temporal IS NULL)),
refs AS (SELECT {', '.join('a.' + c for c in _P.split(', '))}, a.memory_id, a.replaces, b.memory_id IS NOT NULL AS resolved FROM named a LEFT JOIN facts b ON a.user_id = b.user_id AND a.scope = b.scope AND a.scope_identity = b.scope_identity AND a.kind = b.kind AND a.fact_group = b.fact_group
  AND b.memory_id = a.replaces AND b.source_event_id = a.replaces_event AND b.version = a.replaces_version)"""
CANDIDATES = f"""{rq.BASE}, {rq.PAIRS}, {rq.HITS}, {rq.RRF},
cand AS (SELECT k.*, m.kind AS m_kind, m.scope, m.user_confirmed, m.updated_at, m.value, r.purpose, r.token_budget, r.max_memories, r.terms, k.final_rank AS input_rank, m.memory_key || ' | ' || m.kind || ' | ' || m.scope || ' | ' || m.value AS line,
  CASE r.purpose || '/' || m.kind {' '.join(f"WHEN '{p}/{k}' THEN {w}" for p, kinds in context.PURPOSE_WEIGHT.items() for k, w in kinds.items())} END AS weight
  FROM ranked k JOIN memories m ON m.memory_id = k.memory_id JOIN requests r ON r.request_id = k.request_id)"""


def _order_sql(order: str) -> str:
    return f"{CANDIDATES} SELECT request_id, memory_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS INTEGER) AS select_rank FROM cand"


PACKED = CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + """, ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY exact_tier DESC, score DESC, weight DESC, updated_at DESC, memory_id DESC) AS INTEGER) AS rn FROM cand),
sized AS (SELECT request_id, memory_id, rn, octet_length(encode(line)) AS size, token_budget, max_memories FROM ordered),
fold AS (SELECT request_id, 0 AS rn, 0::BIGINT AS bytes, 0 AS items, NULL::VARCHAR AS memory_id, NULL::VARCHAR AS reason FROM (SELECT DISTINCT request_id FROM sized)
  UNION ALL SELECT s.request_id, s.rn, CASE WHEN s.ok THEN s.grown ELSE s.bytes END, s.items + s.ok::INT, s.memory_id, s.why FROM (
    SELECT x.request_id, x.rn, x.memory_id, f.bytes, f.items, f.bytes + (f.items > 0)::INT + x.size AS grown,
      CASE WHEN f.items >= x.max_memories THEN 'max_memories' WHEN ceil((f.bytes + (f.items > 0)::INT + x.size) / 4.0) > x.token_budget THEN 'token_budget' ELSE 'packed' END AS why,
      f.items < x.max_memories AND ceil((f.bytes + (f.items > 0)::INT + x.size) / 4.0) <= x.token_budget AS ok
    FROM fold f JOIN sized x ON x.request_id = f.request_id AND x.rn = f.rn + 1) s),
packed AS (SELECT request_id, memory_id, rn AS select_rank, reason, CAST(ceil(bytes / 4.0) AS BIGINT) AS used_tokens FROM fold WHERE rn > 0)"""
_TASK = "CASE WHEN m.task_id IS NOT NULL THEN ',\"taskId\":' || to_json(m.task_id) ELSE '' END"
_HEAD = """'{"key":' || to_json(m.memory_key) || ',"value":' || to_json(m.value) || ',"kind":' || to_json(m.kind) || ',"scope":' || to_json(m.scope)"""
CITED = f"""cited AS (SELECT memory_id, content_hash, 'memory:' || rtrim(translate(base64(unhex(sha256('[{{"a":' || to_json(memory_id) || ',"b":' || to_json(source_event_id) || ',"c":' || version || ',"d":"' || content_hash || '"}}]'))), '+/', '-_'), '=') AS citation
  FROM (SELECT m.memory_id, m.source_event_id, m.version, sha256({_HEAD} || {_TASK} || ',"memoryId":' || to_json(m.memory_id) || ',"sourceEventId":' || to_json(m.source_event_id) || ',"version":' || m.version || ',"sourceAgentId":' || to_json(m.agent_id) || '}}') AS content_hash FROM memories m))"""
LINED = PACKED.replace("m.memory_key || ' | ' || m.kind || ' | ' || m.scope || ' | ' || m.value AS line", f"{_HEAD} || ',\"version\":' || m.version || {_TASK} || '}}' AS line")
_SPLIT = query.SPLIT
ASKED = f"""WITH asked AS (SELECT conv_id || '-' || turn AS request_id, coalesce(text, '') AS query, CASE WHEN turn % 5 = 4 THEN 'k' || turn END AS key,
  CASE turn % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'direct' ELSE 'multi_step' END AS strategy, turn % 4 = 2 AS include_history FROM conversations),
parts AS (SELECT *, list_transform(string_split_regex(query, '{_SPLIT}'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS raw,
  list_transform(string_split_regex(query, '{_SPLIT}'), lambda p: trim(regexp_replace(regexp_replace(regexp_replace(p, '{query.PLANNING_WORDS}', ' ', 'g'), '{query.PLANNING_SIGNS}', ' ', 'g'), '\\s+', ' ', 'g'))) AS bare FROM asked),
listed AS (SELECT *, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN bare[i] = '' THEN raw[i] ELSE bare[i] END) AS each FROM parts),
firsts AS (SELECT *, CASE WHEN key IS NOT NULL THEN [key] ELSE list_filter(each, lambda x, i: x <> '' AND list_position(each, x) = i) END AS split FROM listed),
planned AS (SELECT *, CASE WHEN strategy = 'direct' THEN CASE WHEN len(split) > 0 THEN split[1:1] ELSE [query] END ELSE split END AS requested, strategy <> 'direct' AND (include_history OR regexp_matches(query, '{query.HISTORY}')) AS h, regexp_matches(query, '{query.MULTI_HOP}') AS hops FROM firsts),
complexities AS (SELECT *, requested[1:3] AS queries, CASE WHEN hops THEN 'L3' WHEN h OR len(requested[1:3]) > 1 THEN 'L2' WHEN key IS NOT NULL THEN 'L0' ELSE 'L1' END AS complexity FROM planned),
plans AS (SELECT *, CASE WHEN strategy = 'direct' THEN 'direct' WHEN strategy = 'multi_step' OR complexity IN ('L2', 'L3') THEN 'multi_step' ELSE 'direct' END AS strategy_used FROM complexities)"""
_REASONS = """concat_ws(',', CASE WHEN evidence = 0 THEN 'no_evidence' END, CASE WHEN evidence < min_evidence THEN 'below_min_evidence' END, CASE WHEN matched < total_queries THEN 'partial_query_coverage' END,
  CASE WHEN history AND history_count = 0 THEN 'missing_history_evidence' END, CASE WHEN history_truncated THEN 'history_limit' END, CASE WHEN unsupported THEN 'unsupported_complexity' END, CASE WHEN stopped <> 'completed' THEN stopped END)"""

SQL = {
    "ledger_versions": f"{APPLIED} SELECT event_id, user_id, memory_key, lifetime, version, memory_id, coalesce(supersedes_event, -1) AS supersedes_event, CASE WHEN is_forget THEN 'forgotten' WHEN supersedes_event IS NULL THEN 'created' ELSE 'replaced' END AS action FROM versions",
    "ledger_current": f"{APPLIED} SELECT user_id, memory_key, memory_id, event_id, version, kind, value FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY user_id, memory_key ORDER BY event_seq DESC, event_id DESC) = 1) WHERE NOT is_forget",
    "ledger_tombstones": f"{APPLIED} SELECT user_id, count(*) AS forgotten, max(version) AS most_versions FROM versions WHERE is_forget GROUP BY user_id",
    "idempotent_outcomes": f"""WITH {EVENTS}, k AS (SELECT *, row_number() OVER w AS rn, first_value(event_id) OVER w AS first_event, first_value(memory_key || kind || round(value, 6)) OVER w AS request FROM ledger WHERE NOT is_forget WINDOW w AS (PARTITION BY user_id, idempotency_key ORDER BY event_seq, event_id))
  SELECT event_id, first_event, CASE WHEN rn = 1 THEN 'original' WHEN request = memory_key || kind || round(value, 6) THEN 'duplicate' ELSE 'conflict' END AS outcome FROM k""",
    "cas_conflicts": f"""{APPLIED}, b AS (SELECT event_id, is_forget, coalesce(lag(CASE WHEN is_forget THEN 0 ELSE version END) OVER (PARTITION BY user_id, memory_key ORDER BY event_seq, event_id), 0) AS actual_version FROM versions)
  SELECT event_id, event_id % 3 AS expected_version, actual_version, event_id % 3 <> actual_version AS conflict FROM b WHERE NOT is_forget""",
    "history_visible": f"""{APPLIED}, seen AS (SELECT user_id AS request_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_seq DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM applied
    WHERE (scope = 'user' OR (scope = 'agent' AND agent_id = 'a' || (user_id % 3)) OR (scope = 'task' AND task_id = 't' || (user_id % 7))) AND (user_id % 2 = 0 OR sensitivity <> 'private') AND (user_id % 3 <> 0 OR memory_key = user_id % 10))
  SELECT request_id, CAST((rn - 1) // 3 + 1 AS INTEGER) AS page, event_id, CAST((rn - 1) % 3 + 1 AS INTEGER) AS page_rank, n > ((rn - 1) // 3 + 1) * 3 AS more FROM seen WHERE rn <= 6""",
    "history_quota": f"""{APPLIED}, cur AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY user_id, memory_key ORDER BY event_seq DESC, event_id DESC) = 1), t AS (SELECT user_id, memory_key, count(*) OVER (PARTITION BY user_id) AS n FROM cur WHERE NOT is_forget),
  q AS (SELECT *, memory_key + 1 AS target_rank, 10 // n + (memory_key + 1 <= 10 % n)::INT AS quota FROM t)
  SELECT q.user_id AS request_id, target_rank, event_id, CAST(quota AS BIGINT) AS quota, CAST(rn AS INTEGER) AS rn FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, memory_key ORDER BY event_seq DESC, event_id DESC) AS rn FROM applied) a ON a.user_id = q.user_id AND a.memory_key = q.memory_key WHERE rn <= quota""",
    "stream_ledger_equals_batch": _LATEST, "batch_latest": _LATEST,
    "fact_temporal_status": f"WITH {MEMORIES}, {FACTS} SELECT memory_id, coalesce({_TEMPORAL}, 'active') AS status FROM facts",
    "fact_refs": f"{FACT_BASE} SELECT memory_id, replaces, resolved FROM refs",
    "fact_adjudication": f"""{FACT_BASE}, broken AS (SELECT DISTINCT {_P} FROM refs WHERE NOT resolved), reach AS (SELECT memory_id AS a, replaces AS b FROM refs WHERE resolved UNION SELECT r.a, e.replaces FROM reach r JOIN refs e ON e.memory_id = r.b AND e.resolved),
  loops AS (SELECT DISTINCT {_P} FROM refs WHERE memory_id IN (SELECT a FROM reach WHERE a = b)), gone AS (SELECT DISTINCT {_P}, replaces AS memory_id FROM refs WHERE resolved),
  marked AS (SELECT t.*, b.kind IS NOT NULL AS broken, l.kind IS NOT NULL AS cyclic, g.memory_id IS NOT NULL AS replaced FROM timed t LEFT JOIN broken b USING ({_P}) LEFT JOIN loops l USING ({_P}) LEFT JOIN gone g USING ({_P}, memory_id)),
  judged AS (SELECT *, count(*) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) AS standing, min(fact_value) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) <> max(fact_value) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) AS differ FROM marked)
  SELECT memory_id, CASE WHEN temporal IS NOT NULL THEN temporal WHEN broken OR cyclic THEN 'unresolved' WHEN replaced THEN 'superseded' WHEN differ THEN 'conflict' WHEN standing > 1 THEN 'consistent_assertions' ELSE 'active_assertion' END AS status,
    temporal IS NULL AND NOT broken AND NOT cyclic AND NOT replaced AND NOT differ AS usable,
    CASE WHEN temporal = 'expired' THEN 'validity_end' WHEN temporal IS NOT NULL THEN 'validity_start' WHEN cyclic THEN 'replacement_cycle' WHEN broken THEN 'unverified_reference' WHEN replaced THEN 'verified_replacement' WHEN differ THEN 'different_visible_values' WHEN standing > 1 THEN 'equal_visible_values' ELSE 'single_visible_assertion' END AS reason FROM judged""",
    "fact_group_budget": f"WITH {MEMORIES}, {FACTS}, g AS (SELECT count(*) AS members FROM facts GROUP BY {_P}) SELECT members > 3 AS truncated, count(*) AS groups, CAST(sum(members) AS BIGINT) AS members FROM g GROUP BY members > 3",
    "token_estimate": "SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, ceil(octet_length(encode(text)) / 4.0)) END AS BIGINT) AS tokens FROM documents",
    "context_relevance_first": _order_sql("exact_tier DESC, score DESC, weight DESC, updated_at DESC, memory_id DESC"),
    "context_relevance_only": _order_sql("exact_tier DESC, score DESC, updated_at DESC, memory_id DESC"),
    "context_legacy_weighted": _order_sql("round(score * 1000 + CASE scope WHEN 'task' THEN 20 WHEN 'agent' THEN 15 ELSE 0 END + CASE WHEN user_confirmed THEN 10 ELSE 0 END + weight, 6) DESC, updated_at DESC, memory_id DESC"),
    "context_input_order": _order_sql("input_rank"),
    "context_pack_greedy": f"{PACKED} SELECT * FROM packed",
    "coverage_receipt": f"""{PACKED}, wanted AS (SELECT request_id, unnest(terms) AS obligation FROM requests)
  SELECT w.request_id, obligation, CASE WHEN count(c.memory_id) = 0 THEN 'none_retrieved' WHEN bool_or(coalesce(p.reason = 'packed', false)) THEN 'selected' ELSE 'context_budget' END AS outcome
  FROM wanted w LEFT JOIN cand c ON c.request_id = w.request_id AND contains(lower(c.value), w.obligation) LEFT JOIN packed p ON p.request_id = c.request_id AND p.memory_id = c.memory_id GROUP BY w.request_id, obligation""",
    "envelope_escape": "SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "query_plan": f"{ASKED} SELECT request_id, CAST(len(requested) AS BIGINT) AS total_queries, len(requested) > 3 AS capped, h AND strategy_used = 'multi_step' AS history, complexity, strategy_used, md5(array_to_string(queries, '|')) AS queries_md5 FROM plans",
    "query_steps": f"{ASKED}, s AS (SELECT unnest(range(1, len(queries) + (h AND strategy_used = 'multi_step')::INT + 1)) AS step FROM plans) SELECT CASE WHEN step <= 2 THEN 'completed' ELSE 'skipped' END AS status, count(*) AS steps FROM s GROUP BY 1",
    "evidence_merge": f"""{rq.BASE}, {rq.PAIRS}, {rq.HITS}, e AS (SELECT request_id, memory_id, updated_at, round(sum(1.0::DOUBLE / (60 + channel_rank)), 8) AS score, min(channel_rank) AS min_rank, string_agg(DISTINCT channel, ',' ORDER BY channel) AS matched FROM hits WHERE channel <> 'structured' GROUP BY ALL)
  SELECT request_id, memory_id, score, min_rank, matched, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, memory_id DESC) AS INTEGER) AS evidence_rank FROM e""",
    "sufficiency": f"""WITH x AS (SELECT event_id, event_id % 4 AS evidence, 1 + event_id % 3 AS min_evidence, event_id % 5 AS matched, 1 + event_id % 4 AS total_queries, event_id % 7 = 0 AS history, event_id % 2 AS history_count, event_id % 11 = 0 AS history_truncated, event_id % 13 = 0 AS unsupported, event_id % 17 = 0 AS capped,
    CASE WHEN event_id % 19 = 0 THEN 'max_steps' WHEN event_id % 23 = 0 THEN 'timeout' ELSE 'completed' END AS stopped FROM events),
  g AS (SELECT *, NOT unsupported AND NOT capped AND NOT history_truncated AND evidence >= min_evidence AND matched = total_queries AND (NOT history OR history_count > 0) AND stopped = 'completed' AS good FROM x)
  SELECT event_id, CASE WHEN good THEN 'sufficient' WHEN evidence > 0 THEN 'partial' ELSE 'insufficient' END AS status, {_REASONS} AS reasons,
    concat_ws(',', CASE WHEN unsupported THEN 'unsupported_complexity' END, CASE WHEN capped THEN 'subquery_limit' END, CASE WHEN history_truncated THEN 'history_limit' END, CASE WHEN stopped <> 'completed' THEN stopped END, CASE WHEN NOT good THEN 'insufficient_evidence' END) AS fallback FROM g""",
    "citation_hash": f"WITH {MEMORIES}, {CITED} SELECT memory_id, content_hash, citation FROM cited",
    "evidence_statements": f"""{LINED}, {CITED}, told AS (SELECT p.*, k.line, length(k.line) AS size, m.value FROM packed p JOIN cand k USING (request_id, memory_id) JOIN memories m USING (memory_id) WHERE p.reason = 'packed')
  SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS place, memory_id, citation, 'unverified_memory' AS verification, CAST(coalesce(sum(size + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(coalesce(sum(size + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS BIGINT) AS stop, md5(value) AS value_md5, md5(line) AS line_md5 FROM told JOIN cited USING (memory_id) WINDOW w AS (PARTITION BY request_id ORDER BY select_rank, memory_id)""",
    "grounded_answers": f"""{LINED}, wanted AS (SELECT request_id, unnest(terms) AS obligation FROM requests),
  held AS (SELECT DISTINCT p.request_id, obligation FROM packed p JOIN memories m USING (memory_id) JOIN wanted w ON w.request_id = p.request_id WHERE reason = 'packed' AND contains(lower(m.value), obligation)),
  n AS (SELECT request_id, count(*) AS statements FROM packed WHERE reason = 'packed' GROUP BY request_id), c AS (SELECT request_id, count(*) AS covered FROM held GROUP BY request_id), t AS (SELECT request_id, count(*) AS total FROM wanted GROUP BY request_id)
  SELECT request_id, CASE WHEN statements IS NULL THEN 'abstain' WHEN coalesce(covered, 0) >= coalesce(total, 0) THEN 'evidence_ready' ELSE 'partial' END AS status, coalesce(statements, 0) AS statements, coalesce(covered, 0) AS covered, coalesce(total, 0) AS total
  FROM (SELECT request_id FROM requests) LEFT JOIN n USING (request_id) LEFT JOIN c USING (request_id) LEFT JOIN t USING (request_id)""",
    "contract_violations": f"""{LINED}, p AS (SELECT request_id, memory_id, CAST(substr(memory_id, 2) AS BIGINT) AS n FROM packed WHERE reason = 'packed'), r AS (SELECT *, 1 AS k FROM p UNION ALL SELECT *, 2 FROM p WHERE n % 7 = 0)
  SELECT request_id, memory_id, 'other_version' AS code FROM r WHERE n % 5 = 0 UNION ALL SELECT request_id, memory_id, 'repeated' FROM r WHERE n % 7 = 0 UNION ALL SELECT request_id, memory_id, 'fact_not_usable' FROM r WHERE n % 3 = 0 AND n % 2 <> 0""",
    "handoff_resume_status": f"""{rq.BASE}, m AS (SELECT task_id, arg_max(memory_id, updated_at) AS memory_id, max(updated_at) AS updated_at FROM memories WHERE kind = 'task_state' GROUP BY task_id), t AS (SELECT task_id FROM requests UNION SELECT 't99')
  SELECT t.task_id, memory_id, CASE WHEN memory_id IS NULL THEN 'not_found' WHEN updated_at < 1704068196 THEN 'expired' ELSE 'ready' END AS status FROM t LEFT JOIN m USING (task_id)""",
}

"""Model tables as projections of the driver's tables, in Spark and as the SQL that the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["user_preference", "user_fact", "task_state", "decision"]
SCOPES = ["user", "agent", "task"]
EVALUATED_AT = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # A label row is a few bytes; the shuffle join lets Spark broadcast it where it is small.
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    m = d.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    scope = _pick(SCOPES, i % 3)
    agent = F.concat(F.lit("a"), (F.floor(i / 3) % 3).cast("string"))
    return m.select(
        i, F.concat(F.lit("d"), F.lpad(i.cast("string"), 12, "0")).alias("memory_id"), F.concat(F.lit("u"), (i % 5).cast("string")).alias("user_id"), agent.alias("agent_id"),
        F.when(scope == "agent", agent).alias("owner_agent_id"), F.when(scope == "task", F.concat(F.lit("t"), (i % 7).cast("string"))).alias("task_id"), scope.alias("scope"),
        F.concat_ws(":", "source", "lang", (i % 50).cast("string")).alias("memory_key"), F.col("text").alias("value"), _pick(KINDS, i % 4).alias("kind"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "private").otherwise("public").alias("sensitivity"), (F.coalesce("quality", F.lit(0)) == 1).alias("user_confirmed"),
        F.concat(F.lit("e"), i.cast("string")).alias("source_event_id"), (F.lit(1704067200) + i).alias("updated_at"), F.lit(1).cast("bigint").alias("version"))


MEMORIES = """memories AS (
  SELECT d.doc_id, 'd' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS memory_id, 'u' || (d.doc_id % 5) AS user_id, 'a' || ((d.doc_id // 3) % 3) AS agent_id,
    CASE WHEN d.doc_id % 3 = 1 THEN 'a' || ((d.doc_id // 3) % 3) END AS owner_agent_id, CASE WHEN d.doc_id % 3 = 2 THEN 't' || (d.doc_id % 7) END AS task_id,
    ['user', 'agent', 'task'][d.doc_id % 3 + 1] AS scope, source || ':' || lang || ':' || (d.doc_id % 50) AS memory_key, text AS value,
    ['user_preference', 'user_fact', 'task_state', 'decision'][d.doc_id % 4 + 1] AS kind, CASE WHEN coalesce(toxic, 0) = 1 THEN 'private' ELSE 'public' END AS sensitivity,
    coalesce(quality, 0) = 1 AS user_confirmed, 'e' || d.doc_id AS source_event_id, 1704067200 + d.doc_id AS updated_at, CAST(1 AS BIGINT) AS version
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    i = F.col("item_id")
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    return b.select(
        i.alias("request_id"), F.concat(F.lit("u"), (i % 5).cast("string")).alias("user_id"), F.concat(F.lit("a"), (i % 3).cast("string")).alias("agent_id"),
        F.concat(F.lit("t"), (i % 7).cast("string")).alias("task_id"), (i % 2 == 0).alias("include_private"), (i % 8 == 1).alias("require_confirmed"),
        F.coalesce(F.try_element_at(terms, F.lit(-1)), F.lit("none")).alias("query"), F.array_distinct(F.slice(terms, 1, 2)).alias("terms"),
        F.concat(F.lit("src"), (i % 20).cast("string"), F.lit(":en:"), (i % 50).cast("string")).alias("key"), _pick(KINDS, i % 4).alias("kind"), (5 + i % 3).cast("int").alias("limit"),
        _pick(["general", "coding", "research", "browser"], i % 4).alias("purpose"), (256 + 256 * (i % 4)).cast("int").alias("token_budget"), (3 + i % 4).cast("int").alias("max_memories"), F.col("text").alias("prompt"))


REQUESTS = """requests AS (
  SELECT item_id AS request_id, 'u' || (item_id % 5) AS user_id, 'a' || (item_id % 3) AS agent_id, 't' || (item_id % 7) AS task_id, item_id % 2 = 0 AS include_private, item_id % 8 = 1 AS require_confirmed,
    coalesce(regexp_extract_all(lower(text), '[a-z]{5,}')[-1], 'none') AS query,
    list_filter([regexp_extract_all(lower(text), '[a-z]{5,}')[1], CASE WHEN regexp_extract_all(lower(text), '[a-z]{5,}')[2] IS DISTINCT FROM regexp_extract_all(lower(text), '[a-z]{5,}')[1] THEN regexp_extract_all(lower(text), '[a-z]{5,}')[2] END], lambda x: x IS NOT NULL) AS terms,
    'src' || (item_id % 20) || ':en:' || (item_id % 50) AS key, ['user_preference', 'user_fact', 'task_state', 'decision'][item_id % 4 + 1] AS kind, CAST(5 + item_id % 3 AS INTEGER) AS lim,
    ['general', 'coding', 'research', 'browser'][item_id % 4 + 1] AS purpose, CAST(256 + 256 * (item_id % 4) AS INTEGER) AS token_budget, CAST(3 + item_id % 4 AS INTEGER) AS max_memories, text AS prompt
  FROM benchmark)"""

ELIGIBLE = """m.user_id = r.user_id AND (m.scope = 'user' OR (m.scope = 'agent' AND m.owner_agent_id = r.agent_id) OR (m.scope = 'task' AND m.task_id = r.task_id))
  AND (r.include_private OR m.sensitivity <> 'private') AND (NOT r.require_confirmed OR m.user_confirmed)"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows in order: ``error`` forgets, others remember. Forgets of absent keys are dropped by the ledger operators."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k, i = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id")
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_seq"), "user_id", (k % 10).alias("memory_key"), (F.col("event_type") == "error").alias("is_forget"),
        F.col("event_type").alias("kind"), "value", F.concat_ws(":", "user_id", k, F.col("event_type")).alias("idempotency_key"),
        F.concat(F.lit("a"), (F.floor(i / 3) % 3).cast("string")).alias("agent_id"), _pick(SCOPES, i % 3).alias("scope"), F.when(i % 3 == 2, F.concat(F.lit("t"), (i % 7).cast("string"))).alias("task_id"), F.when(i % 11 == 0, "private").otherwise("public").alias("sensitivity"))


EVENTS = """ledger AS (
  SELECT event_id, epoch_us(ts) AS event_seq, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS memory_key, event_type = 'error' AS is_forget, event_type AS kind, value,
    user_id || ':' || json_extract_string(props, '$.k') || ':' || event_type AS idempotency_key, 'a' || ((event_id // 3) % 3) AS agent_id, ['user', 'agent', 'task'][event_id % 3 + 1] AS scope,
    CASE WHEN event_id % 3 = 2 THEN 't' || (event_id % 7) END AS task_id, CASE WHEN event_id % 11 = 0 THEN 'private' ELSE 'public' END AS sensitivity FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of every memory: one group a user, language and kind, with validity and up to three replacements; some name an old version."""
    m = memories(spark, sf_dir)
    i = F.col("doc_id")
    group = F.concat_ws("/", F.split("memory_key", ":")[1], (i % 90).cast("string"))
    first = F.when(i % 12 == 0, i - 180).when(i % 360 == 6, i + 180).when(i % 360 == 186, i - 180).when(i % 102 == 7, i - 1)
    more = [F.when(i % 36 == 0, i - 360), F.when(i % 1080 == 9, i + 540)]
    ref = lambda t: F.when(t >= 0, F.struct(F.concat(F.lit("d"), F.lpad(t.cast("string"), 12, "0")).alias("memory_id"), F.concat(F.lit("e"), t.cast("string")).alias("source_event_id"), F.when(i % 24 == 0, 2).otherwise(1).cast("bigint").alias("version")))
    return m.select(
        i, "memory_id", "user_id", "scope", F.coalesce("task_id", "owner_agent_id", F.lit("-")).alias("scope_identity"), "kind", group.alias("fact_group"), F.md5("value").alias("fact_value"),
        "source_event_id", "version", F.when(i % 5 == 2, 20240101 + 200 * (i % 4)).alias("valid_from"), F.when(i % 5 == 3, 20240301 + 300 * (i % 3)).alias("valid_until"),
        F.filter(F.array(ref(first), *[ref(t) for t in more]), lambda r: r.isNotNull()).alias("replaces"), "sensitivity", "user_confirmed", "updated_at")


_REF = "CASE WHEN {0} >= 0 THEN struct_pack(memory_id := 'd' || lpad(CAST({0} AS VARCHAR), 12, '0'), source_event_id := 'e' || {0}, version := CASE WHEN doc_id % 24 = 0 THEN 2 ELSE 1 END) END"
FACTS = f"""facts AS (
  SELECT doc_id, memory_id, user_id, scope, coalesce(task_id, owner_agent_id, '-') AS scope_identity, kind, string_split(memory_key, ':')[2] || '/' || (doc_id % 90) AS fact_group, md5(value) AS fact_value,
    source_event_id, version, CASE WHEN doc_id % 5 = 2 THEN 20240101 + 200 * (doc_id % 4) END AS valid_from, CASE WHEN doc_id % 5 = 3 THEN 20240301 + 300 * (doc_id % 3) END AS valid_until,
    list_filter([{_REF.format('t')}, {_REF.format('t2')}, {_REF.format('t3')}], lambda r: r IS NOT NULL) AS replaces, sensitivity, user_confirmed, updated_at
  FROM (SELECT *, CASE WHEN doc_id % 12 = 0 THEN doc_id - 180 WHEN doc_id % 360 = 6 THEN doc_id + 180 WHEN doc_id % 360 = 186 THEN doc_id - 180 WHEN doc_id % 102 = 7 THEN doc_id - 1 END AS t,
    CASE WHEN doc_id % 36 = 0 THEN doc_id - 360 END AS t2, CASE WHEN doc_id % 1080 = 9 THEN doc_id + 540 END AS t3 FROM memories))"""
FACT_DAY = 20240601

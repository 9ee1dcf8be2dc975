"""Queries over conversations, capture, vectors and the general SQL categories, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.operators import capture, dense
from memloom.plans.fixtures import table

MIN_SCORE, MIN_MARGIN, TOP = 0.3, 0.01, 10


def _items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prefix = F.when(F.col("conv_id") % 4 == 0, "I prefer ").when(F.col("conv_id") % 4 == 1, "Please remember that ").otherwise("")
    user = F.col("role") == "user"
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ordinal"), "role", F.when(user, "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("other").alias("item_type"),
                    F.when(user, F.concat(prefix, F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"), F.when(F.col("conv_id") % 3 == 0, "partial").otherwise("complete").alias("quality"))


def turn_segmentation(spark, sf_dir):
    return capture.turns(_items(spark, sf_dir)).select("thread_id", "ordinal", "turn_no", "place", "final_answer")


def turn_quality(spark, sf_dir):
    return capture.turn_quality(capture.turns(_items(spark, sf_dir)))


def redact_counts(spark, sf_dir):
    _, found = capture.redact(F.col("text"), ["secret", "credential", "email"])
    return table(spark, sf_dir, "documents").select(*[found[k].alias(k) for k in found]).agg(*[F.count_if(k).alias(k) for k in found])


def redact_text(spark, sf_dir):
    text, _ = capture.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("redacted_md5"))


def extract_candidates(spark, sf_dir):
    return capture.candidates(_items(spark, sf_dir)).select("thread_id", "ordinal", "kind", F.md5("value").alias("value_md5"), "rationale", "confidence")


def candidate_dedupe(spark, sf_dir):
    return capture.dedupe(capture.candidates(_items(spark, sf_dir))).select("dedupe_key", "occurrences", "first_thread", "first_ordinal", "confidence", "complete")


def candidate_review(spark, sf_dir):
    c = capture.dedupe(capture.candidates(_items(spark, sf_dir)))
    rows = c.select(F.concat_ws("-", "first_thread", "first_ordinal").alias("id"), "kind", "value")
    held = _items(spark, sf_dir).where("item_type = 'user_message'").select(F.concat_ws("-", "thread_id", "ordinal").alias("id"), F.when(F.col("thread_id") % 4 == 0, "user_preference").otherwise("user_fact").alias("kind"), F.col("text").alias("value"))
    return capture.similar_pairs(rows, held)


def retention_expiry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("conv_id") * 10 + F.col("turn")).alias("seen"))
    return capture.retained(c, F.col("seen"), F.lit(400)).groupBy("conv_id").agg(F.count("*").alias("kept"))


def childless_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return capture.childless(c.select("conv_id").distinct(), c.where("role = 'system'"), "conv_id")


def receipts_last_n(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return capture.last_n(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


def sync_status(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.max("turn").alias("updated"))
    seen = t.where("thread_id % 2 = 0").select("thread_id", (F.col("updated") - (F.col("thread_id") % 3 == 0).cast("int")).alias("seen"))
    return capture.needs_sync(t, seen)


def workspace_allowlist(spark, sf_dir):
    from memloom.operators.eligibility import workspace_allowed

    url = F.regexp_extract("url", "//[^/]+(/[^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", (workspace_allowed(url, F.lit("/en/")) | workspace_allowed(url, F.lit("/fr"))).alias("allowed"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v


def _ranked(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return dense.top_k(q, v, TOP, MIN_SCORE)


def cosine_topk(spark, sf_dir):
    return _ranked(spark, sf_dir)


def vector_norm_check(spark, sf_dir):
    return dense.norm_check(table(spark, sf_dir, "embeddings")).select("vec_id", "norm", "unit")


def dense_admission(spark, sf_dir):
    q, _ = _vectors(spark, sf_dir)
    i = F.col("query_id")
    return dense.admission(_ranked(spark, sf_dir), q.select(i, (i % 150 == 0).cast("int").alias("lexical_matches"), (i % 200 != 50).alias("model_ready"), (i % 350 != 100).alias("complete")), MIN_SCORE, MIN_MARGIN, 2).fillna(-1, ["admitted_id"])


def dense_hybrid(spark, sf_dir):
    return dense.hybrid(_ranked(spark, sf_dir), MIN_SCORE, 3).select("query_id", "vec_id", "rank")


def _verdicts(spark, sf_dir):
    e = lambda k: ((F.col("query_id") * 7 + F.col("vec_id") * k) % 100) / 100.0
    verdict = lambda k: dense.pair_verdict(e(k), (1 - e(k)) * 0.9, 0.7, 0.5)
    return _ranked(spark, sf_dir).withColumns({"forward": verdict(13), "backward": verdict(29), "relevance": F.round(e(31), 6), "lexical_matches": (F.col("query_id") % 250 == 0).cast("int")})


def pair_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("query_id", "vec_id", "forward", "backward")


def rescue_decision(spark, sf_dir):
    return dense.rescue(_verdicts(spark, sf_dir), 4, MIN_SCORE).fillna(-1, ["accepted_id"])


def rerank_order(spark, sf_dir):
    return dense.reorder(_verdicts(spark, sf_dir), 5).select("query_id", "vec_id", "new_rank")


def dense_pending(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") % 3).alias("version"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 2).alias("version"))
    return dense.pending(d, v, ["vec_id", "version"])


def ext_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def ext_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def ext_grouping_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).fillna(-1, ["c_nationkey"])


def ext_set_ops(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("op", F.lit("both")).unionByName(c.exceptAll(s).groupBy("k").agg(F.count("*").alias("n")).select("k", F.lit("more").alias("op")))


def ext_window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("before"))


def ext_semi_anti(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_custkey").alias("c_custkey")
    some = c.join(o.where("o_totalprice > 200000").select(key), "c_custkey", "left_semi").join(o.where("o_orderkey % 5 = 0").select(key), "c_custkey", "left_anti")
    return some.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def ext_session_window(spark, sf_dir):
    """Sessions of a user: events less than ten minutes apart."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "10 minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def ext_range_join(spark, sf_dir):
    """Orders of a customer within a week before another one: an equi-join on customer and week with the rest beside it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    week = F.floor(F.unix_date("d") / 7)
    later = o.select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("d").alias("e"), week.alias("w"))
    earlier = o.withColumn("w", F.explode(F.array(week, week + 1)))
    near = later.join(earlier, ["o_custkey", "w"]).where("d < e AND date_diff(e, d) <= 7")
    return near.groupBy("k").agg(F.count("*").alias("n"))


def ext_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


QUERIES = {f.__name__: f for f in (
    turn_segmentation, turn_quality, redact_counts, redact_text, extract_candidates, candidate_dedupe, candidate_review, retention_expiry, childless_threads, receipts_last_n, sync_status, workspace_allowlist, cosine_topk,
    vector_norm_check, dense_admission, dense_hybrid, pair_verdict, rescue_decision, rerank_order, dense_pending, ext_rollup, ext_cube, ext_grouping_sets, ext_set_ops, ext_window_frames, ext_semi_anti, ext_session_window,
    ext_range_join, ext_approx_distinct)}

ITEMS = """items AS (SELECT conv_id AS thread_id, turn AS ordinal, role, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'other' END AS item_type,
  CASE WHEN role = 'user' THEN CASE conv_id % 4 WHEN 0 THEN 'I prefer ' WHEN 1 THEN 'Please remember that ' ELSE '' END || coalesce(text, '') ELSE text END AS text, CASE WHEN conv_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS quality FROM conversations)"""
TURNS = f"""WITH {ITEMS}, n AS (SELECT *, CAST(sum((role = 'user')::INT) OVER (PARTITION BY thread_id ORDER BY ordinal) AS BIGINT) AS turn_no FROM items),
  t AS (SELECT thread_id, ordinal, role, turn_no, CAST(row_number() OVER (PARTITION BY thread_id, turn_no ORDER BY ordinal) - 1 AS BIGINT) AS place, coalesce(role = 'assistant' AND ordinal = max(ordinal) FILTER (role = 'assistant') OVER (PARTITION BY thread_id, turn_no), false) AS final_answer FROM n)"""
_TRIM = "trim(regexp_replace(regexp_replace(trim(raw), '^[：,:，\\s]+', ''), '[。.!！\\s]+$', ''))"
FOUND = f"""WITH {ITEMS}, raws AS ({' UNION ALL '.join(f"SELECT thread_id, ordinal, quality, {n} AS pattern, regexp_extract(text, '{p}', 1) AS raw, '{r}' AS rationale, '{k}' AS kind, {c}::DOUBLE AS confidence FROM items WHERE item_type = 'user_message'" for n, (p, r, k, c) in enumerate(capture.EXTRACTIONS))}),
  vals AS (SELECT *, {_TRIM} AS value FROM raws),
  found AS (SELECT thread_id, ordinal, kind, value, rationale, CASE WHEN quality = 'complete' THEN confidence ELSE least(confidence, 0.6) END AS confidence, quality, kind || ':' || substr(sha256(kind || ':' || chr(0) || value), 1, 16) AS dedupe_key
    FROM vals WHERE length(value) BETWEEN 2 AND 500 QUALIFY row_number() OVER (PARTITION BY thread_id, ordinal, value ORDER BY pattern) = 1)"""
COSINE = f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(-1, least(1, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS population, CAST(count(*) FILTER (score >= {MIN_SCORE}) OVER (PARTITION BY query_id) AS BIGINT) AS above FROM p),
  ranked AS (SELECT query_id, vec_id, score, rank, population, above FROM r WHERE rank <= {TOP})"""


def _verdict_sql(k: int) -> str:
    e = f"(((query_id * 7 + vec_id * {k}) % 100)::DOUBLE / 100.0::DOUBLE)"
    return f"CASE WHEN (1 - {e}) * 0.9::DOUBLE >= 0.7::DOUBLE THEN 'contradictory_pair' WHEN {e} < 0.5 THEN 'insufficient_pair_support' ELSE 'verified_pair' END"


VERDICTS = f"{COSINE}, v AS (SELECT *, {_verdict_sql(13)} AS forward, {_verdict_sql(29)} AS backward, round(((query_id * 7 + vec_id * 31) % 100)::DOUBLE / 100, 6) AS relevance, (query_id % 250 = 0)::INT AS lexical FROM ranked)"
_BARE = "regexp_replace(lower(value), '[\\p{P}\\p{S}\\s]+', '', 'g')"
_GRAMS = f"CASE WHEN length({_BARE}) > 2 THEN list_distinct(list_transform(range(1, length({_BARE})), lambda i: substr({_BARE}, i, 2))) WHEN length({_BARE}) > 0 THEN [{_BARE}] ELSE [] END"

SQL = {
    "turn_segmentation": f"{TURNS} SELECT thread_id, ordinal, turn_no, place, final_answer FROM t",
    "turn_quality": f"{TURNS} SELECT thread_id, turn_no, count(*) AS items, CASE WHEN bool_or(role = 'user') AND bool_or(final_answer) THEN 'complete' ELSE 'partial' END AS quality FROM t GROUP BY ALL",
    "redact_counts": """WITH a AS (SELECT text, regexp_matches(text, '\\b(?:sk|pk)-[A-Za-z0-9_-]{16,}\\b') AS secret, regexp_replace(text, '\\b(?:sk|pk)-[A-Za-z0-9_-]{16,}\\b', '<redacted:secret>', 'g') AS t1 FROM documents),
  b AS (SELECT *, regexp_matches(t1, '(?i)\\b(?:bearer|token|api[_ -]?key|password|passwd|secret)\\s*[:=]\\s*[^\\s,;]+') AS credential, regexp_replace(t1, '(?i)\\b(?:bearer|token|api[_ -]?key|password|passwd|secret)\\s*[:=]\\s*[^\\s,;]+', '<redacted:credential>', 'g') AS t2 FROM a)
  SELECT count(*) FILTER (secret) AS secret, count(*) FILTER (credential) AS credential, count(*) FILTER (regexp_matches(t2, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')) AS email FROM b""",
    "extract_candidates": f"{FOUND} SELECT thread_id, ordinal, kind, md5(value) AS value_md5, rationale, confidence FROM found",
    "candidate_dedupe": f"""{FOUND} SELECT dedupe_key, count(*) AS occurrences, min(struct_pack(a := thread_id, b := ordinal)).a AS first_thread, min(struct_pack(a := thread_id, b := ordinal)).b AS first_ordinal, max(confidence) AS confidence, max((quality = 'complete')::INT) AS complete FROM found GROUP BY dedupe_key""",
    "candidate_review": f"""{FOUND}, c AS (SELECT kind, value, min(struct_pack(a := thread_id, b := ordinal)) AS f FROM found GROUP BY kind, value), l AS (SELECT f.a || '-' || f.b AS left_id, kind, {_GRAMS} AS x FROM c),
  r AS (SELECT thread_id || '-' || ordinal AS right_id, CASE WHEN thread_id % 4 = 0 THEN 'user_preference' ELSE 'user_fact' END AS kind, {_GRAMS} AS y FROM (SELECT thread_id, ordinal, text AS value FROM items WHERE item_type = 'user_message')),
  p AS (SELECT left_id, right_id, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS similarity FROM l JOIN r ON l.kind = r.kind WHERE len(x) > 0 AND len(y) > 0) SELECT * FROM p WHERE similarity >= 0.72""",
    "retention_expiry": "SELECT conv_id, count(*) AS kept FROM conversations WHERE turn % 5 = 4 OR conv_id * 10 + turn >= 400 GROUP BY conv_id",
    "childless_threads": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "receipts_last_n": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    "sync_status": "WITH t AS (SELECT conv_id AS thread_id, max(turn) AS updated FROM conversations GROUP BY conv_id) SELECT * FROM t WHERE thread_id % 2 <> 0 OR thread_id % 3 = 0",
    "workspace_allowlist": "WITH u AS (SELECT page_id, regexp_extract(url, '//[^/]+(/[^?#]*)', 1) AS p FROM pages) SELECT page_id, p = '/en/' OR starts_with(p, '/en/') OR p = '/fr' OR starts_with(p, '/fr/') AS allowed FROM u",
    "cosine_topk": f"{COSINE} SELECT * FROM ranked",
    "vector_norm_check": "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(n, 5) AS norm, abs(n - 1) <= 0.001 AS unit FROM n",
    "dense_admission": f"""{COSINE}, t AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second, max(vec_id) FILTER (rank = 1) AS first FROM ranked GROUP BY query_id),
  d AS (SELECT *, round(top - second, 6) AS margin, CASE WHEN query_id % 150 = 0 THEN 'lexical_preserved' WHEN query_id % 200 = 50 THEN 'model_not_ready' WHEN query_id % 350 = 100 THEN 'comparison_incomplete' WHEN top < {MIN_SCORE} THEN 'below_similarity' WHEN round(top - second, 6) < {MIN_MARGIN} THEN 'ambiguous_candidates' ELSE 'admitted' END AS reason FROM t)
  SELECT query_id, reason, top, margin, CASE WHEN reason = 'admitted' THEN first ELSE -1 END AS admitted_id FROM d""",
    "dense_hybrid": f"{COSINE} SELECT query_id, vec_id, rank FROM ranked WHERE score >= {MIN_SCORE} AND rank <= 3",
    "pair_verdict": f"{VERDICTS} SELECT query_id, vec_id, forward, backward FROM v",
    "rescue_decision": f"""{VERDICTS}, f AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(forward) FILTER (rank = 1) AS verdict, max(vec_id) FILTER (rank = 1) AS first, max(lexical) AS lexical, count(*) FILTER (forward = 'verified_pair' AND backward = 'verified_pair') AS mutual, max(vec_id) FILTER (forward = 'verified_pair' AND backward = 'verified_pair') AS mutual_id FROM v WHERE rank <= 4 GROUP BY query_id),
  d AS (SELECT *, CASE WHEN top >= {MIN_SCORE} AND verdict = 'verified_pair' THEN 'score_gate_preserved' WHEN top >= {MIN_SCORE} AND verdict = 'contradictory_pair' THEN 'top_contradiction' WHEN lexical > 0 THEN 'lexical_preserved' WHEN verdict = 'contradictory_pair' THEN 'top_contradiction' WHEN mutual = 1 THEN 'unique_mutual_support' WHEN mutual > 1 THEN 'ambiguous_mutual_support' ELSE 'no_mutual_support' END AS reason FROM f)
  SELECT query_id, reason, CASE reason WHEN 'score_gate_preserved' THEN first WHEN 'unique_mutual_support' THEN mutual_id ELSE -1 END AS accepted_id FROM d""",
    "rerank_order": f"{VERDICTS} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, vec_id DESC) AS INTEGER) AS new_rank FROM v WHERE rank <= 5",
    "dense_pending": "SELECT doc_id AS vec_id, doc_id % 3 AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.vec_id % 2 = d.doc_id % 3)",
    "ext_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "ext_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_grouping_sets": "SELECT c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "ext_set_ops": "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT k, 'more' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)",
    "ext_window_frames": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, coalesce(lag(o_orderkey) OVER w, -1) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "ext_semi_anti": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = 0) GROUP BY c_mktsegment",
    "ext_session_window": """WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "ext_range_join": "SELECT a.o_orderkey AS k, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE AND a.o_orderdate::DATE - b.o_orderdate::DATE <= 7 GROUP BY 1",
}

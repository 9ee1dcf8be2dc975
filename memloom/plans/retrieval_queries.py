"""Queries over eligibility, channels, fusion and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.shared import stored
from memloom.operators import channels, metrics, ranking, recall
from memloom.operators.eligibility import access_outcome, eligible
from memloom.plans.fixtures import ELIGIBLE, MEMORIES, REQUESTS, memories, requests, table

OUT = ["request_id", "memory_id", "channel_rank", "truncated"]


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return requests(spark, sf_dir), memories(spark, sf_dir)


def eligible_candidates(spark, sf_dir):
    r, m = _both(spark, sf_dir)
    return eligible(r, m).groupBy("r.request_id").agg(F.count("*").alias("n"), F.min("m.memory_id").alias("first_id"), F.max("m.memory_id").alias("last_id"))


def exact_channel_topk(spark, sf_dir):
    return channels.exact(*_both(spark, sf_dir)).select(*OUT)


def structured_channel_topk(spark, sf_dir):
    return channels.structured(*_both(spark, sf_dir)).select(*OUT)


def whole_query_substring(spark, sf_dir):
    return recall.substring(*_both(spark, sf_dir)).select(*OUT)


def all_terms_and(spark, sf_dir):
    r, m = _both(spark, sf_dir)
    return eligible(r, m, channels.all_terms(F.col("r.terms"), F.col("m.memory_key"), F.col("m.value"))).select("r.request_id", "m.memory_id")


def trigram_posting(spark, sf_dir):
    return channels.postings(memories(spark, sf_dir)).groupBy("trigram").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))


def trigram_candidates(spark, sf_dir):
    r, m = _both(spark, sf_dir)
    return channels.by_postings(r, channels.postings(m))


def bm25_rank(spark, sf_dir):
    return recall.bm25(*_both(spark, sf_dir)).select("request_id", "memory_id", "channel_rank", "score")


def short_terms(spark, sf_dir):
    """Terms of two letters must occur beside the scored ones."""
    r, m = _both(spark, sf_dir)
    r = r.withColumn("terms", F.concat(F.slice("terms", 1, 1), F.array(F.substring("query", 1, 2))))
    return recall.bm25(r, m).select("request_id", "memory_id", "channel_rank", "score")


def literal_fallback(spark, sf_dir):
    """With short terms alone nothing is scored."""
    r, m = _both(spark, sf_dir)
    r = r.withColumn("terms", F.array(F.substring("query", 1, 2), F.substring("key", 4, 1)))
    return recall.bm25(r, m).select("request_id", "memory_id", "channel_rank", "score", "truncated")


def misspelt(query: F.Column) -> F.Column:
    """The second and third letter changed places."""
    return F.concat(F.substring(query, 1, 1), F.substring(query, 3, 1), F.substring(query, 2, 1), F.substring(query, 4, 99))


def spelling_one_edit(spark, sf_dir):
    r, m = _both(spark, sf_dir)
    wrong = misspelt(F.col("query"))
    r = r.withColumn("query", F.when(F.col("request_id") % 3 == 0, F.concat_ws(" ", F.try_element_at("terms", F.lit(1)), wrong)).otherwise(wrong))
    return recall.spelling(r, m).select(*OUT, "query_token", "matched_token", "edit")


def channel_hits(spark, sf_dir) -> DataFrame:
    r, m = _both(spark, sf_dir)
    # Fusion reads them twice.
    return stored(ranking.union_channels(exact=channels.exact(r, m), structured=channels.structured(r, m), full_text=recall.substring(r, m)), "hits")


RANKED = ["request_id", "memory_id", "exact_tier", "score", "channels", "final_rank"]


def rank_fusion_rrf(spark, sf_dir):
    return ranking.fuse(channel_hits(spark, sf_dir)).select(*RANKED)


def rank_fusion_best(spark, sf_dir):
    return ranking.fuse(channel_hits(spark, sf_dir), mode="best", tier=False).select(*RANKED)


def rank_fusion_legacy(spark, sf_dir):
    return ranking.fuse_legacy(channel_hits(spark, sf_dir)).select("request_id", "memory_id", "score", "final_rank")


def batch_integrity(spark, sf_dir):
    """Batches of which some hold their first row twice, and some lack it."""
    hits = channel_hits(spark, sf_dir)
    first, i = F.col("channel_rank") == 1, F.col("request_id") % 5
    return ranking.batch_violations(hits.where(~first | (i != 3)).unionAll(hits.where(first & (i == 1))))


def keyset_page_2(spark, sf_dir):
    r, m = _both(spark, sf_dir)
    rows = eligible(r, m).select("r.request_id", "m.updated_at", "m.memory_id")
    return ranking.page_after(rows, 10, ["updated_at", "memory_id"])


def recall_truncated_flags(spark, sf_dir):
    return channels.structured(*_both(spark, sf_dir)).groupBy("request_id").agg(F.count("*").alias("n"), F.max("truncated").alias("truncated"))


def judgments(spark, sf_dir) -> DataFrame:
    r, m = _both(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    held = eligible(r.withColumns({"include_private": F.lit(True), "require_confirmed": F.lit(False)}), m, channels.contains_folded(F.col("m.value"), F.col("r.query"))).select("r.request_id", "m.memory_id", "m.doc_id")
    grade = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 2)
    return held.join(labels, "doc_id").select("request_id", "memory_id", grade.alias("grade")).where("grade IS NOT NULL")


def ranking_metrics(spark, sf_dir):
    return metrics.ranking_scores(ranking.fuse(channel_hits(spark, sf_dir)), judgments(spark, sf_dir), 3)


def metric_summary(spark, sf_dir):
    s = ranking_metrics(spark, sf_dir)
    return s.agg(F.count("*").alias("requests"), metrics.ratio(F.sum("hits"), F.sum("relevant")).alias("micro_recall"), F.round(F.avg("recall"), 6).alias("macro_recall"),
                 F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), metrics.ratio(F.sum("leaks"), F.sum("selected")).alias("leak_ratio"))


def access_policy(spark, sf_dir):
    r = requests(spark, sf_dir).select("request_id", F.when(F.col("request_id") % 3 == 0, "http").otherwise("mcp").alias("transport"),
                                       F.when(F.col("request_id") % 2 == 0, "key").alias("api_key"), "agent_id", "include_private")
    return access_outcome(r, "key", ["a0", "a1"], False).select("request_id", "outcome")


def latency_nearest_rank(spark, sf_dir):
    return metrics.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


def regression_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 3).alias("round"), F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("phase"))
    p95 = metrics.latency_summary(e, ["event_type", "phase", "round"], "value").select("event_type", "phase", "round", "p95")
    return metrics.regression_gate(p95, "event_type")


QUERIES = {f.__name__: f for f in (
    eligible_candidates, exact_channel_topk, structured_channel_topk, whole_query_substring, all_terms_and, trigram_posting, trigram_candidates, bm25_rank, short_terms, literal_fallback, spelling_one_edit, rank_fusion_rrf,
    rank_fusion_best, rank_fusion_legacy, batch_integrity, keyset_page_2, recall_truncated_flags, ranking_metrics, metric_summary, access_policy, latency_nearest_rank, regression_gate)}

BASE = f"WITH {MEMORIES}, {REQUESTS}"
PAIRS = f"pairs AS (SELECT r.*, m.memory_id, m.memory_key, m.value, m.kind AS m_kind, m.updated_at, m.doc_id FROM requests r JOIN memories m ON {ELIGIBLE})"


def _top(name: str, where: str, order: str = "updated_at DESC, memory_id DESC") -> str:
    return f"""{name}_all AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM pairs WHERE {where}),
{name} AS (SELECT request_id, memory_id, updated_at, CAST(rn AS INTEGER) AS channel_rank, n > lim AS truncated FROM {name}_all WHERE rn <= lim)"""


EXACT, STRUCTURED, TEXT = _top("exact", "memory_key = key"), _top("structured", "m_kind = kind"), _top("full_text", "contains(lower(memory_key), query) OR contains(lower(value), query)")
HITS = f"""{EXACT}, {STRUCTURED}, {TEXT}, hits AS (SELECT 'exact' AS channel, * FROM exact UNION ALL SELECT 'structured', * FROM structured UNION ALL SELECT 'full_text', * FROM full_text),
active AS (SELECT request_id, count(DISTINCT channel) AS active FROM hits WHERE channel <> 'structured' GROUP BY request_id),
per AS (SELECT request_id, memory_id, updated_at, max(CASE WHEN channel = 'exact' THEN 1 ELSE 0 END) AS tier, sum(CASE WHEN channel <> 'structured' THEN 1.0::DOUBLE / (60 + channel_rank) ELSE 0 END) AS total,
  max(CASE WHEN channel <> 'structured' THEN 1.0::DOUBLE / (60 + channel_rank) END) AS best, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM hits GROUP BY request_id, memory_id, updated_at)"""


def _fused(score: str, tier: str) -> str:
    return f"""fused AS (SELECT request_id, memory_id, updated_at, {tier} AS exact_tier, round({score}, 8) AS score, channels FROM per JOIN active USING (request_id) WHERE best IS NOT NULL),
ranked AS (SELECT request_id, memory_id, exact_tier, score, channels, CAST(row_number() OVER (PARTITION BY request_id ORDER BY exact_tier DESC, score DESC, updated_at DESC, memory_id DESC) AS INTEGER) AS final_rank FROM fused)"""


RRF = _fused("CASE WHEN active > 1 THEN total ELSE best END", "tier")
METRICS = f"""{BASE}, {PAIRS}, {HITS}, {RRF},
judged AS (SELECT r.request_id, m.memory_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 2 END AS grade
  FROM (SELECT * REPLACE (true AS include_private, false AS require_confirmed) FROM requests) r JOIN memories m ON {ELIGIBLE} JOIN labels l ON l.doc_id = m.doc_id WHERE contains(lower(m.value), r.query) AND (toxic = 1 OR quality = 1)),
top AS (SELECT * FROM ranked WHERE final_rank <= 3),
wanted AS (SELECT request_id, count(*) FILTER (grade > 0) AS relevant FROM judged GROUP BY request_id),
got AS (SELECT t.request_id, count(*) AS selected, count(*) FILTER (grade > 0) AS hits, count(*) FILTER (grade < 0) AS leaks, min(final_rank) FILTER (grade > 0) AS first,
  sum((pow(2.0, grade) - 1) / log2(final_rank + 1)) FILTER (grade > 0) AS dcg FROM top t LEFT JOIN judged j ON j.request_id = t.request_id AND j.memory_id = t.memory_id GROUP BY t.request_id),
ideal AS (SELECT request_id, sum((pow(2.0, grade) - 1) / log2(p + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY grade DESC, memory_id) AS p FROM judged WHERE grade > 0) WHERE p <= 3 GROUP BY request_id),
scores AS (SELECT request_id, relevant, coalesce(selected, 0) AS selected, coalesce(hits, 0) AS hits, round(coalesce(hits, 0)::DOUBLE / relevant, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
  round(coalesce(dcg / idcg, 0), 6) AS ndcg, relevant - coalesce(hits, 0) AS missed, coalesce(selected, 0) - coalesce(hits, 0) AS false_selected, coalesce(leaks, 0) AS leaks
  FROM wanted LEFT JOIN got USING (request_id) LEFT JOIN ideal USING (request_id) WHERE relevant > 0)"""


def _bm25(scored: str, more: str) -> str:
    """``scored``: the terms with a score; ``more``: those that must only occur."""
    return f"""{BASE}, docs AS (SELECT *, greatest(length(memory_key) - 2, 0) + greatest(length(value) - 2, 0) AS dl FROM memories), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
  asked AS (SELECT *, {scored} AS scored, {more} AS more FROM requests), terms AS (SELECT DISTINCT unnest(scored) AS term FROM asked),
  tf AS (SELECT memory_id, term, dl, CASE WHEN len(list_filter(range(1, length(term)), lambda i: term[1:i] = term[length(term) - i + 1:])) = 0
      THEN (length(k) + length(v) - length(replace(k, term, '')) - length(replace(v, term, ''))) // length(term)
      ELSE len(list_filter(range(1, length(k) - length(term) + 2), lambda i: substr(k, i, length(term)) = term)) + len(list_filter(range(1, length(v) - length(term) + 2), lambda i: substr(v, i, length(term)) = term)) END AS tf
    FROM (SELECT memory_id, dl, term, lower(memory_key) AS k, lower(value) AS v FROM docs JOIN terms ON contains(lower(value), term) OR contains(lower(memory_key), term))),
  idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
  wanted AS (SELECT request_id, len(scored) AS n_terms, unnest(scored) AS term FROM asked),
  per AS (SELECT request_id, memory_id, n_terms, count(*) AS met, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN wanted USING (term), corpus GROUP BY request_id, memory_id, n_terms),
  ok AS (SELECT r.request_id, r.lim, m.memory_id, m.updated_at, p.score FROM per p JOIN asked r ON r.request_id = p.request_id JOIN memories m ON m.memory_id = p.memory_id AND {ELIGIBLE}
    WHERE met = n_terms AND len(list_filter(r.more, lambda t: NOT contains(lower(m.memory_key), t) AND NOT contains(lower(m.value), t))) = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, updated_at DESC, memory_id DESC) AS rn FROM ok)
  SELECT request_id, memory_id, CAST(rn AS INTEGER) AS channel_rank, score FROM ranked WHERE rn <= lim"""


SQL = {
    "eligible_candidates": f"{BASE}, {PAIRS} SELECT request_id, count(*) AS n, min(memory_id) AS first_id, max(memory_id) AS last_id FROM pairs GROUP BY request_id",
    "exact_channel_topk": f"{BASE}, {PAIRS}, {EXACT} SELECT request_id, memory_id, channel_rank, truncated FROM exact",
    "structured_channel_topk": f"{BASE}, {PAIRS}, {STRUCTURED} SELECT request_id, memory_id, channel_rank, truncated FROM structured",
    "whole_query_substring": f"{BASE}, {PAIRS}, {TEXT} SELECT request_id, memory_id, channel_rank, truncated FROM full_text",
    "all_terms_and": f"{BASE}, {PAIRS} SELECT request_id, memory_id FROM pairs WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(lower(value), t) AND NOT contains(lower(memory_key), t))) = 0",
    "trigram_posting": f"""WITH {MEMORIES}, t AS (SELECT DISTINCT memory_id, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS trigram
  FROM (SELECT memory_id, lower(memory_key) || chr(10) || lower(value) AS x FROM memories)) SELECT trigram, count(*) AS n, min(memory_id) AS first_id FROM t GROUP BY trigram""",
    "trigram_candidates": f"""{BASE}, t AS (SELECT request_id, unnest(list_distinct(list_transform(range(1, length(query) - 1), lambda i: substr(query, i, 3)))) AS g FROM requests),
  n AS (SELECT request_id, count(*) AS need FROM t GROUP BY request_id)
  SELECT t.request_id, m.memory_id FROM t JOIN memories m ON contains(lower(m.memory_key) || chr(10) || lower(m.value), t.g) JOIN n ON n.request_id = t.request_id GROUP BY t.request_id, m.memory_id, need HAVING count(*) = need""",
    "bm25_rank": _bm25("terms", "[]"),
    "short_terms": _bm25("terms[1:1]", "[substr(query, 1, 2)]"),
    "literal_fallback": f"""{BASE}, {PAIRS}, ok AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, memory_id DESC) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM pairs
    WHERE (contains(lower(memory_key), substr(query, 1, 2)) OR contains(lower(value), substr(query, 1, 2))) AND (contains(lower(memory_key), substr(key, 4, 1)) OR contains(lower(value), substr(key, 4, 1))))
  SELECT request_id, memory_id, CAST(rn AS INTEGER) AS channel_rank, CAST(NULL AS DOUBLE) AS score, n > lim AS truncated FROM ok WHERE rn <= lim""",
    "spelling_one_edit": f"""WITH {MEMORIES}, {REQUESTS.replace("requests AS", "plain AS")},
  wrong AS (SELECT *, query[1] || query[3] || query[2] || query[4:] AS w FROM plain), requests AS (SELECT * REPLACE (CASE WHEN request_id % 3 = 0 AND len(terms) > 0 THEN terms[1] || ' ' || w ELSE w END AS query) FROM wrong), {PAIRS},
  literal AS (SELECT DISTINCT request_id FROM pairs WHERE len(list_filter(string_split(query, ' '), lambda t: NOT contains(lower(memory_key), t) AND NOT contains(lower(value), t))) = 0),
  worded AS (SELECT *, list_distinct(string_split(query, ' ')) AS asked, regexp_extract_all(lower(memory_key || ' ' || value), '[a-z0-9]+') AS words FROM pairs WHERE request_id NOT IN (SELECT request_id FROM literal) AND octet_length(encode(memory_key || ' ' || value)) <= 65536),
  missing AS (SELECT request_id, lim, memory_id, updated_at, words, list_filter(asked, lambda t: NOT list_contains(words, t)) AS gone FROM worded WHERE len(words) <= 256 AND len(list_filter(asked, lambda t: length(t) > 32)) = 0),
  fixes AS (SELECT request_id, lim, memory_id, updated_at, gone[1] AS query_token, list_min(list_filter(words, lambda w: regexp_full_match(w, '[a-z]+') AND w <> gone[1] AND abs(length(w) - length(gone[1])) <= 1 AND damerau_levenshtein(gone[1], w) = 1)) AS matched_token FROM missing WHERE len(gone) = 1 AND length(gone[1]) >= 5),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, memory_id DESC) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM fixes WHERE matched_token IS NOT NULL)
  SELECT request_id, memory_id, CAST(rn AS INTEGER) AS channel_rank, n > lim AS truncated, query_token, matched_token,
    CASE WHEN length(query_token) > length(matched_token) THEN 'delete' WHEN length(query_token) < length(matched_token) THEN 'insert' WHEN levenshtein(query_token, matched_token) = 1 THEN 'substitute' ELSE 'transpose' END AS edit FROM ranked WHERE rn <= lim""",
    "rank_fusion_rrf": f"{BASE}, {PAIRS}, {HITS}, {RRF} SELECT * FROM ranked",
    "rank_fusion_best": f"{BASE}, {PAIRS}, {HITS}, {_fused('best', '0')} SELECT * FROM ranked",
    "rank_fusion_legacy": f"""{BASE}, {PAIRS}, {HITS}, s AS (SELECT request_id, memory_id, updated_at, round(sum(1.0::DOUBLE / (60 + channel_rank)), 8) AS score FROM hits GROUP BY request_id, memory_id, updated_at)
  SELECT request_id, memory_id, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, memory_id DESC) AS INTEGER) AS final_rank FROM s""",
    "batch_integrity": f"""{BASE}, {PAIRS}, {HITS} SELECT request_id, channel, count(*) AS n, max(channel_rank) AS top, count(DISTINCT channel_rank) AS ranks, count(DISTINCT memory_id) AS ids
  FROM (SELECT * FROM hits WHERE channel_rank <> 1 OR request_id % 5 <> 3 UNION ALL SELECT * FROM hits WHERE channel_rank = 1 AND request_id % 5 = 1) GROUP BY request_id, channel
  HAVING count(*) <> max(channel_rank) OR count(*) <> count(DISTINCT channel_rank) OR count(*) <> count(DISTINCT memory_id)""",
    "keyset_page_2": f"""{BASE}, {PAIRS}, n AS (SELECT request_id, updated_at, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, memory_id DESC) AS rn FROM pairs)
  SELECT request_id, updated_at, memory_id, CAST(rn - 10 AS INTEGER) AS page_rank FROM n WHERE rn BETWEEN 11 AND 20""",
    "recall_truncated_flags": f"{BASE}, {PAIRS}, {STRUCTURED} SELECT request_id, count(*) AS n, bool_or(truncated) AS truncated FROM structured GROUP BY request_id",
    "ranking_metrics": f"{METRICS} SELECT * FROM scores",
    "metric_summary": f"""{METRICS} SELECT count(*) AS requests, round(sum(hits)::DOUBLE / sum(relevant), 6) AS micro_recall, round(avg(recall), 6) AS macro_recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  round(CASE WHEN sum(selected) <> 0 THEN sum(leaks)::DOUBLE / sum(selected) END, 6) AS leak_ratio FROM scores""",
    "access_policy": f"""{BASE} SELECT request_id, CASE WHEN request_id % 3 = 0 AND request_id % 2 <> 0 THEN 'UNAUTHORIZED' WHEN agent_id NOT IN ('a0', 'a1') THEN 'FORBIDDEN_AGENT' WHEN include_private THEN 'FORBIDDEN_PRIVATE' ELSE 'allowed' END AS outcome FROM requests""",
    "latency_nearest_rank": """SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type""",
    "regression_gate": """WITH p AS (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, event_id % 3 AS round, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL),
  m AS (SELECT event_type, quantile_disc(p95, 0.5) FILTER (phase = 'before') AS before, quantile_disc(p95, 0.5) FILTER (phase = 'after') AS after FROM p GROUP BY event_type)
  SELECT event_type, before, after, after <= before * 1.5 + 0.5 AS passes FROM m""",
}

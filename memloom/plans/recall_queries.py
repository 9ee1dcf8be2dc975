"""Queries over whole recalls: staged retrieval, authorised vectors, pages; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import dense, recall
from memloom.operators import facts as fact_ops
from memloom.plans.fixtures import ELIGIBLE, FACT_DAY, FACTS, MEMORIES, REQUESTS, memories, requests, table
from memloom.plans.fixtures import facts as fact_rows
from memloom.plans.retrieval_queries import misspelt

MODEL = "m1"
POLICY = recall.RecallPolicy(candidate_limit=20, min_score=0.1, min_margin=0.01)
TOP, LEAST, PAGE, PAGES, GROUP_LIMIT = 5, 0.2, 4, 3, 2


def recall_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of six kinds: a key, a misspelt word, two words of a kind, nothing that is written anywhere, no query, a word of agents' memories."""
    r = requests(spark, sf_dir)
    i = F.col("request_id") % 6
    query = (F.when(i == 0, F.col("key")).when(i == 1, misspelt(F.col("query"))).when(i == 2, F.concat_ws(" ", F.try_element_at("terms", F.lit(1)), "query"))
             .when(i == 3, F.concat(F.lit("zq"), "request_id", F.lit("xx"))).when(i == 4, F.when(F.col("request_id") % 12 == 4, F.lit("  "))).otherwise(F.col("query")))
    return r.select("request_id", "user_id", "agent_id", "task_id", "include_private", "require_confirmed", query.alias("query"), F.lit(None).cast("string").alias("key"), F.when(i == 2, F.col("kind")).alias("kind"),
                    F.when(i == 4, "user").when(i == 5, "agent").alias("scope"))


def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories; confirmed are those with a vector, and some of one user without."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("held"))
    m = memories(spark, sf_dir).join(held, "doc_id", "left")
    return m.withColumn("user_confirmed", F.col("user_confirmed") & (F.col("held").isNotNull() | (F.col("doc_id") % 5 == 4))).drop("held")


def index(spark: SparkSession, sf_dir: str) -> recall.VectorIndex:
    v = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    vectors = v.select(F.concat(F.lit("d"), F.lpad(i.cast("string"), 12, "0")).alias("memory_id"), F.concat(F.lit("e"), i.cast("string")).alias("source_event_id"), F.lit(1).cast("bigint").alias("version"), F.lit(MODEL).alias("model"), "embedding")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), ((F.col("item_id") * 7 + 3) % 500).alias("vec_id"))
    return recall.VectorIndex(vectors, asked.join(v, "vec_id").select("request_id", "embedding"), MODEL)


def _recalled(spark, sf_dir) -> recall.Recalled:
    return recall.recall(recall_requests(spark, sf_dir), recall_memories(spark, sf_dir), POLICY, index(spark, sf_dir))


def recall_full(spark, sf_dir):
    return _recalled(spark, sf_dir).ranked.select("request_id", "memory_id", "exact_tier", "score", "channels", "final_rank")


def recall_receipts(spark, sf_dir):
    return _recalled(spark, sf_dir).receipts


def recall_page(spark, sf_dir):
    """Pages one to three, each from the cursor of the one before."""
    found, asked = _recalled(spark, sf_dir), recall_requests(spark, sf_dir).withColumn("limit", F.lit(PAGE)).withColumn("cursor", F.lit(None).cast("string"))
    out = None
    for page in range(1, PAGES + 1):
        rows = recall.page_of(found.ranked, asked, POLICY)
        some = rows.select("request_id", F.lit(page).alias("page"), "memory_id", "page_rank", F.col("next_cursor").isNotNull().alias("more"))
        out = some if out is None else out.unionAll(some)
        asked = asked.drop("cursor").join(rows.where("next_cursor IS NOT NULL").select("request_id", F.col("next_cursor").alias("cursor")).distinct(), "request_id")
    return out


def authorised_dense(spark, sf_dir):
    """The nearest memories that each request may see, private and unconfirmed ones among them."""
    held = index(spark, sf_dir)
    vectors = dense.indexed(recall_memories(spark, sf_dir), held.vectors, MODEL)
    asked = recall_requests(spark, sf_dir).join(held.queries, "request_id")
    return dense.authorised_top_k(asked, vectors, TOP, LEAST).drop("updated_at")


def dense_access_coverage(spark, sf_dir):
    asked = recall_requests(spark, sf_dir).withColumn("require_confirmed", F.lit(True)).withColumn("key", F.when(F.col("request_id") % 10 == 0, F.concat(F.lit("src"), F.col("request_id") % 20, F.lit(":en:"), F.col("request_id") % 50)))
    return dense.access_coverage(asked, recall_memories(spark, sf_dir), index(spark, sf_dir).vectors, MODEL, 60)


def _resolved(spark, sf_dir):
    claims = fact_rows(spark, sf_dir).where("doc_id % 7 <> 3")
    return fact_ops.resolve(_recalled(spark, sf_dir).ranked, claims, recall_requests(spark, sf_dir), F.lit(FACT_DAY), GROUP_LIMIT)


def fact_resolution(spark, sf_dir):
    """Ranked memories judged within their groups, of which a bounded number of members is read; some memories have no fact."""
    return _resolved(spark, sf_dir).select("request_id", "memory_id", "status", "usable", "reason", "coverage", "accepted_rank")


def fact_review(spark, sf_dir):
    return fact_ops.review(_resolved(spark, sf_dir)).select("request_id", "accepted", F.array_join(F.transform("omitted", lambda x: F.concat_ws("=", x["memory_id"], x["reason"])), ",").alias("omitted"))


QUERIES = {f.__name__: f for f in (recall_full, recall_receipts, recall_page, authorised_dense, dense_access_coverage, fact_resolution, fact_review)}

_NEAR = "round(greatest(-1, least(1, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6)"
SETUP = f"""WITH {MEMORIES.replace("memories AS", "all_memories AS")}, {REQUESTS.replace("requests AS", "plain AS")},
memories AS (SELECT * REPLACE (user_confirmed AND (doc_id IN (SELECT vec_id FROM embeddings) OR doc_id % 5 = 4) AS user_confirmed) FROM all_memories),
requests AS (SELECT request_id, user_id, agent_id, task_id, include_private, require_confirmed, CAST(NULL AS VARCHAR) AS key, CASE WHEN request_id % 6 = 2 THEN kind END AS kind,
  CASE WHEN request_id % 6 = 4 THEN 'user' WHEN request_id % 6 = 5 THEN 'agent' END AS scope,
  CASE request_id % 6 WHEN 0 THEN key WHEN 1 THEN query[1] || query[3] || query[2] || query[4:] WHEN 2 THEN concat_ws(' ', terms[1], query) WHEN 3 THEN 'zq' || request_id || 'xx' WHEN 4 THEN '' ELSE query END AS query FROM plain)"""
FILTERED = "(r.key IS NULL OR m.memory_key = r.key) AND (r.kind IS NULL OR m.kind = r.kind) AND (r.scope IS NULL OR m.scope = r.scope)"
_TF = """CASE WHEN len(list_filter(range(1, length(term)), lambda i: term[1:i] = term[length(term) - i + 1:])) = 0
  THEN (length(k) + length(v) - length(replace(k, term, '')) - length(replace(v, term, ''))) // length(term)
  ELSE len(list_filter(range(1, length(k) - length(term) + 2), lambda i: substr(k, i, length(term)) = term)) + len(list_filter(range(1, length(v) - length(term) + 2), lambda i: substr(v, i, length(term)) = term)) END"""
_LIMIT = POLICY.candidate_limit


def _channel(name: str, of: str, order: str = "updated_at DESC, memory_id DESC") -> str:
    return f"""{name} AS (SELECT '{name.split('_')[0]}' AS channel, request_id, memory_id, updated_at, rn AS channel_rank, n > {_LIMIT} AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM {of}) WHERE rn <= {_LIMIT})"""


FOUND = f"""{SETUP},
pairs AS (SELECT r.*, m.memory_id, m.memory_key, m.value, m.updated_at FROM requests r JOIN memories m ON {ELIGIBLE} AND {FILTERED}),
{_channel('exact', "(SELECT * FROM pairs WHERE query <> '' AND memory_key = coalesce(key, query) AND (key IS NULL OR key = query))")},
{_channel('structured', "(SELECT * FROM pairs WHERE query <> '' AND (key IS NOT NULL OR kind IS NOT NULL OR scope IS NOT NULL))")},
{_channel('list', "(SELECT * FROM pairs WHERE query = '')")},
wanted AS (SELECT request_id, len(ts) AS n_terms, unnest(ts) AS term FROM (SELECT request_id, list_distinct(string_split(lower(query), ' ')) AS ts FROM requests WHERE query <> '')),
docs AS (SELECT memory_id, lower(memory_key) AS k, lower(value) AS v, greatest(length(memory_key) - 2, 0) + greatest(length(value) - 2, 0) AS dl FROM memories),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
tf AS (SELECT memory_id, term, dl, {_TF} AS tf FROM docs JOIN (SELECT DISTINCT term FROM wanted) ON contains(k, term) OR contains(v, term)),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
scored AS (SELECT w.request_id, t.memory_id, n_terms, count(*) AS met, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf t JOIN idf USING (term) JOIN wanted w USING (term), corpus GROUP BY ALL),
{_channel('full_text', "(SELECT p.*, s.bm25 FROM pairs p JOIN scored s ON s.request_id = p.request_id AND s.memory_id = p.memory_id WHERE met = n_terms)", "bm25, updated_at DESC, memory_id DESC").replace("'full' AS", "'full_text' AS")},
worded AS (SELECT *, list_distinct(string_split(lower(query), ' ')) AS asked, regexp_extract_all(lower(memory_key || ' ' || value), '[a-z0-9]+') AS words FROM pairs
  WHERE regexp_full_match(query, '[a-zA-Z]+( [a-zA-Z]+)*') AND request_id NOT IN (SELECT request_id FROM full_text) AND octet_length(encode(memory_key || ' ' || value)) <= 65536),
missing AS (SELECT request_id, memory_id, updated_at, words, list_filter(asked, lambda t: NOT list_contains(words, t)) AS gone FROM worded WHERE len(words) <= 256 AND len(list_filter(asked, lambda t: length(t) > 32)) = 0),
fixes AS (SELECT request_id, memory_id, updated_at FROM missing WHERE len(gone) = 1 AND length(gone[1]) >= 5
  AND len(list_filter(words, lambda w: regexp_full_match(w, '[a-z]+') AND w <> gone[1] AND abs(length(w) - length(gone[1])) <= 1 AND damerau_levenshtein(gone[1], w) = 1)) > 0),
{_channel('spelling', 'fixes')},
lexical AS (SELECT request_id, count(DISTINCT memory_id) AS lexical FROM (SELECT request_id, memory_id FROM exact UNION ALL SELECT request_id, memory_id FROM full_text UNION ALL SELECT request_id, memory_id FROM spelling) GROUP BY request_id),
population AS (SELECT r.request_id, r.query, m.memory_id, m.updated_at, {_NEAR} AS score, v.vec_id IS NULL AS gap
  FROM (SELECT * REPLACE (true AS require_confirmed) FROM requests) r JOIN memories m ON {ELIGIBLE} AND {FILTERED} LEFT JOIN embeddings v ON v.vec_id = m.doc_id LEFT JOIN embeddings q ON q.vec_id = (r.request_id * 7 + 3) % 500),
tops AS (SELECT request_id, count(*) AS n, count(*) FILTER (gap) AS gaps, max(score) AS top, max(score) FILTER (place = 2) AS second, max(memory_id) FILTER (place = 1) AS memory_id, max(updated_at) FILTER (place = 1) AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, updated_at DESC, memory_id DESC) AS place FROM population) GROUP BY request_id),
judged AS (SELECT r.request_id, t.memory_id, t.updated_at, CASE WHEN coalesce(lexical, 0) > 0 THEN 'lexical_preserved' WHEN coalesce(gaps, 0) > 0 OR n > {POLICY.dense_maximum} THEN 'index_incomplete' WHEN coalesce(n, 0) = 0 THEN 'no_candidates'
  WHEN n < {POLICY.minimum} THEN 'insufficient_comparison' WHEN top < {POLICY.min_score} THEN 'below_similarity' WHEN round(top - second, 6) < {POLICY.min_margin} THEN 'ambiguous_candidates' ELSE 'admitted' END AS reason
  FROM requests r LEFT JOIN lexical USING (request_id) LEFT JOIN tops t USING (request_id) WHERE r.query <> ''),
near AS (SELECT 'dense' AS channel, request_id, memory_id, updated_at, 1 AS channel_rank, false AS truncated FROM judged WHERE reason = 'admitted'),
hits AS (SELECT * FROM exact UNION ALL SELECT * FROM structured UNION ALL SELECT * FROM full_text UNION ALL SELECT * REPLACE ('full_text' AS channel) FROM spelling UNION ALL SELECT * FROM near),
active AS (SELECT request_id, count(DISTINCT channel) AS active FROM hits WHERE channel <> 'structured' GROUP BY request_id),
per AS (SELECT request_id, memory_id, updated_at, max(CASE WHEN channel = 'exact' THEN 1 ELSE 0 END) AS tier, sum(CASE WHEN channel <> 'structured' THEN 1.0::DOUBLE / (60 + channel_rank) ELSE 0 END) AS total,
  max(CASE WHEN channel <> 'structured' THEN 1.0::DOUBLE / (60 + channel_rank) END) AS best, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM hits GROUP BY ALL),
fused AS (SELECT request_id, memory_id, updated_at, tier AS exact_tier, round(CASE WHEN active > 1 THEN total ELSE best END, 8) AS score, channels FROM per JOIN active USING (request_id) WHERE best IS NOT NULL
  UNION ALL SELECT request_id, memory_id, updated_at, 0, 0.0, 'list' FROM list),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY exact_tier DESC, score DESC, updated_at DESC, memory_id DESC) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM fused)"""

_P = "user_id, scope, scope_identity, kind, fact_group, include_private, require_confirmed"
_TEMPORAL = f"CASE WHEN {FACT_DAY} < valid_from THEN 'not_yet_valid' WHEN {FACT_DAY} >= valid_until THEN 'expired' END"
RESOLVED = f"""{FOUND.replace("WITH ", "WITH RECURSIVE ", 1)}, {FACTS.replace("FROM memories)", "FROM all_memories WHERE doc_id % 7 <> 3)")},
placed AS (SELECT DISTINCT k.request_id, k.memory_id, f.user_id, f.scope, f.scope_identity, f.kind, f.fact_group, r.include_private, r.require_confirmed FROM ranked k JOIN facts f USING (memory_id) JOIN requests r ON r.request_id = k.request_id),
touched AS (SELECT DISTINCT {_P} FROM placed),
members AS (SELECT f.*, t.include_private, t.require_confirmed, {_TEMPORAL} AS temporal, row_number() OVER (PARTITION BY f.user_id, f.scope, f.scope_identity, f.kind, f.fact_group, t.include_private, t.require_confirmed ORDER BY f.updated_at DESC, f.memory_id DESC) AS place
  FROM facts f JOIN touched t ON f.user_id = t.user_id AND f.scope = t.scope AND f.scope_identity = t.scope_identity AND f.kind = t.kind AND f.fact_group = t.fact_group
  WHERE (t.include_private OR f.sensitivity <> 'private') AND (NOT t.require_confirmed OR f.user_confirmed)),
sized AS (SELECT *, max(place) OVER (PARTITION BY {_P}) > {GROUP_LIMIT} AS beyond FROM members),
over AS (SELECT DISTINCT {_P} FROM sized WHERE beyond), held AS (SELECT * FROM sized WHERE NOT beyond),
named AS (SELECT {_P}, memory_id, ref.memory_id AS replaces, ref.source_event_id AS event, ref.version AS version FROM (SELECT *, unnest(replaces) AS ref FROM held WHERE temporal IS NULL)),
refs AS (SELECT {', '.join('a.' + c for c in _P.split(', '))}, a.memory_id, a.replaces, b.memory_id IS NOT NULL AS resolved FROM named a LEFT JOIN held b
  ON {' AND '.join(f'a.{c} = b.{c}' for c in _P.split(', '))} AND b.memory_id = a.replaces AND b.source_event_id = a.event AND b.version = a.version),
broken AS (SELECT DISTINCT {_P} FROM refs WHERE NOT resolved), reach AS (SELECT {_P}, memory_id AS a, replaces AS b FROM refs WHERE resolved UNION SELECT {', '.join('r.' + c for c in _P.split(', '))}, r.a, e.replaces FROM reach r JOIN refs e ON {' AND '.join(f'e.{c} = r.{c}' for c in _P.split(', '))} AND e.memory_id = r.b AND e.resolved),
loops AS (SELECT DISTINCT {_P} FROM reach WHERE a = b), gone AS (SELECT DISTINCT {_P}, replaces AS memory_id FROM refs WHERE resolved),
marked AS (SELECT h.*, b.kind IS NOT NULL AS broken, l.kind IS NOT NULL AS cyclic, g.memory_id IS NOT NULL AS replaced FROM held h LEFT JOIN broken b USING ({_P}) LEFT JOIN loops l USING ({_P}) LEFT JOIN gone g USING ({_P}, memory_id)),
judged_facts AS (SELECT *, count(*) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) AS standing, min(fact_value) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) <> max(fact_value) FILTER (temporal IS NULL AND NOT replaced) OVER (PARTITION BY {_P}) AS differ FROM marked),
verdicts AS (SELECT {_P}, memory_id, CASE WHEN temporal IS NOT NULL THEN temporal WHEN broken OR cyclic THEN 'unresolved' WHEN replaced THEN 'superseded' WHEN differ THEN 'conflict' WHEN standing > 1 THEN 'consistent_assertions' ELSE 'active_assertion' END AS status,
  CASE WHEN temporal = 'expired' THEN 'validity_end' WHEN temporal IS NOT NULL THEN 'validity_start' WHEN cyclic THEN 'replacement_cycle' WHEN broken THEN 'unverified_reference' WHEN replaced THEN 'verified_replacement' WHEN differ THEN 'different_visible_values' WHEN standing > 1 THEN 'equal_visible_values' ELSE 'single_visible_assertion' END AS reason FROM judged_facts),
resolved AS (SELECT k.request_id, k.memory_id, k.rn, CASE WHEN p.kind IS NULL THEN 'unannotated' WHEN o.kind IS NOT NULL THEN 'unresolved' ELSE v.status END AS status,
  CASE WHEN p.kind IS NULL THEN 'legacy_unverified' WHEN o.kind IS NOT NULL THEN 'group_budget' ELSE v.reason END AS reason, CASE WHEN p.kind IS NULL THEN 'not_applicable' WHEN o.kind IS NOT NULL THEN 'truncated' ELSE 'visible_filtered_group' END AS coverage
  FROM ranked k LEFT JOIN placed p USING (request_id, memory_id) LEFT JOIN over o USING ({_P}) LEFT JOIN verdicts v USING ({_P}, memory_id)),
final AS (SELECT *, status IN ('unannotated', 'active_assertion', 'consistent_assertions') AS usable FROM resolved)"""

SQL = {
    "fact_resolution": f"""{RESOLVED} SELECT request_id, memory_id, status, usable, reason, coverage, CASE WHEN usable THEN CAST(row_number() OVER (PARTITION BY request_id, usable ORDER BY rn) AS INTEGER) END AS accepted_rank FROM final""",
    "fact_review": f"""{RESOLVED} SELECT request_id, count(*) FILTER (usable) AS accepted, coalesce(string_agg(memory_id || '=' || reason, ',' ORDER BY rn) FILTER (NOT usable), '') AS omitted FROM final GROUP BY request_id""",
    "recall_full": f"{FOUND} SELECT request_id, memory_id, exact_tier, score, channels, CAST(rn AS INTEGER) AS final_rank FROM ranked",
    "recall_receipts": f"""{FOUND}, flags AS (SELECT request_id, bool_or(truncated) AS truncated, count(DISTINCT memory_id) FILTER (channel <> 'structured') AS candidates, bool_or(channel = 'dense') AS d, bool_or(channel NOT IN ('structured', 'dense', 'list')) AS l
  FROM (SELECT * FROM hits UNION ALL SELECT * FROM list) GROUP BY request_id)
  SELECT r.request_id, CASE WHEN query = '' THEN 'list' WHEN d THEN 'dense' WHEN request_id IN (SELECT request_id FROM spelling) THEN 'spelling' WHEN l THEN 'literal' ELSE 'none' END AS stage,
    coalesce(lexical, 0) AS lexical, coalesce(candidates, 0) AS candidates, coalesce(truncated, false) AS truncated, reason AS dense_reason
  FROM requests r LEFT JOIN flags USING (request_id) LEFT JOIN lexical USING (request_id) LEFT JOIN judged USING (request_id)""",
    "recall_page": f"""{FOUND} SELECT request_id, CAST((rn - 1) // {PAGE} + 1 AS INTEGER) AS page, memory_id, CAST((rn - 1) % {PAGE} + 1 AS INTEGER) AS page_rank, n > ((rn - 1) // {PAGE} + 1) * {PAGE} AS more
  FROM ranked WHERE rn <= {PAGE * PAGES}""",
    "authorised_dense": f"""{SETUP}, p AS (SELECT r.request_id, m.memory_id, m.updated_at, {_NEAR} AS score FROM requests r JOIN memories m ON {ELIGIBLE} AND {FILTERED} JOIN embeddings v ON v.vec_id = m.doc_id JOIN embeddings q ON q.vec_id = (r.request_id * 7 + 3) % 500),
  x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, memory_id DESC) AS rn, count(*) OVER (PARTITION BY request_id) AS population, count(*) FILTER (score >= {LEAST}) OVER (PARTITION BY request_id) AS above FROM p)
  SELECT request_id, memory_id, score, CAST(rn AS INTEGER) AS rank, population, above FROM x WHERE rn <= {TOP}""",
    "dense_access_coverage": f"""{SETUP}, p AS (SELECT r.request_id, v.vec_id IS NULL AS gap FROM (SELECT * REPLACE (true AS require_confirmed, CASE WHEN request_id % 10 = 0 THEN 'src' || (request_id % 20) || ':en:' || (request_id % 50) END AS key) FROM requests) r
    JOIN memories m ON {ELIGIBLE} AND {FILTERED} LEFT JOIN embeddings v ON v.vec_id = m.doc_id),
  c AS (SELECT request_id, count(*) AS n, count(*) FILTER (gap) AS missing FROM p GROUP BY request_id)
  SELECT request_id, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, coalesce(missing, 0) = 0 AND coalesce(n, 0) <= 60 AS complete FROM requests LEFT JOIN c USING (request_id)""",
}

"""The dense channel: exhaustive cosine with bounded output, admission, verification, rescue, reordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType

from memloom.functions.shared import in_batches, stored
from memloom.operators.eligibility import visible

#: Queries that are sent to the tasks at once, queries of one product, and numbers of one product.
GROUP_QUERIES, BLOCK_QUERIES, PRODUCT = 16_384, 1024, 1 << 21
LONG_AGO = -(1 << 62)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def norm_check(vectors: DataFrame, tolerance: float = 0.001) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.withColumn("norm", F.round(norm, 5)).withColumn("unit", F.abs(norm - 1) <= tolerance)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query_id, vec_id, score, rank, population, above (vectors at or over ``least``) of the ``k`` nearest vectors. A query never meets itself.

    A vector that is null, zero, not finite or of another length than the queries is no vector: it is in no list and no count; the same
    holds for a query. What is shuffled grows with tasks and queries, not with vectors (see ``_nearest``).
    """
    asked = queries.select("query_id", "embedding")
    parts = _in_groups(asked, vectors.select("vec_id", F.lit(0).cast("bigint").alias("time"), "embedding"), k, least, "query_id", "vec_id", False)
    return _best(parts, k, "query_id", "vec_id").drop("time")


#: What a memory and a request must hold so that one may be checked against the other inside the product.
ACCESS = ["user_id", "scope", "owner_agent_id", "task_id", "sensitivity", "user_confirmed"]
ASKER = ["user_id", "agent_id", "task_id", "include_private", "require_confirmed"]
#: Filters that a request may name (null: none), with the memory's column.
FILTERS = {"key": "memory_key", "kind": "kind", "scope": "scope"}


def authorised_top_k(requests: DataFrame, vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """request_id, memory_id, updated_at, score, rank, population, above: of each request's ``k`` nearest memories that it may see.

    ``requests``: request_id, the columns of ASKER, embedding, and any of FILTERS. ``vectors``: memory_id, updated_at, the columns of ACCESS
    (and those that are filtered), embedding. What a request may not see is masked inside the matrix product, before any list is cut: nobody's rank or count depends on rows
    of others. Ties go to the later, then to the larger id. Vectors as in ``top_k``.
    """
    filters = [c for c in FILTERS if c in requests.columns]
    asked = requests.select("request_id", "embedding", *ASKER, *filters)
    held = vectors.select("memory_id", F.col("updated_at").cast("bigint").alias("time"), "embedding", *ACCESS, *[FILTERS[c] for c in filters if FILTERS[c] not in ACCESS])
    parts = _in_groups(asked, held, k, least, "request_id", "memory_id", True)
    return _best(parts, k, "request_id", "memory_id").withColumnRenamed("time", "updated_at")


def _best(parts: DataFrame, k: int, of: str, what: str) -> DataFrame:
    """The best ``k`` of all tasks, with the sums of their counts."""
    totals = parts.where(F.col(what).isNull()).groupBy(of).agg(F.sum("population").alias("population"), F.sum("above").alias("above"))
    w = Window.partitionBy(of).orderBy(F.desc("score"), F.desc("time"), F.desc(what))
    best = parts.where(F.col(what).isNotNull()).select(of, what, "time", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(totals, of)


def _in_groups(asked: DataFrame, held: DataFrame, k: int, least: float, of: str, what: str, access: bool) -> DataFrame:
    """``_nearest`` of all queries. Queries are sent to the tasks in groups of checked size, each group in a scan of its own; where there are
    several, each group's few rows are stored before the next is sent, so that one group at a time is held."""
    spark = asked.sparkSession
    few = asked.limit(GROUP_QUERIES + 1).collect()
    schema = asked.select(of).schema.add(what, held.schema[what].dataType).add("time", LongType()).add("score", DoubleType()).add("population", LongType()).add("above", LongType())
    scan = lambda shared: in_batches(held, _nearest(shared, k, least, of, what, access, [f.type for f in to_arrow_schema(schema)]), schema)
    if len(few) <= GROUP_QUERIES:
        return scan(spark.sparkContext.broadcast(_asked(few, of, access)))
    groups = -(-asked.count() // (GROUP_QUERIES // 2))
    parts = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64(of), F.lit(groups)) == group).collect()
        shared = spark.sparkContext.broadcast(_asked(rows, of, access))
        found = stored(scan(shared), "nearest")
        shared.unpersist()
        parts = found if parts is None else parts.unionAll(found)
    return parts


def _asked(rows: list, of: str, access: bool) -> dict:
    """The queries of a group as one matrix of unit rows beside their access columns."""
    good = [r for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    sizes = {len(r.embedding) for r in good}
    if len(sizes) > 1:
        raise ValueError(f"queries of several lengths: {sorted(sizes)}")
    x = np.array([r.embedding for r in good], dtype=np.float64).reshape(len(good), max(sizes, default=0))
    out = {"ids": [r[of] for r in good], "matrix": x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(good) else x}
    return out | {c: [r[c] for r in good] for c in (*ASKER, *FILTERS) if access and rows and c in rows[0]}


def _codes(known: dict, values: list) -> np.ndarray:
    """A number for each value; -1 for null and for what isn't known."""
    return np.array([known.get(v, -1) if v is not None else -1 for v in values], dtype=np.int64)


def _seen(asked: dict, block: slice, batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """Which of a block's requests may see which rows of a batch."""
    of = lambda c: batch.column(c).take(pa.array(rows)).to_pylist()

    def same(mine: str, theirs: str) -> np.ndarray:
        known = {v: i for i, v in enumerate(dict.fromkeys(v for v in asked[mine] if v is not None))}
        a, b = _codes(known, asked[mine][block]), _codes(known, of(theirs))
        return (a[:, None] == b[None, :]) & (a >= 0)[:, None]

    scope = np.array(of("scope"), dtype=object)
    private, confirmed = np.array([v != "public" for v in of("sensitivity")]), np.array([v is True for v in of("user_confirmed")])
    may = lambda c: np.array([v is True for v in asked[c][block]], dtype=bool)[:, None]
    place = (scope == "user")[None, :] | ((scope == "agent")[None, :] & same("agent_id", "owner_agent_id")) | ((scope == "task")[None, :] & same("task_id", "task_id"))
    for mine, theirs in FILTERS.items():
        if mine in asked:
            place = place & (same(mine, theirs) | np.array([v is None for v in asked[mine][block]])[:, None])
    return same("user_id", "user_id") & place & (may("include_private") | ~private[None, :]) & (~may("require_confirmed") | confirmed[None, :])


def _nearest(shared, k: int, least: float, of: str, what: str, access: bool, types: list[pa.DataType]):
    """For each query the best ``k`` rows of a task, and how many it was held against, passed on when the task's vectors are through: rows
    out of a task are queries x (k + 1) at most, whatever the number of its vectors. One block of the product has PRODUCT numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        q, width = asked["matrix"], asked["matrix"].shape[1]
        n = len(q)
        population, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best: list[list[tuple]] = [[] for _ in range(n)]
        own = np.array(asked["ids"], dtype=object)
        for batch in batches:
            lists = batch.column("embedding")
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int64)
            if not len(fits):
                continue
            x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            fits, x = fits[good], x[good] / norm[good, None]
            ids = batch.column(what).take(pa.array(fits)).to_pylist()
            times = [t if t is not None else LONG_AGO for t in batch.column("time").take(pa.array(fits)).to_pylist()]
            # Columns in the order in which ties are decided.
            order = sorted(range(len(fits)), key=lambda i: (times[i], ids[i]), reverse=True)
            fits, x, ids, times = fits[order], x[order], np.array([ids[i] for i in order], dtype=object), np.array([times[i] for i in order], dtype=np.int64)
            for low in range(0, n, BLOCK_QUERIES):
                block = slice(low, min(low + BLOCK_QUERIES, n))
                step = max(1, PRODUCT // (block.stop - low))
                for at in range(0, len(fits), step):
                    part = slice(at, at + step)
                    s = np.round(np.clip(q[block] @ x[part].T, -1, 1), 6)
                    met = _seen(asked, block, batch, fits[part]) if access else own[block, None] != ids[None, part]
                    population[block] += met.sum(axis=1)
                    above[block] += (met & (s >= least)).sum(axis=1)
                    s = np.where(met, s, -np.inf)
                    bound = np.array([b[-1][0] if len(b) >= k else -2.0 for b in best[block]])
                    better = np.flatnonzero(s.max(axis=1) >= bound)
                    for row, near in zip(better.tolist(), np.argsort(-s[better], axis=1, kind="stable")[:, :k], strict=True):
                        near = near[s[row, near] >= bound[row]]
                        more = list(zip(s[row, near].tolist(), times[part][near].tolist(), ids[part][near].tolist(), strict=True))
                        best[low + row] = sorted(best[low + row] + more, reverse=True)[:k]
        flat = [x for b in best for x in b]
        of_flat = [i for i, b in zip(asked["ids"], best, strict=True) for _ in b]
        none, all_ = [None] * n, [None] * len(flat)
        columns = [of_flat + asked["ids"], [x[2] for x in flat] + none, [x[1] for x in flat] + none, [x[0] for x in flat] + none, all_ + population.tolist(), all_ + above.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[of, what, "time", "score", "population", "above"])

    return run


def admission(ranked: DataFrame, queries: DataFrame, min_score: float, min_margin: float, minimum: int) -> DataFrame:
    """One decision a query (query_id, lexical_matches, model_ready, complete): why nothing is admitted, or the one vector that is."""
    tops = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
                                          F.max(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("first"), F.count("*").alias("n"))
    j = queries.join(tops, "query_id", "left")
    margin = F.round(F.col("top") - F.col("second"), 6)
    reason = (F.when(F.col("lexical_matches") > 0, "lexical_preserved").when(~F.col("model_ready"), "model_not_ready").when(~F.col("complete"), "comparison_incomplete")
              .when(F.coalesce("n", F.lit(0)) == 0, "no_candidates").when(F.col("n") < minimum, "insufficient_comparison").when(F.col("top") < min_score, "below_similarity")
              .when(margin < min_margin, "ambiguous_candidates").otherwise("admitted"))
    return j.select("query_id", reason.alias("reason"), "top", margin.alias("margin"), F.when(reason == "admitted", F.col("first")).alias("admitted_id"))


def access_coverage(requests: DataFrame, current: DataFrame, vectors: DataFrame, model: str, maximum: int) -> DataFrame:
    """request_id, n, missing, complete: confirmed memories that a request may see, and those of them without a vector of their version.

    Memories are counted by what access depends on before they meet requests, so requests are held against few rows, not against memories.
    """
    have = vectors.where(F.col("model") == model).select(*VERSION).distinct().withColumn("has", F.lit(True))
    filters = [c for c in FILTERS if c in requests.columns]
    kinds = list(dict.fromkeys([c for c in ACCESS if c != "user_confirmed"] + [FILTERS[c] for c in filters if c != "key"]))
    held = current.where("user_confirmed").select(*VERSION, "user_confirmed", *kinds, *["memory_key" for c in filters if c == "key"]).join(have, VERSION, "left").withColumn("none", F.col("has").isNull().cast("bigint"))
    counted = held.groupBy(*kinds).agg(F.count("*").alias("n"), F.sum("none").alias("missing")).withColumn("user_confirmed", F.lit(True))
    on = (F.col("r.user_id") == F.col("m.user_id")) & visible()
    for c in filters:
        if c != "key":
            on &= F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"m.{FILTERS[c]}"))
    sum_of = lambda met: met.groupBy("r.request_id").agg(*[F.coalesce(F.sum(f"m.{c}"), F.lit(0)).alias(c) for c in ("n", "missing")])
    if "key" in filters:  # few memories have a key
        keyed = held.withColumn("n", F.lit(1)).withColumnRenamed("none", "missing")
        sums = sum_of(requests.where("key IS NULL").alias("r").join(counted.alias("m"), on, "left")).unionAll(
            sum_of(requests.where("key IS NOT NULL").alias("r").join(keyed.alias("m"), on & (F.col("r.key") == F.col("m.memory_key")), "left")))
    else:
        sums = sum_of(requests.alias("r").join(counted.alias("m"), on, "left"))
    return sums.withColumn("complete", (F.col("missing") == 0) & (F.col("n") <= maximum))


def revision(vectors: DataFrame) -> DataFrame:
    """One row, n and digest, that changes with any vector's version, whatever the order of rows."""
    return vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*VERSION, "model").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def retrieve(requests: DataFrame, current: DataFrame, vectors: DataFrame, model: str, mode: str = "miss_only", min_score: float = 0.0, min_margin: float = 0.02, minimum: int = 2,
             maximum: int = 10_000, top: int = 100, now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense channel: hits (request_id, memory_id, updated_at, channel_rank, score, limit, truncated) and why each request has them or not
    (request_id, reason, population, top, margin).

    ``requests``: request_id, query, limit, lexical_matches, embedding and the columns of ASKER; only confirmed memories count whatever they
    ask for. ``miss_only`` leaves requests with lexical matches alone and admits the nearest memory where it is near and far enough from the
    next; ``hybrid`` takes all at or over ``min_score``. A population with a memory that lacks its vector, or over ``maximum``, is not
    compared. ``now``: the vectors as they are after the comparison; where their revision is another, nothing found counts.
    """
    asked = requests.withColumn("require_confirmed", F.lit(True))
    early = F.when(F.lit(mode == "miss_only") & (F.col("lexical_matches") > 0), "lexical_preserved").when(F.coalesce(F.trim("query"), F.lit("")) == "", "empty_query")
    covered = asked.join(access_coverage(asked, current, vectors, model, maximum), "request_id").withColumn("early", early.when(~F.col("complete"), "index_incomplete").when(F.col("n") == 0, "no_candidates"))
    held = indexed(current, vectors, model)
    ranked = authorised_top_k(covered.where("early IS NULL"), held, top, min_score)
    first = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    tops = ranked.groupBy("request_id").agg(first(1, "score").alias("top"), first(2, "score").alias("second"), F.count("*").alias("compared"), F.max("above").alias("above"))
    margin = F.round(F.col("top") - F.col("second"), 6)
    gate = (F.when(F.col("early").isNotNull(), F.col("early")).when(F.coalesce("compared", F.lit(0)) < minimum, "insufficient_comparison").when(F.col("top") < min_score, "below_similarity"))
    why = gate.when(margin < min_margin, "ambiguous_candidates").otherwise("admitted") if mode == "miss_only" else gate.otherwise("admitted")
    judged = covered.join(tops, "request_id", "left").withColumn("reason", why).withColumn("margin", margin)
    if now is not None:
        both = revision(vectors).select(F.struct("n", "digest").alias("a")).join(revision(now).select(F.struct("n", "digest").alias("b")))
        judged = judged.join(F.broadcast(both)).withColumn("reason", F.when((F.col("reason") == "admitted") & (F.col("a") != F.col("b")), "index_changed").otherwise(F.col("reason")))
    kept = ranked.join(judged.where("reason = 'admitted'").select("request_id", "limit", F.col("above").alias("reached")), "request_id")
    kept = kept.where("rank = 1") if mode == "miss_only" else kept.where((F.col("score") >= min_score) & (F.col("rank") <= F.col("limit")))
    more = F.lit(False) if mode == "miss_only" else F.col("reached") > F.col("limit")
    hits = kept.select("request_id", "memory_id", "updated_at", F.col("rank").alias("channel_rank"), "score", "limit", more.alias("truncated"))
    return hits, judged.select("request_id", "reason", F.col("n").alias("population"), "top", "margin")


def hybrid(ranked: DataFrame, min_score: float, limit: int) -> DataFrame:
    return ranked.where((F.col("score") >= min_score) & (F.col("rank") <= limit))


def pair_verdict(entailment: Column, contradiction: Column, max_contradiction: float, min_entailment: float) -> Column:
    return F.when(contradiction >= max_contradiction, "contradictory_pair").when(entailment < min_entailment, "insufficient_pair_support").otherwise("verified_pair")


def rescue(window: DataFrame, limit: int, min_score: float) -> DataFrame:
    """One decision a query over its ranked window (query_id, vec_id, rank, score, forward, backward, lexical_matches)."""
    first = F.col("rank") == 1
    flags = window.where(F.col("rank") <= limit).groupBy("query_id").agg(
        F.max(F.when(first, F.col("score"))).alias("top"), F.max(F.when(first, F.col("forward"))).alias("verdict"), F.max(F.when(first, F.col("vec_id"))).alias("first_id"), F.max("lexical_matches").alias("lexical"),
        F.count_if((F.col("forward") == "verified_pair") & (F.col("backward") == "verified_pair")).alias("mutual"), F.max(F.when((F.col("forward") == "verified_pair") & (F.col("backward") == "verified_pair"), F.col("vec_id"))).alias("mutual_id"))
    gate = F.col("top") >= min_score
    reason = (F.when(gate & (F.col("verdict") == "verified_pair"), "score_gate_preserved").when(gate & (F.col("verdict") == "contradictory_pair"), "top_contradiction").when(F.col("lexical") > 0, "lexical_preserved")
              .when(F.col("verdict") == "contradictory_pair", "top_contradiction").when(F.col("mutual") == 1, "unique_mutual_support").when(F.col("mutual") > 1, "ambiguous_mutual_support").otherwise("no_mutual_support"))
    return flags.select("query_id", reason.alias("reason"), F.when(reason == "score_gate_preserved", F.col("first_id")).when(reason == "unique_mutual_support", F.col("mutual_id")).alias("accepted_id"))


def reorder(window: DataFrame, limit: int) -> DataFrame:
    """The window of ``limit`` by relevance, then cosine, then recency (here: the larger id)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("score"), F.desc("vec_id"))
    return window.where(F.col("rank") <= limit).withColumn("new_rank", F.row_number().over(w))


def pending(current: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows without a vector of exactly their version."""
    return current.join(indexed.select(*keys), keys, "left_anti")


VERSION = ["memory_id", "source_event_id", "version"]


def indexed(current: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``current`` memories with their vector: one of exactly that source event and version, made by ``model``."""
    return current.join(vectors.where(F.col("model") == model).drop("model"), VERSION)


def coverage(population: DataFrame, vectors: DataFrame, model: str, maximum: int, by: list[str]) -> DataFrame:
    """``by``, n, missing, complete: whether every memory of a population has its vector and there are at most ``maximum``."""
    have = vectors.where(F.col("model") == model).select(*VERSION).distinct().withColumn("has", F.lit(True))
    counted = population.join(have, VERSION, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("missing"))
    return counted.withColumn("complete", (F.col("missing") == 0) & (F.col("n") <= maximum))


def commits(tasks: DataFrame, current: DataFrame, jobs: DataFrame) -> DataFrame:
    """``tasks`` (user_id, memory_id, source_event_id, version, model) with ``committed``: the memory is still that version, confirmed, and its job open."""
    live = current.where("user_confirmed").select("user_id", *VERSION).join(jobs.select("memory_id", "model").distinct(), "memory_id").withColumn("committed", F.lit(True))
    return tasks.join(live, ["user_id", *VERSION, "model"], "left").fillna(False, ["committed"])


def sync_counts(tasks: DataFrame, most: int) -> DataFrame:
    """What one run a user over the oldest ``most`` tasks does, which stops at the first failure. ``tasks``: user_id, memory_id,
    updated_at, outcome (indexed, stale, failed: what the model and the commit would give)."""
    w = Window.partitionBy("user_id").orderBy("updated_at", "memory_id")
    first = tasks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    stop = first.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("outcome") == "failed", F.col("place"))), F.lit(most)).alias("stop"))
    ran = first.join(stop, "user_id").where("place <= stop").groupBy("user_id").agg(F.count("*").alias("attempted"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("indexed", "stale", "failed")])
    total = tasks.groupBy("user_id").agg(F.count("*").alias("total"))
    return ran.join(total, "user_id").select("user_id", "attempted", "indexed", "stale", "failed", F.least(F.lit(most), F.col("total") - F.col("indexed")).alias("remaining"))


def hydration(references: DataFrame, current: DataFrame, most: int = 100) -> DataFrame:
    """request_id, n, found, valid: at most ``most`` distinct references a request, each still of its version."""
    have = current.select(*VERSION).withColumn("has", F.lit(True))
    counted = references.join(have, VERSION, "left").groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("ids"), F.count_if("has").alias("found"))
    return counted.select("request_id", "n", "found", ((F.col("n") <= most) & (F.col("ids") == F.col("n")) & (F.col("found") == F.col("n"))).alias("valid"))


def route(baseline: Column, reranked: Column) -> Column:
    """Which selection counts: a rejection by reranking keeps what was verified before."""
    return F.when(reranked.isNotNull() | baseline.isNull(), "reranked").otherwise("baseline")


def embedding_text(value: Column) -> Column:
    """A JSON string's content, or the JSON of any other value."""
    return F.coalesce(F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]), value)

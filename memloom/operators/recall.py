"""Recall in stages: literal channels, then spelling, then vectors, each for the requests that the one before left without a hit.

One pass over the texts finds what both lexical stages need: occurrences of all terms (one automaton), words of the text that are terms, and
words one edit away from a term. Its hits are stored; everything after joins hits to requests. Exact and structured channels don't read
texts at all.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from memloom.functions.shared import delete_stored, in_batches, stored
from memloom.operators import channels, dense, ranking
from memloom.operators.channels import BM25_B, BM25_K1, LEAST_IDF, LEAST_TERM, LEAST_WORD, MOST_LIMIT, MOST_TERM_CHARS, MOST_TERMS, MOST_TEXT_BYTES, MOST_TEXT_WORDS, MOST_WORD, recency, top_k
from memloom.operators.eligibility import MOST_BROADCAST_REQUESTS, visible

try:
    import ahocorasick
except ImportError:  # terms are looked for one by one then
    ahocorasick = None

# Candidates of a channel, terms of a query, and the default of a page.
CANDIDATE_LIMIT, MOST_QUERY_TERMS, PAGE = 50, 32, 10
SHARED = ["memory_id", "updated_at", "user_id", "scope", "owner_agent_id", "task_id", "sensitivity", "user_confirmed", "memory_key", "kind"]
ASKED = ["request_id", "user_id", "agent_id", "task_id", "include_private", "require_confirmed", "key", "kind", "scope"]


@dataclass(frozen=True)
class RecallPolicy:
    """How candidates are found and ranked."""

    candidate_limit: int = CANDIDATE_LIMIT
    rrf_k: int = 60
    fusion: str = "rrf"
    exact_precedence: bool = True
    spelling: bool = True
    dense_mode: str = "miss_only"
    min_score: float = 0.0
    min_margin: float = 0.02
    minimum: int = 2
    dense_maximum: int = 10_000

    def fingerprint(self) -> str:
        return "|".join(f"{k}={v}" for k, v in sorted(vars(self).items()))


@dataclass(frozen=True)
class VectorIndex:
    """Vectors of memories (memory_id, source_event_id, version, model, embedding) and those of requests (request_id, embedding)."""

    vectors: DataFrame
    queries: DataFrame
    model: str


@dataclass(frozen=True)
class Recalled:
    """``ranked``: request_id, memory_id, updated_at, exact_tier, score, channels, final_rank, stage. ``receipts``: request_id, stage, lexical
    (distinct memories of exact and full text), candidates, truncated, dense_reason. ``hits``: the channels' rows."""

    ranked: DataFrame
    receipts: DataFrame
    hits: DataFrame


def matches_filters() -> Column:
    """The equality filters that a request names on key, kind and scope."""
    same = lambda r, m: F.col(f"r.{r}").isNull() | (F.col(f"r.{r}") == F.col(f"m.{m}"))
    return same("key", "memory_key") & same("kind", "kind") & same("scope", "scope")


def may_see() -> Column:
    return (F.col("r.user_id") == F.col("m.user_id")) & visible() & matches_filters()


def prepared(requests: DataFrame, limit: int) -> DataFrame:
    """The columns of ASKED with the trimmed query, its terms, those of the spelling fallback (null: it may not be corrected) and the limit.
    More than MOST_QUERY_TERMS terms raise."""
    have = requests.columns
    query = F.coalesce(F.trim(F.regexp_replace("query", r"\s+", " ")), F.lit(""))
    rows = requests.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ASKED], query.alias("query"), F.lit(limit).alias("limit"))
    terms = channels.query_terms(F.col("query"))
    bounded = F.when(F.size(terms) > MOST_QUERY_TERMS, F.raise_error(F.lit("Candidate query exceeds the term budget")).cast("array<string>")).otherwise(terms)
    return rows.withColumn("terms", bounded).withColumn("worded", channels.fallback_terms(F.col("query")))


def edit_between(query: str, word: str) -> str | None:
    """insert, delete, substitute or transpose where ``word`` is one edit from ``query``."""
    n, m = len(query), len(word)
    if query == word or abs(n - m) > 1:
        return None
    i = next((i for i, (a, b) in enumerate(zip(query, word, strict=False)) if a != b), min(n, m))
    if n == m:
        if query[i + 1:] == word[i + 1:]:
            return "substitute"
        return "transpose" if query[i:i + 2] == word[i:i + 2][::-1] and query[i + 2:] == word[i + 2:] else None
    return ("delete" if query[i + 1:] == word[i:] else None) if n > m else ("insert" if word[i + 1:] == query[i:] else None)


def shortened(word: str) -> set[str]:
    """The word, and it without each one letter: words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1:] for i in range(len(word)))}


def _short_terms(sets: list[list[str]]) -> Callable[[str, str, set[str]], set[str]]:
    """For a text and the longer terms that it holds: the short terms of those of ``sets`` of which it holds all."""
    by_long: dict[str | None, list[tuple[frozenset[str], frozenset[str]]]] = {}
    for terms in {frozenset(s) for s in sets if s and all(s)}:
        long = frozenset(t for t in terms if len(t) >= LEAST_TERM)
        if long != terms:
            by_long.setdefault(min(long, default=None), []).append((long, terms - long))

    def held(k: str, v: str, met: set[str]) -> set[str]:
        out: set[str] = set()
        seen = functools.cache(lambda t: t in k or t in v)
        for one in (None, *met):
            for long, short in by_long.get(one, ()):
                if long <= met and all(map(seen, short)):
                    out |= short
        return out

    return held


def _scan(listed: list[tuple[str, bool]], keep: list[str], types: list[pa.DataType], sets: list[list[str]] | None = None):
    """With ``sets``, which terms are asked for together, a text's short terms are told only where it holds all of a set, and once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [t for t, _ in listed]
        place = {t: i for i, t in enumerate(names)}
        worded = {t for t, w in listed if w}
        forms: dict[str, list[str]] = {}
        for t in worded:
            if len(t) >= LEAST_WORD:
                for f in shortened(t):
                    forms.setdefault(f, []).append(t)
        counted = {t: i for t, i in place.items() if sets is None or len(t) >= LEAST_TERM}
        short = _short_terms(sets) if sets is not None else None
        if ahocorasick and counted:
            found = ahocorasick.Automaton()
            for t, i in counted.items():
                found.add_word(t, i)
            found.make_automaton()
            occurring = lambda text: Counter(i for _, i in found.iter(text))
        else:
            occurring = lambda text: Counter({i: n for t, i in counted.items() if (n := sum(text.startswith(t, at) for at in range(len(text))))})

        @functools.lru_cache(1 << 16)
        def near(word: str) -> list[tuple[int, str]]:
            return sorted({(place[t], e) for f in shortened(word) for t in forms.get(f, ()) if (e := edit_between(t, word))})

        for batch in batches:
            rows, codes, tfs, tokens, fixes, edits = [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("__k", "__v", "__bytes")]
            for row, (k, v, size) in enumerate(zip(*columns, strict=True)):
                met = occurring(k)
                met.update(occurring(v))
                if short:
                    met.update(place[t] for t in short(k, v, {names[i] for i in met}))
                held: dict[int, list] = {i: [float(n), False, None, None] for i, n in met.items()}
                if worded and size <= MOST_TEXT_BYTES:
                    listed_words = re.findall("[a-z0-9]+", f"{k} {v}")
                    own = set(listed_words) if len(listed_words) <= MOST_TEXT_WORDS else set()
                    for w in own & worded:
                        held.setdefault(place[w], [0.0, False, None, None])[1] = True
                    for w in own:
                        if LEAST_WORD - 1 <= len(w) <= MOST_WORD + 1 and w.isalpha():
                            for i, e in near(w):
                                x = held.setdefault(i, [0.0, False, None, None])
                                if x[2] is None or w < x[2]:
                                    x[2:] = w, e
                for i, (tf, token, fix, edit) in held.items():
                    rows.append(row)
                    codes.append(i)
                    tfs.append(tf)
                    tokens.append(token)
                    fixes.append(fix)
                    edits.append(edit)
            # A last row of the batch without a memory: how many texts there were, and how long.
            kept = [pa.chunked_array([c, pa.nulls(1, c.type)]).combine_chunks() for c in batch.select(keep).take(pa.array(rows, pa.int64())).columns]
            lengths = sum(batch.column("dl").to_pylist())
            kept[keep.index("dl")] = pa.concat_arrays([batch.column("dl").take(pa.array(rows, pa.int64())), pa.array([lengths], batch.schema.field("dl").type)])
            more = [pa.array([names[i] for i in codes] + [None], types[0]), pa.array(tfs + [float(batch.num_rows)], types[1]), pa.array(tokens + [None], types[2]), pa.array(fixes + [None], types[3]), pa.array(edits + [None], types[4])]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*keep, "term", "tf", "token", "fix", "edit"])

    return run


def text_hits(memories: DataFrame, terms: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The columns of SHARED and dl, with term, tf (overlapping occurrences in key and value), token (the term is a word of them), fix and edit
    (the first word in order that is one edit away); and for each batch a row of null memory_id with its number of texts (tf) and their length (dl).

    ``terms``: term, worded (words count beside occurrences). Terms go to every task in groups of checked number and size, each
    group in one pass over the texts; one group is the rule. ``sets`` (terms, an array: those that must all occur for a hit to count, of terms
    that are not worded) spares rows: short terms, which are in nearly every text, are told only where a whole set occurs, with a tf of 1.
    """
    size = F.greatest(F.coalesce(F.length("memory_key"), F.lit(0)) - 2, F.lit(0)) + F.greatest(F.coalesce(F.length("value"), F.lit(0)) - 2, F.lit(0))
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    texts = memories.select(*SHARED, size.cast("bigint").alias("dl"), lower("memory_key").alias("__k"), lower("value").alias("__v"), F.octet_length(F.concat_ws(" ", "memory_key", "value")).alias("__bytes"))
    distinct = terms.where(F.length("term") > 0).groupBy("term").agg(F.max("worded").alias("worded"))
    few = distinct.limit(MOST_TERMS + 1).collect()
    keep = [*SHARED, "dl"]
    schema = StructType([StructField(f.name, f.dataType) for f in texts.select(*keep).schema])  # all may be null
    more = {"term": StringType(), "tf": DoubleType(), "token": BooleanType(), "fix": StringType(), "edit": StringType()}
    for name, kind in more.items():
        schema = schema.add(name, kind)
    types = [pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string()]
    group_rows = [[(r.term, r.worded) for r in few]]
    if len(few) > MOST_TERMS or sum(len(r.term) for r in few) > MOST_TERM_CHARS:
        n, chars = distinct.agg(F.count("*"), F.sum(F.length("term"))).first()
        groups = 1 + max(2 * n // MOST_TERMS, 2 * chars // MOST_TERM_CHARS)
        group_rows = ([(r.term, r.worded) for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).collect()] for g in range(groups))
        sets = None
    together = [r.terms for r in sets.distinct().limit(MOST_TERMS + 1).collect()] if sets is not None else None
    together = together if together is not None and len(together) <= MOST_TERMS else None
    scans = [in_batches(texts, _scan(sorted(rows), keep, types, together), schema) for rows in group_rows]
    out = scans[0]
    for i, s in enumerate(scans[1:]):  # texts are counted once
        out = out.unionAll(s.where("memory_id IS NOT NULL"))
    return out


def full_text(hits: DataFrame, asked: DataFrame, hint) -> DataFrame:
    """BM25 over stored hits: request_id, memory_id, updated_at, limit, channel_rank, truncated, score. All terms must occur; those of fewer than
    LEAST_TERM characters have no score. Statistics cover every memory, whoever may see it."""
    corpus = hits.where("memory_id IS NULL").agg(F.sum("tf").alias("n"), (F.sum("dl") / F.sum("tf")).alias("avgdl"))
    literal = hits.where("memory_id IS NOT NULL AND tf > 0")
    df = literal.where(F.length("term") >= LEAST_TERM).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(corpus)).select("term", "avgdl", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    wanted = asked.select(*ASKED, "limit", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    seen = literal.alias("m").join(hint(wanted).alias("r"), (F.col("m.term") == F.col("r.term")) & may_see()).select("r.request_id", "r.limit", "r.n_terms", "m.memory_id", "m.updated_at", "m.term", "m.tf", "m.dl")
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    scored = seen.join(weights, "term", "left").groupBy("request_id", "memory_id", "limit", "n_terms", "updated_at").agg(F.count("*").alias("met"), F.round(-F.sum(part), 6).alias("score"))
    return top_k(scored.where("met = n_terms").select("request_id", "limit", "memory_id", "updated_at", "score"), [F.asc("score"), *recency()])


def spelled(hits: DataFrame, asked: DataFrame, hint) -> DataFrame:
    """Memories that hold, as words, all terms of a request but one, and of that one a word one edit away; by recency. As ``full_text``, with query_token, matched_token, edit."""
    wanted = asked.where("worded IS NOT NULL").select(*ASKED, "limit", F.size("worded").alias("n_terms"), F.explode("worded").alias("term"))
    near = hits.where("memory_id IS NOT NULL AND (token OR fix IS NOT NULL)")
    met = near.alias("m").join(hint(wanted).alias("r"), (F.col("m.term") == F.col("r.term")) & may_see()).select("r.request_id", "r.limit", "r.n_terms", "m.memory_id", "m.updated_at", "m.term", "m.token", "m.fix", "m.edit")
    fix = F.max(F.when(~F.col("token"), F.struct("term", "fix", "edit")))
    per = met.groupBy("request_id", "memory_id", "limit", "n_terms", "updated_at").agg(F.count_if("token").alias("tokens"), fix.alias("x"))
    found = per.where("tokens = n_terms - 1 AND x IS NOT NULL").select("request_id", "limit", "memory_id", "updated_at", F.col("x.term").alias("query_token"), F.col("x.fix").alias("matched_token"), F.col("x.edit").alias("edit"))
    return top_k(found)


def listed(asked: DataFrame, memories: DataFrame, hint) -> DataFrame:
    """What a request without a query sees: all that it may, by recency."""
    rows = memories.select(*SHARED).alias("m").join(hint(asked).alias("r"), may_see()).select("r.request_id", "r.limit", "m.memory_id", "m.updated_at")
    return top_k(rows)


def lookups(asked: DataFrame, memories: DataFrame, hint) -> tuple[DataFrame, DataFrame]:
    """The exact channel (the key, or the query as a key; not where both are given and differ) and the structured one (any filter given)."""
    slim = memories.select(*SHARED)
    named = F.coalesce("key", "query")
    keyed = asked.where(F.col("key").isNull() | (F.col("key") == F.col("query"))).withColumn("named", named)
    fields = ["r.request_id", "r.limit", "m.memory_id", "m.updated_at"]
    exact = slim.alias("m").join(hint(keyed).alias("r"), (F.col("m.memory_key") == F.col("r.named")) & may_see()).select(*fields)
    filtered = asked.where("key IS NOT NULL OR kind IS NOT NULL OR scope IS NOT NULL")
    structured = slim.alias("m").join(hint(filtered).alias("r"), may_see()).select(*fields)
    return top_k(exact), top_k(structured)


def _unfiltered(requests: DataFrame, *more: Column) -> tuple[DataFrame, object]:
    """Requests whose key, kind and scope are no filters, stored, with ``more``; and a hint to broadcast them where they are few."""
    none = [F.lit(None).cast("string").alias(c) for c in ("key", "kind", "scope")]
    asked = stored(requests.select(*ASKED[:6], *none, "limit", *more), "asked")
    return asked, F.broadcast if asked.limit(MOST_BROADCAST_REQUESTS + 1).count() <= MOST_BROADCAST_REQUESTS else lambda df: df


def bm25(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """The full-text channel alone, for the ``terms`` of requests (see ``full_text``)."""
    asked, hint = _unfiltered(requests, F.array_distinct(F.transform("terms", lambda t: F.lower(t))).alias("terms"))
    hits = stored(text_hits(memories, asked.select(F.explode("terms").alias("term"), F.lit(False).alias("worded")), asked.select("terms")), "texthits")
    return full_text(hits, asked, hint)


def substring(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """The whole query as a substring of key or value, by recency: one pass over each text finds all queries."""
    asked, hint = _unfiltered(requests.where("query <> ''"), F.lower("query").alias("term"))
    hits = text_hits(memories, asked.select("term", F.lit(False).alias("worded"))).where("memory_id IS NOT NULL")
    met = hits.alias("m").join(hint(asked).alias("r"), (F.col("m.term") == F.col("r.term")) & may_see())
    return top_k(met.select("r.request_id", "r.limit", "m.memory_id", "m.updated_at"))


def spelling(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """The spelling fallback alone: for requests that full text leaves without a hit (see ``spelled``)."""
    worded = channels.fallback_terms(F.col("query"))
    asked, hint = _unfiltered(requests.where(worded.isNotNull()), worded.alias("terms"), worded.alias("worded"))
    hits = stored(text_hits(memories, asked.select(F.explode("terms").alias("term"), F.lit(True).alias("worded"))), "texthits")
    missed = asked.join(full_text(hits, asked, hint).select("request_id").distinct(), "request_id", "left_anti")
    return spelled(hits, missed, hint)


def recall(requests: DataFrame, memories: DataFrame, policy: RecallPolicy | None = None, index: VectorIndex | None = None) -> Recalled:
    """Ranked memories of each request (request_id, query, the columns of dense.ASKER; key, kind and scope where it filters).

    A request with a query goes through the literal channels; where full text has none, through spelling; where no lexical channel has any
    and there is an ``index``, through vectors. A request without one lists what it may see by recency. A null query is blank. Requests are
    few beside memories: their table is stored and its rows counted once, and beyond MOST_BROADCAST_REQUESTS it is joined by shuffle.
    """
    policy = policy or RecallPolicy()
    if not 1 <= policy.candidate_limit <= MOST_LIMIT:
        raise ValueError(f"candidate_limit is not within 1 to {MOST_LIMIT}")
    all_asked = stored(prepared(requests, policy.candidate_limit), "asked")
    few = all_asked.limit(MOST_BROADCAST_REQUESTS + 1).count() <= MOST_BROADCAST_REQUESTS
    hint = F.broadcast if few else lambda df: df
    asked, blank = all_asked.where("query <> ''"), all_asked.where("query = ''")

    words = asked.select(F.explode("terms").alias("term"), (F.col("worded").isNotNull() & F.lit(policy.spelling)).alias("worded"))
    hits = stored(text_hits(memories, words), "texthits")
    exact, structured = lookups(asked, memories, hint)
    out = ["request_id", "channel", "channel_rank", "memory_id", "updated_at", "limit", "truncated", "stage"]
    as_channel = lambda df, name, stage: df.select("request_id", F.lit(name).alias("channel"), "channel_rank", "memory_id", "updated_at", "limit", "truncated", F.lit(stage).alias("stage")).select(*out)
    literal = stored(as_channel(exact, "exact", "literal").unionAll(as_channel(structured, "structured", "literal")).unionAll(as_channel(full_text(hits, asked, hint), "full_text", "literal"))
                     .unionAll(as_channel(listed(blank, memories, hint), "list", "list")), "literal")
    found = literal
    if policy.spelling:
        missed = asked.join(literal.where("channel = 'full_text'").select("request_id").distinct(), "request_id", "left_anti")
        found = found.unionAll(stored(as_channel(spelled(hits, missed, hint), "full_text", "spelling"), "spelled"))
    delete_stored(hits)
    lexical = found.where("channel IN ('exact', 'full_text')").groupBy("request_id").agg(F.countDistinct("memory_id").alias("lexical"))
    counted = asked.join(lexical, "request_id", "left").fillna(0, ["lexical"])
    reasons = counted.select("request_id", F.lit(None).cast("string").alias("dense_reason"))
    if index is not None:
        queries = counted.withColumnRenamed("lexical", "lexical_matches").join(index.queries.select("request_id", "embedding"), "request_id", "left")
        near, why = dense.retrieve(queries, memories.drop("value"), index.vectors, index.model, policy.dense_mode, policy.min_score, policy.min_margin, policy.minimum, policy.dense_maximum)
        found = found.unionAll(stored(as_channel(near, "dense", "dense"), "dense"))
        reasons = why.select("request_id", F.col("reason").alias("dense_reason"))
    fused = ranking.fuse(found.where("channel <> 'list'"), policy.fusion, policy.exact_precedence, policy.rrf_k).drop("limit")
    plain = found.where("channel = 'list'").select("request_id", "memory_id", "updated_at", F.lit(0).alias("exact_tier"), F.lit(0.0).alias("score"), F.lit("list").alias("channels"), F.col("channel_rank").alias("final_rank"))
    ranked = fused.unionByName(plain)
    per = found.groupBy("request_id").agg(F.max("truncated").alias("truncated"), F.countDistinct(F.when(F.col("channel") != "structured", F.col("memory_id"))).alias("candidates"),
                                          F.max(F.when(F.col("channel") == "dense", 3).when(F.col("stage") == "spelling", 2).when(F.col("channel") == "list", 0).when(F.col("channel") != "structured", 1)).alias("last"))
    stage = F.when(F.col("last") == 3, "dense").when(F.col("last") == 2, "spelling").when(F.col("last") == 1, "literal").when(F.col("query") == "", "list").otherwise("none")
    receipts = (all_asked.select("request_id", "query").join(per, "request_id", "left").join(lexical, "request_id", "left").join(reasons, "request_id", "left")
                .select("request_id", stage.alias("stage"), F.coalesce("lexical", F.lit(0)).alias("lexical"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "dense_reason"))
    return Recalled(ranked, receipts, found)


def fingerprints(requests: DataFrame, policy: RecallPolicy) -> DataFrame:
    """request_id and what a cursor is bound to: who asks for what, under which policy."""
    have = requests.columns
    named = [F.col(c).cast("string") if c in have else F.lit(None).cast("string") for c in (*ASKED[1:], "query")]
    # JSON keeps fields apart whatever they hold.
    text = F.to_json(F.struct(*[c.alias(n) for c, n in zip(named, (*ASKED[1:], "query"), strict=True)], F.lit(policy.fingerprint()).alias("policy")))
    return requests.select("request_id", F.sha2(text, 256).alias("fingerprint"))


def page_of(ranked: DataFrame, requests: DataFrame, policy: RecallPolicy | None = None) -> DataFrame:
    """One page of each request's ranked list: ``requests`` with cursor (null: the first page) and limit (PAGE where null). See ranking.ranked_page."""
    have = requests.columns
    limit = F.coalesce("limit", F.lit(PAGE)) if "limit" in have else F.lit(PAGE)
    cursor = F.col("cursor") if "cursor" in have else F.lit(None).cast("string")
    pages = requests.select("request_id", limit.alias("limit"), cursor.alias("cursor")).join(fingerprints(requests, policy or RecallPolicy()), "request_id")
    return ranking.ranked_page(ranked, pages)
